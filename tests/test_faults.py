"""Cases in which operators once departed from the rules they implement."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from lavra.functions import text as tf
from lavra.operators import analysis, chat, chunk, diff, rules, structure, tables
from lavra.sources import files
from lavra.streaming import rates


def test_renaming_skips_names_that_are_taken(spark):
    def brute(numbers):
        seen = []
        for n in numbers:
            k = 1
            name = n
            while name in seen:
                name, k = f"{n}-{k}", k + 1
            seen.append(name)
        return seen

    cases = {"a": ["1", "1-1", "1"], "b": ["1", "1", "1-1", "1"], "c": ["2", "2", "2"], "d": ["1-1", "1", "1", "1"], "e": ["1-1-1", "1-1", "1", "1", "1-1"]}
    rows = [(k, i, n) for k, ns in cases.items() for i, n in enumerate(ns)]
    out = structure.renamed_duplicates(spark.createDataFrame(rows, "k string, i int, n string"), "k", "n", "i").orderBy("k", "i").collect()
    assert {k: [r["n"] for r in out if r["k"] == k] for k in cases} == {k: brute(ns) for k, ns in cases.items()}


def test_long_numbers_keep_their_order(spark):
    numbers = ["1.12345678901", "1.12345678902", "1.123456789019", "1.9", "1.0010", "b", "0"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string").withColumn("key", tf.natural_key(F.col("n")))
    assert df.select("key").distinct().count() == len(numbers)
    assert [r["n"] for r in df.orderBy("key").collect()] == ["0", "1.9", "1.0010", "1.12345678901", "1.12345678902", "1.123456789019", "b"]


def test_rejected_events_dont_count(spark):
    rows = [(i, "u", t) for i, t in enumerate((0, 10, 55, 65))] + [(9, "v", 5), (10, None, 1)]
    df = spark.createDataFrame(rows, "id int, user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = {r["id"]: r["admitted"] for r in rates.limited(df, "user", "ts", "id", 2, 60).collect()}
    assert out == {0: True, 1: True, 2: False, 3: True, 9: True, 10: True}


def test_keywords_are_trimmed():
    rule = {"id": "a", "rotulo": "b", "tipo": "booleano", "palavras_chave": [" x ", "", "  "]}
    assert rules.parse_rules({"regras": [rule]})[0]["palavras_chave"] == ["x"]
    assert rules.parse_rules({"regras": [rule | {"palavras_chave": [""]}]})[0]["palavras_chave"] is None


def test_diff_writes_missing_texts_as_empty(spark):
    kind = "item_order int, item_number string, title string, content string"
    old, new = spark.createDataFrame([(0, "1", "antigo", None), (1, "2", None, "b")], kind), spark.createDataFrame([(0, "1", None, None), (1, "3", None, None)], kind)
    out = {r["item_number"]: (r["status"], r["titulo"], r["conteudo_antes"], r["conteudo_depois"]) for r in diff.diff(old, new).collect()}
    assert out == {"1": ("inalterado", "", "", ""), "2": ("removido", "", "b", None), "3": ("adicionado", "", None, "")}


def _archive(*names):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in names:
            z.writestr(name, text)
    return raw.getvalue()


def test_office_types_are_told_apart(spark):
    odt = _archive(("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", "<a/>"))
    docx = _archive(("[Content_Types].xml", "<a/>"), ("word/document.xml", "<a/>"))
    rows = [(f"{n}.{k}", len(c), c) for n, c in (("a", odt), ("b", docx)) for k in ("docx", "odt")]
    out = {r["path"]: r["problem"] for r in tables.upload_checks(spark.createDataFrame(rows, "path string, length long, content binary")).collect()}
    wrong = "content doesn't match the extension"
    assert out == {"a.docx": wrong, "a.odt": None, "b.docx": None, "b.odt": wrong}


def test_broken_archives_become_error_rows(spark, monkeypatch):
    broken = bytearray(_archive(("word/document.xml", "<a>" + "x" * 500 + "</a>")))
    broken[6] |= 1  # marked as encrypted
    at = bytes(broken).index(b"PK\x01\x02")
    broken[at + 8] |= 1
    out = files.parsed(spark.createDataFrame([("a.docx", bytes(broken))], "path string, content binary")).first()
    assert out["text"] is None and out["error"]
    monkeypatch.setattr(files, "MAX_UNPACKED", 100)
    try:
        files.docx_text(_archive(("word/document.xml", "<a>" + "x" * 500 + "</a>")))
    except ValueError as e:
        assert "larger" in str(e)
    else:
        raise AssertionError("no bound")


def test_a_bare_mark_leaves_the_title(spark):
    number, title = chunk.header(F.lit("# Lei 1\n# T\u00edtulo: Das Compras\n#\ncorpo"), F.lit("arquivo"))
    assert tuple(spark.range(1).select(number, title).first()) == ("Lei 1", "Das Compras")


def test_failed_providers_have_a_reason_of_their_own(spark):
    df = spark.createDataFrame([(None, True), (None, False)], "raw string, broke boolean")
    assert {r["broke"]: r["reason"] for r in chat.validated(df, failed="broke").collect()} == {True: "falha-llm", False: "resposta-invalida"}


def test_analyses_without_findings_are_scored_and_reported(spark):
    found = spark.createDataFrame([(1, 0, "juridica", "alto")], "k long, ord int, category string, severity string")
    out = {r["k"]: (float(r["score_overall"]), r["risk_level"]) for r in analysis.fallback_scores(found, "k", spark.createDataFrame([(1,), (2,)], "k long")).collect()}
    assert out[2] == (10.0, "baixo") and out[1][1] == "alto"
    whole = found.withColumns({c: F.lit("t") for c in ("situation", "problem", "risk", "original_text", "suggested_text", "justification", "legal_basis")})
    heads = spark.createDataFrame([(1, "D", "completed", 9.5, "alto", "op"), (2, "E", "completed", 0.0, None, None)], "k long, document_name string, status string, score_overall double, risk_level string, final_opinion string")
    text = {r["k"]: r["report"] for r in analysis.markdown_report(heads.withColumn("analyzed_at", F.lit(None).cast("timestamp")), whole, "k").collect()}
    assert "| Nota Geral | 9.5/10 |" in text[1] and "### Corre\u00e7\u00e3o 1 \u2014 Jur\u00eddica (\U0001f7e0 Alto)" in text[1] and "## \U0001f4dd Parecer Final\n\nop\n\n---" in text[1]
    assert "| Nota Geral | N/A |" in text[2] and analysis.NO_FINDINGS in text[2] and text[2].endswith("*Gerado em: N/A*")
