from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lavra import providers, schemas
from lavra.functions import text as tf
from lavra.operators import analysis, chat, chunk, compliance, diff, generate, quality, retrieval, rules, structure, tables
from lavra.sources import files, html

# ---------------------------------------------------------------- rules and compliance


@pytest.mark.parametrize(
    "config",
    ["{", "[]", {"regras": []}, {"regras": [{"id": "a", "rotulo": "A", "tipo": "outro"}]}, {"regras": [{"id": "a", "rotulo": "A", "tipo": "cep"}] * 2}, {"regras": [{"rotulo": "A", "tipo": "cep"}]}],
)
def test_rule_sets_are_checked(config):
    with pytest.raises(rules.RuleError):
        rules.parse_rules(config)


COMPARED = [
    ("numero_inteiro", "90", "90", "ok"), ("numero_inteiro", "90", "90.0", "ok"), ("numero_inteiro", "90.0", "90", "ok"), ("percentual", "12.34", "123.4", "falha"),
    ("monetario", "1.500,00", "1500.00", "ok"), ("monetario", "1.500,00", "1600.00", "falha"), ("numero_inteiro", "90", "60", "falha"), ("numero_inteiro", "90", None, "falha"),
    ("numero_inteiro", None, "90", "atencao"), ("booleano", "sim", "sim", "ok"), ("booleano", "sim", "não", "falha"), ("booleano", "não", "sim", "ok"), ("legal", "sim", None, "falha"),
    ("data", "2026-12-15", "2026-12-15", "ok"), ("data", "2026-12-15", "2026-12-16", "falha"), ("prazo_relativo", "30 dias", "trinta dias", "falha"), ("cep", "40015-000", None, "falha"),
]


def test_comparison_ladder(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(COMPARED)], "i int, tipo string, a string, b string")
    status, reason = compliance.compare(F.col("tipo"), F.col("a"), F.col("b"))
    found = df.select("i", status.alias("s"), reason.alias("r")).orderBy("i").collect()
    assert [r["s"] for r in found] == [c[3] for c in COMPARED]
    assert found[6]["r"] == "Valor da proposta (60) diverge do esperado no Termo de Referência (90)."
    assert found[16]["r"] == "Cep não localizado(a) na proposta do fornecedor."


def test_matrix_fills_missing_cells(spark):
    rule = spark.createDataFrame([("r1", "Regra 1", 0)], "regra_id string, rotulo string, ord int")
    suppliers = spark.createDataFrame([("a", "A", "a@x"), ("b", "B", "b@x")], "id string, nome string, email string")
    found = spark.createDataFrame([("a", "r1", "ok", "m", "1", "1")], "fornecedor_id string, regra_id string, status string, motivo string, valor_tr string, valor_proposta string")
    cells = {r["fornecedor_id"]: (r["status"], r["motivo"]) for r in compliance.matrix_cells(rule, suppliers, found).collect()}
    assert cells == {"a": ("ok", "m"), "b": ("atencao", compliance.MISSING_CELL)}


def test_pendencies_fall_back_to_the_rule_id(spark):
    found = spark.createDataFrame([("a", "r9", "falha", "m", None, "")], "fornecedor_id string, regra_id string, status string, motivo string, valor_tr string, valor_proposta string")
    labels = spark.createDataFrame([], "regra_id string, rotulo string, ord int")
    row = compliance.pendencies(found, labels).first()
    assert (row["rotulo"], row["valor_tr"], row["valor_proposta"]) == ("r9", "não informado", "não informado")


# ---------------------------------------------------------------- structure and chunks


def outline(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [(r["item_type"], r["item_number"], r["title"]) for r in structure.items(df).orderBy("item_order").collect()]


def test_structure_golden_sequence(spark):
    text = "1. OBJETO\ntexto\n1.1 Escopo\nx\n1.2 Prazo\ny\n2.\n\nJUSTIFICATIVA\nz\n2.1 Motivo\nw\n[TABELA]\na | b\n[/TABELA]\n2.2 Fim\nq"
    assert [(a, b) for a, b, _ in outline(spark, text)] == [("section", "1"), ("item", "1.1"), ("item", "1.2"), ("section", "2"), ("item", "2.1"), ("table", "TAB-6"), ("item", "2.2")]


def test_structure_openings(spark):
    assert outline(spark, "a) primeira alínea\nb) BTU\nII - segunda parte\nANEXO I - Modelo\nCLÁUSULA PRIMEIRA") == [
        ("subitem", "a", "primeira alínea"), ("section", "II", "segunda parte"), ("annex", "ANEXO I", "Modelo"), ("section", "CLÁUSULA PRIMEIRA", "CLÁUSULA PRIMEIRA"),
    ]
    assert outline(spark, "só texto") == [("section", "1", "Documento Completo")]
    assert [n for _, n, _ in outline(spark, "1.1 A\nx\n1.1 B\ny\n1.1 C\nz")] == ["1.1", "1.1-1", "1.1-2"]
    assert outline(spark, "1.\n2.\nTítulo\nx")[0][1:] == ("2", "Título")
    assert outline(spark, "[TÍTULO] Objeto\nx") == outline(spark, "[TÍTULO] Objeto\nx")


def test_structure_of_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "doc_id int, text string")
    assert structure.items(df).count() == 0


def test_paragraph_packing(spark):
    text = "# cabeçalho\n" + "\n".join(f"linha {i:02d} " + "x" * 20 for i in range(40)) + f"\n{chunk.FOOTER}\nfora"
    rows = chunk.paragraph_chunks(spark.createDataFrame([(1, text)], "doc_id int, text string"), limit=150).orderBy("chunk_index").collect()
    assert len(rows) > 1 and all(len(r["chunk_text"]) <= 220 for r in rows)
    assert [r["article"] for r in rows][:3] == ["Trecho 1", "Trecho 2", "Trecho 3"]
    joined = "\n".join(r["chunk_text"] for r in rows)
    assert "fora" not in joined and "cabeçalho" not in joined and joined.count("linha") == 40


def test_law_chunks(spark):
    text = "LEI Nº 1\nTÍTULO I\nDISPOSIÇÕES\nArt. 1º Um.\n§ 1º a\nCAPÍTULO II\nArt. 2º. Dois.\nNOME\n" + chunk.FOOTER + "\nArt. 3º"
    rows = chunk.law_chunks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("chunk_index").collect()
    assert [(r["article"], r["section"], r["chunk_text"]) for r in rows] == [("Art. 1º", "TÍTULO I - DISPOSIÇÕES", "Art. 1º Um.\n§ 1º a"), ("Art. 2º", "CAPÍTULO II", "Art. 2º. Dois.\nNOME")]


def test_page_of_line(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(6)], "doc int, pos int, line string")
    pages = spark.createDataFrame([(1, 1, "l0\nl1"), (1, 2, "l3\nl4\nl5")], "doc int, page int, text string")
    assert [r["page"] for r in structure.pages_of_lines(lines, pages, "doc").orderBy("pos").collect()] == [1, 1, 1, 2, 2, 2]


# ---------------------------------------------------------------- versions


def test_diff_statuses_and_order(spark):
    schema = "item_number string, title string, content string, item_order int"
    old = spark.createDataFrame([("1.1", "A", "igual", 0), ("2", "B", "o prazo é de trinta dias corridos", 1), ("10", "C", "sai", 2), ("3", "D", "completamente outro", 3)], schema)
    new = spark.createDataFrame([("1.1", "A", " IGUAL ", 0), ("2", "B", "o prazo é de trinta dias corridos.", 1), ("11", "E", "entra", 2), ("3", "D", "xyz 123", 3)], schema)
    found = diff.diff(old, new).orderBy("sort_key").collect()
    assert [(r["item_number"], r["status"]) for r in found] == [("1.1", "inalterado"), ("2", "inalterado"), ("3", "alterado"), ("10", "removido"), ("11", "adicionado")]
    assert diff.summary(diff.diff(old, new)).first().asDict() == {"n_adicionado": 1, "n_removido": 1, "n_alterado": 1, "n_inalterado": 2}


def test_duplicate_numbers_keep_the_last(spark):
    schema = "item_number string, title string, content string, item_order int"
    old = spark.createDataFrame([("1", "A", "primeiro", 0), ("1", "A", "segundo", 1)], schema)
    assert diff.diff(old, old).first()["conteudo_antes"] == "segundo"


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("10", "2", "1.1", "1.10", "1.2", "TAB-6", "a")], "n string")
    assert [r["n"] for r in df.orderBy(tf.natural_key(F.col("n"))).collect()] == ["1.1", "1.2", "1.10", "2", "10", "TAB-6", "a"]


def test_snapshot_and_restore(spark):
    items = spark.createDataFrame([("d", "1", "T", "um", 1, 0, "item"), ("d", "2", "T", "dois", 1, 1, "item")], "document_id string, item_number string, title string, content string, page_number int, item_order int, item_type string")
    none = spark.createDataFrame([], "document_id string, versao int")
    saved = tables.snapshot(items, none, F.lit("v1"))
    assert saved.first()["versao"] == 1
    changed = items.withColumn("content", F.lit("outro")).withColumn("item_number", F.when(F.col("item_number") == "2", "3").otherwise(F.col("item_number")))
    assert [(r["item_number"], r["content"]) for r in tables.restore(changed, saved).orderBy("item_number").collect()] == [("1", "um"), ("3", "outro")]


# ---------------------------------------------------------------- retrieval


def test_cosine_ranking_and_fusion(spark):
    chunks = spark.createDataFrame([("Art. 6º", [1.0, 0.0, 0.0]), ("Art. 7º", [0.0, 1.0, 0.0]), ("Art. 40º", [0.8, 0.6, 0.0]), ("vazio", None)], "id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "q int, embedding array<float>")
    best = retrieval.top_k(retrieval.semantic(asked, chunks, "q", "id"), "q", [F.desc("score"), F.col("id")], 2)
    assert [r["id"] for r in best.orderBy("rank").collect()] == ["Art. 6º", "Art. 40º"]
    other = best.withColumn("rank", 3 - F.col("rank"))
    assert [r["id"] for r in retrieval.fuse([best, other], "q", "id").orderBy("rank").collect()] == ["Art. 6º", "Art. 40º"]


def test_text_search_ignores_accents_and_empty_queries(spark):
    chunks = spark.createDataFrame([(1, "Instruções de SEGURANÇA do trabalho"), (2, "outro tema"), (3, "mais um tema"), (4, None)], "id int, text string")
    asked = spark.createDataFrame([(1, "instrucoes de seguranca"), (2, ""), (3, None)], "q int, text string")
    found = retrieval.bm25(asked, retrieval.postings(chunks, "id"), chunks, "q", "id").collect()
    assert [(r["q"], r["id"]) for r in found] == [(1, 1)] and found[0]["score"] < 0
    assert retrieval.ilike(chunks, "SEGURANÇA x").count() == 1 and retrieval.ilike(chunks, " ").count() == 0


# ---------------------------------------------------------------- analysis


def test_findings_are_recovered(spark):
    one = '{"category":"juridica","problem":"p","original_text":"o","suggested_text":"s"}'
    raws = [one, f"[{one},{one}]", f"```json\n[{one}]\n```", f"veja: [{one}] fim", "nada", "[1", None]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    assert [r["n"] for r in df.select("i", F.size(analysis.parsed_findings(F.col("raw"))).alias("n")).orderBy("i").collect()] == [1, 2, 1, 1, 0, 0, 0]


def test_sanitize(spark):
    df = spark.createDataFrame([("X", "ALTO", None, "p" * 3000, None)], "category string, severity string, importance string, problem string, legal_basis string")
    r = analysis.sanitized(df).first()
    assert (r["category"], r["severity"], r["importance"], len(r["problem"]), r["legal_basis"]) == ("tecnica", "alto", "media", 2000, None)


def test_review_last_decision_and_last_adjustment(spark):
    found = spark.createDataFrame([(1, 0, "s", "j"), (1, 1, "s", "j"), (1, 2, "s", "j")], "a int, correction_index int, suggested_text string, justification string")
    raw = spark.createDataFrame(
        [(1, 0, "0", "ajustada", "n", "novo", None), (1, 1, "0", "aprovada", "m", "x", None), (1, 2, "9", "rejeitada", None, None, None)],
        "a int, ord int, correction_index string, status string, note string, adjusted_suggested_text string, adjusted_justification string",
    )
    out = {r["correction_index"]: (r["review_status"], r["suggested_text"]) for r in analysis.reviewed(found, analysis.decisions(raw, F.lit(3)), ["a"]).collect()}
    assert out == {0: ("aprovada", "novo"), 1: ("pendente", "s"), 2: ("rejeitada", "s")}
    assert analysis.kept(analysis.reviewed(found, analysis.decisions(raw, F.lit(3)), ["a"])).count() == 2


def test_dedupe_keeps_the_first_and_empty_sides(spark):
    df = spark.createDataFrame([(1, 0, " A ", "p"), (1, 1, "a", "P"), (1, 2, "", "p"), (1, 3, "", "p")], "k int, ord int, original_text string, problem string")
    assert [r["ord"] for r in analysis.deduplicated(df, ["k"], "ord").orderBy("ord").collect()] == [0, 2, 3]


def test_scores(spark):
    df = spark.createDataFrame([(1, "juridica", "baixo"), (1, "tecnica", "info"), (2, "juridica", "critico"), (3, "outra", "alto")], "k int, category string, severity string")
    out = {r["k"]: (float(r["score_juridica"]), float(r["score_tecnica"]), float(r["score_overall"]), r["risk_level"]) for r in analysis.fallback_scores(df, "k").collect()}
    assert out == {1: (9.8, 9.3, 9.7, "baixo"), 2: (7.5, 10.0, 9.1, "critico"), 3: (10.0, 10.0, 10.0, "alto")}


def test_corrections_replace_first_occurrences(spark):
    df = spark.createDataFrame([("aa b aa", [("aa", "x"), ("zz", "y"), ("b", "")])], "t string, c array<struct<original:string,suggested:string>>")
    assert df.select(analysis.applied(F.col("t"), F.col("c")).alias("t")).first()["t"] == "x  aa"


def test_max_severity_and_progress(spark):
    df = spark.createDataFrame([(1, "baixo"), (1, "alto"), (2, "x")], "k int, severity string")
    assert {r["k"]: r["max_severity"] for r in analysis.max_severity(df, "k").collect()} == {1: "alto", 2: "info"}
    assert spark.range(1).select(analysis.progress(F.lit(1), F.lit(0)).alias("p")).first()["p"] == 100


# ---------------------------------------------------------------- chat


ANSWERS = [
    ("nada", True, "resposta-invalida"), ('{"refused": true, "reason": "r"}', True, "r"), ('{"answer": 5}', True, "resposta-vazia"), ('{"answer": "a", "citations": []}', True, "sem-citacao"),
    ('x {"answer": "a", "citations": [{"type": "legal"}], "grounded": true, "confidence": -3} y', False, None), (None, True, "resposta-invalida"),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, raw string")
    out = chat.validated(df).orderBy("i").collect()
    assert [(r["refused"], r["reason"]) for r in out] == [(a[1], a[2]) for a in ANSWERS]
    assert (out[4]["content"], out[4]["grounded"], out[4]["confidence"]) == ("a", True, 0.0)
    free = chat.validated(df.filter("i = 3"), grounding=False).first()
    assert (free["refused"], free["content"]) == (False, "a")


def test_failover_and_embedding(spark):
    class Slow:
        name = "slow"

        def generate(self, system, user):
            import time

            time.sleep(3)

    class Bad:
        name = "bad"

        def generate(self, system, user):
            raise ValueError("quota")

    answer = providers.Failover([Bad(), Slow(), providers.EchoAnswers()], timeout=0.2).generate("", "[1] tipo=legal | reference=Art. 5")
    assert "Art. 5" in answer
    with pytest.raises(providers.ProviderError, match="quota"):
        providers.Failover([Bad()]).generate("", "")
    df = spark.createDataFrame([(1, "um texto"), (2, "um texto"), (3, None)], "id int, text string")
    rows = {r["id"]: r["embedding"] for r in providers.embed(df, "id", providers.HashingEmbedder).collect()}
    assert set(rows) == {1, 2} and rows[1] == rows[2] and abs(sum(x * x for x in rows[1]) - 1) < 1e-5


# ---------------------------------------------------------------- quality, documents, sources


def test_quality(spark):
    expected = spark.createDataFrame([("d", "1", "prazo"), ("d", "1", "multa"), ("d", "2", None)], "doc string, item string, keyword string")
    found = spark.createDataFrame([("d", "1", "falta o PRAZO")], "doc string, item string, text string")
    counts = spark.createDataFrame([("d", 4, 2)], "doc string, generated int, kept int")
    r = quality.document_quality(quality.item_recall(expected, found, ["doc", "item"]), counts, "doc").first()
    assert (r["recall"], r["precision"], round(r["f1"], 6)) == (0.75, 0.5, 0.6)


def test_generated_document(spark):
    r = spark.createDataFrame([(1, "compras_gerais", "Aquisição de cadeiras", "Porque faltam cadeiras", 1500.0, 12, True, "menor_preco")], "id int, tipo_contratacao string, objeto string, justificativa string, valor_estimado double, prazo_meses int, garantia_exigida boolean, criterio_julgamento string")
    items = generate.sections(r).orderBy("item_order").collect()
    assert len(items) == 10 and items[6]["content"] == "Valor estimado global: R$ 1,500.00." and items[3]["content"].endswith("12 meses.")
    assert generate.html(generate.sections(r), r).first()["html"].startswith("<h1>TERMO DE REFERÊNCIA — AQUISIÇÃO DE BENS / COMPRAS GERAIS</h1>\n<h2>1.0 DO OBJETO</h2>")


def test_html(spark):
    page = "<html><head><meta charset='utf-8'><style>p{}</style></head><body><p>Art. 1&ordm;  Um</p><div>dois<br>três</div><script>x</script></body>"
    assert html.page_blocks(page) == "Art. 1º Um\ndois\ntrês" and html.page_blocks(None) == ""
    df = spark.createDataFrame([(page, None), ("<p>", "text/html; charset=cp1252"), ("<p>", None)], "h string, t string")
    assert [r["c"] for r in df.select(html.charset(F.col("h"), F.col("t")).alias("c")).collect()] == ["utf-8", "cp1252", "latin-1"]


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "<w:p><w:pPr><w:pStyle w:val='{}'/></w:pPr><w:r><w:t>{}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p.format('Heading1', 'OBJETO')}{table}{p.format('ListBullet', 'item')}{p.format('Normal', 'texto')}</w:body></w:document>")
    return out.getvalue()


def test_office_files(spark):
    odt = io.BytesIO()
    with zipfile.ZipFile(odt, "w") as z:
        z.writestr("content.xml", '<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:h>OBJETO</text:h><text:p>texto</text:p></o>')
    df = spark.createDataFrame([("a.docx", _docx()), ("b.odt", odt.getvalue()), ("c.pdf", b"%PDF"), ("d.docx", b"x")], "path string, content binary")
    rows = {r["path"]: r for r in files.parsed(df).collect()}
    assert rows["a.docx"]["text"] == "[TÍTULO] OBJETO\n  • item\ntexto\n[TABELA]\na | b\n[/TABELA]"
    assert rows["b.odt"]["text"] == "[TÍTULO] OBJETO\ntexto" and rows["b.odt"]["pages"][0]["page"] == 1
    assert rows["c.pdf"]["error"] and rows["d.docx"]["error"]
    assert files.pdf_pages(b"", [lambda raw: ["x"]], lambda raw: ["texto do OCR"]) == ["texto do OCR"]


def test_upload_checks(spark):
    df = spark.createDataFrame([("a.pdf", 4, b"%PDF"), ("b.exe", 1, b"x"), ("c.docx", 3, b"abc"), ("d.pdf", 0, b"")], "path string, length long, content binary")
    assert [r["problem"] for r in tables.upload_checks(df).orderBy("path").collect()] == [None, "extension", "content doesn't match the extension", "empty"]


def test_text_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# R-1\n# Título: Um título\ncorpo\n")
    (tmp_path / "b.txt").write_text("corpo")
    corpus = files.text_corpus(spark, str(tmp_path))
    number, title = chunk.header(F.col("text"), F.col("stem"), "RILC")
    assert [tuple(r) for r in corpus.select(number, title).orderBy("stem").collect()] == [("R-1", "Um título"), ("RILC b", "b")]


# ---------------------------------------------------------------- tables and schemas


def test_table_operators(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, nome string")
    assert sorted(r["id"] for r in tables.without_duplicates(t, ["nome"]).collect()) == [1, 2]
    assert [r["id"] for r in tables.page(t, [F.desc("id")], 2, 1).collect()] == [2]
    assert sorted(tuple(r) for r in tables.upsert(t, spark.createDataFrame([(2, "z"), (9, "y")], t.schema), "id").collect()) == [(1, "a"), (2, "z"), (3, "a"), (9, "y")]
    children = spark.createDataFrame([(10, 1), (11, 2)], "id int, parent int")
    assert [r["id"] for r in tables.cascade(t.filter("id = 1"), {"c": (children, "parent", "")})["c"].collect()] == [11]
    assert [r["id"] for r in tables.in_use(t, children, "parent").orderBy("id").collect()] == [1, 2]
    assert [r["parent"] for r in tables.set_null_missing(children, t.filter("id = 1"), "parent").orderBy("id").collect()] == [1, None]


def test_schemas(spark):
    for ddl in schemas.TABLES.values():
        spark.createDataFrame([], ddl)
    t = spark.createDataFrame([("ok",), ("outro",), (None,)], "status string")
    assert schemas.rejects(t, {"status": schemas.in_domain("status", "result_status")}).count() == 2
    assert schemas.add_columns(t, {"status": "string", "nota": "int"}).columns == ["status", "nota"]
