from __future__ import annotations

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lavra import providers
from lavra.functions.text import nfc
from lavra.operators import compliance, drafts, generate, quality, rules, rulesets, tables

OK = {"id": "a", "rotulo": "A", "tipo": "data"}
CONFIGS = [
    None, "", "x", "[1]", "{}", '{"regras": 5}', '{"regras": []}', json.dumps({"regras": [OK]}), json.dumps({"regras": [OK, OK]}), json.dumps({"regras": [OK | {"tipo": "cor"}]}),
    json.dumps({"regras": [OK | {"rotulo": ""}]}), json.dumps({"regras": [OK | {"ancora": "x" * 501}]}), json.dumps({"regras": [OK | {"palavras_chave": ["w"] * 51}]}), json.dumps({"regras": [OK, OK | {"id": "b", "unidade": "dias"}]}),
]


def test_a_table_of_sets_is_checked_as_one_set_is(spark):
    sets = spark.createDataFrame([(i, "n", c, i) for i, c in enumerate(CONFIGS)], "molde_id long, nome string, config string, created_at long")
    got = {r["molde_id"]: r for r in rulesets.created(sets).collect()}
    for i, config in enumerate(CONFIGS):
        try:
            parsed = rules.parse_rules(config or "")
        except rules.RuleError as e:
            assert got[i]["problem"] is not None and got[i]["config"] == config, (config, e)
        else:
            assert got[i]["problem"] is None and [r["id"] for r in json.loads(got[i]["config"])["regras"]] == [r["id"] for r in parsed]
    assert [r["molde_id"] for r in rulesets.listing(sets).collect()] == list(reversed(range(len(CONFIGS))))
    assert [r["molde_id"] for r in rulesets.newest(sets).collect()] == [len(CONFIGS) - 1]
    assert {r["molde_id"] for r in rulesets.rules_table(sets).collect()} == {i for i, c in enumerate(CONFIGS) if c and '"regras": [{' in c}


def test_types_keep_only_what_they_use(spark):
    full = {"ancora": "  ", "unidade": "dias", "expectativa": "", "regex": "1+", "palavras_chave": [" a ", "", "b"]}
    config = json.dumps({"regras": [OK | full, OK | full | {"id": "b", "tipo": "booleano"}, OK | full | {"id": "c", "tipo": "legal"}]})
    row = rulesets.created(spark.createDataFrame([(config,)], "config string")).first()
    kept = json.loads(row["config"])["regras"]
    assert kept == [OK | {"unidade": "dias"}, OK | {"id": "b", "tipo": "booleano", "unidade": "dias", "palavras_chave": ["a", "b"]}, OK | {"id": "c", "tipo": "legal", "unidade": "dias", "regex": "1+"}]


def test_comparison_matrix_has_every_rule_of_its_own_set(spark):
    config = json.dumps({"regras": [OK, OK | {"id": "b", "rotulo": "B"}]})
    sets = spark.createDataFrame([(1, config), (2, json.dumps({"regras": [OK]})), (3, "x")], "molde_id long, config string")
    jobs = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "comparacao_id long, molde_id long")
    results = [(10, 7, "a", "falha"), (10, 7, "a", "ok"), (10, 8, "gone", "ok"), (10, 9, "a", "ok"), (20, 7, "b", "ok"), (30, 7, "a", "ok"), (None, 7, "a", "ok")]
    results = spark.createDataFrame(results, "comparacao_id long, fornecedor_id long, regra_id string, status string").withColumns({c: F.lit(None).cast("string") for c in ("motivo", "valor_tr", "valor_proposta")})
    suppliers = spark.createDataFrame([(7, "S"), (8, "T")], "id long, nome string")
    got = rulesets.comparison_matrix(jobs, sets, results, suppliers)
    cells = {(r["comparacao_id"], r["fornecedor_id"], r["regra_id"]): (r["status"], r["motivo"]) for r in got.collect()}
    none = ("atencao", compliance.MISSING_CELL)
    assert cells == {(10, 7, "a"): ("ok", None), (10, 7, "b"): none, (10, 8, "a"): none, (10, 8, "b"): none, (20, 7, "a"): none}
    assert rulesets.comparison_matrix(jobs.limit(0), sets, results, suppliers).count() == 0


def test_comparison_matrix_takes_the_largest_result(spark):
    """Of several results with missing values, and without an aggregation that sorts all results before their shuffle."""
    rng = random.Random(8)
    ids = ["a", "b", "c", None]
    config = json.dumps({"regras": [OK | {"id": i, "rotulo": i.upper()} for i in ids[:3]]})
    sets = spark.createDataFrame([(1, config)], "molde_id long, config string")
    jobs = spark.createDataFrame([(i, 1) for i in range(6)], "comparacao_id long, molde_id long")
    suppliers = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "id long, nome string")
    few = lambda *x: rng.choice([None, *x])
    rows = [(rng.randrange(6), rng.randrange(5), rng.choice(ids), few("ok", "falha"), few("x", "y"), few("1", "2"), few("3", "10")) for _ in range(400)]
    results = spark.createDataFrame(rows, "comparacao_id long, fornecedor_id long, regra_id string, status string, motivo string, valor_tr string, valor_proposta string").repartition(3)
    got = rulesets.comparison_matrix(jobs, sets, results, suppliers)
    want = {}
    for job, supplier in {r[:2] for r in rows if r[1] < 4}:
        for i in ids[:3]:
            own = max((r[3:] for r in rows if r[:3] == (job, supplier, i)), key=lambda r: [(x is not None, x or "") for x in r], default=(None,) * 4)
            want[job, supplier, i] = (own[0] or "atencao", compliance.MISSING_CELL if own[0] is None else own[1], *own[2:])
    assert {(r["comparacao_id"], r["fornecedor_id"], r["regra_id"]): (r["status"], r["motivo"], r["valor_tr"], r["valor_proposta"]) for r in got.collect()} == want
    assert "partial_collect_list" not in got._jdf.queryExecution().toString()


def test_the_grid_is_dealt_over_salts(spark):
    one = spark.createDataFrame([("a", "A", 0), ("b", "B", 1)], "regra_id string, rotulo string, ord int")
    suppliers = spark.createDataFrame([(i, f"s{i}") for i in range(40)] + [(None, "none")], "id long, nome string")
    found = spark.createDataFrame([(3, "a", "ok", None, None, None)], "fornecedor_id long, regra_id string, status string, motivo string, valor_tr string, valor_proposta string")
    cells = compliance.matrix_cells(one, suppliers, found).collect()
    assert len(cells) == len({(r["fornecedor_id"], r["regra_id"]) for r in cells}) == 82
    assert [(r["fornecedor_id"], r["regra_id"]) for r in cells if r["status"] == "ok"] == [(3, "a")]


def test_sequence_numbers_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, *range(900)]), i) for i in range(2000)]
    table = spark.createDataFrame(rows, "source string, at int, i long").repartition(5)
    got = tables.sequenced(table, ["source"], ["at", "i"], "nth")
    assert got.columns == ["source", "at", "i", "nth"]
    kept = {r["i"]: r["nth"] for r in got.collect()}
    for source in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [kept[r[2]] for r in own] == list(range(len(own)))
    tied = tables.sequenced(table.withColumn("at", F.lit(1)), ["source"], ["at"], "nth").groupBy("source").agg(F.sort_array(F.collect_list("nth")).alias("all")).collect()
    assert all(r["all"] == list(range(len(r["all"]))) for r in tied)
    assert tables.sequenced(table.limit(0), ["source"], ["at"], "nth").count() == 0


def test_first_entry_of_expected_issues(spark):
    expected = spark.createDataFrame([(1, 2, ["x"]), (1, 1, ["a", "b"]), (2, 1, []), (2, 3, ["x"]), (3, 5, ["q"])], "item int, ord int, issues array<string>")
    first = quality.first_expected(expected, ["item"])
    assert sorted(map(tuple, first.collect()), key=str) == [(1, "a"), (1, "b"), (2, None), (3, "q")]
    found = spark.createDataFrame([(1, "A only"), (2, "x")], "item int, text string")
    assert {r["item"]: r["recall"] for r in quality.item_recall(first, found, ["item"]).collect()} == pytest.approx({1: 0.5, 2: 1.0, 3: 0.0})


def test_drafts_of_every_answer(spark):
    values = [(i, "obras_engenharia", "Objeto da obra", "Justificativa da obra", None, 12, True, "menor_preco") for i in range(12)]
    requests = spark.createDataFrame(values, "id long, tipo_contratacao string, objeto string, justificativa string, valor_estimado decimal(18,2), prazo_meses int, garantia_exigida boolean, criterio_julgamento string")
    hits = spark.createDataFrame([(i, n, "Lei 1", f"Art. {n}", None if n == 2 else "texto") for i in range(6) for n in range(1, 6)], "id long, ord int, law_number string, article string, text string")
    asked = drafts.prompts(requests, hits)
    shown = {r["id"]: r["user"] for r in asked.collect()}
    assert shown[3].endswith("Fontes:\n[Lei 1 - Art. 1]\ntexto\n\n[Lei 1 - Art. 2]\n\n\n[Lei 1 - Art. 3]\ntexto") and shown[7].endswith(drafts.NO_CONTEXT)
    answers = providers.generate(asked, "id", providers.RuleDrafter).cache()
    items = {}
    for r in drafts.items(requests, answers).orderBy("item_order").collect():
        items.setdefault(r["id"], []).append(r)
    documents = {r["id"]: r for r in drafts.documents(requests, answers).collect()}
    assert set(documents) == set(range(12)) and set(items) == set(range(12)) - {0, 6}
    for i, d in documents.items():
        assert d["total_items"] == len(items.get(i, [])) and (d["status"] == "error") == (i % 6 == 0) == (d["error"] is not None)
        assert {r["origin"] for r in items.get(i, [])} == (set() if i % 6 == 0 else {"answer"} if i % 6 < 3 else {"template"})
    assert [(r["item_number"], r["title"], r["content"]) for r in items[7]] == [("A.1", "DO OBJETO", "Texto 7 de 0 fontes"), ("2.0", "SEÇÃO 2", "linha")]
    assert [r["title"] for r in items[4]] == [t for t, _ in generate.SECTIONS]


def test_composed_text(spark):
    rows = spark.createDataFrame([(0, unicodedata.normalize("NFD", "é ã")), (1, None), (2, ""), (3, "plain")], "i int, x string").select("i", nfc("x").alias("x")).collect()
    assert {r["i"]: r["x"] for r in rows} == {0: unicodedata.normalize("NFC", "é ã"), 1: None, 2: "", 3: "plain"}
