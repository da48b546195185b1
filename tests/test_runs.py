from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lavra import prompts, providers, storage
from lavra.operators import analysis, runs

ITEMS = "analysis_id long, item_id long, item_order long, mode string, item_number string, title string, page_number int, content string"


def items(spark, *rows):
    return spark.createDataFrame([(a, i, i, mode, f"{a}-{i}", "t", 1, "c") for a, i, mode in rows], ITEMS)


def answers(spark, *rows):
    return spark.createDataFrame([(a, i, agent, text is not None, text, None if text is not None else "sem quota") for a, i, agent, text in rows], "analysis_id long, item_id long, agent string, ok boolean, answer string, error string")


def finding(**fields):
    return {"category": "juridica", "severity": "alto", "problem": "p", "original_text": "o", "suggested_text": "s"} | fields


def test_a_retry_asks_only_what_is_missing(spark, tmp_path):
    some = items(spark, *((2, i, runs.MULTI) for i in range(6)), *((3, i, "single") for i in range(6)))
    asked = runs.calls(some)
    assert asked.count() == 6 * 4 + 6
    store = runs.Answers(spark, str(tmp_path / "answers"), runs.CALL, asked)
    assert store.read().count() == 0
    for attempt in (1, 1, 2):  # an attempt that is made again replaces itself
        store.ask(asked, lambda n=attempt: providers.RuleAnalyst(n), attempt)
    n = lambda a, i, agent: a + i + [*prompts.AGENTS, prompts.SINGLE].index(agent)
    keys = [(r["analysis_id"], r["item_id"], r["agent"]) for r in asked.collect()]
    first_failed = {k for k in keys if n(*k) % 7 == 0 or n(*k) % 5 == 0}
    second = spark.read.parquet(f"{store.path}/attempt=2")
    assert {tuple(r) for r in second.select(*runs.CALL).collect()} == first_failed
    got = {tuple(r[c] for c in runs.CALL): r for r in store.read().collect()}
    assert len(got) == len(keys)
    for k, r in got.items():
        assert r["ok"] == (n(*k) % 7 != 0) and (r["answer"] is None) == (n(*k) % 7 == 0) and (r["error"] is None) == r["ok"]


def test_statuses(spark):
    some = items(spark, (1, 1, "single"), (1, 2, "single"), (2, 1, "single"), (3, 1, runs.MULTI), (4, 1, runs.MULTI), (5, 1, "single"))
    four = [(3, 1, a, None) for a in prompts.AGENTS]
    found = answers(spark, (1, 1, "geral", "[]"), (1, 2, "geral", None), (2, 1, "geral", None), *four, (4, 1, "juridico", "[]"))
    got = {r["analysis_id"]: (r["status"], r["total_items"], r["analyzed_items"], r["error_message"] is not None) for r in runs.statuses(some, found).collect()}
    # Failed agents leave an item analysed without findings; a failed single agent skips it.
    assert got == {1: ("completed", 2, 1, False), 2: ("error", 1, 0, True), 3: ("completed", 1, 1, False), 4: ("running", 1, 0, False), 5: ("running", 1, 0, False)}


def test_findings_of_agents(spark):
    some = items(spark, (1, 1, runs.MULTI), (2, 1, "single"))
    text = json.dumps
    found = answers(
        spark, (1, 1, "juridico", text([finding(problem=" P ", category="tecnica"), finding(problem="q", severity="GRAVE"), finding(suggested_text="")])), (1, 1, "tecnico", text([finding(problem="p"), finding(problem="r")])),
        (1, 1, "redacao", text([finding(problem="x"), "texto"])), (1, 1, "estrutural", text(finding())), (2, 1, "geral", "ok " + text([finding(), 3, finding(), finding(category="X", problem="y")]) + " fim"),
    )
    got = sorted((r["analysis_id"], r["correction_index"], r["agent"], r["category"], r["severity"], r["problem"], r["agent_origin"]) for r in runs.findings(some, found).collect())
    assert got == [
        (1, 0, "juridico", "juridica", "alto", " P ", "juridico"), (1, 1, "juridico", "juridica", "medio", "q", "juridico"), (1, 2, "tecnico", "tecnica", "alto", "r", "tecnico"),
        (2, 0, "geral", "juridica", "alto", "p", None), (2, 1, "geral", "juridica", "alto", "p", None), (2, 2, "geral", "tecnica", "alto", "y", None),
    ]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"review": [{"correction_index": 1, "status": "Rejeitada", "note": "n"}]}', [("pendente", None), ("rejeitada", "n")]),
        ('[{"correction_index": "1", "status": "aprovada"}, "x", null, 4]', [("pendente", None), ("aprovada", None)]),
        ('x ```json\n[{"correction_index": 1.9, "status": "nada"}]\n```', [("pendente", None), ("aprovada", None)]),
        ('[{"correction_index": -5}, {"correction_index": "dois", "status": "rejeitada"}]', [("rejeitada", None), ("pendente", None)]),
        ('[{"correction_index": 70, "status": "aprovada"}]', [("pendente", None), ("aprovada", None)]),
        ('{"review": "tudo certo"}', [("pendente", None)] * 2),
        ('{"outra": [{"correction_index": 0, "status": "rejeitada"}]}', [("pendente", None)] * 2),
        ("nada", [("pendente", None)] * 2),
        (None, [("pendente", None)] * 2),
    ],
)
def test_reviews_of_all_shapes(spark, answer, want):
    found = spark.createDataFrame([(1, 1, i, "s", "j") for i in range(2)], "analysis_id long, item_id long, correction_index int, suggested_text string, justification string")
    told = spark.createDataFrame([(1, 1, answer is not None, answer, None)], "analysis_id long, item_id long, ok boolean, answer string, error string")
    got = [(r["review_status"], r["review_note"]) for r in runs.reviewed(found, told).orderBy("correction_index").collect()]
    assert got == want


def test_an_adjustment_changes_the_text_and_keeps_what_it_lacks(spark):
    found = spark.createDataFrame([(1, 1, 0, "s", "j")], "analysis_id long, item_id long, correction_index int, suggested_text string, justification string")
    text = json.dumps({"review": [{"status": "ajustada", "adjusted_suggested_text": " novo ", "adjusted_justification": " "}, {"status": "aprovada", "adjusted_suggested_text": "não"}]})
    told = spark.createDataFrame([(1, 1, True, text, None)], "analysis_id long, item_id long, ok boolean, answer string, error string")
    row = runs.reviewed(found, told).first()
    assert (row["review_status"], row["suggested_text"], row["justification"]) == ("aprovada", "novo", "j")


def test_scores_fall_back(spark):
    states = spark.createDataFrame([(i, "completed", 3, 3, None) for i in range(1, 6)] + [(9, "error", 1, 0, "x")], "analysis_id long, status string, total_items long, analyzed_items long, error_message string")
    kept = spark.createDataFrame([(1, "juridica", "critico")], "analysis_id long, category string, severity string")
    good = {"score_overall": 6, "score_juridical": 5.5}
    told = [(1, True, json.dumps([good])), (2, True, json.dumps(good)), (3, True, '{"score_overall": 0}'), (4, True, "[]"), (5, False, None)]
    answered = spark.createDataFrame(told, "analysis_id long, ok boolean, answer string")
    got = {r["analysis_id"]: (r["score_overall"], r["score_juridical"], r["risk_level"], r["fallback"]) for r in runs.scored(states, kept, answered).collect()}
    assert got == {1: (6.0, 5.5, "medio", False), 2: (6.0, 5.5, "medio", False), 3: (10.0, 10.0, "baixo", True), 4: (10.0, 10.0, "baixo", True), 5: (10.0, 10.0, "baixo", True)}
    assert runs.scored(states, kept, answered.limit(0)).filter("analysis_id = 1").first()["risk_level"] == "critico"


def test_the_scorer_sees_the_first_findings_in_order(spark):
    states = spark.createDataFrame([(1, "completed", 2, 2, None), (2, "completed", 1, 1, None)], "analysis_id long, status string, total_items long, analyzed_items long, error_message string")
    rows = [(1, i // 40, i // 40, i % 40, "juridica", "alto", f"p{i}" + "x" * 200) for i in range(80)]
    kept = spark.createDataFrame(rows, "analysis_id long, item_id long, item_order long, correction_index int, category string, severity string, problem string")
    got = {r["analysis_id"]: r["user"].split("\n") for r in runs.scoring_calls(states, kept).collect()}
    lines = [x for x in got[1] if "[juridica]" in x]
    assert len(lines) == 50 and lines[0].startswith("1. [juridica] [alto] p0x") and lines[49].startswith("50. [juridica] [alto] p49") and len(lines[0]) == len("1. [juridica] [alto] ") + 100
    assert "Correções: 80" in got[1] and prompts.NO_FINDINGS in got[2]


def test_prompts_of_odd_items(spark):
    some = spark.createDataFrame([(1, 1, 1, "single", None, "", None, None), (1, 2, 2, "single", "2", "T", 7, "x" * 9000)], ITEMS)
    contexts = spark.createDataFrame([(1, 2, "### Lei")], "analysis_id long, item_id long, context string")
    got = [r["user"] for r in runs.calls(some, contexts).orderBy("item_id").collect()]
    assert prompts.NO_TITLE in got[0] and prompts.NO_PAGE in got[0] and prompts.NO_CONTEXT in got[0]
    assert "### Lei" in got[1] and got[1].count("x") == prompts.CONTENT_CHARS + 1  # one stands in "Contexto"


def test_tables_that_are_not_there_are_empty(spark, tmp_path):
    assert storage.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    assert analysis.kept(spark.createDataFrame([("rejeitada",), ("pendente",)], "review_status string")).count() == 1
    assert storage.stored(spark.range(3), str(tmp_path / "some")).agg(F.sum("id")).first()[0] == 3
