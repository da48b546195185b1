"""Reads and guards: queries against their SQL, and cases of nulls, ties and empty tables."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lavra.operators import reads
from lavra.plans.queries import QUERIES
from lavra.plans.sql import ORACLE

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "supplier", "part", "customer", "conversations", "embeddings")
NAMES = ["comparison_reads", "proposal_problems", "start_requests", "message_feedback", "refused_feedback", "message_counts", "document_analyses", "agent_findings", "whole_texts", "vectors_available", "analysis_batches"]


@pytest.mark.parametrize("query", NAMES)
def test_query_equals_sql(spark, query):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = db.execute(ORACLE[query])
    names = [c[0] for c in found.description]
    rows = QUERIES[query](spark, SF)
    assert sorted(rows.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r) for r in found.fetchall()), key=key)
    assert sorted((tuple(r) for r in rows.select(names).collect()), key=key) == want and want


def test_comparisons_without_results_or_suppliers(spark):
    jobs = spark.createDataFrame([(1,), (2,)], "id long")
    results = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (1, 9)], "comparacao_id long, fornecedor_id long")
    suppliers = spark.createDataFrame([(7, "b"), (8, "a")], "id long, nome string")
    found = {r["id"]: (r["total_resultados"], [x["nome"] for x in r["fornecedores"]]) for r in reads.comparisons(jobs, results, suppliers).collect()}
    assert found == {1: (4, ["a", "b"]), 2: (0, [])}


def test_proposals_are_checked(spark):
    wanted = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 5, 6)], "comparacao_id long, ord int, proposta_id long")
    documents = spark.createDataFrame([(1, "proposta", 7), (2, "tr", 7), (3, "proposta", None), (4, "proposta", 7), (5, None, 8)], "id long, document_type string, fornecedor_id long")
    found = {r["proposta_id"]: r["problem"] for r in reads.proposal_problems(wanted, documents).collect()}
    assert found == {1: None, 2: "not a proposal", 3: "no supplier", 4: "supplier twice", 5: "not a proposal", 6: "not a proposal"}


def test_requests_to_start(spark):
    analyses = spark.createDataFrame([(1, 1, "pending"), (2, 2, "running"), (3, 2, "pending"), (4, 3, "completed"), (5, 4, None)], "id long, document_id long, status string")
    found = {r["document_id"]: (r["analysis_id"], r["outcome"]) for r in reads.start_requests(spark.range(1, 5).withColumnRenamed("id", "document_id"), analyses).collect()}
    assert found == {1: (1, "queued again"), 2: (2, "refused"), 3: (None, "created"), 4: (None, "created")}


def test_feedback_on_answers_alone(spark):
    messages = spark.createDataFrame([(1, "user"), (2, "assistant"), (3, "assistant")], "id long, role string")
    votes = spark.createDataFrame([(1, 0, "up", None), (2, 0, "up", "x"), (2, 1, "down", None), (9, 0, "up", None)], "message_id long, ord int, rating string, comment string")
    found = {r["id"]: (r["feedback_rating"], r["feedback_comment"]) for r in reads.with_feedback(messages, votes).collect()}
    assert found == {1: (None, None), 2: ("down", None), 3: (None, None)}
    assert {(r["message_id"], r["reason"]) for r in reads.refused_feedback(messages, votes).collect()} == {(1, "not an answer"), (9, "no such message")}


def test_vectors_items_and_failed_agents(spark):
    kind = "id long, embedding array<float>"
    assert [r["available"] for rows in ([], [(1, None)], [(1, [])], [(1, None), (2, [0.5])]) for r in reads.has_vectors(spark.createDataFrame(rows, kind)).collect()] == [False, False, False, True]
    items = spark.createDataFrame([(1, "1.1"), (1, "1"), (2, "1")], "document_id long, item_number string")
    assert [tuple(r) for r in reads.item_by_number(items, F.lit(1), F.lit("1")).collect()] == [(1, "1")]
    asked = spark.createDataFrame([(1, ["a", "b", "c"], [["x"], None, ["y", "z"]]), (2, ["a"], [None])], "item long, agents array<string>, results array<array<string>>")
    assert sorted(tuple(r) for r in reads.agent_findings(asked, "item").collect()) == [(1, "a", 1, "x"), (1, "c", 2, "y"), (1, "c", 3, "z")]


def test_whole_text_with_nulls(spark):
    items = spark.createDataFrame([(1, 1, None, "b"), (1, 0, "t", None)], "document_id long, item_order int, title string, content string")
    assert reads.whole_text(items, "document_id").first()["text"] == "t\n\n\n\nb"


def test_json_report_is_replaced(spark, tmp_path):
    path = str(tmp_path / "report")
    for n in (3, 2):
        reads.json_report(spark.range(n), path)
    assert sorted(json.loads(x)["id"] for f in (tmp_path / "report").glob("part-*") for x in f.read_text().split()) == [0, 1]
