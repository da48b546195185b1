"""Queries run over whole tables and whole texts, as their SQL does."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lavra.operators import retrieval
from lavra.plans.queries import QUERIES
from lavra.plans.sql import ORACLE

SF = "/root/testdata/sf0.001"


def sql_rows(text):
    db = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "supplier"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found = db.execute(text)
    names = [c[0] for c in found.description]
    return names, sorted(tuple(r) for r in found.fetchall())


def check(spark, query, text):
    names, want = sql_rows(text)
    found = QUERIES[query](spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert sorted(tuple(r) for r in found.select(names).collect()) == want and want
    return found


@pytest.mark.parametrize("query", ["bm25_topk", "cosine_topk", "rrf_fusion", "retrieval_context"])
def test_searches_follow_the_table(spark, query):
    assert "% 50 = 0" in ORACLE[query] and "< 10" not in ORACLE[query] and "left(text, 300)" not in ORACLE[query]
    check(spark, query, ORACLE[query])
    assert QUERIES[f"{query}_spread"] is QUERIES[query]


def test_many_queries_go_in_blocks(spark):
    rows = spark.range(40).select(F.col("id").alias("k"), F.array(F.col("id").cast("double") + 1, F.lit(1.0)).alias("embedding"))
    asked = rows.withColumnRenamed("k", "q")
    found = retrieval.semantic_all(asked, rows, "q", "k", most_queries=7)
    assert {(r["q"], r["k"]) for r in found.collect()} == {(a, b) for a in range(40) for b in range(40)} and found.count() == 1600


def test_findings_are_compared_by_whole_texts(spark):
    found = check(spark, "findings_dedupe", ORACLE["findings_dedupe"])
    assert "left(text" not in ORACLE["findings_dedupe"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("original_text" not in line and "text#" not in line for line in plan.split("\n") if "Exchange" in line)


def test_the_matrix_holds_all_suppliers(spark):
    found = check(spark, "compliance_cells", ORACLE["compliance_cells"])
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert suppliers > 5 and found.select("fornecedor_id").distinct().count() == suppliers
