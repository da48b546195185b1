from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lavra.operators import retrieval
from lavra.plans.queries import QUERIES
from lavra.plans.sql import ORACLE

SF = "/root/testdata/sf0.001"
CHUNKS = "id int, law_number string, law_title string, article string, section string, text string, embedding array<float>"
LAWS = [
    (1, "L1", "t", "1", "s", "prazo de entrega em trinta dias", [1.0, 0.0]),
    (2, "L1", None, None, None, "garantia do contrato", [0.8, 0.6]),
    (3, "L2", "t", "3", "s", "multa por atraso na entrega", [0.0, 1.0]),
    (4, "L2", "t", "4", "s", None, None),
    (5, "L1", "t", "1", "s", "prazo de entrega em trinta dias", None),
]


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "q int, text string, embedding array<float>")


def found(spark, queries, chunks=LAWS, **more):
    rows = retrieval.retrieve(queries, spark.createDataFrame(chunks, CHUNKS), "q", "id", **more).orderBy("q", "rank").collect()
    return [(r["q"], r["law_number"], r["article"], r["text"]) for r in rows], rows


def test_query_equals_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = db.execute(ORACLE["retrieve"])
    names = [c[0] for c in want.description]
    got = QUERIES["retrieve"](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(r) for r in got.select(*names).collect())
    assert rows and rows == sorted(want.fetchall())


def test_legs_are_fused_and_equal_chunks_are_one(spark):
    short, rows = found(spark, asked(spark, (1, " Prazo de  ENTREGA ", [1.0, 0.0]), (2, "  ", [1.0, 0.0]), (3, None, [1.0, 0.0])))
    assert {r[0] for r in short} == {1}  # blank and null queries have no rows
    assert short[0][1:] == ("L1", "1", "prazo de entrega em trinta dias") and len(short) == 3
    assert rows[0]["score"] == pytest.approx(1.0)  # the cosine
    empty = next(r for r in rows if r["text"] == "garantia do contrato")
    assert (empty["law_title"], empty["article"], empty["section"]) == ("", "", "")


def test_laws_limit_the_hits(spark):
    short, _ = found(spark, asked(spark, (1, "entrega", [1.0, 0.0])), laws=["L2"])
    assert [r[1:3] for r in short] == [("L2", "3")]


def test_without_vectors_the_text_leg_stands_alone(spark):
    none = [(*r[:6], None) for r in LAWS]
    short, rows = found(spark, asked(spark, (1, "multa", [1.0, 0.0])), none)
    assert [r[2] for r in short] == ["3"] and rows[0]["score"] < 0
    assert found(spark, asked(spark, (1, "multa", None)))[0][0][2] == "3"  # a query without a vector
    assert [r[2] for r in found(spark, asked(spark, (1, "multa", [1.0, 0.0])), by_meaning=False)[0]] == ["3"]
    assert found(spark, asked(spark, (1, "multa", None)), [])[0] == []


def test_terms_as_patterns(spark):
    queries = asked(spark, (1, "MULT_ x", None), (2, "a\\", None), (3, "'", None), (4, "zz yy xx ww vv uu multa", None))
    short, rows = found(spark, queries, mode="ilike", by_meaning=False)
    assert [r[:3] for r in short] == [(1, "L2", "3")] and rows[0]["score"] == 1.0
    chunks = spark.createDataFrame(LAWS, CHUNKS)
    in_blocks = retrieval.like_hits(spark.range(30).select(F.col("id").alias("q"), F.lit("entrega").alias("text")), chunks, "q", "id", most_queries=7)
    assert in_blocks.groupBy("q").count().select("count").distinct().collect() == [(3,)] and in_blocks.count() == 90
