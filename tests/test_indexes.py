from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lavra.operators import retrieval, textindex, vectorindex

SF = "/root/testdata/sf0.001"


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"p{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(1, 60))) for _ in range(n)]
    return texts + [None, "", "único"] + [texts[0]] * 20, [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(20)] + ["unico", "nada-disso zz", "", None, 'p1 "p2" OR']


def plain(chunks, asked, k):
    scored = retrieval.bm25(asked, retrieval.postings(chunks, "id"), chunks, "q", "id").withColumn("score", F.round("score", 6))
    return {(r["q"], r["rank"], r["id"], r["score"]) for r in retrieval.top_k(scored, "q", [F.col("score"), F.col("id")], k).collect()}


@pytest.mark.parametrize(("block", "buckets", "k"), [(128, 3, 5), (4, 16, 3), (1, 1, 30)])
def test_text_search_equals_a_full_search(spark, block, buckets, k):
    texts, queries = corpus()
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3).withColumns({c: F.lit("x") for c in ("term", "bucket", "key", "bound")})
    asked = spark.createDataFrame(list(enumerate(queries)), "q long, text string")
    index = textindex.build(chunks, "id", block=block, buckets=buckets)
    assert index.n_chunks == len(texts)
    got = {(r["q"], r["rank"], r["id"], r["score"]) for r in textindex.search(index, asked, "q", k).collect()}
    assert got == plain(chunks, asked, k)
    few = chunks.filter("id % 3 = 0")
    rows = textindex.search(index, asked, "q", k, few).collect()
    full = retrieval.bm25(asked, retrieval.postings(chunks, "id"), chunks, "q", "id").withColumn("score", F.round("score", 6)).join(few.select("id"), "id", "left_semi")
    want = {(r["q"], r["rank"], r["id"], r["score"]) for r in retrieval.top_k(full, "q", [F.col("score"), F.col("id")], k).collect()}
    assert {(r["q"], r["rank"], r["id"], r["score"]) for r in rows} == want


def test_text_search_reads_few_blocks(spark):
    """Chunks of one subject stand together, as articles of a law do; a search opens the blocks of its subject alone."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"a{i // 32}b{j}" for j in range(20)] + ["comum"] * 5, k=30)) for i in range(1600)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    asked = spark.createDataFrame([(s, f"comum a{s}b1 a{s}b2 a{s}b3") for s in range(0, 50, 7)], "q long, text string")
    index = textindex.build(chunks, "id", block=16)
    bound = textindex.bounds(index, textindex.query_terms(asked, "q", buckets=index.buckets), "q")
    needed = textindex.needed(index, bound, "q", 5)
    assert needed.count() <= 0.1 * bound.count()
    got = {(r["q"], r["rank"], r["id"], r["score"]) for r in textindex.search(index, asked, "q", 5).collect()}
    assert got == plain(chunks, asked, 5)


def test_text_index_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string")
    asked = spark.createDataFrame([(1, "a")], "q long, text string")
    assert textindex.search(textindex.build(none, "id"), asked, "q").count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def all_pairs(chunks, asked, k):
    scored = retrieval.semantic(asked, chunks, "q", "id").withColumn("score", F.round("score", 6) + F.lit(0.0))
    return {(r["q"], r["rank"], r["id"], r["score"]) for r in retrieval.top_k(scored.filter("score is not null"), "q", [F.desc("score"), F.col("id")], k).collect()}


def clustered(n=1200, groups=40, width=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return [(i, (centres[i % groups] + 0.1 * rng.normal(size=width)).tolist()) for i in range(n)]


def test_vector_search_equals_all_pairs(spark):
    rows = clustered() + [(5000 + i, clustered()[3][1]) for i in range(60)] + [(6000, [0.0] * 16), (6001, [1.0, 2.0]), (6002, [-1.0, 2.0]), (6003, None), (6004, []), (6005, [float("nan")] * 16)]
    chunks = vectors(spark, rows).repartition(4)
    asked = chunks.filter("id % 50 = 0 or id in (5003, 6001, 6003, 6004, 6005)").withColumnRenamed("id", "q")
    good = chunks.filter("id < 6003")
    for block in (7, 512):
        index = vectorindex.build(chunks, "id", block=block)
        got = {(r["q"], r["rank"], r["id"], r["score"]) for r in vectorindex.search(index, asked, "q", 6).collect()}
        assert got == all_pairs(good, asked.filter("q < 6003"), 6)


def test_vector_search_skips_far_cells(spark):
    chunks = vectors(spark, clustered(2400))
    asked = chunks.filter("id % 50 = 0").withColumnRenamed("id", "q")
    index = vectorindex.build(chunks, "id", block=64)
    bound = vectorindex.bounds(index, asked, "q", "embedding")
    assert vectorindex.needed(index, bound, 5).count() <= 0.2 * bound.count()


def test_vectors_of_any_scale(spark):
    rows = [(i, [float(i + 1), 1.0, 0.0, float(-i)]) for i in range(40)] + [(50, [1e200, 2e200, 0.0, 0.0]), (51, [1e-200, 2e-200, 0.0, 0.0]), (52, [1e-320, 2e-320, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>")
    found = vectorindex.search(vectorindex.build(chunks, "id"), chunks.filter("id = 50").withColumnRenamed("id", "q"), "q", 3).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 3)) for r in found] == [(50, 1.0), (51, 1.0), (52, 1.0)]


def test_recall_of_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = table.filter("id % 50 = 0").withColumnRenamed("id", "q")
    got = {(r["q"], r["rank"], r["id"], r["score"]) for r in vectorindex.search(vectorindex.build(table, "id"), asked, "q").collect()}
    assert got == all_pairs(table, asked, 5)  # a recall of 1


def test_vector_index_of_nothing(spark):
    none = vectors(spark, [])
    asked = spark.createDataFrame([(1, [1.0]), (2, None)], "q long, embedding array<float>")
    assert vectorindex.search(vectorindex.build(none, "id"), asked, "q").count() == 0
