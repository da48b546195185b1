"""Queries on rows that the given tables lack, against their SQL, and what they move."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lavra.operators import chunk, retrieval, structure, textindex
from lavra.plans.queries import QUERIES
from lavra.plans.sql import ORACLE

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, query, **tables):
    """The query's rows, compared with its SQL on these tables."""
    db = duckdb.connect()
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    sql = db.execute(ORACLE[query])
    names = [c[0] for c in sql.description]
    found = QUERIES[query](spark, str(folder)).select(names)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(sql.fetchall(), key=repr) and got
    return got


def test_review_notes_are_whole(spark, tmp_path):
    turns = spark.createDataFrame([(1, 2, "assistant", "n" * 2500), (1, 1, "user", "x"), (2, 1, "assistant", "antes"), (2, 6, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = same_as_sql(spark, tmp_path, "review_apply", conversations=turns)
    assert max(len(r[3]) for r in got if r[3]) == 2500


def test_a_term_and_a_block_are_one_row(spark):
    """What travels from chunk to folder is a row for each term of a batch, not one for each word; blocks may lie in two batches."""
    chunks = spark.range(100, numPartitions=2).select("id", F.concat(F.lit("comum comum p"), F.col("id") % 7).alias("text"))
    asked = spark.createDataFrame([(1, "comum p3")], "q long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        index = textindex.build(chunks, "id", block=16, buckets=3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert index.postings.groupBy("term", "block").count().agg(F.max("count")).first()[0] == 1
    rows = index.postings.filter("term = 'comum'").select(F.inline(F.arrays_zip("keys", "tf", "dl"))).collect()
    assert sorted(tuple(r) for r in rows) == [(i, 2, 3) for i in range(100)]
    assert index.n_chunks == 100 and [r["id"] for r in textindex.search(index, asked, "q", 3).orderBy("rank").collect()] == [3, 10, 17]


def test_fused_ranks_by_tiles(spark, tmp_path, monkeypatch):
    """Several tiles, copies of one vector, and vectors of another width."""
    monkeypatch.setattr(retrieval, "TILE_VECTORS", 96)
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 24)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0, 3.0]) for _ in range(3)], rng.randrange(-2, 5)) for i in range(400)]
    rows += [(400 + i, rows[50][1], 3 if i % 2 else None) for i in range(60)]
    same_as_sql(spark, tmp_path, "rrf_fusion", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def test_fused_ranks_by_partitions(spark, tmp_path, monkeypatch):
    """Both sides of a tile meet in one task when the shuffle's partitions aren't made one again."""
    monkeypatch.setattr(retrieval, "TILE_VECTORS", 300)
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(5)
        rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], rng.randrange(10)) for i in range(500)]
        same_as_sql(spark, tmp_path, "rrf_fusion", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_articles_are_cut_without_a_shuffle(spark):
    text = "NADA\nArt. 1º a\n\n  SEÇÃO I\nB C\nArt. 2. b\nTÍTULO V\nSEÇÃO II\nc\nArt. 3-A d"
    laws = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "TÍTULO I\nA\nb\nC\nArt. 1 x\n" + chunk.FOOTER)], "doc_id int, text string")
    found = chunk.law_chunks(laws)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    one = [(0, "Art. 1º", "", "Art. 1º a\nB C"), (1, "Art. 2", "SEÇÃO I", "Art. 2. b\nc"), (2, "Art. 3-A", "SEÇÃO II", "Art. 3-A d")]
    assert sorted(tuple(r) for r in found.collect()) == sorted([(1, *r) for r in one] * 2 + [(3, 0, "Art. 1", "TÍTULO I - A - C", "Art. 1 x")])


def test_documents_at_once_equal_documents_by_row():
    """Both folds of a structure, over batches that cut documents, with and without the way by rows."""
    rng = random.Random(8)
    cut = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("kind", pa.int8()), ("line", pa.string())])
    rows = []
    for key in range(60):
        rows.append((key % 7, -1, structure.WHOLE, "w"))
        rows += [(key % 7, i, rng.choice([structure.LINE, structure.LINE, structure.NUMBER, structure.FOOTER]), f"l{i}") for i in range(rng.randrange(0, 9))]
    batches = [pa.RecordBatch.from_pylist([dict(zip(cut.names, r, strict=True)) for r in rows[i : i + 5]], schema=cut) for i in range(0, len(rows), 5)]
    whole = list(structure._complete(iter(batches)))
    by_row = [(k, *r) for b in whole for k, doc in structure._documents(b) for r in structure._cut(doc)]
    assert [tuple(r.values()) for b in whole for r in structure._cut_at_once(b, cut).to_pylist()] == by_row
    opened = pa.schema([*cut, ("number", pa.string()), ("title", pa.string()), ("type", pa.string())])
    made = pa.schema([("id", pa.int64()), ("order", pa.int32()), ("number", pa.string()), ("title", pa.string()), ("content", pa.string()), ("type", pa.string()), ("pos", pa.int32())])
    more = []
    for key in range(40):
        more.append((key % 5, -1, structure.WHOLE, "w", None, None, None))
        more += [(key % 5, i, structure.LINE, f"l{i}", *((rng.choice("12"), "t", "item") if i == 3 or rng.random() < 0.4 else (None,) * 3)) for i in range(8)]
    batch = pa.RecordBatch.from_pylist([dict(zip(opened.names, r, strict=True)) for r in more], schema=opened)
    by_row = [(k, *r) for k, doc in structure._documents(batch) for r in structure._assembled(doc, True)]
    assert [tuple(r.values()) for r in structure._assembled_at_once(batch, made).to_pylist()] == by_row
