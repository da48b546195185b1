"""Labelled rows for the classifiers: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: int = 5) -> DataFrame:
    """At most `rows` labelled documents (doc_id, text, label) outside the held-out fold, drawn by a seeded hash of the id.

    Repeated labels of an id count once, conflicting ones as 1. Of several
    documents with one id the text with the smallest hash is taken, so repeated
    ids don't make the sample grow.
    """
    free = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = free.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    drawn = one.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # bounded by `rows`
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label")
