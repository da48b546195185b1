"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import license as licenses
from lavra.llm import audit, decontam, jaccard, mixing, neighbours, packing, pii, quality, ranked, secrets, suffixes, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = lambda names: F.sha2(F.array_join(names, ","), 256)
    count = lambda names: F.size(names).cast("long")
    return found.select(
        "doc_id", "n_words", "n_hit", count("items").alias("n_items"), digest("items").alias("items_sha256"), "contaminated", count("near").alias("n_near"), digest("near").alias("near_sha256")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole join: op8_jaccard's columns, which its SQL fixes, and each document's number of links."""
    return jaccard.linked(_table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_licenses": op7_licenses,
    "op8_jaccard": op8_jaccard,
    "op8_links": op8_links,
    "op9_neighbours": op9_neighbours,
    "op10_suffixes": op10_suffixes,
    "op11_audit": op11_audit,
    "op12_packing": op12_packing,
    "op13_ranked": op13_ranked,
}
