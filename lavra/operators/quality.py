"""Quality of an analysis against expected issues: recall, precision and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import contains_ci


def item_recall(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Share of an item's expected keywords that its findings' text holds; 1 without any. expected: keys, keyword (null for none); found: keys, text."""
    texts = found.groupBy(*keys).agg(F.concat_ws("\n", F.array_sort(F.collect_list("text"))).alias("text"))
    hits = expected.join(texts, keys, "left")
    hit = contains_ci(F.coalesce("text", F.lit("")), F.col("keyword")).cast("double")
    return hits.groupBy(*keys).agg(F.coalesce(F.avg(hit), F.lit(1.0)).alias("recall"))


def first_expected(expected: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """(keys, keyword) of each item's first entry of expected issues, by the order; an entry without issues is one row of a null keyword. expected: keys, order, issues (array)."""
    first = expected.groupBy(*keys).agg(F.min_by("issues", order).alias("issues"))
    return first.select(*keys, F.explode_outer("issues").alias("keyword"))


def f1(recall: Column, precision: Column) -> Column:
    return F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))


def document_quality(recalls: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Per document: mean item recall, precision = kept / generated (1 without any), and F1. counts: key, generated, kept."""
    mean = recalls.groupBy(key).agg(F.avg("recall").alias("recall"))
    precision = F.when(F.col("generated") > 0, F.col("kept") / F.col("generated")).otherwise(1.0)
    return mean.join(counts, key).select(key, "recall", precision.alias("precision"), "generated", "kept", f1(F.col("recall"), precision).alias("f1"))


def summary(documents: DataFrame) -> DataFrame:
    """Means over documents; the F1 is that of the means."""
    means = documents.agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.count("*").alias("documents"))
    return means.withColumn("f1", f1(F.col("recall"), F.col("precision")))


def counts_by(findings: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """Zero-filled counts by several dimensions in one pass."""
    return findings.agg(*(F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, values in domains.items() for v in values))
