"""Version diff of documents by item number, with fuzzy equality."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.text import natural_key, normalize

#: Similarity from which a changed item counts as unchanged.
SAME_FROM = 0.8
STATUSES = ("adicionado", "removido", "alterado", "inalterado")


@F.pandas_udf(T.DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts, as the standard library computes it; no built-in function does."""
    for left, right in pairs:
        yield pd.Series([1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in zip(left.fillna(""), right.fillna(""), strict=True)], dtype="float64")


def last_of_number(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the items with equal number, the last."""
    row = F.max_by(F.struct("title", "content"), F.struct(order, "title", "content")).alias("item")  # ties by the texts
    return items.groupBy(*keys, "item_number").agg(row).select(*keys, "item_number", "item.title", "item.content")


def written(name: str) -> Column:
    """The text of an item that a version has; a missing one is empty."""
    return F.coalesce(name, F.lit(""))


def diff(old: DataFrame, new: DataFrame, keys: list[str] | None = None, order: str = "item_order", fuzzy: bool = True) -> DataFrame:
    """Items of both versions by number, with status, both contents and a sort key.

    Only pairs whose normalised texts differ are compared by similarity, after
    the join, so equal items cost no Python.
    """
    keys = keys or []
    a = last_of_number(old, keys, order).withColumnsRenamed({"title": "old_title", "content": "old_content"}).withColumn("in_old", F.lit(True))
    b = last_of_number(new, keys, order).withColumnsRenamed({"title": "new_title", "content": "new_content"}).withColumn("in_new", F.lit(True))
    both = a.join(b, [*keys, "item_number"], "full_outer")
    left, right = normalize(F.coalesce("old_content", F.lit(""))), normalize(F.coalesce("new_content", F.lit("")))
    pair = F.col("in_old") & F.col("in_new")
    equal = left == right
    if fuzzy:
        both = both.withColumn("ratio", F.when(pair & ~equal, similarity(F.when(pair & ~equal, left), F.when(pair & ~equal, right))).when(pair, 1.0))
        equal = F.col("ratio") >= SAME_FROM
    status = F.when(F.col("in_old").isNull(), "adicionado").when(F.col("in_new").isNull(), "removido").when(equal, "inalterado").otherwise("alterado")
    return both.select(
        *keys, status.alias("status"), "item_number", F.when(F.col("in_new"), written("new_title")).otherwise(written("old_title")).alias("titulo"),
        F.when(F.col("in_old"), written("old_content")).alias("conteudo_antes"), F.when(F.col("in_new"), written("new_content")).alias("conteudo_depois"), natural_key(F.col("item_number")).alias("sort_key"),
    )


def summary(found: DataFrame, *keys: str) -> DataFrame:
    """Counts of all four statuses, zeros included."""
    counts: list[Column] = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    return found.groupBy(*keys).agg(*counts) if keys else found.agg(*counts)
