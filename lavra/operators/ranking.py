"""Constants and ranks that all legs of a search share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25 constants, the floor of a term's weight, the rank constant of the fusion, and results by default.
K1, B, LEAST_IDF, RRF, TOP_K = 1.2, 0.75, 1e-6, 60, 5


def top_k(scored: DataFrame, query_key: str, order: list[Column], k: int = TOP_K) -> DataFrame:
    """The first k of each query with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(*order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")
