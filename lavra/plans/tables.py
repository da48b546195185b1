"""Reading of the tables, and rule-bearing texts generated from their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import money


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_items(text: Column) -> Column:
    """A text as the only item of a document."""
    return F.array(F.struct(F.lit("1").alias("item_number"), F.lit("").alias("title"), text.alias("content")))


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def amount_text(x: Column) -> Column:
    """An amount as Brazilian money, from whole cents so that no binary fraction shows."""
    return money((cents(x) / 100).cast("decimal(18,2)"))


def company_digits(key: Column) -> Column:
    """14 digits: the key, padded to 12, and its two check digits."""
    base = F.lpad(key.cast("string"), 12, "0")

    def with_digit(text: Column, weights: list[int]) -> Column:
        digits = F.transform(F.split(text, ""), lambda d: d.cast("int"))
        total = F.aggregate(F.zip_with(digits, F.array(*(F.lit(w) for w in weights)), lambda d, w: d * w), F.lit(0), lambda a, x: a + x, lambda a: F.when(a % 11 < 2, 0).otherwise(11 - a % 11))
        return F.concat_ws("", F.transform(digits, lambda d: d.cast("string")), total.cast("string"))

    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return with_digit(with_digit(base, first), [6, *first])
