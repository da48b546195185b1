"""A stored text index: postings dealt by term, and what each block of chunks can add to a score at most.

Texts are tokenised once. A block is a range of chunks as they are read; words are
counted where the chunk is, and all chunks of a batch that hold a term travel as one
row. Rows of a term and a block are written in folders by a hash of their term, so
that a search opens the folders of its terms alone, and within a folder in the order
of terms and blocks.
For each term and block a second table holds the largest weight and the number
of chunks. A search adds these up to a bound for each query and block, scores the
FIRST most promising blocks of a query, and then those whose bound reaches the
score that the last result has at least. The results are those of a full search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lavra import storage
from lavra.functions.text import clean_query, tokens
from lavra.operators.ranking import B, K1, LEAST_IDF, TOP_K, top_k

#: Folders of postings at most (by default one for each shuffle partition), chunks of a block, and parts that a folder is written in, so that no frequent term meets in one task.
BUCKETS, BLOCK, SALTS = 512, 128, 16
#: Blocks of each query that are scored before all others.
FIRST = 2
#: Scores are ranked by six digits; a bound counts as reached within this.
MARGIN = 1e-6
#: Stands for a chunk itself among its terms; no text has such a term.
SELF = ""


@dataclass
class TextIndex:
    """postings: bucket, term, block, keys, tf, dl (arrays over the block's chunks with the term); maxima: bucket, term, block, most, n; n_chunks chunks of avg_dl words on average."""

    postings: DataFrame
    maxima: DataFrame
    key: str
    n_chunks: int
    avg_dl: float
    buckets: int


def _bucket(term: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def weight(tf: Column, dl: Column, avg_dl: float) -> Column:
    """A term's part of a score before its rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avg_dl or 1.0)))


def rarity(n_chunks: int, df: Column) -> Column:
    raw = F.log((F.lit(n_chunks) - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, LEAST_IDF).otherwise(raw)


def _runs(arrays: list[pa.Array], starts: np.ndarray) -> list[pa.Array]:
    """The arrays cut into lists that begin at these places."""
    offsets = pa.array(np.append(starts, len(arrays[0])), pa.int32())
    return [pa.ListArray.from_arrays(offsets, x) for x in arrays]


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(term, first, blocks, keys, tf, dl) of chunks (key, block, words): a row for each term with all chunks that hold it, in their order."""
    words, n = batch.column("words"), batch.num_rows
    blocks, dl = batch.column("block").to_numpy(), np.diff(words.offsets.to_numpy())
    terms = words.flatten().dictionary_encode()
    # A pair of term and chunk is one number; the chunks themselves come as the term behind all others.
    pairs = np.append(terms.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), dl), len(terms.dictionary) * n + np.arange(n))
    pairs, tf = np.unique(pairs, return_counts=True)
    term, chunk = np.divmod(pairs, n)
    starts = np.flatnonzero(np.append(True, np.diff(term) != 0))
    lists = _runs([pa.array(blocks[chunk], pa.int64()), batch.column("key").take(pa.array(chunk)), pa.array(tf, pa.int32()), pa.array(dl[chunk], pa.int32())], starts)
    names = pa.concat_arrays([terms.dictionary.cast(pa.string()), pa.array([SELF], pa.string())])
    return pa.RecordBatch.from_arrays([names.take(pa.array(term[starts])), pa.array(np.full(len(starts), blocks[0]), pa.int64()), *lists], ["term", "first", "blocks", "keys", "tf", "dl"])


def _by_term_and_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, keys, tf, dl): the rows of `_counted`, cut where the block changes."""
    for batch in batches:
        if batch.num_rows:
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("blocks").offsets.to_numpy()))
            blocks = batch.column("blocks").flatten().to_numpy()
            starts = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(blocks) != 0)))
            lists = _runs([batch.column(c).flatten() for c in ("keys", "tf", "dl")], starts)
            yield pa.RecordBatch.from_arrays([batch.column("term").take(pa.array(row[starts])), pa.array(blocks[starts], pa.int64()), *lists], ["term", "block", "keys", "tf", "dl"])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_counted` over blocks that are complete; the last block of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            blocks = batch.column("block").to_numpy()
            last = int(np.searchsorted(blocks, blocks[-1]))
            if held and blocks[0] != held[0].column("block")[0].as_py():
                yield _counted(pa.concat_batches(held))
                held = []
            if last:
                yield _counted(pa.concat_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
    if held:
        yield _counted(pa.concat_batches(held))


def build(chunks: DataFrame, key: str, text: str = "text", block: int = BLOCK, buckets: int | None = None) -> TextIndex:
    """The index of all chunks. A null text has no terms and still counts as a chunk."""
    spark = chunks.sparkSession
    buckets = buckets or min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = chunks.select(F.col(key).alias("key"), F.floor(F.monotonically_increasing_id() / block).alias("block"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    lists = [StructField("keys", ArrayType(chunks.schema[key].dataType)), StructField("tf", ArrayType(IntegerType())), StructField("dl", ArrayType(IntegerType()))]
    packed = words.mapInArrow(_by_block, StructType([StructField("term", StringType()), StructField("first", LongType()), StructField("blocks", ArrayType(LongType())), *lists]))
    # Batches of chunks are dealt over salts, so that no frequent term meets in one task.
    dealt = packed.repartition(_bucket(F.col("term"), buckets), F.pmod(F.xxhash64("first"), F.lit(SALTS))).drop("first")
    split = dealt.mapInArrow(_by_term_and_block, StructType([StructField("term", StringType()), StructField("block", LongType()), *lists]))
    counted = split.withColumn("bucket", _bucket("term", buckets)).sortWithinPartitions("bucket", "term", "block")
    path = storage.folder(spark, "text-index")
    counted.write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = spark.read.schema(counted.schema).parquet(f"{path}/postings")
    own = postings.filter((F.col("bucket") == _bucket(F.lit(SELF), buckets)) & (F.col("term") == SELF)).select(F.explode("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl")).first()
    # A term has one row in a block, so its largest weight is found without a shuffle, and a folder's rows stay together.
    most = F.array_max(F.zip_with("tf", "dl", lambda tf, dl: weight(tf, dl, own["avg_dl"] or 0.0)))
    maxima = postings.select("bucket", "term", "block", most.alias("most"), F.size("keys").cast("long").alias("n")).sortWithinPartitions("bucket", "term")
    maxima.write.partitionBy("bucket").parquet(f"{path}/maxima")
    return TextIndex(postings, spark.read.schema(maxima.schema).parquet(f"{path}/maxima"), key, own["n"], own["avg_dl"] or 0.0, buckets)


def query_terms(queries: DataFrame, query_key: str, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(query_key, term, bucket): each query's distinct terms."""
    terms = queries.select(query_key, F.explode(F.array_distinct(tokens(clean_query(F.coalesce(F.col(text), F.lit("")))))).alias("term"))
    return terms.filter(F.col("term") != SELF).withColumn("bucket", _bucket("term", buckets))


def bounds(index: TextIndex, terms: DataFrame, query_key: str) -> DataFrame:
    """(query_key, block, bound, terms): what any chunk of the block can score at most, with the terms (and rarities) that the block has."""
    used = index.maxima.join(terms.select("bucket", "term").distinct(), ["bucket", "term"])
    # Stored, it is known to be small, so that the maxima needn't be shuffled.
    idf = storage.stored(used.groupBy("term").agg(rarity(index.n_chunks, F.sum("n")).alias("idf")), storage.folder(terms.sparkSession, "rarity"))
    weighed = terms.join(idf, "term").join(index.maxima, ["bucket", "term"])
    return weighed.groupBy(query_key, "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"), F.collect_list(F.struct("bucket", "term", "idf")).alias("terms"))


def scored(index: TextIndex, chosen: DataFrame, query_key: str, allowed: DataFrame | None = None) -> DataFrame:
    """(query_key, key, score) of the chunks in the chosen blocks; scores are negative, smaller is better."""
    asked = chosen.select(query_key, "block", F.inline("terms"))
    places = F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("tf").alias("tf"), F.col("dl").alias("dl"))).alias("key", "tf", "dl")
    hits = asked.join(index.postings, ["bucket", "term", "block"]).select(query_key, "idf", places)
    if allowed is not None:
        hits = hits.join(allowed.select(F.col(index.key).alias("key")).distinct(), "key", "left_semi")
    part = F.col("idf") * weight(F.col("tf"), F.col("dl"), index.avg_dl)
    return hits.groupBy(query_key, "key").agg((-F.sum(part)).alias("score"))


def needed(index: TextIndex, bound: DataFrame, query_key: str, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The blocks that can hold one of a query's k best chunks."""
    nth = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("bound"), "block"))
    first = bound.withColumn("nth", nth).filter(F.col("nth") <= FIRST)
    place = F.row_number().over(Window.partitionBy(query_key).orderBy("score"))
    least = scored(index, first, query_key, allowed).withColumn("place", place).filter(F.col("place") == k).select(query_key, (-F.col("score")).alias("least"))
    return bound.join(least, query_key, "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - MARGIN)).drop("least")


def search(index: TextIndex, queries: DataFrame, query_key: str, k: int = TOP_K, allowed: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(query_key, key, score, rank): each query's k best chunks, by scores of six digits and then by key; allowed: only chunks of these keys."""
    spark = queries.sparkSession
    # Stored frames have a known size, by which Spark sends small ones to the postings and opens their folders alone.
    terms = storage.stored(query_terms(queries, query_key, text, index.buckets), storage.folder(spark, "terms"))
    bound = storage.stored(bounds(index, terms, query_key), storage.folder(spark, "bounds"))
    chosen = storage.stored(needed(index, bound, query_key, k, allowed), storage.folder(spark, "blocks"))
    hits = scored(index, chosen, query_key, allowed).withColumn("score", F.round("score", 6))
    return top_k(hits.withColumnRenamed("key", index.key), query_key, [F.col("score"), F.col(index.key)], k)
