"""A stored vector index with exact results: cells around centres, packed in blocks, skipped where a bound proves them useless.

Vectors are dealt to the nearest of a few centres, which are fitted on a bounded
sample, and written in blocks of one cell with the largest angle to its centre.
No vector of a block can be nearer to a query than the angle between query and
centre, less that largest angle. A search scores the FIRST most promising blocks
of a query, which gives the score that its last result has at least, and then
those blocks whose bound reaches it. Blocks meet queries in blocks: a task
multiplies two matrices and returns the best of each query alone, so no row is
made for a pair of query and vector. Where vectors have no clusters, the bounds
exclude little; the results are the same.

Vectors of different widths never meet. A zero vector, and one that a sample has
shown no centre for, lies in a cell without centre, which every query scores; a
zero query scores all cells, each vector at 0. Vectors that are null, empty or hold null or
non-finite components are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from lavra import storage
from lavra.operators.ranking import TOP_K, doubles

#: Vectors that centres are fitted on, centres at most, and rounds of the fit.
SAMPLE, CENTRES, ROUNDS = 8192, 256, 6
#: Vectors of a block, queries of a block, and blocks of each query that are scored first.
BLOCK, QUERIES, FIRST = 512, 256, 2
#: Scores are ranked by six digits; bounds allow for this.
DIGITS, MARGIN = 6, 2e-6
NO_CENTRE = -1


def usable(vector: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(doubles(F.col(vector)), finite), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their scale; zero rows stay."""
    largest = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(largest > 0, largest, 1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def centres_of(x: np.ndarray, most: int = CENTRES, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centres of unit vectors; about the square root of their number, `most` at most."""
    n = min(most, max(1, int(np.sqrt(len(x)))))
    found = x[np.random.default_rng(seed).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        cell = (x @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, cell, x)
        found = np.where(np.bincount(cell, minlength=n)[:, None] > 0, unit(sums), found)
    return found


@dataclass
class VectorIndex:
    """blocks: width, cell, block, keys, matrix (unit vectors), radius; centres by width."""

    blocks: DataFrame
    centres: dict[int, np.ndarray]
    key: str


def build(chunks: DataFrame, key: str, vector: str = "embedding", sample: int = SAMPLE, block: int = BLOCK) -> VectorIndex:
    """The index of all usable vectors. The sample that centres are fitted on has `sample` rows at most, drawn by a hash of the keys."""
    spark = chunks.sparkSession
    rows = chunks.filter(usable(vector)).select(F.col(key).alias("key"), doubles(F.col(vector)).alias("vector"))
    drawn = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").toPandas()["vector"]
    by_width: dict[int, list] = {}
    for v in drawn:
        by_width.setdefault(len(v), []).append(v)
    centres = {}
    for width, some in by_width.items():
        x = unit(np.array(some, np.float64))
        x = x[np.abs(x).sum(axis=1) > 0]
        if len(x):
            centres[width] = centres_of(x)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, widths = batch.column("vector").flatten().to_numpy(), np.diff(batch.column("vector").offsets.to_numpy())
            ends = np.cumsum(widths)
            for width in np.unique(widths).tolist():
                which = np.flatnonzero(widths == width)
                x = unit(flat[(ends[which] - width)[:, None] + np.arange(width)])
                cell, angle = np.full(len(x), NO_CENTRE), np.full(len(x), np.pi)
                if width in centres:
                    near = x @ centres[width].T
                    cell, angle = near.argmax(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1))
                zero = np.abs(x).sum(axis=1) == 0
                cell, angle = np.where(zero, NO_CENTRE, cell), np.where(zero, np.pi, angle)
                own = batch.column("key").take(pa.array(which))
                columns = [pa.array(np.full(len(x), width), pa.int32()), pa.array(cell, pa.int32()), own, pa.array([v.tobytes() for v in x], pa.binary()), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, ["width", "cell", "key", "unit", "angle"])

    key_type = chunks.schema[key].dataType
    placed = rows.mapInArrow(dealt, StructType([StructField("width", IntegerType()), StructField("cell", IntegerType()), StructField("key", key_type), StructField("unit", BinaryType()), StructField("angle", DoubleType())]))
    # A common vector fills its cell; a hash of the key spreads it over tasks, and near angles share a block.
    spread = placed.repartition("width", "cell", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("width", "cell", "angle")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = list(zip(batch.column("width").to_pylist(), batch.column("cell").to_pylist(), strict=True))
            start = 0
            for i in range(1, len(same) + 1):
                if i == len(same) or same[i] != same[start] or i - start == block:
                    own = batch.slice(start, i - start)
                    columns = [pa.array([same[start][0]], pa.int32()), pa.array([same[start][1]], pa.int32()), pa.array([own.column("key").to_pylist()], pa.list_(own.schema.field("key").type))]
                    columns += [pa.array([b"".join(own.column("unit").to_pylist())], pa.binary()), pa.array([max(own.column("angle").to_pylist())])]
                    yield pa.RecordBatch.from_arrays(columns, ["width", "cell", "keys", "matrix", "radius"])
                    start = i

    shape = StructType([StructField("width", IntegerType()), StructField("cell", IntegerType()), StructField("keys", ArrayType(key_type)), StructField("matrix", BinaryType()), StructField("radius", DoubleType())])
    blocks = spread.mapInArrow(packed, shape).withColumn("block", F.monotonically_increasing_id())
    return VectorIndex(storage.stored(blocks, storage.folder(spark, "vector-index")), centres, key)


def bounds(index: VectorIndex, queries: DataFrame, query_key: str, vector: str) -> DataFrame:
    """(query, width, cell, block, bound, unit): the nearest that any vector of the block can be to the query."""
    centres, key_type = index.centres, queries.schema[query_key].dataType

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, v in zip(batch.column("query").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                x = unit(np.array([v], np.float64))[0]
                cells = centres.get(len(x), np.zeros((0, len(x))))
                angles = np.append(np.arccos(np.clip(cells @ x, -1, 1)) if np.abs(x).sum() else np.zeros(len(cells)), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(angles), t) for y, t in ((query, batch.schema.field("query").type), (len(x), pa.int32()))] + [pa.array([*range(len(cells)), NO_CENTRE], pa.int32()), pa.array(angles), pa.array([x.tobytes()] * len(angles), pa.binary())], ["query", "width", "cell", "angle", "unit"])

    rows = queries.filter(usable(vector)).select(F.col(query_key).alias("query"), doubles(F.col(vector)).alias("vector"))
    cells = rows.mapInArrow(near, StructType([StructField("query", key_type), StructField("width", IntegerType()), StructField("cell", IntegerType()), StructField("angle", DoubleType()), StructField("unit", BinaryType())]))
    radii = index.blocks.select("width", "cell", "block", "radius")
    bound = F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius")))
    return cells.join(radii, ["width", "cell"]).select("query", "block", bound.alias("bound"), "unit")


def scored(index: VectorIndex, chosen: DataFrame, k: int) -> DataFrame:
    """(query, key, score): the k nearest of each chosen block of a query."""
    dealt = F.pmod(F.xxhash64("query"), F.lit(64))  # so that a block's queries needn't meet in one row
    asked = chosen.groupBy("block", dealt.alias("deal")).agg(F.collect_list(F.struct("query", "unit")).alias("asked"))
    asked = asked.select("block", F.explode(F.transform(F.sequence(F.lit(1), F.size("asked"), F.lit(QUERIES)), lambda i: F.slice("asked", i, QUERIES))).alias("asked"))
    pairs = index.blocks.select("block", "keys", "matrix", "width").join(asked, "block")
    query_type, key_type = chosen.schema["query"].dataType, index.blocks.schema["keys"].dataType.elementType

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, keys = batch.column("width")[i].as_py(), batch.column("keys")[i].as_py()
                asked = batch.column("asked")[i].as_py()
                matrix = np.frombuffer(batch.column("matrix")[i].as_py()).reshape(-1, width)
                near = matrix @ np.array([np.frombuffer(a["unit"]) for a in asked]).T
                place = np.empty(len(keys), np.int64)
                place[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
                out: tuple[list, list, list] = ([], [], [])
                for j, a in enumerate(asked):
                    order = np.lexsort((place, -np.round(near[:, j], DIGITS)))[:k]
                    for column, values in zip(out, ([a["query"]] * len(order), [keys[o] for o in order], near[order, j].tolist()), strict=True):
                        column.extend(values)
                types = (batch.schema.field("asked").type.value_type.field("query").type, batch.schema.field("keys").type.value_type, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["query", "key", "score"])

    return pairs.mapInArrow(best, StructType([StructField("query", query_type), StructField("key", key_type), StructField("score", DoubleType())]))


def needed(index: VectorIndex, bound: DataFrame, k: int) -> DataFrame:
    """The blocks that can hold one of a query's k nearest."""
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    first = scored(index, bound.withColumn("nth", nth).filter(F.col("nth") <= FIRST).drop("nth"), k)
    least = first.withColumn("place", place).filter(F.col("place") == k).select("query", F.col("score").alias("least"))
    return bound.join(least, "query", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - MARGIN)).drop("least")


def search(index: VectorIndex, queries: DataFrame, query_key: str, k: int = TOP_K, vector: str = "embedding") -> DataFrame:
    """(query_key, key, score, rank): each query's k nearest vectors by cosine of six digits, then by key."""
    bound = storage.stored(bounds(index, queries, query_key, vector), storage.folder(queries.sparkSession, "bounds"))
    found = scored(index, needed(index, bound, k), k).withColumn("score", F.round("score", DIGITS) + F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_key), F.col("key").alias(index.key), "score", "rank")
