"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a neighbour graph is built and cut into balanced parts; a
small softmax classifier learns which part a vector's neighbours lie in. Every
row is then indexed under its most probable part. A query goes to its most
probable parts, as many as reached TARGET_RECALL for sampled vectors that the
classifier wasn't trained on, and on to further parts until they hold enough
rows; all rows there are reranked by exact cosine. Data without structure thus
cost more probes rather than recall.

Parts are split into blocks of bounded size by a hash of the id, so copies of
one vector, which fall into one part, spread over many tasks.

Vectors of different lengths are searched apart, each length by an index of its own.

Defined results: vectors that are null, zero or hold null or non-finite
components, and rows without vec_id take no part; rows with the query's own
vec_id are no candidates, repeated rows are candidates each; vectors of any
scale count, the largest and smallest doubles too; ties go to the
smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm import shared

#: Vectors that the index is fitted on at most, neighbours in its graph, and held-out recall that sets the number of probes.
SAMPLE_ROWS, GRAPH_K, TARGET_RECALL = 8192, 10, 0.95
#: Rows of a part to aim at, bounds on the number of parts, and rows of a block.
PART_ROWS, LEAST_PARTS, MOST_PARTS, BLOCK_ROWS = 4096, 8, 256, 4096
#: Queries are the rows whose id is a multiple of this; neighbours returned for each.
QUERY_STEP, K = 50, 5


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return typed.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each unit row."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[a : a + 512]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.05, seed: int = 3) -> np.ndarray:
    """Cut the graph into parts of almost equal size: grow regions, then move nodes to where their neighbours are."""
    n = len(graph)
    limit = int(np.ceil(slack * n / parts))
    near: list[set[int]] = [set(r) for r in graph.tolist()]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            near[j].add(i)
    rng = np.random.default_rng(seed)
    part = np.full(n, -1)
    size = np.zeros(parts, np.int64)
    order = rng.permutation(n).tolist()
    p, frontier = 0, []
    for start in order:
        if part[start] >= 0:
            continue
        frontier.append(start)
        while frontier:
            i = frontier.pop(0)
            if part[i] >= 0:
                continue
            if size[p] >= -(-n // parts) and p < parts - 1:
                p, frontier = p + 1, []
            part[i] = p
            size[p] += 1
            frontier += [j for j in near[i] if part[j] < 0]
    lists = [np.fromiter(s, np.int64, len(s)) for s in near]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n).tolist():
            votes = np.bincount(part[lists[i]], minlength=parts).astype(float)
            votes[(size >= limit) & (np.arange(parts) != part[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, goal: np.ndarray, steps: int = 200, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights (with a bias row) of a softmax classifier on soft labels, by Adam on all rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((x1.shape[1], goal.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x1.T @ (softmax(x1 @ w) - goal) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


@dataclass(frozen=True)
class Router:
    """The classifier, and how many parts a query is sent to."""

    weights: np.ndarray
    probes: int

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return softmax(unit @ self.weights[:-1] + self.weights[-1])

    def ranked(self, vectors: np.ndarray) -> np.ndarray:
        return np.argsort(-self.probabilities(vectors), axis=1, kind="stable")


def fit(vectors: np.ndarray, rows: int, target: float = TARGET_RECALL) -> Router:
    """Fit on sampled vectors for a table of so many rows."""
    x = np.unique(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), axis=0)
    parts = int(np.clip(-(-rows // PART_ROWS), LEAST_PARTS, MOST_PARTS))
    parts = max(1, min(parts, len(x) // 4))
    if parts == 1 or len(x) <= GRAPH_K:
        return Router(np.zeros((vectors.shape[1] + 1, 1)), 1)
    graph = neighbour_graph(x, GRAPH_K)
    part = balanced_parts(graph, parts)
    goal = np.zeros((len(x), parts))
    for j in range(graph.shape[1]):
        np.add.at(goal, (np.arange(len(x)), part[graph[:, j]]), 1.0)
    goal[np.arange(len(x)), part] += 1.0
    # Every fifth vector is kept from the training, to choose the probes by.
    tested = np.random.default_rng(13).permutation(len(x))[: max(1, len(x) // 5)]
    learned = np.setdiff1d(np.arange(len(x)), tested)
    router = Router(train_router(x[learned], goal[learned] / goal[learned].sum(axis=1, keepdims=True)), parts)
    # Probes: the fewest parts that hold enough of their true neighbours, by the classifier's own assignment.
    home = router.ranked(x)[:, 0]
    place = np.argsort(router.ranked(x[tested]), axis=1)
    near = graph[tested][:, :GRAPH_K]
    nearest = np.take_along_axis(near, np.argsort(-np.einsum("qd,qkd->qk", x[tested], x[near]), axis=1, kind="stable")[:, :K], axis=1)
    needed = np.take_along_axis(place, home[nearest], axis=1)
    recall = np.array([(needed < m).mean() for m in range(1, parts + 1)])
    return Router(router.weights, int(np.argmax(recall >= target)) + 1)


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _listed(x: np.ndarray) -> pa.Array:
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(x.ravel()))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to largest components near 1. That is exact, so cosines stay as they are, and no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, query_step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows found for every query."""
    usable = valid(vectors).withColumn("width", F.size("embedding"))
    found = None
    for width, rows in sorted((r["width"], r["count"]) for r in usable.groupBy("width").count().collect()):
        own = _search(usable.filter(F.col("width") == width).drop("width"), width, rows, query_step, k)
        found = own if found is None else found.unionByName(own)
    return vectors.sparkSession.createDataFrame([], RESULT) if found is None else found


def _search(usable: DataFrame, width: int, rows: int, query_step: int, k: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = usable.sparkSession
    drawn = usable.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()["embedding"].combine_chunks()
    router = fit(scaled(_stack(drawn, width)), rows)
    parts = router.weights.shape[1]
    sent = spark.sparkContext.broadcast(router)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = scaled(_stack(batch.column("embedding"), width))
                ranked = sent.value.ranked(x).astype(np.int32)
                asks = (batch.column("vec_id").to_numpy() % query_step == 0).tolist()
                order = [r.tolist() if q else None for r, q in zip(ranked, asks, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _listed(x), pa.array(ranked[:, 0]), pa.array(order, pa.list_(pa.int32()))], names=["vec_id", "embedding", "part", "order"])

    # Every row under its most probable part; queries also carry the order in which they would go on.
    index, _ = shared.store(usable.mapInArrow(assign, "vec_id long, embedding array<double>, part int, order array<int>"), "vectors")
    held = dict(index.groupBy("part").count().collect())  # one number a part
    size = F.array(*(F.lit(held.get(p, 0)).cast("long") for p in range(parts)))
    # The probes, and further parts as long as those before hold no more than k rows.
    before = lambda i: F.aggregate(F.slice("order", 1, i), F.lit(0).cast("long"), lambda total, p: total + F.element_at(size, p + 1))
    probed = F.filter("order", lambda p, i: (i < router.probes) | (before(i) <= k))
    asked = index.filter("order is not null").select("vec_id", "embedding", F.explode(probed).alias("part"))
    asking = dict(asked.groupBy("part").count().collect())
    per_part = lambda n: F.element_at(F.array(*(F.lit(-(-n.get(p, 0) // BLOCK_ROWS)) for p in range(parts))), F.col("part") + 1)
    blocks, query_blocks = per_part(held), per_part(asking)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), n).cast("int")
    # A row meets the queries of its own part only, block by block.
    corpus = index.filter(query_blocks > 0).select("part", deal(23, blocks).alias("block"), spread(query_blocks).alias("query_block"), "vec_id", "embedding")
    queries = asked.filter(blocks > 0).select("part", spread(blocks).alias("block"), deal(29, query_blocks).alias("query_block"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def rerank(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asked) and len(rows):
            ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_list())
            norm = np.sqrt((x * x).sum(axis=1))
            names, q = asked["query_id"].to_numpy(), np.stack(asked["query"].to_list())
            for a in range(0, len(q), 256):
                rough = (q[a : a + 256] @ x.T) / norm
                rough[names[a : a + 256, None] == ids[None, :]] = -np.inf
                for i, r in enumerate(rough):
                    bound = np.partition(r, len(r) - k)[len(r) - k] if len(r) > k else -np.inf
                    near = np.flatnonzero((r >= bound - 1e-9 * np.linalg.norm(q[a + i])) & np.isfinite(r))
                    # Row by row in one fixed order, so equal vectors get equal scores wherever they stand.
                    exact = (x[near] * q[a + i]).sum(axis=1) / (norm[near] * np.sqrt((q[a + i] * q[a + i]).sum()))
                    best = np.lexsort((ids[near], -exact))[:k]
                    found.append((np.full(len(best), names[a + i]), ids[near][best], exact[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))

    keys = ["part", "block", "query_block"]
    found = queries.groupBy(*keys).cogroup(corpus.groupBy(*keys)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
