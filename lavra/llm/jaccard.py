"""Similarity join of documents by the Jaccard measure of their word shingles, and its components.

Multiple global orders: a set's prefix under a global order of all shingles
holds, for a threshold t, its first n - ceil(t n) + 1 shingles. Two similar
sets share a shingle of their prefixes under every order, so a pair is a
candidate only if it passes under all of them. The orders put shingles from
rare to frequent, by counts in a fixed-size sketch of the whole corpus, and
break ties by different hashes.

The first order runs as a distributed join: documents that share a prefix
shingle, and could still be similar by size and position, are connected into
clusters. A cluster's texts meet in blocks of bounded size; there the prefixes
of all orders are intersected, and what passes is verified on the whole sets,
and each link once more on the words themselves.

One order connects unlike documents by chance, the more the larger the corpus,
until most of it is one cluster. So a cluster of many blocks is cut before its
texts meet: its members are joined once more among themselves alone, under an
order of its own, by counts of its own. Similar sets share a prefix shingle
under that order too and stay together; this goes on while it cuts.

`components` needs no pair that is connected already. A cluster of many blocks
(more than FEW_BLOCKS) first meets block by block, each with a few pivots of the cluster. Most near
copies are one component then; only documents outside of a cluster's largest
component meet all of its blocks. So a group of many thousands of near copies
is read about once or twice, not once a pair of blocks. `linked` verifies every
pair, block by block, and counts each document's links in the tasks; its work
grows with the square of a cluster, as the number of links does.

Documents with equal sets are one node, known by 128 bits of their set: 64 bits
name it, and if the others ever differ, all sets are named anew under another
seed.

Defined results: null and empty texts have no shingles and are linked with
nothing; a very long text is one set like others; rows without doc_id are linked
with nothing and have no component; repeated rows are equal sets and count once
as a link; of equal similarities and ids nothing is chosen, all links hold; an
empty table gives an empty result; other columns are ignored by `components` and
`linked` and kept by `keep_one`.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm import shared
from lavra.llm import text as tx
from lavra.llm.graph import connected_components

#: Similarity in hundredths, words of a shingle, number of orders.
SIMILAR, SHINGLE, ORDERS = 90, 3, 3
#: Counters of the frequency sketch, and the ranges it is summed in.
SKETCH, RANGES = 1 << 23, 128
#: Postings of a bucket to aim at; postings from which a shingle doesn't go to one task; documents of a block; about how many pivots a cluster has.
BUCKET_ROWS, HOT_ROWS, BLOCK_DOCS, PIVOTS = 200_000, 100_000, 512, 16
#: Blocks up to which all pairs of a cluster's blocks simply meet; both ways give the same links.
FEW_BLOCKS = 8
#: A cut of the large clusters is followed by another if it leaves at most so much of them.
CUT_TO = 0.9
#: Parts that the rows of a common shingle are joined in.
SALTS = 16
#: Groups of up to so many documents are paired; larger ones are chained.
PAIRED = 6
#: Shingles that are counted at once when all pairs are verified.
COUNTED = 1 << 21

_LOWERED = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def at_least(n: np.ndarray | int, similar: int = SIMILAR):
    """Smallest overlap with any similar set: ceil(t n)."""
    return (similar * n + 99) // 100


def overlap(total: np.ndarray | int, similar: int = SIMILAR):
    """Smallest overlap of two similar sets with so many shingles together: ceil(t / (1 + t) total)."""
    return -(-similar * total // (100 + similar))


def prefix(shingles: np.ndarray, level: np.ndarray, order: int, similar: int = SIMILAR) -> np.ndarray:
    """The set's prefix under an order, first shingle first."""
    n = len(shingles)
    size = n - at_least(n, similar) + 1
    rank = tx.mix64(shingles * _SEEDS[order]) >> np.uint64(6)
    key = (level[(shingles & np.uint64(len(level) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | rank
    if size < n:
        part = np.argpartition(key, size - 1)[:size]
        return shingles[part[np.argsort(key[part])]]
    return shingles[np.argsort(key)]


def signature(shingles: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two times 64 bits for a set, negative or positive as Spark's long."""
    out = []
    for k in (0xD6E8FEB86659FD93, 0xA5A3564E27F8862D):
        mixed = tx.mix64(shingles ^ np.uint64((k + seed) & 0xFFFFFFFFFFFFFFFF)).sum(dtype=np.uint64, keepdims=True)
        out.append(int(tx.mix64(mixed ^ np.uint64(len(shingles))).view(np.int64)[0]) if len(shingles) else 0)
    return out[0], out[1]


def signatures(docs: DataFrame, shingle: int = SHINGLE, seed: int = 0) -> DataFrame:
    """(doc_id, h, n, node, other) of every document, h of its text, and each task's share of the sketch as rows of (range, counts)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "h", "n", "node", "other", "range", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        kind = None
        for batch in tx.blocks(batches):
            kind = batch.column("doc_id").type
            sets = tx.shingles(tx.words(batch.column("text"), tx.NONBLANK), shingle)
            n = batch.num_rows
            named = [signature(s, seed) for s in sets]
            arrays = [batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in named], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            np.add.at(counts, (np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        if kind is not None:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, RANGES)]
            none = pa.nulls(RANGES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(RANGES, kind), none, none, none, none, pa.array(range(RANGES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, f"doc_id {id_type}, h long, n long, node long, other long, range int, counts binary")


def within(sets: list[np.ndarray], batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sets; where documents have a cluster, with shingles named anew by it, so that sets of two clusters share none."""
    if "root" not in batch.schema.names:
        return sets
    return [tx.mix64(s ^ of) for s, of in zip(sets, tx.mix64(batch.column("root").to_numpy().view(np.uint64)), strict=True)]


def sketch_within(members: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Each task's share of the sketch of the members' sets, within their clusters, as rows of (range, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(SKETCH, np.uint32), False
        for batch in tx.blocks(batches):
            some = True
            sets = within(tx.shingles(tx.words(batch.column("text"), tx.NONBLANK), shingle), batch)
            np.add.at(counts, (np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        if some:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, RANGES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(parts, pa.binary())], names=["range", "counts"])

    return members.select("text", "root").mapInArrow(run, "range int, counts binary")


def sketch_levels(found: DataFrame) -> np.ndarray:
    """log2 of every counter, one byte each: SKETCH bytes, whatever the corpus."""
    size = SKETCH // RANGES

    def total(parts: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.uint64)
        for x in parts.column("counts"):
            counts += np.frombuffer(zlib.decompress(x.as_py()), np.uint32 if "salt" in parts.column_names else np.uint64)
        return pa.table({"range": parts.column("range").slice(0, 1), "counts": pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())})

    salted = found.filter("range is not null").select("range", "counts", (F.monotonically_increasing_id() % 16).alias("salt"))
    once = salted.groupBy("range", "salt").applyInArrow(total, "range int, counts binary")
    rows = once.groupBy("range").applyInArrow(total, "range int, counts binary").collect()
    level = np.zeros(SKETCH, np.uint8)
    for r in rows:
        counts = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
        level[r["range"] * size : (r["range"] + 1) * size] = np.minimum(np.log2(counts + 1.0), 63)
    return level


def bucket_edges(token: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, by shared prefix shingle, all documents that could be similar by size and position."""
    order = np.lexsort((pos, node, n, token))
    token, node, n, pos = token[order], node[order], n[order], pos[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, n, pos = token[new], node[new], n[new], pos[new]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(token)))
    left, right = [], []
    for size in range(2, PAIRED + 1):
        at = first[count == size]
        for i in range(size):
            for j in range(i + 1, size):  # n[i] <= n[j]
                a, b = at + i, at + j
                could = (n[a] >= at_least(n[b], similar)) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= overlap(n[a] + n[b], similar))
                left.append(node[a[could]])
                right.append(node[b[could]])
    for a, size in zip(first[count > PAIRED].tolist(), count[count > PAIRED].tolist(), strict=True):
        # As the smaller set only early positions count; of those, the ones each larger set can reach stand in one run by size.
        m, p, who = n[a : a + size], pos[a : a + size], node[a : a + size]
        early = np.flatnonzero(p <= m - overlap(2 * m, similar))
        if not len(early):
            continue
        most = np.minimum(m, (m - p) * (100 + similar) // similar - m)
        low = np.searchsorted(m[early], at_least(m, similar), side="left")
        high = np.searchsorted(m[early], most, side="right")
        some = high > low
        left.append(who[early[low[some]]])
        right.append(who[some])
        chain = np.zeros(len(early) + 1, np.int64)
        np.add.at(chain, low[some], 1)
        np.add.at(chain, high[some] - 1, -1)
        joined = np.flatnonzero(np.cumsum(chain)[: len(early) - 1] > 0)
        left.append(who[early[joined]])
        right.append(who[early[joined + 1]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


def clusters(docs: DataFrame, level: np.ndarray, sent: Broadcast, similar: int, rows: int, shingle: int = SHINGLE, seed: int = 0) -> DataFrame:
    """(node, root): candidate clusters under the first order; sent: the levels; rows: about how many postings its prefixes have.

    docs: text alone; or with the node and root of each, then clusters within those roots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task count once
        for batch in tx.blocks(batches):
            node, size, tokens = [], [], []
            sets = tx.shingles(tx.words(batch.column("text"), tx.NONBLANK), shingle)
            asked = batch.column("node").to_pylist() if "node" in batch.schema.names else [None] * len(sets)
            for whole, s, only in zip(sets, within(sets, batch), asked, strict=True):
                if len(s) and (own := signature(whole, seed)[0]) not in seen and only in (None, own):  # not another text of the same id
                    seen.add(own)
                    node.append(own)
                    size.append(len(s))
                    tokens.append(prefix(s, sent.value, 0, similar).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], names=["node", "n", "tokens"])

    # Shingles whose counter is below the bound surely have fewer postings; the others are counted.
    hot_level = int(math.log2(HOT_ROWS))
    named = docs.mapInArrow(run, "node long, n int, tokens array<long>")
    postings = named.select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    suspects = np.flatnonzero(level >= hot_level)
    if len(suspects):
        def maybe_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t = batch.column("token").to_numpy().view(np.uint64) & np.uint64(SKETCH - 1)
                yield batch.append_column("suspect", pa.array(sent.value[t.astype(np.int64)] >= hot_level))

        marked = postings.mapInArrow(maybe_hot, "node long, n int, pos int, token long, suspect boolean")
        doubtful = marked.filter("suspect").drop("suspect")
        counted = doubtful.groupBy("token").agg(F.count("*").alias("times")).filter(F.col("times") > HOT_ROWS).select("token")
        # A hot shingle connects, within a band of sizes and the next, those that could be similar to anything by size and position.
        smallest = f"({similar} * n + 99) div 100"
        could = doubtful.filter(f"n - pos >= ({similar} * (n + {smallest}) + {99 + similar}) div {100 + similar}")
        band = F.floor(F.log("n") / math.log(100 / similar * 1.0001))
        could = could.select("token", "node", F.pmod("node", F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.array(band, band + 1)).alias("band"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        could = could.join(counted.select("token", salts), ["token", "salt"])
        least = could.groupBy("token", "band").agg(F.min("node").alias("least")).select("token", "band", "least", salts)
        stars = could.join(least, ["token", "band", "salt"]).select(F.col("least").alias("a"), F.col("node").alias("b"))
        spread = doubtful.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(counted.select("token", salts), ["token", "salt"], "left_anti").drop("salt")
        postings = marked.filter("not suspect").drop("suspect").unionByName(spread)
    buckets = max(1, -(-rows // BUCKET_ROWS))

    def edges_of(block: pa.Table) -> pa.Table:
        a, b = bucket_edges(*(block.column(c).to_numpy().astype(np.int64) for c in ("token", "node", "n", "pos")), similar)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    edges = postings.withColumn("bucket", F.pmod("token", F.lit(buckets))).groupBy("bucket").applyInArrow(edges_of, "a long, b long")
    if len(suspects):
        edges = edges.unionByName(stars)
    return connected_components(edges)


class Forest:
    """Disjoint sets of numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def shared_prefix(prefixes: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have a shingle of these prefixes in common."""
    m = len(prefixes)
    owner = np.repeat(np.arange(m), [len(p) for p in prefixes])
    _, token, count = np.unique(np.concatenate(prefixes), return_inverse=True, return_counts=True)
    keep = count[token] > 1
    _, token = np.unique(token[keep], return_inverse=True)
    owner = owner[keep]
    common = np.zeros((m, m), bool)
    for low in range(0, int(token.max()) + 1 if len(token) else 0, 2048):
        here = (token >= low) & (token < low + 2048)
        holds = np.zeros((m, 2048), np.float32)
        holds[owner[here], token[here] - low] = 1
        common |= holds @ holds.T > 0
    return common


def candidates(sets: list[np.ndarray], level: np.ndarray, similar: int = SIMILAR, cross: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that pass the filters; `cross`: block of each set, if only pairs of two blocks are asked for."""
    sizes = np.array([len(s) for s in sets])
    passed = sizes[:, None] >= at_least(sizes, similar)[None, :]
    passed &= passed.T
    for order in range(ORDERS):
        if passed.any():
            passed &= shared_prefix([prefix(s, level, order, similar) for s in sets])
    if cross is not None:
        passed &= cross[:, None] != cross[None, :]
    return np.nonzero(np.triu(passed, 1))


def shingle_words(text: str, k: int) -> set[tuple[bytes, ...]]:
    """A text's shingles as words."""
    words = text.encode().translate(_LOWERED).split()  # bytes split at the six blanks that separate words
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} - {()}


def same_words(one: set, other: set, similar: int) -> bool:
    both = len(one & other)
    return 100 * both >= similar * (len(one) + len(other) - both)


def links(sets: list[np.ndarray], level: np.ndarray, similar: int = SIMILAR, cross: np.ndarray | None = None, labels: list[int] | None = None, confirm=None) -> list[tuple[int, int]]:
    """Links of similar sets that connect what is connected; `cross` as for `candidates`.

    labels: sets with one label are connected already. confirm: called with a pair to settle it on the words.
    """
    whole: dict[int, set] = {}
    forest, out = Forest(len(sets)), []
    first: dict[int, int] = {}
    for i, label in enumerate(labels or ()):
        forest.join(first.setdefault(label, i), i)
    for i, j in zip(*(x.tolist() for x in candidates(sets, level, similar, cross)), strict=True):
        if forest.find(i) == forest.find(j):
            continue
        a = whole.setdefault(i, set(sets[i].tolist()))
        b = whole.setdefault(j, set(sets[j].tolist()))
        both = len(a & b)
        if 100 * both >= similar * (len(a) + len(b) - both) and (confirm is None or confirm(i, j)):
            forest.join(i, j)
            out.append((i, j))
    return out


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles each pair of sets has in common; sets are sorted."""
    m, both = len(sets), np.zeros(len(i), np.int64)
    ranges = max(1, -(-sum(len(s) for s in sets) // COUNTED))
    edges = [np.uint64(r * (1 << 64) // ranges) for r in range(1, ranges)]
    cuts = [np.concatenate([[0], np.searchsorted(s, np.array(edges, np.uint64)), [len(s)]]) for s in sets]
    for r in range(ranges):
        parts = [s[c[r] : c[r + 1]] for s, c in zip(sets, cuts, strict=True)]
        owner = np.repeat(np.arange(m), [len(p) for p in parts])
        _, token, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        keep = count[token] > 1
        _, token = np.unique(token[keep], return_inverse=True)
        owner, n = owner[keep], int(token.max()) + 1 if keep.any() else 0
        # A cell of the product of all sets costs about a hundredth of a shingle's look-up.
        if n * m * m < 100 * len(i) * len(owner) / m:
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            for low in range(0, n, 2048):
                here = slice(*np.searchsorted(token, [low, low + 2048]))
                holds = np.zeros((m, 2048), np.float32)
                holds[owner[here], token[here] - low] = 1
                both += (holds @ holds.T)[i, j].astype(np.int64)
        else:
            whole = [set(x.tolist()) for x in np.split(token, np.cumsum(np.bincount(owner, minlength=m))[:-1])]
            both += np.array([len(whole[a] & whole[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    return both


def all_links(sets: list[np.ndarray], level: np.ndarray, similar: int = SIMILAR, cross: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of similar sets; `cross` as for `candidates`."""
    i, j = candidates(sets, level, similar, cross)
    if not len(i):
        return i, j
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    both = common([sets[k] for k in used.tolist()], at[: len(i)], at[len(i) :])
    sizes = np.array([len(s) for s in sets])
    linked = 100 * both >= similar * (sizes[i] + sizes[j] - both)
    return i[linked], j[linked]


def _verified(docs: DataFrame, meetings: DataFrame, sent: Broadcast, similar: int, shingle: int, seed: int, counted: bool) -> DataFrame:
    """(a, b, n_links) of what meets; meetings: doc_id, node, label, copies, root, block, and the two blocks that meet."""
    tasks = max(1, meetings.count() // BLOCK_DOCS)

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets: list[np.ndarray] = []
        for batch in tx.blocks(table.to_batches()):
            sets += tx.shingles(tx.words(batch.column("text"), tx.NONBLANK), shingle)
        node, label, copies, root, block = (table.column(c).to_numpy() for c in ("node", "label", "copies", "root", "block"))
        lows, highs, text = table.column("one").to_numpy(), table.column("two").to_numpy(), table.column("text")
        same = np.array([len(s) > 0 and signature(s, seed)[0] == k for s, k in zip(sets, node.tolist(), strict=True)], bool)  # not another text of the same id
        groups: dict[tuple, dict[int, int]] = {}
        for i in np.flatnonzero(same).tolist():
            groups.setdefault((int(root[i]), int(lows[i]), int(highs[i])), {}).setdefault(int(node[i]), i)
        of_row = functools.lru_cache(4)(lambda i: shingle_words(text[i].as_py(), shingle))
        a, b, n_links = [], [], []
        for (_, low, high), members in groups.items():
            at = list(members.values())
            if len(at) < 2:
                continue
            own, cross = [sets[k] for k in at], block[at] if low != high else None
            confirm = lambda i, j, at=at: same_words(of_row(at[i]), of_row(at[j]), similar)
            if counted:
                one, two = all_links(own, sent.value, similar, cross)
                forest, weight = Forest(len(at)), copies[at]
                found = [(i, j) for i, j in zip(one.tolist(), two.tolist(), strict=True) if forest.find(i) != forest.find(j) and confirm(i, j) and forest.join(i, j)]
                n = np.bincount(one, weight[two], len(at)) + np.bincount(two, weight[one], len(at))
                some = np.flatnonzero(n)
                a += node[at][some].tolist()
                b += [None] * len(some)
                n_links += n[some].astype(np.int64).tolist()
            else:
                found = links(own, sent.value, similar, cross, label[at].tolist(), confirm)
            a += [node[at[i]] for i, _ in found]
            b += [node[at[j]] for _, j in found]
            n_links += [None] * len(found)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n_links": pa.array(n_links, pa.int64())})

    texts = docs.select("doc_id", "text").join(meetings, "doc_id").withColumn("task", F.pmod(F.xxhash64("root", "one", "two"), F.lit(tasks)))
    return texts.groupBy("task").applyInArrow(verify, "a long, b long, n_links long")


def _all_blocks(placed: DataFrame) -> DataFrame:
    """Every pair of a cluster's blocks meets."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.select("doc_id", "node", "label", "copies", "root", "block", other.alias("other"))
    return met.select("doc_id", "node", "label", "copies", "root", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))


def _own_blocks(placed: DataFrame) -> DataFrame:
    """All blocks of a cluster of few blocks meet; of a larger one, every block meets by itself, with the cluster's pivots."""
    pivot = F.pmod(F.xxhash64(F.lit(31), "node"), F.col("members")) < PIVOTS
    to = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    large = placed.filter(F.col("blocks") > FEW_BLOCKS).select("doc_id", "node", "label", "copies", "root", "block", F.explode(to).alias("one")).withColumn("two", F.col("one"))
    return _all_blocks(placed.filter(F.col("blocks") <= FEW_BLOCKS)).unionByName(large)


def _rest_with_all(placed: DataFrame) -> DataFrame:
    """Documents outside of a cluster's largest component meet all of its blocks, and each other."""
    by_label = placed.groupBy("root", "label").agg(F.count("*").alias("times"))
    most = by_label.groupBy("root").agg(F.max_by("label", F.struct("times", "label")).alias("largest"), F.sum("times").alias("all"), F.max("times").alias("in_it"))
    most = most.withColumn("rest_blocks", F.ceil((F.col("all") - F.col("in_it")) / BLOCK_DOCS).cast("int")).filter("rest_blocks > 0").select("root", "largest", "rest_blocks")
    found = placed.join(shared.checkpoint(most), "root").withColumn("rest", F.col("label") != F.col("largest"))
    found = found.withColumn("block", F.when(F.col("rest"), F.col("blocks") + F.pmod(F.xxhash64(F.lit(37), "node"), F.col("rest_blocks")).cast("int")).otherwise(F.col("block")))
    others = F.sequence(F.when(F.col("rest"), 0).otherwise(F.col("blocks")), F.col("blocks") + F.col("rest_blocks") - 1)
    met = found.select("doc_id", "node", "label", "copies", "root", "block", F.explode(others).alias("other"))
    return met.select("doc_id", "node", "label", "copies", "root", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))


def _cut(docs: DataFrame, nodes: DataFrame, found: DataFrame, similar: int, shingle: int, seed: int) -> DataFrame:
    """The clusters (node, root), those of many blocks cut by further orders as long as that makes them smaller."""
    one = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    postings, before, members, path = F.sum(F.col("n") * (100 - similar) / 100 + 1), None, None, None
    while True:
        roots = found.groupBy("root").agg(F.count("*").alias("members")).filter(F.col("members") > FEW_BLOCKS * BLOCK_DOCS)
        roots = shared.checkpoint(roots.select("root"))
        if roots.isEmpty():
            break
        large = shared.checkpoint(found.join(roots, "root").join(one, "node"))
        left, rows = large.agg(F.count("*"), postings).first()
        if before and left > CUT_TO * before:
            break
        texts = docs.select("doc_id", "text").join(large, "doc_id") if members is None else members.drop("root").join(large, "node")
        members, new = shared.store(texts.select("node", "root", "text"), "large-clusters")
        level = sketch_levels(sketch_within(members, shingle))
        sent = docs.sparkSession.sparkContext.broadcast(level)
        again = clusters(members, level, sent, similar, int(rows), shingle, seed)
        found = shared.checkpoint(found.join(large.select("node"), "node", "left_anti").unionByName(again))
        sent.unpersist()
        if path:
            shared.drop(docs.sparkSession, path)
        before, path = left, new
    if path:
        shared.drop(docs.sparkSession, path)
    return found


def similar_links(docs: DataFrame, nodes: DataFrame, level: np.ndarray, similar: int = SIMILAR, shingle: int = SHINGLE, counted: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """(node, root) of all linked nodes; if counted, also (node, n) with parts of the number of documents that a node's are linked to."""
    sent = docs.sparkSession.sparkContext.broadcast(level)  # SKETCH bytes
    rows = nodes.agg(F.sum(F.col("n") * (100 - similar) / 100 + 1)).first()[0] or 0
    found = clusters(docs.filter("doc_id is not null").select("text"), level, sent, similar, int(rows), shingle, seed)
    found = _cut(docs, nodes, found, similar, shingle, seed)
    sizes = found.groupBy("root").agg(F.count("*").alias("members"))
    copies = F.count_distinct("doc_id") if counted else F.lit(1).cast("long")
    first = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), copies.alias("copies"))
    placed = found.join(sizes, "root").join(first, "node").withColumn("blocks", F.ceil(F.col("members") / BLOCK_DOCS).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("label", F.col("node"))
    placed = shared.checkpoint(placed)
    verified = lambda meetings: shared.checkpoint(_verified(docs, meetings, sent, similar, shingle, seed, counted))
    if counted:
        out = verified(shared.checkpoint(_all_blocks(placed)))
        return connected_components(out.filter("b is not null").select("a", "b")), out.filter("b is null").select(F.col("a").alias("node"), F.col("n_links").alias("n"))
    labels = connected_components(verified(shared.checkpoint(_own_blocks(placed))).select("a", "b")).select("node", F.col("root").alias("label"))
    large = placed.filter(F.col("blocks") > FEW_BLOCKS).drop("label")
    if large.isEmpty():
        return labels.withColumnRenamed("label", "root"), None
    many = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = shared.checkpoint(_rest_with_all(many))
    if rest.isEmpty():
        return labels.withColumnRenamed("label", "root"), None
    # The further links join labels; a node without a label is its own.
    more = verified(rest).select("a", "b")
    for end in ("a", "b"):
        more = more.join(labels, more[end] == labels["node"], "left").withColumn(end, F.coalesce("label", end)).drop("node", "label")
    joined = connected_components(more)
    relabelled = labels.join(joined.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    sent.unpersist()
    return relabelled.unionByName(joined.join(labels, "node", "left_anti")), None


def components(docs: DataFrame, similar: int = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return _joined(docs, similar, shingle, counted=False).drop("n_links")


def linked(docs: DataFrame, similar: int = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """The columns of `components`, and n_links: how many other documents are similar to this one, exact copies included."""
    return _joined(docs, similar, shingle, counted=True)


def _named(docs: DataFrame, similar: int, shingle: int, counted: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, node) of every document, and the component of every node that has shingles, with its number of links."""
    seed = 0
    while True:
        found, path = shared.store(signatures(docs, shingle, seed), "shingle-sets")
        nodes = found.filter("range is null").select("doc_id", "h", "n", "node", "other")
        if nodes.filter("n > 0").groupBy("node").agg((F.min("other") != F.max("other")).alias("mixed")).filter("mixed").isEmpty():
            break
        shared.drop(docs.sparkSession, path)
        seed += 1
    level = sketch_levels(found)
    roots, parts = similar_links(docs, nodes, level, similar, shingle, counted, seed)
    copies, n_links = F.lit(1).cast("long"), F.lit(0).cast("long")
    if counted:
        copies = F.count_distinct("doc_id")
    first = nodes.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "node", "h")).alias("first"), copies.alias("copies"))
    first = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if counted:
        first = first.join(parts.groupBy("node").agg(F.sum("n").alias("others")), "node", "left")
        n_links = F.col("copies") - 1 + F.coalesce("others", F.lit(0))
    smallest = first.groupBy("root").agg(F.min("first").alias("component"))
    # Checkpointed, so that the rows of a much copied document can be joined to it in parts.
    named = shared.checkpoint(first.join(smallest, "root").select(F.col("node").alias("of"), "component", n_links.alias("links")))
    return nodes.drop("other"), named


def _joined(docs: DataFrame, similar: int, shingle: int, counted: bool) -> DataFrame:
    nodes, named = _named(docs, similar, shingle, counted)
    out = nodes.join(named, (nodes["node"] == named["of"]) & (nodes["n"] > 0), "left")
    some = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(some, F.coalesce("component.doc_id", "doc_id")).alias("component_id"), F.when(some, F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links")
    )


def keep_one(docs: DataFrame, similar: int = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, that of the smallest id; others of that id stay if they are not linked to it.

    Rows that repeat id and text keep one of them; documents without shingles and rows without doc_id stay.
    """
    nodes, named = _named(docs.filter("doc_id is not null"), similar, shingle, counted=False)
    empty = nodes.filter("n = 0").select("doc_id", "h").distinct()
    kept = named.select("component.doc_id", "component.h").distinct().unionByName(empty)
    packed = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), F.struct(*docs.columns).alias("doc"))
    one = packed.join(kept, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return one.select("doc.*").unionByName(docs.filter("doc_id is null"))
