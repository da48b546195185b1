"""Repeated byte strings by suffix sorting: linear grouping construction in bounded blocks.

A byte is removed if it lies in a 200-byte string that starts at another place
of the corpus too.

1. Anchors. The 32-byte gram with the smallest hash is a window's anchor, so
   equal windows have equal anchors at equal distance. Anchor grams that occur
   at one place only are dropped by a grouped minimum and maximum.
2. Contexts. For each shared anchor the bytes are cut out that the windows with
   that anchor cover; every window lies in exactly one context. Contexts with
   the same anchor go to the same block, many anchors to a block.
3. Suffix order. A block's distinct contexts are parsed into phrases at trigger
   grams, a prefix-free parse, and the suffixes of the string of phrases are
   sorted by grouping: suffixes are grouped by their Lyndon prefix, groups are
   processed in descending order using previous-smaller pointers, and then every
   group's order is emitted in one ascending pass, without renaming and
   recursion. As no phrase begins another, this is the order of the bytes.
4. Common prefixes of neighbours in that order, in bytes, and those of the
   reversed bytes before each phrase decide which windows are equal: the window
   that begins d bytes before a phrase stands twice if another phrase has the
   same d bytes before it and the same 200 - d bytes from it on.

An anchor with more contexts than a block takes is split by the bytes beside it:
a window extends over at least half of what is missing on one side, so contexts
are dealt anew by those bytes, left or right, until every group fits or has one
context only. Nothing is dropped, and copies of a passage need no block at all.

A text is known by 120 bits of its SHA-256. Copies of a whole text count once;
each copy of at least 200 bytes is removed altogether.

Defined results: null counts as empty; texts under 200 bytes keep all bytes;
very long texts are cut into contexts like others; repeated rows are copies of
each other, with or without doc_id; an empty table gives an empty result; other
columns are ignored. No row numbers are used, so the order of rows and retries
of tasks make no difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.llm import shared
from lavra.llm import text as tx

#: Bytes of a repeated string and of an anchor gram (a multiple of 8); one place in so many begins a phrase.
LENGTH, GRAM, PHRASE = 200, 32, 32
#: Contexts of a block to aim at, contexts of one anchor that a block takes at most, and parts that a hot anchor's rows are joined in.
BLOCK_CONTEXTS, HOT_CONTEXTS, SALTS = 4_000, 8_000, 16

_POSITION_BITS = np.uint64(30)
_TRIGGER = np.uint64(0x9FB21C651E98DF25)
EMPTY = hashlib.sha256(b"").hexdigest()
CONTEXT = "a long, h1 long, h2 long, starts array<int>, at int, core int, hot boolean, context binary"


def gram_hashes(eight: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hashes of the n grams of so many bytes, given the lanes of the bytes."""
    n = max(0, n)
    h = tx.mix64(eight[:n] ^ np.uint64(0xA0761D6478BD642F))
    for k in range(8, size, 8):
        h = tx.mix64(h ^ eight[k : k + n])
    return h


def window_minima(grams: np.ndarray, window: int) -> np.ndarray:
    """Place of the leftmost smallest gram of every window of so many grams."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = (grams >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < window:
        key = np.minimum(key[:n], key[window - span : window - span + n])
    return (key[:n] & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)


class Anchors:
    """Anchors of a block of documents, ascending: place, hash, document, and the first and last window that each anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        grams = gram_hashes(tx.lanes(data), len(data) - gram + 1, gram)
        best = window_minima(grams, length - gram + 1)
        n = np.maximum(np.diff(offsets) - length + 1, 0)
        starts = np.repeat(offsets[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        best = best[starts]
        new = np.flatnonzero(np.append(True, best[1:] != best[:-1])) if len(best) else np.zeros(0, np.int64)
        self.place = best[new]
        self.low = starts[new]
        self.high = starts[np.append(new[1:], len(best))[: len(new)] - 1]
        self.hash = grams[self.place]
        self.doc = np.repeat(np.arange(len(n)), n)[new]

    def ends_of_runs(self) -> np.ndarray:
        """Which anchors begin or end a run of equal grams of a document; periodic text has long ones."""
        same = (self.hash[1:] == self.hash[:-1]) & (self.doc[1:] == self.doc[:-1])
        return ~(np.append(False, same) & np.append(same, False)) if len(self.hash) else np.zeros(0, bool)


def lyndon_groups(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Phase 1: suffixes in groups by Lyndon prefix, groups ascending; the group start of each suffix; previous-smaller pointers.

    The symbols are 0 to their number; they are put in order by counting.
    """
    n = len(s)
    order, where = [0] * n, [0] * n
    group = [0] * n  # first index of the suffix's group in `order`
    last: dict[int, int] = {}  # end (exclusive) of the group that starts at an index
    first = [0] * (max(s, default=0) + 2)
    for c in s:
        first[c + 1] += 1
    for c in range(1, len(first)):
        if first[c]:
            last[first[c - 1]] = first[c - 1] + first[c]
        first[c] += first[c - 1]
    free = list(first)
    for p, c in enumerate(s):
        i = free[c]
        order[i], where[p], group[p], free[c] = p, i, first[c], i + 1
    previous = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        members = order[start:end]
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > start:
                p = previous[p]
            previous[i] = p
        repeats: dict[int, int] = {}
        for i in members:  # the same prefix again: all of its repeats belong to the smaller suffix before
            p, path = i, []
            while p >= 0 and group[p] == start:
                path.append(p)
                p = previous[p]
            for q in path:
                previous[q] = p
            if p >= 0:
                repeats[p] = repeats.get(p, 0) + 1
        # A smaller suffix takes up the prefixes that follow it. Those that take up more of them come later in their group.
        movers = list(repeats)
        while movers:
            tail: dict[int, int] = {}
            for p in movers:
                g = group[p]
                t = tail.get(g)
                t = (last[g] if t is None else t) - 1
                tail[g] = t
                i, other = where[p], order[t]
                order[t], order[i] = p, other
                where[p], where[other] = t, i
            for g, t in tail.items():
                if t != g:
                    stop = last[g]
                    last[g], last[t] = t, stop
                    for p in order[t:stop]:
                        group[p] = t
            movers = [p for p in movers if repeats[p] > 1]
            for p in movers:
                repeats[p] -= 1
        end = start
    return order, group, previous


def suffix_order(s: list[int]) -> list[int]:
    """The suffix array: phase 1, then each group's order in one pass over the suffixes as they become known.

    The suffix before a known one and its chain of previous-smaller suffixes
    have that one as their next smaller suffix; within a group that suffix decides.
    """
    n = len(s)
    _, group, previous = lyndon_groups(s)
    free = list(range(n))  # next free index by group start
    placed = [False] * n
    out = [0] * n
    t = n
    for i in range(n + 1):
        p = t - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = previous[p]
        if i < n:
            t = out[i]
    return out


def common_prefix(eight: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from the places a and b on are equal, `most` at most."""
    n, alive, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(alive):
        alive = alive[most[alive] > k]
        x = eight[a[alive] + k] ^ eight[b[alive] + k]
        differs = x != 0
        lowest = x[differs] & (~x[differs] + np.uint64(1))
        n[alive[differs]] = k + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
        alive, k = alive[~differs], k + 8
        n[alive] = k
    return np.minimum(n, most)


def _ranks(slices: list[bytes]) -> np.ndarray:
    """Each string's rank among the distinct ones."""
    rank = {x: i for i, x in enumerate(sorted(set(slices)))}
    return np.fromiter((rank[x] for x in slices), np.int64, len(slices))


def repeated_windows(contexts: list[bytes], anchors: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the windows that stand at two places or more of these contexts.

    anchors: a place in each context whose gram lies in all its windows.
    """
    raw = b"".join(contexts)
    data = np.frombuffer(raw + bytes(length + 8), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in contexts])])
    size = int(offsets[-1])
    eight = tx.lanes(data)
    # Phrases begin at grams that a hash picks and at every anchor's gram. Whether a place begins one depends on its gram alone.
    grams = gram_hashes(eight, size - gram + 1, gram)
    begins = tx.mix64(eight[: len(grams)] ^ _TRIGGER) < np.uint64((1 << 64) // PHRASE)
    begins |= np.isin(grams, grams[offsets[:-1] + anchors])
    cut = np.flatnonzero(begins)
    of = np.searchsorted(offsets, cut, side="right") - 1
    inside = cut + gram <= offsets[of + 1]
    cut, of = cut[inside], of[inside]
    begin, end = offsets[of], offsets[of + 1]
    follows = np.append(False, of[1:] == of[:-1])
    left = np.where(follows, np.append(0, cut[:-1]) + 1, begin)  # the bytes before the phrase that no earlier phrase begins in
    stop = np.where(np.append(follows[1:], False), np.append(cut[1:], 0) + gram, end)
    # The string of phrases; a symbol smaller than all ends each context.
    text = np.zeros(len(cut) + len(contexts), np.int64)
    at = np.arange(len(cut)) + of
    text[at] = _ranks([raw[i:j] for i, j in zip(cut.tolist(), stop.tolist(), strict=True)]) + 1
    number = np.full(len(text), -1)
    number[at] = np.arange(len(cut))
    order = number[np.array(suffix_order(text.tolist()), np.int64)]
    order = order[order >= 0]
    a, b = order[:-1], order[1:]
    rest = np.minimum(end - cut, length)
    right_common = common_prefix(eight, cut[a], cut[b], np.minimum(rest[a], rest[b]))
    # The bytes before phrases, backwards.
    before = cut - left
    turned = tx.lanes(np.concatenate([data[size - 1 :: -1] if size else data[:0], np.zeros(length + 8, np.uint8)]))
    back = np.argsort(_ranks([raw[i:j][::-1] for i, j in zip(left.tolist(), cut.tolist(), strict=True)]), kind="stable")
    c, d = back[:-1], back[1:]
    left_common = common_prefix(turned, size - cut[c], size - cut[d], np.minimum(before[c], before[d]))

    def best(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each phrase, its place in the order and the longer of both neighbours' common bytes."""
        place, most = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        place[order] = np.arange(len(order))
        most[order] = np.maximum(np.append(0, common), np.append(common, 0))
        return place, most

    right_place, right_most = best(order, right_common)
    left_place, left_most = best(back, left_common)
    low = np.maximum(np.maximum(length - right_most, cut + length - end), 0)
    high = np.minimum(before, left_most)
    some = np.flatnonzero(low <= high)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for d in range(int(low[some].min()), int(high[some].max()) + 1) if len(some) else ():
        now = some[(low[some] <= d) & (d <= high[some])]
        if len(now) < 2:
            continue
        right_class = np.append(0, np.cumsum(right_common < length - d))[right_place[now]]
        left_class = np.append(0, np.cumsum(left_common < d))[left_place[now]]
        _, same, count = np.unique(right_class * len(cut) + left_class, return_inverse=True, return_counts=True)
        twice = now[count[same] > 1]
        found.append((of[twice], cut[twice] - d - begin[twice]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def repeated_spans(block: pa.Table, length: int, gram: int) -> pa.Table:
    """(h1, h2, start, end) of bytes in a block's contexts that stand at two places or more."""
    h1, h2, anchor = (block.column(c).to_pylist() for c in ("h1", "h2", "a"))
    starts, at, raw = (block.column(c).to_pylist() for c in ("starts", "at", "context"))
    number: dict[bytes, int] = {}
    places: list[dict[tuple[int, int, int], list[int]]] = []
    first: list[int] = []
    for i, x in enumerate(raw):
        k = number.setdefault(x, len(number))
        if k == len(places):
            places.append({})
            first.append(i)
        places[k][h1[i], h2[i], starts[i][0]] = starts[i]
    distinct = list(number)
    others: dict[int, int] = {}
    for i in first:
        others[anchor[i]] = others.get(anchor[i], 0) + 1
    met = [k for k, i in enumerate(first) if others[anchor[i]] > 1]
    spans: list[list[tuple[int, int]]] = [[] for _ in distinct]
    if met:
        of, offset = repeated_windows([distinct[k] for k in met], np.array([at[first[k]] for k in met], np.int64), length, gram)
        by = np.lexsort((offset, of))
        for k, x in zip(of[by].tolist(), offset[by].tolist(), strict=True):
            own = spans[met[k]]
            if own and x <= own[-1][1]:
                own[-1] = (own[-1][0], x + length)
            else:
                own.append((x, x + length))
    rows: list[tuple[int, int, int, int]] = []
    for k, own in enumerate(places):
        if len(own) > 1 or any(len(s) > 1 for s in own.values()):
            spans[k] = [(0, len(distinct[k]))]  # the context itself stands twice
        rows += [(a, b, s + x, s + y) for (a, b, _), each in own.items() for s in each for x, y in spans[k]]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["h1", "h2", "start", "end"])


def _identity(digest: Column) -> tuple[Column, Column]:
    """120 bits of a SHA-256 as two numbers."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h1"), F.conv(F.substring(digest, 16, 15), 16, 10).cast("long").alias("h2")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once a task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = []
        for key in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _split(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts dealt anew by the bytes left and right of their core; each window goes one way."""
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("a", "h1", "h2", "starts", "at", "core", "context"))
        for a, h1, h2, starts, at, core, context in zip(*columns, strict=True):
            missing = length - core
            half = (missing + 1) // 2
            low, high = max(0, at + core - length), min(at, len(context) - length)
            for side, x, y, begin, more in ((b"<", low, min(high, at - half), at - half, half), (b">", max(low, at - half + 1), high, at, missing - half + 1)):
                if x <= y:
                    size = min(length, core + more)
                    key = hashlib.blake2b(b"%d%b%b" % (a, side, context[begin : begin + size]), digest_size=8).digest()
                    rows.append((int.from_bytes(key, "little", signed=True), h1, h2, [s + x for s in starts], begin - x, size, True, context[x : y + length]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "h1", "h2", "starts", "at", "core", "hot", "context"])


def split_hot(contexts: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Spans that need no block, and contexts in groups of at most `hot`, of the anchors with more contexts than a block takes."""
    first = F.element_at("starts", 1)
    salt = F.pmod(F.xxhash64("h1", "h2", first), F.lit(SALTS))
    places = [c for x in (F.col("h1"), F.col("h2"), first) for c in (F.min(x) != F.max(x),)]
    whole = left = None
    while True:
        groups = contexts.groupBy("a").agg(F.count("*").alias("times"), (F.min("context") == F.max("context")).alias("same"), (places[0] | places[1] | places[2] | (F.max(F.size("starts")) > 1)).alias("apart"))
        kind = F.when(F.col("same"), F.when(F.col("apart"), "whole")).when(F.col("times") <= hot, "block").otherwise("split")
        kinds = groups.select("a", kind.alias("kind")).filter("kind is not null").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # The rows of a hot anchor meet its kind in SALTS parts.
        table, _ = shared.store(contexts.withColumn("salt", salt.cast("int")).join(kinds, ["a", "salt"]).drop("salt"), "hot-contexts")
        spans = table.filter("kind = 'whole'").select("h1", "h2", F.explode("starts").alias("start"), F.octet_length("context").alias("n")).select("h1", "h2", "start", (F.col("start") + F.col("n")).alias("end"))
        blocks = table.filter("kind = 'block'").drop("kind")
        whole = spans if whole is None else whole.unionByName(spans)
        left = blocks if left is None else left.unionByName(blocks)
        more = table.filter("kind = 'split'").drop("kind")
        if more.isEmpty():
            return whole, left
        contexts = more.mapInArrow(lambda batches: _split(batches, length), CONTEXT)


def find_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_CONTEXTS) -> DataFrame:
    """(h1, h2, text, copied, cuts): texts with a shared anchor, each once unless copied, with the byte spans [start, end) that repeat elsewhere."""
    text = F.coalesce("text", F.lit(""))
    long = docs.select(text.alias("text")).filter(F.octet_length("text") >= length).select(*_identity(F.sha2("text", 256)), "text")
    numbers = "h1 long, h2 long"

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in _once(batches) for part in tx.blocks([whole])):
            data, offsets = tx.utf8(batch.column("text"))
            found = Anchors(data, offsets, length, gram)
            keep = found.ends_of_runs()
            doc = found.doc[keep]
            arrays = [pa.array(found.hash[keep].view(np.int64)), *(pa.array(batch.column(c).to_numpy()[doc]) for c in ("h1", "h2")), pa.array((found.place[keep] - offsets[doc]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "h1", "h2", "p"])

    # Stored, as it is read twice and costs a pass over all texts.
    found, anchor_path = shared.store(long.mapInArrow(find_anchors, f"a long, {numbers}, p int"), "anchors")
    apart = (F.min("h1") != F.max("h1")) | (F.min("h2") != F.max("h2")) | (F.min("p") != F.max("p"))
    shared_anchors = found.groupBy("a").agg(apart.alias("apart"), (F.count("*") > hot).alias("hot")).filter("apart").select("a", "hot")
    # An anchor's place and, in the lowest bit, whether the anchor is hot.
    places = found.join(shared_anchors, "a").groupBy("h1", "h2").agg(F.collect_set(F.col("p").cast("long") * 2 + F.col("hot").cast("long")).alias("places"))
    copies = long.groupBy("h1", "h2").agg((F.count("*") > 1).alias("copied"))
    wanted = places.join(copies, ["h1", "h2"])
    texts = long.mapInArrow(_once, f"{numbers}, text string")
    table, _ = shared.store(texts.join(wanted, ["h1", "h2"]), "texts")
    shared.drop(docs.sparkSession, anchor_path)

    def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in _once(batches) for part in tx.blocks([whole])):
            data, offsets = tx.utf8(batch.column("text"))
            found = Anchors(data, offsets, length, gram)
            lists = batch.column("places")
            coded = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            # A document's shared grams by (document, gram).
            at = np.searchsorted(found.place, offsets[owner] + (coded >> 1))
            salted = tx.mix64(found.hash ^ tx.mix64(found.doc.astype(np.uint64)))
            chosen = np.flatnonzero(np.isin(salted, salted[at]))
            hot_ones = np.isin(salted[chosen], salted[at[(coded & 1) == 1]])
            raw = data.tobytes()
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            rows: dict[tuple[int, bytes], list] = {}
            base = offsets[found.doc[chosen]]
            columns = (found.hash.view(np.int64)[chosen], found.doc[chosen], found.low[chosen], found.high[chosen], found.place[chosen], base, hot_ones)
            for a, d, low, high, place, zero, is_hot in zip(*(c.tolist() for c in columns), strict=True):
                context = raw[low : high + length]
                row = rows.setdefault((d, context), [a, d, [], place - low, is_hot])
                row[2].append(low - zero)  # equal contexts of a text go together
            kept = list(rows.values())
            docs_of = np.array([r[1] for r in kept], np.int64)
            arrays = [
                pa.array([r[0] for r in kept], pa.int64()), pa.array(h1[docs_of]), pa.array(h2[docs_of]), pa.array([r[2] for r in kept], pa.list_(pa.int32())), pa.array([r[3] for r in kept], pa.int32()),
                pa.array(np.full(len(kept), gram, np.int32)), pa.array([r[4] for r in kept], pa.bool_()), pa.array([c for _, c in rows], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "h1", "h2", "starts", "at", "core", "hot", "context"])

    cut = lambda rows: rows.select("h1", "h2", "places", "text").mapInArrow(cut_contexts, CONTEXT)
    contexts, spans = cut(table).filter("not hot"), None
    with_hot = table.filter(F.exists("places", lambda x: x.bitwiseAND(F.lit(1)) == 1))
    if not with_hot.isEmpty():
        spans, more = split_hot(cut(with_hot).filter("hot"), length, hot)
        contexts = contexts.unionByName(more)
    total = table.agg(F.sum(F.size("places")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // BLOCK_CONTEXTS))
    dealt = contexts.select("a", "h1", "h2", "starts", "at", "context", F.pmod("a", F.lit(buckets)).alias("bucket"))
    in_blocks = dealt.groupBy("bucket").applyInArrow(lambda block: repeated_spans(block, length, gram), f"{numbers}, start int, end int")
    spans = in_blocks if spans is None else spans.unionByName(in_blocks)
    cuts = spans.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    return table.select("h1", "h2", "copied", "text").join(cuts, ["h1", "h2"])


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay, for every document."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for c in cuts:
                    if merged and c["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], c["end"])
                    else:
                        merged.append([c["start"], c["end"]])
                removed.append(sum(b - a for a, b in merged))
                spans.append(len(merged))
                raw, at, out = text.encode(), 0, hashlib.sha256()
                for a, b in merged:
                    out.update(raw[at:a])
                    at = b
                out.update(raw[at:])
                kept.append(out.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=["h1", "h2", "removed", "spans", "kept"])

    found = find_spans(docs, length, gram, hot).filter("not copied").select("h1", "h2", "text", "cuts")
    cut = found.mapInArrow(finish, "h1 long, h2 long, removed long, spans long, kept string")
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    whole = whole.select("doc_id", "digest", "n_bytes", *_identity(F.col("digest")))
    copied = whole.filter(F.col("n_bytes") >= length).groupBy("h1", "h2").agg(F.count("*").alias("rows"), F.first("n_bytes").alias("n")).filter("rows > 1")
    marks = copied.select("h1", "h2", F.col("n").alias("removed"), F.lit(1).cast("long").alias("spans"), F.lit(EMPTY).alias("kept")).unionByName(cut)
    none = F.lit(0).cast("long")
    joined = whole.join(shared.checkpoint(marks), ["h1", "h2"], "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("removed", none).alias("n_removed"), F.coalesce("spans", none).alias("n_spans"), F.coalesce("kept", "digest").alias("kept_sha256"))
