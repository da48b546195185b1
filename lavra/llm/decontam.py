"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: a shard holds the postings (sorted
positions by term) of a bounded number of words of whole documents, and is
stored as one row in the shared folder. It has all terms, whatever is asked
later; beside a term's hash stands the word itself, and a term is found only if
the words are equal. A query is a window of consecutive words of a benchmark
item. Each shard takes a window's terms from the rarest there to the most
frequent and intersects their offset-adjusted posting lists; what is left are
the exact phrases. Proximity matches are found from the rarest terms as well: a
window matches at a place if its terms stand within SLOP words of theirs, but
for MISSING of them (one in four at most). Such a match holds one of its
MISSING + 1 rarest terms, whichever those are in a shard, so the sharding
doesn't change the result.

The benchmark is answered in parts of about PART_BYTES, one after the other: the
driver holds one part at a time, and only documents with matches are returned by
a part. A small benchmark is one part of the same kind.

Defined results: null and empty texts have no words and are clean; a very long
text is indexed whole, in a shard of its own size; an item without words matches
nothing; items that repeat count once a name; an empty benchmark leaves all
documents clean, an empty table gives an empty result; repeated rows, also of one
doc_id or without any, are judged one by one; other columns are ignored by
`decontaminate` and kept by `clean`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm import shared
from lavra.llm import text as tx

#: Words of a window, words of an index shard, and benchmark bytes of one broadcast.
WINDOW = 13
SHARD_WORDS = 1 << 20
PART_BYTES = 2 << 20
#: Words that a term of a proximity match may stand off, and terms that may be missing.
SLOP, MISSING = 2, 1
#: Candidate places that one intersection handles at once; those of one frequent term are cut as well.
CHUNK = 1 << 21
#: A document is contaminated if one in so many of its words is hit.
HIT_SHARE = 20

#: Words of lower-cased bytes.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWERED = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
INDEX = "shard long, docs array<{}>, words array<int>, terms array<long>, names array<binary>, counts array<int>, places array<int>"


class Queries:
    """Windows of some items: their terms as numbers into a sorted vocabulary, -1 where a window is shorter."""

    def __init__(self, items: list[tuple[str, np.ndarray, list[bytes]]], window: int = WINDOW):
        spelled = {h: w for _, terms, words in items for h, w in zip(terms.tolist(), words, strict=True)}
        windows: dict[bytes, int] = {}
        rows, pairs = [], []
        self.names = [name for name, _, _ in items]
        for number, (_, terms, _) in enumerate(items):
            for at in range(max(1, len(terms) - window + 1) if len(terms) else 0):
                part = terms[at : at + window]
                w = windows.setdefault(part.tobytes(), len(rows))
                if w == len(rows):
                    rows.append(part)
                pairs.append((w, number))
        self.vocabulary = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
        self.words = [spelled[h] for h in self.vocabulary.tolist()]
        self.terms = np.full((len(rows), window), -1, np.int64)
        for w, part in enumerate(rows):
            self.terms[w, : len(part)] = np.searchsorted(self.vocabulary, part)
        self.lengths = (self.terms >= 0).sum(axis=1)
        found = sorted(set(pairs))
        self.pair_window = np.array([w for w, _ in found], np.int64)
        self.pair_item = np.array([i for _, i in found], np.int64)
        self.pair_first = np.searchsorted(self.pair_window, np.arange(len(rows) + 1))


def build_index(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per shard: its documents, their word counts, and sorted terms with their words and places.

    Places count words across the shard's documents with a gap of three windows
    between two of them, so that no match crosses a document's end.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def row(ids: list, sizes: list, hashes: list, places: list, known: list, spelled: list) -> pa.RecordBatch:
        h, p = np.concatenate(hashes), np.concatenate(places)
        order = np.lexsort((p, h))
        terms, counts = np.unique(h, return_counts=True)
        _, one = np.unique(np.concatenate(known), return_index=True)
        names = pa.concat_arrays(spelled).take(pa.array(one))
        arrays = [pa.concat_arrays(ids), pa.array(np.concatenate(sizes), pa.int32()), pa.array(terms.view(np.int64)), names, pa.array(counts.astype(np.int32)), pa.array(p[order].astype(np.int32))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
        return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(os.urandom(8), "little", signed=True)]), *lists], names=["shard", "docs", "words", "terms", "names", "counts", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base = tuple([] for _ in range(6)), 0
        for batch in tx.blocks(batches):
            data, offsets = tx.utf8(batch.column("text"))
            found = tx.Words(data, offsets, tx.ALNUM)
            counts = found.counts()
            place = np.arange(len(found.hash)) + base + 3 * window * np.repeat(np.arange(len(counts)), counts)
            own, one = np.unique(found.hash, return_index=True)
            raw = data.tobytes().translate(_LOWERED)
            spelled = pa.array([raw[a:b] for a, b in zip(found.start[one].tolist(), found.end[one].tolist(), strict=True)], pa.binary())
            for of, value in zip(held, (batch.column("doc_id"), counts, found.hash, place, own, spelled), strict=True):
                of.append(value)
            base += int(counts.sum()) + 3 * window * len(counts)
            if base >= SHARD_WORDS:
                yield row(*held)
                held, base = tuple([] for _ in range(6)), 0
        if held[0]:
            yield row(*held)

    return docs.select("doc_id", "text").mapInArrow(run, INDEX.format(kind))


def _stands(keys: np.ndarray, term: np.ndarray, place: np.ndarray, slop: int = 0) -> np.ndarray:
    """Whether the term stands at the place, or within the slop of it."""
    low = term * (1 << 32) + np.maximum(place - slop, 0)
    near = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
    return (place + slop >= 0) & (keys[near] >= low) & (keys[near] <= term * (1 << 32) + place + slop)


def _entries(lengths: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of its list, place in it) of every entry of lists of these lengths, at most so many at once; a long list is cut."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, most):
        entry = np.arange(at, min(at + most, total))
        of = np.searchsorted(ends, entry, side="right")
        yield of, entry - (ends[of] - lengths[of])


def _intersect(queries: Queries, counts: np.ndarray, firsts: np.ndarray, keys: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, place of its first word) of all exact matches in a shard, piece by piece."""
    lists = np.where(queries.terms >= 0, counts[queries.terms], np.iinfo(np.int64).max)
    alive = np.flatnonzero(lists.min(axis=1) > 0) if len(lists) else np.zeros(0, np.int64)
    order = np.argsort(lists[alive], axis=1, kind="stable")
    terms = np.take_along_axis(queries.terms[alive], order, axis=1)
    for w, within in _entries(counts[terms[:, 0]], CHUNK):
        start = places[firsts[terms[w, 0]] + within] - order[w, 0]
        for r in range(1, queries.terms.shape[1]):
            term = terms[w, r]
            there = term < 0  # shorter windows have no such term
            there |= _stands(keys, np.maximum(term, 0), start + order[w, r])
            w, start = w[there], start[there]
        if len(w):
            yield alive[w], start


def _proximity(queries: Queries, counts: np.ndarray, firsts: np.ndarray, keys: np.ndarray, places: np.ndarray, first: np.ndarray, slop: int, missing: int) -> np.ndarray:
    """Sorted codes, document << 32 | window, of the documents of a shard that hold a proximity match of a window.

    A document in which a window is known to match isn't tried for it again; a
    place is given up as soon as more of its terms are missing than may be.
    """
    real = queries.terms >= 0
    lists = np.where(real, counts[queries.terms], np.iinfo(np.int64).max)
    allowed = np.minimum(missing, (queries.lengths - 1) // 4)
    alive = np.flatnonzero(((lists > 0) & real).sum(axis=1) >= queries.lengths - allowed)
    order = np.argsort(lists[alive], axis=1, kind="stable")
    shifts = np.arange(-slop, slop + 1)
    found = np.zeros(0, np.int64)
    for r in range(min(missing + 1, queries.terms.shape[1])):
        own = np.flatnonzero(allowed[alive] >= r)
        term = queries.terms[alive[own], order[own, r]]
        for of, within in _entries(counts[term], CHUNK // len(shifts)):
            nth, spot = own[of], places[firsts[term[of]] + within]
            code = (np.searchsorted(first, spot, side="right") - 1 << 32) | alive[nth]
            if len(found):
                new = found[np.minimum(np.searchsorted(found, code), len(found) - 1)] != code
                nth, spot, code = nth[new], spot[new], code[new]
            start = ((spot - order[nth, r])[:, None] + shifts).ravel()
            nth, code = np.repeat(nth, len(shifts)), np.repeat(code, len(shifts))
            lost = np.zeros(len(nth), np.int64)
            for c in range(queries.terms.shape[1]):
                column = order[nth, c]
                asked = queries.terms[alive[nth], column]
                lost += (asked >= 0) & ~_stands(keys, np.maximum(asked, 0), start + column, slop)
                kept = lost <= allowed[alive[nth]]
                nth, code, start, lost = nth[kept], code[kept], start[kept], lost[kept]
            found = np.union1d(found, code)
    return found


def _joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges with those that meet or overlap made one, by start."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    head = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[head], end[np.append(head[1:], len(end)) - 1] if len(start) else end


def _by_document(queries: Queries, found: np.ndarray, n: int) -> list[list[str]]:
    """Names of the items that have these windows (distinct codes, document << 32 | window), of each document."""
    doc, w = found >> 32, found & ((1 << 32) - 1)
    many = queries.pair_first[w + 1] - queries.pair_first[w]
    pair = np.repeat(queries.pair_first[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    items: list[list[str]] = [[] for _ in range(n)]
    for code in np.unique(np.repeat(doc, many) * (1 << 32) + queries.pair_item[pair]).tolist():
        items[code >> 32].append(queries.names[code & ((1 << 32) - 1)])
    return items


def _answers(queries: Queries, shard: dict, spelled: pa.Array, slop: int, missing: int, window: int) -> tuple[list, list, list]:
    """Hit word ranges (flat start, end pairs), names of items found, and of those found near, of each document of a shard."""
    sizes = np.asarray(shard["words"], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 3 * window)])
    ranges: list[list[int]] = [[] for _ in sizes]
    none: list[list[str]] = [[] for _ in sizes]
    if not len(queries.vocabulary):
        return ranges, none, none
    stored = np.asarray(shard["terms"], np.int64).view(np.uint64)
    number = np.minimum(np.searchsorted(queries.vocabulary, stored), len(queries.vocabulary) - 1)
    ours = queries.vocabulary[number] == stored
    which = np.flatnonzero(ours)
    ours[which] = [x == queries.words[k] for x, k in zip(spelled.take(pa.array(which)).to_pylist(), number[which].tolist(), strict=True)]
    all_counts = np.asarray(shard["counts"], np.int64)
    places = np.asarray(shard["places"], np.int64)[np.repeat(ours, all_counts)]
    counts = np.zeros(len(queries.vocabulary), np.int64)
    counts[number[ours]] = all_counts[ours]
    firsts = np.cumsum(counts) - counts
    keys = np.repeat(np.arange(len(counts)), counts) * (1 << 32) + places
    near = _proximity(queries, counts, firsts, keys, places, first, slop, missing)
    if not len(near):
        return ranges, none, none
    codes, starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for w, start in _intersect(queries, counts, firsts, keys, places):
        codes = np.union1d(codes, (np.searchsorted(first, start, side="right") - 1 << 32) | w)
        starts, ends = _joined(np.concatenate([starts, start]), np.concatenate([ends, start + queries.lengths[w]]))
    doc = np.searchsorted(first, starts, side="right") - 1  # documents stand apart, so no range joins two
    for d, a, b in zip(doc.tolist(), (starts - first[doc]).tolist(), (ends - first[doc]).tolist(), strict=True):
        ranges[d] += [a, b]
    return ranges, _by_document(queries, codes, len(sizes)), _by_document(queries, near, len(sizes))


def search(index: DataFrame, queries: Queries, slop: int = SLOP, missing: int = MISSING, window: int = WINDOW) -> DataFrame:
    """(shard, nth, ranges, items, near) of the indexed documents that hold anything asked for."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("words", "terms", "counts", "places")}
                ranges, items, near = _answers(q, shard, batch.column("names")[i].values, slop, missing, window)
                some = [d for d, x in enumerate(near) if x]
                of = [batch.column("shard")[i].as_py()] * len(some)
                lists = [pa.array([x[d] for d in some], pa.list_(t)) for x, t in ((ranges, pa.int32()), (items, pa.string()), (near, pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(some, pa.int32()), *lists], names=["shard", "nth", "ranges", "items", "near"])

    return index.drop("docs").mapInArrow(run, "shard long, nth int, ranges array<int>, items array<string>, near array<string>")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of the ranges that several parts of the benchmark found in a document."""
    for batch in batches:
        merged = []
        for flat in batch.column("ranges").to_pylist():
            out: list[int] = []
            for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if out and a <= out[-1]:
                    out[-1] = max(out[-1], b)
                else:
                    out += [a, b]
            merged.append(out)
        yield batch.set_column(batch.schema.get_field_index("ranges"), "ranges", pa.array(merged, pa.list_(pa.int32())))


def item_parts(benchmark: DataFrame) -> Iterator[list[tuple[str, np.ndarray, list[bytes]]]]:
    """The benchmark in parts of bounded size, as item names, word hashes and words; each part is read by itself."""
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // PART_BYTES + 1
    dealt = items.withColumn("part", F.pmod(F.xxhash64("name", "text"), F.lit(parts)).cast("int"))
    table, path = shared.store(dealt.repartition("part"), "benchmark", by="part")
    for p in range(parts):
        rows = table.filter(F.col("part") == p).select("name", "text").collect()
        texts = [r["text"] for r in rows]
        words = [_WORD.findall(t.encode().translate(_LOWERED)) for t in texts]
        yield list(zip([r["name"] for r in rows], tx.hash_words(texts, tx.ALNUM), words, strict=True))
    shared.drop(benchmark.sparkSession, path)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, missing: int = MISSING) -> DataFrame:
    """doc_id, n_words, n_hit, items and near (sorted names) and contaminated for every document."""
    index, _ = shared.store(build_index(docs, window), "postings", large_rows=True)
    found = None
    for part in item_parts(benchmark):
        hits, _ = shared.store(search(index, Queries(part, window), slop, missing, window), "matches")
        found = hits if found is None else found.unionByName(hits)
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near")]
    found = found.groupBy("shard", "nth").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), *lists)
    found = found.mapInArrow(_merge, found.schema)
    n_hit = F.aggregate(F.transform("ranges", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    base = index.select("shard", F.posexplode(F.arrays_zip("docs", "words")).alias("nth", "doc")).select("shard", "nth", F.col("doc.docs").alias("doc_id"), F.col("doc.words").cast("long").alias("n_words"))
    out = base.join(found, ["shard", "nth"], "left")
    none = F.array().cast("array<string>")
    out = out.select("doc_id", "n_words", F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"), *(F.coalesce(c, none).alias(c) for c in ("items", "near")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with their columns; each row is judged by its own text, whatever its id."""
    key = "__text_sha"
    while key in docs.columns:
        key += "_"
    judged = docs.select(F.unhex(F.sha2("text", 256)).alias("doc_id"), "text")
    bad = decontaminate(judged, benchmark, window).filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.unhex(F.sha2("text", 256))).join(bad, key, "left_anti").select(docs.columns)
