"""Ranked lexical search by block-max pruning.

The documents are stored in blocks, ranges of the table as it is read. A block
holds its documents' forward index (terms with their counts, document by
document) and, for each of its terms, how many documents hold it and the most
that it adds to any document's score. A query's bound on a block is the sum of
these maxima over its terms, weighted. The blocks with the highest bounds of a
query are scored first, which gives the score that a document needs; every task
then takes its blocks in the order of their bounds and scores them until the
bound drops below that score or below its own, whichever is higher. Bounds and
scores are whole numbers, so what is left out can't be among the best.

The index holds all documents and all terms, and isn't tied to any queries.
Queries are sent in parts of a fixed number of terms; a part's work on a block
grows with its queries, so what is read of the index again for the next part is
small beside it.

Defined results: a null or empty text holds no terms, counts in no average and is
never found; very long texts are blocks of their own; of equal scores the smaller
id comes first, a missing id before all; repeated rows are documents each; a row
of queries is a query, and one that is null or has no terms has no results;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from lavra.llm import shared
from lavra.llm import text as tx

#: Results of a query by default.
TOP = 20
#: Fixed values of the score: scale of weights and of shares, weight of a count and of a length, and the length's part in percent.
WEIGHT, SHARE, COUNT, LENGTH, PART = 1000, 1_000_000_000, 1000, 12, 25
#: Documents of a block at most; its text has tx.BLOCK_BYTES at most, unless one document has more.
BLOCK_DOCS = 512
#: Terms of the queries that are searched together, repeats included.
PART_TERMS = 1 << 18
#: Blocks whose bounds a task sorts at a time.
TOGETHER = 32
#: Blocks of each query that are scored first, to learn what score is needed.
FIRST = 2


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's count adds to a document's score, before the term's weight."""
    return SHARE * tf // (COUNT * tf + LENGTH * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each term's document, each term's number, and the distinct terms as strings."""
    data, offsets = tx.utf8(texts)
    found = tx.Words(data, offsets, tx.ALNUM, hashes=False)
    ends = np.zeros(len(found.start) + 1, np.int64)
    np.cumsum(found.end - found.start, out=ends[1:])
    letters = tx.lowered(data[tx.ALNUM[data]])
    words = pa.Array.from_buffers(pa.large_string(), len(found.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    return np.repeat(np.arange(len(texts)), found.counts()), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def _each(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows' values of these columns, one row at a time."""
    columns = [batch.column(n) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, after one byte that tells how many."""
    most = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _joined(terms: pa.Array) -> tuple[bytes, np.ndarray]:
    data, offsets = tx.utf8(terms)
    return data.tobytes(), np.diff(offsets)


def _strings(letters: bytes, cuts: bytes) -> pa.Array:
    offsets = np.cumsum(np.append(0, _unpacked(cuts))).astype("<i4")
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])


class LengthWeight:
    """What a document's length weighs in its scores."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, max(1, n_terms)

    def __call__(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - PART + (PART * lengths * self.n_docs) // self.n_terms


def totals(docs: DataFrame) -> tuple[int, int]:
    """How many documents have terms, and how many terms they have in all. Only two sums reach the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for some in tx.blocks(batches):
            found = tx.words(some.column("text"), tx.ALNUM, hashes=False).counts()
            n, terms = n + int((found > 0).sum()), terms + int(found.sum())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "terms": pa.array([terms], pa.int64())})

    total = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return total["n"] or 0, total["terms"] or 0


def blocks(docs: DataFrame, index_weight: LengthWeight, most: int = BLOCK_DOCS) -> DataFrame:
    """(block, ids, lengths, letters, cuts, df, ends, term, tf, most): the forward index of each range of documents, in the order of their ids.

    The block's terms stand one after the other in `letters`, each as long as its entry of `cuts`; `most` has the most that each
    adds to a document's score. A document's entries of `term`, which are places among these terms, and `tf` end at its entry of
    `ends`. All but ids and letters are packed numbers.
    """
    kind = docs.schema["doc_id"].dataType
    names = ["lengths", "letters", "cuts", "df", "ends", "term", "tf", "most"]
    schema = StructType([StructField("ids", ArrayType(kind)), *(StructField(n, BinaryType()) for n in names)])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in tx.blocks(batches):
            for begin in range(0, some.num_rows, most):
                own = some.slice(begin, most)
                own = own.take(pc.sort_indices(own.column("doc_id"), null_placement="at_start"))
                doc, number, terms = _terms(own.column("text"))
                lengths = np.bincount(doc, minlength=own.num_rows)
                pair, tf = np.unique(doc * max(1, len(terms)) + number, return_counts=True)
                holder, term = np.divmod(pair, max(1, len(terms)))
                letters, cuts = _joined(terms)
                highest = np.zeros(len(terms), np.int64)
                np.maximum.at(highest, term, share(tf, index_weight(lengths)[holder]))
                numbers = [cuts, np.bincount(term, minlength=len(terms)), np.cumsum(np.bincount(holder, minlength=own.num_rows)), term, tf, highest]
                columns = [_packed(lengths), letters, *(_packed(x) for x in numbers)]
                ids = pa.array([own.column("doc_id").to_pylist()], pa.list_(own.schema.field("doc_id").type))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in columns)], ["ids", *names])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(built, schema)
    return rows.withColumn("block", F.monotonically_increasing_id())


@dataclass
class Index:
    """A stored index of n_docs documents with n_terms terms in all: the forward blocks with the maxima of their terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> Index:
    """The index of all documents, whose texts are read twice: to count them, as the maxima depend on it, and to write each block once."""
    n_docs, n_terms = totals(docs)
    whole, _ = shared.store(blocks(docs, LengthWeight(n_docs, n_terms), block_docs), "ranked-blocks")
    return Index(whole, n_docs, n_terms)


class Part:
    """Some queries: their distinct terms, and for each query the places and weights of its own."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.keys = [k for k, _ in rows]
        self.terms = sorted({t for _, terms in rows for t in terms})
        place = {t: i for i, t in enumerate(self.terms)}
        self.own, self.counts = [], []
        for _, terms in rows:
            at, n = np.unique(np.array([place[t] for t in terms], np.int64), return_counts=True)
            self.own.append(at)
            self.counts.append(n)
        self.ends = np.cumsum([len(x) for x in self.own])
        self.flat = np.concatenate(self.own)
        self.weights = np.zeros(len(self.flat), np.int64)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        by_term = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        self.weights = by_term[self.flat] * np.concatenate(self.counts)

    def places(self, terms: pa.Array) -> np.ndarray:
        """For each term of the part its place among a block's terms; -1 where the block hasn't got it."""
        return pc.fill_null(pc.index_in(self._array(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _array(self) -> pa.Array:
        if not hasattr(self, "_strings"):
            self._strings = pa.array(self.terms, pa.string())
        return self._strings

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_strings"}

    def bounds(self, places: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The most that any document of the block can score, by query."""
        here = np.where(places >= 0, np.append(most, 0)[places], 0)
        return np.add.reduceat(self.weights * here[self.flat], np.append(0, self.ends[:-1]))


class Block:
    """A block's documents, scored for one query after the other."""

    def __init__(self, batch: pa.RecordBatch, i: int, part: Part, places: np.ndarray, index_weight: LengthWeight):
        lengths, ends, term, tf, cuts = (_unpacked(batch.column(c)[i].as_py()) for c in ("lengths", "ends", "term", "tf", "cuts"))
        self.ids, self.n = batch.column("ids")[i].values, len(lengths)
        doc = np.repeat(np.arange(self.n), np.diff(ends, prepend=0))
        back = np.full(len(cuts), -1, np.int64)
        back[places[places >= 0]] = np.flatnonzero(places >= 0)
        asked = back[term] if len(term) else term
        keep = np.flatnonzero(asked >= 0)
        keep = keep[np.argsort(asked[keep], kind="stable")]
        self.doc, self.share = doc[keep], share(tf[keep], index_weight(lengths)[doc[keep]])
        self.first = np.searchsorted(asked[keep], np.arange(len(part.terms) + 1))

    def best(self, own: np.ndarray, weights: np.ndarray, least: int, top: int) -> list[tuple[int, int]]:
        """(score, document) of the best documents that score `least` at least; of equal ones the first."""
        n = self.first[own + 1] - self.first[own]
        at = np.repeat(self.first[own] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        scores = np.zeros(self.n, np.int64)
        np.add.at(scores, self.doc[at], self.share[at] * np.repeat(weights, n))
        found = np.flatnonzero(scores >= max(1, least))
        order = found[np.argsort(-scores[found], kind="stable")[:top]]
        return list(zip(scores[order].tolist(), order.tolist(), strict=True))


def _rank(x: tuple) -> tuple:
    """Sorts (score, doc_id) with the best last: higher scores, then smaller ids, a missing one first."""
    score, doc_id = x
    return -score, doc_id is not None, doc_id if doc_id is not None else 0


def _parts(queries: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The queries with their terms in parts of bounded size, one part at a time at the driver."""
    rows, n = [], 0
    for r in queries.toLocalIterator():
        rows.append(r)
        n += len(r["terms"])
        if n >= most:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


def query_terms(queries: DataFrame, query_key: str, text: str) -> DataFrame:
    """(key, terms) of every query that has terms; a term comes as often as in the text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, number, terms = _terms(batch.column("text"))
            words = np.array([*terms.to_pylist(), None], object)[number]
            listed = [words[a:b].tolist() for a, b in zip(np.searchsorted(doc, np.arange(batch.num_rows)), np.searchsorted(doc, np.arange(batch.num_rows), "right"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(listed, pa.list_(pa.string()))], ["key", "terms"])

    schema = StructType([StructField("key", queries.schema[query_key].dataType), StructField("terms", ArrayType(StringType()))])
    return queries.select(F.col(query_key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(split, schema).filter(F.size("terms") > 0)


def _frequencies(index: Index, part: Part) -> np.ndarray:
    """How many documents hold each term of the part."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(part.terms), np.int64)
        for batch in batches:
            for letters, cuts, n in _each(batch, "letters", "cuts", "df"):
                places = part.places(_strings(letters, cuts))
                there = places >= 0
                df[there] += _unpacked(n)[places[there]]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(held, pa.int64()), "df": pa.array(df[held], pa.int64())})

    summed = index.blocks.select("letters", "cuts", "df").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(len(part.terms), np.int64)
    for r in summed.collect():  # at most a row for each term of the part
        df[r["term"]] = r["df"]
    return df


def _needed(index: Index, part: Part, top: int) -> np.ndarray:
    """For each query a score that its last result has at least: the top-th of the blocks with its highest bounds."""

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in part.keys]
        for batch in batches:
            for block, letters, cuts, most in _each(batch, "block", "letters", "cuts", "most"):
                bounds = part.bounds(part.places(_strings(letters, cuts)), _unpacked(most))
                for q in np.flatnonzero(bounds).tolist():
                    heapq.heappush(best[q], (int(bounds[q]), block))
                    if len(best[q]) > FIRST:
                        heapq.heappop(best[q])
        rows = [(q, bound, block) for q, some in enumerate(best) for bound, block in some]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["query", "bound", "block"])

    bounds = index.blocks.select("block", "letters", "cuts", "most").mapInArrow(highest, "query long, bound long, block long")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    first = bounds.withColumn("nth", order).filter(F.col("nth") <= FIRST).groupBy("block").agg(F.collect_list("query").alias("queries"))
    chosen = index.blocks.join(F.broadcast(first), "block")  # FIRST rows for each query of the part at most
    scored = chosen.mapInArrow(_scorer(index, part, None, top), "query long, score long")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    least = np.zeros(len(part.keys), np.int64)
    for r in scored.withColumn("nth", nth).filter(F.col("nth") == top).collect():  # a row for each query of the part at most
        least[r["query"]] = r["score"]
    return least


def _scorer(index: Index, part: Part, least: np.ndarray | None, top: int):
    """Scores the blocks of a task: those named in `queries`, or all as far as their bounds ask for it."""
    index_weight = LengthWeight(index.n_docs, index.n_terms)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (queries, letters, cuts) in enumerate(_each(batch, "queries", "letters", "cuts")):
                block = Block(batch, i, part, part.places(_strings(letters, cuts)), index_weight)
                found = [(q, score) for q in queries for score, _ in block.best(part.own[q], _weights(part, q), 1, top)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(2)], ["query", "score"])

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in part.keys]
        needed = least.copy()
        kind = None
        for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
            kind = batch.schema.field("ids").type.value_type
            places, bounds = [], np.zeros((batch.num_rows, len(part.keys)), np.int64)
            for i, (letters, cuts, most) in enumerate(_each(batch, "letters", "cuts", "most")):
                places.append(part.places(_strings(letters, cuts)))
                bounds[i] = part.bounds(places[i], _unpacked(most))
            built: dict[int, Block] = {}
            for q in range(len(part.keys)):
                for i in np.argsort(-bounds[:, q], kind="stable").tolist():
                    if bounds[i, q] < max(1, needed[q]):
                        break
                    if i not in built:
                        built[i] = Block(batch, i, part, places[i], index_weight)
                    found = built[i].best(part.own[q], _weights(part, q), int(needed[q]), top)
                    if found:
                        best[q] = sorted([*best[q], *((s, built[i].ids[d].as_py()) for s, d in found)], key=_rank)[:top]
                        if len(best[q]) == top:
                            needed[q] = max(needed[q], best[q][-1][0])
        if kind is not None:
            flat = [(q, score, doc_id) for q, some in enumerate(best) for score, doc_id in some]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.int64(), pa.int64(), kind))], ["query", "score", "doc_id"])

    return named if least is None else pruned


def _weights(part: Part, q: int) -> np.ndarray:
    end = part.ends[q]
    return part.weights[end - len(part.own[q]) : end]


def search(index: Index, queries: DataFrame, query_key: str = "item_id", text: str = "text", top: int = TOP, part_terms: int = PART_TERMS) -> DataFrame:
    """(query_key, rank, doc_id, score): the `top` documents with the highest scores above 0 of every query."""
    spark = queries.sparkSession
    id_type = index.blocks.schema["ids"].dataType.elementType
    key_type = queries.schema[query_key].dataType
    shown = StructType([StructField(query_key, key_type), StructField("rank", LongType()), StructField("doc_id", id_type), StructField("score", LongType())])
    out = spark.createDataFrame([], shown).withColumn("rank", F.col("rank").cast("int"))
    if not index.n_terms:
        return out
    for rows in _parts(query_terms(queries, query_key, text), part_terms):
        part = Part([(i, r["terms"]) for i, r in enumerate(rows)])
        part.weigh(index.n_docs, _frequencies(index, part))
        least = _needed(index, part, top)
        scored = index.blocks.mapInArrow(_scorer(index, part, least, top), StructType([StructField("query", LongType()), StructField("score", LongType()), StructField("doc_id", id_type)]))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
        keys = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(rows)], StructType([StructField("query", LongType()), StructField(query_key, key_type)]))
        ranked = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
        out = out.unionByName(ranked.join(F.broadcast(keys), "query").select(query_key, "rank", "doc_id", "score"))  # a row for each query of the part
    return out


def rank(docs: DataFrame, queries: DataFrame, query_key: str = "item_id", top: int = TOP) -> DataFrame:
    """`search` over an index of these documents alone."""
    return search(build(docs), queries, query_key, top=top)
