"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenised in place and cut only where they are longer than a
sequence. Packing needs no more of them than how many pieces there are of each
length, at most as many numbers as a sequence has tokens: a bin is filled
greedily with the longest pieces that still fit, then its smallest piece is
replaced by the two unpacked pieces that fill its gap, widened by that piece,
most tightly. Bins that come out alike are made in one step, so the plan's size
depends on the number of lengths and not on that of documents. Each piece then
finds its place by its number among those of its length, counted within the
slice that tokenised it and carried on over the slices by a window; no length,
however common, meets in one task.

Defined results: a null or empty text is the end token alone; text that spells a
special token is ordinary text; a very long text is tokenised stretch by stretch,
cut at blanks where the pattern of words breaks anyway; ties and repeated rows
are pieces like all others; rows without doc_id are packed too; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from lavra.llm import shared
from lavra.llm import text as tx

#: Tokens of a sequence, and the token that ends a document.
ROOM, END = 1024, 2
#: Longer texts are tokenised in stretches of about so many characters.
STRETCH = 1 << 20
#: Distinct words whose tokens a worker remembers.
REMEMBERED = 600_000
#: A blank between two characters that aren't: the tokeniser's pattern always breaks before it.
_SAFE = re.compile(r"(?<=\S)[ \n](?=\S)")


def _classes() -> tuple[str, str, str]:
    """Characters below U+0250 by the classes of the tokeniser's pattern: letters, numbers and blanks."""
    low = [chr(c) for c in range(0x250)]
    of = lambda kind: "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == kind)
    return of("L"), of("N"), r"\t-\r \x85\xa0"


def _spelling() -> dict[int, int]:
    """The character that stands for each byte in the vocabulary: itself if it prints, else the next one from U+0100 on."""
    own = [b for b in range(256) if 0x20 < b < 0x7F or b > 0xA0 and b != 0xAD]
    return {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in own)}


class _Words(dict):
    """The numbers of distinct words; `ids` up to `ends[n]`, from the end before on, are those of word n."""

    def __init__(self, model):
        self._model, self._spelling = model, _spelling()
        self.ids, self.ends = array("I"), array("q", [0])

    def __missing__(self, word: str) -> int:
        self.ids.extend(t.id for t in self._model.tokenize(word.encode().decode("latin-1").translate(self._spelling)))
        self.ends.append(len(self.ids))
        self[word] = len(self)
        return len(self) - 1

    def large(self) -> bool:
        return len(self) > REMEMBERED or len(self.ids) > 8 * REMEMBERED


class Tokens:
    """Token ids of texts.

    The tokeniser works on words apart from each other, so its model is asked once for each distinct word. The words
    are remembered from batch to batch and from task to task of a worker, and forgotten when they are too many.
    """

    def __init__(self, path: str):
        self._all = Tokenizer.from_file(path)
        self._all.encode_special_tokens = True  # their spelling in a text is ordinary text
        letters, numbers, blanks = _classes()
        self._words = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")
        self._other = re.compile(r"[^\x00-\u024f]")  # classes of rarer characters are left to the tokeniser
        self._seen = _Words(self._all.model)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        out, words, ends = [], [], []
        for text in texts:
            if self._other.search(text):
                out.append(np.array(self._all.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                words += self._words.findall(text)
                out.append(None)
                ends.append(len(words))
        at = np.fromiter(map(self._seen.__getitem__, words), np.int64, len(words))
        stops, flat = np.frombuffer(self._seen.ends, np.int64), np.frombuffer(self._seen.ids, np.uint32)
        n = stops[at + 1] - stops[at]
        stop = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(stops[at] - stop[:-1], n) + np.arange(stop[-1])]
        own = iter(np.split(ids, stop[np.array(ends[:-1], np.int64)]) if ends else ())
        del stops, flat
        if self._seen.large():
            self._seen = _Words(self._all.model)
        return [next(own) if x is None else x for x in out]

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, the end token last."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        some, which, n = [], [], 0
        for i, text in enumerate(texts):
            for part in _stretches(text or ""):
                some.append(part)
                which.append(i)
                n += len(part)
                if n >= STRETCH:
                    for k, x in zip(which, self._encoded(some), strict=True):
                        parts[k].append(x)
                    some, which, n = [], [], 0
        for k, x in zip(which, self._encoded(some), strict=True):
            parts[k].append(x)
        return [np.concatenate([*x, np.array([END], np.uint32)]) for x in parts]


def _stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH and (cut := _SAFE.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def bounds(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, but for the first where its length is no multiple."""
    first = (n - 1) % room + 1
    return [(0, first), *((at, room) for at in range(first, n, room))]


def plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for so many pieces of each length: (times, [(length, pieces of it in such a bin)]), longest first."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left)
    found = []

    def two(gap: int, at_least: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Unpacked lengths whose sum is the largest up to the gap and above at_least."""
        free = [n for n in order if n < gap and left[n] > used.get(n, 0)]
        best, pair, i, j = at_least, None, 0, len(free) - 1
        while i <= j:
            total = free[i] + free[j]
            if total > gap:
                j -= 1
                continue
            if total > best and (i < j or left[free[i]] - used.get(free[i], 0) > 1):
                best, pair = total, (free[i], free[j])
                if best == gap:
                    break
            i += 1
        return pair

    while order:
        gap, used, at = room, {}, len(order)
        while at and gap:
            at = bisect.bisect_right(order, gap, 0, at)
            if at:
                n = order[at - 1]
                used[n] = min(left[n], gap // n)
                gap -= n * used[n]
                at -= 1
        if gap and sum(used.values()) > 1:
            smallest = min(used)
            if pair := two(gap + smallest, smallest, used):
                used[smallest] -= 1
                for n in pair:
                    used[n] = used.get(n, 0) + 1
                used = {n: k for n, k in used.items() if k}
        times = min(left[n] // k for n, k in used.items())
        found.append((times, sorted(used.items(), reverse=True)))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                order.pop(bisect.bisect_left(order, n))
    return found


def _places(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length the runs of its pieces, in columns: number of the run's first piece, its first sequence, pieces in a sequence, and their offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for times, parts in bins:
        offset = 0
        for n, k in parts:
            first = seen.get(n, 0)
            rows.setdefault(n, []).append((first, sequence, k, offset))
            seen[n] = first + times * k
            offset += n * k
        sequence += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, slice, nth) and, if asked, the ids: nth numbers a slice's pieces of one length.

    A slice is the task that tokenised the piece. Both belong to the row, so the table must be stored before it is counted.
    """
    names = ["piece", "start", "length", "ids_crc32", "slice", "nth"]
    types = [IntegerType(), LongType(), LongType(), LongType(), IntegerType(), LongType()]
    fields = [docs.schema["doc_id"], *(StructField(n, t) for n, t in zip(names, types, strict=True))]
    schema = StructType(fields + [StructField("ids", ArrayType(IntegerType()))] * ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, here, seen = _tokens(tokenizer), TaskContext.get().partitionId(), {}
        for batch in tx.blocks(batches):
            rows, which, kept = [], [], []
            for i, found in enumerate(tokens.ids(batch.column("text").to_pylist())):
                for piece, (start, n) in enumerate(bounds(len(found), room)):
                    part = found[start : start + n]
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    rows.append((piece, start, n, zlib.crc32(part.astype("<u4").tobytes()), here, nth))
                    which.append(i)
                    if ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(which, pa.int64())), *(pa.array(x, pa.int32() if isinstance(t, IntegerType) else pa.int64()) for x, t in zip(zip(*rows, strict=True), types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * ids, ["doc_id", *names] + ["ids"] * ids)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece, and its ids if asked."""
    cut, _ = shared.store(pieces(docs, tokenizer, room, ids), "pieces")
    by_slice = cut.groupBy("length", "slice").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = shared.checkpoint(by_slice.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `room` rows
    places = _places(plan(counts, room))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                runs = places[n]
                run = runs[np.searchsorted(runs[:, 0], number[own], "right") - 1]
                nth = number[own] - run[:, 0]
                sequence[own] = run[:, 1] + nth // run[:, 2]
                offset[own] = run[:, 3] + nth % run[:, 2] * n
            kept = [batch.column(c) for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [c for c in batch.schema.names if c != "number"] + ["sequence_id", "offset"])

    shown = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    numbered = cut.join(starts.select("length", "slice", "before"), ["length", "slice"]).select(*shown, (F.col("nth") + F.col("before")).alias("number"))
    schema = StructType([*(f for f in numbered.schema.fields if f.name != "number"), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return numbered.mapInArrow(placed, schema)


def sequences(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """(sequence_id, ids, documents) of the packed corpus: a sequence's ids, and the (doc_id, start, offset) of its pieces."""
    packed = pack(docs, tokenizer, room, ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))  # a sequence holds at most `room` pieces
    listed = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    documents = F.transform("parts", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset")))
    return listed.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"), documents.alias("documents"))
