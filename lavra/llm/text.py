"""Arrow helpers of the text operators: bounded blocks, word hashes and byte runs.

A text column arrives in Arrow batches. Everything here works on the UTF-8
bytes of a block of documents at once, so that no Python code runs per word.
Bytes of 0x80 and above belong to non-ASCII characters; all separators the
operators use are ASCII, hence byte-level and character-level words agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one block holds at most, unless a single document is longer.
BLOCK_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_MASK64 = (1 << 64) - 1
#: Bytes of a word that are hashed eight at a time; longer words go through BLAKE2b.
_LANES_UP_TO = 64
#: Masks of the first 0 to 8 bytes of a lane.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _byte_set(chars: str) -> np.ndarray:
    lut = np.zeros(256, dtype=bool)
    lut[[ord(c) for c in chars]] = True
    return lut


#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_low:_high] = True
#: Word bytes of `[^\x20\x09-\x0D]+`.
NONBLANK = ~_byte_set(" \t\n\v\f\r")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_ranges(data: np.ndarray, eight: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges. Each lane goes through a full mix, so no pattern of bytes cancels out.

    Different ranges may still collide by chance; who needs exactness compares the bytes.
    """
    h = mix64(size.astype(np.uint64) * np.uint64(_MULT) + np.uint64(0x2545F4914F6CDD1D))
    long = size > _LANES_UP_TO
    at, left, which = start, np.where(long, 0, size), None
    while True:
        some = np.flatnonzero(left > 0)
        if not len(some):
            break
        which = some if which is None else which[some]
        at, left = at[some], left[some]
        h[which] = mix64(h[which] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        at, left = at + 8, left - 8
    if long.any():
        raw = data.tobytes()
        which = np.flatnonzero(long)
        digests = b"".join(hashlib.blake2b(raw[a : a + n], digest_size=8).digest() for a, n in zip(start[which].tolist(), size[which].tolist(), strict=True))
        h[which] = np.frombuffer(digests, "<u8")
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and document offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole documents with at most `limit` bytes of text (a longer document stands alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """Words of a block: byte bounds, 64-bit hashes, and `first[d]`..`first[d + 1]` for document d."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, hashes: bool = True):
        inside = letters[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        begins[cuts] = inside[cuts]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        before = cuts[cuts > 0] - 1
        stops[before] = inside[before]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashes:
            low = _LOWER[data]
            self._eight = lanes(low)
            self.hash = hash_ranges(low, self._eight, self.start, self.end - self.start)

    def beginnings(self, which: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first n bytes of these words, which must be as long; n is 8 at most."""
        return mix64(self._eight[self.start[which]] & _FIRST[n] ^ np.uint64(n * _MULT & _MASK64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array, letters: np.ndarray, hashes: bool = True) -> Words:
    return Words(*utf8(column), letters, hashes)


def hash_words(texts: list[str], letters: np.ndarray) -> list[np.ndarray]:
    """Word hashes of a few texts, the same as those of a block."""
    found = words(pa.array(texts, pa.string()), letters)
    return [found.hash[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]


def shingles(found: Words, k: int = 3) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; fewer words make one shingle of all."""
    h = found.hash
    mixed = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        mixed += h[j : len(mixed) + j] * np.uint64((_MULT * (2 * j + 1)) & _MASK64)
    mixed = mix64(mixed)
    out = []
    for a, b in zip(found.first[:-1], found.first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(mixed[a : b - k + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = mix64(np.array([short]) * np.uint64(_MULT) + x)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def runs(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, at_least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last byte (exclusive, within the document) of maximal runs of `letters`."""
    found = Words(data, offsets, letters, hashes=False)
    long = found.end - found.start >= at_least
    start, end = found.start[long], found.end[long]
    doc = np.searchsorted(offsets, start, side="right") - 1
    return doc, start - offsets[doc], end - offsets[doc]


def documents_with(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """For each document, whether it holds any of these bytes."""
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(letters[data], out=total[1:])
    return total[offsets[1:]] > total[offsets[:-1]]
