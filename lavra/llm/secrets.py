"""Secret scans: patterns plus sliding-window Shannon entropy over candidate strings.

Three patterns (assignments to secret-like names, access keys, long hex strings)
give the base spans. The entropy scan adds spans of its own: a window slides over
long unbroken strings, and for every character class (hex, base36, letters,
base64) that holds all of the window's characters, its Shannon entropy is held
against what the class needs. Counts, of characters and of each class, are updated
by one character in and one out. An allow-list suppresses harmless strings (UUIDs,
digests announced as such, paths, placeholders).

Defined results: null and empty texts have no spans; very long texts and strings
are scanned whole; ties, repeated rows and rows without doc_id are scanned alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lavra.llm import text as tx

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
#: Parts of which one stands in every assignment; a cheap test before the pattern.
HINTS = ("passw", "secret", "token", "api")

#: Entropy scan: shortest candidate, window, and bits per character needed for each class, narrow classes first.
CANDIDATE_MIN, WINDOW = 20, 20
NEEDED = {"hex": 3.0, "base36": 3.7, "letters": 4.1, "base64": 3.9}
#: Digits and letters (of each case, for letters alone) that a window needs.
SOME = 2
_DIGITS, _LOWER_CASE, _UPPER_CASE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is counted of a character: hex of either case, digit, lower and upper letter.
_COUNTED = {c: (c in "0123456789abcdef", c in "0123456789ABCDEF", c in _DIGITS, c in _LOWER_CASE, c in _UPPER_CASE) for c in _DIGITS + _LOWER_CASE + _UPPER_CASE}
_NOT_COUNTED = (False,) * 5
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
#: Strings that look random and are no secrets.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"(?i).*(example|sample|placeholder|changeme|dummy|your[_-]).*"),
    re.compile(r"/?([A-Za-z_-]+/)+[A-Za-z_-]*"),
    re.compile(r"[A-Za-z]+([_-][A-Za-z]+)+"),
    re.compile(r"[0-9+/_=-]+"),
)
ALLOWED_BEFORE = re.compile(r"(?i)(sha-?[0-9]*|md5|digest|checksum|etag|commit|integrity)\W{0,3}$")


@functools.cache
def _xlogx(most: int) -> list[float]:
    return [0.0, *(c * math.log2(c) for c in range(1, most + 1))]


def class_peaks(text: str, window: int = WINDOW) -> dict[str, float]:
    """By character class, the highest Shannon entropy (bits per character) of a window that the class holds."""
    size = min(window, len(text))
    peaks: dict[str, float] = {}
    if not size:
        return peaks
    xlogx, whole = _xlogx(size), math.log2(size)
    counts: dict[str, int] = {}
    low_hex = high_hex = digits = lower = upper = 0
    terms = 0.0
    for i, c in enumerate(text):
        if i >= size:  # out before in, so that no count exceeds the window
            old = text[i - size]
            n = counts[old]
            terms += xlogx[n - 1] - xlogx[n]
            counts[old] = n - 1
            a, b, d, x, y = _COUNTED.get(old, _NOT_COUNTED)
            low_hex, high_hex, digits, lower, upper = low_hex - a, high_hex - b, digits - d, lower - x, upper - y
        n = counts.get(c, 0)
        terms += xlogx[n + 1] - xlogx[n]
        counts[c] = n + 1
        a, b, d, x, y = _COUNTED.get(c, _NOT_COUNTED)
        low_hex, high_hex, digits, lower, upper = low_hex + a, high_hex + b, digits + d, lower + x, upper + y
        if i < size - 1:
            continue
        entropy = whole - terms / size
        mixed = digits >= SOME and lower + upper >= SOME
        if mixed and size in (low_hex, high_hex):
            peaks["hex"] = max(peaks.get("hex", 0.0), entropy)
        if mixed and size in (digits + lower, digits + upper):
            peaks["base36"] = max(peaks.get("base36", 0.0), entropy)
        if lower + upper == size and lower >= SOME and upper >= SOME:
            peaks["letters"] = max(peaks.get("letters", 0.0), entropy)
        if mixed:
            peaks["base64"] = max(peaks.get("base64", 0.0), entropy)
    return peaks


def suspicious(candidate: str, before: str = "") -> str | None:
    """The narrowest class whose windows are too random, or None."""
    if any(p.fullmatch(candidate) for p in ALLOWED) or ALLOWED_BEFORE.search(before):
        return None
    peaks = class_peaks(candidate)
    return next((kind for kind, needed in NEEDED.items() if peaks.get(kind, 0.0) >= needed), None)


def _scan(text: str, hexes: list[tuple[int, int]], candidates: list[tuple[int, int]], hinted: bool) -> tuple[list[tuple[int, int, int]], list[str]]:
    """(start, kind number, end) of every span of a document, sorted; the classes of those that the entropy scan added."""
    spans, classes = [], []
    if hinted:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    spans += [(a, 2, b) for a, b in hexes]
    base, i, reach = sorted(spans), 0, -1
    for a, b in candidates:  # in the order of their starts, as are the base spans; one of these holds a candidate if it reaches that far
        while i < len(base) and base[i][0] <= a:
            reach, i = max(reach, base[i][2]), i + 1
        if b > reach and (kind := suspicious(text[a:b], text[max(0, a - 16) : a])):
            spans.append((a, 3, b))
            classes.append(kind)
    return sorted(spans), classes


def _by_document(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in zip(*(x.tolist() for x in found), strict=True):
        out.setdefault(d, []).append((a, b))
    return out


def _characters(raw: bytes, text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets as code points; the spans themselves are ASCII."""
    if len(raw) == len(text):
        return spans
    out, at, chars = [], 0, 0
    for a, b in spans:
        chars += len(raw[at:a].decode())
        out.append((chars, chars + b - a))
        at, chars = b, chars + b - a
    return out


def render(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans as kind:start:end (code points), and the classes of the entropy spans in order."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.blocks(batches):
            data, offsets = tx.utf8(batch.column("text"))
            hexes = _by_document(tx.runs(data, offsets, _HEX, HEX_MIN))
            strings = _by_document(tx.runs(data, offsets, _CANDIDATE, CANDIDATE_MIN))
            raw = data.tobytes()
            low = raw.lower()
            bounds = offsets.tolist()
            hinted = set()
            for hint in HINTS:
                at = low.find(hint.encode())
                while at >= 0:
                    d = int(np.searchsorted(offsets, at, side="right")) - 1
                    hinted.add(d)
                    at = low.find(hint.encode(), bounds[d + 1])
            at = raw.find(b"AKIA")
            while at >= 0:
                d = int(np.searchsorted(offsets, at, side="right")) - 1
                strings.setdefault(d, [])
                at = raw.find(b"AKIA", bounds[d + 1])
            rows = []
            nothing = (0, 0, 0, digest(""), "", "")
            for d in range(batch.num_rows):
                if d not in hinted and d not in hexes and d not in strings:
                    rows.append(nothing)
                    continue
                own = raw[bounds[d] : bounds[d + 1]]
                text = own.decode()
                spans, classes = _scan(text, _characters(own, text, hexes.get(d, [])), _characters(own, text, strings.get(d, [])), d in hinted)
                base = [s for s in spans if s[1] < 3]
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest(render(base, KINDS)), render(spans, KINDS), ",".join(classes)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "entropy_classes"],
            )

    schema = f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, entropy_classes string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
