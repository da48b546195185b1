"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are reported whatever their score. Further
kinds (iban by mod-97, cpf and cnpj by mod-11, ssn by context) are reported
when their score reaches the threshold.

Defined results: null and empty texts have no spans; very long texts are scanned
whole; repeated rows and rows without doc_id are scanned alike; spans of one
start are ordered by kind; an empty table gives an empty result; other columns
pass through `redact` and are ignored by `scan`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm import text as tx
from lavra.llm.secrets import digest, render

KINDS = ("email", "ip", "card", "phone", "iban", "cpf", "cnpj", "ssn")
N_BASE = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match ends with a whole run of digits, so only the first digit of a run can start one.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CPF = re.compile(r"(?<![0-9])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9])")
CNPJ = re.compile(r"(?<![0-9])[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score of a confirmed span by kind, and what context adds.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "cpf": 0.7, "cnpj": 0.7, "ssn": 0.3}
FOR, AGAINST, WIDTH, THRESHOLD = 0.3, -0.3, 48, 0.5
#: Whole words near a span that speak for or against its kind.
CONTEXT = {
    "email": r"e-?mails?|mail|contact|write to|reach",
    "ip": r"ip|ips|ip address|address|addresses|host|server|login",
    "card": r"card|cards|visa|mastercard|credit|payment|expir\w*",
    "phone": r"phone|telephone|tel|telefone?|call|mobile|fax|whatsapp",
    "iban": r"iban|account|bank|konto|transfer",
    "cpf": r"cpf|cadastro",
    "cnpj": r"cnpj|empresa",
    "ssn": r"ssn|social security",
}
AGAINST_WORDS = r"version|release|isbn|serial|example|invoice no|part no"
_FOR = {kind: re.compile(rf"(?<!\w)(?:{words})(?!\w)") for kind, words in CONTEXT.items()}
_AGAINST = re.compile(rf"(?<!\w)(?:{AGAINST_WORDS})(?!\w)")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def mod11(digits: str, checks: int = 2) -> bool:
    """Brazilian check digits: weights 2, 3, ... from the right, restarting after 9 for company numbers."""
    if len(set(digits)) == 1:
        return False
    top = 9 if len(digits) == 14 else 11
    for n in range(len(digits) - checks, len(digits)):
        total = sum(int(c) * (2 + i % (top - 1)) for i, c in enumerate(reversed(digits[:n])))
        rest = total % 11
        if int(digits[n]) != (0 if rest < 2 else 11 - rest):
            return False
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@domain`, leftmost and non-overlapping, in time linear in the text."""
    at, free = text.find("@"), 0
    while at >= 0:
        right = DOMAIN.match(text, at + 1)
        if right:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, right.end()
                free = right.end()
        at = text.find("@", max(at + 1, free))


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposed(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of spans whose checks hold."""
    for a, b in _emails(text):
        yield a, 0, b
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.start(), 1, m.end()
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(digits := _only_digits(m[0])) <= 19 and luhn(digits):
            yield m.start(), 2, m.end()
    for m in PHONE.finditer(text):
        if 10 <= len(_only_digits(m[0])) <= 15:
            yield m.start(), 3, m.end()
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield m.start(), 4, m.end()
    for kind, pattern in ((5, CPF), (6, CNPJ)):
        for m in pattern.finditer(text):
            if mod11(_only_digits(m[0])):
                yield m.start(), kind, m.end()
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.start(), 7, m.end()


def find(text: str) -> list[Span]:
    """Spans of a text by start, then kind. Base kinds stay; others need the threshold."""
    out = []
    for start, kind, end in _proposed(text):
        name = KINDS[kind]
        near = (text[max(0, start - WIDTH) : start] + " " + text[end : end + WIDTH // 2]).lower()
        score = SCORE[name] + FOR * bool(_FOR[name].search(near)) + AGAINST * bool(_AGAINST.search(near))
        score = min(1.0, max(0.0, score))
        if kind < N_BASE or score >= THRESHOLD:
            out.append(Span(start, kind, end, score))
    return sorted(out)


_DIGITS = np.zeros(256, bool)
_DIGITS[list(b"0123456789@")] = True


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans (kind:start:end, code points) and the highest score."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (0, 0, 0, 0, digest(""), "", 0.0)
        for batch in tx.blocks(batches):
            data, offsets = tx.utf8(batch.column("text"))
            maybe = tx.documents_with(data, offsets, _DIGITS)  # every kind holds a digit or an @
            raw, bounds = data.tobytes(), offsets.tolist()
            rows = []
            for d in range(batch.num_rows):
                spans = find(raw[bounds[d] : bounds[d + 1]].decode()) if maybe[d] else []
                if not spans:
                    rows.append(nothing)
                    continue
                kinds = [s.kind for s in spans]
                base = render([s[:3] for s in spans if s.kind < N_BASE], KINDS)
                rows.append((*(kinds.count(k) for k in range(N_BASE)), digest(base), render([s[:3] for s in spans], KINDS), max(s.score for s in spans)))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "top_score"]
    schema = f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans share the first one's mark."""
    out, at = [], 0
    for start, kind, end, _ in find(text):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their personal data masked; n_chars, where there is one, follows the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.blocks(batches):
            column = batch.column("text")
            data, offsets = tx.utf8(column)
            maybe = tx.documents_with(data, offsets, _DIGITS)
            texts = [mask(t) if m and t is not None else t for t, m in zip(column.to_pylist(), maybe.tolist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), pa.field("text", column.type), pa.array(texts, column.type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out
