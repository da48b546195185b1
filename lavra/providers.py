"""Model providers as plug-ins, with failover, and deterministic ones for offline runs."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooSlow
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

TIMEOUT_S = 120.0


class TextProvider(Protocol):
    """Anything that answers a prompt. Network providers live outside this package."""

    name: str

    def generate(self, system: str, user: str) -> str: ...


class VectorProvider(Protocol):
    name: str

    def embed(self, text: str) -> list[float]: ...


class ProviderError(RuntimeError):
    """No provider answered; the message lists why."""


class Failover:
    """The first provider that answers in time."""

    def __init__(self, providers: list[TextProvider], timeout: float = TIMEOUT_S):
        self.name, self.providers, self.timeout = "failover", providers, timeout

    def generate(self, system: str, user: str) -> str:
        reasons = []
        for p in self.providers:
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(p.generate, system, user).result(self.timeout)
            except TooSlow:
                reasons.append(f"{p.name}: no answer in {self.timeout} s")
            except Exception as e:
                reasons.append(f"{p.name}: {e}")
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        raise ProviderError("; ".join(reasons) or "no providers")


class HashingEmbedder:
    """Vectors from word hashes: offline, the same everywhere."""

    name = "hashing"

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, text: str) -> list[float]:
        out = [0.0] * self.width
        for word in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            out[h % self.width] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out


class EchoAnswers:
    """Answers that cite the first source of the prompt, or refuse without one."""

    name = "echo"

    def generate(self, system: str, user: str) -> str:
        found = re.search(r"\[1\] tipo=(\S+) \| reference=(.*)", user)
        if not found:
            return json.dumps({"refused": True, "reason": "sem-fonte"})
        citation = {"type": found[1], "reference": found[2], "title": "", "snippet": ""}
        return json.dumps({"refused": False, "answer": f"Conforme {found[2]}.", "grounded": True, "confidence": 0.5, "citations": [citation]}, ensure_ascii=False)


class UnsureAnswers(EchoAnswers):
    """As EchoAnswers, but fails for conversations, named by the system's text, that 5 divides."""

    name = "unsure"

    def generate(self, system: str, user: str) -> str:
        if int(re.search(r"Conversa: (\d+)", system)[1]) % 5 == 0:
            raise RuntimeError("sem resposta")
        return super().generate(system, user)


class RuleAnalyst:
    """An offline analyst whose answers and failures follow from an item's number `a-b` and the agent's place: a test of whole runs.

    n is a + b + place. A call fails if 7 divides n, and in the first attempt also if 5 does. It finds n % 3 problems; the
    second lacks its suggestion where b is even. Answers are plain, fenced or within a sentence, by n % 4, or no JSON.
    """

    name = "rules"
    SEVERITIES = ("critico", "ALTO", "medio", "nenhuma")

    def __init__(self, attempt: int = 1):
        self.attempt = attempt

    def generate(self, system: str, user: str) -> str:
        agent = re.match(r"Agente: (\w+)", system)[1]
        a, b = map(int, re.search(r"Item: (\d+)-(\d+)", user).groups())
        place = ("juridico", "tecnico", "redacao", "estrutural", "geral").index(agent)
        n = a + b + place
        if n % 7 == 0 or (self.attempt == 1 and n % 5 == 0):
            raise RuntimeError(f"quota {n}")
        found = [
            {"category": "outra", "severity": self.SEVERITIES[(n + j) % 4], "problem": f"Problema {(a + j) % 5}", "original_text": f" Trecho {b % 3}", "suggested_text": "" if j == 1 and b % 2 == 0 else f"novo {n}", "justification": "j"}
            for j in range(n % 3)
        ]
        text = json.dumps(found, ensure_ascii=False)
        return (text, f"```json\n{text}\n```", f"Segue: {text} fim", text)[n % 4] if n % 11 else "nada a declarar"


class RuleReviewer:
    """An offline reviewer whose answer's shape follows from the item's number `a-b`: wrapped, a list, other things, or a failure."""

    name = "rules"

    def generate(self, system: str, user: str) -> str:
        a, b = map(int, re.search(r"Item: (\d+)-(\d+)", user).groups())
        one = {"correction_index": 0, "status": "REJEITADA" if b % 2 else "aprovada", "note": f"nota {a}"}
        two = {"correction_index": "1", "status": "ajustada", "adjusted_suggested_text": f" ajuste {b} ", "adjusted_justification": "  "}
        far = {"correction_index": 99, "status": "talvez"}
        shapes = (
            {"review": [one, two]}, [one, "texto", 5], {"review": "nada"}, [two, far], {"outra": []}, None,
        )
        shape = shapes[(a + b) % 6]
        if shape is None:
            raise RuntimeError("sem resposta")
        text = json.dumps(shape, ensure_ascii=False)
        return f"```json\n{text}\n```" if a % 2 else text


class RuleScorer:
    """An offline scorer: by the number of findings it fails, answers a list, zero, no JSON, or an object."""

    name = "rules"

    def generate(self, system: str, user: str) -> str:
        n = int(re.search(r"Correções: (\d+)", user)[1])
        if n % 5 == 0:
            raise RuntimeError("sem resposta")
        scores = {"score_overall": 0 if n % 5 == 2 else 7.5, "score_juridical": 8, "score_technical": 7, "score_writing": 6.5, "score_structural": 8.5, "risk_level": "medio", "final_opinion": f"{n} achados"}
        return "nada" if n % 5 == 3 else json.dumps([scores] if n % 5 == 1 else scores)


class RuleDrafter:
    """An offline drafter whose answer's shape follows from the request's number: a failure, sections, sections in a fence, none, a list, or no JSON."""

    name = "rules"

    def generate(self, system: str, user: str) -> str:
        n, sources = int(re.search(r"Pedido: (\d+)", user)[1]), len(re.findall(r"(?m)^\[", user))
        if n % 6 == 0:
            raise RuntimeError("sem resposta")
        text = json.dumps({"secoes": [{"item_number": "A.1", "title": "DO OBJETO", "content": f"Texto {n} de {sources} fontes"}, {"content": "linha"}]}, ensure_ascii=False)
        return (text, f"```json\n{text}\n```", '{"secoes": []}', "[1, 2]", "nada a redigir")[n % 6 - 1]


def generate(prompts: DataFrame, key: str | list[str], make: Callable[[], TextProvider]) -> DataFrame:
    """(key, ok, answer, error) of prompts (key, system, user); a provider is made once per task, and a failed prompt is a row."""
    keys = [key] if isinstance(key, str) else list(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for batch in batches:
            rows = []
            for system, user in zip(batch.column("system").to_pylist(), batch.column("user").to_pylist(), strict=True):
                try:
                    rows.append((True, provider.generate(system, user), None))
                except Exception as e:
                    rows.append((False, None, str(e)))
            found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *found], [*keys, "ok", "answer", "error"])

    named = ", ".join(f"`{k}` {prompts.schema[k].dataType.simpleString()}" for k in keys)
    return prompts.select(*keys, "system", "user").mapInArrow(run, f"{named}, ok boolean, answer string, error string")


def embed(texts: DataFrame, key: str, make: Callable[[], VectorProvider], text: str = "text") -> DataFrame:
    """(key, embedding) of texts; equal texts of a batch are embedded once, failures are left out to be tried again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            known: dict[str, list[float] | None] = {}
            for t in batch[text].dropna().unique():
                try:
                    known[t] = provider.embed(t)
                except Exception:
                    known[t] = None
            vectors = batch[text].map(lambda t, known=known: known.get(t))
            done = vectors.map(lambda v: v is not None)
            yield pd.DataFrame({key: batch[key][done], "embedding": vectors[done]})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
