from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lavra.llm import audit

DOCS = "doc_id long, text string, lang string, source string"


def brute_force(docs, labels):
    """Every filter applied to every part, order by order, straight from the wording."""
    texts = [(i, t or "", s or "") for i, t, _, s in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}

    def fails(name, row):
        i, t, _ = row
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        if name == "A":
            return len(words) < 200
        if name == "B":
            return 100 * len(set(words)) < 50 * len(words)
        if name == "C":
            return 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)
        if name == "D":
            return bool(re.search(r"[#$%&*|]", t))
        return i is not None and any(j is not None and j < i and u == t for j, u, _ in texts)

    failed = [{n for n in audit.FILTERS if fails(n, row)} for row in texts]
    out = {}
    for part in {s for _, _, s in texts}:
        rows = [(i, f) for (i, _, s), f in zip(texts, failed) if s == part]
        shapley = dict.fromkeys(audit.FILTERS, 0)
        for order in itertools.permutations(audit.FILTERS):
            left = rows
            for step, n in enumerate(order, 1):
                gone = [(i, f) for i, f in left if n in f]
                earlier = set(order[: step - 1])
                shapley[n] += len(gone)
                left = [(i, f) for i, f in left if n not in f]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(n in f and bool(f & earlier) for _, f in rows), sum(f == {n} for _, f in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def run(spark, docs, labels, parts=3):
    found = audit.audit(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    rows = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found}
    assert len(rows) == len(found)
    return rows


def corpus():
    rng = random.Random(4)
    words = [w.lower() for w in ("alpha", "beta", "gama", "delta", "casa", "porta")]
    texts = [None, "", "A B C", "x # y", "é\xa0ü\x1c z", "　", "MAIÚSCULAS " * 300, "w|"]
    texts += [" ".join(f"{w}{rng.randrange(k)}" for w in rng.choices(words, k=rng.choice((20, 199, 200, 260)))) for k in (2, 40, 400) for _ in range(6)]
    texts += rng.choices(texts, k=20) + [texts[-1]] * 40
    return [(i, t, "pt", None if i % 4 == 0 else "" if i % 4 == 1 else f"s{i % 3}") for i, t in enumerate(texts)]


def test_audit_equals_brute_force(spark):
    docs = corpus()
    docs += [docs[10], docs[10], (None, docs[10][1], "pt", "s1"), (None, None, None, None)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(0, None, 1), (4, 1, None), (4, 0, None), (None, 1, 1), (10_000, 1, 1)]
    assert run(spark, docs, labels) == brute_force(docs, labels)


def test_collisions_and_small_chains(monkeypatch):
    """Texts of one fingerprint are told apart by their words, and chains that are sent on early lose nothing."""
    rows = list(enumerate(["a", "b", "a", "c", "b", "a", "", ""]))
    for most in (0, 2, 1 << 20):
        for shuffled in (rows, rows[::-1], rows + rows):
            records = sorted(audit._routed(shuffled, lambda text: 7, most), key=lambda x: (x[0][1], x[0]))
            assert {i for i, _ in audit._settled(records)} == {2, 4, 5, 7}


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], DOCS)
    assert audit.audit(empty, none).count() == 0
    docs = spark.createDataFrame([("b", "t", 1), ("a", "t", 1), (None, "t", 1)], "doc_id string, text string, n int").withColumns({c: F.lit("x") for c in ("part", "mask", "good", "spread", "step")})
    found = audit.audit(docs.withColumn("source", F.lit(None).cast("string")), none).filter("filter_order = 'EABCD' and step = 1").collect()
    assert [(r["part"], r["kept"], r["removed"], r["unique_fails"]) for r in found] == [("", 2, 1, 0)]


def test_long_texts_are_read_word_by_word():
    short = "Palavra outra palavra $ " * 100
    long = "Palavra outra palavra $ " * (audit.LONG_BYTES // 20)
    assert len(long) > audit.LONG_BYTES
    assert audit.failures(short) == audit.failures(long)


@pytest.mark.parametrize("n", [199, 200])
def test_bounds(n):
    words = [f"w{i}" for i in range(n)]
    assert bool(audit.failures(" ".join(words)) & 1) == (n < 200)
    text = "A" * n + "b" * (49 * n)
    assert not audit.failures(text) & 4 and audit.failures(text[:-1]) & 4
