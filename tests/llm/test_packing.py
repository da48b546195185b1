from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lavra.llm import packing
from lavra.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(text, whole=reference()):
    return [*whole.encode(text or "", add_special_tokens=False).ids, packing.END]


OURS = packing.Tokens(PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from("aZé1²½ª '\"'sretvmlld.,!\n\t\r\x0b\x1c\x1f\x85\xa0 ß<|>"), max_size=60)))
def test_ids_equal_the_tokenisers(text):
    assert OURS.ids([text])[0].tolist() == ids_of(text)


def test_words_beyond_the_memory_and_long_texts(monkeypatch):
    rng = random.Random(3)
    texts = ["<|endoftext|> a'sb ''s don'tx", None, "", " ".join(f"w{rng.randrange(900)}{rng.choice(['', ' ', chr(10), '  '])}" for _ in range(3000)), "x" * 5000, "日本 " * 2000]
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing, "STRETCH", 1000)
    ours = packing.Tokens(PATH)
    for some in (texts, texts[::-1], texts[3:4]):
        assert [x.tolist() for x in ours.ids(some)] == [ids_of(t) for t in some]


def one_by_one(sizes, room):
    """Best-two-fit with a list of pieces, a bin at a time."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        chosen = []
        for n in list(left):
            if sum(chosen) + n <= room:
                chosen.append(n)
                left.remove(n)
        if len(chosen) > 1 and sum(chosen) < room:
            low, gap = chosen[-1], room - sum(chosen[:-1])
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if low < a + b <= gap]
            if pairs:
                best = max(x[0] for x in pairs)
                _, a, b = next(x for x in pairs if x[0] == best)
                left.remove(a)
                left.remove(b)
                left = sorted([*left, low], reverse=True)
                chosen[-1:] = [a, b]
        bins.append(chosen)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(0, 3))
def test_plan_packs_every_piece(sizes, repeat):
    sizes = sizes + sizes[:5] * repeat
    bins = packing.plan(Counter(sizes), 40)
    used = Counter()
    for times, parts in bins:
        assert times > 0 and sum(n * k for n, k in parts) <= 40
        for n, k in parts:
            used[n] += times * k
    assert used == Counter(sizes)
    assert abs(sum(t for t, _ in bins) - len(one_by_one(sizes, 40))) <= 1 + len(sizes) // 40


def test_two_replace_the_smallest():
    # Greedy takes 6 and 3, which leaves 1; 2 + 2 fill the four left by the 3 exactly.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(1, [(6, 1), (2, 2)]), (1, [(3, 1)])]
    rng = random.Random(8)
    for _ in range(20):
        sizes = [rng.randint(1, 400) for _ in range(300)]
        n = sum(t for t, _ in packing.plan(Counter(sizes), 1024))
        assert n <= -(-sum(sizes) // 1024) + 1


def test_the_plan_does_not_grow_with_the_corpus():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 50) for n in range(1, 1025)}
    small, large = packing.plan(counts), packing.plan({n: c * 1_000_000 for n, c in counts.items()})
    assert len(large) < 20 * 1024 and len(small) < 20 * 1024
    least = max(sum(n * c for n, c in counts.items()) / 1024, sum(c for n, c in counts.items() if n > 512))  # no two longer halves share a bin
    assert sum(t for t, _ in large) <= 1.01 * 1_000_000 * least


def checked(rows, docs, room):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in docs:
        ids = np.array(ids_of(text), "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for k, r in enumerate(own):
            assert r["start"] == at and (r["length"] == room or k == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(own) > 1) == (len(ids) > room)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= room
    return len(by_sequence)


def test_pack_equals_the_wording(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "é", "the " * 1023, "the " * 3000, "x" * 20_000] + [" ".join(f"palavra{rng.randrange(9)}" for _ in range(rng.randrange(400))) for _ in range(60)] + ["same text"] * 50
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("piece", "length", "nth", "slice", "ids", "offset", "n", "before")})
    found = packing.pack(frame.repartition(5), PATH).collect()
    n = checked(found, docs, packing.ROOM)
    total = sum(len(ids_of(t)) for t in texts)
    assert n <= -(-total // packing.ROOM) + 2
    assert packing.pack(frame.filter("doc_id < 0"), PATH).count() == 0
    odd = spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, "x y")], "doc_id string, text string")
    rows = packing.pack(odd, PATH).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_sequences_hold_the_ids(spark):
    texts = ["um texto curto", "outro " * 30, "mais um texto " * 20]
    found = packing.sequences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, room=64).collect()
    back = {}
    for r in found:
        assert len(r["ids"]) <= 64
        for k, d in enumerate(r["documents"]):
            end = r["documents"][k + 1]["offset"] if k + 1 < len(r["documents"]) else len(r["ids"])
            back[d["doc_id"], d["start"]] = r["ids"][d["offset"] : end]
    for i, text in enumerate(texts):
        assert [x for key in sorted(k for k in back if k[0] == i) for x in back[key]] == ids_of(text)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op12_packing"](spark, sf).collect()
    n = checked(rows, docs, packing.ROOM)
    assert n <= -(-sum(r["length"] for r in rows) // packing.ROOM) + 1
