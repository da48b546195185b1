from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lavra.llm import ranked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute_force(docs, queries, top=20):
    """(item, rank, doc_id, score) by the wording."""
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, len(w), Counter(w)) for i, w in bags if w]
    n_docs, n_terms = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, bag in bags for t in bag)
    out = []
    for item, text in queries:
        scored = []
        for i, n, bag in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text))
            if score > 0:
                scored.append((-score, i is not None, i if i is not None else 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return out


def rows(found, key="item_id"):
    return sorted(((r[key], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=lambda r: (str(r[0]), r[1]))


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "ção", "x9"]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.choice((1, 5, 30, 90)))) for _ in range(n)]
    texts += [None, "", " .,", "rare W3 w3 W3", "b\x00c b"] + [texts[0]] * 50 + ["w1 " * 4000]
    queries = [(i, " ".join(rng.choices(words, k=rng.choice((1, 3, 9))))) for i in range(25)] + [(100, None), (101, ""), (102, "nothing-here zz"), (103, texts[0] + " w1 w1"), (104, "rare")]
    return list(enumerate(texts)), queries


def test_search_equals_brute_force(spark):
    docs, queries = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "terms", "most", "score", "rank", "key")})
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("key", F.lit(1))
    want = sorted(brute_force(docs, queries), key=lambda r: (str(r[0]), r[1]))
    for block_docs, part_terms, parts in ((512, 1 << 18, 3), (4, 20, 5), (1, 1, 1)):
        some = asked if part_terms > 1 else asked.filter("item_id > 98")
        index = ranked.build(frame.repartition(parts), block_docs)
        assert rows(ranked.search(index, some, part_terms=part_terms)) == [r for r in want if part_terms > 1 or r[0] > 98]
    assert rows(ranked.search(index, asked, top=3)) == sorted(brute_force(docs, queries, 3), key=lambda r: (str(r[0]), r[1]))


def test_odd_tables(spark):
    docs = [("b", "um texto"), ("a", "um texto"), (None, "um texto"), ("a", "um texto"), ("c", None)]
    frame = spark.createDataFrame(docs, "doc_id string, text string")
    queries = [("q", "texto um"), (None, "um")]
    asked = spark.createDataFrame(queries, "item_id string, text string")
    found = rows(ranked.rank(frame, asked))
    assert [(r[0], r[1], r[2]) for r in found] == [(None, 1, None), (None, 2, "a"), (None, 3, "a"), (None, 4, "b"), ("q", 1, None), ("q", 2, "a"), ("q", 3, "a"), ("q", 4, "b")]
    for some, other in ((frame.limit(0), asked), (frame, asked.limit(0)), (frame.filter("text is null"), asked)):
        none = ranked.rank(some, other)
        assert none.count() == 0 and none.dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "string"), ("score", "bigint")]


def test_most_blocks_are_left_out(spark, monkeypatch):
    """Documents on one subject stand together: a query's bound is low on all other blocks, which aren't scored."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices([f"s{i // 40}x{k}" for k in range(30)] + ["comum"] * 10, k=40))) for i in range(1600)]
    queries = [(s, f"s{s}x1 s{s}x2 comum") for s in range(0, 40, 5)]
    index = ranked.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 20)
    part = ranked.Part([(i, terms(t)) for i, t in queries])
    part.weigh(index.n_docs, ranked._frequencies(index, part))
    least = ranked._needed(index, part, 20)
    assert (least > 0).all()
    scored = []

    class Counted(ranked.Block):
        def best(self, *args):
            scored.append(1)
            return super().best(*args)

    monkeypatch.setattr(ranked, "Block", Counted)
    table = index.blocks.toArrow()
    out = list(ranked._scorer(index, part, least, 20)(iter(table.combine_chunks().to_batches())))
    got = sorted((queries[q][0], score, i) for b in out for q, score, i in zip(*(b.column(c).to_pylist() for c in ("query", "score", "doc_id"))))
    want = sorted((item, score, i) for item, _, i, score in brute_force(docs, queries))
    assert set(want) <= set(got) and len(scored) <= 0.15 * table.num_rows * len(queries)


def test_bounds_hold(spark):
    docs, queries = corpus(80, 5)
    index = ranked.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 8)
    part = ranked.Part([(i, terms(t)) for i, t in queries if terms(t)])
    part.weigh(index.n_docs, ranked._frequencies(index, part))
    weight = ranked.LengthWeight(index.n_docs, index.n_terms)
    for batch in index.blocks.toArrow().to_batches():
        for i, (letters, cuts, most) in enumerate(ranked._each(batch, "letters", "cuts", "most")):
            places = part.places(ranked._strings(letters, cuts))
            bounds = part.bounds(places, ranked._unpacked(most))
            block = ranked.Block(batch, i, part, places, weight)
            for q in range(len(part.keys)):
                best = block.best(part.own[q], ranked._weights(part, q), 0, 1)
                assert (best[0][0] if best else 0) <= bounds[q]


def test_the_index_is_written_once_and_small(spark, monkeypatch):
    """A block is one row, which passes through the memory of executors whole."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices([f"wort{k}" for k in range(3000)], weights=[1 / (k + 1) for k in range(3000)], k=120))) for i in range(600)]
    stored, store = [], ranked.shared.store
    monkeypatch.setattr(ranked.shared, "store", lambda *args: stored.append(1) or store(*args))
    index = ranked.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    columns = [c for c, kind in index.blocks.dtypes if kind == "binary"]
    taken = sum(len(r[c]) for r in index.blocks.collect() for c in columns)
    assert len(stored) == 1 and taken <= 0.6 * sum(len(t) for _, t in docs)


def test_packed_numbers(spark):
    for x in ([], [0], [255, 3], [256], [65535, 0], [65536], [2**32 - 1], [2**32, 7]):
        assert ranked._unpacked(ranked._packed(ranked.np.array(x, ranked.np.int64))).tolist() == x
