from __future__ import annotations

import collections
import importlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lavra.llm import decontam, mixing, pii, shared, toxicity

SF = "/root/testdata/sf0.001"


def survivors(texts, k, similar):
    """Brute force: the smallest id of each group of linked texts."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} - {()})
    up = {d: d for d in texts}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= similar * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d for d in texts if find(d) == d}


ROWS = [
    (1, "plain words about gardens and rivers", "en", "a", 5), (1, "a different text with the same id", "en", "a", 5), (2, None, None, None, None), (3, "", "xx", "", 0), (None, "no id here at all", "en", "b", 1),
    (4, "mail a.b@c.de now " + "word " * 30, "en", "b", 9), (5, "mail a.b@c.de now " + "word " * 30, "en", "c", 9), (6, "long " * 260_000, "en", "c", 7), (7, "É x", None, "a", 3),
]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, empty):
    """Nulls, repeated ids, one text over 1 MiB, no labels, an empty benchmark, columns with the stages' own names."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([] if empty else ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("h", "node", "doc", "size", "copy", "copies", "shard", "score", "label", "__size")})
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs, _ = shared.store(stage(spark, before, str(tmp_path)), f"odd-{name}")
        counts.append(docs.count())
        if name == "personal_data":
            masked = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns[: len(before.columns)] == before.columns and docs.filter("h != 'x' or __size != 'x'").count() == 0
    if empty:
        assert counts == [0] * 5
    else:
        assert counts[:4] == [9, 8, 8, 8]  # 5 repeats 4
        assert masked[4].startswith("mail [EMAIL] now") and 5 not in masked and len(masked[6]) == 1_300_000


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs, _ = shared.store(stage(spark, before, SF), f"test-{name}")
        ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
        assert ids(docs) <= ids(before)
        if i < 4:
            assert docs.columns == before.columns
        if i == 0:
            bad = {r["doc_id"] for r in toxicity.classify(before, toxicity.fit(before, labels)).filter("predicted = 1").collect()}
            assert ids(docs) == ids(before) - bad
        if i == 1:
            assert ids(docs) == survivors({r["doc_id"]: r["text"] for r in before.collect()}, 5, 80)
        if i == 2:
            assert ids(docs) == ids(before) - {r["doc_id"] for r in decontam.decontaminate(before, bench).filter("contaminated").collect()}
        if i == 3:
            text = {r["doc_id"]: r["text"] for r in before.collect()}
            assert all(r["text"] == pii.mask(text[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in docs.collect())
        if i == 4:
            plan = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
            assert collections.Counter(r["doc_id"] for r in docs.collect()) == plan


def test_run_and_registration(spark):
    import __spark_entry__

    importlib.reload(__spark_entry__)
    assert {*(f"op{n}_" for n in range(1, 14))} == {q[: q.index("_") + 1] for q in __spark_entry__.queries() if q.startswith("op") and q[2].isdigit()}
    assert __spark_entry__.queries()["pipeline"](spark, SF).count() > 0
