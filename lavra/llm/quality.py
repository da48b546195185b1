"""Quality classifier: a sparse rule ensemble.

Text statistics are computed for every document. On a bounded labelled sample,
a forest of shallow trees is grown, each path of a tree becomes a conjunctive
rule over the statistics, and a lasso logistic regression weighs the rules.
The rules that keep a weight are compiled into one Spark column expression.

Defined results: null and empty texts have zero statistics and are scored by
them like any text; without labelled rows of both classes every score is the
share of label 1 (0.5 without any); conflicting labels of an id count as 1;
repeated rows, ties, rows without doc_id and very long texts are scored alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.llm import text as tx
from lavra.llm.labelled import held_out, sample

#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 12_000
TREES, DEPTH, LASSO, SEED = 16, 3, 0.0005, 11
#: Score from which a document is predicted to be good.
PREDICT_AT = 0.3

STATISTICS = (
    "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "upper", "digits", "punctuation", "symbols", "pipes", "bangs",
    "non_ascii", "blanks", "lines", "distinct_lines", "line_length", "distinct_triples", "stops", "runs",
)


def _lut(chars: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars)] = True
    return lut


_CLASSES = {
    "upper": _lut(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": _lut(b"0123456789"),
    "punctuation": _lut(b".,;:!?'\"()-"),
    "symbols": _lut(b"#$%&*+/<=>@[]^_`{}~\\"),
    "pipes": _lut(b"|"),
    "bangs": _lut(b"!?"),
    "blanks": _lut(b" \t\r\v\f"),
    "stops": _lut(b".!?"),
}
_CLASSES["non_ascii"] = np.arange(256) >= 128
_LINES = ~_lut(b"\n")


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], float)


def block_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each document of a block."""
    data, offsets = tx.utf8(column)
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    words, lines = tx.Words(data, offsets, tx.NONBLANK), tx.Words(data, offsets, _LINES)
    n_words, n_lines = words.counts().astype(float), lines.counts().astype(float)
    length = (words.end - words.start).astype(float)
    longest = np.zeros(len(size))
    owner = np.repeat(np.arange(len(size)), words.counts())
    np.maximum.at(longest, owner, length)
    triples = words.hash[:-2] + words.hash[1:-1] * np.uint64(3) + words.hash[2:] * np.uint64(5) if len(words.hash) > 2 else words.hash[:0]
    ends = np.maximum(words.first[1:] - 2, words.first[:-1])
    n_triples = (ends - words.first[:-1]).astype(float)
    distinct_triples = np.array([len(np.unique(triples[a:b])) for a, b in zip(words.first[:-1].tolist(), ends.tolist(), strict=True)], float)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & ~_CLASSES["blanks"][data[1:]]
    out = {k: _per_document(lut[data], offsets) / some for k, lut in _CLASSES.items()}
    out |= {
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(n_words),
        "word_length": np.bincount(owner, length, len(size)) / np.maximum(n_words, 1),
        "longest_word": np.log1p(longest),
        "distinct_words": _distinct(words.hash, words.first) / np.maximum(n_words, 1),
        "lines": np.log1p(n_lines),
        "distinct_lines": _distinct(lines.hash, lines.first) / np.maximum(n_lines, 1),
        "line_length": np.log1p(n_words / np.maximum(n_lines, 1)),
        "distinct_triples": distinct_triples / np.maximum(n_triples, 1),
        "runs": _per_document(same, offsets) / some,
    }
    return out


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the statistics of every document."""
    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{s} double" for s in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.blocks(batches):
            found = block_statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(found[s], pa.float64()) for s in STATISTICS)], names=[*keep, *STATISTICS])

    return docs.select(*keep, "text").mapInArrow(run, fields)


#: A rule: statistic, whether it must be above the bound, bound.
Test = tuple[str, bool, float]


@dataclass(frozen=True)
class Rules:
    """Weighted conjunctions of tests, and the log-odds without any."""

    intercept: float
    weighted: tuple[tuple[tuple[Test, ...], float], ...]

    def score(self) -> Column:
        """The ensemble as one column expression over the statistics."""
        odds = F.lit(self.intercept)
        for rule, weight in self.weighted:
            odds = odds + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def holds(rule: tuple[Test, ...]) -> Column:
    out = F.lit(True)
    for name, above, bound in rule:
        out = out & ((F.col(name) > bound) if above else (F.col(name) <= bound))
    return out


def tree_paths(description: str) -> set[tuple[Test, ...]]:
    """Every path from a root, inner ends included, in Spark's printed form of a forest."""
    rules: set[tuple[Test, ...]] = set()
    path: list[tuple[int, Test]] = []
    for line in description.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        path = [(d, t) for d, t in path if d < depth]
        path.append((depth, (STATISTICS[int(found[2])], found[3] == ">", float(found[4]))))
        tightest: dict[tuple[str, bool], float] = {}
        for _, (name, above, bound) in path:
            old = tightest.get((name, above))
            tightest[name, above] = bound if old is None else (max(old, bound) if above else min(old, bound))
        rules.add(tuple(sorted((name, above, bound) for (name, above), bound in tightest.items())))
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Rules:
    """The rule ensemble fitted on a bounded sample of labelled documents."""
    spark = docs.sparkSession
    drawn = statistics(sample(docs, labels, "quality", rows), ("doc_id", "label")).toPandas()
    drawn = drawn.sort_values(["doc_id", *STATISTICS], kind="stable").reset_index(drop=True)
    good = int(drawn["label"].sum())
    if not 0 < good < len(drawn):
        share = min(max(good / len(drawn), 1e-3), 1 - 1e-3) if len(drawn) else 0.5
        return Rules(math.log(share / (1 - share)), ())
    # Both classes weigh alike while the trees are grown.
    drawn["weight"] = np.where(drawn["label"] == 1, 0.5 * len(drawn) / good, 0.5 * len(drawn) / (len(drawn) - good))
    frame = spark.createDataFrame(drawn[["label", "weight", *STATISTICS]]).coalesce(1)
    frame = frame.select("label", "weight", *STATISTICS, array_to_vector(F.array(*STATISTICS)).alias("features")).cache()
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=10, seed=SEED
    ).fit(frame)
    rules = sorted(tree_paths(forest.toDebugString))
    if not rules:
        frame.unpersist()
        return Rules(math.log(good / (len(drawn) - good)), ())
    matched = frame.select("label", array_to_vector(F.array(*(F.when(holds(r), 1.0).otherwise(0.0) for r in rules))).alias("rules")).cache()
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(matched)
    weights = lasso.coefficients.toArray().tolist()
    frame.unpersist()
    matched.unpersist()
    return Rules(float(lasso.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9))


def classify(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    scored = statistics(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rules.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
