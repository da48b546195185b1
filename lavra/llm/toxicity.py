"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a
logistic model over its hashed words; a noisy-or combines them, so that one
toxic sentence makes a toxic document. The weights are trained from document
labels alone, on a bounded sample, with an L1 penalty; the sentence scores then
tell where the offences are.

The sample's features are kept as a table; a grouped count over it picks the
features that help, and only these are fitted, as 32-bit numbers, for at most
FIT_ENTRIES occurrences, in one task. The driver gets the weights alone.

Defined results: null and empty texts have no sentence and score 0; a very long
text is one bag of many sentences, read whole; without labelled rows of both
classes every score is 0; conflicting labels of an id count as toxic; repeated
rows, ties and rows without doc_id are scored alike; an empty table gives an
empty result; other columns are ignored by `score` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm import shared
from lavra.llm import text as tx
from lavra.llm.labelled import held_out, sample

#: Labelled documents that the model is fitted on at most.
SAMPLE_ROWS = 6_000
#: Feature occurrences of the sample that the fit takes at most; further documents are left out of the fit.
FIT_ENTRIES = 6_000_000
#: Bytes of the word beginnings that count as features beside the word.
BEGINNINGS = (5, 6, 7)
#: Hash slots of features; documents of the sample a feature must occur in, and share of those without toxicity it may occur in.
SLOTS, MIN_DOCS, MOST_DOCS = 1 << 20, 4, 0.2
#: Steps, rate and L1 penalty of the fit.
STEPS, RATE, LASSO = 200, 0.15, 2e-4
#: Feature occurrences that a step handles at once.
PIECE = 1 << 19
#: Score from which a document, or a sentence, is toxic.
PREDICT_AT = 0.5

_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


class Sentences:
    """Features of a block, grouped by sentence: each word and its beginnings. Sentences without words don't count.

    slot: feature of each entry; of: its sentence; doc: document of each sentence; first, last: its first and last word.
    """

    def __init__(self, column: pa.Array):
        data, offsets = tx.utf8(column)
        found = tx.Words(data, offsets, tx.ALNUM)
        self.data, self.offsets, self.words = data, offsets, found
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_END[data], out=ends[1:])
        doc = np.repeat(np.arange(len(offsets) - 1), found.counts())
        stop = ends[found.start]
        new = np.ones(len(stop), bool)
        new[1:] = (stop[1:] != stop[:-1]) | (doc[1:] != doc[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(stop))[: len(self.first)] - 1
        self.doc = doc[self.first]
        sentence = np.cumsum(new) - 1
        slots, owners = [found.hash], [sentence]
        for n in BEGINNINGS:
            longer = np.flatnonzero(found.end - found.start > n)
            slots.append(found.beginnings(longer, n) ^ np.uint64(n << 56))
            owners.append(sentence[longer])
        self.slot = (tx.mix64(np.concatenate(slots)) & np.uint64(SLOTS - 1)).astype(np.int64)
        self.of = np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """Weight of every slot and the log-odds of a sentence without known words."""

    bias: float
    weights: np.ndarray

    def sentence_logits(self, found: Sentences) -> np.ndarray:
        return self.bias + np.bincount(found.of, self.weights[found.slot], len(found.first))


def _log_none(logits: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z)), safe for any z."""
    return -np.logaddexp(0, np.clip(logits, -30, 30))


def train(slots: np.ndarray, sentence: np.ndarray, bag: np.ndarray, labels: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal gradient steps on the noisy-or likelihood.

    slots: feature of each word; sentence: its sentence; bag: document of each sentence; labels: of each document.
    """
    weights, bias = np.zeros(max(1, features)), -5.0
    power, power_b = np.full(len(weights), 1e-8), 1e-8
    balance = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    for _ in range(STEPS):
        z = np.full(len(bag), bias)
        for a in range(0, len(slots), PIECE):
            z += np.bincount(sentence[a : a + PIECE], weights[slots[a : a + PIECE]], len(bag))
        g, gb = gradient(z, slots, sentence, bag, labels, balance, len(weights))
        power = 0.95 * power + 0.05 * g * g
        power_b = 0.95 * power_b + 0.05 * gb * gb
        rate = RATE / (np.sqrt(power) + 1e-4)
        weights = weights - rate * g
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * LASSO, 0)
        bias -= 0.05 * gb / np.sqrt(power_b)
    return weights[:features], float(bias)


def gradient(z: np.ndarray, slots: np.ndarray, sentence: np.ndarray, bag: np.ndarray, labels: np.ndarray, balance: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Slope of the noisy-or's negative log-likelihood by weight and bias, at sentence logits z."""
    none = np.bincount(bag, _log_none(z), len(labels))
    p = np.clip(-np.expm1(none), 1e-6, 1.0)
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    pull = np.where(labels[bag] == 1, -(1 - p[bag]) / p[bag], 1.0) * s * balance[bag]
    g = np.zeros(features)
    for a in range(0, len(slots), PIECE):
        g += np.bincount(slots[a : a + PIECE], pull[sentence[a : a + PIECE]], features)
    return g, float(pull.sum())


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model fitted on a bounded sample of labelled documents; executors split and hash their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.blocks(batches):
            found = Sentences(batch.column("text"))
            ints = pa.list_(pa.int32())
            owner = found.doc[found.of]
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
            before = np.searchsorted(found.doc, np.arange(batch.num_rows))  # sentences of earlier documents
            slot, place = found.slot[order].astype(np.int32), (found.of - before[owner])[order].astype(np.int32)
            slots = [slot[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            places = [place[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(slots, ints), pa.array(places, ints)], names=["doc_id", "label", "slots", "places"])

    spark = docs.sparkSession
    chosen = sample(docs, labels, "toxic", rows)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, slots array<int>, places array<int>"
    table, path = shared.store(chosen.mapInArrow(run, schema), "toxicity-sample")
    # Sizes only; at most `rows` rows in this one window.
    before = Window.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fitting = table.select("doc_id", F.size("slots").alias("n")).withColumn("so_far", F.sum("n").over(before)).filter(F.col("so_far") <= FIT_ENTRIES)
    table = table.join(F.broadcast(fitting.select("doc_id")), "doc_id")
    n_clean, n_bad = table.agg(F.count(F.when(F.col("label") == 0, 1)), F.count(F.when(F.col("label") == 1, 1))).first()
    weights = np.zeros(SLOTS, np.float32)
    if not n_clean or not n_bad:
        shared.drop(spark, path)
        return Model(-30.0, weights)
    # Common words are left out; common among the clean ones, as an offence may stand in every toxic document.
    counted = table.select("label", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").agg(F.count("*").alias("docs"), F.count(F.when(F.col("label") == 0, 1)).alias("clean"))
    useful = counted.filter((F.col("docs") >= MIN_DOCS) & (F.col("clean") <= max(MIN_DOCS, MOST_DOCS * n_clean))).select("slot")
    known = np.sort(useful.toArrow()["slot"].to_numpy()).astype(np.int32)  # SLOTS values at most
    sent = spark.sparkContext.broadcast(known)

    def only_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ints = batch.column("slots"), pa.list_(pa.int32())
            slot = lists.flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
            place = batch.column("places").flatten().to_numpy()
            n = np.zeros(batch.num_rows, np.int64)
            np.maximum.at(n, doc, place + 1)
            first = np.cumsum(n) - n
            at = np.searchsorted(sent.value, slot)
            keep = sent.value[np.minimum(at, len(sent.value) - 1)] == slot if len(sent.value) else np.zeros(len(slot), bool)
            at, sentence = at[keep], (first[doc] + place)[keep]
            bounds = [np.concatenate([[0], np.cumsum(x)]).astype(np.int32) for x in (np.bincount(doc[keep], minlength=batch.num_rows), n)]
            found = (at[np.argsort(sentence, kind="stable")], np.bincount(sentence, minlength=n.sum()))
            arrays = [pa.ListArray.from_arrays(pa.array(b), pa.array(x.astype(np.int32)), type=ints) for b, x in zip(bounds, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *arrays], names=["doc_id", "label", "slots", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrived = pa.Table.from_batches(batches).sort_by("doc_id").combine_chunks()
        label, n = arrived["label"].to_numpy(), pa.compute.list_value_length(arrived["counts"]).to_numpy()
        slot = arrived["slots"].combine_chunks().flatten().to_numpy()
        counts = arrived["counts"].combine_chunks().flatten().to_numpy()
        sentence = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        learned, bias = train(slot, sentence, np.repeat(np.arange(len(n), dtype=np.int32), n), label, len(sent.value))
        weight = pa.ListArray.from_arrays(pa.array([0, len(learned)], pa.int32()), pa.array(learned))
        yield pa.RecordBatch.from_arrays([pa.array([bias]), weight], names=["bias", "weights"])

    # Features by sentence, and how many each sentence has; FIT_ENTRIES of them at most meet in one task, and their weights are sent.
    known_only = table.mapInArrow(only_known, schema.replace("places", "counts")).repartition(1)
    result = known_only.mapInArrow(learn, "bias double, weights array<double>").toArrow()
    shared.drop(spark, path)
    sent.unpersist()
    weights[known] = result["weights"].combine_chunks().flatten().to_numpy()
    return Model(result["bias"][0].as_py(), weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, number of toxic sentences, the worst sentence's score and place, and every toxic sentence (code points)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # SLOTS values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        for batch in tx.blocks(batches):
            found = Sentences(batch.column("text"))
            n = batch.num_rows
            z = known.sentence_logits(found).astype(np.float64)
            p = -np.expm1(np.bincount(found.doc, _log_none(z), n))
            worst = np.full(n, -1)
            order = np.argsort(z, kind="stable")
            worst[found.doc[order]] = order  # the last one written is the highest
            some = worst >= 0
            chars = np.zeros(len(found.data) + 1, np.int64)
            np.cumsum((found.data & 0xC0) != 0x80, out=chars[1:])
            base = chars[found.offsets[:-1]][found.doc]
            begin = chars[found.words.start[found.first]] - base
            end = chars[found.words.end[found.last]] - base
            each = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            at = np.maximum(worst, 0)
            columns = [pa.array(x[at] if len(x) else np.zeros(n, x.dtype), mask=~some) for x in (each, begin, end)]
            bad = np.flatnonzero(z >= 0)
            count = np.bincount(found.doc[bad], minlength=n)
            spans = pa.StructArray.from_arrays([pa.array(begin[bad]), pa.array(end[bad]), pa.array(each[bad])], names=["start", "end", "score"])
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(p, 0.0, 1.0)), pa.array(count.astype(np.int64)), *columns, spans], names=names)

    names = ["doc_id", "score", "n_toxic_sentences", "worst_score", "worst_start", "worst_end", "toxic_sentences"]
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_toxic_sentences long, worst_score double, worst_start long, worst_end long"
    return docs.select("doc_id", "text").mapInArrow(run, f"{kinds}, toxic_sentences array<struct<start:long,end:long,score:double>>")


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and where the worst and all toxic sentences stand, for every document."""
    scored = score(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_toxic_sentences", "worst_score", "worst_start", "worst_end", "toxic_sentences")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, with their columns; each row is judged by its own text."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        for batch in tx.blocks(batches):
            found = Sentences(batch.column("text"))
            none = np.bincount(found.doc, _log_none(known.sentence_logits(found).astype(np.float64)), batch.num_rows)
            yield batch.filter(pa.array(-np.expm1(none) < PREDICT_AT))

    return docs.mapInArrow(run, docs.schema)
