"""How five document filters interact, over all orders in which they can be applied.

A document's failures are a mask of five bits. Four come from its own text. The
fifth, a text that a smaller id has too, comes from an RDD routed by the texts'
xxhash: every input partition keeps chains of (text, smallest id) by fingerprint,
emits all larger ids at once, and sends on one text for each chain link alone,
so a text that fills a third of the table reaches its task once from each
partition. There the texts of a fingerprint, sorted by id, meet in a chain of
full texts, and all but the smallest id are emitted. combineByKey then merges
vectors of counts by mask, one for each part; orders, steps and Shapley sums
follow from a part's 32 counts alone.

Defined results: a null or empty text has no words, so it fails A alone (and E
where a smaller id's text is null or empty too); very long texts are read word by
word; a null source and an empty one are the same part, the empty string; rows
without doc_id are counted, but neither fail E nor make others fail; repeated rows
of one id count each, and don't repeat each other, as no id is smaller; of an id's
labels, one that is 1 decides, null is 0; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lavra.llm import shared

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: Fixed values of the filters: least words, least share of distinct words, most share of capitals (percent), and unwanted marks.
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"
#: Bytes of text that the chains of an input partition hold before they are sent on.
HELD_BYTES = 32 << 20
#: Longer texts are split one word at a time.
LONG_BYTES = 1 << 20

_CAPITALS = bytes(range(0x41, 0x5B))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COUNTS = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str) -> int:
    """The bits of A to D that the text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) > LONG_BYTES:
        n, seen = 0, set()
        for word in _WORD.finditer(raw):
            n += 1
            seen.add(word[0])
        distinct = len(seen)
    else:
        words = raw.split()  # bytes are split at \x20 and \x09-\x0D alone
        n, distinct = len(words), len(set(words))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    marked = len(raw.translate(None, MARKS)) < len(raw)
    failed = (n < LEAST_WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * len(text), marked)
    return sum(bit << i for i, bit in enumerate(failed))


def _fingerprint(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _routed(rows: Iterable[tuple], fingerprint=_fingerprint, most: int = HELD_BYTES) -> Iterator[tuple]:
    """((fingerprint, 0, doc_id), text) for the smallest id that a partition has with each text.

    All larger ids are settled here: they go on without text, spread over all partitions: ((spread, 1, 0), (doc_id, fingerprint)).
    """
    chains: dict[int, list[list]] = {}  # of [text, smallest id]
    held = settled = 0

    def larger(doc_id, at: int) -> tuple:
        nonlocal settled
        settled += 1
        return (xxhash.xxh3_64_intdigest(f"{settled} {doc_id}".encode()), 1, 0), (doc_id, at)

    def smallest() -> Iterator[tuple]:
        for at, chain in chains.items():
            for text, doc_id in chain:
                yield (at, 0, doc_id), text

    for doc_id, text in rows:
        text = text or ""
        at = fingerprint(text)
        chain = chains.setdefault(at, [])
        found = next((x for x in chain if x[0] == text), None)
        if found is None:
            chain.append([text, doc_id])
            held += len(text)
        elif doc_id < found[1]:
            yield larger(found[1], at)
            found[1] = doc_id
        elif doc_id > found[1]:
            yield larger(doc_id, at)
        if held > most:
            yield from smallest()
            chains, held = {}, 0
    yield from smallest()


def _settled(records: Iterable[tuple]) -> Iterator[tuple]:
    """(doc_id, fingerprint) of all but a text's smallest id, from records sorted by fingerprint and id."""
    last, chain = None, []
    for (at, kind, doc_id), value in records:
        if kind:
            yield value
            continue
        if at != last:
            last, chain = at, []
        least = next((least for text, least in chain if text == value), None)
        if least is None:
            chain.append((value, doc_id))
        elif least < doc_id:
            yield doc_id, at


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of the rows whose text a smaller id has too, each once."""
    spark = docs.sparkSession
    rdd = docs.filter("doc_id is not null").select("doc_id", F.col("text").cast("string")).rdd
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rdd.getNumPartitions())  # grows with the input
    routed = rdd.mapPartitions(_routed).repartitionAndSortWithinPartitions(n, lambda key: key[0])
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("fingerprint", LongType())])
    return spark.createDataFrame(routed.mapPartitions(_settled), schema, verifySchema=False).distinct()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = {"mask": pa.array([failures(t) for t in texts], pa.int32()), "fingerprint": pa.array([_fingerprint(t) for t in texts], pa.int64())}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *found.values()], ["doc_id", "part", *found])


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, spread, part, mask) of every row: bit 0 is A, bit 4 is E; spread numbers the rows without id and is 0 for others."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    schema = StructType([docs.schema["doc_id"], *(StructField(name, kind) for name, kind in (("part", StringType()), ("mask", IntegerType()), ("fingerprint", LongType())))])
    # Joins on an id that is missing would send all such rows to one task.
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    own = rows.mapInArrow(_own, schema).withColumn("spread", spread)
    again = repeated(docs).withColumns({"spread": F.lit(0).cast("long"), "again": F.lit(REPEATED)})
    return own.join(again, ["doc_id", "spread", "fingerprint"], "left").select("doc_id", "spread", "part", (F.col("mask") + F.coalesce("again", F.lit(0))).alias("mask"))


def _counted(row: tuple) -> list[int]:
    return _with([0] * (3 << len(FILTERS)), row)


def _with(counts: list[int], row: tuple) -> list[int]:
    """Counts by mask of all documents, of good and of toxic ones, with one more document."""
    mask, good, toxic = row
    counts[3 * mask] += 1
    counts[3 * mask + 1] += good
    counts[3 * mask + 2] += toxic
    return counts


def _merged(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def orders(counts: list[int]) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from a part's counts by mask."""
    found, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in itertools.permutations(FILTERS):
        before, left = 0, sum(counts[::3])
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            here = [m for m in range(1 << len(FILTERS)) if m & bit and not m & before]
            removed = sum(counts[3 * m] for m in here)
            redundant = sum(counts[3 * m] for m in range(1 << len(FILTERS)) if m & bit and m & before)
            left -= removed
            shapley[name] += removed
            found.append(("".join(order), step, left, removed, redundant, counts[3 * bit], sum(counts[3 * m + 1] for m in here), sum(counts[3 * m + 2] for m in here), name))
            before |= bit
    for *row, name in found:
        yield *row, shapley[name]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter order and step; see the module's text."""
    one = lambda name: F.max(F.coalesce(F.col(name).cast("int") == 1, F.lit(False)).cast("int"))
    kind = docs.schema["doc_id"].dataType
    marked = labels.select(F.col("doc_id").try_cast(kind), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    joined = masks(docs).join(marked.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    # A few bytes a row, computed once: the RDD below begins here whatever is lost.
    counted = shared.checkpoint(joined.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    pairs = counted.rdd.map(lambda r: (r[0], (r[1], r[2], r[3])))
    by_part = pairs.combineByKey(_counted, _with, _merged)
    rows = by_part.flatMap(lambda x: ((x[0], *row) for row in orders(x[1])))
    return docs.sparkSession.createDataFrame(rows, f"part string, filter_order string, step int, {COUNTS}", verifySchema=False)
