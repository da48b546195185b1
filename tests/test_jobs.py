from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lavra.operators import chat, ingest, reads, tables
from lavra.streaming import rates
from lavra.streaming.progress import TrackedJob

T0 = dt.datetime(2026, 1, 1)
EVENTS = "event_id int, user_id int, ts timestamp"


# ---------------------------------------------------------------- limits


def test_events_without_key_are_limited_too(spark):
    rows = [(i, None if i % 2 else 7, T0 + dt.timedelta(seconds=i)) for i in range(10)] + [(20, None, None), (21, 7, None)]
    got = {r["event_id"]: r["admitted"] for r in rates.limited(spark.createDataFrame(rows, EVENTS), "user_id", "ts", "event_id", 2, 60).collect()}
    assert [i for i, ok in sorted(got.items()) if ok] == [0, 1, 2, 3] and len(got) == 12
    floats = spark.createDataFrame([(i, float("nan") if i % 2 else None, T0) for i in range(6)], "event_id int, user_id double, ts timestamp")
    assert rates.limited(floats, "user_id", "ts", "event_id", 1, 60).filter("admitted").count() == 2


def one_by_one(rows, most, seconds):
    passed, out = {}, {}
    for i, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        own = [t for t in passed.get(user, []) if t > ts - dt.timedelta(seconds=seconds)]
        out[i] = len(own) < most
        passed[user] = own + [ts] * out[i]
    return out


def test_a_replayed_stream_admits_what_the_batch_admits(spark, tmp_path):
    """Hours lie between the events and no time between the batches, or the other way round: only event time counts."""
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, None]), T0 + dt.timedelta(seconds=20 * i + rng.randrange(20))) for i in range(120)]
    want = one_by_one(rows, 3, 150)
    for name, size in (("few", 60), ("many", 15)):
        for k in range(0, 120, size):
            spark.createDataFrame(rows[k : k + size], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"part={k:03d}"))
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
        q = rates.admitted(stream, "user_id", "ts", 3, 150).writeStream.format("memory").queryName(f"admitted_{name}").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        got = {(r["user_id"], r["ts"]): r["admitted"] for r in spark.table(f"admitted_{name}").collect()}
        assert got == {(u, t): want[i] for i, u, t in rows}
    batch = rates.limited(spark.createDataFrame(rows, EVENTS), "user_id", "ts", "event_id", 3, 150).collect()
    assert {r["event_id"]: r["admitted"] for r in batch} == want


# ---------------------------------------------------------------- progress


def test_progress_is_seen_between_batches_and_counts_once(spark, tmp_path):
    schema = "analysis_id long, item_id long"
    source = str(tmp_path / "items")
    totals = spark.createDataFrame([(1, 4), (2, 2), (3, 1)], "analysis_id long, total_items long")
    job = TrackedJob(str(tmp_path / "job"), lambda b: b.withColumn("ok", F.col("analysis_id") != 2))

    def seen():
        return {r["analysis_id"]: (r["analyzed_items"], r["percent"], r["status"]) for r in job.progress(totals).collect()}

    assert seen() == {1: (0, 0, "pending"), 2: (0, 0, "pending"), 3: (0, 0, "pending")}
    for rows, want in (
        ([(1, 1), (2, 1)], {1: (1, 25, "running"), 2: (0, 50, "running"), 3: (0, 0, "pending")}),
        ([(1, 2), (1, 3), (1, 4), (2, 2)], {1: (4, 100, "completed"), 2: (0, 100, "error"), 3: (0, 0, "pending")}),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        job.start(spark.readStream.schema(schema).parquet(source), str(tmp_path / "checkpoint")).awaitTermination(120)
        assert seen() == want
    job.write(spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 2)], schema), 1)  # the second batch runs again
    assert seen()[1] == (4, 100, "completed") and job.results(spark).count() == 6


# ---------------------------------------------------------------- chat log

TURNS = f"conversation_id long, turn long, text string, content string, citations array<struct<type:string,reference:string,title:string,snippet:string>>, grounded boolean, confidence double, provider string, reason string"


def test_the_log_holds_each_turn_once(spark, tmp_path):
    turn = lambda c, t, text, answer="a": (c, t, text, answer, [], True, 0.5, "p", None)
    log = chat.ChatLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    log.append(spark.createDataFrame([turn(1, 1, "q"), turn(2, 1, "r")], TURNS), 0)
    for _ in range(2):  # a batch that is sent again replaces itself
        log.append(spark.createDataFrame([turn(1, 2, "s"), turn(1, 1, "outra", "b")], TURNS), 1)
    log.append(spark.createDataFrame([turn(1, 2, "s", "c"), turn(1, 1, "q")], TURNS), 2)
    got = [(r["conversation_id"], r["turn"], r["role"], r["content"]) for r in log.read().orderBy("conversation_id", "turn", F.desc("role")).collect()]
    assert got == [(1, 1, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "s"), (1, 2, "assistant", "a"), (2, 1, "user", "r"), (2, 1, "assistant", "a")]


def test_a_failed_answer_says_so(spark):
    row = chat.validated(spark.createDataFrame([("", True)], "raw string, failed boolean"), failed="failed").first()
    assert (row["content"], row["refused"], row["reason"]) == (chat.FAILURE, True, chat.FAILED)


def test_failing_legs_are_empty(spark):
    items = spark.createDataFrame([("a", "1", "t", "c")], "id string, item_number string, title string, content string")
    broken = items.withColumn("item_number", F.raise_error(F.lit("quebrou")).cast("string"))
    legs = [chat.isolated(spark, make, "id", "string") for make in (lambda: spark.table("nenhuma_tabela"), lambda: chat.item_sources(broken, "id"), lambda: chat.item_sources(items, "id"))]
    assert [leg.count() for leg in legs] == [0, 0, 1]
    assert [r["reference"] for r in chat.assembled(legs, "id").collect()] == ["Item 1"]


# ---------------------------------------------------------------- uploads and texts


def test_uploads_are_split_in_one_pass(spark, tmp_path):
    files = spark.createDataFrame([("a.pdf", 9, bytearray(b"%PDF-1.7x")), ("b.exe", 3, bytearray(b"abc")), ("c.pdf", 3, bytearray(b"abc")), ("d.docx", 0, bytearray(b"")), (None, 1, None)], "path string, length long, content binary")
    counts = ingest.write_split(ingest.checked(files), str(tmp_path / "u"))
    assert counts == {"accepted": 1, "rejected": 4}
    rows = {r["path"]: (r["outcome"] == "accepted", r["problem"], r["filename_stored"] is not None) for r in spark.read.parquet(str(tmp_path / "u")).collect()}
    assert rows == {"a.pdf": (True, None, True), "b.exe": (False, "extension", False), "c.pdf": (False, "content doesn't match the extension", False), "d.docx": (False, "empty", False), None: (False, "extension", False)}
    again = ingest.checked(files).filter("problem is null").first()["filename_stored"]
    assert again == spark.read.parquet(str(tmp_path / "u")).filter("outcome = 'accepted'").first()["filename_stored"] and "a" != again.split(".")[0]


def test_texts_without_chunks_are_rejected(spark, tmp_path):
    texts = spark.createDataFrame([(1, "Art. 1º x\nArt. 2º y", True), (2, "só prosa", True), (3, "só prosa", False), (4, None, False), (5, "", None)], "id long, text string, law boolean")
    documents, counts = ingest.ingest(texts, "id", F.col("law"), str(tmp_path / "i"))
    assert {r["id"]: (r["n_chunks"], r["problem"]) for r in documents.collect()} == {1: (2, None), 2: (0, "no chunks"), 3: (1, None), 4: (0, "no chunks"), 5: (0, "no chunks")}
    assert counts == {"accepted": 2, "rejected": 3}
    assert {(r["id"], r["article"]) for r in spark.read.parquet(str(tmp_path / "i" / "chunks")).collect()} >= {(1, "Art. 1º"), (1, "Art. 2º")}


# ---------------------------------------------------------------- guards and revisions


@pytest.mark.parametrize(("before", "after", "problem"), [(1, 2, None), (1, 9, "no such document: after"), (9, 8, "no such document: before"), (3, 9, "not a reference document: before"), (1, 3, "not a reference document: after"), (1, None, "no such document: after"), (4, 1, "not a reference document: before")])
def test_diff_guards(spark, before, after, problem):
    documents = spark.createDataFrame([(1, "tr"), (2, "tr"), (3, "proposta"), (4, None)], "id long, document_type string")
    wanted = spark.createDataFrame([(before, after)], "before_id long, after_id long")
    assert [r["problem"] for r in reads.diff_problems(wanted, documents).collect()] == [problem]


def test_revisions_are_listed_and_read(spark):
    items = spark.createDataFrame([(1, "1", "t", "c", 0, "item", 1), (1, "2", "u", "d", 1, "item", None)], "document_id long, item_number string, title string, content string, item_order int, item_type string, page_number int")
    old = spark.createDataFrame([(1, 1), (1, 2)], "document_id long, versao int")
    saved = tables.snapshot(items, old, F.lit("v"))
    assert [(r["versao"], r["n_items"], r["nth"]) for r in tables.revisions(saved).collect()] == [(3, 2, 1)]
    wanted = spark.createDataFrame([(1, 3), (1, 9), (2, 1)], "document_id long, versao int")
    got = sorted(((r["document_id"], r["versao"], r["found"], r["item_number"]) for r in tables.revision(saved, wanted).collect()), key=str)
    assert got == [(1, 3, True, "1"), (1, 3, True, "2"), (1, 9, False, None), (2, 1, False, None)]
