"""Event streams: sliding rates, limits, dropped duplicates and incremental back-fill."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType


def recent_counts(events: DataFrame, key: str, ts: str, seconds: int, name: str = "recent") -> DataFrame:
    """Per event, the key's events in the window that ends with it; one at exactly `seconds` before is out."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds * 1_000_000) + 1, 0)
    return events.withColumn(name, F.count("*").over(w))


def limited(events: DataFrame, key: str, ts: str, tie: str, most: int, seconds: int) -> DataFrame:
    """The events with `admitted`: whether fewer than `most` admitted ones of the key lie in the `seconds` before.

    A rejected event doesn't count against later ones, so each depends on those
    before it; a key's events are read in order and only its last `most` admitted
    ones are held, however many there are. Events without a key are one key's;
    an event without a time isn't admitted and counts against none.
    """
    dealt = events.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "__at", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, passed = (), deque()
        for batch in batches:
            verdicts = []
            for name, at in zip(batch.column(key).to_pylist(), batch.column("__at").to_pylist(), strict=True):
                name = ("not a number", None) if name != name else (name,)
                if name != who:
                    who, passed = name, deque()
                while at is not None and passed and passed[0] <= at - seconds * 1_000_000:
                    passed.popleft()
                verdicts.append(at is not None and len(passed) < most)
                if verdicts[-1]:
                    passed.append(at)
            yield batch.drop_columns(["__at"]).append_column("admitted", pa.array(verdicts, pa.bool_()))

    return dealt.mapInArrow(run, StructType([*events.schema.fields, StructField("admitted", BooleanType())]))


def sliding_rates(events: DataFrame, key: str, ts: str, seconds: int, step: int, late: str | None = "10 minutes") -> DataFrame:
    """Counts per key in sliding windows of a stream, with late data up to the watermark (None if the stream has one)."""
    marked = events.withWatermark(ts, late) if late else events
    return marked.groupBy(F.window(ts, f"{seconds} seconds", f"{step} seconds"), key).agg(F.count("*").alias("n"))


def admitted(events: DataFrame, key: str, ts: str, most: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """Events of a stream with whether a limiter lets them pass: at most `most` admitted ones of a key in any `seconds`.

    Only the events' own times count: what a key has admitted is kept until the watermark, `late` behind the newest
    event, has passed the last window it can matter in. So a stream that is slow, or replayed, admits what it did before;
    in order, that is what `limited` admits. An event that comes late is held against those admitted before its time.
    """
    kind = events.schema[key].dataType.simpleString()
    span = 1_000_000 * seconds

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed: list[int] = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(t for batch in batches for t in batch[ts]):  # a key's events of one micro-batch
            now = t.value // 1000
            ok = sum(now - span < p <= now for p in passed) < most
            if ok:
                passed.append(now)
            out.append((name[0], t, ok))
        mark = 1000 * state.getCurrentWatermarkMs()
        passed = [p for p in passed if p > mark - span]
        if passed:
            state.update((passed,))
            state.setTimeoutTimestamp((max(passed) + span) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, ts, "admitted"])

    marked = events.filter(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, admitted boolean", "passed array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def once(events: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """A stream without repeated keys within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def backfill(stream: DataFrame, path: str, checkpoint: str, fill: Callable[[DataFrame], DataFrame]):
    """Process what is new and stop: each batch's filled rows are appended once."""

    def write(batch: DataFrame, number: int) -> None:
        fill(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch overwrites itself

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
