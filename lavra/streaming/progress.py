"""A job that runs as a stream, and a table of its progress that others may read meanwhile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lavra import storage
from lavra.operators import analysis


class TrackedJob:
    """Work on a stream of items, one micro-batch after the other. Results and counts of a batch lie in folders of its number.

    A batch that is run again, after a failure, replaces what it had left, so nothing is counted twice. `work` returns
    a row for each item, with the job it belongs to and whether it succeeded.
    """

    def __init__(self, path: str, work: Callable[[DataFrame], DataFrame], job: str = "analysis_id", ok: str = "ok"):
        self.path, self.work, self.job, self.ok = path, work, job, ok

    def write(self, batch: DataFrame, number: int) -> None:
        done = storage.stored(self.work(batch), f"{self.path}/results/batch={number}")
        counts = done.groupBy(self.job).agg(F.count("*").alias("seen"), F.count_if(F.coalesce(F.col(self.ok), F.lit(False))).alias("done"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")

    def start(self, items: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return items.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/results")

    def progress(self, totals: DataFrame) -> DataFrame:
        """job, total_items, analyzed_items, percent and status of every job in totals (job, total_items), as far as batches are complete.

        A job that is seen whole is completed, or an error if no item of it succeeded; one not begun is pending.
        """
        kind = totals.schema[self.job].dataType.simpleString()
        counts = storage.read_or_empty(totals.sparkSession, f"{self.path}/counts", f"`{self.job}` {kind}, seen bigint, done bigint, batch int")
        summed = counts.groupBy(self.job).agg(F.sum("seen").alias("seen"), F.sum("done").alias("done"))
        known = totals.join(summed, self.job, "left").fillna(0, ["seen", "done"])
        whole = F.col("seen") >= F.col("total_items")
        status = F.when(whole & (F.col("done") == 0), "error").when(whole, "completed").when(F.col("seen") > 0, "running").otherwise("pending")
        return known.select(self.job, "total_items", F.col("done").alias("analyzed_items"), analysis.progress(F.col("seen"), F.col("total_items")).alias("percent"), status.alias("status"))
