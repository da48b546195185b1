"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group of large rows, unless one row is larger.
ROW_GROUP = 16 << 20


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only in local mode where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    if not named and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lavra-"))
    return named or spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The frame, computed once and cut from its lineage."""
    folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str, by: str | None = None, large_rows: bool = False) -> tuple[DataFrame, str]:
    """The frame as a Parquet table in the shared folder, split by a column if asked, and the table's path.

    large_rows: rows of megabytes. Pages and row groups are ended by size after every row then; else only
    after a hundred rows, which a task writes, compresses and reads as one piece.
    """
    path = f"{folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    options = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(ROW_GROUP)} if large_rows else {}
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no pending result reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
