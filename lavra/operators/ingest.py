"""Uploads and texts into tables: what is accepted and what isn't are written in one pass, with counts as it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lavra import storage
from lavra.operators import chunk, tables

NO_CHUNKS = "no chunks"


def checked(files: DataFrame) -> DataFrame:
    """Uploads (path, length, content) as rows of documents: stored name, type, size, status and what speaks against them; no content."""
    found = tables.upload_checks(files)
    # A name that can't be guessed from outside and is the same if the upload is tried again.
    name = F.concat(F.sha2(F.concat_ws("/", "path", F.sha2("content", 256)), 256), F.lit("."), F.col("file_type"))
    accepted = F.col("problem").isNull()
    return found.select("path", F.when(accepted, name).alias("filename_stored"), "file_type", F.col("length").alias("file_size_bytes"), F.when(accepted, "uploaded").otherwise("error").alias("status"), "problem")


def write_split(decided: DataFrame, path: str, problem: str = "problem") -> dict[str, int]:
    """Write rows with their problem in folders `outcome=accepted` and `outcome=rejected` of a path, in one pass; returns how many rows went where."""
    counts = Observation("split")
    accepted = F.col(problem).isNull()
    seen = decided.withColumn("outcome", F.when(accepted, "accepted").otherwise("rejected")).observe(counts, F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"))
    seen.write.mode("overwrite").partitionBy("outcome").parquet(path)
    return dict(counts.get)


def chunked(texts: DataFrame, key: str, is_law: Column, text: str = "text") -> DataFrame:
    """(key, chunk_index, article, section, chunk_text): laws by their articles, other texts by paragraphs, as each row says."""
    marked = texts.select(key, text, F.coalesce(is_law, F.lit(False)).alias("__law"))
    laws = chunk.law_chunks(marked.filter("__law"), key, text)
    others = chunk.paragraph_chunks(marked.filter("not __law"), key, text)
    fields = [key, "chunk_index", "article", "section", "chunk_text"]
    shown = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields))
    return shown(laws).unionByName(shown(others))


def ingest(texts: DataFrame, key: str, is_law: Column, path: str, text: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """Chunks of texts under `chunks`, and (key, n_chunks, problem) of each text under `documents`; a text without chunks is rejected.

    Returns the documents and how many were accepted and rejected.
    """
    chunks = storage.stored(chunked(texts, key, is_law, text), f"{path}/chunks")
    counted = texts.select(key).join(chunks.groupBy(key).agg(F.count("*").alias("n_chunks")), key, "left")
    n = F.coalesce("n_chunks", F.lit(0))
    decided = counted.select(key, n.alias("n_chunks"), F.when(n == 0, NO_CHUNKS).alias("problem"))
    counts = write_split(decided, f"{path}/documents")
    return texts.sparkSession.read.parquet(f"{path}/documents"), counts
