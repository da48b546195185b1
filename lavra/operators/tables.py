"""Table operators: listing, upsert, cascades, guards, and status changes.

Parquet has no row updates; a change is a frame of the new table, written as a
whole or by partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra import storage


def page(table: DataFrame, order: list[Column], number: int = 1, size: int = 50, most: int = 200) -> DataFrame:
    """One page of an ordered listing; the order should end with a unique column."""
    size = min(max(size, 1), most)
    return table.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def upsert(table: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """The table with the rows of these keys replaced, and new ones added."""
    return table.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_if_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return table.unionByName(new.join(table.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """The table with columns set in the rows of a condition."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def duplicate_row(table: DataFrame, condition: Column, name: str, new_id: Column, key: str = "id") -> DataFrame:
    """The table and a copy of the rows of a condition, marked in their name."""
    copy = table.filter(condition).withColumns({key: new_id, name: F.concat(F.col(name), F.lit(" (Cópia)"))})
    return table.unionByName(copy)


def delete(table: DataFrame, gone: DataFrame, key: str, gone_key: str = "id") -> DataFrame:
    """The rows that don't refer to a deleted one; a step of a cascade."""
    return table.join(gone.select(F.col(gone_key).alias(key)).distinct(), key, "left_anti")


def cascade(gone: DataFrame, tables: dict[str, tuple[DataFrame, str, str]], key: str = "id") -> dict[str, DataFrame]:
    """Delete through foreign keys. tables: name -> (table, foreign key, name of the parent or empty for the root), parents first."""
    dropped: dict[str, DataFrame] = {"": gone.select(F.col(key).alias("id"))}
    out = {}
    for name, (table, foreign, parent) in tables.items():
        ids = dropped[parent].select(F.col("id").alias(foreign)).distinct()
        out[name] = table.join(ids, foreign, "left_anti")
        if "id" in table.columns:
            dropped[name] = table.join(ids, foreign, "left_semi").select("id")
    return out


def set_null_missing(child: DataFrame, parent: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """A foreign key that names no parent becomes null."""
    ids = parent.select(F.col(key).alias("__key")).distinct()
    joined = child.join(ids, child[foreign] == ids["__key"], "left")
    return joined.withColumn(foreign, F.when(F.col("__key").isNotNull(), F.col(foreign))).select(child.columns)


def in_use(table: DataFrame, users: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """Rows that others refer to and that a delete must refuse."""
    return table.join(users.select(F.col(foreign).alias(key)).distinct(), key, "left_semi")


def without_duplicates(table: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """Of the rows with equal keys, those of the smallest id."""
    first = table.groupBy(*keys).agg(F.min(key).alias(key))
    return table.join(first.select(key), key, "left_semi")


def first_rows(table: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """Of the rows with equal keys, the first."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def numbered(table: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """A sequence number from 0 within each key; the rows of a key meet in one task (`sequenced` deals them)."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def sequenced(table: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """As `numbered`, for keys of any size: rows are numbered within ranges of the order, and a range adds the rows of its key before it.

    Null keys are one key. Rows with equal keys and order lie in one range and are numbered in any order.
    """
    ranged = table.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id())
    ranged = storage.stored(ranged, storage.folder(table.sparkSession, "ranges"))  # so that a row's range stays the same
    sizes = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    nth = ranged.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)) - 1)
    same = nth["__range"] == before["__r"]
    for i, k in enumerate(keys):
        same = same & nth[k].eqNullSafe(before[f"__{i}"])
    return nth.join(before, same).withColumn(name, F.col("__before") + F.col("__nth")).select(*table.columns, name)


def nested(parents: DataFrame, children: DataFrame, foreign: str, order: list[str], name: str, key: str = "id") -> DataFrame:
    """Parents with their children as an ordered array (empty without any)."""
    fields = [c for c in children.columns if c not in (foreign, *order)]
    rows = children.groupBy(F.col(foreign).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias(name))
    return parents.join(rows, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType)))


def next_version(revisions: DataFrame, key: str = "document_id") -> DataFrame:
    return revisions.groupBy(key).agg((F.coalesce(F.max("versao"), F.lit(0)) + 1).alias("versao"))


def snapshot(items: DataFrame, revisions: DataFrame, label: Column, key: str = "document_id") -> DataFrame:
    """A new revision of every document: its next version and its items as an array."""
    kept = F.struct("item_order", "item_number", "title", "content", "page_number", "item_type")
    state = items.groupBy(key).agg(F.array_sort(F.collect_list(kept)).alias("items_snapshot"))
    version = F.coalesce(F.col("versao"), F.lit(1))
    return state.join(next_version(revisions, key), key, "left").select(key, version.alias("versao"), label.alias("rotulo"), "items_snapshot")


def restore(items: DataFrame, revision: DataFrame, key: str = "document_id") -> DataFrame:
    """Items with the content of a revision where the number matches; nothing is added, removed or renamed."""
    old = revision.select(key, F.explode("items_snapshot").alias("s")).select(key, F.col("s.item_number").alias("item_number"), F.struct(F.col("s.item_order").alias("o"), F.col("s.content").alias("c")).alias("old"))
    old = old.groupBy(key, "item_number").agg(F.max("old")["c"].alias("old"))
    return items.join(old, [key, "item_number"], "left").withColumn("content", F.coalesce("old", "content")).select(items.columns)


def revisions(saved: DataFrame, key: str = "document_id") -> DataFrame:
    """A document's revisions, newest first (`nth` is 1), with the number of their items in place of the items."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("versao")))
    return saved.select(key, "versao", "rotulo", F.size("items_snapshot").alias("n_items"), nth.alias("nth"))


def revision(saved: DataFrame, wanted: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, versao, found, and the items of) the revisions asked for; one that isn't there is a row without items."""
    got = wanted.join(saved.select(key, "versao", "items_snapshot"), [key, "versao"], "left")
    return got.select(key, "versao", F.col("items_snapshot").isNotNull().alias("found"), F.explode_outer("items_snapshot").alias("item")).select(key, "versao", "found", "item.*")


def upload_checks(files: DataFrame) -> DataFrame:
    """Uploads (path, length, content) with what speaks against them; null if nothing."""
    kind = F.coalesce(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    head = F.hex(F.substring("content", 1, 4))
    raw = F.decode("content", "ISO-8859-1")  # a byte a character; names of entries stand in an archive as they are
    odt = F.contains(raw, F.lit("mimetypeapplication/vnd.oasis.opendocument.text"))
    magic = F.when(kind == "pdf", head.startswith("25504446")).when(kind.isin("docx", "odt"), head.startswith("504B0304") & F.when(kind == "odt", odt).otherwise(~odt & F.contains(raw, F.lit("word/"))))
    problem = (
        F.when(~kind.isin("pdf", "docx", "odt"), "extension")
        .when(F.col("length") < 1, "empty")
        .when(F.col("length") > 50 * 1024 * 1024, "too large")
        .when(~F.coalesce(magic, F.lit(False)), "content doesn't match the extension")
    )
    return files.withColumns({"file_type": kind, "problem": problem})
