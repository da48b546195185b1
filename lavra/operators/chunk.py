"""Chunking of legal texts: by article, or by packing paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import article_reference, strip

# Structure marks of a law.
SECTION = r"^(TÍTULO|CAPÍTULO|SEÇÃO|SUBSECÇÃO)\s+[IVXLCDM0-9]+"
ARTICLE = r"^Art\.\s*[0-9]+[º\-A-Z]?"
SECTION_NAME = r"^[A-ZÀ-Ú\s]+$"
FOOTER = "Este texto não substitui o publicado no DOU"
CHUNK_CHARS = 1500


def kept_lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")


def before_footer(lines: Column) -> Column:
    """The lines before the first one with the footer mark."""
    at = F.call_function("array_position", F.transform(lines, lambda x: F.contains(x, F.lit(FOOTER))), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines)


def law_chunks(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One chunk per article with its paragraphs: key, chunk_index, article, section, chunk_text.

    What stands before the first article is skipped. A chunk has the section
    that is current where its article opens; a line of capitals after a section
    mark, before the first article, is part of the section's name. A law's lines
    stay an array in its row, from which the articles are cut: no shuffle.
    """
    mark = lambda x: x.rlike(SECTION)
    places = lambda test: F.filter(F.transform("lines", lambda x, i: F.when(test(x), i + 1)), lambda i: i.isNotNull())
    laws = texts.select(key, kept_lines(F.col(text)).alias("lines")).select(key, before_footer(F.col("lines")).alias("lines"))
    laws = laws.select(key, "lines", places(lambda x: x.rlike(ARTICLE)).alias("opens"), places(mark).alias("marks"))

    def section(at: Column) -> Column:
        own = F.try_element_at(F.filter("marks", lambda m: m < at), F.lit(-1))
        first = F.get("opens", F.lit(0))
        names = F.when(own < first, F.filter(F.slice("lines", own + 1, first - own - 1), lambda x: x.rlike(SECTION_NAME))).otherwise(F.array().cast("array<string>"))
        return F.when(own.isNull(), "").otherwise(F.array_join(F.concat(F.array(F.get("lines", own - 1)), names), " - "))

    def article(at: Column, nth: Column) -> Column:
        body = F.slice("lines", at, F.coalesce(F.get("opens", nth + 1), F.size("lines") + 1) - at)
        return F.struct(
            nth.alias("chunk_index"), article_reference(F.get("lines", at - 1)).alias("article"), section(at).alias("section"), F.array_join(F.filter(body, lambda x: ~mark(x)), "\n").alias("chunk_text")
        )

    return laws.select(key, F.inline(F.transform("opens", article)))


def packed(paragraphs: Column, limit: int = CHUNK_CHARS) -> Column:
    """Paragraphs packed greedily: a chunk closes before the paragraph that would bring it beyond the limit."""
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(state: Column, p: Column) -> Column:
        full = (F.size(state["open"]) > 0) & (state["size"] + F.length(p) > limit)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(state["open"], F.array(p))).alias("open"),
            (F.when(full, 0).otherwise(state["size"]) + F.length(p) + 1).alias("size"),
        )

    def close(state: Column) -> Column:
        return F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])

    return F.aggregate(paragraphs, empty, step, close)


def paragraph_chunks(texts: DataFrame, key: str = "doc_id", text: str = "text", limit: int = CHUNK_CHARS) -> DataFrame:
    """`Trecho n` chunks of packed paragraphs; lines that start with # are headers and skipped."""
    before = before_footer(F.filter(kept_lines(F.col(text)), lambda x: ~x.startswith("#")))
    chunks = texts.select(key, F.posexplode(packed(before, limit)).alias("chunk_index", "lines"))
    return chunks.select(key, "chunk_index", F.concat(F.lit("Trecho "), (F.col("chunk_index") + 1).cast("string")).alias("article"), F.lit("").alias("section"), F.array_join("lines", "\n").alias("chunk_text"))


def header(text: Column, stem: Column, prefix: str = "") -> tuple[Column, Column]:
    """(id, title) from lines that start with #: a line `título: …` is the title, the first other one the id.

    A file without them is named by its stem.
    """
    marks = F.transform(F.filter(F.split(text, "\n"), lambda x: x.startswith("#")), lambda x: strip(F.ltrim(x, F.lit("# "))))
    titled = F.element_at(F.concat(F.array(F.lit("")), F.filter(marks, lambda x: F.lower(x).startswith("título"))), -1)
    title = F.when(F.contains(titled, F.lit(":")), strip(F.regexp_extract(titled, r"(?s)^[^:]*:(.*)$", 1))).otherwise(titled)
    number = F.get(F.filter(marks, lambda x: (x != "") & ~F.lower(x).startswith("título")), F.lit(0))
    return F.coalesce(number, F.concat_ws(" ", F.lit(prefix or None), stem)), F.coalesce(F.nullif(title, F.lit("")), stem)
