"""Grounded chat: sources of an answer, and the checks that an answer must pass."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra import schemas, storage
from lavra.functions.text import snippet, strip
from lavra.operators.analysis import recovered_object
from lavra.operators.tables import first_rows

# The answer in place of a refused one, and the reasons for refusing.
REFUSAL = (
    "Não encontrei fontes suficientes para responder essa pergunta com segurança. Reformule a pergunta ou pergunte sobre itens específicos do documento analisado."
)
FAILURE = "Não foi possível processar sua pergunta agora. Tente novamente em instantes."
INVALID, REFUSED, EMPTY, UNCITED, FAILED = "resposta-invalida", "recusa-llm", "resposta-vazia", "sem-citacao", "falha-llm"
MAX_SOURCES = 8


def legal_sources(hits: DataFrame, key: str) -> DataFrame:
    """Citations of retrieved chunks: key, ord, type, reference, title, snippet. hits: key, rank, law_number, law_title, article, text."""
    reference = F.rtrim(F.concat(F.coalesce("law_number", F.lit("")), F.lit(", "), F.coalesce("article", F.lit(""))), F.lit(", "))
    return hits.select(key, F.col("rank").cast("long").alias("ord"), F.lit("legal").alias("type"), reference.alias("reference"), F.coalesce("law_title", F.lit("")).alias("title"), snippet(F.col("text")).alias("snippet"))


def analysis_sources(analyses: DataFrame, key: str) -> DataFrame:
    """The analysis' opinion, or its status and score. analyses: key, id, final_opinion, status, score_overall."""
    fallback = F.concat(F.lit("Status: "), F.col("status"), F.lit(" · Nota geral: "), F.coalesce(F.col("score_overall").cast("string"), F.lit("None")))
    text = F.coalesce(F.nullif("final_opinion", F.lit("")), fallback)
    return analyses.select(key, F.lit(0).cast("long").alias("ord"), F.lit("analysis").alias("type"), F.concat(F.lit("Análise "), F.col("id").cast("string")).alias("reference"), F.lit("Análise do documento").alias("title"), snippet(text).alias("snippet"))


def correction_sources(corrections: DataFrame, key: str, order: str, most: int = MAX_SOURCES) -> DataFrame:
    """The first corrections of an analysis."""
    text = F.coalesce(F.nullif("suggested_text", F.lit("")), F.col("justification"))
    rows = corrections.select(key, F.col(order).cast("long").alias("ord"), F.lit("correction").alias("type"), F.concat_ws(" · ", F.lit("Correção"), "category", "severity").alias("reference"), F.col("problem").alias("title"), snippet(text).alias("snippet"))
    return limited(rows, key, ["ord"], most)


def item_sources(items: DataFrame, key: str) -> DataFrame:
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Item do documento"))
    return items.select(key, F.lit(0).cast("long").alias("ord"), F.lit("document_item").alias("type"), F.concat(F.lit("Item "), F.col("item_number")).alias("reference"), title.alias("title"), snippet(F.col("content")).alias("snippet"))


def limited(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__nth", nth).filter(F.col("__nth") <= most).drop("__nth")


def assembled(legs: list[DataFrame], key: str, most: int = MAX_SOURCES) -> DataFrame:
    """Sources of all legs in their order, the first of equal type and reference, limited; `ord` counts from 1."""
    from pyspark.sql import Window

    both = reduce(DataFrame.unionByName, (leg.withColumn("leg", F.lit(i)) for i, leg in enumerate(legs)))
    once = first_rows(both, [key, "type", "reference"], ["leg", "ord"])
    nth = F.row_number().over(Window.partitionBy(key).orderBy("leg", "ord"))
    return once.withColumn("ord", nth).filter(F.col("ord") <= most).drop("leg")


CITED = "ord long, type string, reference string, title string, snippet string"


def isolated(spark: SparkSession, make: Callable[[], DataFrame], key: str, kind: str) -> DataFrame:
    """A leg of sources; one that can't be planned or computed is an empty leg, and the others stand."""
    try:
        return storage.stored(make(), storage.folder(spark, "leg"))
    except (PySparkException, Py4JError, OSError) as e:
        logging.getLogger(__name__).warning("a leg of sources failed: %s", str(e).splitlines()[0] if str(e) else type(e).__name__)
        return spark.createDataFrame([], f"`{key}` {kind}, {CITED}")


class ChatLog:
    """Messages of conversations in a folder: each turn's question and answer once, whatever is sent again.

    A batch of turns has a number; sent again, it replaces itself. A turn that another batch has already is left out.
    """

    TURN = ["conversation_id", "turn"]
    SCHEMA = f"conversation_id long, turn long, role string, content string, sources array<struct<{schemas.CITATION.replace(' ', ':').replace(',:', ',')}>>, grounded boolean, confidence double, provider string, warning string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame:
        return storage.read_or_empty(self.spark, self.path, f"{self.SCHEMA}, batch int")

    def read(self) -> DataFrame:
        """The messages; of a turn that two batches brought at the same time, the first batch's."""
        return first_rows(self._all(), [*self.TURN, "role"], ["batch"]).drop("batch")

    def append(self, turns: DataFrame, number: int) -> None:
        """turns: conversation_id, turn, text, and an answer's content, citations, grounded, confidence, provider, reason."""
        there = self._all().filter(F.col("batch") != number).select(*self.TURN).distinct()
        new = turns.join(there, self.TURN, "left_anti")
        citations = F.array().cast(new.schema["citations"].dataType)
        asked = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"), citations.alias("sources"), F.lit(None).cast("boolean").alias("grounded"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("warning"))
        told = F.struct(F.lit("assistant").alias("role"), "content", F.col("citations").alias("sources"), "grounded", "confidence", F.col("provider").cast("string").alias("provider"), F.col("reason").alias("warning"))
        both = new.select(*(F.col(c).cast("long") for c in self.TURN), F.inline(F.array(asked, told)))
        both.write.mode("overwrite").parquet(f"{self.path}/batch={number}")


def source_block(sources: DataFrame, key: str) -> DataFrame:
    """Sources as the text of a prompt."""
    line = F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("] tipo="), F.col("type"), F.lit(" | reference="), F.col("reference"), F.lit("\n    titulo="), F.col("title"), F.lit("\n    trecho="), F.col("snippet"))
    listed = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("lines"))
    return listed.select(key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("sources"))


def context_block(context: Column) -> Column:
    """A map of context as lines of a prompt, keys in order."""
    lines = F.transform(F.array_sort(F.map_entries(F.map_filter(context, lambda _, v: v.isNotNull()))), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("(sem contexto específico)"))


ANSWER = f"refused string, reason string, answer string, grounded string, confidence string, citations array<struct<{schemas.CITATION.replace(' ', ':').replace(',:', ',')}>>"


def validated(answers: DataFrame, raw: str = "raw", grounding: bool = True, failed: str | None = None) -> DataFrame:
    """Answers with content, grounded, confidence, citations, refused and reason; what fails a check becomes a refusal.

    failed: a column that tells where the provider itself failed.
    """
    text = recovered_object(F.col(raw))
    data = F.from_json(text, ANSWER)
    whitelist = schemas.DOMAINS["citation_type"]
    citations = F.filter(F.coalesce(data["citations"], F.array().cast(f"array<struct<{schemas.CITATION.replace(' ', ':').replace(',:', ',')}>>")), lambda c: c.isNotNull() & c["type"].isin(*whitelist))
    citations = F.transform(citations, lambda c: F.struct(c["type"].alias("type"), *(F.coalesce(c[f], F.lit("")).alias(f) for f in ("reference", "title", "snippet"))))
    # A string in quotes is no answer unless it is one: JSON of other types doesn't count.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.answer", "variant"))
    answer = F.when(kind == "STRING", strip(F.coalesce(data["answer"], F.lit("")))).otherwise("")
    number = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), "$.confidence", "variant"))
    confidence = F.when(number.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), data["confidence"].try_cast("double"))))
    reason = (
        F.when(F.col(failed) if failed else F.lit(False), FAILED)
        .when(text.isNull(), INVALID)
        .when(data["refused"] == "true", F.coalesce(F.nullif(data["reason"], F.lit("")), F.lit(REFUSED)))
        .when(answer == "", EMPTY)
        .when(F.lit(grounding) & (F.size(citations) == 0), UNCITED)
    )
    refused = reason.isNotNull()
    empty = F.array().cast(f"array<struct<{schemas.CITATION.replace(' ', ':').replace(',:', ',')}>>")
    truthy = F.coalesce(~data["grounded"].isin("false", "0", ""), F.lit(False))
    return answers.withColumns(
        {
            "content": F.when(reason == FAILED, FAILURE).when(refused, REFUSAL).otherwise(answer),
            "grounded": F.when(refused, False).otherwise(truthy),
            "confidence": F.when(~refused, confidence),
            "citations": F.when(refused, empty).otherwise(citations),
            "refused": refused,
            "reason": reason,
        }
    )
