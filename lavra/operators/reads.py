"""Reads and guards around jobs: comparisons, analyses of a document, proposals, requests, feedback, and agents' findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.operators import tables

# Types and states.
PROPOSAL, REFERENCE, PENDING, RUNNING, ASSISTANT = "proposta", "tr", "pending", "running", "assistant"


def comparisons(jobs: DataFrame, results: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Jobs (id, ...) with their number of results and the distinct suppliers of these, by name (an array, empty without any).

    results: comparacao_id, fornecedor_id; suppliers: id, nome. A result of an unknown supplier counts but names nobody.
    """
    pairs = results.groupBy("comparacao_id", "fornecedor_id").agg(F.count("*").alias("n"))
    named = pairs.join(suppliers.select(F.col("id").alias("fornecedor_id"), "nome"), "fornecedor_id", "left")
    known = F.when(F.col("nome").isNotNull(), F.struct("nome", F.col("fornecedor_id").alias("id")))
    read = named.groupBy(F.col("comparacao_id").alias("id")).agg(F.sum("n").alias("total_resultados"), F.array_sort(F.collect_list(known)).alias("fornecedores"))
    none = F.array().cast(read.schema["fornecedores"].dataType)
    return jobs.join(read, "id", "left").withColumns({"total_resultados": F.coalesce("total_resultados", F.lit(0)), "fornecedores": F.coalesce("fornecedores", none)})


def proposal_problems(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """Proposals asked for (comparacao_id, ord, proposta_id) with what speaks against them; null if nothing.

    documents: id, document_type, fornecedor_id. A supplier takes part once, with its first proposal.
    """
    found = wanted.join(documents.select(F.col("id").alias("proposta_id"), "document_type", "fornecedor_id"), "proposta_id", "left")
    good = (F.col("document_type") == PROPOSAL) & F.col("fornecedor_id").isNotNull()
    nth = F.row_number().over(Window.partitionBy("comparacao_id", "fornecedor_id", F.coalesce(good, F.lit(False))).orderBy("ord", "proposta_id"))
    problem = F.when(F.coalesce(F.col("document_type") != PROPOSAL, F.lit(True)), "not a proposal").when(F.col("fornecedor_id").isNull(), "no supplier").when(nth > 1, "supplier twice")
    return found.withColumn("problem", problem).select("comparacao_id", "ord", "proposta_id", "problem")


def diff_problems(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """Comparisons of two documents asked for (before_id, after_id) with what speaks against them; null if nothing.

    documents: id, document_type. Both must exist and be reference documents; the first that fails is named.
    """
    sides = documents.select("id", "document_type")
    found = wanted
    for side in ("before", "after"):
        found = found.join(sides.select(F.col("id").alias(f"{side}_id"), F.col("document_type").alias(f"__{side}"), F.lit(True).alias(f"__{side}_there")), f"{side}_id", "left")
    problem = F.lit(None).cast("string")
    for side in ("after", "before"):
        problem = F.when(F.col(f"__{side}_there").isNull(), f"no such document: {side}").when(~F.coalesce(F.col(f"__{side}") == REFERENCE, F.lit(False)), f"not a reference document: {side}").otherwise(problem)
    return found.select("before_id", "after_id", problem.alias("problem"))


def start_requests(requests: DataFrame, analyses: DataFrame) -> DataFrame:
    """(document_id, analysis_id, outcome) of requests to start an analysis: a running one refuses, a pending one is queued again, else a new one is created.

    analyses: id, document_id, status.
    """
    state = analyses.filter(F.col("status").isin(PENDING, RUNNING)).groupBy("document_id").agg(
        F.min(F.when(F.col("status") == RUNNING, F.col("id"))).alias("__running"), F.min(F.when(F.col("status") == PENDING, F.col("id"))).alias("__pending")
    )
    outcome = F.when(F.col("__running").isNotNull(), "refused").when(F.col("__pending").isNotNull(), "queued again").otherwise("created")
    return requests.join(state, "document_id", "left").select("document_id", F.coalesce("__running", "__pending").alias("analysis_id"), outcome.alias("outcome"))


def with_feedback(messages: DataFrame, votes: DataFrame) -> DataFrame:
    """Messages (id, role, ...) with the last vote (message_id, ord, rating, comment) on them; only answers take votes."""
    last = votes.groupBy(F.col("message_id").alias("id")).agg(F.max_by(F.struct("rating", "comment"), "ord").alias("__vote"))
    takes = F.col("role") == ASSISTANT
    joined = messages.join(last, "id", "left")
    return joined.withColumns({f"feedback_{c}": F.when(takes, F.col(f"__vote.{c}")) for c in ("rating", "comment")}).drop("__vote")


def refused_feedback(messages: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes on messages that don't exist or aren't answers, with the reason."""
    asked = votes.join(messages.select(F.col("id").alias("message_id"), "role"), "message_id", "left")
    reason = F.when(F.col("role").isNull(), "no such message").when(F.col("role") != ASSISTANT, "not an answer")
    return asked.withColumn("reason", reason).filter("reason is not null").drop("role")


def document_analyses(analyses: DataFrame, corrections: DataFrame, order: list[str]) -> DataFrame:
    """Analyses (id, document_id, created_at, ...) with their corrections as an ordered array; `nth` is 1 for a document's newest."""
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("created_at"), "id"))
    return tables.nested(analyses.withColumn("nth", nth), corrections, "analysis_id", order, "corrections")


def agent_findings(items: DataFrame, key: str) -> DataFrame:
    """(key, agent, ord, finding) of all agents of an item, in their order; an agent whose result is null failed and is skipped.

    items: key, agents (array), results (array of arrays of findings, at the agents' positions).
    """
    each = items.select(key, F.posexplode(F.arrays_zip("agents", "results")).alias("place", "pair")).filter(F.col("pair.results").isNotNull())
    flat = each.select(key, "place", F.col("pair.agents").alias("agent"), F.posexplode("pair.results").alias("inner", "finding"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("place", "inner"))
    return flat.select(key, "agent", nth.alias("ord"), "finding")


def whole_text(items: DataFrame, key: str) -> DataFrame:
    """(key, text): titles and contents of a document's items in their order, nulls as empty."""
    part = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    listed = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("item_order", part.alias("part")))).alias("parts"))
    return listed.select(key, F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("text"))


def has_vectors(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: whether any chunk has a vector, so that a search may use them."""
    return chunks.agg(F.coalesce(F.bool_or(F.col(vector).isNotNull() & (F.size(vector) > 0)), F.lit(False)).alias("available"))


def item_by_number(items: DataFrame, document_id: Column, number: Column) -> DataFrame:
    """The items of a document with exactly this number."""
    return items.filter((F.col("document_id") == document_id) & (F.col("item_number") == number))


def json_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines, replacing an earlier one."""
    report.write.mode("overwrite").json(path)
