"""An analysis from its items to its scores: all agents are asked about all items, what they find meets again, is reviewed, and is scored.

The calls are rows, one for each item and agent. Their answers are stored by
attempt, failures included, so a retry asks only what has no answer yet, and
everything after is a function of items and stored answers. An answer may be
asked for again by a task that runs twice; the first stored one counts.

In an analysis of several agents a failed or unreadable answer is one without
findings, and the item counts as analysed; in one of a single agent a failed call
skips the item. An analysis of which no item was analysed is an error. Missing
texts are empty; an analysis without items completes nothing and is an error too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavra import prompts, providers, schemas, storage
from lavra.operators import analysis

MULTI = "multi_agent"
ITEM, CALL = ["analysis_id", "item_id"], ["analysis_id", "item_id", "agent"]
#: Findings of a prompt for scores at most.
SUMMARY_LINES = 50
# What an analysis without any analysed item says.
NOTHING_ANALYSED = "Nenhum item pôde ser analisado: todos os provedores LLM falharam (verifique quota/limites das chaves Gemini e Groq)."


def calls(items: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """(analysis_id, item_id, agent, system, user): what every agent of an item's analysis is asked.

    items: analysis_id, item_id, item_order, mode, item_number, title, page_number, content; contexts: item's key and context.
    """
    known = with_context(items, contexts)
    entry = lambda name: F.struct(F.lit(name).alias("agent"), F.lit(prompts.agent_system(name)).alias("system"))
    agents = F.when(F.col("mode") == MULTI, F.array(*(entry(a) for a in prompts.AGENTS))).otherwise(F.array(entry(prompts.SINGLE)))
    return known.select(*ITEM, prompts.item_user(F.col("context")).alias("user"), F.inline(agents)).select(*CALL, "system", "user")


def with_context(items: DataFrame, contexts: DataFrame | None) -> DataFrame:
    return items.withColumn("context", F.lit(None).cast("string")) if contexts is None else items.join(contexts.select(*ITEM, "context"), ITEM, "left")


class Answers:
    """Answers to calls in a folder, an attempt after the other."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], kinds: DataFrame):
        named = ", ".join(f"`{k}` {kinds.schema[k].dataType.simpleString()}" for k in keys)
        self.spark, self.path, self.keys = spark, path, keys
        self.schema = f"{named}, ok boolean, answer string, error string"

    def attempts(self) -> DataFrame:
        return storage.read_or_empty(self.spark, self.path, f"{self.schema}, attempt int")

    def read(self) -> DataFrame:
        """One row for each call that was made: its first answer, or without any the error of its last attempt."""
        first = F.struct(~F.col("ok"), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt")))
        best = self.attempts().groupBy(*self.keys).agg(F.min_by(F.struct("ok", "answer", "error"), first).alias("best"))
        return best.select(*self.keys, "best.*")

    def ask(self, asked: DataFrame, make: Callable[[], providers.TextProvider], attempt: int) -> None:
        """Make the calls that have no answer yet. The same attempt again replaces what it has left."""
        earlier = self.attempts().filter(F.col("ok") & (F.col("attempt") != attempt)).select(*self.keys).distinct()
        missing = asked.join(earlier, self.keys, "left_anti").repartition(*self.keys)  # an analysis with many items is spread
        providers.generate(missing, self.keys, make).write.mode("overwrite").parquet(f"{self.path}/attempt={attempt}")


def _listed(answer: Column) -> Column:
    """The findings of the list in an answer, what is no object as null; null if it is no list."""
    kind = f"struct<{schemas.CORRECTION.replace(' ', ':').replace(',:', ',')}>"
    listed = F.try_variant_get(F.try_parse_json(analysis.recovered_json(answer)), "$", "array<variant>")
    return F.transform(listed, lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$", kind)))


def findings(items: DataFrame, answers: DataFrame) -> DataFrame:
    """analysis_id, item_id, correction_index (from 0 within the item), agent, and the fields of a finding.

    Of several agents' equal findings the first agent's stays, each has its agent's category, and an answer with
    anything but objects is void; a single agent's keep theirs, and what is no object is left out.
    """
    place = F.array_position(F.array(*(F.lit(a) for a in prompts.AGENTS)), F.col("agent"))
    many = place > 0
    read = answers.filter("ok").withColumn("found", _listed(F.col("answer"))).filter(~many | ~F.exists("found", lambda x: x.isNull()))
    each = read.select(*CALL, place.alias("place"), F.posexplode("found").alias("nth", "finding")).filter("finding is not null").select(*CALL, "place", "nth", "finding.*")
    usable = each.filter(analysis.complete({c: F.col(c) for c in analysis.REQUIRED}))
    clean = analysis.sanitized(usable)
    category = F.col("category")
    for agent, (own, _) in prompts.AGENTS.items():
        category = F.when(F.col("agent") == agent, own).otherwise(category)
    clean = analysis.tagged(clean, category, F.when(many, F.col("agent"))).withColumn("rank", F.struct("place", "nth"))
    original, problem = (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("original_text", "problem"))
    same = Window.partitionBy(*ITEM, F.sha2(original, 256), F.sha2(problem, 256)).orderBy("rank")
    once = clean.withColumn("again", (F.row_number().over(same) > 1) & many & (original != "") & (problem != "")).filter("not again")
    index = F.row_number().over(Window.partitionBy(*ITEM).orderBy("rank")) - 1
    fields = [c.split()[0] for c in schemas.CORRECTION.split(", ")]
    return once.join(items.select(*ITEM), ITEM, "left_semi").select(*ITEM, index.alias("correction_index"), "agent", *fields)


def statuses(items: DataFrame, answers: DataFrame) -> DataFrame:
    """analysis_id, status, total_items, analyzed_items and error_message of every analysis with items."""
    made = answers.groupBy(*ITEM).agg(F.count("*").alias("made"), F.bool_or("ok").alias("any_ok"))
    wanted = F.when(F.col("mode") == MULTI, len(prompts.AGENTS)).otherwise(1)
    joined = items.join(made, ITEM, "left").withColumn("asked", F.coalesce(F.col("made") >= wanted, F.lit(False)))
    done = F.col("asked") & ((F.col("mode") == MULTI) | F.col("any_ok"))
    counted = joined.groupBy("analysis_id").agg(F.count("*").alias("total_items"), F.count_if(F.coalesce(done, F.lit(False))).alias("analyzed_items"), F.bool_and("asked").alias("asked"))
    status = F.when(~F.col("asked"), "running").when(F.col("analyzed_items") == 0, "error").otherwise("completed")
    message = F.when(F.col("status") == "error", NOTHING_ANALYSED)
    return counted.withColumn("status", status).select("analysis_id", "status", "total_items", "analyzed_items", message.alias("error_message"))


def review_calls(items: DataFrame, found: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """(analysis_id, item_id, system, user): the reviewer's prompt for every item with findings."""
    line = F.struct("correction_index", prompts.finding_line("correction_index").alias("line"))
    listed = found.groupBy(*ITEM).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    joined = with_context(items, contexts).join(listed, ITEM)
    summary = F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")
    return joined.select(*ITEM, F.lit(prompts.REVIEWER).alias("system"), prompts.review_user(F.col("context"), summary).alias("user"))


def decisions(answers: DataFrame) -> DataFrame:
    """analysis_id, item_id, ord and the fields of each decision in the reviewers' answers.

    An answer may wrap its decisions in `review` or be the list itself; anything else decides nothing, and what is no
    object in a list is left out. An index that is no whole number is 0, one in quotes counts; null is as if missing.
    """
    whole = F.try_parse_json(analysis.recovered_json(F.col("answer")))
    listed = F.coalesce(F.try_variant_get(whole, "$.review", "array<variant>"), F.try_variant_get(whole, "$", "array<variant>"))
    each = answers.filter("ok").select(*ITEM, F.posexplode(listed).alias("ord", "decision")).filter(F.schema_of_variant("decision").startswith("OBJECT"))
    text = lambda name: F.try_variant_get("decision", f"$.{name}", "string")
    number = F.try_variant_get("decision", "$.correction_index", "double")
    index = F.when(text("correction_index").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text("correction_index")).try_cast("int")).when(~F.schema_of_variant(F.try_variant_get("decision", "$.correction_index", "variant")).isin("STRING"), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("int"))
    return each.select(
        *ITEM, "ord", F.lower(text("status")).alias("status"), F.coalesce(index, F.lit(0)).alias("correction_index"), F.nullif(text("note"), F.lit("")).alias("note"),
        *(F.nullif(F.trim(text(c)), F.lit("")).alias(c) for c in ("adjusted_suggested_text", "adjusted_justification")),
    )


def reviewed(found: DataFrame, answers: DataFrame) -> DataFrame:
    """The findings with review_status, review_note and adjusted texts. A failed or unreadable review leaves them pending."""
    sizes = found.groupBy(*ITEM).agg(F.count("*").cast("int").alias("size"))
    usable = analysis.decisions(decisions(answers).join(sizes, ITEM), F.col("size"))
    return analysis.reviewed(found, usable, ITEM)


def scoring_calls(statuses_: DataFrame, kept: DataFrame) -> DataFrame:
    """(analysis_id, system, user): the scorer's prompt for every completed analysis, with its first findings in the items' order."""
    done = statuses_.filter("status = 'completed'")
    numbered = kept.select("analysis_id", F.struct("item_order", "item_id", "correction_index").alias("at"), prompts.score_line().alias("line"))
    # Only the first lines of an analysis are gathered, however many it has.
    nth = F.row_number().over(Window.partitionBy("analysis_id").orderBy("at"))
    first = numbered.withColumn("nth", nth).filter(F.col("nth") <= SUMMARY_LINES)
    summary = analysis.numbered_summary(first, "analysis_id", "nth", F.col("line"), SUMMARY_LINES)
    total = kept.groupBy("analysis_id").agg(F.count("*").alias("n"))
    joined = done.join(summary, "analysis_id", "left").join(total, "analysis_id", "left")
    user = prompts.scoring_user(F.col("summary"), F.col("total_items"), F.coalesce("n", F.lit(0)))
    return joined.select("analysis_id", F.lit(prompts.SCORER).alias("system"), user.alias("user"))


SCORES = "score_overall double, score_juridical double, score_technical double, score_writing double, score_structural double, risk_level string, final_opinion string"


def scored(statuses_: DataFrame, kept: DataFrame, answers: DataFrame) -> DataFrame:
    """analysis_id, the five scores, risk_level, final_opinion and `fallback` of every completed analysis.

    A scorer's list counts with its first entry. Without an object, or without an overall score above or below 0, the scores follow from the findings.
    """
    found = analysis.recovered_json(F.col("answer"))
    first = F.when(found.rlike(r"(?s)^\s*\["), F.get_json_object(found, "$[0]")).otherwise(found)
    told = answers.select("analysis_id", F.from_json(F.when(F.col("ok") & first.rlike(r"(?s)^\s*\{"), first), SCORES).alias("told"))
    told = told.withColumn("good", F.coalesce(F.col("told.score_overall") != 0, F.lit(False)))
    done = statuses_.filter("status = 'completed'").select("analysis_id")
    own = analysis.fallback_scores(kept, "analysis_id", done)
    names = {"score_juridical": "score_juridica", "score_technical": "score_tecnica", "score_writing": "score_redacao", "score_structural": "score_estrutural", "score_overall": "score_overall"}
    total = kept.groupBy("analysis_id").agg(F.count("*").alias("n"))
    opinion = F.format_string(
        "Análise concluída com %s apontamento(s) de atenção formulados pelos 4 agentes especialistas. Pontuação consolidada do Termo de Referência: %s/10. Nível de Risco Global: %s.",
        F.coalesce("n", F.lit(0)).cast("string"), F.col("own_overall").cast("string"), F.upper("own_risk"),
    )
    joined = done.join(own.select("analysis_id", *(F.col(c).alias(f"own_{n[6:]}") for n, c in names.items()), F.col("risk_level").alias("own_risk")), "analysis_id").join(told, "analysis_id", "left").join(total, "analysis_id", "left")
    good = F.coalesce("good", F.lit(False))
    pick = lambda theirs, ours: F.when(good, theirs).otherwise(ours)
    return joined.select(
        "analysis_id", *(pick(F.col(f"told.{n}"), F.col(f"own_{n[6:]}").cast("double")).alias(n) for n in names),
        pick(F.coalesce("told.risk_level", F.lit("medio")), F.col("own_risk")).alias("risk_level"), pick(F.coalesce("told.final_opinion", F.lit("")), opinion).alias("final_opinion"), (~good).alias("fallback"),
    )
