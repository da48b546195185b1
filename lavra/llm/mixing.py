"""Mix sources to target weights by subset-sum budget fitting.

Each source gets a word budget. Whole passes over a source are taken as often
as they fit; the remaining budget is fitted by document length: the documents
are counted by exact length, every length gets its share, with what a length
can't use carried on to the next shorter one, and a bounded knapsack closes the
gap, for which some of the share is given back in growing steps. Where a source
is too small for that, the passes are given back too: a document may come up to
MAX_REPEATS times while others are left out. Which documents of a length are
taken follows a seeded hash of their ids and texts, so reruns agree.

Defined results: a null or empty text has size 0 and takes no part; a very long
text is a document of its length; a null source is a source of its own that
sorts last; repeated rows count as rows, and rows alike in id and text are
interchangeable, as are ties of the hash; rows without doc_id are drawn by their
text; an empty table gives an empty result; other columns are ignored by `mix`
and kept by `materialise`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm import shared

#: No document is repeated more than this many times.
MAX_REPEATS = 3
#: Steps of the knapsack's budget; a larger one is counted in multiples of words, and what that leaves in another round.
KNAPSACK_STEPS = 1 << 16
#: Hash buckets that split the documents of one source and length.
BUCKETS = 1024


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(totals: list[int], weights: list[float], repeats: int = MAX_REPEATS) -> list[float]:
    """Targets that share the sum of totals by weight, none above `repeats` times its own total."""
    targets = [0.0] * len(totals)
    free, left = set(range(len(totals))), float(sum(totals))
    while free:
        weight = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / weight > repeats * totals[i]}
        if not above:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in above:
            targets[i] = float(repeats * totals[i])
        left -= sum(targets[i] for i in above)
        free -= above
    return targets


def fit_budget(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that the lengths add up to the budget or closely below.

    A share of every length is the start; its rounding is carried from length to
    length, so the gap stays below a document. Where the rest can't close it,
    some of the share is given back, from the shortest lengths on and in growing
    steps until all is, and fitted anew. Up to KNAPSACK_STEPS words that is the
    best fit there is.
    """
    whole = sum(n * c for n, c in counts.items())
    if budget >= whole:
        return dict(counts)
    order = sorted((n for n in counts if n), reverse=True)
    share, carry = dict.fromkeys(counts, 0), 0
    for n in order:
        due = counts[n] * n * budget + carry  # in words times `whole`
        share[n] = min(counts[n], due // (n * whole))
        carry = due - share[n] * n * whole
    best: dict[int, int] = {}
    missed, back = budget + 1, 0
    while missed:
        start, given = dict(share), 0
        for n in reversed(order):
            k = min(start[n], max(0, back - given) // n)
            start[n] -= k
            given += n * k
        taken = _close_gap(counts, start, budget - sum(n * k for n, k in start.items()))
        gap = budget - sum(n * k for n, k in taken.items())
        if gap < missed:
            best, missed = taken, gap
        if not any(start.values()):
            break
        back = max(order[-1], 4 * back)
    return best


def _close_gap(counts: dict[int, int], start: dict[int, int], gap: int) -> dict[int, int]:
    """The start with further documents that add up to the gap or closely below."""
    taken = dict(start)
    order = sorted((n for n in counts if n), reverse=True)
    while gap >= (order[-1] if order else gap + 1):
        # Bounded knapsack: bit b of `reach` tells whether b steps can be had from the lengths so far.
        step = -(-gap // KNAPSACK_STEPS)
        most = gap // step
        parts: list[tuple[int, int, int]] = []
        reach, history, mask = 1, [], (1 << (most + 1)) - 1
        for n in order:
            cost = -(-n // step)
            spare, k = min(counts[n] - taken[n], most // cost), 1
            while spare > 0 and not reach >> most & 1:
                k = min(k, spare)
                history.append(reach)
                parts.append((n, k, cost))
                reach |= (reach << (cost * k)) & mask
                spare, k = spare - k, k * 2
        best, before_gap = reach.bit_length() - 1, gap
        for (n, k, cost), before in zip(reversed(parts), reversed(history), strict=True):
            if not before >> best & 1:
                taken[n] += k
                best -= cost * k
                gap -= n * k
        if step == 1 or gap == before_gap:
            break
    return taken


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words, repeats counted) of every document.

    The weights repeat over the sources in code-point order. Only one total per
    source reaches the driver; budgets are fitted on executors, one task for the
    length counts of a source.
    """
    light = docs.select("doc_id", "text", "source")
    return _dealt(light, light, weights, repeats, seed).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def _sized(docs: DataFrame, seed: int, *kept: Column) -> DataFrame:
    """What the mix needs of a document, beside the kept columns."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    return docs.select("doc_id", "source", key.alias("key"), size_of(F.col("text")).alias("size"), draw.alias("draw"), F.pmod(draw, F.lit(BUCKETS)).cast("int").alias("bucket"), *kept)


def _dealt(docs: DataFrame, kept: DataFrame, weights: tuple[float, ...], repeats: int, seed: int) -> DataFrame:
    """The rows of `kept`, which are those of docs with more columns or without, with their copies."""
    sizes = shared.checkpoint(_sized(docs, seed))
    totals = {r["key"]: r["total"] for r in sizes.groupBy("key").agg(F.sum("size").alias("total")).collect()}
    names = sorted(totals, key=lambda k: (k[0] == "n", k))
    targets = dict(zip(names, share_out([totals[k] for k in names], [weights[i % len(weights)] for i in range(len(names))], repeats), strict=True))
    plan = [(k, int(totals[k]), float(targets[k]), int(targets[k] // totals[k]) if totals[k] else 0) for k in names]
    spark = docs.sparkSession
    budget = spark.createDataFrame(plan, "key string, source_size long, target double, passes int")
    passes_of = {k: passes for k, _, _, passes in plan}
    rest = {k: round(target) - passes * size for k, size, target, passes in plan}

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        name = group["key"].iloc[0]
        counts = dict(zip(group["size"].tolist(), group["n"].tolist(), strict=True))
        taken, base = fit_budget(counts, max(0, rest[name])), 0
        words = lambda chosen: sum(n * k for n, k in chosen.items())
        if words(taken) < rest[name]:
            # The whole passes are given back, and each document may come up to `repeats` times.
            size = words(counts)
            again = fit_budget({n: repeats * c for n, c in counts.items()}, rest[name] + passes_of[name] * size)
            if words(again) - passes_of[name] * size > words(taken):
                taken, base = again, -passes_of[name]
        return pd.DataFrame({"key": name, "size": list(taken), "base": [base + k // counts[n] for n, k in taken.items()], "picks": [k % counts[n] for n, k in taken.items()]})

    by_bucket = sizes.filter("size > 0").groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    by_length = by_bucket.groupBy("key", "size").agg(F.sum("n").alias("n"))
    picks = by_length.groupBy("key").applyInPandas(fit, "key string, size long, base int, picks long")
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    open_buckets = (
        by_bucket.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(picks, ["key", "size"])
        .select("key", "size", "bucket", "base", F.least("n", F.greatest(F.lit(0), F.col("picks") - F.col("before"))).alias("quota"))
    )
    nth = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("draw", "doc_id", *(["tie"] if "doc" in kept.columns else [])))
    rows = _sized(kept, seed, F.col("doc"), F.xxhash64("doc").alias("tie")) if "doc" in kept.columns else sizes
    chosen = rows.withColumn("nth", nth).join(open_buckets, ["key", "size", "bucket"], "left").join(F.broadcast(budget), "key")
    copies = F.col("passes") + F.coalesce("base", F.lit(0)) + F.when(F.col("nth") <= F.col("quota"), 1).otherwise(0)
    return chosen.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def materialise(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with its columns and the number of its copy."""
    packed = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("doc"))
    taken = _dealt(docs.select("doc_id", "text", "source"), packed, weights, repeats, seed).filter("copies > 0")
    number = "copy"
    while number in docs.columns:
        number += "_"
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("doc.*", F.col("nth").alias(number))
