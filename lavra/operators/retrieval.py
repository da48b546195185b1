"""Hybrid retrieval for batches of queries: BM25 over postings, cosine over vectors, reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lavra.functions.text import clean_query, quoted_term, tokens
from lavra.operators import textindex, vectorindex
from lavra.operators.ranking import B, K1, LEAST_IDF, RRF, TOP_K, doubles, top_k

LIKE_TERMS = 6
#: Numbers that the vectors and the queries of a tile hold at most, and queries that are multiplied at a time.
TILE_VECTORS, TILE_QUERIES, AT_A_TIME = 1 << 20, 1 << 19, 128


def postings(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, key, tf, dl): the text index, rebuilt as a whole. `dl` is the chunk's length in words."""
    words = chunks.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    flat = words.select(key, F.size("words").alias("dl"), F.explode("words").alias("term"))
    return flat.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, index: DataFrame, chunks: DataFrame, query_key: str, key: str, text: str = "text", query_text: str = "text") -> DataFrame:
    """(query_key, key, score) of all chunks with a query term; scores are negative, smaller is better.

    The queries' terms cut the postings down before anything is joined on chunks.
    """
    terms = queries.select(query_key, F.explode(F.array_distinct(tokens(clean_query(F.coalesce(F.col(query_text), F.lit("")))))).alias("term"))
    # Chunks without words count in the number of chunks and in the average length.
    stats = chunks.select(F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    used = index.join(terms.select("term").distinct(), "term", "left_semi")
    frequency = used.groupBy("term").agg(F.count("*").alias("df"))
    scored = used.join(frequency, "term").join(F.broadcast(stats))  # stats is one row
    raw_idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw_idf <= 0, LEAST_IDF).otherwise(raw_idf)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return terms.join(scored.select("term", key, weight.alias("weight")), "term").groupBy(query_key, key).agg((-F.sum("weight")).alias("score"))


def phrase_match(queries: DataFrame, chunks: DataFrame, query_key: str, key: str, term: str = "term", text: str = "text") -> DataFrame:
    """Chunks that hold a term's words one after the other; a term of several words is a phrase."""
    phrase = queries.select(query_key, F.concat(F.lit(" "), F.array_join(tokens(F.col(term)), " "), F.lit(" ")).alias("phrase"), F.explode(F.array_distinct(tokens(F.col(term)))).alias("word"))
    wanted = phrase.groupBy(query_key, "phrase").agg(F.count("*").alias("n"), F.collect_list("word").alias("words"))
    flat = chunks.select(key, F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("word"))
    holding = phrase.join(flat, "word").groupBy(query_key, "phrase", key).agg(F.count("*").alias("have")).join(wanted.select(query_key, "phrase", "n"), [query_key, "phrase"]).filter("have = n")
    spelled = chunks.select(key, F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(F.col(text), F.lit(""))), " "), F.lit(" ")).alias("spelled"))
    return holding.join(spelled, key).filter(F.contains("spelled", F.col("phrase"))).select(query_key, key)


def match_expression(terms: Column) -> Column:
    """Quoted terms joined by OR."""
    return F.array_join(F.transform(terms, quoted_term), " OR ")


def ilike(chunks: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Chunks that hold any of the first six terms; % and _ in a term stay wildcards."""
    terms = [t.replace("'", "") for t in query.split()][:LIKE_TERMS]
    terms = [t for t in terms if t]
    return chunks.filter(reduce(or_, (F.col(text).ilike(f"%{t}%") for t in terms))) if terms else chunks.limit(0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of doubles; 0 if one is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def semantic(queries: DataFrame, chunks: DataFrame, query_key: str, key: str, vector: str = "embedding", most_queries: int = 10_000) -> DataFrame:
    """(query_key, key, score) of every query with every chunk of the same dimension.

    The batch of queries is collected into blocks of an array literal only if it
    is no larger than `most_queries`; a scan of the chunks then scores all of them.
    """
    asked, there = F.col("__query"), F.col("__vector")
    small = queries.select(query_key, doubles(F.col(vector)).alias("__query")).filter("__query is not null").withColumn("__norm", F.sqrt(dot(asked, asked))).limit(most_queries + 1)
    if small.count() > most_queries:
        raise ValueError(f"more than {most_queries} queries; send them in batches")
    usable = chunks.filter(F.col(vector).isNotNull()).select(key, doubles(F.col(vector)).alias("__vector")).withColumn("__length", F.sqrt(dot(there, there)))
    pairs = usable.join(F.broadcast(small), F.size("__vector") == F.size("__query"))  # bounded by most_queries
    norms = F.col("__norm") * F.col("__length")
    return pairs.select(query_key, key, F.when(norms == 0, 0.0).otherwise(dot(asked, there) / norms).alias("score"))


def semantic_all(queries: DataFrame, chunks: DataFrame, query_key: str, key: str, vector: str = "embedding", most_queries: int = 10_000, depth: int = 0) -> DataFrame:
    """`semantic` for any number of queries: too many are halved by a hash of their key until each block is small enough."""
    if depth == 60 or queries.limit(most_queries + 1).count() <= most_queries:
        return semantic(queries, chunks, query_key, key, vector, most_queries)
    bit = F.shiftrightunsigned(F.xxhash64(query_key), depth).bitwiseAND(F.lit(1))
    return reduce(DataFrame.unionByName, (semantic_all(queries.filter(bit == side), chunks, query_key, key, vector, most_queries, depth + 1) for side in (0, 1)))


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded half away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits, x) + 0.0


def nearest(queries: DataFrame, chunks: DataFrame, query_key: str, key: str, bonus: str, k: int, vector: str = "embedding") -> DataFrame:
    """(query_key, key, score, bonus): of each query, all chunks that can be among the k best by score or by score and bonus.

    Every query meets every chunk with a vector of its width; the score is their cosine of six digits. Chunks and queries are dealt to tiles of
    bounded size. A tile multiplies two matrices and returns the k best of each query, so no row is made for a pair, and
    the shuffle grows with the number of tiles. Equal scores go by the key, a null bonus goes last; vectors that
    `vectorindex.usable` refuses take no part.
    """
    rows = chunks.filter(vectorindex.usable(vector)).select(key, vector, F.col(bonus).cast("double").alias("bonus"))
    asked = queries.filter(vectorindex.usable(vector)).select(query_key, vector)
    size = F.sum(F.size(vector).cast("long"))
    n_rows, n_asked = (max(1, -(-(x.agg(size).first()[0] or 0) // most)) for x, most in ((rows, TILE_VECTORS), (asked, TILE_QUERIES)))
    # Of the type of the sequences' numbers: cogroup casts no keys, and an int and a long of one value lie in different partitions.
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    left = asked.withColumn("b", deal(query_key, n_asked)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    right = rows.withColumn("a", deal(key, n_rows)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))

    def units(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By width: the places of the rows, and their vectors as units."""
        column = table.column(vector).combine_chunks()
        flat, widths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
        ends = np.cumsum(widths)
        places = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
        return {w: (at, vectorindex.unit(flat[(ends[at] - w)[:, None] + np.arange(w)])) for w, at in places.items()}

    def first(by: np.ndarray) -> np.ndarray:
        """For each row, a mask of its k largest; of values equal to the last one, the leftmost."""
        if by.shape[1] <= k:
            return np.ones(by.shape, bool)
        least = np.partition(by, -k, axis=1)[:, -k, None]
        above, ties = by > least, by == least
        return above | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))

    def tile(asked: pa.Table, there: pa.Table) -> pa.Table:
        schema = pa.schema([asked.schema.field(query_key), there.schema.field(key), ("score", pa.float64()), ("bonus", pa.float64())])
        if not asked.num_rows or not there.num_rows:
            return schema.empty_table()
        there = there.take(pc.sort_indices(there.column(key), null_placement="at_start"))
        mine, bonuses, found = units(there), there.column("bonus").to_numpy(), []
        for width, (at, x) in units(asked).items():
            if width not in mine:
                continue
            own, y = mine[width]
            more = np.nan_to_num(bonuses[own], nan=-np.inf)
            for i in range(0, len(at), AT_A_TIME):
                score = rounded(x[i : i + AT_A_TIME] @ y.T)
                q, c = np.nonzero(first(score) | first(rounded(score + more)))
                found.append(pa.table([asked.column(query_key).take(pa.array(at[i + q])), there.column(key).take(pa.array(own[c])), pa.array(score[q, c]), there.column("bonus").take(pa.array(own[c]))], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    shape = StructType([queries.schema[query_key], chunks.schema[key], StructField("score", DoubleType()), StructField("bonus", DoubleType())])
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(tile, shape)


def fuse(legs: list[DataFrame], query_key: str, key: str, k: int = TOP_K) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (query_key, key, rank, score), the first leg's score and place winning ties.

    `score` stays the score of the first leg that has the chunk; `rrf_score` is the fused one.
    """
    both = reduce(DataFrame.unionByName, (leg.select(query_key, key, "rank", "score").withColumn("leg", F.lit(i)) for i, leg in enumerate(legs)))
    place = F.struct("leg", "rank")
    fused = both.groupBy(query_key, key).agg(F.sum(1 / (RRF + F.col("rank"))).alias("rrf_score"), F.min_by("score", place).alias("score"), F.min(place).alias("place"))
    return top_k(fused, query_key, [F.round("rrf_score", 12).desc(), F.col("place"), F.col(key)], k).drop("place")


def like_hits(queries: DataFrame, chunks: DataFrame, query_key: str, key: str, text: str = "text", most_queries: int = 10_000, depth: int = 0) -> DataFrame:
    """(query_key, key, score 1) of chunks that hold any of a query's first terms, as `ilike` for many queries, in blocks of bounded size."""
    if depth < 60 and queries.limit(most_queries + 1).count() > most_queries:
        bit = F.shiftrightunsigned(F.xxhash64(query_key), depth).bitwiseAND(F.lit(1))
        return reduce(DataFrame.unionByName, (like_hits(queries.filter(bit == side), chunks, query_key, key, text, most_queries, depth + 1) for side in (0, 1)))
    terms = F.slice(F.split(clean_query(F.coalesce(F.col("text"), F.lit(""))), " "), 1, LIKE_TERMS)
    terms = F.filter(F.transform(terms, lambda t: F.replace(t, F.lit("'"), F.lit(""))), lambda t: t != "")
    patterns = F.transform(terms, lambda t: F.concat(F.lit("%"), F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("%")))
    asked = queries.select(query_key, patterns.alias("__patterns"))
    found = chunks.select(key, F.col(text).alias("__text")).join(F.broadcast(asked), F.expr("exists(__patterns, p -> __text ilike p)"))  # bounded by most_queries
    return found.select(query_key, key, F.lit(1.0).alias("score"))


def retrieve(queries: DataFrame, chunks: DataFrame, query_key: str, key: str, k: int = TOP_K, laws: list[str] | None = None, by_meaning: bool | None = None, mode: str = "bm25", vector: str = "embedding") -> DataFrame:
    """(query_key, rank, law_number, law_title, article, section, text, score): the k best chunks of each query.

    queries: query_key, text, and a vector (null if there is none); chunks: key, the fields above, and a vector. Nearest
    vectors and the text leg (mode: bm25 or ilike) are fused by rank; a chunk that both have keeps its cosine as score, and
    chunks of equal law, article and text are one. by_meaning: whether vectors are used; by default if any chunk has one.
    Without vectors the text leg stands alone, with its own scores. laws: only chunks of these. Queries that are null or
    blank have no rows; equal scores go by the chunks' keys; missing fields are empty texts.
    """
    fields = ["law_number", "law_title", "article", "section", "text"]
    asked = queries.filter(clean_query(F.coalesce(F.col("text"), F.lit(""))) != "")
    allowed = chunks.filter(F.col("law_number").isin(laws)) if laws else chunks
    if by_meaning is None:
        by_meaning = not chunks.filter(F.size(vector) > 0).isEmpty()
    if mode == "ilike":
        legs = [top_k(like_hits(asked, allowed, query_key, key), query_key, [F.round("score", 6), F.col(key)], k)]
    else:  # weights come from the whole index
        legs = [textindex.search(textindex.build(chunks, key), asked, query_key, k, allowed if laws else None)]
    if by_meaning:
        legs.insert(0, vectorindex.search(vectorindex.build(allowed, key, vector), asked, query_key, k, vector))
    shown = F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in fields))
    same = F.sha2(F.to_json(F.struct("law_number", *(F.coalesce(c, F.lit("")).alias(c) for c in ("article", "text")))), 256)
    records = chunks.select(key, shown.alias("record"), same.alias("same"))
    named = reduce(DataFrame.unionByName, (leg.select(query_key, key, "rank", "score", F.lit(i).alias("leg")) for i, leg in enumerate(legs))).join(records, key)
    if by_meaning:
        best = named.groupBy(query_key, "same").agg(F.min_by("record", F.struct("leg", "rank")).alias("record"))
        fused = fuse([named.filter(F.col("leg") == i) for i in range(len(legs))], query_key, "same", k)
        named = fused.join(best, [query_key, "same"])
    return named.select(query_key, "rank", "record.*", "score")


def context(hits: DataFrame, query_key: str, chars: int = 2500) -> DataFrame:
    """Text of the hits for a prompt, in the order of their ranks: `### law — article` and the cut chunk."""
    block = F.concat(F.lit("### "), F.coalesce("law", F.lit("")), F.lit(" — "), F.coalesce("article", F.lit("")), F.lit("\n"), F.left(F.coalesce("text", F.lit("")), F.lit(chars)))
    listed = hits.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return listed.select(query_key, F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n").alias("context"))


def missing_vectors(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """Chunks that still need a vector; an empty one counts as missing."""
    return chunks.filter(F.col(vector).isNull() | (F.size(vector) == 0))
