"""Jobs that call providers, write tables or read streams, as queries over the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra import prompts, providers, storage
from lavra.operators import chat, ingest, reads, runs, tables
from lavra.plans.tables import table
from lavra.streaming.progress import TrackedJob


def registry() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """Queries, their SQL, and a decorator that takes the SQL and registers a query with it."""
    queries, oracle = {}, {}

    def query(sql: str) -> Callable:
        def registered(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return registered

    return queries, oracle, query


QUERIES, ORACLE, query = registry()

# ---------------------------------------------------------------- analysis runs

#: Calls that no attempt answers, and those whose answers hold no JSON, by item and agent.
_CALLS = """items AS (SELECT conv_id AS a, turn AS b, min(role) AS role, min(text) AS text FROM conversations GROUP BY ALL),
agents(agent, place, category) AS (VALUES ('juridico', 0, 'juridica'), ('tecnico', 1, 'tecnica'), ('redacao', 2, 'redacao'), ('estrutural', 3, 'estrutural'), ('geral', 4, 'tecnica')),
calls AS (SELECT a, b, agent, place, category, a + b + place AS n FROM items JOIN agents ON (place < 4) = (a % 2 = 0)),
answered AS (SELECT * FROM calls WHERE n % 7 <> 0)"""
_FOUND = f"""{_CALLS},
each AS (SELECT *, unnest(generate_series(0, n % 3 - 1)) AS j FROM answered WHERE n % 11 <> 0),
usable AS (
  SELECT *, 'Problema ' || ((a + j) % 5) AS problem, ' Trecho ' || (b % 3) AS original_text, 'novo ' || n AS suggested_text, ['critico', 'alto', 'medio', 'medio'][(n + j) % 4 + 1] AS severity
  FROM each WHERE NOT (j = 1 AND b % 2 = 0)
),
once AS (SELECT * FROM usable QUALIFY place = 4 OR row_number() OVER (PARTITION BY a, b, problem ORDER BY place, j) = 1),
found AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY place, j) - 1 AS correction_index FROM once)"""
_STATUS = """done AS (SELECT a, b, any_value(agent) = 'geral' AS single, bool_or(n % 7 <> 0) AS any_ok FROM calls GROUP BY a, b),
status AS (SELECT a, count(*) AS total_items, count(*) FILTER (any_ok OR NOT single) AS analyzed_items FROM done GROUP BY a)"""
_REVIEWED = f"""{_FOUND},
sized AS (SELECT a, b, count(*) AS size FROM found GROUP BY a, b),
shapes(shape, ord, i, kind) AS (VALUES (0, 0, 0, 'one'), (0, 1, 1, 'two'), (1, 0, 0, 'one'), (3, 0, 1, 'two'), (3, 1, 99, 'far')),
decided AS (SELECT a, b, ord, least(i, size - 1) AS correction_index, kind FROM sized JOIN shapes ON shape = (a + b) % 6),
last AS (
  SELECT a, b, correction_index, arg_max(CASE WHEN kind = 'two' THEN 'ajustada' WHEN kind = 'one' AND b % 2 = 1 THEN 'rejeitada' ELSE 'aprovada' END, ord) AS review_status,
    arg_max(kind, ord) AS kind, bool_or(kind = 'two') AS adjusted FROM decided GROUP BY ALL
),
reviewed AS (
  SELECT f.*, coalesce(review_status, 'pendente') AS review_status, CASE WHEN kind = 'one' THEN 'nota ' || a END AS review_note,
    CASE WHEN adjusted THEN 'ajuste ' || b ELSE suggested_text END AS final_text
  FROM found f LEFT JOIN last USING (a, b, correction_index)
)"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation is an analysis and a turn an item; every other analysis asks four agents."""
    turns = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("title"), F.min("text").alias("content"))
    mode = F.when(F.col("conv_id") % 2 == 0, runs.MULTI).otherwise("single")
    return turns.select(
        F.col("conv_id").alias("analysis_id"), F.col("turn").alias("item_id"), F.col("turn").alias("item_order"), mode.alias("mode"), F.concat_ws("-", "conv_id", "turn").alias("item_number"), "title",
        F.lit(None).cast("int").alias("page_number"), "content",
    )


def _answered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The items, and what two attempts have got: the second asks only what the first didn't."""
    items = _items(spark, sf)
    asked = runs.calls(items)
    answers = runs.Answers(spark, storage.folder(spark, "answers"), runs.CALL, asked)
    for attempt in (1, 2):
        answers.ask(asked, lambda n=attempt: providers.RuleAnalyst(n), attempt)
    return items, answers.read()


@query(f"WITH {_FOUND} SELECT a AS analysis_id, b AS item_id, CAST(correction_index AS INTEGER) AS correction_index, agent, category, severity, problem, original_text, suggested_text, CASE WHEN place < 4 THEN agent END AS agent_origin FROM found")
def analysis_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.findings(*_answered(spark, sf))
    return found.select("analysis_id", "item_id", "correction_index", "agent", "category", "severity", "problem", "original_text", "suggested_text", "agent_origin")


@query(f"WITH {_CALLS} SELECT a AS analysis_id, b AS item_id, agent, n % 7 <> 0 AS ok, CASE WHEN n % 7 = 0 THEN 'quota ' || n END AS error FROM calls")
def analysis_calls(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every call: an answer, or the last attempt's error."""
    return _answered(spark, sf)[1].select(*runs.CALL, "ok", "error")


def _reviewed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items, answers = _answered(spark, sf)
    found = storage.stored(runs.findings(items, answers), storage.folder(spark, "findings"))
    asked = runs.review_calls(items, found)
    opinions = storage.stored(providers.generate(asked.repartition(*runs.ITEM), runs.ITEM, providers.RuleReviewer), storage.folder(spark, "reviews"))
    return items, answers, runs.reviewed(found, opinions)


@query(f"WITH {_REVIEWED} SELECT a AS analysis_id, b AS item_id, CAST(correction_index AS INTEGER) AS correction_index, review_status, review_note, final_text AS suggested_text, 'j' AS justification FROM reviewed")
def cross_review(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewers' answers of all shapes, and failed ones, applied to the findings."""
    return _reviewed(spark, sf)[2].select("analysis_id", "item_id", "correction_index", "review_status", "review_note", "suggested_text", "justification")


@query(f"""
WITH {_REVIEWED}, {_STATUS},
kept AS (SELECT * FROM reviewed WHERE review_status <> 'rejeitada'),
sums AS (
  SELECT status.a, status.total_items, analyzed_items, count(kept.a) AS n, {', '.join(f"greatest(0, 100 - coalesce(sum(CASE severity WHEN 'critico' THEN 25 WHEN 'alto' THEN 15 ELSE 7 END) FILTER (category = '{c}'), 0)) AS {c}" for c in ('juridica', 'tecnica', 'estrutural', 'redacao'))},
    coalesce(bool_or(severity = 'critico'), false) AS critical, coalesce(bool_or(severity = 'alto'), false) AS high
  FROM status LEFT JOIN kept USING (a) GROUP BY ALL
),
own AS (SELECT *, round_even(CAST((juridica * 35 + tecnica * 30 + estrutural * 20 + redacao * 15) / 1000 AS DECIMAL(12, 3)), 1) AS overall FROM sums),
told AS (SELECT *, n % 5 IN (1, 4) AS good, CASE WHEN critical OR overall < 5 THEN 'critico' WHEN high OR overall < 7 THEN 'alto' WHEN overall < 8.5 THEN 'medio' ELSE 'baixo' END AS own_risk FROM own)
SELECT a AS analysis_id, CASE WHEN analyzed_items = 0 THEN 'error' ELSE 'completed' END AS status, total_items, analyzed_items, analyzed_items = 0 AS failed,
  CASE WHEN analyzed_items > 0 THEN CASE WHEN good THEN 7.5::DOUBLE ELSE CAST(overall AS DOUBLE) END END AS score_overall,
  CASE WHEN analyzed_items > 0 THEN CASE WHEN good THEN 6.5::DOUBLE ELSE redacao / 10 END END AS score_writing,
  CASE WHEN analyzed_items > 0 THEN CASE WHEN good THEN 'medio' ELSE own_risk END END AS risk_level,
  CASE WHEN analyzed_items > 0 THEN CASE WHEN good THEN n || ' achados' ELSE 'Análise concluída com ' || n || ' apontamento(s) de atenção formulados pelos 4 agentes especialistas. Pontuação consolidada do Termo de Referência: '
    || CAST(CAST(overall AS DECIMAL(4, 1)) AS VARCHAR) || '/10. Nível de Risco Global: ' || upper(own_risk) || '.' END END AS final_opinion,
  CASE WHEN analyzed_items > 0 THEN NOT good END AS fallback
FROM told
""")
def analysis_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole runs: status, scores and opinion of every analysis, by the scorer or, where it fails, by the findings."""
    items, answers, reviewed = _reviewed(spark, sf)
    states = runs.statuses(items, answers)
    kept = runs.analysis.kept(reviewed).join(items.select(*runs.ITEM, "item_order"), runs.ITEM)
    kept = storage.stored(kept, storage.folder(spark, "kept"))
    scores = providers.generate(runs.scoring_calls(states, kept), "analysis_id", providers.RuleScorer)
    scored = runs.scored(states, kept, scores)
    out = states.join(scored, "analysis_id", "left")
    return out.select("analysis_id", "status", "total_items", "analyzed_items", F.col("error_message").isNotNull().alias("failed"), "score_overall", "score_writing", "risk_level", "final_opinion", "fallback")


@query(f"""
WITH {_CALLS}, named AS (SELECT calls.a, calls.b, agent, role, text FROM calls JOIN items USING (a, b))
SELECT a AS analysis_id, b AS item_id, agent, md5('Item: ' || a || '-' || b || chr(10) || 'Título: ' || coalesce(nullif(role, ''), '{prompts.NO_TITLE}') || chr(10) || 'Página: {prompts.NO_PAGE}' || chr(10)
  || chr(10) || 'Conteúdo:' || chr(10) || left(coalesce(text, ''), {prompts.CONTENT_CHARS}) || chr(10) || chr(10) || 'Contexto jurídico:' || chr(10) || '{prompts.NO_CONTEXT}') AS user_md5,
  'Agente: ' || agent AS first_line
FROM named
""")
def item_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """What every agent of an item's analysis is asked."""
    return runs.calls(_items(spark, sf)).select(*runs.CALL, F.md5("user").alias("user_md5"), F.substring_index("system", "\n", 1).alias("first_line"))


@query("""
WITH t AS (SELECT conv_id, turn, (conv_id + turn) % 4 <> 0 AND conv_id % 9 <> 0 AS ok FROM conversations),
c AS (SELECT conv_id, count(*) AS total_items, count(*) FILTER (ok) AS analyzed_items FROM t GROUP BY conv_id)
SELECT conv_id AS analysis_id, total_items, analyzed_items, 100 AS percent, CASE WHEN analyzed_items = 0 THEN 'error' ELSE 'completed' END AS status FROM c
""")
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The progress table of a job over all turns, run as a stream until nothing is left."""
    turns = table(spark, sf, "conversations")
    items = spark.readStream.schema(turns.schema).parquet(f"{sf}/conversations.parquet*")
    ok = ((F.col("conv_id") + F.col("turn")) % 4 != 0) & (F.col("conv_id") % 9 != 0)
    job = TrackedJob(storage.folder(spark, "job"), lambda batch: batch.select(F.col("conv_id").alias("analysis_id"), "turn", ok.alias("ok")))
    job.start(items, storage.folder(spark, "job-checkpoint")).awaitTermination()
    totals = turns.groupBy(F.col("conv_id").alias("analysis_id")).agg(F.count("*").alias("total_items"))
    return job.progress(totals)


# ---------------------------------------------------------------- chat log


@query(f"""
WITH asked AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY ALL),
told AS (
  SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'falha-llm' WHEN conv_id % 2 = 1 THEN 'sem-fonte' END AS reason, 'Conforme Item ' || conv_id || '.' AS answer FROM asked
)
SELECT conv_id AS conversation_id, turn, 'user' AS role, md5(text) AS content_md5, CAST(0 AS INTEGER) AS n_sources, CAST(NULL AS BOOLEAN) AS grounded, CAST(NULL AS VARCHAR) AS warning FROM told
UNION ALL
SELECT conv_id, turn, 'assistant', md5(CASE reason WHEN 'falha-llm' THEN '{chat.FAILURE}' WHEN 'sem-fonte' THEN '{chat.REFUSAL}' ELSE answer END), CASE WHEN reason IS NULL THEN 1 ELSE 0 END, reason IS NULL, reason FROM told
""")
def chat_log(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and answers of every user's turn, sent twice; the leg of laws fails, and so does the provider for some conversations."""
    asked = table(spark, sf, "conversations").filter("role = 'user'").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    asked = asked.select(F.col("conv_id").alias("conversation_id"), "turn", "text", F.concat_ws("-", "conv_id", "turn").alias("id"))
    kind = "string"
    laws = chat.isolated(spark, lambda: chat.legal_sources(spark.read.parquet(f"{sf}/no-such-table.parquet"), "id"), "id", kind)
    own = asked.filter("conversation_id % 2 = 0").select("id", F.col("conversation_id").cast("string").alias("item_number"), F.lit("").alias("title"), F.col("text").alias("content"))
    items = chat.isolated(spark, lambda: chat.item_sources(own, "id"), "id", kind)
    sources = chat.source_block(chat.assembled([laws, items], "id"), "id")
    user = F.concat_ws("\n", F.coalesce("sources", F.lit("(nenhuma fonte recuperada)")), "text")
    prompted = asked.join(sources, "id", "left").select("id", F.concat(F.lit("Conversa: "), "conversation_id").alias("system"), user.alias("user"))
    answers = storage.stored(providers.generate(prompted, "id", providers.UnsureAnswers), storage.folder(spark, "chat-answers"))
    checked = chat.validated(answers.select("id", F.coalesce("answer", F.lit("")).alias("raw"), (~F.col("ok")).alias("failed"), F.lit("unsure").alias("provider")), failed="failed")
    turns = asked.join(checked, "id")
    log = chat.ChatLog(spark, storage.folder(spark, "chat-log"))
    log.append(turns.filter("turn < 4"), 0)
    for number in (1, 1, 2):  # the second batch is sent again, and then all of it under another number
        log.append(turns, number)
    return log.read().select("conversation_id", "turn", "role", F.md5("content").alias("content_md5"), F.size("sources").alias("n_sources"), "grounded", "warning")


# ---------------------------------------------------------------- uploads and texts


@query("""
SELECT 'doc' || doc_id || ['.pdf', '.PDF', '.docx', '.odt', '.exe', ''][doc_id % 6 + 1] AS path, ['pdf', 'pdf', 'docx', 'odt', 'exe', ''][doc_id % 6 + 1] AS file_type,
  CASE WHEN doc_id % 6 > 3 THEN 'extension' WHEN doc_id % 7 = 0 THEN 'empty' WHEN doc_id % 11 = 0 THEN 'too large' WHEN doc_id % 3 = 1 THEN 'content doesn''t match the extension' END AS problem
FROM documents
WHERE doc_id % 6 > 3 OR doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 3 = 1
""")
def upload_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as an upload, some with a wrong name, size or content: those that are refused, after a write of both kinds."""
    k = F.col("doc_id")
    choice = (k % 6 + 1).cast("int")
    name = F.concat(F.lit("doc"), k.cast("string"), F.element_at(F.array(*(F.lit(x) for x in (".pdf", ".PDF", ".docx", ".odt", ".exe", ""))), choice))
    zipped = lambda inner: F.concat(F.unhex(F.lit("504B0304")), F.encode(F.lit(inner), "UTF-8"))
    pdf, docx, odt = F.encode(F.lit("%PDF-1.7"), "UTF-8"), zipped("word/document.xml"), zipped("mimetypeapplication/vnd.oasis.opendocument.text")
    right = F.element_at(F.array(pdf, pdf, docx, odt, pdf, pdf), choice)
    content = F.concat(F.when(k % 3 == 1, F.encode(F.lit("texto"), "UTF-8")).otherwise(right), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    length = F.when(k % 7 == 0, 0).when(k % 11 == 0, 60 << 20).otherwise(F.octet_length(content)).cast("long")
    uploads = table(spark, sf, "documents").select(name.alias("path"), length.alias("length"), content.alias("content"))
    path = storage.folder(spark, "uploads")
    ingest.write_split(ingest.checked(uploads), path)
    return spark.read.parquet(path).filter("outcome = 'rejected'").select("path", "file_type", "problem")


def _law_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document is a law, every other one of these without articles; some of the others are empty."""
    k = F.col("doc_id")
    text = F.when(k % 6 == 0, F.concat(F.lit("Art. 1º "), "lang", F.lit("\nArt. 2º "), "source")).when(k % 6 == 3, F.lit("sem artigos")).when(k % 5 == 0, F.lit("# título\n \n")).otherwise(F.concat("lang", F.lit("\ncorpo")))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


@query("""
SELECT doc_id, CAST(CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 6 = 3 OR doc_id % 5 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_chunks, CASE WHEN doc_id % 6 = 3 OR (doc_id % 6 <> 0 AND doc_id % 5 = 0) THEN 'no chunks' END AS problem
FROM documents
""")
def ingest_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every text, the parser chosen by row; one without chunks is rejected."""
    documents, _ = ingest.ingest(_law_texts(spark, sf), "doc_id", F.col("doc_id") % 3 == 0, storage.folder(spark, "ingest"))
    return documents.select("doc_id", "n_chunks", "problem")


# ---------------------------------------------------------------- revisions and comparisons


def _saved(spark: SparkSession, sf: str) -> DataFrame:
    """A revision of each order for every line number, with the lines up to it."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    both = lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("versao")).distinct().join(lines.withColumnRenamed("l_orderkey", "document_id"), "document_id").filter("l_linenumber <= versao")
    item = F.struct(F.col("l_linenumber").alias("item_order"), F.col("l_linenumber").cast("string").alias("item_number"), F.col("l_returnflag").alias("title"))
    listed = both.groupBy("document_id", "versao").agg(F.array_sort(F.collect_list(item)).alias("items_snapshot"))
    return listed.withColumn("rotulo", F.concat(F.lit("v"), F.col("versao").cast("string")))


@query("""
WITH v AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey AS document_id, l_linenumber AS versao, 'v' || l_linenumber AS rotulo, CAST((SELECT count(*) FROM lineitem x WHERE x.l_orderkey = v.l_orderkey AND x.l_linenumber <= v.l_linenumber) AS INTEGER) AS n_items,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS INTEGER) AS nth
FROM v
""")
def revision_list(spark: SparkSession, sf: str) -> DataFrame:
    return tables.revisions(_saved(spark, sf))


@query("""
WITH w AS (SELECT o_orderkey AS document_id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS versao FROM orders),
f AS (SELECT w.*, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = document_id AND l_linenumber = versao) AS found FROM w)
SELECT document_id, versao, found, CAST(l_linenumber AS VARCHAR) AS item_number, l_returnflag AS title
FROM f LEFT JOIN lineitem ON found AND l_orderkey = document_id AND l_linenumber <= versao
""")
def revision_items(spark: SparkSession, sf: str) -> DataFrame:
    """One revision asked for of every order; some have none of that number."""
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("versao"))
    return tables.revision(_saved(spark, sf), wanted).drop("item_order")


@query("""
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size <= 25 THEN 'tr' ELSE 'proposta' END AS kind FROM part WHERE p_size < 45),
w AS (SELECT DISTINCT l_partkey AS before_id, l_partkey + l_linenumber AS after_id FROM lineitem)
SELECT before_id, after_id, CASE WHEN b.id IS NULL THEN 'no such document: before' WHEN b.kind <> 'tr' THEN 'not a reference document: before' WHEN a.id IS NULL THEN 'no such document: after' WHEN a.kind <> 'tr' THEN 'not a reference document: after' END AS problem
FROM w LEFT JOIN p b ON b.id = before_id LEFT JOIN p a ON a.id = after_id
""")
def diff_requests(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("before_id"), (F.col("l_partkey") + F.col("l_linenumber")).alias("after_id")).distinct()
    parts = table(spark, sf, "part").filter("p_size < 45")
    return reads.diff_problems(wanted, parts.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 25, "tr").otherwise("proposta").alias("document_type")))
