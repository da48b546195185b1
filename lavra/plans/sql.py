"""DuckDB SQL for the queries of this package, by name. Queries that SQL can't express have none."""

from __future__ import annotations

from lavra.functions.text import ACCENTED, PLAIN
from lavra.operators import analysis, chat, chunk, compliance, drafts, generate
from lavra.plans import jobs, sets


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({x}, '')), '{ACCENTED}', '{PLAIN}'), '[0-9a-z]+')"

#: First whole number of a text, by runs of digits, dots and commas (RE2 has no look-around).
_RUN = r"^([0-9]{1,3}(?:\.[0-9]{3})+|[0-9]{1,9})($|[.,]$|[.,][.,])"


def _integer(x: str) -> str:
    first = f"list_filter(regexp_extract_all({x}, '[0-9.,]+'), lambda r: regexp_matches(r, '{_RUN}'))[1]"
    return f"CAST(replace(nullif(regexp_extract({first}, '{_RUN}', 1), ''), '.', '') AS BIGINT)"


def _natural(x: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all({x}, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN lpad(CAST(length(ltrim(p, '0')) AS VARCHAR), 6, '0') || ltrim(p, '0') ELSE p END), 'string_agg', '')"

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- extraction

ORACLE["extract_integer"] = f"SELECT doc_id, value FROM (SELECT doc_id, {_integer('text')} AS value FROM documents) WHERE value IS NOT NULL"
ORACLE["extract_integer_anchored"] = "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS value FROM lineitem"
ORACLE["extract_number_words"] = "SELECT p_partkey, CAST(p_size AS BIGINT) AS value FROM part"
ORACLE["extract_boolean_keywords"] = "SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'and') AS value FROM documents"
ORACLE["extract_legal_regex"] = "SELECT doc_id, regexp_matches(text, 'licen[sc]e|lizenz', 'i') AS value FROM documents"
ORACLE["extract_date"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders"
ORACLE["extract_percent"] = "SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100 + 0.5, 1) AS DOUBLE) AS value FROM lineitem"
ORACLE["extract_money"] = "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) / 100 AS value FROM orders"
ORACLE["extract_cnpj"] = """
WITH b AS (SELECT s_suppkey, [CAST(d AS INTEGER) FOR d IN string_split(lpad(CAST(s_suppkey AS VARCHAR), 12, '0'), '')] AS d FROM supplier),
one AS (SELECT s_suppkey, list_append(d, CASE WHEN r < 2 THEN 0 ELSE 11 - r END) AS d FROM (SELECT *, list_sum(list_transform(list_zip(d, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]), lambda z: z[1] * z[2])) % 11 AS r FROM b)),
two AS (SELECT s_suppkey, list_append(d, CASE WHEN r < 2 THEN 0 ELSE 11 - r END) AS d FROM (SELECT *, list_sum(list_transform(list_zip(d, [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]), lambda z: z[1] * z[2])) % 11 AS r FROM one)),
t AS (SELECT s_suppkey, array_to_string(list_transform(d, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), '') AS t FROM two)
SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN t[1:2] || '.' || t[3:5] || '.' || t[6:8] || '/' || t[9:12] || '-' || t[13:14] END AS value FROM t
"""
ORACLE["extract_relative_term"] = """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 5 = 0 THEN 'trinta' ELSE CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR) END || ' ' || ['dias', 'meses', 'anos'][l_linenumber % 3 + 1] AS value
FROM lineitem
"""
ORACLE["extract_cep"] = "SELECT c_custkey, t[1:5] || '-' || t[6:8] AS value FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS t FROM customer)"

# ---------------------------------------------------------------- compliance

_PROPOSED = f"""
p AS (SELECT s_suppkey AS k, s_name AS nome FROM supplier),
v(ord, regra_id, rotulo, kind, tr) AS (VALUES (0, 'vigencia', 'Vigência', 'n', '30'), (1, 'reajuste', 'Reajuste', 'n', '5.5'), (2, 'valor', 'Valor máximo', 'n', '1500.0'),
  (3, 'entrega', 'Entrega', 't', '2026-12-15'), (4, 'garantia', 'Garantia', 'b', 'sim'), (5, 'lei', 'Lei aplicável', 'b', 'sim')),
x AS (
  SELECT k, nome, v.*, CASE regra_id
    WHEN 'vigencia' THEN CASE WHEN k % 3 = 0 THEN '60' ELSE '30' END
    WHEN 'reajuste' THEN CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN '5.5' ELSE '6.0' END
    WHEN 'valor' THEN CASE WHEN k % 5 = 0 THEN '1600.0' ELSE '1500.0' END
    WHEN 'entrega' THEN CASE WHEN k % 11 = 0 THEN NULL ELSE '2026-12-15' END
    WHEN 'garantia' THEN CASE WHEN k % 4 = 0 THEN 'não' ELSE 'sim' END
    ELSE CASE WHEN k % 9 = 0 THEN 'não' ELSE 'sim' END END AS pr
  FROM p, v
),
r AS (
  SELECT *, CASE WHEN pr IS NOT DISTINCT FROM tr THEN 'ok' ELSE 'falha' END AS status, CASE
    WHEN kind = 'b' THEN CASE pr WHEN 'sim' THEN '{compliance.PRESENT}' ELSE '{compliance.ABSENT}' END
    WHEN pr IS NULL THEN CASE kind WHEN 't' THEN 'Data não localizado(a) na proposta do fornecedor.' ELSE '{compliance.NOT_LOCATED}' END
    WHEN pr = tr THEN '{compliance.EQUAL}'
    ELSE 'Valor da proposta (' || pr || ') diverge do esperado no Termo de Referência (' || tr || ').' END AS motivo
  FROM x
)
"""
ORACLE["compliance_results"] = f"WITH {_PROPOSED} SELECT k AS fornecedor_id, regra_id, status, motivo, tr AS valor_tr, pr AS valor_proposta FROM r"
ORACLE["compliance_matrix"] = f"""
WITH {_PROPOSED} SELECT regra_id, rotulo, count(*) FILTER (s = 'ok') AS n_ok, count(*) FILTER (s = 'falha') AS n_falha, count(*) FILTER (s = 'atencao') AS n_atencao
FROM (SELECT *, CASE WHEN k % 6 = 0 THEN 'atencao' ELSE status END AS s FROM r) GROUP BY regra_id, rotulo
"""
ORACLE["compliance_pivot"] = f"""
WITH {_PROPOSED} SELECT regra_id, rotulo, {', '.join(f"max(status) FILTER (k = {i}) AS f{i}" for i in range(1, 6))} FROM r WHERE k <= 5 GROUP BY regra_id, rotulo
"""
ORACLE["compliance_cells"] = f"WITH {_PROPOSED} SELECT regra_id, rotulo, k AS fornecedor_id, nome, status, motivo FROM r"
ORACLE["pendencies_by_supplier"] = f"""
WITH {_PROPOSED} SELECT k AS fornecedor_id, count(*) AS total,
  string_agg(CASE WHEN regra_id = 'lei' THEN 'lei' ELSE rotulo END || '|' || status || '|' || tr || '|' || coalesce(pr, 'não informado'), ';' ORDER BY CASE WHEN regra_id = 'lei' THEN 99 ELSE ord END) AS pendencias
FROM r WHERE status <> 'ok' GROUP BY k
"""
ORACLE["email_bodies"] = f"""
WITH {_PROPOSED},
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS i FROM r WHERE status <> 'ok')
SELECT k AS fornecedor_id, nome || '@exemplo.br' AS email, count(*) AS n_pendencias,
  'Prezado(a) ' || nome || ',' || chr(10) || chr(10) || '{compliance.LETTER_INTRO}' || chr(10) || chr(10) || string_agg(
    i || '. ' || rotulo || ' — NÃO CONFORME' || chr(10) || '   Motivo: ' || motivo || chr(10) || '   Esperado no TR: ' || tr || chr(10) || '   Consta na proposta: ' || coalesce(pr, 'não informado'),
    chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || '{compliance.LETTER_END}' AS corpo
FROM l GROUP BY k, nome
"""
ORACLE["dry_run_counts"] = f"WITH {_PROPOSED} SELECT k AS fornecedor_id, count(pr) AS found, count(*) AS total FROM r GROUP BY k"

# ---------------------------------------------------------------- versions

_VERSIONS = r"""
o AS (SELECT o_custkey AS doc, o_orderkey AS k, CAST(o_orderkey % 40 AS VARCHAR) AS n, o_orderpriority AS title, o_orderstatus AS s FROM orders),
a AS (SELECT doc, n, arg_max(title, k) AS title, arg_max(title || ' ' || s, k) AS c FROM o WHERE k % 5 <> 0 GROUP BY doc, n),
b AS (SELECT doc, n, arg_max(title, k) AS title, arg_max(CASE WHEN k % 3 = 0 THEN 'revisto ' || s ELSE upper(title) || '  ' || s END, k) AS c FROM o WHERE k % 7 <> 0 GROUP BY doc, n),
d AS (
  SELECT doc, n, coalesce(b.title, a.title) AS titulo, a.c AS before, b.c AS after,
    CASE WHEN a.c IS NULL THEN 'adicionado' WHEN b.c IS NULL THEN 'removido'
      WHEN regexp_replace(lower(trim(a.c)), '\s+', ' ', 'g') = regexp_replace(lower(trim(b.c)), '\s+', ' ', 'g') THEN 'inalterado' ELSE 'alterado' END AS status
  FROM a FULL JOIN b USING (doc, n)
)
"""
ORACLE["version_diff_keys"] = f"WITH {_VERSIONS} SELECT doc, status, n AS item_number, titulo, before AS conteudo_antes, after AS conteudo_depois, {_natural('n')} AS sort_key FROM d"
ORACLE["diff_summary"] = f"WITH {_VERSIONS} SELECT doc, {', '.join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in ('adicionado', 'removido', 'alterado', 'inalterado'))} FROM d GROUP BY doc"
ORACLE["revision_next_version"] = "SELECT conv_id AS document_id, coalesce(max(turn), 0) + 1 AS versao FROM conversations GROUP BY conv_id"
ORACLE["revision_restore"] = "SELECT conv_id AS document_id, CAST(turn AS VARCHAR) AS item_number, role AS title, CASE WHEN turn % 2 = 0 THEN 'antigo ' || role ELSE 'corrente' END AS content FROM conversations"

# ---------------------------------------------------------------- pages and texts

ORACLE["page_title"] = r"SELECT page_id, regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\s+', ' ', 'g') AS title FROM pages"
ORACLE["page_charset"] = "SELECT page_id, coalesce(nullif(regexp_extract(lower(left(html, 4096)), 'charset=[\"'']?([A-Za-z0-9_-]+)', 1), ''), 'latin-1') AS charset FROM pages"
ORACLE["chunk_paragraphs"] = rf"""
WITH RECURSIVE raw AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS l, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS i FROM documents),
t AS (SELECT doc_id, i, {_strip('l')} AS l FROM raw),
f AS (SELECT doc_id, min(i) AS cut FROM t WHERE contains(l, '{chunk.FOOTER}') GROUP BY doc_id),
p AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM t LEFT JOIN f USING (doc_id) WHERE l <> '' AND NOT starts_with(l, '#') AND (cut IS NULL OR i < cut)),
w(doc_id, i, c, size) AS (
  SELECT doc_id, i, 0, length(l) + 1 FROM p WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN w.size + length(p.l) > {chunk.CHUNK_CHARS} THEN w.c + 1 ELSE w.c END, CASE WHEN w.size + length(p.l) > {chunk.CHUNK_CHARS} THEN 0 ELSE w.size END + length(p.l) + 1
  FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1
),
g AS (SELECT doc_id, c, string_agg(l, chr(10) ORDER BY i) AS t FROM w JOIN p USING (doc_id, i) GROUP BY doc_id, c)
SELECT doc_id, CAST(c AS INTEGER) AS chunk_index, 'Trecho ' || (c + 1) AS article, length(t) AS n_chars, md5(t) AS chunk_md5 FROM g
"""
ORACLE["chunk_articles"] = """
WITH l AS (SELECT *, ['I', 'V', 'X'][l_orderkey % 3 + 1] AS roman, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, line_text) AS nth
  FROM (SELECT *, 'Art. ' || l_linenumber || 'º. Prazo de ' || CAST(trunc(l_quantity) AS BIGINT) || ' dias' || chr(10) || '§ 1º ' || l_returnflag AS line_text FROM lineitem))
SELECT l_orderkey AS doc_id, CAST(nth - 1 AS INTEGER) AS chunk_index, 'Art. ' || l_linenumber || 'º' AS article,
  CASE WHEN max(CASE WHEN l_linenumber % 5 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY nth) = 1 THEN 'CAPÍTULO ' || roman ELSE '' END AS section,
  line_text AS chunk_text
FROM l
"""
ORACLE["structure_items"] = """
WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, 'Prazo ' || l_returnflag AS title, CAST(trunc(l_quantity) AS BIGINT) AS qty FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, '1.' || n || ' ' || title || chr(10) || 'texto ' || qty) AS nth FROM o),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY nth) AS again FROM k),
s AS (SELECT DISTINCT doc_id, 0 AS item_order, '1' AS item_number, 'DO PRAZO' AS title, '1. DO PRAZO' AS content, 'section' AS item_type FROM l)
SELECT * FROM s UNION ALL
SELECT doc_id, nth, '1.' || n || CASE WHEN again > 1 THEN '-' || (again - 1) ELSE '' END, title, '1.' || n || ' ' || title || chr(10) || 'texto ' || qty || chr(10) || '(R$)', 'item' FROM l
"""
ORACLE["page_of_line"] = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, len(string_split(text, chr(10))) AS n FROM documents),
p AS (SELECT doc_id, page, 4 * (page - 1) AS first FROM (SELECT DISTINCT doc_id, unnest(generate_series(1, CAST(ceil(n / 3.0) AS BIGINT))) AS page FROM l)),
m AS (SELECT l.doc_id, l.pos, max(p.page) AS page FROM l JOIN p ON p.doc_id = l.doc_id AND p.first <= l.pos GROUP BY l.doc_id, l.pos)
SELECT doc_id, CAST(page AS INTEGER) AS page, count(*) AS n_lines, CAST(min(pos) AS INTEGER) AS first_line FROM m GROUP BY doc_id, page
"""
ORACLE["duplicate_rename"] = """
SELECT lang, number || CASE WHEN nth > 1 THEN '-' || (nth - 1) ELSE '' END AS number, doc_id
FROM (SELECT *, row_number() OVER (PARTITION BY lang, number ORDER BY doc_id) AS nth FROM (SELECT lang, left(md5(text), 1) AS number, doc_id FROM documents))
"""
ORACLE["document_headers"] = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'arquivo ' || c_name END AS number, CASE WHEN c_custkey % 3 = 0 THEN 'Lei ' || c_mktsegment ELSE c_name END AS title FROM customer
"""

# ---------------------------------------------------------------- retrieval

_BM25 = f"""
docs AS (SELECT doc_id, {_tokens('text')} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avg_dl FROM docs),
post AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM docs) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens(f"regexp_replace(left(lower({_strip('text')}), 500), '\\s+', ' ', 'g')")}) AS term FROM benchmark WHERE item_id % 50 = 0),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
s AS (
  SELECT query_id, doc_id, -sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
  FROM q JOIN post USING (term) JOIN df USING (term), stats GROUP BY query_id, doc_id
),
best AS (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6), doc_id) AS rank FROM s)
"""
ORACLE["token_df"] = f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY term"
ORACLE["bm25_topk"] = f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 5"
ORACLE["phrase_search"] = f"""
WITH t(query_id, phrase) AS (VALUES (1, ' license '), (2, ' of the '), (3, ' apache license ')),
d AS (SELECT doc_id, ' ' || array_to_string({_tokens('text')}, ' ') || ' ' AS s FROM documents)
SELECT query_id, doc_id FROM t, d WHERE contains(s, phrase)
"""
ORACLE["ilike_search"] = "SELECT doc_id, lang FROM documents WHERE text ILIKE '%LICENSE%' OR text ILIKE '%oreilly%' OR text ILIKE '%l_zenz%' OR text ILIKE '%zz%yy%'"
_COSINE = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 50 = 0)
"""
ORACLE["cosine_topk"] = f"WITH {_COSINE} SELECT * EXCLUDE (label) FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c) WHERE rank <= 5"
ORACLE["rrf_fusion"] = f"""
WITH {_COSINE},
b AS (SELECT query_id, vec_id, round(score + label * 0.05, 6) AS score FROM c),
legs AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, 0 AS leg FROM c
  UNION ALL SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id), 1 FROM b
),
f AS (SELECT query_id, vec_id, sum(1 / (60 + rank)) AS rrf, arg_min(score, leg * 1000 + rank) AS score, min(leg * 1000 + rank) AS place FROM legs WHERE rank <= 20 GROUP BY query_id, vec_id)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, score, round(rrf, 9) AS rrf_score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, place, vec_id) AS rank FROM f) WHERE rank <= 10
"""
ORACLE["retrieve"] = f"""
WITH {_BM25},
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (
  SELECT item_id AS query_id, doc_id, round(list_cosine_similarity(q.v, e.v), 6) AS score
  FROM benchmark b JOIN e q ON q.vec_id = item_id, e JOIN documents d ON d.doc_id = e.vec_id WHERE item_id % 50 = 0 AND {_strip('b.text')} <> ''
),
legs AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, 0 AS leg FROM c
  UNION ALL SELECT query_id, doc_id, score, rank, 1 FROM best
),
h AS (SELECT query_id, source, coalesce(lang, '') AS article, coalesce(text, '') AS text, score, rank, leg FROM legs JOIN documents USING (doc_id) WHERE rank <= 5),
f AS (SELECT query_id, source, article, text, sum(1 / (60 + rank)) AS rrf, arg_min(score, leg * 1000 + rank) AS score, min(leg * 1000 + rank) AS place FROM h GROUP BY query_id, source, article, text)
SELECT query_id, CAST(rank AS INTEGER) AS rank, coalesce(source, '') AS law_number, '' AS law_title, article, '' AS section, md5(text) AS text_md5, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, place) AS rank FROM f) WHERE rank <= 5
"""
ORACLE["retrieval_context"] = f"""
WITH {_BM25}
SELECT query_id, string_agg('### ' || source || ' — ' || doc_id || chr(10) || left(text, 2500), chr(10) || chr(10) ORDER BY rank) AS context
FROM best JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id
"""
ORACLE["embedding_backfill"] = "SELECT conv_id || '-' || turn AS id, 64 AS width FROM conversations WHERE turn % 2 <> 0 AND text IS NOT NULL"

# ---------------------------------------------------------------- analysis

_FINDINGS = """
f AS (
  SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'juridica' WHEN 'purchase' THEN 'tecnica' WHEN 'view' THEN 'redacao' WHEN 'signup' THEN 'estrutural' ELSE 'outra' END AS category,
    CASE WHEN value < 2 THEN 'info' WHEN value < 20 THEN 'baixo' WHEN value < 60 THEN 'medio' WHEN value < 150 THEN 'alto' ELSE 'critico' END AS severity
  FROM events
)
"""
_POINTS = "CASE severity WHEN 'critico' THEN 25 WHEN 'alto' THEN 15 WHEN 'baixo' THEN 2 ELSE 7 END"


def _scores(key: str) -> str:
    """Scores in tenths and the overall score in thousandths, rounded half to even."""
    tenths = ", ".join(f"greatest(0, 100 - coalesce(sum({_POINTS}) FILTER (category = '{c}'), 0)) AS {c}" for c in ("juridica", "tecnica", "estrutural", "redacao"))
    return f"""
t AS (SELECT {key} AS item, {tenths}, bool_or(severity = 'critico') AS critical, bool_or(severity = 'alto') AS high FROM f GROUP BY 1),
m AS (SELECT *, juridica * 35 + tecnica * 30 + estrutural * 20 + redacao * 15 AS thousandths FROM t),
o AS (SELECT *, thousandths // 100 + CASE WHEN thousandths % 100 > 50 OR (thousandths % 100 = 50 AND (thousandths // 100) % 2 = 1) THEN 1 ELSE 0 END AS overall FROM m)
"""

ORACLE["source_assembly"] = f"""
WITH legs AS (
  SELECT doc_id % 50 AS chat, 0 AS leg, doc_id AS ord, 'legal' AS type, source || ', ' || lang AS reference, source AS title FROM documents
  UNION ALL SELECT * EXCLUDE (nth) FROM (SELECT doc_id % 50, 1, doc_id, 'correction', 'Correção · ' || quality || ' · ' || toxic, 'p', row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id) AS nth FROM labels) WHERE nth <= {chat.MAX_SOURCES}
  UNION ALL SELECT DISTINCT conv_id % 50, 2, 0, 'document_item', 'Item ' || turn, 'Item do documento' FROM conversations
),
once AS (SELECT *, row_number() OVER (PARTITION BY chat, type, reference ORDER BY leg, ord) AS nth FROM legs),
numbered AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY leg, ord, reference) AS n FROM once WHERE nth = 1)
SELECT chat, n AS ord, type, reference, title FROM numbered WHERE n <= {chat.MAX_SOURCES}
"""
ORACLE["findings_dedupe"] = """
SELECT source, doc_id FROM (
  SELECT source, doc_id, a, b, row_number() OVER (PARTITION BY source, a, b ORDER BY doc_id) AS nth
  FROM (SELECT source, doc_id, lower(trim(' ' || upper(text), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS a, CASE WHEN doc_id % 10 <> 0 THEN lower(trim(lang)) ELSE '' END AS b FROM documents)
) WHERE nth = 1 OR a = '' OR b = ''
"""
ORACLE["findings_by_category_severity"] = f"WITH {_FINDINGS} SELECT 'category' AS dimension, category AS label, count(*) AS n FROM f GROUP BY category UNION ALL SELECT 'severity', severity, count(*) FROM f GROUP BY severity"
ORACLE["fallback_scores"] = f"""
WITH {_FINDINGS}, {_scores('event_id // 7')}
SELECT item, juridica / 10 AS score_juridica, tecnica / 10 AS score_tecnica, estrutural / 10 AS score_estrutural, redacao / 10 AS score_redacao, overall / 10 AS score_overall,
  CASE WHEN critical OR overall < 50 THEN 'critico' WHEN high OR overall < 70 THEN 'alto' WHEN overall < 85 THEN 'medio' ELSE 'baixo' END AS risk_level
FROM o
"""
ORACLE["max_severity"] = f"WITH {_FINDINGS} SELECT user_id, [{_list(analysis.SEVERITY_ORDER)}][max(list_position([{_list(analysis.SEVERITY_ORDER)}], severity))] AS max_severity FROM f GROUP BY user_id"
ORACLE["apply_corrections"] = """
WITH a AS (SELECT doc_id, CASE WHEN contains(text, 'the') THEN left(text, strpos(text, 'the') - 1) || 'THE' || substr(text, strpos(text, 'the') + 3) ELSE text END AS t FROM documents)
SELECT doc_id, md5(CASE WHEN contains(t, '. ') THEN left(t, strpos(t, '. ') - 1) || '.' || chr(10) || substr(t, strpos(t, '. ') + 2) ELSE t END) AS text_md5 FROM a
"""
ORACLE["json_recovery"] = "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN json_extract_string(props, '$.k') END AS k FROM events"
ORACLE["review_apply"] = """
WITH d AS (
  SELECT conv_id, turn AS ord, greatest(0, least(turn % 5, 2)) AS i, CASE WHEN role = 'user' THEN 'rejeitada' WHEN turn % 3 = 0 THEN 'ajustada' ELSE 'aprovada' END AS status, text AS note,
    CASE WHEN turn % 2 = 0 THEN text END AS t FROM conversations
),
l AS (SELECT conv_id, i, arg_max(status, ord) AS status, arg_max(note, ord) AS note, arg_max(t, ord) FILTER (status = 'ajustada' AND t IS NOT NULL) AS t FROM d GROUP BY conv_id, i),
f AS (SELECT conv_id, unnest([0, 1, 2, 3]) AS i FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, i AS correction_index, coalesce(status, 'pendente') AS review_status, note AS review_note, coalesce(t, 's') AS suggested_text, 'j' AS justification
FROM f LEFT JOIN l USING (conv_id, i) WHERE coalesce(status, 'pendente') <> 'rejeitada'
"""
ORACLE["answer_validation"] = f"""
SELECT conv_id, turn, CASE k WHEN 4 THEN 'sim' WHEN 5 THEN 'b' ELSE '{chat.REFUSAL}' END AS content, k = 4 AS grounded, CASE WHEN k = 4 THEN 1.0::DOUBLE END AS confidence, CASE WHEN k IN (4, 5) THEN 1 ELSE 0 END AS n_citations,
  k < 4 AS refused, CASE k WHEN 0 THEN '{chat.INVALID}' WHEN 1 THEN '{chat.REFUSED}' WHEN 2 THEN '{chat.EMPTY}' WHEN 3 THEN '{chat.UNCITED}' END AS reason
FROM (SELECT conv_id, turn, (conv_id + turn) % 6 AS k FROM conversations)
"""
ORACLE["chat_turns"] = """
SELECT conv_id || '-' || turn AS id, conv_id % 2 <> 0 AS refused, CASE WHEN conv_id % 2 <> 0 THEN 'sem-fonte' END AS reason, conv_id % 2 = 0 AS grounded, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS n_citations
FROM conversations WHERE role = 'user'
"""
_QUALITY = """
l AS (SELECT * FROM labels JOIN documents USING (doc_id)),
r AS (
  SELECT source, doc_id, (CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'license') AS INTEGER) + CASE WHEN quality = 0 THEN CAST(contains(lower(text), 'zzz') AS INTEGER) ELSE 0 END)
    / CASE WHEN quality = 0 THEN 3 ELSE 2 END AS recall FROM l
),
m AS (SELECT source, avg(recall) AS recall FROM r GROUP BY source),
c AS (SELECT source, count(*) AS generated, CAST(sum(quality) AS BIGINT) AS kept FROM l GROUP BY source),
d AS (SELECT source, round(recall, 9) AS recall, round(kept / generated, 9) AS precision, round(coalesce(2 * recall * (kept / generated) / nullif(recall + kept / generated, 0), 0), 9) AS f1, generated, kept FROM m JOIN c USING (source))
"""
ORACLE["first_expectations"] = """
SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN contains(t, 'the')::INT ELSE (contains(t, 'license')::INT + contains(t, 'e')::INT + contains(t, 'zzz')::INT) / 3.0 END, 9) AS recall
FROM (SELECT doc_id, coalesce(lower(text), '') AS t FROM labels JOIN documents USING (doc_id))
"""
ORACLE["quality_metrics"] = f"WITH {_QUALITY} SELECT * FROM d"
ORACLE["quality_summary"] = f"WITH {_QUALITY}, s AS (SELECT avg(recall) AS r, avg(precision) AS p, count(*) AS documents FROM d) SELECT round(r, 6) AS recall, round(p, 6) AS precision, round(2 * r * p / (r + p), 6) AS f1, documents FROM s"
_COUNTED = {"category": ("juridica", "tecnica", "redacao", "estrutural"), "severity": ("info", "baixo", "medio", "alto", "critico")}
ORACLE["report_counts"] = f"WITH {_FINDINGS} SELECT {', '.join(f"count(*) FILTER ({c} = '{v}') AS {c}_{v}" for c, vs in _COUNTED.items() for v in vs)} FROM f"
ORACLE["score_labels"] = "SELECT c_custkey AS id, label, CAST(nullif(score, 0) AS DOUBLE) AS score FROM (SELECT c_custkey, unnest(['legal', 'overall']) AS label, unnest([c_custkey % 3, c_custkey % 5]) AS score FROM customer)"
_NL = "chr(10) || chr(10)"
_LABELS = lambda x, labels: f"CASE {x} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())} ELSE {x} END"
_CAT, _SEV = _LABELS("category", analysis.CATEGORY_LABELS), _LABELS("severity", analysis.SEVERITY_LABELS)
# In the order of the report: overall, legal, technical, writing, structural.
_SHOWN = (("Nota Geral", "overall"), ("Segurança Jurídica", "juridica"), ("Qualidade Técnica", "tecnica"), ("Qualidade da Redação", "redacao"), ("Conformidade Estrutural", "estrutural"))
_ROWS = " || chr(10) || ".join(f"'| {label} | ' || CASE WHEN {v} = 0 THEN 'N/A' ELSE {v} // 10 || '.' || {v} % 10 || '/10' END || ' |'" for label, v in _SHOWN)
ORACLE["markdown_reports"] = f"""
WITH {_FINDINGS}, {_scores('user_id')},
r AS (SELECT *, CASE WHEN critical OR overall < 50 THEN 'critico' WHEN high OR overall < 70 THEN 'alto' WHEN overall < 85 THEN 'medio' ELSE 'baixo' END AS risk FROM o),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM f),
c AS (SELECT user_id, string_agg('- **' || {_CAT} || ':** ' || k, chr(10) ORDER BY category) AS t FROM (SELECT user_id, category, count(*) AS k FROM f GROUP BY ALL) GROUP BY user_id),
s AS (SELECT user_id, string_agg('- ' || {_SEV} || ': ' || k, chr(10) ORDER BY severity) AS t FROM (SELECT user_id, severity, count(*) AS k FROM f GROUP BY ALL) GROUP BY user_id),
d AS (
  SELECT user_id, count(*) AS total, string_agg('### Correção ' || nth || ' — ' || {_CAT} || ' (' || {_SEV} || ')' || {_NL} || '**Situação:** s' || {_NL} || '**Problema:** p' || {_NL} || '**Risco:** r' || {_NL} || '**DE (texto original):**' || chr(10) || '> o'
    || {_NL} || '**PARA (texto sugerido):**' || chr(10) || '> s' || {_NL} || '**Justificativa:** j' || {_NL} || '**Fundamento Legal:** l' || {_NL} || '---', {_NL} ORDER BY nth) AS t FROM n GROUP BY user_id
)
SELECT item AS analysis_id, '# Relatório de Análise — Termo de Referência' || {_NL} || '**Documento:** ' || item || chr(10) || '**Data da Análise:** 02/01/2026 às 03:04' || chr(10) || '**Status:** completed' || {_NL}
  || '---' || {_NL} || '## 📊 Pontuação Geral' || {_NL} || '| Dimensão | Nota |' || chr(10) || '|----------|------|' || chr(10) || {_ROWS}
  || {_NL} || '**Risco de Impugnação:** ' || {_LABELS("risk", analysis.RISK_LABELS)} || {_NL} || '---' || {_NL} || '## 📋 Resumo' || {_NL} || '**Total de correções:** ' || total || {_NL} || '### Por Categoria' || {_NL} || c.t || {_NL} || '### Por Severidade' || {_NL} || s.t
  || {_NL} || '---' || {_NL} || '## 🔍 Correções Detalhadas' || {_NL} || d.t || {_NL} || '---' || {_NL} || '{analysis.REPORT_END}' || chr(10) || '*Gerado em: 02/01/2026 às 03:04*' AS report
FROM r JOIN c ON c.user_id = item JOIN s ON s.user_id = item JOIN d ON d.user_id = item
"""

# ---------------------------------------------------------------- tables

ORACLE["paged_listing"] = "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 50 OFFSET 100"
ORACLE["dedupe_min_id"] = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY lang, text)"
ORACLE["upsert_replace"] = """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier
UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier WHERE s_suppkey % 10 = 0
"""
ORACLE["insert_absent"] = "SELECT n_name, n_regionkey FROM nation UNION ALL SELECT r_name, r_regionkey FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)"
ORACLE["row_duplicate"] = "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 1000, n_name || ' (Cópia)' FROM nation WHERE n_nationkey = 7"
ORACLE["cascade_delete"] = """
SELECT l_returnflag, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3) GROUP BY l_returnflag
"""
ORACLE["foreign_key_null"] = "SELECT s_suppkey, n_nationkey AS s_nationkey FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey"
ORACLE["delete_guard"] = "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)"
ORACLE["orphan_reset"] = "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('P', 'O') THEN 'error' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus IN ('P', 'O') THEN 'interrompido' END AS error_message FROM orders"
ORACLE["status_dashboard"] = "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders"
ORACLE["progress"] = "SELECT l_orderkey, CAST(round(100 * count(*) FILTER (l_linestatus = 'F') / greatest(count(*), 1)) AS INTEGER) AS percent FROM lineitem GROUP BY l_orderkey"
ORACLE["nested_children"] = """
SELECT o_orderkey AS id, CAST(count(l_orderkey) AS INTEGER) AS n_lines, coalesce(string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS lines
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
"""
ORACLE["constraint_checks"] = """
SELECT id, broken FROM (
  SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN NOT o_totalprice >= 5000 THEN 'price' END) AS broken FROM orders
) WHERE broken <> ''
"""
ORACLE["recent_events"] = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM events"
ORACLE["rate_limit"] = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS nth FROM events),
s AS (
  SELECT event_id, user_id, nth, true AS ok, [us] AS passed FROM e WHERE nth = 1
  UNION ALL
  SELECT event_id, user_id, nth, len(recent) < 2, CASE WHEN len(recent) < 2 THEN list_append(recent, us) ELSE recent END
  FROM (SELECT e.event_id, e.user_id, e.nth, e.us, list_filter(s.passed, lambda p: p > e.us - 86400000000) AS recent FROM s JOIN e ON e.user_id = s.user_id AND e.nth = s.nth + 1)
)
SELECT event_id, NOT ok AS rejected FROM s
"""
ORACLE["first_wins"] = "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY source, lang"
ORACLE["sequence_numbers"] = "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS item_order FROM documents"
ORACLE["key_difference"] = """
WITH c AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT o_custkey AS key FROM orders WHERE o_custkey % 3 = 0)
SELECT key, 'customer' AS side FROM c WHERE key NOT IN (FROM o) UNION ALL SELECT DISTINCT key, 'order' FROM o WHERE key NOT IN (FROM c)
"""

# ---------------------------------------------------------------- generated documents


def _filled(body: str) -> str:
    """A section template as a SQL expression."""
    out = "'" + body + "'"
    for name, value in (("objeto", "objeto"), ("justificativa", "justificativa"), ("tipo", "tipo"), ("prazo", "prazo"), ("valor", "valor"), ("garantia", "garantia"), ("criterio", "'Menor Preço'")):
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out

_TYPES = [*generate.TYPES.values(), "outro"]
_GENERATED = f"""
p AS (
  SELECT c_custkey AS id, [{_list(_TYPES)}][c_custkey % 5 + 1] AS tipo, 'Objeto de ' || c_name AS objeto, 'Justificativa' || chr(10) || 'de ' || c_name AS justificativa, c_custkey % 61 AS prazo,
    CASE WHEN c_custkey % 4 <> 0 AND round(abs(c_acctbal) * 100) <> 0 THEN 'R$ ' || format('{{:,.2f}}', CAST(round(abs(c_acctbal) * 100) AS BIGINT) / 100) ELSE '{generate.NO_VALUE}' END AS valor,
    CASE WHEN c_custkey % 2 = 0 THEN '{generate.WARRANTY[True]}' ELSE '{generate.WARRANTY[False]}' END AS garantia
  FROM customer WHERE c_custkey % 61 BETWEEN 1 AND 60
),
s AS ({' UNION ALL '.join(f"SELECT id, tipo, {i + 1} AS item_order, '{i + 1}.0' AS item_number, '{title}' AS title, {_filled(body)} AS content FROM p" for i, (title, body) in enumerate(generate.SECTIONS))})
"""
_DRAFTS = f"""{_GENERATED},
h AS (SELECT o_custkey AS id, least(count(*), {drafts.TOP}) AS n FROM orders GROUP BY 1),
q AS (SELECT p.*, id % 6 AS kind, coalesce(n, 0) AS n FROM p LEFT JOIN h USING (id))"""
ORACLE["generated_drafts"] = f"""
WITH {_DRAFTS}
SELECT id, 1 AS item_order, 'A.1' AS item_number, 'DO OBJETO' AS title, 'Texto ' || id || ' de ' || n || ' fontes' AS content, 'answer' AS origin FROM q WHERE kind IN (1, 2)
UNION ALL SELECT id, 2, '2.0', '{drafts.NO_TITLE}2', 'linha', 'answer' FROM q WHERE kind IN (1, 2)
UNION ALL SELECT id, item_order, item_number, title, content, 'template' FROM s WHERE id % 6 > 2
"""
ORACLE["draft_documents"] = f"""
WITH {_DRAFTS} SELECT id, '{drafts.NAME}' || tipo AS filename_original, 'tr' AS document_type, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE {len(generate.SECTIONS)} END AS total_items,
  CASE WHEN kind = 0 THEN 'error' ELSE 'parsed' END AS status, CASE WHEN kind = 0 THEN 'sem resposta' END AS error FROM q
"""
ORACLE["generated_items"] = f"WITH {_GENERATED} SELECT * EXCLUDE (tipo) FROM s"
ORACLE["generated_html"] = f"""
WITH {_GENERATED} SELECT id, '<h1>TERMO DE REFERÊNCIA — ' || upper(tipo) || '</h1>' || chr(10)
  || string_agg('<h2>' || item_number || ' ' || title || '</h2>' || chr(10) || '<p>' || replace(content, chr(10), '<br/>') || '</p>' || chr(10), '' ORDER BY item_order) AS html
FROM s GROUP BY id, tipo
"""
ORACLE["text_functions"] = rf"""
SELECT doc_id, md5(regexp_replace(lower({_strip('text')}), '\s+', ' ', 'g')) AS normalized, md5(regexp_replace(left(lower({_strip('text')}), 500), '\s+', ' ', 'g')) AS cleaned,
  md5(left(replace({_strip('text')}, chr(10), ' '), 400)) AS snippet, CAST(len({_tokens('text')}) AS INTEGER) AS n_tokens, {_natural("(doc_id || '.' || source)")} AS sort_key,
  'T-' || CAST(('0x' || left(sha256(source), 12)) AS BIGINT) % 100000 AS title_number, 'não informado' AS shown
FROM documents
"""

for _name in ("bm25_topk", "cosine_topk", "rrf_fusion", "retrieval_context"):
    ORACLE[f"{_name}_spread"] = ORACLE[_name]
ORACLE["findings_dedupe_texts"] = ORACLE["findings_dedupe"]

# ---------------------------------------------------------------- reads and guards

ORACLE["comparison_reads"] = """
WITH n AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
s AS (
  SELECT id, string_agg(s_name, ',' ORDER BY s_name, s_suppkey) AS names
  FROM (SELECT DISTINCT l_orderkey AS id, s_suppkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) GROUP BY id
)
SELECT o_orderkey AS id, coalesce(n, 0) AS total_resultados, coalesce(names, '') AS fornecedores FROM orders LEFT JOIN n ON n.id = o_orderkey LEFT JOIN s ON s.id = o_orderkey
"""
ORACLE["proposal_problems"] = """
WITH w AS (
  SELECT l_orderkey AS comparacao_id, l_linenumber AS ord, l_partkey AS proposta_id, p_partkey IS NOT NULL AND p_size > 10 AS good, CASE WHEN p_size > 15 THEN p_size % 6 END AS f
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 45
),
n AS (SELECT *, row_number() OVER (PARTITION BY comparacao_id, f, good ORDER BY ord, proposta_id) AS nth FROM w)
SELECT comparacao_id, ord, proposta_id, CASE WHEN NOT good THEN 'not a proposal' WHEN f IS NULL THEN 'no supplier' ELSE 'supplier twice' END AS problem
FROM n WHERE NOT good OR f IS NULL OR nth > 1
"""
ORACLE["start_requests"] = """
WITH late AS (SELECT * FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 200 DAY),
a AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'P') AS r, min(o_orderkey) FILTER (o_orderstatus <> 'P') AS p FROM late GROUP BY 1)
SELECT c_custkey AS document_id, coalesce(r, p) AS analysis_id, CASE WHEN r IS NOT NULL THEN 'refused' WHEN p IS NOT NULL THEN 'queued again' ELSE 'created' END AS outcome
FROM customer LEFT JOIN a ON o_custkey = c_custkey
"""
_VOTES = """m AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2),
v AS (SELECT conv_id, turn + ahead AS turn, ahead, CASE WHEN turn % 2 = 0 THEN 'up' ELSE 'down' END AS rating, role AS comment FROM m, (VALUES (0), (1)) AS x(ahead))"""
ORACLE["message_feedback"] = f"""
WITH {_VOTES}, last AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY ahead DESC) = 1)
SELECT m.conv_id || '-' || m.turn AS id, m.role, CASE WHEN m.role = 'assistant' THEN rating END AS feedback_rating, CASE WHEN m.role = 'assistant' THEN comment END AS feedback_comment
FROM m LEFT JOIN last USING (conv_id, turn)
"""
ORACLE["refused_feedback"] = f"""
WITH {_VOTES}
SELECT CASE WHEN m.role IS NULL THEN 'no such message' ELSE 'not an answer' END AS reason, count(*) AS n FROM v LEFT JOIN m USING (conv_id, turn) WHERE coalesce(m.role, '') <> 'assistant' GROUP BY 1
"""
ORACLE["message_counts"] = "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id"
ORACLE["document_analyses"] = """
WITH c AS (SELECT l_orderkey, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS corrections FROM lineitem GROUP BY 1)
SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth, o_orderkey AS id, coalesce(corrections, '') AS corrections
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey
"""
ORACLE["agent_findings"] = f"""
WITH a AS (SELECT generate_subscripts(x, 1) - 1 AS i, unnest(x) AS agent FROM (SELECT [{_list(analysis.WEIGHTS)}] AS x)),
f AS (SELECT o_orderkey AS item, agent, i, inner_, CASE WHEN inner_ = 0 THEN o_orderstatus ELSE agent END AS finding FROM orders, a, (VALUES (0), (1)) AS y(inner_) WHERE length(o_orderpriority) <> 5 + i)
SELECT item, agent, row_number() OVER (PARTITION BY item ORDER BY i, inner_) AS ord, finding FROM f
"""
ORACLE["whole_texts"] = """
SELECT conv_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY turn, part)) AS text_md5 FROM (SELECT conv_id, turn, coalesce(role, '') || chr(10) || coalesce(text, '') AS part FROM conversations) GROUP BY conv_id
"""
ORACLE["vectors_available"] = "SELECT count(*) FILTER (embedding IS NOT NULL AND len(embedding) > 0) > 0 AS available FROM embeddings"
ORACLE["analysis_batches"] = """
SELECT l_orderkey, count(*) FILTER (l_linestatus = 'F') AS analyzed_items, count(*) AS total_items, CASE WHEN count(*) FILTER (l_linestatus = 'F') = 0 THEN 'error' ELSE 'completed' END AS status
FROM lineitem GROUP BY l_orderkey
"""

ORACLE |= jobs.ORACLE | sets.ORACLE
