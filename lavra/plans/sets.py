"""Queries over tables of rule sets, nested compliance reads, marked tables and title numbers, each with its SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import marked_table, nfc, split_keywords, title_number
from lavra.operators import compliance, rulesets
from lavra.plans.jobs import registry
from lavra.plans.tables import table

QUERIES, ORACLE, query = registry()

#: Shapes of the sets' JSON, by a customer's key; # stands for the key.
_RULE = '{"id": "r1", "rotulo": "Regra #", "tipo": "booleano", "ancora": " ", "regex": "x", "palavras_chave": %s}'
_SHAPES = (
    '{"versao": 1, "regras": [%s, {"id": "r2", "rotulo": "Lei", "tipo": "legal", "ancora": "lei", "regex": "1+", "palavras_chave": ["a"]}]}' % (_RULE % '[" garantia ", "", "prazo"]'),
    "nada #", "[1, 2]", '{"regras": []}', '{"regras": [%s, %s]}' % (_RULE % "null", _RULE % "null"), '{"regras": [{"id": "r#", "rotulo": "R", "tipo": "cor"}]}', '{"regras": [{"id": "r#", "tipo": "data"}]}',
)


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    """A rule set of every customer, some of which can't be used."""
    k = F.col("c_custkey")
    config = F.replace(F.element_at(F.array(*(F.lit(s) for s in _SHAPES)), (k % len(_SHAPES) + 1).cast("int")), F.lit("#"), k.cast("string"))
    return table(spark, sf, "customer").select(k.alias("molde_id"), F.concat("c_mktsegment", F.lit(" "), (k % 50).cast("string")).alias("nome"), config.alias("config"), (k % 97).alias("created_at"))


@query(f"""
WITH c AS (SELECT c_custkey AS k, c_custkey % {len(_SHAPES)} AS shape FROM customer)
SELECT k AS molde_id, ['', 'not JSON', 'not a JSON object', 'no rules', 'rule ids are not unique', 'unknown type', 'a rule needs rotulo'][shape + 1] AS problem FROM c WHERE shape > 0
""")
def rule_set_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return rulesets.created(_sets(spark, sf)).filter("problem is not null").select("molde_id", "problem")


@query(f"""
SELECT c_custkey AS molde_id, '{{"versao":1,"regras":[{{"id":"r1","rotulo":"Regra ' || c_custkey || '","tipo":"booleano","palavras_chave":["garantia","prazo"]}},{{"id":"r2","rotulo":"Lei","tipo":"legal","ancora":"lei","regex":"1+"}}]}}' AS config
FROM customer WHERE c_custkey % {len(_SHAPES)} = 0
""")
def rule_sets_created(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON of usable sets as it is kept."""
    return rulesets.created(_sets(spark, sf)).filter("problem is null").select("molde_id", "config")


@query(f"""
WITH c AS (SELECT c_custkey AS molde_id, c_mktsegment || ' ' || c_custkey % 50 AS nome, c_custkey % {len(_SHAPES)} AS shape, row_number() OVER (PARTITION BY c_mktsegment, c_custkey % 50 ORDER BY c_custkey % 97 DESC, c_custkey) AS nth FROM customer),
w AS (SELECT *, [2, 0, 0, 0, 2, 1, 1][shape + 1] AS n FROM c WHERE nth = 1)
SELECT molde_id, nome, generate_series AS ord, CASE WHEN shape > 4 THEN 'r' || molde_id WHEN shape = 0 AND generate_series = 1 THEN 'r2' ELSE 'r1' END AS regra_id,
  CASE WHEN shape = 5 THEN 'R' WHEN shape < 5 THEN CASE WHEN shape = 0 AND generate_series = 1 THEN 'Lei' ELSE 'Regra ' || molde_id END END AS rotulo
FROM w, generate_series(0, 1) WHERE generate_series < n
""")
def newest_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of each name's newest set."""
    sets = rulesets.newest(_sets(spark, sf))
    return rulesets.rules_table(sets).join(sets.select("molde_id", "nome"), "molde_id").select("molde_id", "nome", "ord", "regra_id", "rotulo")


@query(f"""
SELECT c_custkey AS molde_id, c_mktsegment || ' ' || c_custkey % 50 AS nome, [2, 0, 0, 0, 2, 1, 1][c_custkey % {len(_SHAPES)} + 1] AS n_rules, c_custkey % 97 AS created_at FROM customer
""")
def rule_set_listing(spark: SparkSession, sf: str) -> DataFrame:
    return rulesets.listing(_sets(spark, sf))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    """An order is a comparison by one of five sets of up to five rules; a line is a supplier's result for the rule of its number, which the set may not have."""
    rule = F.transform(F.sequence(F.lit(1), F.col("r_regionkey") + 1), lambda i: F.struct(i.cast("string").alias("id"), F.concat("r_name", F.lit(" "), i.cast("string")).alias("rotulo"), F.lit("data").alias("tipo")))
    sets = table(spark, sf, "region").select(F.col("r_regionkey").alias("molde_id"), F.to_json(F.struct(rule.alias("regras"))).alias("config"))
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("comparacao_id"), (F.col("o_orderkey") % 5).alias("molde_id"))
    status = F.when(F.col("l_returnflag") == "N", "ok").otherwise("falha")
    results = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("comparacao_id"), F.col("l_suppkey").alias("fornecedor_id"), F.col("l_linenumber").cast("string").alias("regra_id"), status.alias("status"), F.col("l_partkey").cast("string").alias("motivo"),
        F.lit("1").alias("valor_tr"), F.col("l_linestatus").alias("valor_proposta"),
    )
    suppliers = table(spark, sf, "supplier").filter("s_suppkey % 10 != 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nome"))
    return rulesets.comparison_matrix(jobs, sets, results, suppliers)


@query(f"""
WITH one AS (SELECT *, CASE l_returnflag WHEN 'N' THEN 'ok' ELSE 'falha' END AS status FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber ORDER BY status DESC, CAST(l_partkey AS VARCHAR) DESC, l_linestatus DESC) = 1),
p AS (SELECT DISTINCT l_orderkey, l_suppkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey % 10 <> 0)
SELECT p.l_orderkey AS comparacao_id, i - 1 AS ord, CAST(i AS VARCHAR) AS regra_id, r_name || ' ' || i AS rotulo, p.l_suppkey AS fornecedor_id, s_name AS nome,
  coalesce(l.status, 'atencao') AS status, CASE WHEN l.status IS NULL THEN '{compliance.MISSING_CELL}' ELSE CAST(l_partkey AS VARCHAR) END AS motivo,
  CASE WHEN l.status IS NOT NULL THEN '1' END AS valor_tr, l_linestatus AS valor_proposta
FROM p JOIN orders o ON o.o_orderkey = p.l_orderkey JOIN region ON r_regionkey = o_orderkey % 5 JOIN generate_series(1, 5) g(i) ON i <= r_regionkey + 1
LEFT JOIN one l ON l.l_orderkey = p.l_orderkey AND l.l_suppkey = p.l_suppkey AND l.l_linenumber = i
""")
def comparison_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf)


@query("""
SELECT l_orderkey AS id, '[TABELA]' || chr(10) || string_agg(l_linenumber || ' | ' || l_partkey || ' | ' || CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END, chr(10) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), nullif(l_returnflag, 'N') NULLS FIRST) || chr(10) || '[/TABELA]' AS text
FROM lineitem GROUP BY l_orderkey
""")
def marked_tables(spark: SparkSession, sf: str) -> DataFrame:
    """An order's lines as a table in a text; some cells are null."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("cells")))).alias("rows"))
    return rows.select("id", marked_table(F.transform("rows", lambda r: r["cells"])).alias("text"))


_MARKS = tuple((c, unicodedata.normalize("NFD", c)) for c in "éãüñçáó")
_SQL_APART = "left(text, 60)"
for _one, _two in _MARKS:
    _SQL_APART = f"replace({_SQL_APART}, '{_one}', '{_two}')"


@query(f"SELECT doc_id, 'T-' || CAST(('0x' || left(sha256(nfc_normalize({_SQL_APART})), 12)) AS BIGINT) % 100000 AS item_number FROM documents WHERE text IS NOT NULL")
def title_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of titles, which are the first 60 characters of a text, with accents that stand apart from their letters."""
    apart = F.left("text", F.lit(60))
    for one, two in _MARKS:
        apart = F.replace(apart, F.lit(one), F.lit(two))
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", title_number(nfc(apart)).alias("item_number"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ' , '), ','), lambda w: trim(w)), lambda w: w <> ''), '|') AS keywords FROM part")
def keyword_lists(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(split_keywords(F.replace("p_name", F.lit(" "), F.lit(" , "))), "|").alias("keywords"))
