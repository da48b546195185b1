"""Rule sets as a table: their JSON is read, checked and cleaned by columns, and a comparison's matrix is made from them.

A table of sets has molde_id, nome, config (JSON text) and created_at. Whether a
pattern compiles is left to `rules.parse_rules`, which reads one set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions import extract
from lavra.operators.compliance import MISSING_CELL
from lavra.operators.rules import BOUNDS, MAX_KEYWORDS

RULE = "struct<id:string,rotulo:string,tipo:string,ancora:string,unidade:string,expectativa:string,regex:string,palavras_chave:array<string>>"
CONFIG = f"versao int, regras array<{RULE}>"


def rules_of(config: Column) -> Column:
    """The rules of a set's JSON; null where it is no object with a list of rules."""
    return F.from_json(F.when(config.rlike(r"(?s)^\s*\{"), config), CONFIG)["regras"]


def _rule_problem(rule: Column) -> Column:
    problem = F.when(rule.isNull(), "a rule is not an object")
    for name in ("id", "rotulo"):
        problem = problem.when(F.coalesce(rule[name], F.lit("")) == "", f"a rule needs {name}")
    for name, bound in BOUNDS.items():
        problem = problem.when(F.length(rule[name]) > bound, f"{name} is longer than {bound}")
    problem = problem.when(~F.coalesce(rule["tipo"].isin(*extract.TYPES), F.lit(False)), "unknown type")
    return problem.when(F.size(rule["palavras_chave"]) > MAX_KEYWORDS, f"more than {MAX_KEYWORDS} keywords")


def config_problem(config: Column) -> Column:
    """What speaks against a set's JSON, the first rule's problem first; null if nothing."""
    rules = rules_of(config)
    ids = F.transform(rules, lambda r: r["id"])
    own = F.get(F.filter(F.transform(rules, _rule_problem), lambda p: p.isNotNull()), F.lit(0))
    return (
        F.when(config.isNull() | F.try_parse_json(config).isNull(), "not JSON")
        .when(~config.rlike(r"(?s)^\s*\{"), "not a JSON object")
        .when(rules.isNull() | (F.size(rules) == 0), "no rules")
        .when(own.isNotNull(), own)
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "rule ids are not unique")
    )


def cleaned(rule: Column) -> Column:
    """A rule without what its type has no use for: blank texts are null, keywords are trimmed, and only their types keep keywords and a pattern."""
    words = F.filter(F.transform(rule["palavras_chave"], lambda w: F.trim(w)), lambda w: w != "")
    filled = {n: F.when(F.trim(rule[n]) != "", rule[n]) for n in ("ancora", "unidade")}
    return F.struct(
        *(rule[n].alias(n) for n in ("id", "rotulo", "tipo")), *(c.alias(n) for n, c in filled.items()), F.nullif(rule["expectativa"], F.lit("")).alias("expectativa"),
        F.when(rule["tipo"] == "legal", rule["regex"]).alias("regex"), F.when((rule["tipo"] == "booleano") & (F.size(words) > 0), words).alias("palavras_chave"),
    )


def created(sets: DataFrame) -> DataFrame:
    """The sets with their JSON cleaned and what speaks against it; a set with a problem keeps its JSON as it came."""
    clean = F.to_json(F.struct(F.lit(1).alias("versao"), F.transform(rules_of(F.col("config")), cleaned).alias("regras")))
    problem = config_problem(F.col("config"))
    return sets.withColumns({"problem": problem, "config": F.when(problem.isNull(), clean).otherwise(F.col("config"))})


def listing(sets: DataFrame) -> DataFrame:
    """(molde_id, nome, n_rules, created_at) of all sets, newest first."""
    return sets.select("molde_id", "nome", F.coalesce(F.size(rules_of(F.col("config"))), F.lit(0)).alias("n_rules"), "created_at").orderBy(F.desc_nulls_last("created_at"), "molde_id")


def rules_table(sets: DataFrame) -> DataFrame:
    """(molde_id, ord, regra_id, rotulo, tipo) of all rules of the sets."""
    return sets.select("molde_id", F.posexplode(rules_of(F.col("config"))).alias("ord", "r")).select("molde_id", "ord", F.col("r.id").alias("regra_id"), F.col("r.rotulo").alias("rotulo"), F.col("r.tipo").alias("tipo"))


def comparison_matrix(jobs: DataFrame, sets: DataFrame, results: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Every rule of a comparison's set with every known supplier that has a result in it; pairs without a result are `atencao`.

    jobs: comparacao_id, molde_id; results: comparacao_id, fornecedor_id, regra_id, status, motivo, valor_tr, valor_proposta (of
    several for one rule the largest row counts); suppliers: id, nome. A set's rules travel as one array and are dealt out after the joins, so that no key holds
    all pairs. A pair's results are listed after their shuffle alone, as listing makes them no fewer, and in falling order, so that a rule's first is its largest.
    Results of rules that the set doesn't have, and of unknown suppliers, aren't shown.
    """
    listed = sets.select("molde_id", F.transform(rules_of(F.col("config")), lambda r: F.struct(r["id"].alias("id"), r["rotulo"].alias("rotulo"))).alias("rules"))
    values = ("regra_id", "status", "motivo", "valor_tr", "valor_proposta")
    pair = Window.partitionBy("comparacao_id", "fornecedor_id").orderBy(*(F.desc_nulls_last(v) for v in values))
    whole = pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = results.select("comparacao_id", "fornecedor_id", F.collect_list(F.struct(*values)).over(whole).alias("found"), F.row_number().over(pair).alias("__nth")).filter("__nth = 1").drop("__nth")
    rows = rows.join(jobs.select("comparacao_id", "molde_id"), "comparacao_id").join(suppliers.select(F.col("id").alias("fornecedor_id"), "nome"), "fornecedor_id").join(listed, "molde_id")
    place = F.array_position(F.col("found.regra_id"), F.col("r.id"))
    cell = rows.select("comparacao_id", "fornecedor_id", "nome", "found", F.posexplode("rules").alias("ord", "r")).withColumn("own", F.get("found", (place - 1).cast("int")))
    status, reason = F.coalesce("own.status", F.lit("atencao")), F.when(F.col("own.status").isNull(), MISSING_CELL).otherwise(F.col("own.motivo"))
    return cell.select("comparacao_id", "ord", F.col("r.id").alias("regra_id"), F.col("r.rotulo").alias("rotulo"), "fornecedor_id", "nome", status.alias("status"), reason.alias("motivo"), "own.valor_tr", "own.valor_proposta")


def newest(sets: DataFrame) -> DataFrame:
    """Of the sets of one name, the newest."""
    nth = F.row_number().over(Window.partitionBy("nome").orderBy(F.desc_nulls_last("created_at"), "molde_id"))
    return sets.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
