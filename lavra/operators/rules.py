"""Rule sets: parsing and validation of their JSON, and dry runs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions import extract

# Bounds of the fields of a rule.
BOUNDS = {"id": 100, "rotulo": 300, "ancora": 500, "unidade": 50, "regex": 500}
MAX_KEYWORDS = 50
FIELDS = (*BOUNDS, "tipo", "expectativa", "palavras_chave")


class RuleError(ValueError):
    """The rule set can't be used; the message says why."""


def parse_rules(config: str | dict) -> list[dict]:
    """The rules of a JSON rule set, checked: known types, bounded fields, at least one rule, unique ids, usable patterns."""
    if isinstance(config, str):
        try:
            config = json.loads(config)
        except json.JSONDecodeError as e:
            raise RuleError(f"not JSON: {e}") from e
    if not isinstance(config, dict):
        raise RuleError("not a JSON object")
    rules = config.get("regras")
    if not isinstance(rules, list) or not rules:
        raise RuleError("no rules")
    checked = [_checked(r) for r in rules]
    ids = [r["id"] for r in checked]
    if len(ids) != len(set(ids)):
        raise RuleError("rule ids are not unique")
    return checked


def _checked(rule: object) -> dict:
    if not isinstance(rule, dict):
        raise RuleError("a rule is not an object")
    for name in ("id", "rotulo"):
        if not isinstance(rule.get(name), str) or not rule[name]:
            raise RuleError(f"a rule needs {name}")
    for name, bound in BOUNDS.items():
        if isinstance(rule.get(name), str) and len(rule[name]) > bound:
            raise RuleError(f"{name} is longer than {bound}")
    if rule.get("tipo") not in extract.TYPES:
        raise RuleError(f"unknown type {rule.get('tipo')!r}")
    if len(rule.get("palavras_chave") or ()) > MAX_KEYWORDS:
        raise RuleError(f"more than {MAX_KEYWORDS} keywords")
    if rule["tipo"] == "legal" and rule.get("regex"):
        try:
            re.compile(rule["regex"])
        except re.error:
            rule = rule | {"regex": None}  # a broken pattern finds nothing
    words = [w.strip() for w in rule.get("palavras_chave") or () if w.strip()]
    return {name: rule.get(name) for name in FIELDS} | {"palavras_chave": words or None}


def rules_table(spark, rules: list[dict]) -> DataFrame:
    """The rules as a table with their order."""
    rows = [(i, r["id"], r["rotulo"], r["tipo"], r.get("ancora"), r.get("palavras_chave"), r.get("regex")) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, id string, rotulo string, tipo string, ancora string, palavras_chave array<string>, regex string")


def extract_values(documents: DataFrame, rules: list[dict], key: str = "document_id") -> DataFrame:
    """(key, regra_id, tipo, valor) for each document and rule; `documents` has key and `items`."""
    found = F.explode(extract.compile_rules(rules, F.col("items"))).alias("found")
    return documents.select(key, found).select(key, "found.regra_id", "found.tipo", "found.valor")


def dry_run(documents: DataFrame, rules: list[dict], key: str = "document_id") -> DataFrame:
    """How many of the rules find a value in each document."""
    values = extract_values(documents, rules, key)
    return values.groupBy(key).agg(F.count("valor").alias("found"), F.count("*").alias("total"))


def not_evaluated(rule_id: str, reason: str):
    """A result for a rule that wasn't evaluated."""
    return F.struct(F.lit(rule_id).alias("regra_id"), F.lit("atencao").alias("status"), F.lit(reason).alias("motivo"))
