from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lavra.functions import extract
from lavra.operators import rules

ITEMS = "id int, items array<struct<item_number:string,title:string,content:string>>"


def by_runs(text):
    """The first whole number, run of digits and separators by run."""
    for run in re.findall(r"[0-9.,]+", text):
        found = re.match(r"^([0-9]{1,3}(?:\.[0-9]{3})+|[0-9]{1,9})($|[.,]$|[.,][.,])", run)
        if found:
            return int(found[1].replace(".", ""))
    return None


def test_one_pattern_equals_the_runs(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("0123456789.,.,  ax-", k=rng.randrange(1, 24))) for _ in range(4000)] + ["1.234", "1.234,5", "12.34", "1234567890", "7..", "5.", "x1,", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["v"] for r in frame.select("id", extract.integer(F.col("text")).alias("v")).collect()}
    assert got == {i: by_runs(t) for i, t in enumerate(texts)}


def test_known_anchors_equal_columns(spark):
    rows = [
        (1, [("1", "Prazo", "de 30 dias"), ("1.1", None, "PRAZO de 60 dias"), (None, "", "VALOR 5")]), (2, [("2", "x", None), ("1.1", "", "nada 7")]), (3, []), (4, None), (5, [("1", None, None)]),
    ]
    frame = spark.createDataFrame(rows, ITEMS)
    for anchor in (None, "", "prazo", " PRAZO ", "1.1", "9", "valor", "dias"):
        for kind in ("numero_inteiro", "booleano"):
            words = F.array(F.lit("dias"))
            known = extract.extract(kind, F.col("items"), anchor, words)
            column = extract.extract(kind, F.col("items"), F.lit(anchor).cast("string"), words)
            assert all(r[0] == r[1] for r in frame.select(known, column).collect()), anchor


def test_all_rules_read_the_items_once(spark):
    parsed = rules.parse_rules({"versao": 1, "regras": [{"id": f"r{i}", "rotulo": "r", "tipo": "numero_inteiro", "ancora": a} for i, a in enumerate(("prazo", "valor", "1.1", ""))]})
    frame = spark.createDataFrame([(1, [("1", "Prazo", "de 30 dias"), ("1.1", None, "PRAZO de 60 dias"), (None, "", "VALOR 5")])], ITEMS)
    got = rules.extract_values(frame.withColumnRenamed("id", "document_id"), parsed).collect()
    assert [(r["regra_id"], r["valor"]) for r in got] == [("r0", "30"), ("r1", "5"), ("r2", "60"), ("r3", "30")]
    plan = frame.select(extract.compile_rules(parsed, F.col("items")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(lambda") == 1  # the texts are lower-cased for all rules at once
