from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lavra.functions import extract

ITEMS = [("4.3", "VIGÊNCIA", "A vigência será de 90 dias, com garantia de execução."), ("6.1", "LEI", "Conforme o art. 5 da Lei 14.133/2021, aplica-se o edital.")]


def values(spark, kind, cases, keywords=None, pattern=None):
    """Extracted text of each (items, anchor)."""
    rows = [(i, [tuple(x) for x in items], anchor) for i, (items, anchor) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, items array<struct<item_number:string,title:string,content:string>>, anchor string")
    words = F.array(*(F.lit(k) for k in keywords)) if keywords else F.array().cast("array<string>")
    value = extract.value_text(kind, extract.extract(kind, F.col("items"), F.col("anchor"), words, F.lit(pattern).cast("string")))
    return [r["v"] for r in df.select("i", value.alias("v")).orderBy("i").collect()]


def one(text):
    return [("1", "", text)]


CASES = [
    ("numero_inteiro", ITEMS, "vigência", "90"),
    ("numero_inteiro", ITEMS, None, "90"),
    ("numero_inteiro", ITEMS, "6.1", "5"),
    ("numero_inteiro", ITEMS, "não existe", None),
    ("numero_inteiro", ITEMS, "9.9", None),
    ("numero_inteiro", one("4.3.8 Vigência: 90 dias, com garantia."), "vigência", "90"),
    ("numero_inteiro", one("O quantitativo é de 10000 unidades."), None, "10000"),
    ("numero_inteiro", one("O total é de 10000."), None, "10000"),
    ("numero_inteiro", one("Item 4.3 e R$ 1.500,00."), None, None),
    ("numero_extenso", one("Aqui o prazo será trinta dias."), "prazo", "30"),
    ("numero_extenso", one("Prazo de vinte e um dias."), "prazo", "21"),
    ("numero_extenso", one("Prazo de cento e oitenta dias."), "prazo", "100"),
    ("data", one("Entrega até 15/12/2026, improrrogável."), "entrega", "2026-12-15"),
    ("data", one("Entrega até 31/02/2026."), "entrega", None),
    ("data", one("Entrega imediata."), "entrega", None),
    ("percentual", one("Reajuste anual de 4,5% sobre o valor."), "reajuste", "4.5"),
    ("monetario", one("Valor: R$ 1.500,00"), "valor", "1500.0"),
    ("monetario", one("Valor: R$ 1500,00"), "valor", "1500.0"),
    ("monetario", one("Valor: R$ 1.500."), "valor", "1500.0"),
    ("cnpj", one("Empresa 11.222.333/0001-81"), None, "11.222.333/0001-81"),
    ("cnpj", one("Empresa 11.222.333/0001-00"), None, None),
    ("cnpj", one("CNPJ: 12.345.678/0001-95"), "cnpj", "12.345.678/0001-95"),
    ("cnpj", one("Empresa 11111111111111"), None, None),
    ("prazo_relativo", one("Vigência pelo prazo de 30 (trinta) dias."), "vigência", "30 dias"),
    ("prazo_relativo", one("Vigência de trinta DIAS."), "vigência", "trinta dias"),
    ("cep", one("Entrega no CEP 40015-000 em Salvador."), "cep", "40015-000"),
]


@pytest.mark.parametrize("kind", sorted({c[0] for c in CASES}))
def test_literal_cases(spark, kind):
    cases = [c for c in CASES if c[0] == kind]
    assert values(spark, kind, [(c[1], c[2]) for c in cases]) == [c[3] for c in cases]


def test_keywords_and_patterns(spark):
    assert values(spark, "booleano", [(ITEMS, None), (ITEMS, "não existe")], ["garantia"]) == ["sim", None]
    assert values(spark, "booleano", [(ITEMS, None)], ["seguro", "apólice"]) == ["não"]
    assert values(spark, "booleano", [(ITEMS, None)]) == [None]
    assert values(spark, "legal", [(ITEMS, None)], pattern=r"14\.133/2021") == ["sim"]
    assert values(spark, "legal", [(ITEMS, None)], pattern=r"8\.666/1993") == ["não"]


def test_empty_items_and_nulls(spark):
    assert values(spark, "numero_inteiro", [([], None), ([("1", None, None)], None)]) == [None, None]


def test_decimal_separators(spark):
    rows = [("1.500,00", 1500.0), ("1500.00", 1500.0), ("1,500.00", 1500.0), ("12,34", 12.34), ("12.34", 12.34), ("x", None), (None, None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, a string")
    assert [r["d"] for r in df.select("i", extract.decimal(F.col("a")).alias("d")).orderBy("i").collect()] == [b for _, b in rows]


def spec_integer(text):
    """The look-around form of the integer rule."""
    m = re.search(r"(?<![0-9.,])([0-9]{1,3}(?:\.[0-9]{3})+|[0-9]{1,9})(?![0-9])(?![.,][0-9])", text)
    return m[1].replace(".", "") if m else None


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("0123456789., a", max_size=14), min_size=60, max_size=60))
def test_integer_equals_its_look_around_form(spark, texts):
    got = values(spark, "numero_inteiro", [(one("x " + t), None) for t in texts])
    assert got == [None if (w := spec_integer("x " + t)) is None else str(int(w)) for t in texts]
