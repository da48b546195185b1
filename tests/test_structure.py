from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lavra.operators import structure


def renamed(names):
    out, taken = [], set()
    for n in names:
        name, i = n, 0
        while name in taken:
            i += 1
            name = f"{n}-{i}"
        taken.add(name)
        out.append(name)
    return out


def test_ten_thousand_clashing_numbers():
    names = ["1", "1-1"] * 3 + ["1"] * 10_000 + ["1-1"] * 50
    began = time.perf_counter()
    name = structure.Names()
    got = [name(n) for n in names]
    assert time.perf_counter() - began < 2
    assert got == renamed(names[:200]) + got[200:] and len(set(got)) == len(got)


def test_names_equal_one_by_one(spark):
    rng = random.Random(7)
    for _ in range(30):
        names = rng.choices(["1", "1-1", "1-2", "1-1-1", "2", ""], k=40)
        name = structure.Names()
        assert [name(n) for n in names] == renamed(names)
    rows = [(k, i, rng.choice(["1", "1-1", "2"])) for k in ("a", "b", None) for i in range(300)]
    got = structure.renamed_duplicates(spark.createDataFrame(rows, "k string, i int, n string").repartition(4), "k", "n", "i").orderBy("i").collect()
    for k in ("a", "b", None):
        assert [r["n"] for r in got if r["k"] == k] == renamed([n for kk, _, n in rows if kk == k])


def test_clashing_items_of_one_document(spark):
    text = "\n".join(f"1. item {i}" if i % 2 else f"1.1 item {i}" for i in range(10_000))
    began = time.perf_counter()
    n = structure.items(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("item_number").distinct().count()
    assert n == 10_000 and time.perf_counter() - began < 20


def test_lines_of_all_kinds(spark):
    text = "\n".join([
        "antes", "1.", "", "DO OBJETO", "linha", "[TABELA]", "a | b", "", "[TABELA]", "c | d", "[/TABELA]", "depois da tabela", "2.", "3.", "SEI nº 5", "a) letra", "[/TABELA]", "texto",
        "[TABELA]", "[/TABELA]", "IV - romano", "1.1 m²", "4. R$ 5", "ANEXO II – Modelo", "CLÁUSULA PRIMEIRA", "5.", "[TABELA]", "x", "[/TABELA]", "fim", "[TABELA]", "sem fim", "6. perdido",
    ])
    got = structure.items(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("item_order").collect()
    assert [(r["item_number"], r["item_type"], r["pos"], r["content"]) for r in got] == [
        ("1", "section", 3, "1. DO OBJETO\nlinha"), ("TAB-2", "table", 10, "c | d"), ("a", "subitem", 15, "a) letra\ntexto"), ("IV", "section", 20, "IV - romano\n1.1 m²\n4. R$ 5"),
        ("ANEXO II", "annex", 23, "ANEXO II – Modelo"), ("CLÁUSULA PRIMEIRA", "section", 24, "CLÁUSULA PRIMEIRA"), ("TAB-7", "table", 28, "x"), ("5", "section", 29, "5. fim"),
    ]


def test_documents_stay_apart(spark):
    rows = [(1, "1. um"), (1, "1. um"), (None, "x"), (2, ""), (3, None), (4, " só texto \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("pos", "line", "first", "whole", "opens")})
    got = sorted((r["doc_id"] or 0, r["item_order"], r["item_number"], r["content"]) for r in structure.items(docs.coalesce(1)).collect())
    assert got == [(0, 0, "1", "x"), (1, 0, "1", "1. um"), (1, 0, "1", "1. um"), (4, 0, "1", "só texto")]
    assert structure.items(docs, fallback=False).count() == 2
    assert structure.items(docs.limit(0)).count() == 0


@pytest.mark.parametrize("line", ["1 - x", "12. y", "1.2.3.4 z", "1.2.3 z", "a. b", "b ) c", "x- d", "Iv) e", "anexo  IX: f", "Anexo 3 g", "DAS coisas", "DO X", "CLÁUSULA 2", "[TÍTULO] T", "nada", "123. n", "(a) n", "xyz", "– 1. n"])
def test_the_guard_lets_all_openings_pass(line):
    java = {k: re.sub(r"\\p\{L\}", "a-zA-ZÀ-ÿ", p) for k, p in structure.OPENINGS.items()}
    opens = any(re.match(p.replace("(?iu)", "(?i)"), line) for p in java.values())
    assert not opens or re.match(structure.MAY_OPEN, line)
