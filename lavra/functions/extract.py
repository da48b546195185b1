"""Typed value extraction by declarative rules.

A rule has a type and, for most types, an anchor. The anchored text of a
document's items is searched for the first valid value of the type. Every
function is a column expression, so a rule set compiles into one projection.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
NUMBER_WORDS = {
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "três": 3, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10,
    "onze": 11, "doze": 12, "treze": 13, "catorze": 14, "quatorze": 14, "quinze": 15, "dezesseis": 16, "dezessete": 17, "dezoito": 18, "dezenove": 19,
    "vinte": 20, "trinta": 30, "quarenta": 40, "cinquenta": 50, "sessenta": 60, "setenta": 70, "oitenta": 80, "noventa": 90, "cem": 100, "cento": 100,
    "duzentos": 200, "trezentos": 300, "quatrocentos": 400, "quinhentos": 500, "seiscentos": 600, "setecentos": 700, "oitocentos": 800, "novecentos": 900,
}
# Patterns of numbers, periods and postal codes.
INTEGER = r"(?<![0-9.,])([0-9]{1,3}(?:\.[0-9]{3})+|[0-9]{1,9})(?:[.,]?(?![0-9.,])|[.,][.,])"
WORD = "[a-záàâãéêíóôõúçü]+"
PERCENT = r"(?<![\p{L}0-9_])([0-9]+(?:[.,][0-9]+)?)\s*%"
AMOUNT = r"(?<![\p{L}0-9_])R\$\s*([0-9]{1,3}(?:\.[0-9]{3})+,[0-9]{2}|[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+,[0-9]{2}|[0-9]+)(?![0-9])(?![.,][0-9])"
DAY = r"(?<![\p{L}0-9_])([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![\p{L}0-9_])"
COMPANY = r"(?<![\p{L}0-9_])([0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}|[0-9]{14})(?![\p{L}0-9_])"
PERIOD_WORDS = r"um|dois|três|quatro|cinco|seis|sete|oito|nove|dez|quinze|vinte|trinta|sessenta|noventa|cento\s+e\s+oitenta"
PERIOD = rf"(?iu)(?<![\p{{L}}0-9_])([0-9]+|(?:{PERIOD_WORDS})(?![\p{{L}}0-9_]))\s*(?:\([^)]*\))?\s*(dias|meses|anos)(?![\p{{L}}0-9_])"
PERIOD_NUMBER = rf"(?iu)^(?:[0-9]+|{PERIOD_WORDS})"
POSTAL = r"(?<![\p{L}0-9_])([0-9]{5}-[0-9]{3}|[0-9]{8})(?![\p{L}0-9_])"
NUMBERED_ANCHOR = r"^[0-9]{1,3}(\.[0-9]{1,3})*$"

TYPES = ("numero_inteiro", "numero_extenso", "booleano", "legal", "data", "percentual", "monetario", "cnpj", "prazo_relativo", "cep")
NUMERIC = ("numero_inteiro", "numero_extenso", "percentual", "monetario")
WHOLE_ITEM = ("booleano", "legal")


def item_text(item: Column) -> Column:
    return F.concat(F.coalesce(item["title"], F.lit("")), F.lit("\n"), F.coalesce(item["content"], F.lit("")))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def searched(items: Column) -> Column:
    """The items as rules search them: number, text, and the text in lower case, which is made once for all rules."""
    texts = F.transform(items, lambda i: F.struct(i["item_number"].alias("number"), item_text(i).alias("text")))
    return F.transform(texts, lambda i: F.struct(i["number"].alias("number"), i["text"].alias("text"), F.lower(i["text"]).alias("low")))


def everything(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda i: i["text"]), "\n")


def of_number(texts: Column, number: Column) -> Column:
    return F.get(F.filter(texts, lambda i: i["number"] == number), F.lit(0))["text"]


def holding(texts: Column, low: Column, whole: bool) -> Column:
    """The first text that holds the lower-case anchor, from the anchor on or whole."""
    found = F.get(F.filter(texts, lambda i: F.contains(i["low"], low)), F.lit(0))
    return found["text"] if whole else bound(found, lambda i: F.substring(i["text"], F.call_function("locate", low, i["low"]), F.length(i["text"])))


def anchored(texts: Column, anchor: str | Column | None, whole: bool = False) -> Column:
    """The text a rule searches, or empty; `texts` are searched items.

    Without an anchor: all items. A numbered anchor: the item of that number.
    Any other: the first item that holds it, from the place on (or whole). An
    anchor that the caller knows leaves one of the three alone in the plan.
    """
    if isinstance(anchor, Column):
        key = F.trim(anchor)
        found = F.when(anchor.isNull() | (anchor == ""), everything(texts)).when(key.rlike(NUMBERED_ANCHOR), of_number(texts, key)).otherwise(holding(texts, F.lower(key), whole))
    elif not anchor:
        found = everything(texts)
    elif re.fullmatch(NUMBERED_ANCHOR, anchor.strip(" ")):
        found = of_number(texts, F.lit(anchor.strip(" ")))
    else:
        found = holding(texts, F.lower(F.lit(anchor.strip(" "))), whole)
    return F.coalesce(found, F.lit(""))


def integer(text: Column) -> Column:
    """First whole number: dotted thousands or up to nine digits, no decimals, not part of a longer number."""
    return F.replace(F.regexp_extract(text, INTEGER, 1), F.lit("."), F.lit("")).try_cast("bigint")


def _words_map() -> Column:
    return F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))


def number_word(text: Column) -> Column:
    """First number word; a ten followed by a unit is one number."""
    known = _words_map()
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\s+e\s+", " "), F.lit(f"({WORD})"), F.lit(1))
    values = F.transform(words, lambda w: F.try_element_at(known, w))
    at = F.call_function("array_position", F.transform(values, lambda v: v.isNotNull()), F.lit(True)).cast("int")
    value, following = F.get(values, at - 1), F.get(values, at)
    return F.when(at > 0, F.when(value.between(20, 90) & (F.coalesce(following, F.lit(10)) < 10), value + following).otherwise(value)).cast("bigint")


def has_keywords(text: Column, keywords: Column) -> Column:
    """Whether all keywords occur; null without keywords or text."""
    return F.when((F.size(keywords) > 0) & (text != ""), F.forall(keywords, lambda k: F.contains(F.lower(text), F.lower(k))))


def matches(text: Column, pattern: Column) -> Column:
    """Whether the pattern occurs in any case; null without pattern or text."""
    return F.when((pattern != "") & (text != ""), F.regexp_like(text, F.concat(F.lit("(?iu)"), pattern)))


def date(text: Column) -> Column:
    """First d/m/yyyy that is in the calendar."""
    days = F.transform(F.regexp_extract_all(text, F.lit(DAY), F.lit(1)), lambda d: F.try_to_date(d, "d/M/yyyy"))
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))


def decimal(number: Column) -> Column:
    """A number with Brazilian or plain separators: of two kinds, the last is the decimal one; a lone comma is."""

    def plain(x: Column) -> Column:
        comma, dot = F.contains(x, F.lit(",")), F.contains(x, F.lit("."))
        comma_last = F.call_function("locate", F.lit(","), F.reverse(x)) < F.call_function("locate", F.lit("."), F.reverse(x))
        dotted = F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return F.when(comma & dot & ~comma_last, F.replace(x, F.lit(","), F.lit(""))).when(comma, dotted).otherwise(x)

    return F.trim(bound(number, plain)).try_cast("double")


def percent(text: Column) -> Column:
    return decimal(F.nullif(F.regexp_extract(text, PERCENT, 1), F.lit("")))


def amount(text: Column) -> Column:
    """First amount after R$; dots group thousands, a comma starts the cents."""
    found = F.nullif(F.regexp_extract(text, AMOUNT, 1), F.lit(""))
    return F.replace(F.replace(found, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def _check_digit(digits: Column, weights: list[int]) -> Column:
    products = F.zip_with(F.slice(digits, 1, len(weights)), F.array(*(F.lit(w) for w in weights)), lambda d, w: d * w)
    return F.aggregate(products, F.lit(0), lambda a, x: a + x, lambda a: F.when(a % 11 < 2, 0).otherwise(11 - a % 11))


def valid_company(number: Column) -> Column:
    """Both mod-11 check digits of a company's tax number hold, and its digits aren't all alike."""
    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    digits = F.transform(F.split(number, ""), lambda d: d.try_cast("int"))
    ends = (_check_digit(digits, first) == F.get(digits, F.lit(12))) & (_check_digit(digits, [6, *first]) == F.get(digits, F.lit(13)))
    return number.rlike("^[0-9]{14}$") & ~number.rlike(r"^([0-9])\1{13}$") & ends


def company(text: Column) -> Column:
    """First valid tax number of a company, with its punctuation."""
    found = F.transform(F.regexp_extract_all(text, F.lit(COMPANY), F.lit(1)), lambda x: F.regexp_replace(x, "[./-]", ""))
    d = F.get(F.filter(found, valid_company), F.lit(0))
    return F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")


def period(text: Column) -> Column:
    """First period, as its number or number word and its unit."""
    # The text is searched once; number and unit are read from what was found.
    found = F.regexp_substr(text, F.lit(PERIOD))
    return bound(found, lambda x: F.when(x.isNotNull(), F.concat(F.regexp_extract(x, PERIOD_NUMBER, 0), F.lit(" "), F.lower(F.right(x, F.when(x.rlike("(?iu)meses$"), 5).otherwise(4))))))


def postal_code(text: Column) -> Column:
    raw = F.nullif(F.replace(F.regexp_extract(text, POSTAL, 1), F.lit("-"), F.lit("")), F.lit(""))
    return F.concat(F.substring(raw, 1, 5), F.lit("-"), F.substring(raw, 6, 3))


_EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "numero_inteiro": integer,
    "numero_extenso": number_word,
    "data": date,
    "percentual": percent,
    "monetario": amount,
    "cnpj": company,
    "prazo_relativo": period,
    "cep": postal_code,
}


def extract(kind: str, items: Column, anchor: str | Column | None, keywords: Column | None = None, pattern: Column | None = None) -> Column:
    """The value of a rule of a type known to the caller, typed as its extractor types it; null if there is none."""
    return bound(searched(items), lambda texts: _value(kind, texts, anchor, keywords, pattern))


def _value(kind: str, texts: Column, anchor: str | Column | None, keywords: Column | None, pattern: Column | None) -> Column:
    text = anchored(texts, anchor, whole=kind in WHOLE_ITEM)
    if kind == "booleano":
        return bound(text, lambda t: has_keywords(t, keywords))
    if kind == "legal":
        return bound(text, lambda t: matches(t, pattern))
    return bound(text, lambda t: F.when(t != "", _EXTRACTORS[kind](t)))


def value_text(kind: str, value: Column) -> Column:
    """A value as it is stored: sim or não, ISO dates, numbers as they print."""
    if kind in WHOLE_ITEM:
        return F.when(value, F.lit("sim")).when(~value, F.lit("não"))
    if kind == "data":
        return F.date_format(value, "yyyy-MM-dd")
    return value.cast("string")


def _stored(rule: dict, texts: Column) -> Column:
    """The stored form of a rule's value; rules are small driver-side configuration."""
    keywords = F.array(*(F.lit(k) for k in rule.get("palavras_chave") or ())) if rule.get("palavras_chave") else F.array().cast("array<string>")
    value = _value(rule["tipo"], texts, rule.get("ancora"), keywords, F.lit(rule.get("regex")).cast("string"))
    return value_text(rule["tipo"], value)


def extract_text(rule: dict, items: Column) -> Column:
    return bound(searched(items), lambda texts: _stored(rule, texts))


def compile_rules(rules: list[dict], items: Column) -> Column:
    """One array of (regra_id, tipo, valor) for all rules: a single projection over a document's items, which are read once."""
    return bound(searched(items), lambda texts: F.array(*(F.struct(F.lit(r["id"]).alias("regra_id"), F.lit(r["tipo"]).alias("tipo"), _stored(r, texts).alias("valor")) for r in rules)))
