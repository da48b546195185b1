"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Accented letters and what they become without accents.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"

QUERY_CHARS = 500
SNIPPET_CHARS = 400


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def normalize(x: Column) -> Column:
    """Trimmed, lower case, runs of white space as one blank."""
    return F.regexp_replace(F.lower(strip(x)), r"\s+", " ")


def clean_query(x: Column) -> Column:
    """Trimmed, lower case, cut to 500 characters, then runs of white space as one blank."""
    return F.regexp_replace(F.left(F.lower(strip(x)), F.lit(QUERY_CHARS)), r"\s+", " ")


def unaccented(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def tokens(x: Column) -> Column:
    """Words of letters and digits, lower case, without accents."""
    return F.array_remove(F.split(unaccented(x), "[^0-9a-z]+"), "")


def quoted_term(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit("")), F.lit('"'))


def snippet(x: Column, chars: int = SNIPPET_CHARS) -> Column:
    """Trimmed, line breaks as blanks, cut."""
    return F.left(F.replace(strip(x), F.lit("\n"), F.lit(" ")), F.lit(chars))


def natural_key(x: Column) -> Column:
    """Sort key in which runs of digits, of any length, compare as numbers and stand before letters.

    A run is written without leading zeros behind its length in six digits.
    """
    parts = F.regexp_extract_all(x, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda p: F.ltrim(p, F.lit("0"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(number(p)).cast("string"), 6, "0"), number(p))).otherwise(p)), "")


def article_reference(line: Column) -> Column:
    """`Art. X` without trailing dots, else the line's first 60 characters."""
    found = F.regexp_extract(line, r"^Art\.\s*(\S+)", 1)
    return F.when(found != "", F.concat(F.lit("Art. "), F.rtrim(found, F.lit(".")))).otherwise(F.left(line, F.lit(60)))


def first_replaced(x: Column, old: Column, new: Column) -> Column:
    """The text with the first occurrence of `old` replaced; unchanged without one."""
    at = F.call_function("locate", old, x)
    return F.when((F.length(old) > 0) & (at > 0), F.overlay(x, new, at, F.length(old))).otherwise(x)


def non_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def shown(x: Column) -> Column:
    """A value for people: null and empty as `não informado`."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("não informado"))


def split_keywords(x: Column) -> Column:
    """Comma-separated keywords, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, ","), lambda w: F.trim(w)), lambda w: w != "")


def contains_ci(x: Column, part: Column) -> Column:
    return F.contains(F.lower(x), F.lower(part))


def table_row(cells: Column) -> Column:
    """Cells as ` | `-joined text; null cells are empty."""
    return F.array_join(F.transform(cells, lambda c: F.coalesce(F.trim(c), F.lit(""))), " | ")


def marked_table(rows: Column) -> Column:
    """A table of cells between its marks."""
    return F.concat_ws("\n", F.lit("[TABELA]"), F.array_join(F.transform(rows, table_row), "\n"), F.lit("[/TABELA]"))


def money(x: Column) -> Column:
    """Brazilian amount: `R$ 1.234,56`."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(x, 2), ",.", ".,"))


def moment(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "dd/MM/yyyy 'às' HH:mm"), F.lit("N/A"))


def naive_as_utc(x: Column, zone: str = "UTC") -> Column:
    return F.to_utc_timestamp(x, zone)


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    """The text in Unicode's composed form, for which Spark has no function."""
    return x.str.normalize("NFC")


def title_number(title: Column) -> Column:
    """A number for a title that is the same in every run; the title should be in NFC (see `nfc`)."""
    return F.concat(F.lit("T-"), (F.conv(F.substring(F.sha2(title, 256), 1, 12), 16, 10).cast("decimal(20,0)") % 100000).cast("int").cast("string"))
