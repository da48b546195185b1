"""Structure of a document's text: lines to numbered items.

A line that opens an item has a number, a letter, a roman numeral, or is a
clause, a title or an annex; the lines up to the next opening are the item's
content. Marked tables are items of their own. The patterns are column
expressions; a document's lines are folded in their order, in batches, where the
document is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import itemgetter, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lavra.functions.text import strip, title_number

# Units that show a table cell rather than a title.
UNITS = (
    "btu", "kw", "kg", "m", "m²", "m³", "cm", "mm", "un", "unid", "und", "dia", "dias", "h", "hr", "hora", "horas", "l", "ml", "r$", "pct", "%", "ton", "t",
    "m³/h", "l/min", "v", "w",
)
# Marks of page footers.
FOOTERS = ("referência: processo", "sei nº", "sei n.", "termo de referência / projeto básico", "telefone:", "www.", "pg.", "processo nº", "cep")
# Opening patterns, in the order in which they are tried.
OPENINGS = {
    "annex": r"(?iu)^(ANEXO\s+[IVXLCDM0-9]+)\s*[.\-–]?\s*(.*)",
    "clause": r"^(CLÁUSULA\s+[\p{L}0-9_]+|D[OA]S?\s+.+)",
    "title": r"^\[TÍTULO\]\s+(.+)",
    "letter": r"^([a-z])\s*[).]\s+(.+)",
    "roman": r"(?i)^((?=[XIV])X{0,3}(?:IX|IV|V?I{0,3}))\s*[).\-]\s+(.+)",
    "level4": r"^([0-9]{1,2}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\s*\.?\s+(.+)",
    "level3": r"^([0-9]{1,2}\.[0-9]{1,3}\.[0-9]{1,3})\s*\.?\s+(.+)",
    "level2": r"^([0-9]{1,2}\.[0-9]{1,3})\s*\.?\s+(.+)",
    "section": r"^([0-9]{1,2})\s*[.\-–]\s+(.+)",
}
TYPES = {"annex": "annex", "clause": "section", "title": "section", "letter": "subitem", "roman": "section", "level4": "subitem", "level3": "subitem", "level2": "item", "section": "section"}
#: How a line begins that any of these may fit; most lines are done with it.
MAY_OPEN = r"^(?:(?i:anexo)\s|CLÁUSULA\s|D[OA]S?\s|\[TÍTULO\]\s|[a-z]\s*[).]|[xivXIV]+\s*[).\-]|[0-9]{1,2}\s*[.\-–])"
#: Openings that a table cell can't be.
GUARDED = ("letter", "roman", "level2", "section")
#: Openings that begin with a digit.
NUMBERED = ("level4", "level3", "level2", "section")
#: What a row of a document is: its whole text, a line, a mark that opens or closes a table, a lone number, a footer, a closed table.
WHOLE, LINE, OPEN, CLOSE, NUMBER, FOOTER, TABLE = range(-1, 6)
LONE_NUMBER = r"^[0-9]{1,2}(\.[0-9]{1,3})*\.$"
TITLE_CHARS, CLAUSE_CHARS = 200, 50
#: Rows that a batch of folded documents holds at least.
BATCH_ROWS = 4096


def footer_like(line: Column) -> Column:
    return reduce(or_, (F.contains(F.lower(line), F.lit(x)) for x in FOOTERS))


def table_cell(title: Column) -> Column:
    """Whether a title is only a unit or an amount."""
    return F.lower(strip(title)).rlike(rf"^(?:{'|'.join(map(re.escape, UNITS))})?$|^dias úteis|^r\$")


def opening(line: Column) -> Column:
    """(number, title, type) of the item that a line opens, or null. The first pattern that fits decides, also against."""
    numbered, other = None, None
    for name, pattern in OPENINGS.items():
        first, second = strip(F.regexp_extract(line, pattern, 1)), None
        if name in ("clause", "title"):
            number = F.left(first, F.lit(CLAUSE_CHARS)) if name == "clause" else title_number(first)
            title = first
        else:
            second = strip(F.regexp_extract(line, pattern, 2))
            number = F.lower(first) if name == "letter" else F.upper(first) if name == "roman" else first
            title = second if name == "annex" else F.left(second, F.lit(TITLE_CHARS))
        found = F.struct(number.alias("number"), title.alias("title"), F.lit(TYPES[name]).alias("type"))
        if name in GUARDED:
            found = F.when(~table_cell(second), found)
        fits = line.rlike(pattern)
        if name in NUMBERED:
            numbered = F.when(fits, found) if numbered is None else numbered.when(fits, found)
        else:
            other = F.when(fits, found) if other is None else other.when(fits, found)
    # A line that begins with a digit can only fit the patterns that do.
    return F.when(line.rlike(MAY_OPEN), F.when(F.left(line, F.lit(1)).between("0", "9"), numbered).otherwise(other))


def lines_of(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    split = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "raw"))
    return split.select(key, "pos", strip(F.col("raw")).alias("line"))


def _listed(column: pa.Array) -> list:
    """The values; whole numbers and texts go by numpy, which is several times faster."""
    if pa.types.is_string(column.type) or (pa.types.is_integer(column.type) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole documents; a row of the kind WHOLE begins one, so documents of equal keys stay apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("kind").to_numpy() == WHOLE)
        if len(begins):
            last = int(begins[-1])
            if held or last:
                yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
            batch = batch.slice(last)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[object, list[tuple]]]:
    """Each document's key, which is the first column, and the other columns' values by row."""
    keys, *others = map(_listed, batch.columns)
    rows = list(zip(*others, strict=True))
    begins = np.flatnonzero(batch.column("kind").to_numpy() == WHOLE).tolist()
    for begin, end in zip(begins, [*begins[1:], len(rows)], strict=True):
        yield keys[begin], rows[begin:end]


def _cut_at_once(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch | None:
    """What `_cut` makes of all documents, if none has a table."""
    kind, lines = batch.column("kind").to_numpy(), batch.column("line")
    if np.isin(kind, (OPEN, CLOSE)).any():
        return None
    joined = np.flatnonzero((kind[:-1] == NUMBER) & (kind[1:] == LINE))
    places = np.arange(len(kind))
    places[joined + 1] = len(kind) + np.arange(len(joined))
    longer = pc.binary_join_element_wise(lines.take(pa.array(joined)), lines.take(pa.array(joined + 1)), " ")
    rest = np.delete(np.arange(len(kind)), joined)
    found = pa.concat_arrays([lines, longer]).take(pa.array(places[rest]))
    kinds = pa.array(np.where(kind == WHOLE, WHOLE, LINE)[rest], pa.int8())
    return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rest)) for i in (0, 1)), kinds, found], schema=schema)


def _assembled_at_once(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch | None:
    """What `_assembled` makes of all documents, if none has a table or an opening without number and each has an item."""
    kind, opens = batch.column("kind").to_numpy(), np.asarray(batch.column("type").is_valid())
    document = np.cumsum(kind == WHOLE)
    starts = np.flatnonzero(opens)
    own = document[starts]
    numbers = batch.column("number").take(pa.array(starts)).to_pylist()
    if (kind == TABLE).any() or len(np.unique(own)) < document[-1] or "" in numbers:
        return None
    item = np.cumsum(opens)
    inside = (kind == LINE) & (item > 0)
    inside &= np.append(0, own)[item] == document  # a document's lines before its first item belong to none
    begins = np.append(0, np.cumsum(np.bincount(item[inside] - 1, minlength=len(starts))))
    contents = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), batch.column("line").filter(pa.array(inside))), "\n")
    given, name, last = [], Names(), 0
    for number, now in zip(numbers, own.tolist(), strict=True):
        if now != last:
            name, last = Names(), now
        given.append(name(number))
    order = np.arange(len(starts)) - np.searchsorted(own, own)
    key, pos, title, made = (batch.column(c).take(pa.array(starts)) for c in (0, "pos", "title", "type"))
    return pa.RecordBatch.from_arrays([key, pa.array(order, pa.int32()), pa.array(given, pa.string()), title, contents, made, pos], schema=schema)


def _batched(found: Iterator[tuple[object, list[tuple]]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their documents' keys in front, many documents in a batch."""
    held: list[tuple] = []
    for key, rows in found:
        held += ((key, *row) for row in rows)
        if len(held) >= BATCH_ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _cut(rows: list[tuple]) -> list[tuple]:
    """(pos, kind, line): lines of items and closed tables of a document, after a row with its whole text.

    Lone numbers are joined with the next line, unless that is a number or a footer. An open table
    swallows all lines; its rows make an item when its end mark comes.
    """
    out: list[tuple] = [rows[0]]
    table, lone = None, None
    for row in rows[1:]:
        pos, kind, line = row
        if kind == OPEN:
            table = []
        elif kind == CLOSE:
            if table:
                out.append((pos, TABLE, "\n".join(table)))
            table = None
        elif table is not None:
            table.append(line)
        else:
            if lone is not None:
                if kind == LINE:
                    row = (pos, LINE, f"{lone[2]} {line}")
                else:
                    out.append((lone[0], LINE, lone[2]))
                lone = None
            if kind == NUMBER:
                lone = row
            else:
                out.append((row[0], LINE, row[2]))
    if lone is not None:
        out.append((lone[0], LINE, lone[2]))
    out.sort(key=itemgetter(0))
    return out


def _assembled(rows: list[tuple], fallback: bool) -> list[tuple]:
    """(item_order, item_number, title, content, item_type, pos) of a document's lines with their openings."""
    found: list[list] = []  # number, title, lines, type, pos
    inside = False
    for pos, kind, line, number, title, opens in rows[1:]:
        if kind == TABLE:
            found.append([None, "Tabela", [line], "table", pos])
            inside = False
        elif opens is not None:
            found.append([number, title, [line], opens, pos])
            inside = True
        elif inside:
            found[-1][2].append(line)
    whole = rows[0][2]
    if not found and fallback and whole:
        found = [["1", "Documento Completo", [whole], "section", 0]]
    name, out = Names(), []
    for nth, (number, title, lines, kind, pos) in enumerate(found, 1):
        number = f"TAB-{nth}" if number is None else number
        if number != "":
            out.append((len(out), name(number), title, "\n".join(lines), kind, pos))
    return out


class Names:
    """Names that are free: a name that was given already gets the first suffix -1, -2, ... with which it wasn't."""

    def __init__(self):
        self._given: set[str] = set()
        self._next: dict[str, int] = {}

    def __call__(self, wanted: str) -> str:
        name = wanted
        while name in self._given:
            n = self._next.get(wanted, 0) + 1
            self._next[wanted], name = n, f"{wanted}-{n}"
        self._given.add(name)
        return name


def items(texts: DataFrame, key: str = "doc_id", text: str = "text", fallback: bool = True) -> DataFrame:
    """Items of each text: key, item_order, item_number, title, content, item_type, pos (line of the opening).

    Text before the first item or after a table is dropped; a table without an
    end mark swallows the rest; a text without items is one item. A document's
    lines stay where the document is: two folds over them, with the patterns as
    columns in between, and no shuffle.
    """
    key_field = texts.schema[key]
    # The whole text goes before its lines, so that no line carries it along. Blank lines belong to nothing.
    content = F.coalesce(F.col(text), F.lit(""))
    split = texts.select(key, F.posexplode(F.concat(F.array(content), F.split(content, "\n"))).alias("at", "raw")).withColumn("line", strip(F.col("raw")))
    line = F.col("line")
    kinds = F.when(line.startswith("[TABELA]"), OPEN).when(line.startswith("[/TABELA]"), CLOSE).when(line.rlike(LONE_NUMBER), NUMBER).when(footer_like(line), FOOTER).otherwise(LINE)
    kind = F.when(F.col("at") == 0, WHOLE).otherwise(kinds)
    marked = split.filter("at = 0 or line != ''").select(key, (F.col("at") - 1).alias("pos"), kind.cast("byte").alias("kind"), "line")

    def folded(fold: Callable[[list[tuple]], list[tuple]], at_once: Callable[..., pa.RecordBatch | None], schema: StructType) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape = to_arrow_schema(schema)
            for batch in _complete(batches):
                whole = at_once(batch, shape)
                if whole is not None:
                    yield whole
                else:
                    yield from _batched(((own, fold(rows)) for own, rows in _documents(batch)), shape)

        return run

    cut = StructType([key_field, *StructType.fromDDL("pos int, kind byte, line string").fields])
    made = StructType([key_field, *StructType.fromDDL("item_order int, item_number string, title string, content string, item_type string, pos int").fields])
    opened = marked.mapInArrow(folded(_cut, _cut_at_once, cut), cut).withColumn("opens", F.when(F.col("kind") == LINE, opening(F.col("line"))))
    flat = opened.select(key, "pos", "kind", "line", "opens.number", "opens.title", "opens.type")
    return flat.mapInArrow(folded(lambda rows: _assembled(rows, fallback), _assembled_at_once, made), made)


def renamed_duplicates(table: DataFrame, key: str, number: str, order: str) -> DataFrame:
    """A number that a row of the key before has already gets the first suffix -1, -2, ... whose name is free.

    Each name depends on those before it, so a key's rows are read in order; only its names are held.
    """
    dealt = table.repartition(key).sortWithinPartitions(key, order)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, name = object(), Names()
        for batch in batches:
            out = []
            for own, wanted in zip(batch.column(key).to_pylist(), batch.column(number).to_pylist(), strict=True):
                if own != last:
                    last, name = own, Names()
                out.append(wanted if wanted is None else name(wanted))
            at = batch.schema.get_field_index(number)
            yield batch.set_column(at, number, pa.array(out, pa.string()))

    return dealt.mapInArrow(named, table.schema)


def pages_of_lines(lines: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The page of each line: the last page whose first line isn't after it. pages: key, page, text."""
    w = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    size = F.size(F.split("text", "\n")) + 1  # pages are joined by a blank line
    starts = pages.withColumn("pos", F.coalesce(F.sum(size).over(w), F.lit(0))).select(key, "pos", "page", F.lit(None).cast("string").alias("line"), F.lit(0).alias("kind"))
    both = lines.select(key, "pos", F.lit(None).cast("int").alias("page"), "line", F.lit(1).alias("kind")).unionByName(starts.withColumn("page", F.col("page").cast("int")))
    upto = Window.partitionBy(key).orderBy("pos", "kind")
    return both.withColumn("page", F.last("page", ignorenulls=True).over(upto)).filter("kind = 1").drop("kind")
