"""Text of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that end a block, tags whose text counts as such, tags without text.
BLOCKS = ("p", "div", "br", "h1", "h2", "h3", "h4")
PARAGRAPHS = ("p", "h1", "h2", "h3", "h4")
SILENT = ("script", "style")


class _Events(HTMLParser):
    """What a page consists of, in order: ("<", tag), (">", tag) and ("", text)."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, attrs: self.found.append(("<", tag))
        self.handle_endtag = lambda tag: self.found.append((">", tag))
        self.handle_data = lambda text: self.found.append(("", text))
        self.feed(html)
        self.close()


#: Stands for the end of a block; no page text holds it, as blanks of this kind are white space.
_CUT = "\x1c"


def page_blocks(html: str | None) -> str:
    """A page's blocks, one a line, blanks between words made single.

    Blanks between tags inside a block stay as one blank; they separate words that a browser shows apart.
    """
    pieces, depth = [], 0
    for kind, value in _Events(html or "").found:
        if kind and value in SILENT:
            depth = depth + 1 if kind == "<" else max(0, depth - 1)
        elif depth == 0:
            ends = (kind == "<" and value in BLOCKS) or (kind == ">" and value in PARAGRAPHS)
            pieces.append(_CUT if ends else "" if kind else value.replace(_CUT, " "))
    blocks = (" ".join(block.split()) for block in "".join(pieces).split(_CUT))
    return "\n".join(filter(None, blocks))


@F.pandas_udf(T.StringType())
def page_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A page's text, one line per block; entities and comments need a parser, so this runs in Arrow batches."""
    for batch in pages:
        yield batch.map(page_blocks)


def page_title(html: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " ")


def charset(head: Column, content_type: Column | None = None, default: str = "latin-1") -> Column:
    """The named charset in a page's first 4096 characters, else that of the content type, else latin-1."""
    named = F.nullif(F.regexp_extract(F.lower(F.left(head, F.lit(4096))), r"charset=[\"']?([A-Za-z0-9_-]+)", 1), F.lit(""))
    if content_type is None:
        return F.coalesce(named, F.lit(default))
    return F.coalesce(named, F.nullif(F.trim(F.regexp_extract(content_type, r";[^;]*charset[^=;]*=\s*\"?([^;\"]+)", 1)), F.lit("")), F.lit(default))
