"""Office files to text. DOCX and ODT are read with the standard library; PDF and OCR engines are plug-ins."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Marks and XML names.
TITLE, BULLET, TABLE, TABLE_END = "[TÍTULO] ", "  • ", "[TABELA]", "[/TABELA]"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ODF_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
ODF_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
MAX_PAGES, MIN_CHARS = 500, 100
#: Bytes that one entry of an archive may have when unpacked.
MAX_UNPACKED = 512 << 20

#: A PDF reader: bytes to page texts.
PdfReader = Callable[[bytes], list[str]]


def _marked(rows: list[list[str]]) -> list[str]:
    lines = [" | ".join(cells) for cells in rows if any(cells)]
    return [TABLE, *lines, TABLE_END] if lines else []


def _word_text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" if t.tag == f"{WORD}t" else "\n" for t in node.iter() if t.tag in (f"{WORD}t", f"{WORD}br")).strip()


def _entry(z: zipfile.ZipFile, name: str) -> bytes:
    """An archive's entry, if it isn't too large when unpacked, whatever the archive says of itself."""
    with z.open(name) as f:
        raw = f.read(MAX_UNPACKED + 1)
    if len(raw) > MAX_UNPACKED:
        raise ValueError(f"{name} is larger than {MAX_UNPACKED} bytes")
    return raw


def docx_text(raw: bytes) -> str:
    """Paragraphs with headings and list items marked, then all tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(_entry(z, "word/document.xml")).find(f"{WORD}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for style in ElementTree.fromstring(_entry(z, "word/styles.xml")).iter(f"{WORD}style"):
                label = style.find(f"{WORD}name")
                names[style.get(f"{WORD}styleId")] = label.get(f"{WORD}val") if label is not None else ""
    out = []
    for p in body.findall(f"{WORD}p") if body is not None else []:
        text = _word_text(p)
        if text:
            used = p.find(f"{WORD}pPr/{WORD}pStyle")
            key = used.get(f"{WORD}val") if used is not None else ""
            style = (names.get(key) or key or "").lower()
            out.append((TITLE if "heading" in style or "título" in style else BULLET if "list" in style else "") + text)
    for table in body.findall(f"{WORD}tbl") if body is not None else []:
        out += _marked([[_word_text(c) for c in row.findall(f"{WORD}tc")] for row in table.findall(f"{WORD}tr")])
    return "\n".join(out)


def odt_text(raw: bytes) -> str:
    """Paragraphs and headings in order, then the tables again as rows."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(_entry(z, "content.xml"))
    out = []
    for node in root.iter():
        if node.tag in (f"{ODF_TEXT}p", f"{ODF_TEXT}h"):
            text = "".join(node.itertext()).strip()
            if text:
                out.append((TITLE if node.tag.endswith("}h") else "") + text)
    for table in root.iter(f"{ODF_TABLE}table"):
        out += _marked([["".join(c.itertext()).strip() for c in row.iter(f"{ODF_TABLE}table-cell")] for row in table.iter(f"{ODF_TABLE}table-row")])
    return "\n".join(out)


def pdf_pages(raw: bytes, readers: list[PdfReader], ocr: PdfReader | None = None) -> list[str]:
    """Pages of the first reader that works; a page-rich file with hardly any text goes to OCR, whose failure keeps what there was."""
    reasons = []
    for read in readers:
        try:
            pages = read(raw)
        except Exception as e:
            reasons.append(str(e))
            continue
        if len(pages) > MAX_PAGES:
            raise ValueError(f"more than {MAX_PAGES} pages")
        if ocr and pages and sum(map(len, pages)) < MIN_CHARS:
            try:
                pages = ocr(raw) or pages
            except Exception as e:
                reasons.append(str(e))
        return pages
    raise ValueError("no PDF reader could read the file: " + ("; ".join(reasons) or "none is installed"))


def parsed(files: DataFrame, pdf_readers: list[PdfReader] | None = None, ocr: PdfReader | None = None) -> DataFrame:
    """(path, text, pages, error) of files (path, content); a file that can't be read is a row with its error."""

    def one(path: str, raw: bytes) -> tuple[str | None, list[dict], str | None]:
        kind = path.rsplit(".", 1)[-1].lower()
        try:
            if kind == "pdf":
                pages = [p for p in pdf_pages(raw, pdf_readers or [], ocr)]
            elif kind in ("docx", "odt"):
                pages = [docx_text(raw) if kind == "docx" else odt_text(raw)]
            else:
                raise ValueError(f"unknown file type {kind}")
            text = "\n\n".join(p for p in pages if p.strip())
            if not text.strip():
                raise ValueError("no text in the file")
            return text, [{"page": i + 1, "text": p} for i, p in enumerate(pages)], None
        except Exception as e:  # whatever a broken or encrypted file raises
            return None, [], f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *one(p, c)) for p, c in batch[["path", "content"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "text", "pages", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, pages array<struct<page:int,text:string>>, error string")


def office_files(spark: SparkSession, path: str, glob: str = "*.{pdf,docx,odt}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, text) of whole text files."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return raw.select("path", F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("stem"), "text")


def with_manifest(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files that a manifest (stem, law_number, law_title) lists; those missing are left out."""
    return manifest.join(corpus, "stem")
