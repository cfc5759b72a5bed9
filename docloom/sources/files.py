"""File sources: DOCX pages and tables, page and text folders, format dispatch."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A single page of more words is cut into virtual pages of fewer, on blank lines.
SPLIT_OVER, PAGE_WORDS = 450, 400
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FORMATS = {"pdf": "pdf", "docx": "docx", "doc": "doc", "txt": "text"}


def file_type(path: str) -> str:
    """The format by extension; other formats are an error."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file type: {path}")
    return FORMATS[suffix]


def _paragraph(p: ET.Element) -> str:
    return "".join(n.text or "" if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" if n.tag == f"{_W}br" and n.get(f"{_W}type") != "page" else "" for n in p.iter()).strip()


def _breaks(p: ET.Element) -> bool:
    return any((n.tag == f"{_W}br" and n.get(f"{_W}type") == "page") or n.tag == f"{_W}lastRenderedPageBreak" for n in p.iter())


def _body(data: bytes) -> ET.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return root.find(f"{_W}body")


def docx_tables(data: bytes) -> list[list[list[str]]]:
    """Rows of cell texts of each table."""
    return [[["\n".join(filter(None, map(_paragraph, c.iter(f"{_W}p")))) for c in row.findall(f"{_W}tc")] for row in t.findall(f"{_W}tr")] for t in _body(data).iter(f"{_W}tbl")]


def docx_pages(data: bytes) -> list[str]:
    """Texts of the pages: breaks part them, table rows read `a : b : c`, one long page is cut on blank lines."""
    pages: list[list[str]] = [[]]
    for block in _body(data):
        if block.tag == f"{_W}p":
            if _breaks(block) and pages[-1]:
                pages.append([])
            pages[-1].append(_paragraph(block))
        elif block.tag == f"{_W}tbl":
            for row in block.findall(f"{_W}tr"):
                cells = [" ".join(filter(None, map(_paragraph, c.iter(f"{_W}p")))) for c in row.findall(f"{_W}tc")]
                pages[-1].append(" : ".join(c for c in cells if c))
    texts = [t for t in ("\n".join(p).strip() for p in pages) if t]
    if len(texts) == 1 and len(texts[0].split()) > SPLIT_OVER:
        out: list[str] = []
        for part in re.split(r"\n\s*\n", texts[0]):
            if out and len((out[-1] + " " + part).split()) <= PAGE_WORDS:
                out[-1] += "\n\n" + part
            else:
                out.append(part)
        return out
    return texts


def _files(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None) -> DataFrame:
    """(document_id, content) of a folder's files, of some extensions; temporary files (~$) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        files = files.option("pathGlobFilter", "*.{" + ",".join(sorted({x for e in extensions for x in (e.lower(), e.upper())})) + "}")
    name = F.try_element_at(F.split("path", "/"), F.lit(-1))
    return files.load(folder).select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("document_id"), "content").filter(~F.startswith(F.col("document_id"), F.lit("~$")))


PAGES = "document_id string, page_number int, location string, text string, error string"
TABLES = "document_id string, table_id string, page_number int, matrix array<array<string>>"


def page_rows(document_id: str, content: bytes, parsers: dict[str, Callable[[bytes], list[str]]]) -> list[tuple]:
    """The rows (as PAGES) of a file; one row with its error, if it can't be read."""
    try:
        kind = file_type(document_id)
        if kind in parsers:
            texts = parsers[kind](content)
        elif kind in ("pdf", "doc"):
            raise ValueError(f"no parser for {kind} files; give one, or load their pages as a table")
        else:
            texts = docx_pages(content) if kind == "docx" else content.decode("utf-8", "replace").split("\f")
        return [(document_id, i, f"Page {i}", t, None) for i, t in enumerate(texts, 1) if t.strip()]
    except Exception as e:  # one bad file doesn't end the ingest
        return [(document_id, None, None, None, f"{type(e).__name__}: {e}")]


def table_rows(document_id: str, content: bytes, parsers: dict[str, Callable[[bytes], list[tuple[int | None, list[list[str]]]]]]) -> list[tuple]:
    """The rows (as TABLES) of a file; none of a file that can't be read."""
    try:
        kind = file_type(document_id)
        found = parsers[kind](content) if kind in parsers else [(None, m) for m in docx_tables(content)]
    except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError):
        return []
    return [(document_id, f"{document_id}:p{page or 'document'}:t{i}", page, m) for i, (page, m) in enumerate(found, 1)]


def read_pages(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes], list[str]]] | None = None, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Pages (document_id, page_number, location, text, error) of the files of a folder, of some extensions.

    DOCX and text are read here; parsers take the bytes of other kinds (pdf, doc) to the texts of their pages, and a
    kind without one says so in `error`. A file that can't be read gives one row with its error.
    """
    files, own = _files(spark, folder, extensions), parsers or {}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for doc, content in zip(pdf["document_id"], pdf["content"], strict=True) for r in page_rows(doc, content, own)]
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "location", "text", "error"]).astype({"page_number": "Int32"})

    return files.mapInPandas(parse, PAGES)


def read_tables(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes], list[tuple[int | None, list[list[str]]]]]] | None = None) -> DataFrame:
    """Matrices (document_id, table_id, page_number, matrix) of the tables of a folder's files.

    DOCX tables have no page; parsers take the bytes of other kinds to (page, rows) pairs. A file that can't be read
    has no tables; read_pages() reports it.
    """
    own = parsers or {}
    files = _files(spark, folder, ("docx", *own))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for doc, content in zip(pdf["document_id"], pdf["content"], strict=True) for r in table_rows(doc, content, own)]
            yield pd.DataFrame(rows, columns=["document_id", "table_id", "page_number", "matrix"]).astype({"page_number": "Int32"})

    return files.mapInPandas(parse, TABLES)


def ingest_totals(pages: DataFrame) -> DataFrame:
    """One row over read_pages(): files, failed, pages, words, characters, and the errors by file."""
    failed = F.col("error").isNotNull()
    return pages.agg(F.count_distinct("document_id").alias("files"), F.count_distinct(F.when(failed, F.col("document_id"))).alias("failed"), F.count("page_number").alias("pages"), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"\S+"))), F.lit(0)).cast("long").alias("words"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("characters"), F.map_from_entries(F.array_sort(F.collect_list(F.when(failed, F.struct("document_id", "error"))))).alias("errors"))
