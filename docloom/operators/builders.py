"""Leaves of hierarchies from contents, tables and prose, and the line-island operators they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.functions import script
from docloom.operators import pages as page_text
from docloom.operators import tables, terms

PERIOD_WORDS = r"(?i)quarter|period|ending|ended|तिमाही|अवधि|समाप्त"
#: Lines that a masthead heading may have below it, and that a list heading is looked for.
MASTHEAD_LINES, LIST_LINES, LIST_LEAST = 6, 15, 2


def contents_leaves(entries: DataFrame) -> DataFrame:
    """(document_id, path, value): section > title > author and section > title > page of contents entries."""
    part = lambda name, value: F.struct(F.array("section_original", "title_original", F.lit(name)).alias("path"), value.cast("string").alias("value"))
    both = F.array(part("author", F.col("author_original")), part("page", F.col("page_number")))
    return entries.select("document_id", F.explode(both).alias("x")).filter("x.value IS NOT NULL").select("document_id", "x.path", "x.value")


def table_leaves(cells: DataFrame) -> DataFrame:
    """(document_id, path, value): table > row label > header of filled cells; a label is the row's first cell that is no number.

    Rows without a label are named by their number. A header that is blank inherits the one to its left.
    """
    text = F.trim(F.coalesce("value", F.lit("")))
    rows = cells.withColumn("v", text).filter("v <> ''")
    whole = Window.partitionBy("table_id", "row_index")
    label_at = F.min(F.when(~F.col("v").rlike(nb.NUMBER), F.col("col_index"))).over(whole)
    label = F.min_by("v", F.when(~F.col("v").rlike(nb.NUMBER), F.col("col_index"))).over(whole)
    left = Window.partitionBy("table_id", "row_index").orderBy("col_index").rowsBetween(Window.unboundedPreceding, 0)
    header = F.coalesce(F.last(F.when(~F.col("header").rlike("^(Column [0-9]+)?$"), F.col("header")), ignorenulls=True).over(left), F.col("header"))
    rows = rows.withColumn("label_at", label_at).withColumn("label", F.coalesce(label, F.concat(F.lit("Row "), (F.col("row_index") + 1).cast("string")))).withColumn("h", header)
    return rows.filter(F.col("label_at").isNull() | (F.col("col_index") != F.col("label_at"))).select("document_id", F.array("table_id", "label", "h").alias("path"), F.col("v").alias("value"))


def lines_of(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, line_no, line) of page texts."""
    return pages.select("document_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def prose_leaves(lines: DataFrame) -> DataFrame:
    """(document_id, path, value): the first `key : value` of each key in a document."""
    pattern = r"^\s*[-•*]?\s*([^:\n]{2,80}?)\s*[:：]\s*(\S.*?)\s*$"
    pairs = lines.withColumn("key", F.regexp_extract("line", pattern, 1)).filter("key <> ''").withColumn("value", F.regexp_extract("line", pattern, 2))
    first = F.row_number().over(Window.partitionBy("document_id", F.lower("key")).orderBy("page_number", "line_no"))
    return pairs.withColumn("n", first).filter("n = 1").select("document_id", F.array("key").alias("path"), "value")


def islands(lines: DataFrame, is_heading: Column, is_item: Column, most: int) -> DataFrame:
    """Adds heading and nth to the items right below a heading: up to `most`, until the first line that is no item."""
    order = Window.partitionBy("document_id", "page_number").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("_h", is_heading).withColumn("_i", is_item & ~is_heading).withColumn("island", F.sum(F.col("_h").cast("int")).over(so_far)).filter("island > 0")
    own = Window.partitionBy("document_id", "page_number", "island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("heading", F.first(F.trim("line")).over(own)).withColumn("nth", F.row_number().over(Window.partitionBy("document_id", "page_number", "island").orderBy("line_no")) - 1)
    df = df.withColumn("_broken", F.max(~F.col("_h") & ~F.col("_i")).over(own))
    return df.filter(F.col("_i") & ~F.col("_broken") & (F.col("nth") <= most)).drop("_h", "_i", "_broken")


def masthead_leaves(lines: DataFrame) -> DataFrame:
    """(document_id, path, value): names below a heading such as Editor or Patron."""
    heading = F.trim("line").rlike(r"(?i)^(chief )?(editor(ial board)?|sub[- ]editor|patron|guidance|संपादक.*|संरक्षक.*|मार्गदर्शन.*)\s*:?$")
    name = F.trim("line").rlike(r"^[^0-9:]{3,60}$")
    return islands(lines, heading, name, MASTHEAD_LINES).groupBy("document_id", "page_number", "island", "heading").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.trim("line").alias("t")))), lambda x: x["t"]), ", ").alias("value")).select("document_id", F.array(F.rtrim(F.regexp_replace("heading", ":$", ""))).alias("path"), "value")


def list_leaves(lines: DataFrame) -> DataFrame:
    """(document_id, path, value): items below a line that ends in a colon, two or more of them."""
    heading, item = F.trim("line").rlike(r"[:：]$"), F.trim("line").rlike(r"^([-•*]|\(?[0-9a-zA-Z]{1,3}[.)])\s*\S")
    found = islands(lines, heading, item, LIST_LINES)
    enough = F.count(F.lit(1)).over(Window.partitionBy("document_id", "page_number", "island"))
    bare = F.regexp_replace(F.trim("line"), r"^([-•*]|\(?[0-9a-zA-Z]{1,3}[.)])\s*", "")
    return found.withColumn("n", enough).filter(F.col("n") >= LIST_LEAST).select("document_id", F.array(F.regexp_replace("heading", r"\s*[:：]$", ""), F.concat(F.lit("item "), F.col("nth").cast("string"))).alias("path"), bare.alias("value"))


def assemble(parts: list[DataFrame], reports: DataFrame, contents_part: int = 0) -> DataFrame:
    """Leaves of a document from parts in order of preference: a first key that an earlier part has is left out later; contents count for non-reports alone."""
    parts = list(parts)
    parts[contents_part] = parts[contents_part].join(reports.select("document_id").distinct(), "document_id", "left_anti")
    ranked = [p.select("document_id", "path", "value", F.lit(i).alias("part")) for i, p in enumerate(parts)]
    every = ranked[0]
    for p in ranked[1:]:
        every = every.unionByName(p)
    best = F.min("part").over(Window.partitionBy("document_id", F.lower(F.col("path")[0])))
    return every.withColumn("best", best).filter("part = best").drop("part", "best")


def period_fields(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, label, value) of lines with a date and a period word."""
    df = lines_of(pages).filter(F.col("line").rlike(nb.DATE) & F.col("line").rlike(PERIOD_WORDS))
    return df.select("document_id", "page_number", F.trim(F.regexp_replace("line", nb.DATE + r".*$", "")).alias("label"), nb.period_text(F.col("line")).alias("value"))


def address_continuation(lines: DataFrame) -> DataFrame:
    """Adds value: an address line and the next one where that is no field of its own."""
    after = F.lead("line").over(Window.partitionBy("document_id", "page_number").orderBy("line_no"))
    own = F.trim(F.regexp_extract("line", r"[:：]\s*(.*)$", 1))
    more = F.when(F.col("after").isNotNull() & ~F.col("after").rlike("[:：]") & (F.trim("after") != ""), F.concat(F.lit(", "), F.trim("after"))).otherwise("")
    return lines.withColumn("after", after).filter(F.lower("line").rlike(r"address|पता")).withColumn("value", F.concat(own, more)).drop("after")


def form_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, cells) of the form blocks of pages: a two-column table for each page with enough `label : value` lines."""
    pairs = terms.form_pairs(pages)
    tid = F.concat("document_id", F.lit(":p"), F.col("page_number").cast("string"), F.lit(":form"))
    rows = pairs.withColumn("table_id", tid).withColumn("row_index", (F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("position")) - 1).cast("int"))
    return _made(rows, ["Field", "Value"], ["label", "value"], "key_value_form")


def period_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, cells) of lines with a date and a period word: a table of one row for each."""
    rows = period_fields(pages)
    nth = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("label", "value"))
    rows = rows.withColumn("table_id", F.concat("document_id", F.lit(":p"), F.col("page_number").cast("string"), F.lit(":period"), nth.cast("string"))).withColumn("row_index", F.lit(0))
    return _made(rows, ["Period", "Value"], ["label", "value"], "period_field_pattern")


def _made(rows: DataFrame, headers: list[str], columns: list[str], method: str) -> tuple[DataFrame, DataFrame]:
    cells = F.array(*[F.struct(F.lit(i).alias("col_index"), F.lit(h).alias("header"), F.col(c).alias("value")) for i, (h, c) in enumerate(zip(headers, columns, strict=True))])
    long = rows.select("document_id", "table_id", "row_index", F.explode(cells).alias("c")).select("document_id", "table_id", "row_index", "c.*")
    return rows.select("document_id", "table_id", "page_number", F.lit(method).alias("extraction_method")).distinct(), long


def extracted_tables(pages: DataFrame, matrices: DataFrame | None = None, native: str = "docx_xml") -> tuple[DataFrame, DataFrame]:
    """(tables, cells) of documents: native matrices (document_id, table_id, matrix, page_number), form blocks, then period fields.

    Cells are cleaned and normalised; tables of one page with the same headers and rows are one, the first by id. Each
    table has its heading (from its page), extraction method and confidence.
    """
    parts = [form_tables(pages), period_tables(pages)]
    if matrices is not None:
        clean = F.transform("matrix", lambda row: F.transform(row, lambda v: script.repair(F.coalesce(v, F.lit("")))))
        rows = matrices.withColumn("matrix", clean)
        page = F.col("page_number") if "page_number" in matrices.columns else F.lit(None).cast("int")
        own = rows.select("document_id", "table_id", page.alias("page_number"), F.lit(native).alias("extraction_method"))
        parts.insert(0, (own, tables.matrix_cells(rows).join(own.select("document_id", "table_id"), "table_id")))
    every, cells = parts[0]
    for t, c in parts[1:]:
        every, cells = every.unionByName(t), cells.unionByName(c)
    whole = cells.groupBy("document_id", "table_id").agg(F.array_sort(F.collect_set(F.struct("col_index", "header"))).alias("headers"), F.collect_list(F.struct("row_index", "col_index", "value")).alias("c"))
    by_row = F.transform(F.array_distinct(F.transform("c", lambda x: x["row_index"])), lambda i: F.struct(F.array_join(F.transform(F.array_sort(F.filter("c", lambda x: x["row_index"] == i)), lambda x: F.coalesce(x["value"], F.lit(""))), "\u001f").alias("row")))
    unique = tables.dedup_tables(every.join(whole, ["document_id", "table_id"]).withColumn("rows", by_row)).select("document_id", "table_id", "page_number", "extraction_method")
    cells = cells.join(unique.select("table_id"), "table_id", "left_semi")
    forms = every.filter(~F.col("extraction_method").isin("docx_xml", "pdfplumber")).select("table_id").distinct()
    sure = tables.confidence(cells.join(forms, "table_id", "left_anti")).unionByName(tables.confidence(cells.join(forms, "table_id", "left_semi"), form=True))
    headings = pages.select("document_id", "page_number", page_text.heading(F.col("text")).alias("heading"))
    listed = unique.join(headings, ["document_id", "page_number"], "left").join(sure, "table_id", "left")
    return listed, cells


def document_leaves(entries: DataFrame, cells: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Leaves of documents from contents, tables, forms and prose, mastheads and lists, in this order of preference.

    Contents count for documents that aren't reports; a first key that an earlier part has is left out later.
    """
    lines = lines_of(pages)
    pairs = terms.form_pairs(pages).filter("value_state <> 'blank'").select("document_id", F.array("label").alias("path"), "value")
    reports = documents.filter("document_type = 'report'")
    return assemble([contents_leaves(entries), table_leaves(cells), pairs, address_leaves(lines), masthead_leaves(lines), prose_leaves(lines), list_leaves(lines)], reports)


def address_leaves(lines: DataFrame) -> DataFrame:
    """(document_id, path, value) of address lines that go on in the next one."""
    return address_continuation(lines).filter("value <> '' AND contains(value, ', ')").select("document_id", F.array(F.lit("Full address")).alias("path"), "value").dropDuplicates(["document_id"])
