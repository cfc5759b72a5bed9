"""Cells as answers: candidates of matrix and key-value tables, clauses, regional expansion and display."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.functions.script import generic_header
from docloom.operators import evidence, tables

#: The letters of regions in Devanagari, Latin and spelled out.
REGION_NAMES = {"क": ("क", "a", "ka"), "ख": ("ख", "b", "kha"), "ग": ("ग", "c", "ga")}
CONJUNCTION = r"\s+(?:and|aur|और|एवं|तथा|evam)\s+|\s*[,;&]\s*"
NUMERIC = r"^[-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?$"
#: The score from which a regional row answers with all regions of its column.
EXPAND_FROM = 6.0


def region_flags(text: Column) -> Column:
    """The regions (क, ख, ग) that a text names, in three scripts, before or after the word."""
    found = []
    for letter, names in REGION_NAMES.items():
        any_of = "|".join(names)
        found.append(F.when(text.rlike(rf"(?i)(?:region|kshetra|क्षेत्र)\s*[‘'\"“(]?\s*(?:{any_of})(?![A-Za-z\x{{0900}}-\x{{097F}}])|(?<![A-Za-z\x{{0900}}-\x{{097F}}])[‘'\"“(]?\s*(?:{any_of})\s*[’'\"”)]?\s*(?:region|kshetra|क्षेत्र)"), letter))
    return F.array_compact(F.array(*found))


def table_topic(headers: Column) -> Column:
    """The first header that says something; null where none does."""
    return F.get(F.filter(headers, lambda h: ~generic_header(h)), F.lit(0))


def clauses_of(question: str) -> list[str]:
    """Parts of a question between conjunctions, of two words or more."""
    return [c.strip() for c in re.split(CONJUNCTION, question) if len(c.split()) >= 2]


def strip_bullet(label: str, question: str) -> str:
    """A label without its clause mark, such as (a) or 2., unless the question names the mark."""
    m = re.match(r"^\s*(\(?(?:[0-9]{1,2}|[ivx]{1,4}|[a-zA-Zक-ह])[.)])\s*", label)
    mark = m[1].strip("().").lower() if m else ""
    return label if not m or re.search(rf"\(\s*{re.escape(mark)}\s*\)|\b(?:clause|item|point)\s+{re.escape(mark)}\b", question.lower()) else label[m.end() :]


def matrix_candidates(cells: DataFrame) -> DataFrame:
    """Cells that may answer (table_id, row_index, col_index, header, label, description, value, display, regions) of matrix tables.

    Rows before the first one with an integer are headers, and so is a row of column numbers; a blank header inherits the
    one to its left, and a column's headers are joined. A row's label is what stands before its first number.
    """
    text = F.trim(F.coalesce("value", F.lit("")))
    grid = cells.select("table_id", "row_index", "col_index", "header", F.when(text.isin(":", "："), "").otherwise(text).alias("v"))
    integer, number = F.col("v").rlike("^[0-9]+$"), F.col("v").rlike(NUMERIC)
    rows = grid.filter(integer).groupBy("table_id", "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "v"))), lambda x: x["v"].try_cast("int")).alias("n"))
    numbering = (F.size("n") >= 2) & (F.col("n") == F.sequence(F.lit(1), F.size("n")))
    first = rows.filter(~numbering).groupBy("table_id").agg(F.min("row_index").alias("first_row"))
    grid = grid.join(first, "table_id")
    meaningful = F.when((F.col("v") != "") & ~integer, F.col("v"))
    across = Window.partitionBy("table_id", "row_index").orderBy("col_index").rowsBetween(Window.unboundedPreceding, 0)
    heads = grid.filter("row_index < first_row").withColumn("h", F.last(meaningful, ignorenulls=True).over(across)).filter("h IS NOT NULL")
    subs = heads.groupBy("table_id", "col_index").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "h"))), lambda x: x["h"])), " | ").alias("sub"))
    topics = cells.groupBy("table_id").agg(table_topic(F.transform(F.array_sort(F.collect_set(F.struct("col_index", "header"))), lambda x: x["header"])).alias("topic"))
    data = grid.filter("row_index >= first_row AND v <> ''")
    own = Window.partitionBy("table_id", "row_index")
    data = data.withColumn("first_number", F.min(F.when(number, F.col("col_index"))).over(own)).filter("first_number IS NOT NULL")
    labels = data.filter("col_index < first_number").groupBy("table_id", "row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "v"))), lambda x: x["v"]), " ").alias("row_label"))
    out = data.filter("col_index >= first_number").join(labels, ["table_id", "row_index"], "left").join(subs, ["table_id", "col_index"], "left").join(topics, "table_id")
    out = out.withColumn("row_label", F.coalesce("row_label", F.lit(""))).withColumn("has_sub", F.max(F.col("sub").isNotNull()).over(Window.partitionBy("table_id")))
    sub = F.when(F.col("sub").isNotNull(), F.col("sub")).when(~F.col("has_sub") & ~generic_header(F.col("header")), F.col("header"))
    out = out.withColumn("sub", sub)
    plain = F.col("sub").isNull() | generic_header(F.col("sub")) | F.contains("row_label", "sub")
    label = F.when(plain, F.col("row_label")).when(F.col("row_label") == "", F.col("sub")).otherwise(F.concat("row_label", F.lit(" ("), "sub", F.lit(")")))
    out = out.withColumn("label", label).withColumn("description", F.array_join(F.array_distinct(F.array_compact(F.array("topic", "row_label", F.when(~plain, F.col("sub"))))), " "))
    return out.select("table_id", "row_index", "col_index", "header", "label", "description", F.col("v").alias("value"), F.concat_ws(": ", "label", "v").alias("display"), region_flags(F.col("row_label")).alias("regions"))


def key_value_candidates(cells: DataFrame) -> DataFrame:
    """matrix_candidates() of tables with a colon column: the cell after the colon, described by what stands before it and by its parents."""
    rows = tables.key_values(cells).filter("value <> ''")
    return rows.select("table_id", "row_index", F.lit(0).alias("col_index"), F.lit("").alias("header"), "label", F.concat_ws(" ", "prefix", "label").alias("description"), "value", F.concat_ws(": ", "label", "value").alias("display"), region_flags(F.concat_ws(" ", "prefix", "label")).alias("regions"))


def candidates(cells: DataFrame) -> DataFrame:
    """All cells that may answer: key-value tables by their colon, others as matrices."""
    pairs = key_value_candidates(cells)
    matrices = cells.join(pairs.select("table_id").distinct(), "table_id", "left_anti")
    return pairs.unionByName(matrix_candidates(matrices))


def scored(cands: DataFrame, variants: list[list[str]], expected: str | None = None, regions: tuple[str, ...] = (), counting: bool = False) -> DataFrame:
    """Candidates with their best score over the question and its variants of three words or more; 3.0 and more are kept, the best first."""
    queries = [v for i, v in enumerate(variants) if i == 0 or len(v) >= 3]
    rows = evidence.cell_scores(cands, queries, expected, regions, counting)
    return rows.orderBy(F.desc("score"), "table_id", "row_index", "col_index")


def picked(rows: list[dict], regions: tuple[str, ...] = ()) -> list[dict]:
    """Of candidates in order of score the best; with regions asked for, its column's cell of each; a regional best of 6.0 without, every region of its column."""
    best = rows[0]
    same = [r for r in rows if (r["table_id"], r["col_index"]) == (best["table_id"], best["col_index"])]
    if regions:
        each = [next((r for r in same if region in r["regions"]), None) for region in regions]
        return [r for r in each if r] or [best]
    if best["regions"] and best["score"] >= EXPAND_FROM:
        every: dict[tuple, dict] = {}
        for r in same:
            if r["regions"]:
                every.setdefault(tuple(sorted(r["regions"])), r)
        return list(every.values())
    return [best]


def display(rows: list[dict], question: str = "") -> str:
    """A yes or no alone; otherwise the distinct cells with their labels, a line each; numbers are never added up."""
    if len(rows) == 1 and rows[0]["value"].strip().lower() in ("yes", "no", "हाँ", "हां", "नहीं"):
        return rows[0]["value"].strip()
    return "\n".join(dict.fromkeys(strip_bullet(r["display"], question) for r in rows))


def lasts(value: str, label: str) -> bool:
    """Whether a cell states a duration."""
    return bool(re.search(r"[0-9]\s*(?:years?|months?|days?|hours?|weeks?|वर्ष|साल|माह|महीने|दिन|घंटे)|(?:years?|months?|days?|hours?|वर्ष|साल|माह|महीने|दिन|घंटे)\b", f"{value} {label}".lower()))


def numeric(value: Column) -> Column:
    """The number of a cell, without its unit."""
    return nb.parse_amount(value)[0]
