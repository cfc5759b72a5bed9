"""Table cells: normal form, carry-forward, confidence, arithmetic and chunks.

A table is long: (table_id, row_index, col_index, header, value), so that every operator is a window or an
aggregate by table and no task holds more than one table's rows of a key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers as nb

#: Fixed values of the extraction confidence.
CONFIDENCE_BASE, CONFIDENCE_RECTANGULAR, CONFIDENCE_TABLE, CONFIDENCE_FORM = 0.45, 0.35, 0.15, 0.05


def cells_long(df: DataFrame, table_id: Column, row_index: Column, columns: list[str]) -> DataFrame:
    """A wide table's columns as cells; every value as text."""
    cells = F.array(*[F.struct(F.lit(i).alias("col_index"), F.lit(c).alias("header"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(table_id.alias("table_id"), row_index.alias("row_index"), F.explode(cells).alias("c")).select("table_id", "row_index", "c.col_index", "c.header", "c.value")


def matrix_cells(matrices: DataFrame) -> DataFrame:
    """Cells of (table_id, matrix ARRAY<ARRAY<STRING>>) with unique headers from the first row; empty rows go, short rows are padded."""
    trimmed = F.transform("matrix", lambda row: F.transform(row, lambda v: F.trim(F.coalesce(v, F.lit("")))))
    rows = F.filter(trimmed, lambda row: F.exists(row, lambda v: v != ""))
    wide = matrices.select("table_id", rows.alias("rows")).filter(F.size("rows") > 1)
    width = F.array_max(F.transform("rows", F.size))
    wide = wide.select("table_id", width.alias("width"), F.col("rows")[0].alias("head"), F.slice("rows", 2, F.size("rows")).alias("body"))
    wide = wide.withColumn("headers", unique_headers(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get("head", i), F.lit("")))))
    lines = wide.select("table_id", "width", "headers", F.posexplode("body").alias("row_index", "row"))
    cells = lines.select("table_id", "row_index", F.col("row"), F.posexplode("headers").alias("col_index", "header"))
    return cells.select("table_id", "row_index", "col_index", "header", F.coalesce(F.get("row", F.col("col_index")), F.lit("")).alias("value"))


def unique_headers(headers: Column) -> Column:
    """Blank headers become Column i; a repeated header gets (n)."""
    named = F.transform(headers, lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(F.trim(h)))
    return F.transform(named, lambda h, i: F.when((n := F.size(F.filter(F.slice(named, 1, i + 1), lambda x: x == h))) > 1, F.concat(h, F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(h))


def confidence(cells: DataFrame, form: bool = False) -> DataFrame:
    """(table_id, extraction_confidence): the share of rows with enough filled cells counts for 0.35."""
    filled = F.count_if(F.trim(F.coalesce("value", F.lit(""))) != "")
    rows = cells.groupBy("table_id", "row_index").agg(filled.alias("filled"), F.count(F.lit(1)).alias("width"))
    full = F.avg((F.col("filled") >= F.greatest(F.lit(2), F.col("width") - 1)).cast("double"))
    return rows.groupBy("table_id").agg(F.round(CONFIDENCE_BASE + CONFIDENCE_RECTANGULAR * full + (CONFIDENCE_FORM if form else CONFIDENCE_TABLE), 4).alias("extraction_confidence"))


def fill_right(cells: DataFrame) -> DataFrame:
    """A blank cell inherits the last filled one to its left in the row."""
    w = Window.partitionBy("table_id", "row_index").orderBy("col_index").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("filled", F.last(F.when(F.trim(F.coalesce("value", F.lit(""))) != "", F.col("value")), ignorenulls=True).over(w))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, reset: Column | None = None, name: str = "carried") -> DataFrame:
    """The last non-null value so far by key; a reset row begins anew."""
    if reset is not None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_group", F.sum(reset.cast("int")).over(w))
        keys = [*keys, "_group"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w)).drop("_group")


#: Words that name an operation, in order of precedence.
OPERATIONS = {
    "difference": ("difference", "differ", "differs", "अंतर", "antar"), "max": ("maximum", "highest", "largest", "most", "सबसे अधिक", "अधिकतम"), "min": ("minimum", "lowest", "smallest", "least", "सबसे कम", "न्यूनतम"),
    "average": ("average", "mean", "औसत"), "percentage": ("percent", "percentage", "%", "प्रतिशत"), "sum": ("sum", "total", "totals", "कुल", "योग"),
}


def operation_of(question: str) -> str:
    """difference, max, min, average, percentage, sum or lookup; the first of which a whole word occurs. "at least" and "at most" are no operation."""
    low = re.sub(r"\bat (?:least|most)\b", " ", question.lower())
    for name, words in OPERATIONS.items():
        if any(w in low if w == "%" else re.search(rf"(?<![\wऀ-ॿ]){w}(?![\wऀ-ॿ])", low) for w in words):
            return name
    return "lookup"


def numeric_column(cells: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(table_id, col_index) of the numeric column (2 numbers or more) whose header has most of the wanted words; the first otherwise."""
    amount, _ = nb.parse_amount(F.col("value"))
    numeric = cells.withColumn("a", amount).groupBy("table_id", "col_index", "header").agg(F.count("a").alias("n")).filter("n >= 2")
    hits = sum((F.contains(F.lower("header"), F.lit(w.lower())).cast("int") for w in wanted or []), F.lit(0))
    return numeric.groupBy("table_id").agg(F.max_by("col_index", F.struct(hits.alias("hits"), (-F.col("col_index")).alias("first"))).alias("col_index"))


def amounts(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_id, row_index, amount, unit, label): the numbers of the chosen columns; a label is the row's first cell that is no number."""
    amount, unit = nb.parse_amount(F.col("value"))
    rows = cells.withColumn("amount", amount).withColumn("unit", unit)
    labels = rows.groupBy("table_id", "row_index").agg(F.min_by("value", F.when(F.col("amount").isNull() & (F.trim("value") != ""), F.col("col_index"))).alias("label"))
    return rows.join(columns, ["table_id", "col_index"]).filter("amount IS NOT NULL").join(labels, ["table_id", "row_index"]).select("table_id", "row_index", "amount", "unit", "label")


def extremes(df: DataFrame, key: str, amount: str, order: str, payload: list[str]) -> DataFrame:
    """The largest and the smallest amount by key with its payload: the first row wins ties."""
    most, least = (F.struct(F.col(amount).alias("a"), (-F.col(order)).alias("o")) for _ in range(2))
    low = F.struct((-F.col(amount)).alias("a"), (-F.col(order)).alias("o"))
    out = [F.max(amount).alias("max_amount"), F.min(amount).alias("min_amount")]
    out += [F.max_by(c, most).alias(f"max_{c}") for c in payload] + [F.max_by(c, low).alias(f"min_{c}") for c in payload]
    return df.groupBy(key).agg(*out)


def guarded_average(df: DataFrame, key: str, amount: str, unit: str) -> DataFrame:
    """(key, n, total, average): no answer where rows have more than one unit."""
    units = F.count_distinct(F.when(F.trim(F.col(unit)) != "", F.lower(F.trim(F.col(unit)))))
    total = F.sum(F.col(amount))
    agg = df.groupBy(key).agg(F.count(amount).alias("n"), total.alias("t"), units.alias("u"))
    ok = F.col("u") <= 1
    return agg.select(key, "n", F.when(ok, F.col("t")).alias("total"), F.when(ok, F.col("t") / F.col("n")).alias("average"))


def difference(df: DataFrame, key: str, amount: str, order: list[str]) -> DataFrame:
    """(key, difference): absolute value of the last minus the first number; 2 rows or more."""
    place = F.struct(*order)
    agg = df.groupBy(key).agg(F.count(amount).alias("n"), F.min_by(amount, place).alias("first"), F.max_by(amount, place).alias("last"))
    return agg.filter("n >= 2").select(key, F.abs(F.col("last") - F.col("first")).alias("difference"))


def calculate(cells: DataFrame, question: str) -> DataFrame:
    """(table_id, answer, unit, label) for an arithmetic question; no row where units disagree or numbers are missing."""
    op, words = operation_of(question), [w for w in question.lower().split() if len(w) > 2]
    rows = amounts(cells, numeric_column(cells, words))
    one_unit = F.count_distinct(F.when(F.col("unit") != "", F.lower("unit"))) <= 1
    unit = F.first(F.when(F.col("unit") != "", F.col("unit")), ignorenulls=True)
    first, last = F.min_by(F.struct("amount", "unit"), "row_index"), F.max_by(F.struct("amount", "unit"), "row_index")
    if op in ("max", "min"):
        best = (F.max_by if op == "max" else F.min_by)(F.struct("amount", "unit", "label"), F.struct("amount", (-F.col("row_index") if op == "max" else F.col("row_index")).alias("r")))
        return rows.groupBy("table_id").agg(best.alias("b")).select("table_id", F.col("b.amount").alias("answer"), "b.unit", "b.label")
    if op == "difference":
        agg = rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), first.alias("f"), last.alias("l")).filter("n >= 2")
        return agg.select("table_id", F.abs(F.col("l.amount") - F.col("f.amount")).alias("answer"), F.when(F.lower("l.unit") == F.lower("f.unit"), F.col("l.unit")).otherwise("").alias("unit"), F.lit(None).cast("string").alias("label"))
    value = F.avg("amount") if op == "average" else F.sum("amount")
    agg = rows.groupBy("table_id").agg(value.alias("answer"), unit.alias("unit"), one_unit.alias("ok")).filter("ok")
    return agg.select("table_id", "answer", F.coalesce("unit", F.lit("")).alias("unit"), F.lit(None).cast("string").alias("label"))


def key_values(cells: DataFrame) -> DataFrame:
    """(table_id, row_index, label, value, prefix) of rows with a colon cell: the cell before it, after it, and earlier ones, carried forward."""
    row = cells.groupBy("table_id", "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "value"))), lambda c: F.trim(F.coalesce(c["value"], F.lit("")))).alias("v"))
    row = row.withColumn("colon", F.array_position("v", ":")).filter("colon > 1")
    at = F.col("colon").cast("int")
    out = row.select("table_id", "row_index", F.col("v")[at - 2].alias("label"), F.coalesce(F.get("v", at), F.lit("")).alias("value"), F.array_join(F.filter(F.slice("v", 1, at - 2), lambda x: x != ""), " ").alias("own"))
    return carry_forward(out.withColumn("own", F.when(F.col("own") != "", F.col("own"))), ["table_id"], ["row_index"], "own", name="prefix").drop("own")


def table_chunks(cells: DataFrame) -> DataFrame:
    """(id, table_id, chunk_type, row_index, text): one summary, and one chunk for each row, of every table."""
    row = cells.groupBy("table_id", "row_index").agg(F.array_sort(F.collect_list(F.struct("col_index", "header", "value"))).alias("c"))
    filled = F.filter("c", lambda c: F.trim(F.coalesce(c["value"], F.lit(""))) != "")
    rows = row.withColumn("text", F.array_join(F.transform(filled, lambda c: F.concat(c["header"], F.lit(": "), c["value"])), " | ")).filter("text <> ''")
    rows = rows.select(F.concat("table_id", F.lit(":r"), F.col("row_index").cast("string")).alias("id"), "table_id", F.lit("row").alias("chunk_type"), "row_index", "text")
    head = cells.groupBy("table_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("col_index", "header"))), lambda c: c["header"])).alias("h"), F.count_distinct("row_index").alias("n"))
    summary = head.select(F.concat("table_id", F.lit(":summary")).alias("id"), "table_id", F.lit("summary").alias("chunk_type"), F.lit(None).cast("int").alias("row_index"), F.concat(F.array_join("h", " | "), F.lit(" ("), F.col("n").cast("string"), F.lit(" rows)")).alias("text"))
    return summary.unionByName(rows.withColumn("row_index", F.col("row_index").cast("int")))


def field_chunks(pairs: DataFrame) -> DataFrame:
    """(id, table_id, chunk_type, text) of form fields: one chunk for each label, with its value or that it is blank."""
    tid = F.concat("document_id", F.lit(":p"), F.col("page_number").cast("string"), F.lit(":form"))
    rows = pairs.withColumn("table_id", tid).withColumn("n", F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("position")))
    shown = F.when(F.col("value_state") == "present", F.col("value")).otherwise(F.concat(F.lit("("), F.replace("value_state", F.lit("_"), F.lit(" ")), F.lit(")")))
    return rows.select(F.concat("table_id", F.lit(":field:"), F.col("n").cast("string")).alias("id"), "table_id", F.lit("field").alias("chunk_type"), F.concat("label", F.lit(": "), shown).alias("text"))


def dedup_tables(tables: DataFrame) -> DataFrame:
    """Tables of one page, headers and rows (in any order) once; the first by table_id stays (t2 before t10)."""
    print_ = F.sha2(F.to_json(F.struct("page_number", "headers", F.array_sort(F.transform("rows", lambda r: F.to_json(r))).alias("r"))), 256)
    return tables.withColumn("_p", print_).withColumn("_n", F.row_number().over(Window.partitionBy("document_id", "_p").orderBy(nb.natural("table_id"), "table_id"))).filter("_n = 1").drop("_p", "_n")
