"""Report metrics: region totals, period comparison, fuzzy period merge, roll-ups and record building."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.operators.similarity import components, similar_pairs
from docloom.sources.scratch import Scratch

#: Latin letters of regions to Devanagari ones, in order.
REGIONS = {"a": "क", "b": "ख", "c": "ग"}
THRESHOLD, MERGE_RATIO, TOP_MARGIN, WIDE_MARGIN = 2.0, 0.85, 0.6, 2.5
#: Sections that match a question's words and may be broadcast.
BROADCAST_SECTIONS = 100_000
NATIVE = ("docx_xml", "pdfplumber")


def region_of(text: Column) -> Column:
    """क, ख or ग of a label that names a region; null otherwise."""
    hit = F.lower(F.regexp_extract(text, r"(?i)(?:region|kshetra|क्षेत्र)\s*[‘'\"“(]?\s*([abcकखग])\b?", 1))
    back = F.lower(F.regexp_extract(text, r"(?i)[‘'\"“(]\s*([abcकखग])\s*[’'\"”)]\s*(?:region|kshetra|क्षेत्र)", 1))
    letter = F.when(hit != "", hit).when(back != "", back)
    return F.coalesce(*[F.when(letter == a, d) for a, d in REGIONS.items()], letter)


def region_totals(records: DataFrame, keys: list[str], region: str, value: str, is_percent: str, least_regions: int = 2) -> DataFrame:
    """(keys, n_regions, total): groups with 2 regions or more; a group with a percent row is listed without a total."""
    g = records.groupBy(*keys).agg(F.count_distinct(region).alias("n_regions"), F.sum(value).alias("t"), F.max(is_percent).alias("p"))
    return g.filter(F.col("n_regions") >= least_regions).select(*keys, "n_regions", F.when(~F.col("p"), F.col("t")).alias("total"), F.col("p").alias("is_percent"))


def pivot_periods(records: DataFrame, keys: list[str], period: str, value: str, periods: list, position: str | None = None, least: int = 2) -> DataFrame:
    """One row a key with a column for each period: the last record by position wins; keys with values in `least` periods stay."""
    aggs = [value_of(value, period, p, position).alias(str(p)) for p in periods]
    wide = records.groupBy(*keys).agg(*aggs)
    have = sum((F.col(f"`{p}`").isNotNull().cast("int") for p in periods), F.lit(0))
    return wide.filter(have >= least)


def value_of(value: str, period: str, p, position: str | None) -> Column:
    """A period's value: its last record's by position, else the sum."""
    own = F.when(F.col(period) == F.lit(p), F.col(value))
    return F.max_by(own, F.when(F.col(period) == F.lit(p), F.col(position))) if position else F.sum(own)


def compare(wide: DataFrame, periods: list, is_percent: Column | None = None) -> DataFrame:
    """Adds change and change_pct from the first to the last period."""
    diff, pct = nb.change(F.col(f"`{periods[0]}`"), F.col(f"`{periods[-1]}`"), is_percent)
    return wide.withColumn("change", diff).withColumn("change_pct", pct)


def fuzzy_merge(records: DataFrame, keys: list[str], metric: str = "metric_key", period: str = "period", position: str = "position", ratio: float = MERGE_RATIO) -> DataFrame:
    """Adds merged_key: a record goes to the row of its metric, else to the row most alike (by `ratio`, of ties the older one) that has no value for its period yet, else it opens a row.

    Records of a group come by position, then metric and period; those equal in all of these share their fate. A record
    meets only rows whose metrics are alike: a similarity join ties metrics, and the order matters within what ties
    connect. A metric without ties keeps its name and meets no Python. Of a tied metric and period, records beyond the
    number of its ties open or find its own row, so that a task holds few of them.
    """
    scratch = Scratch(records.sparkSession, "metrics")
    node = lambda m: F.to_json(F.struct(*keys, F.col(m).alias("m")))  # noqa: E731  null keys are left out of it
    pairs = scratch.write(similar_pairs(records.filter(F.col(metric).isNotNull()), metric, keys, ratio), "pairs")
    if pairs.isEmpty():
        return records.withColumn("merged_key", F.col(metric))
    ties = scratch.write(pairs.select(node("a").alias("a"), node("b").alias("b"), F.col("a").alias("name_a"), F.col("b").alias("name_b"), "ratio_ab", "ratio_ba"), "ties")
    ends = ties.select(F.col("a").alias("node")).unionByName(ties.select(F.col("b").alias("node")))
    degrees = scratch.write(ends.groupBy("node").agg(F.count(F.lit(1)).alias("ties")), "degrees")
    most = degrees.agg(F.max("ties")).first()[0] + 2
    parts = components(degrees.select("node"), ties, scratch)
    cases = records.select(node(metric).alias("node"), F.col(metric).alias("name"), F.col(period).cast("string").alias("period"), F.col(position).alias("at")).distinct()
    nth = F.row_number().over(Window.partitionBy("node", "period").orderBy("at"))
    cases = cases.join(parts, "node").withColumn("_n", nth).filter(F.col("_n") <= most).drop("_n")
    edges = scratch.write(ties.join(parts.withColumnRenamed("node", "a"), "a").select("component", "name_a", "name_b", "ratio_ab", "ratio_ba"), "edges")

    def merge(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        alike: dict[str, list[tuple[str, float]]] = {}  # of a new metric: (older metric, ratio)
        for a, b, ab, ba in zip(near["name_a"], near["name_b"], near["ratio_ab"], near["ratio_ba"], strict=True):
            alike.setdefault(b, []).append((a, ab))
            alike.setdefault(a, []).append((b, ba))
        held: dict[str, tuple[int, set]] = {}  # rows: place, periods
        out = []
        rows = rows.sort_values(["at", "name", "period"], kind="stable")
        for name, own in zip(rows["name"], rows["period"], strict=True):
            if name not in held:
                fits = [(r, -held[k][0], k) for k, r in alike.get(name, ()) if r >= ratio and k in held and own not in held[k][1]]
                name = max(fits)[2] if fits else name
            held.setdefault(name, (len(held), set()))[1].add(own)
            out.append(name)
        return pd.DataFrame({"node": rows["node"], "p": rows["period"], "at": rows["at"], "merged": out})

    kind = records.schema[position].dataType.simpleString()
    merged = cases.groupBy("component").cogroup(edges.groupBy("component")).applyInPandas(merge, f"node string, p string, at {kind}, merged string")
    on = (F.col("r._node") == F.col("m.node")) & F.col(f"r.{period}").cast("string").eqNullSafe(F.col("m.p")) & F.col(f"r.{position}").eqNullSafe(F.col("m.at"))
    joined = records.withColumn("_node", node(metric)).alias("r").join(merged.alias("m"), on, "left")
    return joined.select("r.*", F.coalesce("m.merged", f"r.{metric}").alias("merged_key")).drop("_node")


def latest_period(records: DataFrame, period: Column) -> DataFrame:
    """The records of the latest (y, m, d)."""
    keyed = records.withColumn("_k", period)
    top = keyed.agg(F.max("_k").alias("_top"))
    return keyed.crossJoin(F.broadcast(top)).filter("_k = _top").drop("_k", "_top")


def group_rollup(records: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums of groups with 2 rows or more; a single row's group has none."""
    g = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    return g.select(*keys, "n", F.when(F.col("n") > 1, F.col("s")).alias("total"))


def section_reference(records: DataFrame, number: int, clause: str | None = None) -> DataFrame:
    """Rows of `section N(M)`: those that cite it, else rows numbered N whose section has it, else rows numbered N."""
    numbered = F.col("section_no") == str(number)
    if clause is None:
        return records.filter(numbered)
    cite = rf"(?i)\b{number}\s*\(\s*{clause}\s*\)"
    tier = F.when(F.col("metric").rlike(cite) | F.col("region_header").rlike(cite), 0).when(numbered & F.col("section").rlike(cite), 1).when(numbered, 2)
    tiers = records.withColumn("_tier", tier).filter("_tier IS NOT NULL")
    best = tiers.agg(F.min("_tier").alias("_best"))
    return tiers.crossJoin(F.broadcast(best)).filter("_tier = _best").drop("_tier", "_best")


def section_scope(records: DataFrame, query: list[str], least: float = 1.0, margin: float = 0.25) -> DataFrame:
    """Rows of the sections that fit the query best, words of few sections weighing more; all rows where none fits."""
    from docloom.functions.tokens import tokens

    words = records.select("section_no", "section").distinct().select("section_no", "section", F.explode(F.array_distinct(tokens(F.col("section")))).alias("w")).filter(F.col("w").isin(query))
    scored = words.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("w"))).groupBy("section_no", "section").agg(F.sum(1.0 / F.col("df")).alias("_s"))
    few = F.broadcast(scored) if scored.limit(BROADCAST_SECTIONS + 1).count() <= BROADCAST_SECTIONS else scored
    out = records.join(few, ["section_no", "section"], "left").fillna(0.0, ["_s"])
    top = scored.agg(F.coalesce(F.max("_s"), F.lit(0.0)).alias("_top"))  # one row
    return out.crossJoin(F.broadcast(top)).filter((F.col("_top") < least) | (F.col("_s") >= F.col("_top") - margin)).drop("_s", "_top")


def records_from_cells(cells: DataFrame) -> DataFrame:
    """Metric records of sectioned tables (table_id, row_index, col_index, value): section, region and value of each row.

    A row whose first cell is `N.` begins a section and resets the region; a row that names a region sets
    it; the label is the longest cell, the value the last; rows of numbers alone are numbering.
    """
    text = F.trim(F.coalesce("value", F.lit("")))
    row = cells.groupBy("table_id", "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_index", text.alias("v")))), lambda c: c["v"]).alias("v"))
    filled = F.filter("v", lambda x: x != "")
    row = row.withColumn("filled", filled).filter(F.size("filled") > 0)
    number = lambda x: x.rlike(nb.NUMBER)
    row = row.withColumn("no", F.regexp_extract(F.col("v")[0], r"^([0-9]+)\.$", 1))
    row = row.withColumn("section_no", F.when(F.col("no") != "", F.col("no"))).withColumn("numbers", F.filter("filled", number)).withColumn("texts", F.filter("filled", lambda x: ~number(x) & ~x.rlike(r"^[0-9]+\.$")))
    row = row.withColumn("section", F.when(F.col("section_no").isNotNull(), F.get("texts", F.lit(0))))
    region = F.get(F.filter(F.transform("texts", region_of), lambda x: x.isNotNull()), F.lit(0))
    row = row.withColumn("own_region", region).withColumn("region_header", F.when(F.col("own_region").isNotNull(), F.get("texts", F.lit(0))))
    w = Window.partitionBy("table_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    row = row.withColumn("part", F.count("section_no").over(w))
    in_part = Window.partitionBy("table_id", "part").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    for c in ("section_no", "section"):
        row = row.withColumn(c, F.last(c, ignorenulls=True).over(in_part))
    row = row.withColumn("region", F.last("own_region", ignorenulls=True).over(in_part)).withColumn("region_header", F.last("region_header", ignorenulls=True).over(in_part))
    row = row.filter((F.size("texts") > 0) & (F.size("numbers") > 0))
    label = F.reduce("texts", F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    raw = F.try_element_at("filled", F.lit(-1))
    return _finished(row.select("table_id", "row_index", "section_no", "section", "region", "region_header", label.alias("metric"), raw.alias("raw_value")))


def native_first(tables: DataFrame) -> DataFrame:
    """A document's native tables; its form tables where it has none native."""
    native = F.col("extraction_method").isin(*NATIVE)
    return tables.withColumn("_n", F.max(native).over(Window.partitionBy("document_id"))).filter(~F.col("_n") | native).drop("_n")


def reports_only(tables: DataFrame, documents: DataFrame) -> DataFrame:
    """Tables or records of documents that are not typed magazine; an unknown type counts as magazine for contents, not here."""
    return tables.join(documents.filter(F.col("document_type") == "magazine").select("document_id"), "document_id", "left_anti")


def _regions_out_of_labels(records: DataFrame) -> DataFrame:
    """Records without a region whose label names one: the region is lifted out of the label, unless nothing else is left."""
    own = region_of(F.col("metric"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("metric", r"(?i)(?:from\s+)?(?:region|kshetra|क्षेत्र)\s*[‘'\"“(]?\s*[abcकखग]\s*[’'\"”)]?|[‘'\"“(]\s*[abcकखग]\s*[’'\"”)]\s*(?:region|kshetra|क्षेत्र)", " "), r"^[\s:–—()'‘’\"-]+|[\s:–—()'‘’\"-]+$", ""))
    lift = F.col("region").isNull() & own.isNotNull()
    rows = records.withColumn("_lift", lift).withColumn("region_header", F.when(F.col("_lift"), F.col("metric")).otherwise(F.col("region_header"))).withColumn("region", F.coalesce("region", own))
    return rows.withColumn("metric", F.when(F.col("_lift") & (bare != ""), bare).otherwise(F.col("metric"))).drop("_lift")


def _finished(records: DataFrame) -> DataFrame:
    """Adds the metric's short form and key, value and is_percent; rows without a number go."""
    value, percent = nb.parse_number(F.col("raw_value"))
    rows = _regions_out_of_labels(records)
    return rows.withColumn("metric_short", nb.short_label(F.col("metric"))).withColumn("metric_key", nb.metric_key(F.col("metric"))).withColumn("value", value).withColumn("is_percent", percent).filter("value IS NOT NULL")


def records_from_forms(cells: DataFrame) -> DataFrame:
    """Records of form tables (label and value columns): the first cell is the metric, the last the value."""
    rows = cells.groupBy("table_id", "row_index").agg(F.min_by("value", "col_index").alias("metric"), F.max_by("value", "col_index").alias("raw_value")).filter("trim(coalesce(metric, '')) <> ''")
    empty = F.lit(None).cast("string")
    return _finished(rows.select("table_id", "row_index", F.lit("").alias("section_no"), F.lit("").alias("section"), empty.alias("region"), empty.alias("region_header"), F.trim("metric").alias("metric"), F.trim("raw_value").alias("raw_value"), empty.alias("aggregation_group")))


def records_by_column(cells: DataFrame) -> DataFrame:
    """Records of tables whose measures stand in columns: a row of labels names the columns below it, within its section.

    A label row has two texts or more, one number at most and no region; a second one refines the first (parent –
    label, with the parent as aggregation group). Below it, every number of a row with a region or with two numbers
    is a record of its column.
    """
    text = F.trim(F.coalesce("value", F.lit("")))
    grid = cells.withColumn("v", F.when(text.isin(":", "："), "").otherwise(text))
    number = F.col("v").rlike(nb.NUMBER)
    rows = grid.groupBy("table_id", "row_index").agg(F.count_if((F.col("v") != "") & ~number).alias("texts"), F.count_if(number).alias("numbers"), F.min(F.when((F.col("v") != "") & ~number & (F.col("col_index") >= 2), F.col("col_index"))).alias("lead"), F.max(region_of(F.col("v"))).alias("own_region"), F.max_by("v", region_of(F.col("v"))).alias("own_header"), F.min_by("v", "col_index").alias("head"), F.min(F.when((F.col("v") != "") & ~number, F.col("v").rlike(r"^\(\s*[0-9]+\s*\)$"))).alias("numbering"), F.min_by("v", F.when((F.col("v") != "") & (F.col("col_index") > 0), F.col("col_index"))).alias("title"))
    rows = rows.withColumn("no", F.regexp_extract("head", r"^([0-9]+)\.$", 1)).withColumn("is_section", F.col("no") != "")
    so_far = Window.partitionBy("table_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.count_if("is_section").over(so_far)).withColumn("is_label", ~F.col("is_section") & F.col("own_region").isNull() & (F.col("texts") >= 2) & (F.col("numbers") <= 1) & ~F.coalesce("numbering", F.lit(False)))
    in_part = Window.partitionBy("table_id", "part").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section_no", F.last(F.when(F.col("is_section"), F.col("no")), ignorenulls=True).over(in_part)).withColumn("section", F.last(F.when(F.col("is_section"), F.col("title")), ignorenulls=True).over(in_part))
    rows = rows.withColumn("region", F.last("own_region", ignorenulls=True).over(in_part)).withColumn("region_header", F.last(F.when(F.col("own_region").isNotNull(), F.col("own_header")), ignorenulls=True).over(in_part))
    # a label row's texts by column, and those of the label row before it
    labels = grid.filter((F.col("v") != "") & ~number & (F.col("col_index") >= 1)).groupBy("table_id", "row_index").agg(F.map_from_entries(F.collect_list(F.struct("col_index", "v"))).alias("names"))
    rows = rows.join(labels, ["table_id", "row_index"], "left").withColumn("names", F.when(F.col("is_label"), F.col("names")))
    before = Window.partitionBy("table_id", "part").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("above", F.last("names", ignorenulls=True).over(before)).withColumn("parent", F.when(F.col("is_label") & F.col("lead").isNotNull(), F.element_at("above", F.col("lead"))))
    named = F.transform_values("names", lambda k, v: F.struct(F.when((k >= 2) & F.col("parent").isNotNull(), F.concat("parent", F.lit(" – "), v)).otherwise(v).alias("label"), F.when(k >= 2, F.coalesce("parent", v)).alias("group")))
    rows = rows.withColumn("columns", F.last(named, ignorenulls=True).over(in_part))
    data = rows.filter(~F.col("is_section") & ~F.col("is_label") & F.col("columns").isNotNull() & (F.col("own_region").isNotNull() | (F.col("numbers") >= 2)))
    found = data.select("table_id", "row_index", "section_no", "section", F.when(F.col("own_region").isNotNull(), F.col("region")).alias("region"), F.when(F.col("own_region").isNotNull(), F.col("region_header")).alias("region_header"), "columns")
    values = grid.filter(number).select("table_id", "row_index", "col_index", F.col("v").alias("raw_value"))
    out = found.join(values, ["table_id", "row_index"]).withColumn("c", F.element_at("columns", F.col("col_index"))).filter("c IS NOT NULL")
    return _finished(out.select("table_id", "row_index", F.coalesce("section_no", F.lit("")).alias("section_no"), F.coalesce("section", F.lit("")).alias("section"), "region", "region_header", F.col("c.label").alias("metric"), "raw_value", F.col("c.group").alias("aggregation_group")))


def report_records(cells: DataFrame, tables: DataFrame, documents: DataFrame) -> DataFrame:
    """Metric records of report documents: by the layout of each table (document_id, table_id, extraction_method).

    Documents typed magazine, form tables beside native ones, and contents lists give none. A row that the column
    layout reads isn't read again by sections.
    """
    kept = native_first(reports_only(tables.select("document_id", "table_id", "extraction_method"), documents))
    own = cells.join(kept.select("table_id", F.col("extraction_method").isin(*NATIVE).alias("native")), "table_id")
    row = own.filter("native").groupBy("table_id", "row_index").agg(F.min_by(F.trim(F.coalesce("value", F.lit(""))), "col_index").rlike(r"^[0-9]+[.)]?$").alias("numbered"), F.max_by(F.trim(F.coalesce("value", F.lit(""))), "col_index").rlike(nb.NUMBER).alias("ends"))
    native = own.filter("native").join(not_contents_list(row, "table_id", "numbered", "ends").select("table_id").distinct(), "table_id", "left_semi").drop("native")
    columns = records_by_column(native)
    sections = records_from_cells(native).withColumn("aggregation_group", F.lit(None).cast("string")).join(columns.select("table_id", "row_index").distinct(), ["table_id", "row_index"], "left_anti")
    every = columns.unionByName(sections).unionByName(records_from_forms(own.filter("NOT native").drop("native")))
    return every.join(kept.select("table_id", "document_id"), "table_id")


def not_contents_list(rows: DataFrame, key: str, is_numbered: str, ends_in_number: str) -> DataFrame:
    """Tables but those with 5 numbered rows of which 60 % end in a number."""
    g = rows.groupBy(key).agg(F.count_if(is_numbered).alias("n"), F.count_if(F.col(is_numbered) & F.col(ends_in_number)).alias("e"))
    return rows.join(g.filter("n >= 5 AND e >= 0.6 * n").select(key), key, "left_anti")


def relevance_cut(scored: DataFrame, score: str = "score", wide: bool = False) -> DataFrame:
    """Rows within 0.6 (2.5 for coordinated or two-language questions) of the best, and 2.0 at least."""
    from docloom.operators.search import relative_cut

    return relative_cut(scored, score, WIDE_MARGIN if wide else TOP_MARGIN, THRESHOLD)
