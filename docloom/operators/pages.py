"""Page text: chunks, front matter, document type and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of chunking and of the front-matter score.
CHUNK_CHARS, OVERLAP_WORDS, OVERLAP_FROM = 750, 20, 30
INDEX_SCORE, DENSE_WORDS, SCAN_MOST, SCAN_LEAST, SCAN_SHARE = 0.45, 180, 15, 3, 0.35
KEYWORDS = ["contents", "index", "preface", "foreword", "editorial board", "table of contents", "अनुक्रमणिका", "विषय सूची", "अनुक्रम", "संपादक मंडल", "प्रस्तावना"]
REPORT_WORDS = ["quarterly", "progress report", "annual report", "report", "तिमाही", "प्रगति रिपोर्ट"]
MAGAZINE_WORDS = ["magazine", "editorial", "poem", "story", "पत्रिका", "संपादकीय", "कविता", "कहानी"]


def chunk(pages: DataFrame, text: str = "text", separator: str = r"\n\s*\n", most: int = CHUNK_CHARS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Adds chunk_no (from 0, within the page) and chunk: paragraphs are gathered until the next would pass `most` characters.

    A flushed chunk of over 30 words hands its last words to the next. A page is folded in one expression, so
    that pages are independent and nothing is shuffled.
    """
    paragraphs = F.filter(F.transform(F.split(F.col(text), separator), lambda p: F.trim(p)), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a, p):
        words = F.split(a["open"], r"\s+")
        tail = F.when(F.size(words) > OVERLAP_FROM, F.array_join(F.slice(words, -overlap, overlap), " ")).otherwise("") if overlap else F.lit("")
        full = (a["open"] != "") & (F.length(a["open"]) + F.length(p) > most)
        opened = F.when(tail != "", F.concat(tail, F.lit("\n"), p)).otherwise(p)
        return F.when(full, F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), opened.alias("open"))).otherwise(F.struct(a["done"].alias("done"), F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit("\n"), p)).alias("open")))

    folded = F.aggregate(paragraphs, empty, step, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    return pages.select("*", F.posexplode(folded).alias("chunk_no", "chunk"))


def chunk_ids(chunks: DataFrame, kind: str) -> DataFrame:
    """Adds id {doc}_idx_{n} or {doc}_cnt_{n}, n running over the document."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "chunk_no")) - 1
    return chunks.withColumn("id", F.concat("document_id", F.lit("_idx_" if kind == "index" else "_cnt_"), n.cast("string")))


def leaders(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\.{3,}|…"))


def frontmatter_score(text: Column, page_number: Column) -> Column:
    """0.2 for a blank page; 0.35 for each keyword, dot leaders, short lines and an early page."""
    low, lines = F.lower(text), F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) < 60)).cast("double")
    share = F.when(F.size(lines) > 0, short / F.size(lines)).otherwise(0.0)
    keys = sum((F.contains(low, F.lit(k)).cast("int") for k in KEYWORDS), F.lit(0))
    score = 0.35 * keys + F.when(leaders(text) >= 3, 0.5).when(leaders(text) >= 1, 0.25).otherwise(0.0) + F.when(share > 0.7, 0.2).otherwise(0.0) + F.when(page_number <= 2, 0.15).otherwise(0.0)
    return F.round(F.when(F.trim(text) == "", F.lit(0.2)).otherwise(score), 4)


def segment(pages: DataFrame) -> DataFrame:
    """Adds segment_type, index or content, to the pages of documents.

    Pages up to the scan limit are index by their score until two content signals follow each other, or one
    comes after page 3; from there on, all is content. Without an index page the first one is, unless it is alone.
    """
    words = F.regexp_count("text", F.lit(r"\S+"))
    all_ = Window.partitionBy("document_id")
    order = all_.orderBy("page_number")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    df = pages.withColumn("_score", frontmatter_score(F.col("text"), F.col("page_number"))).withColumn("_total", F.count(F.lit(1)).over(all_)).withColumn("_nth", F.row_number().over(order))
    limit = F.least(F.lit(SCAN_MOST), F.greatest(F.lit(SCAN_LEAST), F.floor(F.col("_total") * SCAN_SHARE)))
    dense = (words > DENSE_WORDS) & (leaders(F.col("text")) == 0)
    df = df.withColumn("_index", (F.col("_nth") <= limit) & (F.col("_score") >= INDEX_SCORE) & ~dense).withColumn("_signal", ~F.col("_index"))
    df = df.withColumn("_island", F.sum(F.col("_index").cast("int")).over(so_far))
    in_island = Window.partitionBy("document_id", "_island").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_signals", F.sum(F.col("_signal").cast("int")).over(in_island))
    df = df.withColumn("_latched", F.max((F.col("_signals") >= 2) | (F.col("_signal") & (F.col("page_number") > 3))).over(so_far))
    df = df.withColumn("_index", F.col("_index") & ~F.col("_latched")).withColumn("_any", F.max("_index").over(all_))
    is_index = F.col("_index") | (~F.col("_any") & (F.col("_nth") == 1) & (F.col("_total") > 1))
    return df.withColumn("segment_type", F.when(is_index, "index").otherwise("content")).select(*pages.columns, "segment_type")


def document_type(text: Column) -> Column:
    """report if it has strictly more report words than magazine words, else magazine."""
    low = F.lower(text)
    votes = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.when(votes(REPORT_WORDS) > votes(MAGAZINE_WORDS), "report").otherwise("magazine")


def totals(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, total_words, total_chars)."""
    return pages.groupBy(key).agg(F.sum(F.regexp_count(text, F.lit(r"\S+"))).alias("total_words"), F.sum(F.length(text)).alias("total_chars"))


def heading(text: Column) -> Column:
    """The first of 12 lines with 3 to 140 characters that is no number."""
    lines = F.slice(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), 1, 12)
    return F.get(F.filter(lines, lambda x: F.length(x).between(3, 140) & ~x.rlike("^[0-9]+$")), F.lit(0))


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become blanks."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))
