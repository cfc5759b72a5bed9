"""Contents listings: counts, rankings, ordinals, distinct lists and title or author resolution."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import script
from docloom.functions.numbers import natural
from docloom.functions.tokens import clean, query_tokens, tokens
from docloom.operators.similarity import first_seen, similar_pairs
from docloom.sources.scratch import Scratch

#: Names of one person are alike by so much.
NAME_RATIO = 0.84

#: Names of sections, by concept.
SECTION_WORDS = {
    "non technical": ("non technical", "non-technical", "गैर तकनीकी", "गैर-तकनीकी", "gair takniki"), "technical": ("technical", "तकनीकी", "takniki"), "poem": ("poem", "poems", "poetry", "कविता", "kavita"),
    "story": ("story", "stories", "कहानी", "kahani"), "tribute": ("tribute", "श्रद्धांजलि", "shraddhanjali"), "report": ("report", "रिपोर्ट", "प्रतिवेदन"),
    "editorial": ("editorial", "संपादकीय", "sampadkiya"), "special": ("special", "विशेष", "vishesh"), "official": ("official language", "राजभाषा", "rajbhasha"),
}


def breakdown(entries: DataFrame, section: str, edition: str, editions: list) -> DataFrame:
    """Counts by section and edition with a grand-total row (section null: total = true); a missing count is 0, a null section General."""
    df = entries.withColumn("_s", F.coalesce(F.col(section), F.lit("General")))
    counts = [F.count_if(F.col(edition) == F.lit(e)).alias(str(e)) for e in editions]
    out = df.rollup("_s").agg(F.grouping("_s").alias("is_total"), *counts)
    return out.select(F.col("_s").alias("section"), (F.col("is_total") == 1).alias("is_total"), *[F.col(f"`{e}`") for e in editions])


def author_ranking(works: DataFrame, author: str = "author", k: int = 15, count: str | None = None) -> DataFrame:
    """(author, works): by descending works, then name; rows that stand for several works say so in `count`."""
    n = F.sum(count) if count else F.count(F.lit(1))
    return works.groupBy(author).agg(n.alias("works")).orderBy(F.desc("works"), author).limit(k)


def common_members(rows: DataFrame, member: str, group: str, first, second) -> DataFrame:
    """(member): those that occur in both groups, such as authors (by cluster) of two editions."""
    own = rows.filter(F.col(group).isin(first, second))
    return own.groupBy(member).agg(F.count_distinct(group).alias("n")).filter("n = 2").select(member)


def by_page(entries: DataFrame, pages: list[int], page: str = "page_number") -> DataFrame:
    """(page, the columns of entries, found): entries of each page asked for; a page without one has a row that isn't found."""
    wanted = entries.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, pages))).alias("page"))
    rows = entries.filter(F.col(page).isin(pages)).withColumn("found", F.lit(True))
    return wanted.join(rows, F.col("page") == rows[page], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def in_section(entries: DataFrame, section: str, columns: tuple[str, ...] = ("type", "section_normalized")) -> DataFrame:
    """Entries whose type is the section, or whose section's name has it; the first column is compared whole."""
    hit = F.lower(F.col(columns[0])) == section.lower()
    for c in columns[1:]:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(section.lower()))
    return entries.filter(hit)


def author_clusters(entries: DataFrame, author: str = "author", position: str = "position") -> DataFrame:
    """(author, cluster): names of one person have the first-seen name.

    Names are reduced to distinct keys, so that names of one key cost nothing more. Keys are blocked by their words'
    first consonants; within a block, keys of as many words alike by NAME_RATIO meet in a similarity join, and a key, in the
    order of first sight, joins the first leader before it that is alike, or leads. No block is gathered in a task.
    """
    scratch = Scratch(entries.sparkSession, "authors")
    names = entries.groupBy(author).agg(F.min(position).alias("at")).withColumn("key", script.person_key(F.col(author)))
    names = scratch.write(names, "names")
    keys = names.groupBy("key").agg(F.min(F.struct("at", author)).alias("at")).filter("key IS NOT NULL")
    words = F.split("key", " ")
    keys = scratch.write(keys.withColumn("words", F.size(words)).withColumn("block", F.array_join(F.transform(words, lambda w: F.substring(script.skeleton(w), 1, 1)), "")), "keys")
    pairs = scratch.write(similar_pairs(keys, "key", ["block", "words"], NAME_RATIO), "pairs")
    place = lambda c: keys.select(F.col("key").alias(c), F.col("at").alias(f"at_{c}"))
    both = pairs.join(place("a"), "a").join(place("b"), "b")
    first = F.col("at_a") < F.col("at_b")
    edges = both.filter(F.when(first, F.col("ratio_ab")).otherwise(F.col("ratio_ba")) >= NAME_RATIO).select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"))
    leaders = first_seen(keys.select("key", "at"), edges, scratch)
    heads = keys.select(F.col("key").alias("leader"), F.col(f"at.{author}").alias("cluster"))
    return names.join(leaders.join(heads, "leader"), "key").select(author, "cluster")


def ordered_distinct(df: DataFrame, value: str, position: str, skip: tuple[str, ...] = ("General",)) -> DataFrame:
    """(value, first_position) in first-seen order."""
    return df.filter(~F.col(value).isin(*skip)).groupBy(value).agg(F.min(position).alias("first_position")).orderBy("first_position", value)


def nth(df: DataFrame, key: list[str], order: list[str], n: int | str) -> DataFrame:
    """The first, last or n-th row of each key; the first where there is no n-th."""
    w = Window.partitionBy(*key).orderBy(*order)
    total = F.count(F.lit(1)).over(Window.partitionBy(*key))
    numbered = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", total)
    want = F.lit(1) if n == "first" else F.col("_n") if n == "last" else F.when(F.col("_n") >= int(n), int(n)).otherwise(1)
    return numbered.filter(F.col("_i") == want).drop("_i", "_n")


def section_index(df: DataFrame, key: list[str], order: list[str], name: str = "section_item_index") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def with_margin(scored: DataFrame, query: str, score: str, id_column: str, threshold: float, margin: float, waive: float = 2.0) -> DataFrame:
    """The best row of each query if it reaches the threshold and leads the second by the margin (waived from `waive`)."""
    w = Window.partitionBy(query).orderBy(F.desc(score), id_column)
    ranked = scored.withColumn("_n", F.row_number().over(w)).withColumn("second", F.lead(score).over(w)).filter("_n = 1").drop("_n")
    lead = F.col(score) - F.coalesce("second", F.lit(0.0))
    return ranked.filter((F.col(score) >= threshold) & ((lead >= margin) | (F.col(score) >= waive)))


def topic_hits(df: DataFrame, text: str, topics: list[str], id_column: str) -> DataFrame:
    """Rows by the number of topic tokens that occur: tokens of 3 characters or fewer as whole words, counting 2."""
    toks = tokens(F.col(text))
    parts = [F.when(F.array_contains(toks, t), 2).otherwise(0) if len(t) <= 3 else F.contains(F.lower(F.col(text)), F.lit(t)).cast("int") for t in topics]
    return df.withColumn("hits", sum(parts, F.lit(0))).filter("hits > 0").orderBy(F.desc("hits"), id_column)


def topic_groups(groups: list[list[str]], text: Column) -> Column:
    """Every group has a word that occurs (an AND of ORs)."""
    low = F.lower(text)
    out = F.lit(True)
    for g in groups:
        out = out & F.exists(F.array(*[F.lit(x.lower()) for x in g]), lambda t: F.contains(low, t))
    return out


def title_candidates(entries: DataFrame, query: str, ratio: float | None = None) -> DataFrame:
    """Entries whose stored title forms may fit a query at all, by built-in functions, so that scores in Python are taken of few.

    With a ratio: forms that are equal or hold each other, share a word, or have letters enough in common for a sequence
    ratio of it. Without: forms that are equal or hold each other, or share a consonant skeleton. A superset of what
    scores by title_score_text(), and by article_score_text().
    """
    roman, plain = F.coalesce("title_roman", F.lit("")), F.lower(clean(F.coalesce("title_original", F.lit(""))))
    own = script.romanize_text(query)
    words = F.split(roman, " ")
    fits = F.lit(False)
    for form, text in ((roman, own), (plain, " ".join(query_tokens(query)))):
        if text:
            fits = fits | (form == text) | F.contains(form, F.lit(text)) | ((form != "") & F.contains(F.lit(text), form))
    if ratio is None:
        bones = sorted({script.skeleton_text(w) for w in own.split()} - {""})
        fits = fits | (F.arrays_overlap(F.transform(words, script.skeleton), F.array(*map(F.lit, bones))) if bones else F.lit(False))
    elif own:
        shared = F.length(roman) - F.length(F.translate(roman, "".join(sorted(set(own))), ""))
        fits = fits | F.arrays_overlap(words, F.array(*map(F.lit, own.split()))) | (2 * F.least(shared, F.lit(len(own))) >= (ratio - 1e-9) * (F.length(roman) + len(own)))
    return entries.filter(fits)


def resolve_title(entries: DataFrame, query: str, title: str = "title_original", threshold: float = 0.80, margin: float = 0.10) -> DataFrame:
    """The entry whose title fits the query, with its score; none where it is ambiguous."""
    tokens_in = len(query.split())
    least = 0.92 if tokens_in <= 1 else 0.78 if tokens_in <= 3 else threshold
    near = title_candidates(entries, query, (least - margin) / 0.92) if title == "title_original" and "title_roman" in entries.columns else entries  # the second best counts within the margin
    scored = near.withColumn("query", F.lit(query)).withColumn("score", script.title_score(F.lit(query), F.col(title)))
    return with_margin(scored, "query", "score", "article_id", least, margin, waive=0.98)


def resolve_article(entries: DataFrame, target: str, gap: float = 0.05) -> DataFrame:
    """The entry that fits a target by equality, containment or consonant skeletons, with score; none where the second is within the gap."""
    near = title_candidates(entries, target) if "title_roman" in entries.columns else entries
    scored = near.withColumn("query", F.lit(target)).withColumn("score", script.article_score(F.lit(target), F.col("title_original"))).filter("score > 0")
    return with_margin(scored, "query", "score", "article_id", 0.40, gap, waive=2.0)


def resolve_semantic(entries: DataFrame, query: str, vector: list[float], embed: Callable[[Column], Column]) -> DataFrame:
    """The entry nearest to a title by embedding, with score; the threshold and the margin fall with shared words (0.60 and 0.08 for concepts in both scripts, 0.64 and 0.10 for words, 0.66 and 0.12 for none). Titles have their vectors stored (dense); where they have none, they are embedded."""
    from docloom.functions.tokens import tokens
    from docloom.functions.vectors import cosine_to

    words = F.array(*[F.lit(w) for w in script.romanize_text(query).split()]) if script.romanize_text(query) else F.array().cast("array<string>")
    scored = entries.withColumn("query", F.lit(query)).withColumn("score", cosine_to(F.col("dense") if "dense" in entries.columns else embed(F.col("title_original")), vector))
    covered = F.size(F.array_intersect(F.array_distinct(F.split(F.coalesce("title_roman", F.lit("")), " ")), words)) / F.greatest(F.size(words), F.lit(1))
    own = F.size(F.array_intersect(tokens(F.col("title_original")), F.array(*[F.lit(w) for w in re.findall(r"[\wऀ-ॿ]+", query.lower())] or [F.lit("")]))) > 0
    best = with_margin(scored.withColumn("covered", covered).withColumn("same_script", own), "query", "score", "article_id", 0.60, 0.0)
    lead = F.col("score") - F.coalesce("second", F.lit(0.0))
    concept, lexical = (F.col("covered") >= 0.15) & ~F.col("same_script"), F.col("covered") >= 0.15
    ok = F.when(concept, lead >= 0.08).when(lexical, (F.col("score") >= 0.64) & (lead >= 0.10)).otherwise((F.col("score") >= 0.66) & (lead >= 0.12))
    return best.filter(ok).drop("covered", "same_script")


def resolve_cascade(entries: DataFrame, query: str, vector: list[float], embed: Callable[[Column], Column], translate: Callable[[str], list[str]] | None = None) -> list[dict]:
    """The entry of a title: by its words, by article forms, by embedding, then by the words of its translations; the first that has one (a list of one row or none)."""
    for plan in (lambda: resolve_title(entries, query), lambda: resolve_article(entries, query), lambda: resolve_semantic(entries, query, vector, embed), *((lambda t=t: resolve_title(entries, t)) for t in (translate(query) if translate else ()))):
        found = [r.asDict() for r in plan().drop("dense").limit(1).collect()]
        if found:
            return found
    return []


def titles_like(entries: DataFrame, query: str, least: float = 0.35, margin: float = 0.15) -> DataFrame:
    """Entries whose title, or a part of it, fits the query: a score of 0.35, within 0.15 of the best; the best first."""
    from docloom.operators.search import relative_cut

    scored = entries.withColumn("score", script.segments_score(F.lit(query), F.col("title_original")))
    return relative_cut(scored, "score", margin, least).orderBy(F.desc("score"), "article_id")


def works_of(entries: DataFrame, name: str) -> DataFrame:
    """Entries with an author whom the query names (every word of the query alike), titles once for each document, in order."""
    authors = entries.withColumn("author", F.explode("author_list"))
    distinct = authors.select("author").distinct()
    hit = distinct.filter(strict_author(F.lit(name), F.col("author")))
    found = authors.join(hit, "author", "left_semi")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("document_id", "title_normalized").orderBy("serial_number"))).filter("_n = 1").drop("_n")


def works_by_author(entries: DataFrame, name: str) -> DataFrame:
    """(author, document_id, works, titles): works_of() by author and document, titles in order."""
    return works_of(entries, name).groupBy("author", "document_id").agg(F.count(F.lit(1)).alias("works"), F.transform(F.array_sort(F.collect_list(F.struct("serial_number", "title_original"))), lambda t: t["title_original"]).alias("titles"))


def authors_in(rows: DataFrame, author: str = "author_original", position: str = "serial_number") -> DataFrame:
    """Distinct authors of entries or hits, in first-seen order."""
    return ordered_distinct(rows.filter(F.col(author).isNotNull()), author, position, ("", "General"))


def strict_author_text(query: str, name: str) -> bool:
    """Each query word has a name word that is equal, or has its first letter and a ratio of 0.84."""
    q, n = script.person_key_text(query).split(), script.person_key_text(name).split()
    return bool(q) and all(any(a == b or (a[0] == b[0] and script.seq_ratio_text(a, b) >= 0.84) for b in n) for a in q)


strict_author = script._mapped("boolean", strict_author_text)


def entry_type(section: Column) -> Column:
    """poem, story, tribute, report or article."""
    s = F.lower(F.coalesce(section, F.lit("")))
    return F.when(s.rlike("poem|poetry|कविता|काव्य"), "poem").when(s.rlike("story|stories|कहानी|कथा") & ~s.rlike("लेख"), "story").when(s.rlike("tribute|श्रद्धांजलि|स्मृति"), "tribute").when(s.rlike("report|रिपोर्ट|प्रतिवेदन"), "report").otherwise("article")


def split_authors(text: Column) -> Column:
    """Names between separators and conjunctions, without honorifics, each once."""
    bare = F.regexp_replace(text, r"(?i)\b(?:shri|smt|mr|mrs|ms|dr|prof)\.?\s+|(?:श्री|श्रीमती|सुश्री|डॉ)\.?\s+", "")
    parts = F.split(bare, r"(?i)\s*(?:[,;/&]|\band\b|\bevam\b|\s(?:एवं|और|तथा)\s)\s*")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def toc_from_cells(cells: DataFrame) -> DataFrame:
    """Entries of a contents table (document_id, table_id, row_index, col_index, value): serial, title, authors, page under sections.

    A row whose filled cells are all equal, short and free of digits is a section. The first table of a document that has
    5 entries or more is its contents.
    """
    text = F.trim(F.coalesce("value", F.lit("")))
    row = cells.groupBy("document_id", "table_id", "row_index").agg(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("col_index", text.alias("v")))), lambda c: c["v"]), lambda x: (x != "") & (x != ":")).alias("v")).filter(F.size("v") > 0)
    first = F.col("v")[0]
    is_section = (F.size(F.array_distinct("v")) == 1) & (F.length(first) <= 60) & ~first.rlike("[0-9०-९]")
    row = row.withColumn("section_original", F.when(is_section, first))
    w = Window.partitionBy("document_id", "table_id").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    row = row.withColumn("section_original", F.coalesce(F.last("section_original", ignorenulls=True).over(w), F.lit("General")))
    entry = row.filter(~is_section & (F.size("v") >= 3)).withColumn("serial_number", F.regexp_extract(F.col("v")[0], r"^([0-9]+)\.?$", 1).try_cast("int")).withColumn("page_number", F.regexp_extract(F.try_element_at("v", F.lit(-1)), r"^([0-9]+)$", 1).try_cast("int")).filter("serial_number IS NOT NULL")
    entry = entry.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("document_id", "table_id"))).filter("n >= 5")
    entry = entry.withColumn("first", F.min_by("table_id", natural("table_id")).over(Window.partitionBy("document_id"))).filter("table_id = first")
    authors = F.when(F.size("v") >= 4, F.col("v")[2])
    out = entry.select("document_id", "table_id", "serial_number", "section_original", F.col("v")[1].alias("title_original"), authors.alias("author_original"), "page_number")
    return enrich(section_index(out, ["document_id", "table_id", "section_original"], ["serial_number"]))


def enrich(entries: DataFrame) -> DataFrame:
    """Adds the normal forms, author list, type and article id of contents entries."""
    return (
        entries.withColumn("section_normalized", F.lower(clean(F.col("section_original"))))
        .withColumn("title_normalized", F.lower(clean(F.col("title_original"))))
        .withColumn("title_roman", script.romanize(F.col("title_original")))
        .withColumn("author_list", split_authors(F.coalesce("author_original", F.lit(""))))
        .withColumn("type", entry_type(F.col("section_original")))
        .withColumn("article_id", F.concat("document_id", F.lit(":article:"), F.coalesce(F.col("serial_number").cast("string"), F.length("title_original").cast("string"))))
    )


_ENTRY = r"^([0-9]{1,3})[.)]?\s+(.+?)\s*(?:[:：]\s*(.*?))?\s*[.… ]*\s([0-9]{1,3})$"
_OPEN = r"^([0-9]{1,3})[.)]\s+([^0-9].*?)\s*(?:[:：]\s*(.*?))?\s*[.… ]*$"
_BARE = r"^(?![0-9]+[.)])([^:：]*?[^0-9\s:：.…])\s*(?:[:：]\s*(.*?))?\s*(?:\.{2,}|…+)[.… ]*([0-9]{1,3})$"


def toc_from_lines(lines: DataFrame) -> DataFrame:
    """Entries of contents lines (document_id, page_number, line_no, line): `serial title : author page`; other short lines are sections.

    An entry without a serial has leaders before its page, and is numbered in order; one without a page takes it from a
    line below that is a number alone.
    """
    parts = lines.withColumn("t", F.trim("line")).filter("t <> ''")
    got = lambda p, i: F.regexp_extract("t", p, i)
    whole, open_, bare = F.col("t").rlike(_ENTRY), F.col("t").rlike(_OPEN), F.col("t").rlike(_BARE)
    parts = parts.withColumn("kind", F.when(whole, "entry").when(F.col("t").rlike("^[0-9]{1,3}$"), "number").when(bare, "bare").when(open_, "open"))
    entry = F.col("kind").isin("entry", "bare", "open")
    order = Window.partitionBy("document_id").orderBy("page_number", "line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col("kind").isNull() & (F.length("t") <= 60) & ~F.col("t").rlike("[0-9०-९]"), F.col("t"))
    parts = parts.withColumn("section_original", F.coalesce(F.last(heading, ignorenulls=True).over(so_far), F.lit("General"))).withColumn("below", F.when(F.lead("kind").over(order) == "number", F.lead("t").over(order)))
    parts = parts.withColumn("running", F.count_if(F.col("kind") == "bare").over(so_far)).filter(entry)
    pick = lambda e, b, o: F.when(F.col("kind") == "entry", e).when(F.col("kind") == "bare", b).otherwise(o)
    author = pick(got(_ENTRY, 3), got(_BARE, 2), got(_OPEN, 3))
    out = parts.select("document_id", F.col("page_number").alias("toc_page"), pick(got(_ENTRY, 1).try_cast("int"), F.col("running").cast("int"), got(_OPEN, 1).try_cast("int")).alias("serial_number"), "section_original", pick(got(_ENTRY, 2), got(_BARE, 1), got(_OPEN, 2)).alias("title_original"), F.when(author != "", author).alias("author_original"), pick(got(_ENTRY, 4).try_cast("int"), got(_BARE, 3).try_cast("int"), F.col("below").try_cast("int")).alias("page_number"))
    return enrich(section_index(out, ["document_id", "section_original"], ["toc_page", "serial_number"]))


#: Lines that begin a contents listing, and that end it.
TOC_START, TOC_STOP = ("contents", "table of contents", "इस अंक में", "अनुक्रमणिका", "विषय सूची", "विषय-सूची"), ("foreword", "message", "editorial", "***", "---", "संदेश", "संपादकीय")


def is_tokenised(lines: DataFrame) -> DataFrame:
    """(document_id) of contents listings whose serials, titles, colons, authors and pages stand on lines of their own."""
    t = F.trim("line")
    counts = lines.groupBy("document_id").agg(F.count_if(t.rlike("^[0-9]{1,3}$")).alias("numbers"), F.count_if(t.isin(":", "：")).alias("colons"), F.count_if(t.rlike(r"^[0-9]+[.\s:-]") & (F.size(F.split(t, r"\s+")) > 3)).alias("whole"))
    return counts.filter("(numbers >= 4 AND colons >= 2) OR (numbers >= 6 AND whole < 3)").select("document_id")


def toc_from_tokens(lines: DataFrame) -> DataFrame:
    """Entries of tokenised contents listings (document_id, page_number, line_no, line).

    A number opens an entry, or closes one that has a title, as its page; after a colon come authors. The lines of a
    listing decide in order, so one document's contents lines are one call; they are a few pages.
    """
    sections = [w for words in SECTION_WORDS.values() for w in words]

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, section, serial, title, author, author_next = [], "General", None, [], [], False
        texts = [(t.strip(), p) for t, p in zip(pdf.sort_values(["page_number", "line_no"])["line"], pdf.sort_values(["page_number", "line_no"])["page_number"], strict=True)]
        begins = next((i + 1 for i, (t, _) in enumerate(texts) if t.lower() in TOC_START), 0)

        def close(page: int | None, toc_page: int) -> None:
            if title:
                rows.append((pdf["document_id"].iloc[0], toc_page, serial, section, " ".join(title), " ".join(author) or None, page))

        for t, toc_page in texts[begins:]:
            if not t or t.lower() in TOC_START:
                continue
            if t.lower() in TOC_STOP or (len(rows) >= 3 and len(t.split()) > 25):
                break
            if re.fullmatch("[0-9]{1,3}", t):
                if serial is not None and title:
                    close(int(t), toc_page)
                    serial, title, author, author_next = None, [], [], False
                else:
                    serial, title, author, author_next = int(t), [], [], False
            elif t in (":", "：", "-"):
                author_next = True
            elif serial is None or t.lower() in sections:
                close(None, toc_page)
                serial, title, author, author_next, section = None, [], [], False, t
            else:
                (author if author_next else title).append(t)
        if texts:
            close(None, texts[-1][1])
        return pd.DataFrame(rows, columns=["document_id", "toc_page", "serial_number", "section_original", "title_original", "author_original", "page_number"]).astype({"toc_page": "Int32", "serial_number": "Int32", "page_number": "Int32"})

    found = lines.groupBy("document_id").applyInPandas(parse, "document_id string, toc_page int, serial_number int, section_original string, title_original string, author_original string, page_number int")
    return enrich(section_index(found, ["document_id", "section_original"], ["toc_page", "serial_number"]))


def toc_from_pages(lines: DataFrame) -> DataFrame:
    """Entries of contents lines, each document by its own form."""
    tokenised = is_tokenised(lines)
    return toc_from_lines(lines.join(tokenised, "document_id", "left_anti")).unionByName(toc_from_tokens(lines.join(tokenised, "document_id", "left_semi")))
