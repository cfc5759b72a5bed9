"""Text, id, number and term queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.functions import script
from docloom.functions import tokens as tk
from docloom.operators import pages, terms
from docloom.plans.registry import query, table
from docloom.plans.search_queries import TOKENS


@query(f"""SELECT item_id, array_to_string(list_distinct_kept, ' ') AS terms FROM (
  SELECT item_id, (SELECT list(x ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT unnest(a) AS x, unnest(range(len(a))) AS p) GROUP BY x ORDER BY p LIMIT 12)) AS list_distinct_kept
  FROM (SELECT item_id, list_concat(list_concat(regexp_extract_all(lower(text), '[0-9]+\\([0-9]+\\)'), regexp_extract_all(lower(text), '[0-9]+')), list_filter({TOKENS}, lambda t: length(t) >= 3)) AS a FROM benchmark))""")
def search_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tk.search_terms(F.col("text")), " ").alias("terms"))


@query(f"""WITH d AS (SELECT doc_id, list_distinct({TOKENS}) AS c FROM documents), q AS (SELECT list_distinct({TOKENS}) AS q FROM benchmark WHERE item_id = 0),
  n AS (SELECT doc_id, len(c) AS nc, len(q) AS nq, len(list_intersect(c, q)) AS b FROM d, q)
  SELECT doc_id, round(CASE WHEN nc > 0 AND nq > 0 THEN 0.8 * b / nq + 0.2 * b / (nc + nq - b) ELSE 0 END, 6) AS overlap FROM n""")
def token_overlap(spark, sf_dir):
    row = table(spark, sf_dir, "benchmark").filter("item_id = 0").select("text").first()
    words = F.array(*[F.lit(t) for t in tk.query_tokens(row[0])])
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tk.token_overlap(words, tk.tokens(F.col("text"))), 6).alias("overlap"))


@query(r"""SELECT lang, script, count(*)::BIGINT AS n FROM (SELECT lang, CASE WHEN regexp_matches(text, '[\x{0900}-\x{097F}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed_hinglish'
  WHEN regexp_matches(text, '[\x{0900}-\x{097F}]') THEN 'devanagari_hindi' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin_english_or_hinglish' ELSE 'neutral' END AS script FROM documents) GROUP BY 1, 2""")
def script_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", script.script_of(F.col("text")).alias("script")).groupBy("lang", "script").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{FEFF}\x{E000}-\x{F8FF}]', '', 'g'), '([\x{0915}-\x{0939}]) +([\x{093E}-\x{094D}])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' ') AS text FROM conversations""")
def text_repair(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", script.repair(F.col("text")).alias("text"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS period, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d FROM orders""")
def period_key(spark, sf_dir):
    text = F.concat(F.lit("report_"), F.date_format("o_orderdate", "d.M.yyyy"), F.lit(".docx"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", nb.report_period(text, F.lit(""), F.lit("")).alias("period"))
    return rows.withColumn("k", nb.period_key(F.col("period"))).select("o_orderkey", "period", "k.y", "k.m", "k.d")


def _votes(words: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


@query(f"""SELECT doc_id, CASE WHEN {_votes(pages.REPORT_WORDS)} > {_votes(pages.MAGAZINE_WORDS)} THEN 'report' ELSE 'magazine' END AS document_type FROM documents""")
def doc_type_vote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.document_type(F.col("text")).alias("document_type"))


@query()
def chunk_documents(spark, sf_dir):
    rows = pages.chunk(table(spark, sf_dir, "documents").select("doc_id", "text"), separator="\n")
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("sha"))


@query(r"""SELECT event_id, regexp_extract(props, '"(\w+)"\s*:\s*([^,}]*)', 1) AS label, trim(regexp_extract(props, '"(\w+)"\s*:\s*([^,}]*)', 2)) AS value,
  CASE WHEN trim(regexp_extract(props, '"(\w+)"\s*:\s*([^,}]*)', 2)) = '' THEN 'blank' ELSE 'present' END AS value_state FROM events""")
def kv_extract(spark, sf_dir):
    # a numbered line for each event, so that one pair is a form
    line = F.concat(F.lit("1. "), F.regexp_replace(F.regexp_extract("props", r'"\w+"\s*:\s*[^,}]*', 0), '"', ""))
    return terms.form_pairs(table(spark, sf_dir, "events").select("event_id", line.alias("text")), ("event_id",)).select("event_id", "label", "value", "value_state")


_STRIP = r"""trim(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(rf"""SELECT page_id, len(regexp_extract_all({_STRIP}, '\S+'))::BIGINT AS total_words, length({_STRIP})::BIGINT AS total_chars FROM pages""")
def page_word_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", pages.strip_tags(F.col("html")).alias("text"))
    return pages.totals(rows, "page_id").select("page_id", F.col("total_words").cast("long").alias("total_words"), F.col("total_chars").cast("long").alias("total_chars"))


_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"


@query(f"""SELECT doc_id, round(CASE WHEN trim(text) = '' THEN 0.2 ELSE 0.35 * ({_votes(pages.KEYWORDS)}) + CASE WHEN n >= 3 THEN 0.5 WHEN n >= 1 THEN 0.25 ELSE 0 END + CASE WHEN share > 0.7 THEN 0.2 ELSE 0 END + CASE WHEN page <= 2 THEN 0.15 ELSE 0 END END, 4) AS score FROM (
  SELECT doc_id, text, doc_id % 10 + 1 AS page, len(regexp_extract_all(text, '\\.{{3,}}|…')) AS n, CASE WHEN len({_LINES}) > 0 THEN len(list_filter({_LINES}, lambda x: length(trim(x)) < 60))::DOUBLE / len({_LINES}) ELSE 0 END AS share FROM documents)""")
def frontmatter_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.frontmatter_score(F.col("text"), F.col("doc_id") % 10 + 1).alias("score"))


ALIASES = [("the", "article"), ("of the", "phrase"), ("und", "conjunction"), ("de la", "phrase"), ("que", "conjunction"), ("all rights reserved", "licence"), ("licensed under the apache", "licence")]
_ALIAS_SQL = "(VALUES " + ", ".join(f"('{a}', '{k}')" for a, k in ALIASES) + ") AS a(alias, key)"


@query(f"""WITH t AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT doc_id, {TOKENS} AS t FROM documents)),
  r AS (SELECT doc_id, w, lead(w, 1) OVER o AS x, lead(w, 2) OVER o AS y, lead(w, 3) OVER o AS z FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT doc_id, unnest([w, w || ' ' || x, w || ' ' || x || ' ' || y, w || ' ' || x || ' ' || y || ' ' || z]) AS alias FROM r)
  SELECT doc_id, alias, key, count(*)::BIGINT AS n FROM g JOIN {_ALIAS_SQL} USING (alias) GROUP BY 1, 2, 3""")
def term_alias_join(spark, sf_dir):
    aliases = spark.createDataFrame(ALIASES, "alias string, key string")
    return terms.alias_join(table(spark, sf_dir, "documents"), aliases, "doc_id")


@query()
def term_longest_matches(spark, sf_dir):
    aliases = spark.createDataFrame(ALIASES, "alias string, key string")
    return terms.longest_matches(table(spark, sf_dir, "documents"), aliases, "doc_id")


@query(f"""WITH q AS (SELECT DISTINCT term FROM (SELECT unnest(list_filter({TOKENS}, lambda t: length(t) >= 6)) AS term FROM benchmark)),
  d AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents)
  SELECT term, min(doc_id) AS doc_id FROM q JOIN d USING (term) GROUP BY 1""")
def first_containing(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.filter(tk.tokens(F.col("text")), lambda t: F.length(t) >= 6)).alias("term")).distinct()
    return terms.first_containing(words, table(spark, sf_dir, "documents"), id_column="doc_id").select("term", "doc_id")


@query()
def ids(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    raw = F.concat(F.lit("item_"), F.col("item_id").cast("string"))
    return rows.select("item_id", nb.token_hash(F.col("text")).alias("token_hash"), nb.point_id(raw).alias("point_id"), nb.record_id(raw, F.lit(None), F.lit("a")).alias("record_id"))


@query("""SELECT o_orderkey, col, CASE WHEN regexp_matches(value, '^\\s*-?[0-9][0-9,]*(\\.[0-9]+)?\\s*%\\s*$') THEN 'PERCENTAGE' WHEN regexp_matches(value, '^\\s*[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\\s*$') THEN 'DATE'
  WHEN regexp_matches(value, '^\\s*-?[0-9][0-9,]*(\\.[0-9]+)?\\s*$') THEN 'NUMERIC' ELSE 'TEXT' END AS value_type FROM (
  SELECT o_orderkey, unnest(['key', 'date', 'share', 'priority']) AS col, unnest([o_orderkey::VARCHAR, strftime(o_orderdate, '%d.%m.%Y'), (o_orderkey % 100)::VARCHAR || '%', o_orderpriority]) AS value FROM orders)""")
def value_types(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(n).alias("col"), c.alias("value")) for n, c in (("key", F.col("o_orderkey").cast("string")), ("date", F.date_format("o_orderdate", "dd.MM.yyyy")), ("share", F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("%"))), ("priority", F.col("o_orderpriority")))])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(cells).alias("c")).select("o_orderkey", "c.col", nb.value_type(F.col("c.value")).alias("value_type"))


@query("""SELECT l_orderkey, l_linenumber, replace(p, ' %', '')::DOUBLE AS value, true AS is_percent, q::DOUBLE AS amount, 'units' AS unit FROM (
  SELECT l_orderkey, l_linenumber, round(l_discount * 100)::INT::VARCHAR || ' %' AS p, l_quantity::INT AS q FROM lineitem)""")
def number_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(" %")).alias("p"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" units")).alias("q"))
    value, percent = nb.parse_number(F.col("p"))
    amount, unit = nb.parse_amount(F.col("q"))
    return rows.select("l_orderkey", "l_linenumber", value.alias("value"), percent.alias("is_percent"), amount.cast("double").alias("amount"), unit.alias("unit"))
