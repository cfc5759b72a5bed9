"""Numbers, value types, ids and periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(%?)\s*\**\s*$"
WITH_UNIT = r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)\s*(\S.*)?$"
DATE = r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"
DEVANAGARI_DIGITS = "०१२३४५६७८९"


def natural(text: Column | str) -> Column:
    """A key that orders texts with their numbers as numbers: t2 before t10."""
    runs = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 12, "0")).otherwise(r)), "")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DEVANAGARI_DIGITS, "0123456789")


def parse_number(text: Column) -> tuple[Column, Column]:
    """(value, is_percent) of a cell that is a number and nothing else; (null, false) otherwise."""
    digits = F.replace(F.regexp_extract(text, NUMBER, 1), F.lit(","), F.lit(""))
    value = F.when(digits != "", digits.try_cast("double"))
    return value, F.coalesce(value.isNotNull() & (F.regexp_extract(text, NUMBER, 2) == "%"), F.lit(False))


def parse_amount(text: Column) -> tuple[Column, Column]:
    """(amount, unit) of the first number in a cell and what follows it."""
    digits = F.replace(F.regexp_extract(text, WITH_UNIT, 1), F.lit(","), F.lit(""))
    return F.when(digits != "", digits.try_cast("decimal(38,10)")), F.trim(F.regexp_extract(text, WITH_UNIT, 2))


def format_number(value: Column) -> Column:
    """Without trailing zeros; a dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))


def coerce_number(text: Column) -> Column:
    """A number out of display text, without commas, percent and currency signs."""
    return F.translate(F.trim(text), ",%₹ ", "").try_cast("double")


def change(first: Column, last: Column, is_percent: Column | None = None) -> tuple[Column, Column]:
    """(last - first, its percentage of first to 2 places): none for a base of null or 0, or percent rows."""
    pct = F.when(first.isNotNull() & (first != 0), F.round((last - first) / first * 100, 2))
    return last - first, pct if is_percent is None else F.when(~is_percent, pct)


def value_type(value: Column, leaf: Column | None = None) -> Column:
    """BRANCH, PERCENTAGE, DATE, NUMERIC or TEXT."""
    kind = (
        F.when(value.rlike(r"^\s*-?[0-9][0-9,]*(\.[0-9]+)?\s*%\s*$"), "PERCENTAGE")
        .when(value.rlike(rf"^\s*{DATE}\s*$"), "DATE")
        .when(value.rlike(r"^\s*-?[0-9][0-9,]*(\.[0-9]+)?\s*$"), "NUMERIC")
        .otherwise("TEXT")
    )
    return kind if leaf is None else F.when(~leaf, "BRANCH").otherwise(kind)


def cell_flags(value: Column) -> dict[str, Column]:
    """What a cell looks like, by flag."""
    return {
        "has_digit": value.rlike("[0-9]"),
        "yes_no": F.lower(F.trim(value)).isin("yes", "no", "हाँ", "हां", "नहीं"),
        "percent": value.rlike("%"),
        "date": value.rlike(DATE),
        "pure_number": value.rlike(r"^\s*-?[0-9][0-9,]*(\.[0-9]+)?\s*$"),
        "duration": F.lower(value).rlike(r"[0-9]\s*(day|week|month|year|hour|minute|दिन|माह|वर्ष|घंट)"),
    }


def value_state(value: Column) -> Column:
    """blank, not_applicable or present; zero is present."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v == "", "blank").when(v.isin("n/a", "na", "not applicable", "लागू नहीं"), "not_applicable").otherwise("present")


def period_text(text: Column) -> Column:
    """The first date D.M.Y of a text as DD.MM.YYYY; null without one."""
    part = lambda i: F.regexp_extract(text, r"([0-9]{1,2})[./-]([0-9]{1,2})[./-]([0-9]{4}|[0-9]{2})(?![0-9])", i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    return F.when(part(1) != "", F.concat_ws(".", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), year))


def period_key(period: Column) -> Column:
    """(y, m, d) of DD.MM.YYYY, or of a year alone; zeros for anything else."""
    d, m, y = (F.regexp_extract(period, r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$", i).try_cast("int") for i in (1, 2, 3))
    year = F.regexp_extract(period, "(20[0-9]{2})", 1).try_cast("int")
    return F.struct(F.coalesce(y, year, F.lit(0)).alias("y"), F.coalesce(m, F.lit(0)).alias("m"), F.coalesce(d, F.lit(0)).alias("d"))


def report_period(filename: Column, document_id: Column, table_text: Column) -> Column:
    """File name, then id, then table text; then a year of the id."""
    year = F.regexp_extract(document_id, "(20[0-9]{2})", 1)
    return F.coalesce(period_text(filename), period_text(document_id), period_text(table_text), F.when(year != "", year))


def edition(document_id: Column) -> Column:
    """The last 20xx of a document id, else the id."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(document_id, F.lit("20[0-9]{2}"), F.lit(0)), F.lit(-1)), document_id)


#: How quarters are written.
QUARTERS = {
    "Q1": r"(?:प्रथम|\b1st|\bfirst)\s*(?:तिमाही|quarter)|\bQ1\b|\bquarter\s*1\b", "Q2": r"(?:द्वितीय|\b2nd|\bsecond)\s*(?:तिमाही|quarter)|\bQ2\b|\bquarter\s*2\b",
    "Q3": r"(?:तृतीय|\b3rd|\bthird)\s*(?:तिमाही|quarter)|\bQ3\b|\bquarter\s*3\b", "Q4": r"(?:चतुर्थ|\b4th|\bfourth)\s*(?:तिमाही|quarter)|\bQ4\b|\bquarter\s*4\b",
}


def quarter(text: Column) -> Column:
    """Q1 to Q4, as a sign or in words; then Annual or Quarterly; null otherwise."""
    out = F.when(F.lit(False), "")
    for name, pattern in QUARTERS.items():
        out = out.when(text.rlike(f"(?i){pattern}"), name)
    low = F.lower(text)
    return out.when(low.rlike("annual|वार्षिक"), "Annual").when(low.rlike("quarterly|तिमाही|त्रैमासिक"), "Quarterly")


_YEAR = "(19[89][0-9]|20[0-3][0-9])"


def page_year(text: Column) -> Column:
    """The year of one page: next to a year word, a range's first year, or the commonest of 1990 to 2035 in its first 1,200 characters (the first of equal ones)."""
    text = ascii_digits(F.coalesce(text, F.lit("")))
    found = [F.regexp_extract(text, rf"(?i){p}", 1) for p in (rf"(?:year|वर्ष|fy|edition|अंक|annual|वार्षिक)\D{{0,12}}?{_YEAR}", rf"(?:date|दिनांक)\s*[:–—-]?\s*[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-]{_YEAR}", rf"\b{_YEAR}\s*[-–—/]\s*[0-9]{{2,4}}\b")]
    years = F.filter(F.transform(F.regexp_extract_all(F.substring(text, 1, 1200), F.lit(rf"\b{_YEAR}\b"), F.lit(1)), lambda y: y.cast("int")), lambda y: (y >= 1990) & (y <= 2035))
    counted = F.transform(F.array_distinct(years), lambda y, i: F.struct(F.size(F.filter(years, lambda z: z == y)).alias("n"), (-i).alias("i"), y.alias("y")))
    return F.coalesce(*[F.when(x != "", x.cast("int")) for x in found], F.array_max(counted)["y"])


def file_year(filename: Column) -> Column:
    """The year of a file name: four digits, or `edition NN` of 20 to 35."""
    name = ascii_digits(F.coalesce(filename, F.lit("")))
    whole, short = F.regexp_extract(name, "((?:199|20[0-3])[0-9])", 1), F.regexp_extract(name, r"(?i)edition[_\s]*([0-9]{2})(?![0-9])", 1).try_cast("int")
    return F.coalesce(F.when(whole != "", whole.cast("int")), F.when(short.between(20, 35), short + 2000))


def year_of(text: Column, filename: Column) -> Column:
    """page_year(), else file_year()."""
    return F.coalesce(page_year(text), file_year(filename))


def token_hash(token: Column) -> Column:
    """CRC-32 without the top bit."""
    return F.crc32(token.cast("binary")).bitwiseAND(2147483647)


#: RFC 4122 name space of DNS names.
_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def point_id(raw: Column) -> Column:
    """UUID version 5 of a raw id in the DNS name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(_DNS)), raw.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def record_id(*parts: Column) -> Column:
    """sha256 of the parts as a compact JSON array; null is null."""
    quoted = [F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null")) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")), 256)


def file_safe(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_.-]", "_")


def short_label(label: Column) -> Column:
    """The text before a parenthesis."""
    return F.trim(F.regexp_extract(label, r"^([^(]*)", 1))


def metric_key(label: Column) -> Column:
    """Letters and digits of the last English parenthesis, else of the short label, lower-cased."""
    inner = F.try_element_at(F.regexp_extract_all(label, F.lit(r"\(([^()]*[A-Za-z][^()]*)\)"), F.lit(1)), F.lit(-1))
    base = F.lower(F.coalesce(inner, short_label(label)))
    return F.trim(F.regexp_replace(base, r"[^\p{L}\p{N}\x{0900}-\x{097F}]+", " "))
