"""Personal data by bootstrapped contextual extraction.

1. Base expressions give seed entities. Other texts of the form of an identifier (digits, @, bracketed at and dot)
   are loose instances; only their surroundings can tell whether they are personal data.
2. One to three words before and after an instance, with digits as 0, are its lexical patterns. They and the
   instances make a graph. What a pattern matches is every place where its words occur, in all documents.
3. Spark scores the graph in turn. A pattern's confidence is the score of the instances it introduces against all
   it matches, its support the sum of scores of its different instances; a loose instance has the noisy or of the
   patterns that pass. Seeds alone count at first; what they discover supports further patterns in later rounds.
4. Patterns that pass discover loose instances, seen or unseen, next to them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import by_key, chunks, discard, sha256_hex, write_shared

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs this support and confidence; ROUNDS at most. WORDS of a pattern; DIGITS of a loose instance without @.
MIN_SUPPORT, MIN_CONFIDENCE, ROUNDS, WORDS, DIGITS = 3, 0.3, 5, 3, 4
#: Patterns that are broadcast at most: to count their places, and to discover with. More are joined to.
MAX_COUNTED, MAX_PATTERNS = 200_000, 10_000
#: Different phrases (or edges) whose counts a task holds before it sends them.
MOST_WORDS = 200_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_digit = re.compile(r"[0-9]")
# A match never starts inside a run of digits, as every match ends at the end of one.
_ip = re.compile(r"(?<![0-9])[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_token = re.compile(r"(?<!\S)(?=\S*[0-9@])\S+")
_piece = re.compile(r"""[^"'<>=,;|]+""")
_group = re.compile(r"[0-9().+/_-]*[0-9][0-9().+/_-]*")
_hidden = re.compile(r"(?<!\S)[^\s\[({<]+ ?[\[({<] ?(?:at|dot) ?[\])}>] ?[^\s\[({<]+(?: ?[\[({<] ?(?:at|dot) ?[\])}>] ?[^\s\[({<]+)*", re.IGNORECASE)
_marked = re.compile(r"[\[({<] ?at ?[\])}>]", re.IGNORECASE)
_MARKS = ".!?:*#$%&~^_-\\/[]{}`"
_edges = re.compile(r"^\W+|\W+$")
_digits = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base entities, by kind and start; code points, end exclusive."""
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            out.append(("email", start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    if _digit.search(text):
        out += [("ip", *m.span()) for m in _ip.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _card.finditer(text):
            if 16 <= m.end() - m.start() and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _phone.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of texts of the form of an identifier in order, none of which touches a base entity or an earlier one."""
    found: list[tuple[int, int]] = []
    if "@" in text or _digit.search(text):
        groups: list[tuple[int, int, bool]] = []
        for m in _token.finditer(text):
            for p in _piece.finditer(m[0]):
                own = p[0].lstrip(_MARKS)
                start = m.start() + p.end() - len(own)
                own = own.rstrip(_MARKS)
                own = own[:-1] if own.endswith(")") and "(" not in own else own
                name, colon, rest = own.partition(":")
                if colon and name.isalpha():  # tel:555
                    start, own = start + len(name) + 1, rest
                if not own:
                    continue
                digits = bool(_group.fullmatch(own))
                if digits and groups and groups[-1][2] and text[groups[-1][1] : start] == " ":
                    groups[-1] = (groups[-1][0], start + len(own), True)  # groups of digits are one instance
                else:
                    groups.append((start, start + len(own), digits))
        found = [(a, b) for a, b, _ in groups if "@" in text[a + 1 : b - 1] or sum(map(len, _digits.findall(text, a, b))) >= DIGITS]
    if _marked.search(text):
        found += [m.span() for m in _hidden.finditer(text) if _marked.search(m[0])]
    out, taken, at, end = [], sorted((a, b) for _, a, b in base), 0, 0
    for start, stop in sorted(found):
        while at < len(taken) and taken[at][1] <= start:
            end, at = max(end, taken[at][1]), at + 1
        # base entities of different kinds may overlap, so all that begin before the end are looked at, each once or twice
        if start >= end and (at == len(taken) or taken[at][0] >= stop):
            out.append((start, stop))
            end = stop
    return out


def _word(raw: str) -> str:
    """A word of a pattern: lower-cased, without marks at its edges, runs of digits as 0."""
    return _digits.sub("0", _edges.sub("", raw.lower()))


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """L: and R: with one to WORDS words before and after a span, in the order of the text; marks alone are no words."""
    before: list[str] = []
    at = start
    while at > 0 and len(before) < WORDS:
        stop = at
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        if w := _word(text[at:stop]):
            before.append(w)
        while at > 0 and text[at - 1].isspace():
            at -= 1
    after: list[str] = []
    at = end
    while at < len(text) and len(after) < WORDS:
        begin = at
        while at < len(text) and not text[at].isspace():
            at += 1
        if w := _word(text[begin:at]):
            after.append(w)
        while at < len(text) and text[at].isspace():
            at += 1
    return [f"L:{' '.join(before[:n][::-1])}" for n in range(1, len(before) + 1)] + [f"R:{' '.join(after[:n])}" for n in range(1, len(after) + 1)]


def phrase_counts(texts: Iterable[str | None], phrases: frozenset[str] | None, known: dict[str, str]) -> Counter:
    """How often phrases of one to WORDS words occur (all of them where phrases is None); known caches words."""
    out: Counter = Counter()
    first: dict[str, list[int]] = {}
    for p in phrases or ():
        n = p.count(" ") + 1
        if n not in (own := first.setdefault(p.partition(" ")[0], [])):
            own.append(n)
    for text in texts:
        words = []
        for raw in (text or "").split():
            w = known.get(raw)
            if w is None:
                w = known[raw] = _word(raw)
            if w:
                words.append(w)
        if phrases is None:
            for n in range(1, WORDS + 1):
                out.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
            continue
        for i, w in enumerate(words):
            if w in first:
                for n in first[w]:
                    p = w if n == 1 else " ".join(words[i : i + n])
                    if p in phrases:
                        out[p] += 1
    return out


def pattern_graph(docs: DataFrame) -> DataFrame:
    """(pattern, instance, kind, n) of every instance of all documents as a shared table; kind is null for loose ones."""

    def rows_of(found: Counter) -> pa.RecordBatch:
        columns = zip(*((*k, n) for k, n in found.items()), strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], ["pattern", "instance", "kind", "n"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for (texts,) in chunks(batches, columns=("text",)):
            for text in texts:
                if not text:
                    continue
                base = base_spans(text)
                for kind, start, end in [*base, *((None, *s) for s in loose_spans(text, base))]:
                    for p in patterns_of(text, start, end):
                        found[p, xxhash.xxh64_intdigest(text[start:end].encode("utf-8", "surrogatepass")) - (1 << 63), kind] += 1
                if len(found) > MOST_WORDS:
                    yield rows_of(found)
                    found = Counter()
        yield rows_of(found)

    rows = docs.select("text").mapInArrow(edges, "pattern string, instance long, kind string, n long")
    return write_shared(rows.groupBy("pattern", "instance", "kind").agg(F.sum("n").alias("n")), "graph")


def pattern_totals(docs: DataFrame, patterns: DataFrame, most: int = MAX_COUNTED, most_words: int = MOST_WORDS) -> DataFrame:
    """(pattern, total): how often the words of each pattern occur in all documents.

    The phrases are broadcast if they are `most` at most; otherwise all phrases are counted and joined to. A task holds
    counts of most_words phrases, and sends them when there are more.
    """
    wanted = patterns.select("pattern", F.expr("substring(pattern, 3)").alias("phrase"))
    few = wanted.select("phrase").distinct().limit(most + 1).toArrow().column(0).to_pylist()
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(few) if len(few) <= most else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known = Counter(), {}
        for (texts,) in chunks(batches, columns=("text",)):
            out.update(phrase_counts(texts, shared.value, known))
            known = known if len(known) <= MOST_WORDS else {}
            if len(out) > most_words:
                yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], ["phrase", "total"])
                out = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], ["phrase", "total"])

    totals = docs.select("text").mapInArrow(count, "phrase string, total long").groupBy("phrase").agg(F.sum("total").alias("total"))
    return wanted.join(totals, "phrase", "left").select("pattern", F.coalesce("total", F.lit(0)).alias("total"))


def score_patterns(edges: DataFrame, totals: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, support) of the patterns that pass, as a shared table; patterns and instances are scored in turn.

    A round that lets no further pattern pass is the last. A loose instance is of the kind that scores best, the
    earlier by name of equal ones.
    """
    # the total, and how many edges a pattern has, on every edge
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("places"))
    sizes = sizes.join(totals, "pattern").select("pattern", "edges", F.greatest("total", "places").alias("total"))
    graph = write_shared(by_key(edges, sizes, ["pattern"], "edges"), "scored")
    seeds = graph.filter("kind IS NOT NULL").select("pattern", "instance", "kind", "n", "total", F.lit(1.0).alias("score"))
    scored, passing, known = seeds, None, -1
    for _ in range(rounds):
        by = scored.groupBy("pattern", "kind").agg((F.sum(F.col("score") * F.col("n")) / F.max("total")).alias("confidence"), F.sum("score").alias("support"))
        found = write_shared(by.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)), "passing")
        if passing is not None:
            discard(passing)
        passing, before, known = found, known, found.count()
        if known == before:
            break
        loose = graph.filter("kind IS NULL").drop("kind")
        heard = loose.join(passing.select("pattern", "kind", "confidence"), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        best = heard.groupBy("instance").agg(F.max_by("kind", F.struct("score", F.expr("-ascii(kind)"))).alias("kind"), F.max("score").alias("score"))
        best = write_shared(best, "heard")
        scored = seeds.unionByName(loose.join(best, "instance").select(*seeds.columns))
    return passing


def passing_patterns(docs: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(kind, pattern, confidence) rows to discover with, all of them, as a shared table."""
    edges = pattern_graph(docs)
    # a pattern with fewer instances never gets the support
    many = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("instances")).filter(F.col("instances") >= min_support).select("pattern")
    totals = write_shared(pattern_totals(docs, write_shared(many, "many")), "totals")
    # nor does one whose words occur too often next to other things get the confidence
    places = edges.groupBy("pattern").agg(F.sum("n").alias("places")).join(totals, "pattern").filter(F.col("places") >= min_confidence * F.greatest("total", "places"))
    places = write_shared(places.select("pattern", "total"), "likely")
    likely = edges.join(places.select("pattern"), "pattern", "left_semi")
    return score_patterns(likely, places, min_support, min_confidence).select("kind", "pattern", "confidence")


def confident_patterns(docs: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> dict[str, list[tuple[str, float]]]:
    """passing_patterns() on the driver: (kind, confidence) rows by pattern."""
    return _by_pattern(passing_patterns(docs, min_support, min_confidence))


def _by_pattern(passing: DataFrame) -> dict[str, list[tuple[str, float]]]:
    out: dict[str, list[tuple[str, float]]] = {}
    for r in passing.collect():
        out.setdefault(r["pattern"], []).append((r["kind"], r["confidence"]))
    return out


def kind_of(found: Iterable[tuple[str, float]]) -> str | None:
    """The kind whose patterns (kind, confidence) have the highest noisy or, the earlier by name of equal ones; None for no pattern."""
    miss: dict[str, float] = {}
    for kind, confidence in sorted(found):
        miss[kind] = miss.get(kind, 0.0) + math.log1p(-min(confidence, 1 - 1e-12))
    return min(sorted(miss), key=lambda k: round(miss[k], 6)) if miss else None


def all_spans(text: str | None, patterns: dict[str, list[tuple[str, float]]]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by kind and start."""
    if not text:
        return [], []
    base, more = base_spans(text), []
    for start, end in loose_spans(text, base) if patterns else ():
        if kind := kind_of(x for p in patterns_of(text, start, end) for x in patterns.get(p, ())):
            more.append((kind, start, end))
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def joined_data(docs: DataFrame, passing: DataFrame) -> DataFrame:
    """personal_data() with patterns of any number: candidates are joined to them, and no task holds them all."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "more"]
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    loose = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("patterns", pa.list_(pa.string()))])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [base_spans(t) for t in texts]
            counts = [pa.array([sum(s[0] == k for s in base) for base in found], pa.int64()) for k in KINDS]
            digests = [sha256_hex(joined(base)) for base in found]
            every = [[{"kind": KINDS.index(k), "start": a, "end": b} for k, a, b in base] for base in found]
            more = [[{"start": a, "end": b, "patterns": patterns_of(t, a, b)} for a, b in loose_spans(t, base)] for t, base in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(every, pa.list_(span)), pa.array(more, pa.list_(loose))], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:int,start:long,end:long>>, more array<struct<start:long,end:long,patterns:array<string>>>"
    # numbered when written: a row keeps its number
    rows = write_shared(docs.select("doc_id", "text").mapInArrow(candidates, schema).withColumn("row", F.monotonically_increasing_id()), "candidates")
    kinds = F.array(*map(F.lit, KINDS))
    pairs = rows.select("row", F.explode("more").alias("m")).select("row", "m.start", "m.end", F.explode(F.array_distinct("m.patterns")).alias("pattern"))
    heard = pairs.join(passing, "pattern").groupBy("row", "start", "end", "kind").agg(F.round(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-12)))), 6).alias("miss"))
    kind = (F.array_position(kinds, F.min_by("kind", F.struct("miss", "kind"))) - 1).cast("int")
    added = heard.groupBy("row", "start", "end").agg(kind.alias("kind")).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    own = F.coalesce("added", F.array().cast("array<struct<kind:int,start:long,end:long>>"))
    told = F.transform(F.array_sort(F.concat("base", own)), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"]))
    return rows.join(added, "row", "left").select(*names[:6], F.array_join(told, ",").alias("spans"), F.size(own).cast("long").alias("n_added"))


def personal_data(docs: DataFrame, patterns: dict[str, list[tuple[str, float]]] | None = None, most: int = MAX_PATTERNS) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone (base entities), base_sha256, spans, n_added.

    Null and empty texts have no spans: counts of 0, the digest of "" and "". Texts of any length are read whole, in
    time that grows with the length. Base entities of different kinds may overlap and all count; an added span touches
    none, and where kinds tie it is of the earlier by name. Repeated rows give a row each; other columns are ignored,
    whatever their names; an empty table gives no rows and no patterns. Patterns are broadcast when they are `most` at
    most, and joined to otherwise.
    """
    if patterns is None:
        passing = passing_patterns(docs)
        if passing.limit(most + 1).count() > most:
            return joined_data(docs, passing)
        patterns = _by_pattern(passing)
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t, shared.value) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            spans = [joined(every) for _, every in found]
            digests = [sha256_hex(joined(base)) for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array([len(every) - len(base) for base, every in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
