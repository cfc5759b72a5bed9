"""Hierarchy points, path prefixes, the three-valued predicate, re-ranking and gates."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.functions import tokens as tk
from docloom.functions.script import _mapped, romanize_text

SEPARATOR = " > "
#: Which stored value types may answer a requested type.
COMPATIBLE = {
    "COUNT": ["NUMERIC", "NUMBER", "INTEGER", "COUNT"], "PERCENTAGE": ["PERCENTAGE"], "DATE": ["DATE", "TEXT"], "DURATION": ["DURATION", "NUMERIC", "TEXT"],
    "MONETARY": ["MONETARY", "NUMERIC", "TEXT"], "PERSON": ["PERSON", "NAME", "TEXT"], "DESCRIPTION": ["DESCRIPTION", "TEXT"],
}


def hierarchy_points(leaves: DataFrame) -> DataFrame:
    """Points from leaves (document_id, path ARRAY, value): each leaf, and each branch above one, once.

    Columns: id, document_id, node_type, hierarchy_path, hierarchy_path_text, node_key, node_value, value_type,
    root_section, parent_key, row_entity, column_attribute, depth. Equal paths are one point.
    """
    size = F.size("path")
    leaf = leaves.select("document_id", F.lit("leaf").alias("node_type"), "path", F.col("value").cast("string").alias("node_value"))
    above = leaves.filter(size > 1).select("document_id", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda n: F.slice("path", 1, n))).alias("path"))
    branch = above.distinct().select("document_id", F.lit("branch").alias("node_type"), "path", F.lit(None).cast("string").alias("node_value"))
    both = leaf.groupBy("document_id", "node_type", "path").agg(F.max("node_value").alias("node_value")).unionByName(branch)
    text = F.array_join("path", SEPARATOR)
    text = F.when(F.col("node_value").isNotNull(), F.concat(text, F.lit(" = "), F.col("node_value"))).otherwise(text)
    n = F.size("path")
    return both.select(
        F.concat("document_id", F.lit("::hier::"), "node_type", F.lit("::"), text).alias("id"),
        "document_id", "node_type", F.col("path").alias("hierarchy_path"), text.alias("hierarchy_path_text"), F.try_element_at("path", F.lit(-1)).alias("node_key"), "node_value",
        nb.value_type(F.col("node_value"), F.col("node_type") == "leaf").alias("value_type"), F.col("path")[0].alias("root_section"),
        F.when(n > 1, F.try_element_at("path", F.lit(-2))).alias("parent_key"),
        F.when((F.col("node_type") == "leaf") & (n >= 3), F.try_element_at("path", F.lit(-2))).alias("row_entity"),
        F.when((F.col("node_type") == "leaf") & (n >= 2), F.try_element_at("path", F.lit(-1))).alias("column_attribute"), n.alias("depth"),
    )


def sibling_ordinals(points: DataFrame) -> DataFrame:
    """Adds sibling_ordinal: the place of a point among those of its parent, from 1, by id."""
    parent = F.slice("hierarchy_path", 1, F.greatest(F.col("depth") - 1, F.lit(0)))
    return points.withColumn("sibling_ordinal", F.row_number().over(Window.partitionBy("document_id", parent).orderBy("id")))


_json = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|([^\s{}\[\],:"]+))', re.DOTALL)


def walk_tree(text: str | None) -> Iterator[tuple[list[str | None], str | None]]:
    """(path, value) of every node of a tree as JSON text {"key", "value", "children"}, parents first; nothing of a text that is no such tree.

    It keeps its own stack, so that a tree is as deep as it likes.
    """
    stack: list[dict] = []  # open nodes
    name, last, at, rows = None, None, 0, []
    skip = 0  # depth inside a value that is no scalar
    text = text or ""
    while match := _json.match(text, at):
        at = match.end()
        sign, quoted, bare = match.groups()
        if skip:
            skip += (sign in ("{", "[")) - (sign in ("}", "]")) if sign else 0
            if not skip:
                stack[-1]["node"][name] = text[begin:at]
            continue
        if sign == "{" and (not stack or stack[-1]["in"]):
            stack.append({"node": {"key": None, "value": None}, "in": False, "row": len(rows)})
            rows.append(None)
        elif sign in ("{", "["):
            if sign == "[" and name == "children":
                stack[-1]["in"] = True
            elif stack:
                begin, skip = match.start(1), 1
            else:
                return
        elif sign == "]" and stack:
            stack[-1]["in"] = False
        elif sign == "}" and stack:
            done = stack.pop()
            rows[done["row"]] = (done["node"]["key"], done["node"]["value"], len(stack))
            name = "children"
            if not stack:
                break
        elif quoted or bare:
            value = json.loads(quoted) if quoted else None if bare == "null" else bare
            if last in ("{", ",") and quoted:
                name = value
            elif stack and name in ("key", "value"):
                stack[-1]["node"][name] = value
        last = sign or "v"
    if stack:
        return
    path: list[str | None] = []
    for key, value, depth in rows:
        path = [*path[:depth], key]
        yield path, value


def flatten_tree(trees: DataFrame, key: str = "document_id", tree: str = "tree") -> DataFrame:
    """(key, path, value) of every node of trees as JSON text {"key", "value", "children"}, parents before children.

    A tree may have any depth and any number of nodes; one without a key at its root, and a text that is no tree, has none.
    """
    kind = trees.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, text in zip(pdf["own"], pdf["tree"], strict=True):
                held = []
                for path, value in walk_tree(text):
                    if path[0] is None:
                        break
                    held.append((own, path, value))
                    if len(held) == 4096:
                        yield pd.DataFrame(held, columns=["own", "path", "value"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["own", "path", "value"])

    found = trees.select(F.col(key).alias("own"), F.col(tree).alias("tree")).mapInPandas(walk, f"own {kind}, path array<string>, value string")
    return found.withColumnRenamed("own", key)


def find_key(points: DataFrame, key: str) -> DataFrame:
    """Points of a key, whatever its case, in the order of their paths; the first is the one that a lookup takes."""
    return points.filter(F.lower("node_key") == key.lower()).orderBy("document_id", "depth", "id")


def labels_text(values: Iterable[str | None] | None, attributes: dict[str, tuple[str, ...]]) -> list[str]:
    """What names answer to: each lower-cased without signs, and in Roman letters, with and without blanks; `attribute:` and the attribute one of whose words it has; `number:` and its section number, as 3 or 3(2)."""
    out: dict[str, None] = {}
    for value in values if values is not None else ():
        words = tk.query_tokens(value or "")
        plain, roman = " ".join(words), romanize_text(value)
        for form in (plain, roman):
            out |= dict.fromkeys(f for f in (form, form.replace(" ", "")) if f)
        out |= dict.fromkeys(f"attribute:{a}" for a, names in attributes.items() if set(words) & set(names))
        if numbers := re.findall(r"\d+(?:\s*\(\s*\d+\s*\))?", value or ""):
            out["number:" + " ".join(re.sub(r"\s+", "", n) for n in numbers)] = None
    return list(out)


def with_labels(points: DataFrame, attributes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds field_labels, entity_labels and section_labels: what a point's field, its row or branch, and its section answer to; empty where it has none.

    Taken when points are built, so that a question compares arrays.
    """
    label = _mapped("array<string>", partial(labels_text, attributes=attributes))
    path, leaf = F.col("hierarchy_path"), (F.col("node_type") == "leaf") & F.col("node_value").isNotNull()
    other = ~F.col("node_key").eqNullSafe(F.col("row_entity")) & ~F.col("node_key").eqNullSafe(F.col("parent_key"))
    field = F.when(other, F.col("node_key")).when(leaf, F.try_element_at(path, F.lit(-1)))
    above = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
    entity = F.when(F.col("row_entity").isNotNull(), F.array("row_entity")).when(F.size(above) > 0, above).otherwise(F.array("parent_key"))
    section = F.when(F.col("root_section").isNotNull(), F.array("root_section")).otherwise(path)
    return points.withColumn("field_labels", label(F.array(field))).withColumn("entity_labels", label(entity)).withColumn("section_labels", label(section))


@dataclass(frozen=True)
class Slots:
    """What a question asks of a point, as far as it says so."""

    field: str | None = None
    entity: str | None = None
    section: str | None = None
    direction: str | None = None
    source_language: str | None = None
    target_language: str | None = None


def slot_states(asked: Slots, attributes: dict[str, tuple[str, ...]]) -> list[Column]:
    """A state for each slot asked for, against the labels of with_labels(): true if one is shared, false if none is, null where a point has none. Points say nothing of directions and languages, so that those are null."""
    out = []
    for wanted, column in ((asked.field, "field_labels"), (asked.entity, "entity_labels"), (asked.section, "section_labels")):
        if wanted:
            own = F.array(*map(F.lit, labels_text([wanted], attributes) or [""]))
            out.append(F.when(F.size(column) > 0, F.arrays_overlap(column, own)))
    return out + [F.lit(None).cast("boolean") for x in (asked.direction, asked.source_language, asked.target_language) if x]


def descendants(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Points strictly below prefixes (document_id, prefix): an equi-join on each point's ancestors."""
    above = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda n: F.slice("hierarchy_path", 1, n))
    exploded = points.filter("depth > 1").withColumn("prefix", F.explode(above))
    return exploded.join(prefixes.select("document_id", "prefix"), ["document_id", "prefix"])


def under(path: Column, prefix: list[str]) -> Column:
    """Strictly deeper than one prefix."""
    return (F.slice(path, 1, len(prefix)) == F.array(*map(F.lit, prefix))) & (F.size(path) > len(prefix))


def siblings(points: DataFrame, parents: DataFrame) -> DataFrame:
    """Points right under parents (document_id, parent)."""
    own = points.filter("depth > 1").withColumn("parent", F.slice("hierarchy_path", 1, F.col("depth") - 1))
    return own.join(parents.select("document_id", "parent"), ["document_id", "parent"])


def branch_summary(points: DataFrame, prefix: list[str]) -> DataFrame:
    """(child, n_nodes, n_leaves, attributes): what stands below a branch, by child."""
    below = points.filter(under(F.col("hierarchy_path"), prefix))
    child = F.col("hierarchy_path")[len(prefix)]
    return below.groupBy(child.alias("child")).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("node_type") == "leaf").alias("n_leaves"), F.array_sort(F.collect_set(F.when(F.col("node_type") == "leaf", F.col("column_attribute")))).alias("attributes"))


def best_parent(children: DataFrame, entities: list[str]) -> DataFrame:
    """(document_id, parent_key, score): 10 for each matched entity, 2 for each descriptive child, and re-rank scores."""
    matched = sum((F.max(F.contains(F.lower("node_key"), F.lit(e.lower())).cast("int")) for e in entities), F.lit(0))
    descriptive = F.count_if((F.col("value_type") == "TEXT") & F.col("node_value").isNotNull())
    return children.groupBy("document_id", "parent_key").agg((10 * matched + 2 * descriptive + F.sum("rerank_score")).alias("score"))


def kleene_and(states: list[Column]) -> Column:
    """False before null before true."""
    return reduce(Column.__and__, states)


def slot(requested: str | list[str] | None, labels: Column) -> Column | None:
    """One requested slot against a candidate's labels: null where it has none; no state without a request."""
    if not requested:
        return None
    wanted = F.array(*[F.lit(x.lower()) for x in ([requested] if isinstance(requested, str) else requested)])
    have = F.array_compact(labels)
    return F.when(F.coalesce(F.size(have), F.lit(0)) <= 0, F.lit(None).cast("boolean")).otherwise(F.arrays_overlap(F.transform(have, F.lower), wanted))


def type_slot(requested: str | None, value_type: Column) -> Column | None:
    if not requested:
        return None
    return F.when(value_type.isNull() | (value_type == ""), F.lit(None).cast("boolean")).otherwise(value_type.isin(COMPATIBLE.get(requested, [requested])))


def eligibility(states: list[Column | None], leaf: Column | None = None, value: Column | None = None, enumerating: bool = False) -> Column:
    """VALID, UNKNOWN or CONTRADICTED: a false slot contradicts; a null slot, or (unless enumerating) a branch or a blank value, is unknown; no slot is unknown."""
    given = [s for s in states if s is not None]
    if not given:
        return F.lit("UNKNOWN")
    both = kleene_and(given)
    if not enumerating and leaf is not None and value is not None:
        both = both & F.when(leaf & value.isNotNull() & (F.trim(value) != ""), F.lit(True)).otherwise(F.lit(None).cast("boolean"))
    return F.when(both.isNull(), "UNKNOWN").when(both, "VALID").otherwise("CONTRADICTED")


def rerank_score(query: str, text: Column, vector_sim: Column, rrf: Column, lexical: Column, entities: list[str] | None = None, title: str | None = None) -> Column:
    """0.75 * vector + min(0.35, 4 * rrf) + 0.15 * min(1, lexical / 10) + 0.20 * share of the query's tokens + entities and title; 4 places."""
    toks = list(dict.fromkeys(tk.query_tokens(query)))
    low = F.lower(text)
    share = F.size(F.array_intersect(F.array_distinct(tk.tokens(text)), F.array(*map(F.lit, toks)))) / F.lit(float(max(1, len(toks))))
    score = 0.75 * F.coalesce(vector_sim, F.lit(0.0)) + F.least(F.lit(0.35), 4 * F.coalesce(rrf, F.lit(0.0))) + 0.15 * F.least(F.lit(1.0), F.coalesce(lexical, F.lit(0.0)) / 10) + 0.20 * share
    if entities:
        score = score + F.least(F.lit(0.40), 0.20 * sum((F.contains(low, F.lit(e.lower())).cast("int") for e in entities), F.lit(0)))
    if title:
        score = score + F.when(F.contains(low, F.lit(title.lower())), 0.50).otherwise(0.0)
    return F.round(score, 4)


def hierarchy_terms(query: str, path: Column, value: Column, leaf: Column, value_type: Column, expected: str | None = None) -> Column:
    """What hierarchy rows add: path coverage, a leaf's value, and how its type suits the expected one."""
    toks = list(dict.fromkeys(tk.query_tokens(query)))
    in_path = F.size(F.array_intersect(F.array_distinct(tk.tokens(F.array_join(path, " "))), F.array(*map(F.lit, toks)))) / F.lit(float(max(1, len(toks))))
    score = 0.80 * in_path + F.when(leaf & value.isNotNull() & (in_path > 0), 0.35).otherwise(0.0)
    number = value_type == "NUMERIC"
    few = F.size(F.split(F.trim(F.coalesce(value, F.lit(""))), r"\s+")) <= 2
    rules = {
        "DURATION": F.when(F.lower(value).rlike("day|week|month|year|दिन|माह|वर्ष"), 2.5).when(leaf, -2.5),
        "MONETARY": F.when(F.lower(value).rlike("₹|rs|rupee|रुप|रु"), 2.5).when(leaf & number, -2.5),
        "DATE": F.when(value.rlike(nb.DATE), 2.5).when(leaf & number, -2.5),
        "PERCENTAGE": F.when(value_type == "PERCENTAGE", 0.40).otherwise(-0.40),
        "PERSON": F.when(leaf, F.when(number | (value_type == "PERCENTAGE"), -3.0).otherwise(2.0)).otherwise(0.5),
        "DESCRIPTION": F.when(leaf, F.when(number | few, -3.0).otherwise(2.0)).otherwise(0.5),
        "COUNT": F.when(number, 0.40).when(value_type.isin("PERCENTAGE", "DATE"), -0.50),
    }
    return score + F.coalesce(rules[expected], F.lit(0.0)) if expected in rules else score


def rerank(df: DataFrame, score: str = "rerank_score", state: str = "structural_eligibility", id_column: str = "id", n: int = 5) -> DataFrame:
    """Contradicted rows go; VALID before UNKNOWN, then by score."""
    kept = df.filter(F.col(state) != "CONTRADICTED")
    return kept.orderBy(F.when(F.col(state) == "VALID", 0).otherwise(1), F.desc(score), id_column).limit(n)


def evidence_gate(df: DataFrame, constrained: bool, enumerating: bool = False, least: float = 0.30) -> DataFrame:
    """Rows that may answer: no contradicted ones; no branches unless enumerating; with constraints VALID leaves with a value; score 0.30."""
    leaf = F.col("node_type") == "leaf"
    out = df.filter(F.col("structural_eligibility") != "CONTRADICTED")
    if not enumerating:
        out = out.filter(leaf)
    if constrained and not enumerating:
        out = out.filter((F.col("structural_eligibility") == "VALID") & (F.trim(F.coalesce("node_value", F.lit(""))) != ""))
    return out.filter(F.col("rerank_score") >= least)


def has_word(value: Column) -> Column:
    """Not symbols alone."""
    return value.rlike(r"[A-Za-z0-9\x{0900}-\x{097F}]")


#: Names of designations, by group.
ROLES = [
    ("secretary", "sachiv", "सचिव"),
    ("director", "nideshak", "निदेशक"),
    ("chairman", "chairperson", "president", "adhyaksh", "adhyaksha", "अध्यक्ष"),
    ("editor", "sampadak", "संपादक", "सम्पादक"),
    ("minister", "mantri", "मंत्री"),
    ("engineer", "abhiyanta", "अभियंता"),
    ("officer", "adhikari", "अधिकारी"),
    ("manager", "prabandhak", "प्रबंधक"),
    ("convener", "convenor", "sanyojak", "संयोजक"),
    ("head", "pramukh", "प्रमुख"),
    ("translator", "anuvadak", "अनुवादक"),
]


def roles_in(question: str) -> list[list[str]]:
    """The groups of designations of which a word of the question begins with a name."""
    words = re.findall(r"[a-z\u0900-\u097F]+", question.lower())
    return [list(names) for names in ROLES if any(w.startswith(names) for w in words)]


def roles_present(groups: list[list[str]], text: Column) -> Column:
    """Every group of designations named in the question occurs in the evidence, anywhere in a word."""
    low = F.lower(text)
    return reduce(Column.__and__, [reduce(Column.__or__, [F.contains(low, F.lit(t.lower())) for t in g]) for g in groups], F.lit(True))


def type_gate(expected: str | None, value: Column) -> Column:
    """Whether a value may answer an expected type."""
    low, number = F.lower(value), value.rlike(r"^\s*[0-9][0-9,.]*\s*%?\s*$")
    words = F.size(F.split(F.trim(value), r"\s+"))
    return {
        "DURATION": low.rlike("day|week|month|year|hour|दिन|माह|वर्ष|घंट"),
        "MONETARY": low.rlike("₹|rs|rupee|lakh|crore|रुप|रु|लाख|करोड़"),
        "DATE": value.rlike(nb.DATE) | value.rlike("(19|20)[0-9]{2}"),
        "PERSON": ~number,
        "DESCRIPTION": ~number & (words > 2),
    }.get(expected, F.lit(True))


def typed_or_wordy(df: DataFrame, expected: str | None, value: str = "node_value", order: tuple[str, ...] = ("rerank_score",)) -> DataFrame:
    """Rows whose value may answer the expected type; for a person or a description without any, the first whose value has four words or more."""
    from docloom.operators.search import or_else

    fits = df.filter(has_word(F.col(value)) & type_gate(expected, F.col(value)))
    if expected not in ("PERSON", "DESCRIPTION"):
        return fits
    wordy = df.filter(F.size(F.split(F.trim(F.col(value)), r"\s+")) >= 4).orderBy(*[F.desc(c) for c in order]).limit(1)
    return or_else(fits, wordy)


def sufficient(df: DataFrame, score: str = "score", lexical: str = "lexical") -> DataFrame:
    """(sufficient): top score 0.45, or lexical support and 0.30."""
    return df.agg(F.coalesce((F.max(score) >= 0.45) | ((F.max(lexical) > 0) & (F.max(score) >= 0.30)), F.lit(False)).alias("sufficient"))


def first_of(df: DataFrame, keys: list[str], order: list, limit: int | None = None) -> DataFrame:
    """One row a key, the first in an order; then `limit` rows in that order."""
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return out.orderBy(*order).limit(limit) if limit else out
