"""Similarity joins of short strings by sequence ratio, and what follows from them: first-seen clusters, components.

The ratio is 2 M / T (M matched characters of T in both). Matched characters are a common subsequence, so that strings
alike by `ratio` are at most (1 - ratio) T insertions and deletions apart. Each spoils two 2-grams of a string at
most; of the 2-grams in order of rarity the first ones hence must meet, no further apart than the edits allow. These meet
in an equi-join; lengths, positions and letter counts thin the pairs out, and ratios are taken of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.script import seq_ratio
from docloom.sources.scratch import Scratch

#: Stands before and after a string.
EDGE = "\x02"


def _edits(length: Column, ratio: float) -> Column:
    """Insertions and deletions that keep a string of this length alike to any other."""
    return F.floor(F.lit(1e-9) + F.lit(2 * (1 - ratio) / ratio) * length).cast("int")


def similar_pairs(keys: DataFrame, key: str, by: list[str], ratio: float) -> DataFrame:
    """(by, a, b, ratio_ab, ratio_ba) of distinct keys a < b of one group with a ratio of `ratio` in one direction at least.

    The ratio of two strings depends on which comes first. Groups compare as equal where both are null; null keys are
    like nothing. No group is gathered: its pairs are dealt by 2-grams.
    """
    text = keys.select(*by, F.col(key).alias("_k")).filter("_k IS NOT NULL").distinct().withColumn("_n", F.length("_k"))
    padded = F.concat(F.lit(EDGE), "_k", F.lit(EDGE))
    grams = F.transform(F.sequence(F.lit(1), F.col("_n") + 1), lambda i: F.struct(F.substring(padded, i, F.lit(2)).alias("g"), i.alias("p")))
    places = text.withColumn("_x", F.explode(grams)).select(*by, "_k", "_n", F.col("_x.g").alias("_g"), F.col("_x.p").alias("_p"))
    rare = places.groupBy("_g").agg(F.count(F.lit(1)).alias("_often"))
    order = F.sort_array(F.collect_list(F.struct("_often", "_g", "_p")))  # as many as the string has characters
    spoilt = 2 * _edits(F.col("_n"), ratio) + 1
    first = places.join(rare, "_g").groupBy(*by, "_k", "_n").agg(order.alias("_o")).withColumn("_x", F.explode(F.slice("_o", F.lit(1), spoilt)))
    first = first.select(*by, "_k", "_n", F.col("_x._g").alias("_g"), F.col("_x._p").alias("_p"))
    a, b = first.alias("a"), first.alias("b")
    on = (F.col("a._g") == F.col("b._g")) & (F.col("a._k") < F.col("b._k"))
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    apart = F.floor(F.lit(1e-9) + (1 - ratio) * (F.col("a._n") + F.col("b._n")))
    on = on & (F.abs(F.col("a._n") - F.col("b._n")) <= apart) & (F.abs(F.col("a._p") - F.col("b._p")) <= apart)
    pairs = a.join(b, on).select(*[F.col(f"a.{c}") for c in by], F.col("a._k").alias("a"), F.col("b._k").alias("b")).distinct()
    shared = F.length("a") + F.length("b") - F.length(_without(F.col("a"), F.col("b"))) - F.length(_without(F.col("b"), F.col("a")))
    pairs = pairs.filter(shared + 1e-9 >= ratio * (F.length("a") + F.length("b")))
    out = pairs.withColumn("ratio_ab", seq_ratio(F.col("a"), F.col("b"))).withColumn("ratio_ba", seq_ratio(F.col("b"), F.col("a")))
    return out.filter((F.col("ratio_ab") >= ratio) | (F.col("ratio_ba") >= ratio))


def _without(a: Column, b: Column) -> Column:
    """The characters of a that b doesn't have at all: what surely isn't matched."""
    return F.array_join(F.filter(F.split(a, ""), lambda c: ~F.contains(b, c)), "")


def first_seen(keys: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, leader) of keys (key, at) in the order of at: a key joins the first leader before it that an edge (early, late) ties it to, or leads.

    In rounds: what has no undecided key tied before it is decided, and what is tied to a leader before it leads no more.
    Each round is written; only whether something is undecided reaches the driver. `at` is different for every key.
    """
    tied = scratch.write(edges.select("early", "late").distinct(), "edges")
    state = scratch.write(keys.select("key", "at", F.lit(None).cast("boolean").alias("leads")), "state")
    while True:
        before = tied.join(state.select(F.col("key").alias("early"), "leads"), "early").groupBy("late").agg(F.coalesce(F.bool_or(F.col("leads")), F.lit(False)).alias("led"), F.bool_or(F.col("leads").isNull()).alias("waits"))
        met = state.join(before, state.key == before.late, "left")
        leads = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("led"), False).when(F.coalesce("waits", F.lit(False)), None).otherwise(True)
        new = scratch.write(met.select("key", "at", leads.alias("leads")), "state")
        scratch.drop(state)
        state = new
        if state.filter("leads IS NULL").isEmpty():
            break
    heads = tied.join(state.filter("leads").select(F.col("key").alias("early"), "at"), "early").groupBy("late").agg(F.min_by("early", "at").alias("head"))
    out = state.join(heads, state.key == heads.late, "left")
    return out.select("key", F.when(F.col("leads"), F.col("key")).otherwise(F.col("head")).alias("leader"))


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) lead to; a node without edges is its own. Rounds grow with the logarithm of a chain."""
    both = scratch.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    state = scratch.write(nodes.select("node", F.col("node").alias("component")).distinct(), "components")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        low = state.join(near, state.node == near.a, "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        far = state.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = scratch.write(low.join(far, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("next"), "component"), "components")
        scratch.drop(state)
        if new.filter("next <> component").isEmpty():
            return new.select("node", "component")
        state = scratch.write(new.select("node", F.col("next").alias("component")), "components")
        scratch.drop(new)
