"""Mixing sources to target weights by pivotal dependent rounding.

Each document has the expected copies target / size of its source. The whole part is taken; the fractions
are rounded by the pivotal method: two documents meet, words move at random from one to the other until
one fraction is 0 or 1, and the other goes on. Moves keep the words of the pair constant, so that a
source's words stay at its target until its last open document, which is rounded to the nearest. If the target is
then missed by more than MISS of it, the root turns the rounding of a few of its documents to come near again.
Documents meet in blocks of bounded size, equal rows in many of them; what a block leaves open meets in the next level, up a reduction tree
with one root per source.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import common, merkle
from docloom.llm.common import by_key, write_shared

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BLOCK = 8192
ADDED = ("size", "source_size", "target", "taken")
#: Share of a target that may be missed before the root turns roundings, TURNS at most.
MISS, TURNS = 0.001, 16
NON_BLANK = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Words to take of each source.

    Sources by code point, null last, have the weights in turn. They share `share` of all words by weight;
    a target above cap times its source's size is cut to it and the excess is shared again among the rest.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: cap * n for s, n in order}
    out = dict.fromkeys(limit, 0.0)
    left, free = share * sum(n for _, n in order), [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= limit[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: limit[s] for s in over}
        left -= sum(limit[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def planned(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, rows, target) for each source of rows (source, size), as a shared table; targets() on any number of sources.

    Sources are numbered in order by range; then the level to which targets fill up rises until no further source is
    full. A round is one sum; a few numbers reach the driver.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    dealt = by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = write_shared(dealt, "sources")
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # one row a partition
    before = {p: sum(n for q, n in counts.items() if q < p) for p in counts}
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("part").cast("long")) if before else F.lit(0)
    nth = offset + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights)).cast("int") + 1)
    dealt = write_shared(dealt.withColumn("weight", weight), "weights")
    total = dealt.agg(F.sum("source_size")).first()[0] or 0
    left, free, full = share * total, dealt.agg(F.sum("weight")).first()[0] or 0, -1
    while True:
        over = F.lit(left) * F.col("weight") / F.lit(float(free)) >= F.lit(cap) * F.col("source_size") if free else F.lit(True)
        n, size, weighs = dealt.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full:
            break
        full, left, free = n, share * total - cap * (size or 0), weighs or 0
    target = F.when(over, F.lit(cap) * F.col("source_size")).otherwise(F.lit(left) * F.col("weight") / F.lit(float(free or 1)))
    return write_shared(dealt.select("source", "source_size", "rows", target.cast("double").alias("target")), "plan")


def _duel(block: pd.DataFrame, rng: random.Random, last: bool) -> pd.DataFrame:
    """Pivotal rounding of `open` (fractions) with sizes as weights; one row at most stays open."""
    size, p = block["size"].tolist(), block["open"].tolist()
    extra = [0] * len(p)
    at = None
    for i in range(len(p)):
        if at is None:
            at = i
            continue
        a, b = at, i
        # p[a] + x / size[a] and p[b] - x / size[b]: x words move up to `up` or down to `down`
        up = min((1 - p[a]) * size[a], p[b] * size[b])
        down = min(p[a] * size[a], (1 - p[b]) * size[b])
        x = up if rng.random() * (up + down) < down else -down
        to_a, to_b = (x == (1 - p[a]) * size[a]) - (-x == p[a] * size[a]), (-x == (1 - p[b]) * size[b]) - (x == p[b] * size[b])
        p[a], p[b] = p[a] + x / size[a], p[b] - x / size[b]
        at = None
        for j, to in ((a, to_a), (b, to_b)):
            if to:
                extra[j], p[j] = int(to > 0), 0.0
            else:
                at = j
    if at is not None and last:
        extra[at], missed = int(p[at] >= 0.5), (p[at] - int(p[at] >= 0.5)) * size[at]
        p[at] = 0.0
        extra = _turned(np.array(size), np.array(extra), missed, MISS * float(block["target"].iloc[0]) if "target" in block else 0.0)
    return block.assign(open=p, copies=block["copies"].to_numpy() + np.array(extra))


def _turned(size: np.ndarray, extra: np.ndarray, missed: float, most: float) -> np.ndarray:
    """Roundings (0 or 1), some turned so that `missed` words (taken too few, or too many if below 0) come near 0.

    Each turn is the one that leaves the least; none that leaves no less is made.
    """
    extra = extra.copy()
    for _ in range(TURNS):
        if abs(missed) <= most:
            break
        left = np.abs(missed - np.where(extra == 0, size, -size))
        best = int(left.argmin())
        if left[best] >= abs(missed):
            break
        missed -= size[best] if extra[best] == 0 else -size[best]
        extra[best] = 1 - extra[best]
    return extra


def _reducer(seed: int, level: int, last: bool):
    def reduce(key, pdf):
        pdf = pdf.sort_values(["size", "tie"], ascending=[False, True], kind="stable")
        return _duel(pdf, random.Random(f"{seed}/{level}/{key[0]!r}/{key[1]}"), last)

    return reduce


def numbered(rows: DataFrame) -> DataFrame:
    """number: 0, but 0, 1, 2 ... over equal rows (by tie) where they are many, so that they don't meet in one node.

    Equal rows are interchangeable, so that it doesn't matter which has which number.
    """
    many = write_shared(rows.groupBy("tie").agg(F.count(F.lit(1)).alias("equal")).filter(F.col("equal") > common.HOT), "many")
    rows = rows.withColumn("number", F.lit(0).cast("long"))
    if many.isEmpty():
        return rows
    equal = write_shared(by_key(rows, many, ["tie"], "equal").select("doc_id", "source", F.col("size").alias("words"), "tie", F.col("tie").cast("string").alias("tree")), "equal")
    apart = merkle.ranked(equal, F.col("tie")).select("doc_id", "source", F.col("words").alias("size"), "tie", F.col("rank").alias("number"))
    few = F.broadcast if many.limit(common.HOT_KEYS + 1).count() <= common.HOT_KEYS else lambda df: df
    return rows.join(few(many), "tie", "left_anti").unionByName(apart)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, copies.

    size: words between blanks, 0 for null and empty texts, which are taken 0 times; texts of any length count whole. Reruns agree: chance
    depends on the seed, the source and the documents alone, not on how rows are dealt out. Repeated rows
    are rounded one by one. An empty table gives no rows; other columns are ignored.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(NON_BLANK)), F.lit(0)).cast("long")
    rows = write_shared(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("tie")), "sizes")
    rows = numbered(rows)
    plan = planned(rows, weights, share, cap)
    most = plan.agg(F.max("rows")).first()[0] or 0
    plan = plan.withColumn("blocks", F.ceil(F.col("rows") / block).cast("long"))
    keyed = lambda df: df.withColumn("__docloom_null", F.col("source").isNull()).withColumn("__docloom_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    rows = by_key(keyed(rows), keyed(plan).drop("source"), ["__docloom_null", "__docloom_source"], "rows").select("doc_id", "source", "size", "tie", "number", "source_size", "target", "blocks")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.floor(expected)).otherwise(0).cast("long"))
    rows = rows.withColumn("open", F.when(F.col("size") > 0, expected - F.floor(expected)).otherwise(0.0))
    out = []
    level, left = 0, rows
    blocks = most
    while True:
        last = blocks <= block
        node = F.when(F.lit(last), 0).otherwise(F.pmod(F.xxhash64(F.lit(seed + level), "tie", "number"), F.greatest(F.col("blocks"), F.lit(1))))
        left = left.withColumn("node", node)

        settled = left.filter("open = 0")
        duels = left.filter("open > 0").groupBy("source", "node").applyInPandas(_reducer(seed, level, last), left.schema)
        if last:
            out += [settled, duels]
            break
        duels = write_shared(duels, f"mix-{level}")
        out += [settled, duels.filter("open = 0")]
        left = duels.filter("open > 0").withColumn("blocks", F.ceil(F.col("blocks") / block).cast("long"))
        blocks = -(-blocks // block)
        level += 1
    done = out[0]
    for part in out[1:]:
        done = done.unionByName(part)
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "tie")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix: every document once for each copy taken, with its columns, and size, source_size, target, taken and copy (from 1).

    Where docs has a column of such a name, its own stays and the added one is called mix_<name>. Null and empty texts
    have no words and are not taken; texts of any length count whole; repeated rows are taken one by one, and equal ones
    are interchangeable; an empty table gives no rows. Names that begin with __docloom are reserved.
    """
    nth = F.row_number().over(Window.partitionBy("__docloom_tie", "__docloom_id").orderBy("__docloom_copies"))
    found = mix(docs, **options).filter("copies > 0").select(F.col("tie").alias("__docloom_tie"), F.col("doc_id").alias("__docloom_id"), F.col("copies").alias("__docloom_copies"), *[F.col(c).alias(f"__docloom_{c}") for c in ADDED])
    found = found.withColumn("__docloom_n", nth)
    marked = docs.withColumn("__docloom_tie", F.xxhash64("doc_id", "source", "text")).withColumn("__docloom_id", F.col("doc_id")).withColumn("__docloom_copies", F.lit(0))
    marked = marked.withColumn("__docloom_n", nth).drop("__docloom_copies")
    d, m = F.col("d.__docloom_tie"), F.col("m.__docloom_tie")
    joined = marked.alias("d").join(found.alias("m"), (d == m) & F.col("d.__docloom_id").eqNullSafe(F.col("m.__docloom_id")) & (F.col("d.__docloom_n") == F.col("m.__docloom_n")))
    names = {}
    for c in (*ADDED, "copy"):
        names[c] = c
        while names[c] in docs.columns:
            names[c] = f"mix_{names[c]}"
    own = [F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(*own, *[F.col(f"m.__docloom_{c}").alias(names[c]) for c in ADDED], F.explode(F.sequence(F.lit(1), F.col("m.__docloom_copies").cast("int"))).alias(names["copy"]))
