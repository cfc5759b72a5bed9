"""Jaccard join on 5-word shingles through signature trees.

1. Signatures: each document's set of shingle hashes, its size, a bitmap of the set and a digest. Equal
   sets become one class, and only its representative goes on.
2. Forest: two sets with Jaccard >= 3/4 share one of the first n // 4 + 1 shingles of each in any common
   order, so the sets that have a shingle there are the leaves of one tree. Frequent shingles come last in
   the order, and the tree of one is known before any list is made; the order changes the work, never the
   result. Trees with one smallest member are one; a list of two sets is a pair of leaves.
3. Dual traversal: each signature tree is traversed with itself. Its nodes hold the OR of the bitmaps, size
   ranges and the common component. Node pairs are dropped by size, by the maximum possible overlap, or when
   they are one component; the leaf pairs that are left are the candidates. A tree with few of them sends
   all. A dense tree, such as a group of near copies, sends the best spanning forest of its candidates, so
   that work stays linear; a large one is first dealt out in blocks that a few common members join.
4. Candidates are verified against the whole sets, rebuilt from the texts, and linked sets become components.
   Dense trees that still span several components are traversed again, with their components as labels; the
   last traversal sends every candidate between different components, so that no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import by_key, chunks, discard, write_shared
from docloom.llm.graph import components, merged

SHINGLE = 5
BITS = 1024
#: Members of a tree that one task may hold for a dual traversal.
BLOCK = 1024
FANOUT = 8
#: Trees of so many members are compared pair by pair first, by size alone.
SMALL = 48
#: A tree with more candidates for a member is dense: it sends a spanning forest, in FORESTS rounds at most, as long
#: as one finds FOUND links. CENTERS members of a large tree are in all its blocks.
DENSE, FORESTS, FOUND, CENTERS = 4, 3, 20, 4
#: A shingle that two documents of a chunk of text have counts as many there; those with LATE in all go to the end of
#: the order, ORDER_ROWS of them at most.
FREQUENT, LATE, FREQUENT_CHARS, ORDER_ROWS = 2, 8, 10_000_000, 200_000
#: Characters that are hashed at once.
PART_CHARS = 1_000_000
#: Ids that may be broadcast to pick the texts to verify; beyond it the join is shuffled.
BROADCAST_IDS = 2_000_000
#: 64-bit constants of the hashes: one for each byte (A-Z as a-z), and odd multipliers.
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_ODD = _random.integers(1, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[6]
    h = (h ^ (h >> np.uint64(29))) * _ODD[7]
    return h ^ (h >> np.uint64(32))


def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word [^\\x20\\x09-\\x0D]+ in turn, with A-Z as a-z; how many words each text has)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    word = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    size = ends - starts
    place = np.arange(size.sum(), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(size.max()) - 1, _ODD[5])))
    values = _BYTE[data[word]] * power[place]
    return _mixed(np.add.reduceat(values, np.cumsum(size) - size) + size.astype(np.uint64)), counts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: all its words where there are fewer than five, none for no words."""
    word, counts = _word_hashes(texts)
    none = np.zeros(0, np.uint64)
    h = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE if len(h) else 0):
        h += word[k : k + len(h)] * _ODD[k]
    h = _mixed(h)
    out, begin = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(h[begin : begin + n - SHINGLE + 1]))
        elif n:
            out.append(_mixed((word[begin : begin + n] * _ODD[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(none)
        begin += n
    return out


def _parts(texts: list[str | None], most: int = PART_CHARS) -> Iterator[slice]:
    """Slices of about `most` characters; a longer text is one of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequent shingles, their places in the common order, the smallest document known to have each); bounded arrays."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, FREQUENT_CHARS):
            rows = sorted((i, t) for i, t in zip(ids, texts, strict=True) if t)
            texts = [t for _, t in rows]
            found = [s for part in _parts(texts) for s in shingle_sets(texts[part])]
            if found:
                token, at, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
                keep = n >= FREQUENT
                first = np.array([i for i, _ in rows], np.int64)[np.searchsorted(np.cumsum([len(s) for s in found]), at[keep], side="right")]
                yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(n[keep]), pa.array(first)], ["token", "n", "first"])

    seen = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "token long, n long, first long")
    rows = seen.groupBy("token").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter(F.col("n") >= LATE).orderBy(F.desc("n"), "token").limit(ORDER_ROWS).toArrow()
    token, first = rows.column("token").to_numpy()[::-1].view(np.uint64), rows.column("first").to_numpy()[::-1]
    ordered = np.argsort(token)
    return token[ordered], ordered, first[ordered]


def _ordered(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n // 4 + 1 shingles in the common order: those that aren't frequent, and the trees of those that are."""
    n = len(tokens) // 4 + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        late = frequent[at] == tokens
        if late.any():
            rare = tokens[~late][:n]
            return rare, np.unique(first[at[late][np.argsort(rank[at[late]], kind="stable")][: n - len(rare)]])
    return tokens[:n], np.zeros(0, np.int64)


def bitmap(tokens: np.ndarray) -> bytes:
    """Bits of the set by the low bits of its hashes: 4 to 8 a shingle, a power of two, BITS at least."""
    size = max(BITS, 1 << max(0, 4 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of different lengths as rows of `size` bytes, the shortest length among them."""
    rows = []
    for b in bitmaps:
        row = np.frombuffer(b, np.uint8)
        while len(row) > size:
            row = row[: len(row) // 2] | row[len(row) // 2 :]
        rows.append(row)
    return np.stack(rows).view(np.uint64)


def signatures(docs: DataFrame) -> tuple[DataFrame, str]:
    """(doc_id, n_shingles, digest, bits, prefix and trees of every document as a shared table; the type of doc_id)."""
    table = docs.sparkSession.sparkContext.broadcast(_frequent(docs))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def lists(found: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(p) for p in found])).astype(np.int32)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks(batches, PART_CHARS):
            sets = shingle_sets(texts)
            first = [_ordered(s, *table.value) if len(s) else (s, np.zeros(0, np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()), lists([p.view(np.int64) for p, _ in first]), lists([t for _, t in first])],
                ["doc_id", "n_shingles", "digest", "bits", "prefix", "trees"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bits binary, prefix array<long>, trees array<long>")
    return write_shared(rows, "signatures", "lz4"), id_type


def _can_link(sizes_a, sizes_b, bits_a: np.ndarray, bits_b: np.ndarray, loss_a, loss_b) -> tuple[np.ndarray, np.ndarray]:
    """(whether the maximum possible overlap reaches 3/7 of the sizes, the overlap) for rows of two tables: sizes are (low, high)."""
    (low_a, high_a), (low_b, high_b) = sizes_a, sizes_b
    ok = (3 * low_a <= 4 * high_b) & (3 * low_b <= 4 * high_a)
    shared = np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(high_a, high_b), shared + np.minimum(loss_a, loss_b))
    return ok & (7 * most >= 3 * (low_a + low_b)), most


class Tree:
    """A signature tree over sets: levels of nodes, each with OR-ed bits, a size range, the most bits lost and its component (-1: several)."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, labels: np.ndarray, fanout: int = FANOUT) -> None:
        self.order, self.fanout = np.lexsort((sizes, labels)), fanout
        size = sizes[self.order]
        loss = size - np.bitwise_count(bits[self.order]).sum(axis=1, dtype=np.int64)
        self.levels = [(size, size, bits[self.order], loss, labels[self.order])]
        while len(self.levels[-1][0]) > 1:
            low, high, b, loss, label = self.levels[-1]
            at = np.arange(0, len(low), fanout)
            first, last = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(b, at, axis=0), np.maximum.reduceat(loss, at), np.where(first == last, first, -1)))

    def pairs(self, slab: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Dual traversal of the tree with itself: places (i, j) of sets of different components that may link, and what they share at most."""
        top = len(self.levels) - 1
        stack = [(top, np.array([[0, 0]]))]
        while stack:
            level, nodes = stack.pop()
            if len(nodes) > slab:
                stack += [(level, nodes[at : at + slab]) for at in range(0, len(nodes), slab)]
                continue
            low, high, bits, loss, label = self.levels[level]
            a, b = nodes.T
            same = (label[a] == label[b]) & (label[a] >= 0)
            a, b = a[~same], b[~same]
            ok, most = _can_link((low[a], high[a]), (low[b], high[b]), bits[a], bits[b], loss[a], loss[b])
            a, b = a[ok], b[ok]
            if level == 0:
                if len(a):
                    yield self.order[a], self.order[b], most[ok] / (low[a] + low[b])
                continue
            n, k = len(self.levels[level - 1][0]), self.fanout
            x = (a[:, None] * k + np.repeat(np.arange(k), k)).ravel()
            y = (b[:, None] * k + np.tile(np.arange(k), k)).ravel()
            keep = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
            if keep.any():
                stack.append((level - 1, np.column_stack([x[keep], y[keep]])))


def _verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose whole sets link, as a shared table."""
    ids = write_shared(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(chosen, "id", "left_semi")
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            both = [batch.column(batch.schema.get_field_index(c)) for c in ("text_a", "text_b")]
            sizes = np.maximum(pa.compute.binary_length(both[0]).to_numpy(zero_copy_only=False), pa.compute.binary_length(both[1]).to_numpy(zero_copy_only=False))
            turn = np.append(0, np.flatnonzero(np.diff(np.cumsum(sizes) // (PART_CHARS // 2))) + 1)
            for at, end in zip(turn, np.append(turn[1:], batch.num_rows), strict=True):
                part = batch.slice(int(at), int(end - at))
                if not part.num_rows:
                    continue
                a, b, ta, tb = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "text_a", "text_b"))
                held = {i: s for i, s in held.items() if i in a[:1]}
                need = {i: t for i, t in zip(a + b, ta + tb, strict=True) if i not in held}
                held |= dict(zip(need, shingle_sets(list(need.values())), strict=True))
                links = []
                for x, y in zip(a, b, strict=True):
                    sx, sy = held[x], held[y]
                    both = len(np.intersect1d(sx, sy, assume_unique=True))
                    links.append(both > 0 and 100 * both >= 75 * (len(sx) + len(sy) - both))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(links, pa.bool_()))

    links = write_shared(both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "links")
    discard(ids)
    return links


def _may_link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes leave, and then bitmaps; bitmaps are joined to the former alone."""
    sizes = lambda c: sets.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"))
    bits = lambda c: sets.select(F.col("rep").alias(c), F.col("bits").alias(f"bits_{c}"))
    near = pairs.join(sizes("a"), "a").join(sizes("b"), "b").filter("3 * n_a <= 4 * n_b AND 3 * n_b <= 4 * n_a")
    near = near.join(bits("a"), "a").join(bits("b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("a", "b", "n_a", "n_b"))
            every = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bits_a", "bits_b")]
            size, ok = np.array([min(len(x), len(y)) for x, y in zip(*every, strict=True)], np.int64), np.zeros(len(a), bool)
            for width in np.unique(size):
                own = np.flatnonzero(size == width)
                ba, bb = (folded([col[i] for i in own], int(width)) for col in every)
                loss = [n[own] - np.bitwise_count(x).sum(axis=1, dtype=np.int64) for n, x in ((na, ba), (nb, bb))]
                ok[own] = _can_link((na[own], na[own]), (nb[own], nb[own]), ba, bb, *loss)[0]
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return near.mapInArrow(check, "a long, b long")


def tree_pairs(sizes: np.ndarray, bitmaps: list[bytes], labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) of sets of different components that may link, and a score, by trees over neighbouring size classes.

    Bitmaps grow with the sets, so that classes keep them alike in length. Linked sets are in one class or in
    neighbouring ones; a pair within a class may be given twice.
    """
    if len(sizes) <= SMALL:
        i, j = np.triu_indices(len(sizes), 1)
        near = (labels[i] != labels[j]) & (3 * sizes[i] <= 4 * sizes[j]) & (3 * sizes[j] <= 4 * sizes[i])
        if not near.any():
            return
    group = np.floor(np.log(sizes) / math.log(4 / 3)).astype(np.int64)
    for g in np.unique(group):
        own = np.flatnonzero((group == g) | (group == g + 1))
        if len(own) > 1 and (labels[own] != labels[own[0]]).any():
            width = min(len(bitmaps[i]) for i in own)
            for i, j, score in Tree(sizes[own], folded([bitmaps[i] for i in own], width), labels[own]).pairs():
                yield own[i], own[j], score


def spanning(labels: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Indexes of the candidates (i, j) of a spanning forest over the components: each component's best candidate, in turn."""
    parent = np.unique(labels, return_inverse=True)[1]
    chosen, left = [], np.arange(len(i))
    while len(left):
        a, b = parent[i[left]], parent[j[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            break
        ends, edge = np.concatenate([a, b]), np.concatenate([left, left])
        order = np.lexsort((edge, -score[edge], ends))
        best = np.unique(edge[order][np.append(True, ends[order][1:] != ends[order][:-1])])
        chosen.append(best)
        up = np.arange(parent.max() + 1)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(parent[i[best]].tolist(), parent[j[best]].tolist(), strict=True):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
        parent = np.array([root(x) for x in range(len(up))])[parent]
    return np.sort(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def _traverse(members: DataFrame, sets: DataFrame, block: int, forest: int | None) -> DataFrame:
    """Candidates (a, b) from members (pivot, rep, n, label), and rows (pivot) of the trees that didn't send all, by dual traversal.

    With forest (the number of the round) dense trees send a spanning forest alone, and large trees are dealt out
    in blocks by hash, with CENTERS members in all of them. Without, every candidate between different components is
    sent: a large tree is dealt out in pairs of blocks by size class, but for pairs within its largest component.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3)).cast("int")
    members = members.withColumn("g", size_class)
    by_label = members.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("count"))
    most = by_label.groupBy("pivot").agg(F.sum("count").alias("size"), F.max_by("label", "count").alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    most = write_shared(most, "trees")
    if forest is not None:
        picks = [F.min_by("rep", F.xxhash64(F.lit(CENTERS * forest + i), "rep")) for i in range(CENTERS)]
        centers = members.groupBy("pivot").agg(F.array_distinct(F.array(*picks)).alias("centers"))
        near = by_key(members, write_shared(most.join(centers, "pivot"), "plan"), ["pivot"], "size")
        blocks = F.ceil(F.col("size") / block).cast("int")
        own = F.array(F.pmod(F.xxhash64(F.lit(forest), "rep"), blocks).cast("int"))
        at = F.when(F.array_contains("centers", F.col("rep")), F.sequence(F.lit(0), blocks - 1)).otherwise(own)
        tree = F.when(F.col("size") <= block, F.array(F.xxhash64("pivot"))).otherwise(F.transform(at, lambda s: F.xxhash64("pivot", s)))
    else:
        counts = members.join(most.select("pivot", "main"), "pivot").groupBy("pivot", "g").agg(*[F.ceil(F.count(F.when(c, 1)) / block).cast("int").alias(k) for c, k in ((F.col("label") == F.col("main"), "m"), (F.col("label") != F.col("main"), "o"))])
        plan = counts.groupBy("pivot").agg(F.map_from_entries(F.collect_list(F.struct("g", F.struct("m", "o")))).alias("k"))  # a row for each size class
        near = by_key(members, write_shared(most.join(plan, "pivot"), "plan"), ["pivot"], "size")
        is_main, g = F.col("label") == F.col("main"), F.col("g")
        blocks = F.when(is_main, F.col("k")[g]["m"]).otherwise(F.col("k")[g]["o"])
        s = F.pmod(F.xxhash64("rep"), blocks).cast("int")

        def met(step: int, part: str, name: str, mine_first: bool):
            """Keys of this row's block with each block of a part of a size class, this one or another."""
            n = F.coalesce(F.element_at("k", g + step)[part], F.lit(0))
            there = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda t: F.struct((g + step).alias("g"), t.alias("s")))
            here = F.struct(g.alias("g"), s.alias("s"))
            if name == "o" and not step:  # a block meets the blocks of its own part and class once
                return F.transform(there, lambda t: F.xxhash64("pivot", F.lit(name), F.least(here, t), F.greatest(here, t)))
            return F.transform(there, lambda t: F.xxhash64("pivot", F.lit(name), here, t) if mine_first else F.xxhash64("pivot", F.lit(name), t, here))

        rest = [met(step, "o", "o", step > 0) for step in (-1, 0, 1)] + [met(step, "m", "m", True) for step in (-1, 0, 1)]
        main = [met(step, "o", "m", False) for step in (-1, 0, 1)]
        tree = F.when(F.col("size") <= block, F.array(F.xxhash64("pivot"))).otherwise(F.when(is_main, F.concat(*main)).otherwise(F.concat(*rest)))
    dealt = near.select("pivot", "rep", "n", "label", (F.col("size") > block).alias("cut"), tree.alias("tree")).join(sets.select("rep", "bits"), "rep")
    rows = dealt.select(F.explode("tree").alias("tree"), "pivot", "rep", "n", "label", "cut", "bits")
    rows = rows.repartition("tree").sortWithinPartitions("tree")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def sent(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(x), pa.int64())], ["a", "b", "pivot"])

        def trees(table: pa.Table) -> Iterator[pa.RecordBatch]:
            tree, pivot, rep, n, label = (table.column(c).to_numpy() for c in ("tree", "pivot", "rep", "n", "label"))
            cut, bits = table.column("cut").to_numpy(), table.column("bits").to_pylist()
            cuts = np.append(np.flatnonzero(np.append(True, tree[1:] != tree[:-1])), len(tree))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                found, open_ = [], bool(cut[lo])
                if hi - lo > 1 and (label[lo:hi] != label[lo]).any():
                    for i, j, score in tree_pairs(n[lo:hi], bits[lo:hi], label[lo:hi]):
                        if forest is None:
                            yield sent(rep[lo:hi][i], rep[lo:hi][j])
                        else:
                            found.append((i, j, score))
                if found:
                    i, j, score = map(np.concatenate, zip(*found, strict=True))
                    if len(i) > DENSE * (hi - lo):
                        open_ = True
                        # after the first round any candidate will do, as the best have been tried
                        edges = spanning(label[lo:hi], i, j, score if forest == 0 else np.random.default_rng(forest).random(len(i)))
                        i, j = i[edges], j[edges]
                    yield sent(rep[lo:hi][i], rep[lo:hi][j])
                if open_ and forest is not None:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array(pivot[lo : lo + 1])], ["a", "b", "pivot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            tree = batch.column(0).to_numpy()
            if tree[-1] == held[0].column(0)[0].as_py():
                continue  # one tree so far
            table = pa.Table.from_batches(held)
            cut = len(table) - int((tree == tree[-1]).sum())
            yield from trees(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from trees(pa.Table.from_batches(held))

    return rows.mapInArrow(walk, "a long, b long, pivot long")


def similar_components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A & B| >= 75 * |A | B| over their distinct shingles; component_id is the
    smallest doc_id reachable. Null and empty texts, and texts of blanks, have 0 shingles and link with
    nothing: component_id is their own doc_id. doc_id must be an integer and name one text; repeated rows
    give a row each. Rows with a null doc_id link by equal sets only. Texts of any length are compared whole;
    ties have no choice to make, as a link is symmetric and the smallest id is one. Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    sig, id_type = signatures(docs)
    classes = write_shared(sig.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    class_of = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "digest").join(classes, "digest").select("doc_id", "rep").distinct()
    class_of = write_shared(class_of, "class-of")
    # rare shingles alone are listed here: no list holds more than a few documents of each chunk of text
    routed = sig.filter("doc_id IS NOT NULL").select(F.explode("prefix").alias("token"), F.col("doc_id").alias("doc"))
    w = Window.partitionBy("token")
    lists = routed.select("doc", F.min("doc").over(w).alias("first"), F.max("doc").over(w).alias("last"), F.count(F.lit(1)).over(w).alias("count")).filter("first <> last")
    lists = lists.groupBy("first", "doc").agg(F.max("count").alias("count"))
    frequent = sig.filter("doc_id IS NOT NULL").select(F.explode("trees").alias("first"), F.col("doc_id").alias("doc"), F.lit(1 << 40).alias("count"))
    # copies give way to their representative; trees of one smallest member are one
    reps = lists.unionByName(frequent).join(class_of.select(F.col("doc_id").alias("doc"), "rep"), "doc").select("first", "rep", "count")
    members = reps.join(class_of.select(F.col("doc_id").alias("first"), F.col("rep").alias("pivot")), "first").groupBy("pivot", "rep").agg(F.max("count").alias("count"))
    routes = write_shared(members, "routes")
    chosen = routes.select("rep").union(routes.select("pivot")).distinct()
    sets = write_shared(sig.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bits").join(chosen, "rep", "left_semi").dropDuplicates(["rep"]), "sets", "lz4")
    members = write_shared(routes.filter("count > 2").select("pivot", "rep").join(sets.select("rep", "n"), "rep"), "members")
    leaves = routes.filter("count = 2 AND rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))

    labels, forest = None, 0
    while True:
        found = write_shared(_traverse(_labelled(members, labels), sets, block, forest), "found")
        pairs = found.filter("a IS NOT NULL").select("a", "b")
        pairs = write_shared((pairs if forest != 0 else pairs.unionByName(_may_link(leaves, sets))).distinct(), "pairs")
        links = _verify(docs, pairs)
        labels = components(links) if forest == 0 else merged(labels, links)
        unfinished = write_shared(found.filter("pivot IS NOT NULL").select("pivot").distinct(), "unfinished")
        if unfinished.isEmpty():
            break
        left = write_shared(members.join(unfinished, "pivot", "left_semi"), "members")
        forest = forest + 1 if forest + 1 < FORESTS and (forest == 0 or links.count() >= FOUND) else None
        discard(members, found, pairs, links, unfinished)
        members = left
    discard(routes, members, sets, class_of, found, pairs, links)

    by_class = classes.join(labels, classes.rep == labels.id, "left").select("digest", F.coalesce("label", "rep").alias("component"))
    out = sig.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    return out.select(F.col("doc_id").cast(id_type).alias("doc_id"), "n_shingles", F.coalesce("component", "doc_id").cast(id_type).alias("component_id"))


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (pivot, rep, n, label) with their components; before any is known, each is its own."""
    if labels is None:
        return members.select("pivot", "rep", "n", F.col("rep").alias("label"))
    return members.join(labels, members.rep == labels.id, "left").select("pivot", "rep", "n", F.coalesce("label", "rep").alias("label"))


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id of each component, with all its columns; documents without shingles stay.

    Rows with a null doc_id stay; repeated rows of the document that stays all stay. An empty table gives no rows.
    Columns of docs keep their names and values, whatever they are.
    """
    found = similar_components(docs, **options).filter("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("__docloom_id")).distinct()
    return docs.alias("d").join(found, F.col("d.doc_id").eqNullSafe(F.col("__docloom_id")), "left_semi")
