"""Exact dedup through an extendible-hash index on shared files; DataFrame functions only.

1. Each row makes an entry (doc_id, key, digest), written to the shared folder. The key is a 60-bit hash of
   the normalised text; distinct keys are counted by key prefix.
2. Directory: it begins with one bucket. A bucket that holds more distinct keys than its capacity is split by
   its next key bit; when its local depth is the global depth, the directory doubles. It is an array of 2^g
   bucket numbers, indexed by the first g key bits, and buckets are numbered in key order: each is a key range.
3. Owner tasks: one for each bucket. Rows are dealt by the bucket that the directory names, and the owner groups
   them by whole texts, which compares their bytes; different texts of one key are chained, each with its slot.
   Rows of a hot key are combined before the shuffle, so that the owner gets one row a text and map task.
4. An owner writes the files of its bucket, in a folder of its own (bucket=n). Lookup takes the bucket from the
   directory and walks the key's chain there.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import common
from docloom.llm.common import ascii_lower, by_key, discard, write_shared

KEY_BITS = 60
#: Distinct keys of a bucket; it grows when there would be more than MOST_BUCKETS buckets.
CAPACITY, MOST_BUCKETS = 8192, 1 << 18
#: Rows to drop that keep_rows() broadcasts at most; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def double_directory(cells: dict[int, int], cell_bits: int, capacity: int) -> tuple[int, list[int], list[int]]:
    """(global depth, directory, local depth of each bucket) from key counts by the first cell_bits bits; buckets in key order."""
    order = sorted(cells)
    below = [0, *accumulate(cells[c] for c in order)]

    def keys(prefix: int, depth: int) -> int:
        low, high = (p << cell_bits - depth for p in (prefix, prefix + 1))
        return below[bisect_left(order, high)] - below[bisect_left(order, low)]

    depth, directory, local, prefix, queue = 0, [0], [0], [0], [0]
    while queue:
        b = queue.pop()
        if local[b] >= cell_bits or keys(prefix[b], local[b]) <= capacity:
            continue
        if local[b] == depth:
            depth, directory = depth + 1, [x for x in directory for _ in range(2)]
        new = len(local)
        local[b], prefix[b] = local[b] + 1, prefix[b] * 2
        local.append(local[b])
        prefix.append(prefix[b] + 1)
        span = 1 << depth - local[b]
        directory[prefix[new] * span : (prefix[new] + 1) * span] = [new] * span
        queue += [b, new]
    in_order = sorted(range(len(local)), key=lambda b: prefix[b] << depth - local[b])
    number = {b: i for i, b in enumerate(in_order)}
    return depth, [number[b] for b in directory], [local[b] for b in in_order]


@dataclass(frozen=True)
class Index:
    """The directory, and the shared tables: entries (doc_id, key, text_sha256) and chains (bucket, key, slot, text_sha256, keep_id, group_size)."""

    depth: int
    directory: list[int]
    local: list[int]
    key_bits: int
    entries: DataFrame
    chains: DataFrame

    def bucket(self, key: str = "key") -> Column:
        """The bucket that the directory names for a key."""
        slots = F.split(F.lit(",".join(map(str, self.directory))), ",").cast("array<int>")
        return F.element_at(slots, (F.shiftright(key, self.key_bits - self.depth) if self.depth else F.lit(0)).cast("int") + 1)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows with key and text_sha256, and the keep_id and group_size of their text; a hot text's by broadcast."""
        on = ["bucket", "key", "text_sha256"]
        return by_key(rows.withColumn("bucket", self.bucket()), self.chains.select(*on, "keep_id", "group_size"), on, "group_size").drop("bucket")


def digests(docs: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """norm, text_sha256 and key added to doc_id."""
    docs = docs.select("doc_id", ascii_lower(F.col("text")).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    return docs.withColumn("key", F.shiftright(F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("bigint"), KEY_BITS - key_bits))


def build_index(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> Index:
    """The index of all rows. key_bits below 60 shortens the key (tests: collisions)."""
    docs = digests(docs, key_bits)
    entries = write_shared(docs.select("doc_id", "key", "text_sha256"), "entries")
    keys = write_shared(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    total = keys.count()
    capacity = max(capacity, -(-total // MOST_BUCKETS))
    cell_bits = min(key_bits, max(1, -(-total // capacity)).bit_length() + 3)
    while True:  # 8 to 16 cells a bucket; more only if one cell is overfull
        counts = keys.groupBy(F.shiftright("key", key_bits - cell_bits).alias("cell")).count().collect()
        cells = {r["cell"]: r["count"] for r in counts}
        if cell_bits == key_bits or max(cells.values(), default=0) <= capacity:
            break
        cell_bits = min(key_bits, cell_bits + 2)
    index = Index(*double_directory(cells, cell_bits, capacity), key_bits, entries, entries)

    rows, buckets = docs.withColumn("bucket", index.bucket()), len(index.local)
    grouped = lambda df: df.groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    bound = common.hot_bound(keys, "n")
    if bound is not None:
        hot = keys.filter(F.col("n") > bound).select("key")
        cold = rows.join(F.broadcast(hot), "key", "left_anti")
        groups = grouped(cold.repartitionById(buckets, "bucket")).unionByName(grouped(rows.join(F.broadcast(hot), "key", "left_semi")))
    else:
        groups = grouped(rows.repartitionById(buckets, "bucket"))
    slot = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256")) - 1
    chains = write_shared(groups.repartitionById(buckets, "bucket").withColumn("slot", slot), "index", by="bucket")
    discard(keys)
    return Index(index.depth, index.directory, index.local, key_bits, entries, chains)


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and so equals "". Texts of any
    length are compared whole. The row with the largest doc_id of a group stays. Null ids lose to any other; if
    all are null, keep_id is null and kept is true. Rows repeated with one doc_id (ties) count one by one in
    group_size and share their flag; keep_rows() leaves one of them. An empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    index = build_index(docs, capacity, key_bits)
    return index.lookup(index.entries).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with all their columns and names.

    As exact_groups(): null texts equal empty ones. Of rows repeated with one doc_id and text one stays, the first by
    its other columns. An empty table gives no rows. Names that begin with __docloom are reserved.
    """
    by = exact_groups(docs, **options).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept"))
    odd = write_shared(by.filter("NOT kept OR n > 1").select(F.col("doc_id").alias("__docloom_id"), F.unhex("text_sha256").alias("__docloom_digest"), F.col("kept").alias("__docloom_kept")), "odd")
    few = F.broadcast if odd.count() <= BROADCAST_ROWS else lambda df: df
    marked = docs.withColumn("__docloom_sha", F.unhex(F.sha2(ascii_lower(F.col("text")), 256)))
    same = F.col("doc_id").eqNullSafe(F.col("__docloom_id")) & (F.col("__docloom_sha") == F.col("__docloom_digest"))
    single = marked.join(few(odd), same, "left_anti").select(docs.columns)
    first = F.row_number().over(Window.partitionBy("doc_id", "__docloom_sha").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    repeated = marked.join(few(odd.filter("__docloom_kept")), same, "left_semi").withColumn("__docloom_n", first).filter("__docloom_n = 1").select(docs.columns)
    return single.unionByName(repeated)
