"""Merkle dataset manifest by postorder recursive traversal of blocks.

A row is a leaf. Leaves of a tree (a language) are numbered in order without a gather: rows are dealt by range,
numbered within their range, and moved up by the counts of the ranges before. FAN ** LEVELS consecutive leaves,
aligned, make a block, whose task visits its subtree in postorder: a visit returns the digest of a subtree and, while it
unwinds, appends the digests of a child's siblings to every leaf below that child. The roots of blocks are the
leaves of the next traversal, until one block is left. On the way back each leaf's siblings are followed by those
of its block. The roots of the trees make one more tree in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, by_key, sha256_hex, write_shared

FAN = 8
#: Levels of a block; it has FAN ** LEVELS leaves.
LEVELS = 3
#: Rows of block roots, or of trees, that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 50_000
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(digests: bytes) -> bytes:
    """The digest of nodes whose digests stand one after the other: sha256 over their hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def encoded(column: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, `:` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a row, with `text` in place of its text."""
    return F.unhex(F.sha2(F.concat(*[encoded(text if c == "text" else F.col(f"`{c}`")) for c in fields]), 256))


def tampered() -> Column:
    """Whether 3 divides the crc32 of the id as decimal text; null ids are left alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        nth = []
        for tree in batch.column(batch.schema.get_field_index("tree")).to_pylist():
            seen[tree] = seen.get(tree, -1) + 1
            nth.append(seen[tree])
        cols = [*batch.columns, pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "part", "nth"])


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rank (from 0, by order) and size of its tree for every row of a written table; equal rows get ranks of their own.

    A range of rows that are all equal is split by the place of its rows in the table, so that no key is hot.
    """
    keys = ["tree", *order, "__place"]
    dealt = rows.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__place")
    held = write_shared(dealt.mapInArrow(_number, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", part int, nth long"), "ranked")
    counts = held.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each tree of a range
    own = Window.partitionBy("tree")
    counts = counts.select("tree", "part", (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("size"))
    counts = write_shared(counts, "offsets")
    return held.join(_few(counts), ["tree", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def _few(table: DataFrame) -> DataFrame:
    """A written table marked for broadcast, if its rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def traverse(digests: list[bytes], height: int) -> tuple[bytes, list[bytes]]:
    """(root, siblings of each leaf, lowest level first) of a subtree of `height` levels."""
    paths: list[list[bytes]] = [[] for _ in digests]

    def visit(begin: int, level: int) -> bytes:
        if level == 0:
            return digests[begin]
        wide = FAN ** (level - 1)
        starts = range(begin, min(begin + FAN * wide, len(digests)), wide)
        children = [visit(s, level - 1) for s in starts]
        for i, s in enumerate(starts):  # unwinding: what stands beside a child goes to the leaves below it
            rest = b"".join(children[:i] + children[i + 1 :])
            for path in paths[s : s + wide]:
                path.append(rest)
        return joined_hash(b"".join(children))

    return visit(0, height), [b"".join(p) for p in paths]


def height_of(size: int) -> int:
    """Levels over `size` leaves: none over one."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def _block(levels: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("rank").to_numpy(), kind="stable")))
        size = table.column("size")[0].as_py()
        top, siblings = traverse(table.column("digest").to_pylist(), levels if size > FAN**levels else height_of(size))
        return table.append_column("siblings", pa.array(siblings, pa.binary())).append_column("top", pa.array([top] * len(siblings), pa.binary()))

    return run


def proved(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves (tree, rank, size, digest and other columns) with proof (siblings up to the root, digests one after the other) and root."""
    wide = FAN**levels
    blocks = nodes.withColumn("block", F.expr(f"rank div {wide}"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema) + ", siblings binary, top binary"
    done = write_shared(blocks.groupBy("tree", "block").applyInArrow(_block(levels), schema), "blocks", "none")  # digests don't compress
    own = [F.col(c) for c in nodes.columns]
    roots = done.filter(F.col("rank") % wide == 0).select("tree", F.col("block").alias("rank"), F.expr(f"(size + {wide - 1}) div {wide}").alias("size"), F.col("top").alias("digest"))
    higher = roots.filter("size > 1")
    if higher.isEmpty():
        return done.select(*own, F.col("siblings").alias("proof"), F.col("top").alias("root"))
    upper = proved(higher, levels).select("tree", F.col("rank").alias("block"), "proof", "root")
    upper = write_shared(upper, "upper", "none")
    met = done.join(_few(upper), ["tree", "block"], "left")  # at most `wide` rows a key
    return met.select(*own, F.concat("siblings", F.coalesce("proof", F.lit(b""))).alias("proof"), F.coalesce("root", "top").alias("root"))


def fold(digest: bytes, rank: int, size: int, proof: bytes) -> bytes:
    """The root that a leaf's digest and its siblings lead to."""
    at = 0
    while size > 1:
        place = rank % FAN
        others = min(FAN, size - (rank - place)) - 1
        run = proof[at : at + others * DIGEST]
        digest = joined_hash(run[: place * DIGEST] + digest + run[place * DIGEST :])
        at, rank, size = at + others * DIGEST, rank // FAN, -(-size // FAN)
    return digest


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", levels: int = LEVELS) -> DataFrame:
    """One row for each document: doc_id, leaf, tampered_leaf (null: not tampered with), rank and size in its tree, proof, subroot, tree_rank, trees, tree_proof, root.

    Digests are binary; proofs are digests one after the other. Rows of a tree stand by doc_id, nulls first, then by
    digest, so that ties and repeated rows have a defined place (equal ones are interchangeable). Any field may be
    null; an empty text is not a null one. Texts of any length are hashed whole in the scan and go no further. An
    empty table gives no rows. Columns other than `fields` are not part of a leaf, whatever their names.
    """
    text = F.col("text")
    change = F.when(text.isNotNull(), ascii_lower(text))
    named = F.coalesce(F.concat(F.lit("v"), F.col(f"`{tree}`").cast("string")), F.lit("n"))  # null first
    rows = docs.select("doc_id", named.alias("tree"), leaf(text, fields).alias("digest"), F.when(tampered(), leaf(change, fields)).alias("tampered_leaf"))
    rows = ranked(write_shared(rows, "leaves", "none"), F.col("doc_id").asc_nulls_first(), F.col("digest"))
    rows = proved(rows, levels).withColumnRenamed("root", "subroot")
    rows = write_shared(rows, "proofs", "none")
    roots = write_shared(rows.filter("rank = 0").select("tree", F.col("size").alias("rows"), F.col("subroot").alias("digest")), "subroots", "none")
    order = roots.select(F.lit("").alias("tree"), F.col("tree").alias("named"), "rows", "digest")
    upper = proved(ranked(order, F.col("named")), levels).select(F.col("named").alias("tree"), F.col("rank").alias("tree_rank"), F.col("size").alias("trees"), F.col("proof").alias("tree_proof"), "root", "rows")
    upper = write_shared(upper, "trees", "none")
    met = rows.join(F.broadcast(upper), "tree") if upper.count() <= BROADCAST_ROWS else by_key(rows, upper, ["tree"], "rows")
    return met.select("doc_id", F.col("digest").alias("leaf"), "tampered_leaf", "rank", "size", "proof", "subroot", "tree_rank", "trees", "tree_proof", "root")


def _checked(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["leaf", "tampered_leaf", "rank", "size", "proof", "subroot", "tree_rank", "trees", "tree_proof", "root"]
        for batch in batches:
            out: list[tuple] = []
            for own, changed, rank, size, proof, subroot, tree_rank, trees, tree_proof, root in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names], strict=True):
                folded = fold(fold(changed or own, rank, size, proof), tree_rank, trees, tree_proof)
                out.append((own.hex(), subroot.hex(), root.hex(), sha256_hex((proof + tree_proof).hex()), folded.hex(), folded == root))
            cols = list(zip(*out, strict=True)) or [()] * 6
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(id_type)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.string()) for c in cols[:5]], pa.array(cols[5], pa.bool_())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def verified(entries: DataFrame) -> DataFrame:
    """Of manifest() rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests in hex.

    folded_root is what the leaf, the tampered one where there is one, and its siblings lead to.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = entries.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return entries.mapInArrow(_checked(to_arrow_type(kind)), schema)
