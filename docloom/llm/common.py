"""Shared pieces: the shared folder, tables written to it, and text batches for Arrow operators."""

from __future__ import annotations

import atexit
import hashlib
import logging
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z only, in str.translate.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
#: Rows of a hot key, hot keys that are broadcast at most, and how fast the bound rises beyond that.
HOT, HOT_KEYS, STEP = 4096, 100_000, 4
DEFAULT_SHARED_DIR = "/tmp/checkpoints/docloom"
#: Rows of an Arrow batch while a shared table is written: texts are long, and batches are held on both sides.
BATCH_ROWS, _BATCH_ROWS = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: dict[int, tuple[DataFrame, str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; where it is unset a local one, for local sessions alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return folder or DEFAULT_SHARED_DIR


def write_shared(df: DataFrame, name: str, compression: str = "zstd", by: str | None = None) -> DataFrame:
    """Cut lineage: write a table to the shared folder (in a folder for each value of `by`), and read it again.

    The files outlive lost executors. They are deleted when the driver ends, or by drop_shared().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
    try:
        out = df.write.option("compression", compression)
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, rows)
    if not _written:
        atexit.register(drop_shared, spark)
    table = spark.read.schema(df.schema).parquet(path)
    _written[id(table)] = (table, path)  # the table is held, so that its id stays its own
    return table


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception as e:  # the session may be gone already; the files are only scratch
        logging.getLogger(__name__).warning("%s stays: %s", path, e)


def discard(*tables: DataFrame) -> None:
    """Delete tables of write_shared() that nothing will read again; other tables are let be."""
    for table in tables:
        if found := _written.pop(id(table), None):
            _delete(table.sparkSession, found[1])


def drop_shared(spark: SparkSession) -> None:
    """Delete all that write_shared() made in this session."""
    while _written:
        _delete(spark, _written.popitem()[1][1])


def hot_bound(table: DataFrame, size: str) -> int | None:
    """Rows of a key above which it is hot: HOT, or so many times more that HOT_KEYS keys at most are above; None if no key is above HOT.

    A key at the bound has STEP / HOT_KEYS of all rows at most, however many keys there are.
    """
    bound, found = HOT, 0
    while (n := table.filter(F.col(size) > bound).limit(HOT_KEYS + 1).count()) > HOT_KEYS:
        bound, found = bound * STEP, n
    return bound if n or found else None


def by_key(rows: DataFrame, table: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join of rows with a table that has one row a key, and in `size` how many rows the key has.

    Keys with over hot_bound() rows would make one task long: they are joined by broadcast, and all others by shuffle.
    Both inputs are read twice.
    """
    bound = hot_bound(table, size)
    if bound is None:
        return rows.join(table, on)
    hot = table.filter(F.col(size) > bound)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.filter(F.col(size) <= bound), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; lower() does so where the text is ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucket_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def chunks(batches: Iterable[pa.RecordBatch], max_chars: int = 1_000_000, columns: tuple[str, ...] = ("doc_id", "text")) -> Iterator[tuple[list, ...]]:
    """Lists of ids and whole texts (null: None), cut so that a chunk has about max_chars; a longer text is a chunk of its own."""
    held: list[list] = [[] for _ in columns]
    at, size = columns.index("text"), 0
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):  # a few rows at a time become Python strings
            part = batch.slice(begin, 256)
            cols = [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
            for row in zip(*cols, strict=True):
                n = len(row[at] or "")
                if size and size + n > max_chars:
                    yield tuple(held)
                    held, size = [[] for _ in columns], 0
                for c, v in zip(held, row, strict=True):
                    c.append(v)
                size += n
    if held[0]:
        yield tuple(held)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
