"""The store: record sets as a base and later deltas, under versions that a manifest commits.

A write adds one delta: its rows, sorted, in buckets, and what it replaces (whole documents, or rows by key). Nothing
that is written is changed later. A version is a manifest file that lists the deltas of every record set in order; it is
created under the next number or not at all, so that a write that is killed leaves the version before it, and a
reader keeps the version that it began with. A read merges: rows that a later delta replaces go. compact() makes one base
of a record set's deltas, in a job of its own, and vacuum() deletes what no kept version lists.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import xxhash
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new store; an existing one keeps its number.
BUCKETS = 64
#: Deltas of a record set that streams let stand before they compact it.
MOST_DELTAS = 16
#: Seconds after which a version that isn't whole counts as given up.
GRACE_S = 10.0


def _schema(**columns: str) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


#: Record sets and their columns; the document of a conversation is its id.
SCHEMAS = {
    "pages": _schema(page_number="int", location="string", text="string", author="string", segment_type="string", document_id="string"),
    "documents": _schema(filename="string", file_type="string", document_type="string", year="int", quarter="string", report_period="string", total_pages="int", total_words="long", total_chars="long", upload_date="timestamp", document_id="string"),
    "tables": _schema(table_id="string", page_number="int", heading="string", extraction_method="string", extraction_confidence="double", document_id="string"),
    "cells": _schema(table_id="string", row_index="int", col_index="int", header="string", value="string", document_id="string"),
    "chunks": _schema(id="string", collection="string", chunk_type="string", page="int", section="string", text="string", dense="array<float>", document_type="string", year="int", document_id="string"),
    "points": _schema(id="string", node_type="string", hierarchy_path="array<string>", hierarchy_path_text="string", node_key="string", node_value="string", value_type="string", root_section="string", parent_key="string", row_entity="string", column_attribute="string", depth="int", sibling_ordinal="int", field_labels="array<string>", entity_labels="array<string>", section_labels="array<string>", dense="array<float>", document_type="string", year="int", quarter="string", report_period="string", document_id="string"),
    "facts": _schema(source_type="string", page_number="int", position="int", field="string", label="string", value="string", value_state="string", confidence="double", document_id="string"),
    "contents": _schema(serial_number="int", section_original="string", section_normalized="string", section_item_index="int", title_original="string", title_normalized="string", title_roman="string", author_original="string", author_list="array<string>", page_number="int", type="string", article_id="string", dense="array<float>", document_id="string"),
    "records": _schema(table_id="string", row_index="int", period="string", section_no="string", section="string", region="string", region_header="string", metric="string", metric_short="string", metric_key="string", raw_value="string", value="double", is_percent="boolean", aggregation_group="string", document_id="string"),
    "terms": _schema(key="string", canonical="string", category="string", english="array<string>", hindi="array<string>", roman="array<string>", occurrences="long", source_chunk_ids="array<string>", contexts="array<string>", document_id="string"),
    "conversations": _schema(article_id="string", turn="long", seen="timestamp", document_id="string"),
    "postings": _schema(collection="string", token="string", block="int", id="string", tf="int", dl="int", document_id="string"),
    "maxima": _schema(collection="string", token="string", block="int", tf="int", dl="int", document_id="string"),
    "forward": _schema(collection="string", id="string", length="long", tokens="array<string>", tfs="array<int>", document_id="string"),
    "statistics": _schema(collection="string", token="string", df="long", texts="long", length="long", document_id="string"),
    "centres": _schema(cell="int", vector="array<double>", document_id="string"),
    "reach": _schema(cell="string", near="double", document_id="string"),
    **{f"cells_{c}": _schema(cell="string", id="string", dense="array<float>", document_id="string", near="double") for c in ("index", "content", "table", "hierarchical", "titles")},
}
#: What names one row of a record set within a document.
KEYS = {
    "pages": ["page_number"], "documents": [], "tables": ["table_id"], "cells": ["table_id", "row_index", "col_index"], "chunks": ["id"], "points": ["id"], "facts": ["page_number", "position", "field"],
    "contents": ["article_id", "title_normalized"], "records": ["table_id", "row_index", "metric_key", "region"], "terms": ["key"],
    "conversations": [],
}
#: Sets that indexes keep; what they are dealt to buckets by, if not by document; how a bucket is sorted within that.
INDEXES = ("postings", "maxima", "forward", "statistics", "centres", "reach", *(n for n in SCHEMAS if n.startswith("cells_")))
#: Sets that are right together alone: the text index.
TOGETHER = ("postings", "maxima", "forward", "statistics")
BUCKET_BY = {"postings": "token", "maxima": "token", "statistics": "token", **{n: "cell" for n in SCHEMAS if n.startswith("cells_")}}
SORT = {"postings": ["collection", "block", "id"], "maxima": ["collection", "block"]}
#: Sets that are read by folding their rows: (keys, how each column folds); compact() folds them for good.
FOLDED = {
    "statistics": (["collection", "token"], {"df": "sum", "texts": "sum", "length": "sum"}),
    "maxima": (["collection", "token", "block"], {"tf": "max", "dl": "min"}),
    "reach": (["document_id", "cell"], {"near": "min"}),
}
#: Where a point lookup searches, in order.
COLLECTIONS = ("index", "content", "table", "hierarchical")


def listing_of(files: DataFrame, meta: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Files (key) with their metadata, defaults for what is missing, and has_meta."""
    rows = files.join(meta.withColumn("has_meta", F.lit(True)), key, "left")
    for c, value in {**defaults, "has_meta": False}.items():
        rows = rows.withColumn(c, F.coalesce(c, value if isinstance(value, Column) else F.lit(value)))
    return rows


def collection_counts(collections: dict[str, DataFrame], name: str = "points") -> DataFrame:
    """(collection, points) of each collection."""
    out = None
    for collection, rows in collections.items():
        own = rows.agg(F.count(F.lit(1)).alias(name)).select(F.lit(collection).alias("collection"), name)
        out = own if out is None else out.unionByName(own)
    return out


class Conflict(RuntimeError):
    """Another writer changed what this one builds on."""


@dataclass(frozen=True)
class Packed:
    """How rows that are dealt in a closer form are unpacked by the tasks that write them, and how many tasks share a bucket (1: by its bytes)."""

    unpack: Callable[[DataFrame], DataFrame]
    tasks: int = 1


class Store:
    """Record sets under a root folder that every executor sees."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._pending: list[tuple[str, dict[str, Any]]] | None = None
        if self._names("_layout"):
            raise ValueError(f"{root} was written by an earlier version, without a manifest: ingest it anew")
        if not self._latest()[1]:
            self._commit(lambda m: m or {"buckets": buckets, "sets": {}})
        self.buckets: int = self._latest()[1]["buckets"]

    def _path(self, *names: str) -> str:
        return "/".join([self.root, *names])

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *folder: str) -> list[tuple[str, int]]:
        """(name, time of change in ms) of what a folder holds."""
        path, fs = self._hadoop(self._path(*folder))
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []

    # -- versions

    def versions(self) -> list[int]:
        """Numbers of the versions there are, the last one first."""
        return sorted((int(n[:-5]) for n, _ in self._names("_versions") if n.endswith(".json")), reverse=True)

    def _manifest(self, version: int) -> dict[str, Any] | None:
        """A version's manifest; None where its writer was stopped half-way, or it is gone."""
        path, fs = self._hadoop(self._path("_versions", f"{version:020d}.json"))
        try:
            stream = fs.open(path)
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except (Py4JJavaError, ValueError):
            return None

    def _latest(self) -> tuple[int, dict[str, Any]]:
        """(number that is taken last, manifest of the last whole version)."""
        numbers = self.versions()
        return (numbers[0] if numbers else -1), next((m for m in map(self._manifest, numbers) if m), {})

    def _commit(self, change: Callable[[dict[str, Any]], dict[str, Any]]) -> int:
        """Create the next version by a change of the last one; where another writer took its number, the change is made anew."""
        while True:
            taken, manifest = self._latest()
            if self._half_written(taken):
                time.sleep(0.1)
                continue
            body = json.dumps(change(manifest)).encode()
            path, fs = self._hadoop(self._path("_versions", f"{taken + 1:020d}.json"))
            try:
                stream = fs.create(path, False)
            except Py4JJavaError:
                if not fs.exists(path):
                    raise
                continue
            stream.write(body)
            stream.close()
            return taken + 1

    def _half_written(self, version: int) -> bool:
        """Whether a writer may be at work on a version: it isn't whole, and young."""
        if version < 0 or self._manifest(version):
            return False
        path, fs = self._hadoop(self._path("_versions", f"{version:020d}.json"))
        return fs.exists(path) and fs.getFileStatus(path).getModificationTime() > (time.time() - GRACE_S) * 1000

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """Writes inside become visible to others as one version, or not at all; reads inside see them."""
        if self._pending is not None:
            yield
            return
        self._pending = []
        try:
            yield
            added = self._pending
        finally:
            self._pending = None
        if added:
            self._commit(lambda m: self._with(m, added))

    @staticmethod
    def _with(manifest: dict[str, Any], added: list[tuple[str, dict[str, Any]]]) -> dict[str, Any]:
        sets = {n: {"schema": s["schema"], "deltas": list(s["deltas"])} for n, s in manifest["sets"].items()}
        for name, delta in added:
            sets.setdefault(name, {"schema": SCHEMAS[name], "deltas": []})["deltas"].append(delta)
        return {**manifest, "sets": sets}

    def _deltas(self, name: str, version: int | None = None) -> list[dict[str, Any]]:
        if version is None:
            manifest = self._with(self._latest()[1], self._pending or [])
        elif (manifest := self._manifest(version)) is None:
            raise ValueError(f"no version {version}")
        return manifest["sets"].get(name, {"deltas": []})["deltas"]

    def ensure(self) -> list[str]:
        """Drop stored record sets whose columns aren't the expected ones, and what is right with them alone; their names."""
        sets = self._latest()[1]["sets"]
        odd = [n for n, s in sets.items() if s["schema"] != SCHEMAS.get(n)]
        if set(odd) & set(TOGETHER):
            odd = [n for n in sets if n in odd or n in TOGETHER]
        if odd:
            self._commit(lambda m: {**m, "sets": {n: s for n, s in m["sets"].items() if n not in odd}})
        return odd

    # -- reads

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(column, F.lit(""))), F.lit(self.buckets)).cast("int")

    def bucket(self, column: Column) -> Column:
        """The bucket of a value that isn't null."""
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def bucket_of(self, value: str | None) -> int:
        """The bucket of a value, on the driver."""
        h = xxhash.xxh64((value or "").encode(), seed=42).intdigest()  # Spark's xxhash64()
        return (h - (1 << 64) if h >> 63 else h) % self.buckets

    def _raw(self, name: str, deltas: list[dict[str, Any]], buckets: list[int] | None = None) -> DataFrame:
        """The rows of deltas, of some buckets: only their folders are listed and read."""
        paths = [self._path(name, f"delta={d['id']}", *([] if buckets is None else [f"bucket={b}"])) for d in deltas for b in ([0] if buckets is None else buckets) if buckets is None or b in d["buckets"]]
        return self.spark.read.schema(f"{SCHEMAS[name]}, delta string, bucket int").option("basePath", self._path(name)).parquet(*paths)

    def _gone(self, name: str, ids: list[str]) -> DataFrame:
        paths = [self._path("_gone", name, f"delta={i}") for i in ids]
        return self.spark.read.schema("document_id string, bucket int, delta string").option("basePath", self._path("_gone", name)).parquet(*paths)

    def _merged(self, name: str, deltas: list[dict[str, Any]], buckets: list[int] | None = None) -> DataFrame:
        """Rows that no later delta replaces; of some buckets alone. Joins are with what later deltas replace, which is small beside the rows once they are compacted."""
        held = [i for i, d in enumerate(deltas) if d["buckets"] and (buckets is None or set(d["buckets"]) & set(buckets))]
        if not held:
            return self.spark.createDataFrame([], SCHEMAS[name])
        rows = self._raw(name, [deltas[i] for i in held], buckets)
        by_document = BUCKET_BY.get(name, "document_id") == "document_id"
        gone = [i for i, d in enumerate(deltas) if i > held[0] and d["gone"] and (buckets is None or not by_document or set(d["gone"]) & set(buckets))]
        keyed = [i for i in held if i > held[0] and deltas[i]["keyed"]]
        nth = lambda which: F.element_at(F.create_map(*[F.lit(x) for i in which for x in (deltas[i]["id"], i)]), F.col("delta"))
        if gone or keyed:
            rows = rows.withColumn("_nth", nth(held))
        if gone:
            later = self._gone(name, [deltas[i]["id"] for i in gone])
            later = later.filter(F.col("bucket").isin(buckets)) if buckets is not None and by_document else later
            later = later.groupBy("document_id").agg(F.max(nth(gone)).alias("_later"))
            rows = rows.alias("r").join(later.alias("l"), F.col("r.document_id").eqNullSafe(F.col("l.document_id")) & (F.col("r._nth") < F.col("l._later")), "left_anti")
        if keyed:
            keys = ["document_id", *KEYS[name]]
            later = self._raw(name, [deltas[i] for i in keyed], buckets)
            later = later.groupBy(*keys).agg(F.max(nth(keyed)).alias("_later"))
            same = F.col("r._nth") < F.col("l._later")
            for k in keys:
                same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}"))
            rows = rows.alias("r").join(later.alias("l"), same, "left_anti")
        return rows.drop("_nth", "delta", "bucket")

    def read(self, name: str, values: list[str] | None = None, version: int | None = None) -> DataFrame:
        """A record set as of the last version, or an earlier one; an empty frame before the first write.

        values: of some documents alone (postings and statistics: of some tokens), whose buckets alone are read.
        """
        deltas = self._deltas(name, version)
        if not values:
            return self._merged(name, deltas)
        column = BUCKET_BY.get(name, "document_id")
        return self._merged(name, deltas, sorted({self.bucket_of(v) for v in values})).filter(F.col(column).isin(values))

    # -- writes

    @staticmethod
    def _typed(name: str, df: DataFrame, *more: str) -> DataFrame:
        types = dict(c.split(" ", 1) for c in SCHEMAS[name].split(", "))
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in types.items()], *more)

    def _write_rows(self, name: str, rows: DataFrame, packed: Packed | None = None) -> tuple[str, list[int]]:
        """(id, buckets) of a new folder of rows; a large bucket goes to several tasks, small ones share one."""
        column, new = BUCKET_BY.get(name, "document_id"), f"d{uuid.uuid4().hex}"
        dealt = rows if "bucket" in rows.columns else rows.withColumn("bucket", self._bucket(column))
        if packed and packed.tasks > 1:
            task = F.col("bucket") + self.buckets * F.pmod(F.hash("document_id"), F.lit(packed.tasks))
            dealt = dealt.repartitionById(self.buckets * packed.tasks, task.cast("int"))
        else:
            dealt = dealt.hint("rebalance", "bucket")
        dealt = self._typed(name, packed.unpack(dealt), "bucket") if packed else dealt
        dealt.sortWithinPartitions("bucket", column, *SORT.get(name, [])).write.partitionBy("bucket").option("compression", "zstd").parquet(self._path(name, f"delta={new}"))
        return new, sorted(int(n.split("=")[1]) for n, _ in self._names(name, f"delta={new}") if n.startswith("bucket="))

    def _add(self, name: str, df: DataFrame | None, keyed: bool, documents: DataFrame | None, whole: bool, packed: Packed | None = None) -> DataFrame:
        """One delta: rows of df, which replace by key, or whole documents: those of df (whole) and those of `documents`."""
        new, own = f"d{uuid.uuid4().hex}", []
        if df is not None:
            new, own = self._write_rows(name, df if packed else self._typed(name, df), packed)
        delta = {"id": new, "buckets": own, "gone": [], "keyed": keyed}
        parts = ([self._raw(name, [delta]).select("document_id")] if whole and own else []) + ([documents.select(F.col("document_id").cast("string"))] if documents is not None else [])
        if parts:
            ids = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            ids.distinct().withColumn("bucket", self._bucket("document_id")).coalesce(8 if df is not None else 1).write.parquet(self._path("_gone", name, f"delta={new}"))
            delta["gone"] = sorted(r[0] for r in self._gone(name, [new]).select("bucket").distinct().collect())  # the number of buckets at most
        with self.transaction():
            if own or delta["gone"]:
                self._pending.append((name, delta))
        return self._raw(name, [delta]).drop("delta", "bucket") if own else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, df: DataFrame, documents: DataFrame | None = None, whole: bool = True, packed: Packed | None = None) -> DataFrame:
        """Replace the documents of df, and those of `documents` (document_id) of which nothing is left; a repeated ingest changes nothing. Returns the rows as written.

        whole: False where `documents` has those of df too, so that the rows needn't be read for them.
        packed: df has rows in a closer form for the way to their tasks, with their `bucket` if that isn't their document's.
        """
        return self._add(name, df, False, documents, whole, packed)

    def merge(self, name: str, df: DataFrame) -> None:
        """Upsert the rows of df by the record set's key; other rows of their documents stay."""
        self._add(name, df.dropDuplicates(["document_id", *KEYS[name]]), True, None, False)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows that replace none, such as differences that are summed up when they are read."""
        self._add(name, df, False, None, False)

    def delete(self, *document_ids: str) -> None:
        """Drop documents from every record set, in one version; terms lose the association alone, and stay with no occurrence of it."""
        ids = self.spark.createDataFrame([(d,) for d in document_ids], "document_id string")
        with self.transaction():
            for name in SCHEMAS:
                if name in INDEXES or not self._deltas(name):
                    continue
                freed = None
                if name == "terms":
                    freed = self.read(name, list(document_ids)).withColumn("document_id", F.lit(None).cast("string")).withColumn("occurrences", F.lit(0).cast("long")).withColumn("source_chunk_ids", F.array().cast("array<string>")).dropDuplicates(["key"])
                self._add(name, freed, name == "terms", ids, False)

    # -- upkeep

    def deltas(self, name: str) -> int:
        """How many deltas a read of a record set merges."""
        return len(self._deltas(name))

    def compact(self, name: str) -> None:
        """One base instead of a record set's deltas; what is written meanwhile stays after it. Conflict, if it was compacted meanwhile."""
        seen = self._latest()[1]["sets"].get(name, {"deltas": []})["deltas"]
        if len(seen) < 2:
            return
        rows = self._merged(name, seen)
        if name in FOLDED:
            keys, how = FOLDED[name]
            rows = rows.groupBy(*keys).agg(*[F.expr(f"{f}({c})").alias(c) for c, f in how.items()])
            if set(how.values()) == {"sum"}:
                rows = rows.filter(" OR ".join(f"{c} <> 0" for c in how))
            rows = self._typed(name, rows)
        new, own = self._write_rows(name, rows)

        def change(manifest: dict[str, Any]) -> dict[str, Any]:
            now = manifest["sets"].get(name, {"deltas": []})["deltas"]
            if now[: len(seen)] != seen:
                raise Conflict(f"{name} was compacted meanwhile")
            base = [{"id": new, "buckets": own, "gone": [], "keyed": False}] if own else []
            return {**manifest, "sets": {**manifest["sets"], name: {"schema": SCHEMAS[name], "deltas": base + now[len(seen) :]}}}

        self._commit(change)

    def vacuum(self, keep: int = 2, age_s: float = 86_400.0) -> int:
        """Delete versions but the last `keep`, and deltas that no kept version lists and that are older than age_s (those of writers at work are younger); how many deltas."""
        numbers = self.versions()
        named = {d["id"] for v in numbers[:keep] for s in (self._manifest(v) or {"sets": {}})["sets"].values() for d in s["deltas"]}
        old, dropped = (time.time() - age_s) * 1000, set()
        for v in numbers[keep:]:
            self._drop(self._path("_versions", f"{v:020d}.json"))
        for name in SCHEMAS:
            for folder in ((name,), ("_gone", name)):
                for found, changed in self._names(*folder):
                    if found.startswith("delta=") and found[6:] not in named and changed <= old:
                        self._drop(self._path(*folder, found))
                        dropped.add(found)
        return len(dropped)

    def _drop(self, path: str) -> None:
        p, fs = self._hadoop(path)
        fs.delete(p, True)

    # -- looks

    def listing(self, files: DataFrame | None = None) -> DataFrame:
        """Documents with defaults for what is missing; files (document_id) without metadata are listed too."""
        meta = self.read("documents")
        rows = listing_of((files if files is not None else meta).select("document_id"), meta, "document_id", {"filename": F.col("document_id"), "document_type": "magazine", "total_pages": 0, "total_words": 0, "total_chars": 0})
        return rows.drop("has_meta")

    def stats(self) -> DataFrame:
        """(collection, points)."""
        chunks = self.read("chunks")
        each = {c: chunks.filter(F.col("collection") == c) for c in COLLECTIONS[:3]}
        return collection_counts({**each, "hierarchical": self.read("points")}).filter("points > 0")

    def vector(self, point_id: str) -> list[float] | None:
        """The dense vector of a chunk or a hierarchy point: the first collection that has it."""
        both = self.read("chunks").select("id", "collection", "dense").unionByName(self.read("points").select("id", F.lit("hierarchical").alias("collection"), "dense"))
        rank = F.array_position(F.array(*map(F.lit, COLLECTIONS)), F.col("collection"))
        row = both.filter(F.col("id") == point_id).orderBy(rank).select("dense").first()
        return list(row[0]) if row and row[0] is not None else None

    def points(self, document_id: str, limit: int = 50, node_type: str | None = None) -> DataFrame:
        """Some points of a document, for a look, with the sizes of their vectors."""
        df = self.read("points", [document_id])
        df = df.filter(F.col("node_type") == node_type) if node_type else df
        return df.withColumn("dense_size", F.size("dense")).orderBy("depth", "id").limit(limit)
