"""A stored vector index: cells around learned centres, probed by bounds, with exact scores.

Centres are learned by k-means on the sphere from a bounded sample; every vector is indexed, in the cell of its nearest
centre. A cell's reach (the least cosine of a vector with its centre) bounds the cosine of a question with any
vector of the cell. A search scores the rows of the nearest cells by the stored vectors; the exact setting then
scores every cell whose bound exceeds the k-th score, so that its result is the one of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import search
from docloom.sources.store import Store

#: Vectors that centres are learned from, cells of a collection, and passes: all at most.
SAMPLE, CELLS, PASSES = 20_000, 4096, 12
#: Rows that a cell is meant to hold.
CELL_ROWS = 64
#: Numbers of rows times cells that are held at once.
PRODUCT = 1 << 20
#: Slack of bounds, for vectors that are stored as floats.
SLACK = 1e-5


def centres(vectors: np.ndarray, cells: int, passes: int = PASSES, seed: int = 3) -> np.ndarray:
    """Unit centres of unit vectors; a cell that stays empty takes a vector at random."""
    rng = np.random.default_rng(seed)
    found = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(passes):
        own = (vectors @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1)
        lost = size < 1e-9
        sums[lost] = vectors[rng.choice(len(vectors), int(lost.sum()))]
        found = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return found


def _assigned(found: np.ndarray, collection: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, most = found.shape[1], max(1, PRODUCT // len(found))
        for batch in (b.slice(i, most) for b in batches for i in range(0, b.num_rows, most)):
            rows = [np.array(v, float) if v is not None and len(v) == wide and None not in v else np.zeros(wide) for v in batch.column(batch.schema.get_field_index("dense")).to_pylist()]
            x = np.array(rows).reshape(-1, wide)
            size = np.linalg.norm(x, axis=1)
            near = (x / np.maximum(size, 1e-300)[:, None]) @ found.T
            own = near.argmax(axis=1) if len(x) else np.zeros(0, int)
            cell = [f"{collection}:{c}" if s > 0 else f"{collection}:none" for c, s in zip(own, size, strict=True)]
            cols = [pa.array(cell), *[batch.column(batch.schema.get_field_index(c)) for c in ("id", "dense", "document_id")], pa.array(near[np.arange(len(x)), own].tolist(), pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


class VectorIndex:
    """The vector index of a store, for one collection of vectors of one width, the most frequent one when centres are learned."""

    def __init__(self, store: Store, collection: str, cells: int | None = None) -> None:
        self.store, self.collection, self.cells = store, collection, cells

    def _centres(self) -> np.ndarray | None:
        """The centres, in order; a few thousand rows at most."""
        rows = self.store.read("centres", [self.collection]).orderBy("cell").collect()
        return np.array([list(r["vector"]) for r in rows]) if rows else None

    def fit(self, rows: DataFrame) -> np.ndarray | None:
        """Learn the centres from rows (dense): from SAMPLE vectors at most, chosen by their hash; None without a vector that isn't 0."""
        whole = F.forall("dense", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("dense", lambda x: x != 0)
        live = rows.filter(whole).select("dense")
        width = live.groupBy(F.size("dense").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        if width is None:
            return None
        live, n = live.filter(F.size("dense") == width["n"]), width["count"]
        drawn = live.filter(F.pmod(F.xxhash64("dense"), F.lit(n)) < SAMPLE) if n > SAMPLE else live
        x = np.array([list(r[0]) for r in drawn.limit(2 * SAMPLE).collect()], float)  # about SAMPLE rows; equal vectors share a hash, hence the limit
        found = centres(x / np.linalg.norm(x, axis=1, keepdims=True), self.cells or max(1, min(CELLS, n // CELL_ROWS)))
        frame = self.store.spark.createDataFrame([(self.collection, i, c.tolist()) for i, c in enumerate(found)], "document_id string, cell int, vector array<double>")
        self.store.write("centres", frame)
        return found

    def update(self, rows: DataFrame, documents: DataFrame | None = None) -> None:
        """Rows (document_id, id, dense) take the place of all rows of their documents, and of `documents`; the first ones teach the centres.

        Vectors that are null, 0 or of another width are found by the exact setting alone, with score 0.
        """
        with self.store.transaction():
            found = self._centres()
            found = self.fit(rows) if found is None else found
            found = np.zeros((1, 1)) if found is None else found
            schema = pa.schema([("cell", pa.string()), ("id", pa.string()), ("dense", pa.list_(pa.float32())), ("document_id", pa.string()), ("near", pa.float64())])
            dealt = rows.select("id", "dense", "document_id").mapInArrow(_assigned(found, self.collection, schema), "cell string, id string, dense array<float>, document_id string, near double")
            cells = self.store.write(f"cells_{self.collection}", dealt, documents)
            self.store.append("reach", cells.groupBy("cell").agg(F.min("near").alias("near")).withColumn("document_id", F.lit(self.collection)))

    def refit(self) -> None:
        """Learn the centres anew from all rows, and deal the rows to them: for a collection that has outgrown its cells."""
        with self.store.transaction():
            rows = self.store.read(f"cells_{self.collection}")
            self.store.write("reach", self.store.read("reach").limit(0), self.store.spark.createDataFrame([(self.collection,)], "document_id string"))
            if self.fit(rows) is not None:
                self.update(rows)

    def remove(self, *document_ids: str) -> None:
        ids = self.store.spark.createDataFrame([(d,) for d in document_ids], "document_id string")
        self.update(self.store.spark.createDataFrame([], "document_id string, id string, dense array<float>"), ids)

    def search(self, queries: list[tuple[list[float], float]], k: int = search.TOP_K, probes: int | None = None, scope: list[str] | None = None) -> DataFrame:
        """(document_id, id, score, variant): search.dense_variants() over the indexed rows.

        probes: the number of cells that are read, nearest first; None is exact, and reads what the bounds leave.
        """
        name = f"cells_{self.collection}"
        found = self._centres()
        if found is None:
            return search.dense_variants(self.store.read(name), queries, "dense", "id", k).select("document_id", "id", "score", "variant")
        reach = {r["cell"]: r["near"] for r in self.store.read("reach", [self.collection]).groupBy("cell").agg(F.min("near").alias("near")).collect()}  # a row a cell
        bounds = dict.fromkeys(reach, 0.0 if probes is None else -2.0)
        nearest: dict[str, float] = {}
        for vector, scale in queries:
            q = np.array(vector, float)
            size = np.linalg.norm(q)
            if not size:
                continue
            for i, c in enumerate((found @ (q / size)).tolist()):
                cell = f"{self.collection}:{i}"
                if cell in reach:
                    apart = np.arccos(np.clip(c, -1, 1)) - np.arccos(np.clip(reach[cell], -1, 1))
                    bound = scale * (1.0 if apart <= 0 else float(np.cos(apart)))
                    bounds[cell] = max(bound, bounds[cell]) if cell in nearest else bound
                    nearest[cell] = max(scale * c, nearest.get(cell, -2.0))
        order = sorted(nearest, key=lambda c: (-nearest[c], c))

        def scored(cells: list[str]) -> DataFrame:
            rows = self.store.read(name, cells) if cells else self.store.read(name).limit(0)
            rows = rows.filter(F.col("document_id").isin(scope)) if scope else rows
            return search.dense_variants(rows, queries, "dense", "id", k)

        kept = order[: probes or max(8, len(order) // 16)]
        if probes is None:
            best = [r[0] for r in scored(kept).select("score").collect()]  # k rows
            least = min(best) - SLACK if len(best) == k else -2.0
            kept = [c for c in bounds if bounds[c] + SLACK >= least]
        return scored(kept).select("document_id", "id", "score", "variant")
