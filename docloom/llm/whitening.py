"""Embedding whitening by TSQR: a QR in each partition, a tree that merges R factors, an SVD of the last one.

Entries are fixed-point integers, so that counts, sums and deviations are exact. The fit list has each vector once.
Its rows, centred with the exact sums, are reduced to one triangular R a task; FAN of these are stacked and reduced
again, level by level, until one is left. Its right singular vectors are the components and its squared singular
values, over n, the eigenvalues: no covariance is formed to find them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, write_shared

SCALE = 256
COMPONENTS = 4
#: States that a node of the tree merges, and rows that a QR takes at once.
FAN, ROWS = 8, 4096
WIDE = 38


def fixed_point(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry as long; null for a vector that is null or holds null or non-finite entries. Beyond a long: its bound."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(0).cast("long")))


def _matrix(batch: pa.RecordBatch, wide: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, wide)


def _sums(wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * wide
        for batch in batches:
            x = _matrix(batch, wide)
            small = not len(x) or (int(x.max()) < 2**62 // len(x) and int(x.min()) > -(2**62) // len(x))
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0) if small else x.astype(object).sum(axis=0), strict=True)]
            n += len(x)
        if n:
            exact = pa.array([Decimal(t) for t in total], pa.decimal128(WIDE, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(wide), pa.int32()), pa.array([n] * wide, pa.int64()), exact], ["dimension", "n", "total"])

    return run


@dataclass(frozen=True)
class Model:
    """n vectors of the fit list with exact sums; components (rows) by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def flat(self) -> np.ndarray:
        """Which components have no spread to double precision."""
        return self.values <= (self.values[0] if len(self.values) else 0.0) * (max(len(self.sums), 64) * np.finfo(float).eps) ** 2

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: whole parts leave as integers, the rest as a fraction."""
        whole = np.array([s // self.n for s in self.sums], object)
        left = np.array([(s % self.n) / self.n for s in self.sums])
        near = max((abs(w) for w in whole), default=0) < 2**61 and (not x.size or np.abs(x // 4).max() < 2**60)
        return (x - (whole.astype(np.int64) if near else whole)).astype(float) - left

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums) ** 2, exact; None beyond WIDE digits."""
        most = self.n * (int(np.abs(x // 2).max()) * 2 + 2 if x.size else 0) + max((abs(s) for s in self.sums), default=0)
        kind = np.int64 if most**2 * max(1, len(self.sums)) < 2**63 else object
        apart = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [v if v < 10**WIDE else None for v in map(int, (apart * apart).sum(axis=1))] if x.size else [0] * len(x)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components), nan where a component is flat."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.flat, np.nan, self.centred(x) @ self.components.T / np.sqrt(self.values))


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _states(wide: int, state: Callable[[Iterator[np.ndarray]], np.ndarray]):
    """One row a task: its node (the number of the partition) and its state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = state(m for batch in batches for m in (_matrix(batch, wide),) if len(m))
        if found.size:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found.ravel().tolist()], pa.list_(pa.float64()))], ["node", "state"])

    return run


def _tree(rows: DataFrame, wide: int, state: Callable, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The state of all rows: one a task, then FAN merged in each node, level by level; the root alone comes to the driver."""
    schema = "node long, state array<double>"

    def up(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        states = [np.array(table.column("state")[int(i)].as_py()) for i in order]
        node = table.column("node")[int(order[0])].as_py() // FAN
        return pa.table({"node": pa.array([node], pa.int64()), "state": pa.array([merge(states).ravel().tolist()], pa.list_(pa.float64()))})

    level = write_shared(rows.select("x").mapInArrow(_states(wide, state), schema), "states")
    while level.count() > 1:
        higher = write_shared(level.groupBy(F.expr(f"node div {FAN}").alias("parent")).applyInArrow(up, schema), "states")
        discard(level)
        level = higher
    root = level.first()
    discard(level)
    return np.array(root["state"]) if root else np.zeros(0)


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Model, DataFrame] | None:
    """The model of rows (x), and the written fit list; None without rows. All vectors have one length."""
    first = rows.select(F.size("x").alias("wide")).first()
    if first is None or not first["wide"]:
        return None
    wide = first["wide"]
    once = write_shared(rows.select("x").distinct(), "fit")
    totals = {r["dimension"]: r for r in once.mapInArrow(_sums(wide), f"dimension int, n long, total decimal({WIDE},0)").groupBy("dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}  # a row a dimension
    n, sums = totals[0]["n"], [int(totals[d]["total"]) for d in range(wide)]
    blank = Model(n, sums, np.zeros((0, wide)), np.zeros(0), 0.0)

    def reduced(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, wide))
        for block in blocks:
            for at in range(0, len(block), ROWS):
                r = triangle(np.vstack([r, blank.centred(block[at : at + ROWS])]))
        return r

    r = _tree(once, wide, reduced, lambda states: triangle(np.vstack([s.reshape(-1, wide) for s in states]))).reshape(-1, wide)
    _, values, right = np.linalg.svd(r, full_matrices=True)
    values = np.concatenate([values, np.zeros(wide - len(values))]) ** 2 / n
    kept = min(components, wide)
    right = right[:kept]
    signs = np.sign(right[np.arange(kept), np.abs(right).argmax(axis=1)])
    return Model(n, sums, right * signs[:, None], values[:kept], float(values.sum())), once


def identity_error(model: Model, once: DataFrame) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, over components that are not flat; None without one.

    A task keeps count, means and products of what is centred on its means; states merge as variances do.
    """
    live = np.flatnonzero(~model.flat)
    k = len(live)
    if not k:
        return None

    def merge(states: list[np.ndarray]) -> np.ndarray:
        n, mean, products = 0.0, np.zeros(k), np.zeros((k, k))
        for s in states:
            m, other = s[0], s[1 : 1 + k]
            apart = other - mean
            products += s[1 + k :].reshape(k, k) + np.outer(apart, apart) * n * m / (n + m)
            mean = mean + apart * m / (n + m)
            n += m
        return np.concatenate([[n], mean, products.ravel()]) if n else np.zeros(0)

    def moments(blocks: Iterator[np.ndarray]) -> np.ndarray:
        states = []
        for block in blocks:
            w = model.whitened(block)[:, live]
            apart = w - w.mean(axis=0)
            states = [merge([*states, np.concatenate([[len(w)], w.mean(axis=0), (apart.T @ apart).ravel()])])]
        return states[0] if states else np.zeros(0)

    state = _tree(once, len(model.sums), moments, merge)
    return float(np.abs(state[1 + k :].reshape(k, k) / state[0] - np.eye(k)).max())


def _projected(model: Model, error: float | None, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        share = [float(v / model.trace) if model.trace else None for v in model.values]
        for batch in batches:
            x = _matrix(batch, len(model.sums))
            white, apart = model.whitened(x).ravel(), model.deviations(x)
            ids = batch.column(batch.schema.get_field_index(id_name)).take(pa.array(np.repeat(np.arange(len(x)), k)))
            whole = pa.array([Decimal(a) if a is not None else None for a in apart], pa.decimal128(WIDE, 0)).take(pa.array(np.repeat(np.arange(len(x)), k)))
            cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(white), model.n)), whole, pa.array(white, mask=np.isnan(white)), pa.array(share * len(x), pa.float64()), pa.array([error] * len(white), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [id_name, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(rows: DataFrame, vector: str = "embedding", id_name: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each vector and component: its id, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out, and so are those that don't have the most
    frequent length (of ties the longest). Null ids, repeated ids and repeated vectors keep their rows; each vector
    counts once in the fit. Where a component has no spread (a single vector, equal dimensions) whitened is null, and
    identity_error is of the others; explained is null where nothing spreads. Of equal eigenvalues the order is open.
    An empty table gives no rows; other columns are ignored, whatever their names. A row goes through a task alone, and
    a task and the driver hold wide x wide numbers.
    """
    kind = rows.schema[id_name].dataType.simpleString()
    schema = f"`{id_name}` {kind}, component int, n long, deviation decimal({WIDE},0), whitened double, explained double, identity_error double"
    x = rows.select(F.col(f"`{id_name}`"), fixed_point(F.col(f"`{vector}`"), scale).alias("x")).filter("x IS NOT NULL")
    lengths = x.groupBy(F.size("x").alias("wide")).count().orderBy(F.desc("count"), F.desc("wide")).first()
    found = fit(x.filter(F.size("x") == lengths["wide"]), components) if lengths else None
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    model, once = found
    error = identity_error(model, once)
    discard(once)
    return x.filter(F.size("x") == lengths["wide"]).mapInArrow(_projected(model, error, id_name), schema)
