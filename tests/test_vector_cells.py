"""Rows are dealt to cells a few at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docloom.operators.vector_index import _assigned


def test_dealing_a_batch_to_many_cells_stays_small():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4096, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = rng.normal(size=(5000, 8)).astype("float32")
    batch = pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), pa.array([str(i) for i in range(5000)]), pa.array(["d"] * 5000)], names=["dense", "id", "document_id"])
    schema = pa.schema([("cell", pa.string()), ("id", pa.string()), ("dense", pa.list_(pa.float32())), ("document_id", pa.string()), ("near", pa.float64())])
    tracemalloc.start()
    out = pa.Table.from_batches(list(_assigned(centres, "content", schema)(iter([batch, batch.slice(0, 0)]))), schema)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # all rows by all cells are 164 MB
    assert out.column("id").to_pylist() == batch.column("id").to_pylist()
    assert out.column("cell").to_pylist() == [f"content:{c}" for c in (x.astype(float) @ centres.T).argmax(axis=1)]
