"""Bounded samples of labelled rows, to fit classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """Of each label the rows whose id hashes below a bound, about per_label of them (some standard deviations more at most).

    One count by label fixes the bounds, so that nothing is sorted and no label is gathered in a task. The
    same rows are chosen wherever they lie.
    """
    counts = rows.groupBy(label).count().collect()  # one row a label
    h = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40))
    bound = F.lit(None).cast("long")
    for r in counts:
        if r[label] is not None:
            bound = F.when(F.col(label) == F.lit(r[label]), F.lit(min(1 << 40, (1 << 40) * per_label // r["count"]))).otherwise(bound)
    return rows.filter(h < bound)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> list[tuple[str, object]]:
    """(text, label) of a sample of labels (doc_id, label) that have a document; the texts are scanned, not shuffled."""
    chosen = F.broadcast(sampled(labels, label, per_label).distinct())  # about per_label rows a label
    found = docs.select("doc_id", "text").join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text", label)
    return [(r["text"], r[label]) for r in found.select("text", label).collect()]
