"""Tables that cut lineage: written to the folder that all executors see, and read again."""

from __future__ import annotations

import atexit
import logging
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For local sessions alone, where spark.checkpoint.dir is unset.
LOCAL = "/tmp/checkpoints/docloom"
_roots: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder for a local session, and an error for a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return folder or LOCAL


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the session may be gone already; the files are only scratch
        logging.getLogger(__name__).warning("%s stays: %s", path, e)


def _clear() -> None:
    while _roots:
        _delete(*_roots.pop())


class Scratch:
    """A folder of one job's tables; it goes when the driver ends, or by clear()."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/docloom-{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        if not _roots:
            atexit.register(_clear)
        _roots.append((spark, self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it again; its files outlive lost executors."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = (table, path)  # the table is held, so that its id stays its own
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again; others are let be."""
        for t in tables:
            if found := self._paths.pop(id(t), None):
                _delete(self.spark, found[1])

    def clear(self) -> None:
        self._paths.clear()
        _delete(self.spark, self.root)
