"""Document folders as a data source: spark.read.format("docloom") and spark.readStream.format("docloom").

Options: path, a folder of a file system that pyarrow.fs reaches from every executor; kind, pages (the default) or tables;
extensions, comma-joined. Files are dealt to tasks by size. A filter on document_id keeps other files unparsed, if filters are pushed. A stream gives
the files that are new since its last batch, in the order of their times and paths, filesPerBatch of them at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from docloom.sources.files import FORMATS, PAGES, TABLES, page_rows, table_rows

NAME = "docloom"
#: Bytes that a task reads; a larger file is alone.
TASK_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    """Paths that one task reads."""

    paths: list[str]


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(options: dict[str, str]) -> list[tuple[int, str, int]]:
    """(time of change in microseconds, path, size) of the folder's files of the formats, or extensions, asked for; temporary ones (~$) are left out."""
    from pyarrow import fs

    system, folder = _system(options["path"])
    ends = tuple(f".{e.strip().lower()}" for e in options.get("extensions", ",".join(FORMATS)).split(","))
    found = system.get_file_info(fs.FileSelector(folder, recursive=True))
    return sorted((f.mtime_ns // 1000 if f.mtime_ns else 0, f.path, f.size or 0) for f in found if f.is_file and f.path.lower().endswith(ends) and not f.base_name.startswith("~$"))


def dealt(files: Iterable[tuple[str, int]], most: int = TASK_BYTES) -> list[Files]:
    """Files in turn, `most` bytes a task."""
    out, size = [], most
    for path, n in files:
        if size + n > most:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(path)
        size += n
    return out


def _rows(options: dict[str, str], paths: list[str], parsers: dict[str, Callable]) -> Iterator[tuple]:
    system, _ = _system(options["path"])
    make = table_rows if options.get("kind") == "tables" else page_rows
    for path in paths:
        with system.open_input_stream(path) as f:
            yield from make(path.rsplit("/", 1)[-1], f.read(), parsers)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], parsers: dict[str, Callable]) -> None:
        self.options, self.parsers, self.names = options, parsers, None

    def partitions(self) -> list[Files]:
        return dealt((p, n) for _, p, n in listed(self.options) if self.names is None or p.rsplit("/", 1)[-1] in self.names) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.options, partition.paths, self.parsers)


class FilteredReader(Reader):
    """A reader that takes filters on document_id."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  a name of the base class
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("document_id",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            else:
                yield f


class StreamReader(DataSourceStreamReader):
    """Offsets are (time, path) of the last file taken; a file that comes with an older time than that is not seen."""

    def __init__(self, options: dict[str, str], parsers: dict[str, Callable]) -> None:
        self.options, self.parsers, self.taken = options, parsers, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def _after(self, offset: dict) -> list[tuple[int, str, int]]:
        return [f for f in listed(self.options) if (f[0], f[1]) > (offset["time"], offset["path"])]

    def latestOffset(self) -> dict:  # noqa: N802
        new = self._after(self.taken or self.initialOffset())[: int(self.options.get("filesPerBatch", "1000"))]
        if new:
            self.taken = {"time": new[-1][0], "path": new[-1][1]}
        return self.taken or self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.taken = max((x for x in (self.taken, end) if x), key=lambda x: (x["time"], x["path"]))  # after a restart
        return dealt((p, n) for t, p, n in self._after(start) if (t, p) <= (end["time"], end["path"]))

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.options, partition.paths, self.parsers)


def register(spark: SparkSession, parsers: dict[str, Callable] | None = None, name: str = NAME) -> None:
    """Register the source under a name; parsers take the bytes of other kinds, as in read_pages() and read_tables().

    It takes filters if spark.sql.python.filterPushdown.enabled is on by now, as Spark has it off.
    """
    own = parsers or {}
    made = FilteredReader if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else Reader

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return TABLES if self.options.get("kind") == "tables" else PAGES

        def reader(self, schema: StructType) -> Reader:
            return made(dict(self.options), own)

        def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
            return StreamReader(dict(self.options), own)

    spark.dataSource.register(Documents)
