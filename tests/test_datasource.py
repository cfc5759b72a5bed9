"""Document folders as a data source, in batch and as a stream."""

import io
import zipfile

import pytest

from docloom.sources import datasource
from docloom.sources.files import read_pages, read_tables

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs, rows=()):
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f"<w:tbl>{''.join(f'<w:tr>{chr(32).join(map(cell, r))}</w:tr>' for r in rows)}</w:tbl>" if rows else ""
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + table
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "a.docx").write_bytes(docx(["one", "two"], [["h", "n"], ["x", "1"]]))
    (root / "sub" / "b.txt").write_text("page 1\fpage 2")
    (root / "c.pdf").write_bytes(b"p|q")
    (root / "bad.docx").write_bytes(b"no zip")
    (root / "~$a.docx").write_bytes(b"x")
    (root / "other.csv").write_text("1,2")
    return root


def same(got, want):
    return sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_batch_reads_what_the_reader_reads(spark, folder):
    parse = {"pdf": lambda data: data.decode().split("|")}
    datasource.register(spark, parse)
    got = spark.read.format("docloom").load(str(folder))
    assert same(got, read_pages(spark, str(folder), parse, ("docx", "txt", "pdf")))
    assert [r.document_id for r in got.filter("error IS NOT NULL").collect()] == ["bad.docx"]
    datasource.register(spark, {"pdf": lambda data: [(1, [["h"], [data.decode()]])]}, "docloom_tables")
    tables = spark.read.format("docloom_tables").option("kind", "tables").option("extensions", "docx").load(str(folder))
    assert same(tables, read_tables(spark, str(folder))) and tables.count() == 1
    assert spark.read.format("docloom_tables").option("kind", "tables").load(f"file://{folder}").count() == 2


def test_a_filter_on_documents_leaves_others_unparsed(spark, folder, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        datasource.register(spark, {"text": lambda data, at=str(marks): (open(f"{at}/{len(data)}", "w").close(), [data.decode()])[1]}, "docloom_marks")
        (folder / "long.txt").write_text("x" * 500)
        rows = spark.read.format("docloom_marks").option("extensions", "txt").load(str(folder))
        assert [r.document_id for r in rows.filter("document_id = 'long.txt'").collect()] == ["long.txt"]
        assert [p.name for p in marks.iterdir()] == ["500"]
        assert rows.filter("document_id IN ('long.txt', 'b.txt') AND page_number = 1").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_are_dealt_by_size():
    files = [(f"f{i}", n) for i, n in enumerate([10, 10, 90, 5, 5, 200, 1])]
    found = datasource.dealt(files, 100)
    assert [f.paths for f in found] == [["f0", "f1"], ["f2", "f3", "f4"], ["f5"], ["f6"]]
    assert datasource.dealt([], 100) == []


def test_a_stream_gives_new_files_once(spark, folder, tmp_path):
    datasource.register(spark, {"pdf": lambda data: data.decode().split("|")}, "docloom_stream")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.format("docloom_stream").option("extensions", "txt,pdf").option("filesPerBatch", "1").load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", check).start(out)
        query.processAllAvailable()
        query.stop()
        return sorted((r.document_id, r.page_number, r.text) for r in spark.read.parquet(out).collect())

    first = [("b.txt", 1, "page 1"), ("b.txt", 2, "page 2"), ("c.pdf", 1, "p"), ("c.pdf", 2, "q")]
    assert run() == first
    (folder / "d.txt").write_text("late")
    assert run() == sorted([*first, ("d.txt", 1, "late")])  # after a restart, the new file alone
