"""Files in and out: decoded pages, chapter folders, seeds, templates and renderings."""

import json

from pagewright.operators import mapping as M
from pagewright.operators import pages as P
from pagewright.sources import tables


def test_pages_of_files(spark, tmp_path):
    def decode(content: bytes):
        return content.decode().split("\f")  # what is no UTF-8 can't be read

    (tmp_path / "One.pdf").write_bytes(b"a\fb")
    (tmp_path / "two.pdf").write_bytes(b"\xff\xfe")
    (tmp_path / "three.txt").write_bytes(b"x")
    got = {(r.file, r.page, r.text, (r.error or "")[:18]) for r in tables.read_pages(spark, str(tmp_path), decode).collect()}
    assert got == {("One.pdf", 1, "a", ""), ("One.pdf", 2, "b", ""), ("two.pdf", None, None, "UnicodeDecodeError")}
    assert {r.file for r in tables.read_pages(spark, str(tmp_path), decode, only="ONE").collect()} == {"One.pdf"}
    files = tables.read_files(spark, str(tmp_path), "o").collect()
    assert {(r.name, r.size_bytes) for r in files} == {("One.pdf", 3), ("two.pdf", 2)} and all(r.book_id == f"book-{r.source_hash[:16]}" for r in files)


def test_chapters_and_seeds(spark, tmp_path):
    for name, meta, text in (("chapter_01", {"title": "First"}, "one two\n\n three \n"), ("chapter_02", None, "four"), ("other", {"title": "x"}, "no")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "corpus.txt").write_text(text)
        if meta:
            (tmp_path / name / "meta.json").write_text(json.dumps(meta))
    got = [tuple(r) for r in tables.read_chapters(spark, str(tmp_path)).orderBy("chapter", "para_id").collect()]
    assert got == [("chapter_01", "First", 1, "one two", 2), ("chapter_01", "First", 2, "three", 1), ("chapter_02", "chapter_02", 1, "four", 1)]
    (tmp_path / "s.csv").write_text("Title,PrintedStart\n A  b ,3\n,4\nC,0\nD,\n")
    assert [tuple(r) for r in tables.read_seeds(spark, str(tmp_path / "s.csv")).collect()] == [("A b", 3)]


def test_renderings(spark, tmp_path):
    o = spark.createDataFrame([("b", 2, "T", "", 7), ("b", 1, "P", "ix", 1), ("b", 3, None, None, None)], "book_id string, sno int, title string, label string, printed int")
    assert tables.outline_text(o).first().value == "P | ix\nT | 7\n | "
    p = spark.createDataFrame([("b", 1, None)], "book_id string, page int, text string")
    assert tables.page_texts(p).first().value == "--- Physical page 1 ---\n"
    rows = spark.createDataFrame([("b", "A", 1, 0.0, "toc"), ("b", "B", 2, 0.0, "heading")], "book_id string, title string, start int, y double, kind string")
    tables.write_template(rows, str(tmp_path / "t"))
    got = spark.read.csv(str(tmp_path / "t"), header=True).orderBy("Sno").collect()
    assert [(r.Sno, r.printed_start, r.physical_start, r.book_id) for r in got] == [("1", "1", None, "b"), ("2", None, "2", "b")]
    tables.write_chapters(spark.createDataFrame([("c1", "T", ["x", "y"])], "chapter string, title string, paragraphs array<string>"), str(tmp_path / "w"), "wrap")
    assert spark.read.text(str(tmp_path / "w" / "corpus"), wholetext=True).first().value == "x\n\ny\n"


def test_rows_and_ends(spark):
    a = spark.createDataFrame([("b", 1, 3, False), ("b", 5, 7, False), ("b", 100, 110, False), ("b", 110, 120, False)], "book_id string, printed int, physical int, exception boolean")
    rows = spark.createDataFrame([("b", 1, 2, 5, False), ("b", 2, 5, 50, False), ("b", 3, 50, 60, False), ("b", 4, 50, 60, True)], "book_id string, sno int, start int, end int, already_physical boolean")
    got = [(r.physical_start, r.physical_end, r.unresolved) for r in M.physical_rows(rows, a).orderBy("sno").collect()]
    assert got == [(4, 7, None), (None, None, 50), (None, None, 50), (50, 60, None)]
    e = spark.createDataFrame([("b", 1, 3, 5, 7), ("b", 2, 3, 8, 9), ("b", 3, None, 10, 12)], "book_id string, pos int, printed int, start int, end int")
    assert [r.printed_end for r in P.printed_ends(e).orderBy("pos").collect()] == [5, 4, None]
    issues = spark.createDataFrame([("b", "warning"), ("b", "blocking"), ("b", "blocking")], "book_id string, severity string")
    o = M.overview(M.resolve(e, a), a, issues).first()
    assert (o.entries, o.resolved, o.first_page, o.last_page, o.confirmed, o.warnings, o.blocking) == (3, 2, 5, 5, 2, 1, 2)
    assert [r.sno for r in P.renumbered(e.where("pos > 1")).orderBy("pos").collect()] == [1, 2]
