"""Detection of outlines on literal pages, and caption merging against plain Python on random lines."""

import random
import re

from pagewright.operators import detect as D

PAGES = "book_id string, page int, text string"
BOOKS = "book_id string, page_count int, offset int, first int, last int"


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def merged(lines):
    """The greedy rule, line by line: [(text, ...)] in order."""
    caption = re.compile(r"(map|chart|figure|table|plate)\s+(\d+[a-z]?)\b[:\-]?\s*(.*)", re.I)
    out, i = [], 0
    while i < len(lines):
        m = caption.fullmatch(lines[i])
        after = lines[i + 1] if i + 1 < len(lines) else None
        if m and after is not None and not caption.fullmatch(after) and not re.match(r"(part ([ivxlc]+|\d+)|chapter (\d+|[ivxlc]+))\b", after, re.I) and not re.fullmatch(r"\d{1,4}", after):
            out.append(f"[{m[1].upper()}] {m[1].title()} {m[2]}: {m[3].strip() or after}")
            i += 1
        else:
            out.append(lines[i])
        i += 1
    return out


def test_captions(spark):
    r = random.Random(5)
    kinds = ["MAP 1", "Table 2b: Seas", "Chapter 3", "Part IV", "17", "Some title", "Zone 4", "Introduction"]
    books = {f"b{i}": [r.choice(kinds) for _ in range(r.randint(1, 9))] for i in range(60)}
    df = spark.createDataFrame([(b, 1, i, float(i), t) for b, ls in books.items() for i, t in enumerate(ls)], "book_id string, page int, line_no int, top double, text string")
    got = D.merge_captions(df).orderBy("book_id", "line_no").collect()
    assert {b: [x.text for x in got if x.book_id == b] for b in books} == {b: merged(ls) for b, ls in books.items()}


def test_contents(spark):
    text = "Table of Contents\nOne .... 3\none .... 3\nTwo ..... 9\nNo leader 12\nab .. 4\nThree .. 11"
    p = spark.createDataFrame([("b", 1, None), ("b", 2, text), ("b", 3, "Four ... 20"), ("b", 5, "Five ... 30"), ("c", 1, "Six ... 1")], PAGES)
    assert rows(D.contents_entries(p), "start") == [("b", "one", 3), ("b", "Two", 9), ("b", "Three", 11), ("b", "Four", 20)]
    assert rows(D.contents_run(p), "page") == [("b", 2)]
    assert rows(D.run_entries(p, D.contents_run(p)).select("title", "start"), "pos")[:3] == [("One", 3), ("Two", 9), ("ab", 4)]


def test_entries_on_split_lines(spark):
    p = spark.createDataFrame([("b", 1, "Contents"), ("b", 2, "First\nchapter\n1\nSecond\n20\n7"), ("b", 3, "Lost\n40\nKept 50")], PAGES)
    assert rows(D.run_entries(p, p.select("book_id", "page")).select("title", "start"), "pos") == [("First chapter", 1), ("Second", 20), ("Kept", 50)]


def test_detected_outline(spark):
    w = "book_id string, page int, text string, top double, x0 double, x1 double, fontname string, size double"
    words = [("b", 1, t, float(top), x, x + 40.0, f, s) for t, top, x, f, s in [("CHAPTER", 10, 10.0, "T", 9.0), ("1", 10.5, 60.0, "T", 9.0), ("Big", 30, 10.0, "T", 20.0), ("plain", 50, 10.0, "T", 9.0), ("mid", 70, 130.0, "T-Bold", 9.0), ("12", 90, 130.0, "T-Bold", 9.0)]]
    pages = spark.createDataFrame([("b", 1, "Contents\nBig .... 7"), ("b", 2, None)], PAGES)
    out = D.detect_outline(pages, spark.createDataFrame(words, w), spark.createDataFrame([("b", 1, 300.0)], "book_id string, page int, width double"))
    assert rows(out.select("title", "start", "kind"), "start", "y") == [("Chapter 1", 1, "heading"), ("Big", 1, "heading"), ("mid", 1, "heading")]
    assert rows(D.draft_entries(out).select("sno", "printed", "physical", "confidence"), "sno")[0] == (1, None, 1, 0.55)


def test_seeds(spark):
    seeds = spark.createDataFrame([("b", "A one", 1, 0), ("b", "B", 5, 1), ("b", "C", 5, 2), ("b", "D", 99, 3)], "book_id string, title string, printed int, pos int")
    books = spark.createDataFrame([("b", 20, 2, 4, 15)], BOOKS)
    assert rows(D.chapters_from_seeds(seeds, books), "start") == [("b", "A one", 1, 4, 6), ("b", "C", 5, 7, 15)]
    p = spark.createDataFrame([("b", i, "see A ONE" if i in (4, 9) else "x") for i in range(1, 21)], PAGES)
    assert rows(D.inferred_offset(p, seeds), "book_id") == [("b", 3)]


def test_chapters_by_heading(spark):
    p = spark.createDataFrame([("b", i, "x\nChapter 7\nChapter 8" if i in (3, 6) else None) for i in range(1, 9)] + [("c", i, "y") for i in range(1, 9)], PAGES)
    books = spark.createDataFrame([("b", 8, 0, 2, 7), ("c", 8, 0, 1, 8)], BOOKS)
    got = D.chapters_by_heading(p, books, 3)
    assert rows(got, "book_id", "start") == [("b", "Chapter 7", 3, 5), ("b", "Chapter 7", 6, 7), ("c", "Chapter 1", 1, 2), ("c", "Chapter 2", 3, 4), ("c", "Chapter 3", 5, 8)]
    text = D.range_text(p, got.where("book_id = 'b' and start = 3"))
    assert text.first().text == "x\nChapter 7\nChapter 8\n\n"
    assert D.chapters_by_heading(p.limit(0), books.limit(0)).count() == 0


def test_scan(spark):
    index = "\n".join(f"term{i}, {i}" for i in range(9))
    p = spark.createDataFrame([("b", 1, "Contents"), ("b", 2, "plain"), ("b", 30, index), ("b", 31, "INDEX"), ("b", 15, "index")], PAGES)
    assert rows(D.scan_pages(p).select("page", "source", "confidence"), "page") == [(1, "toc", 0.9), (30, "index", 0.65), (31, "index", 0.65)]
