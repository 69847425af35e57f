"""Chapters from the best source of each book, and exports over a union of keys."""

from pagewright.operators import detect as D
from pagewright.operators import review as R


def test_chapters_from_the_best_source(spark):
    toc = "Contents\n" + "\n".join(f"Title {k} words ..... {10 * k}" for k in range(1, 6))
    pages = []
    for book in ("csv", "toc"):
        pages += [(book, 1, toc)] + [(book, p, f"title {(p - 3) // 10} words begin" if p in (13, 23, 33, 43, 53) else f"text {p}") for p in range(2, 61)]
    pages += [("lines", p, f"Chapter {p // 20 + 1}\ntext" if p % 20 == 1 else "text") for p in range(1, 61)]
    pages += [("none", p, "text") for p in range(1, 13)]
    df = spark.createDataFrame(pages, "book_id string, page int, text string")
    given = spark.createDataFrame([("csv", "One", 5, 1), ("csv", "Two", 25, 2), ("other", "X", 1, 1)], "book_id string, title string, printed int, pos int")
    got = {}
    for r in D.chosen_chapters(df, given).orderBy("book_id", "start").collect():
        got.setdefault((r.book_id, r.way), []).append((r.start, r.end))
    assert got[("csv", "given")] == [(5, 24), (25, 60)]
    # the contents page itself holds "title 1 words", so its page is where the first seed is found
    assert set(got) == {("csv", "given"), ("toc", "contents"), ("lines", "headings"), ("none", "headings")}
    starts = [10 * k - 9 for k in range(1, 6)]
    assert got[("toc", "contents")] == list(zip(starts, [*(s - 1 for s in starts[1:]), 60], strict=True))
    assert got[("lines", "headings")] == [(1, 20), (21, 40), (41, 60)]
    assert got[("none", "headings")] == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12)]
    crop = spark.createDataFrame([(b, 11, 30) for b in ("csv", "lines")] + [("toc", 12, 30)], "book_id string, first_printed int, last_printed int")
    cut = [(r.title, r.start, r.end) for r in D.chosen_chapters(df, given, crop, 2).where("book_id = 'csv'").orderBy("start").collect()]
    assert cut == [("One", 11, 24), ("Two", 25, 30)]


def test_union_of_keys(spark):
    rows = spark.createDataFrame([("b", 1, {"title": "A, a", "x": "1"}), ("b", 2, {"title": "B"}), ("c", 1, {"y": None})], "book_id string, pos int, fields map<string,string>")
    got = sorted((r.book_id, r.pos, r.line) for r in R.union_rendered(rows).collect())
    assert got == [("b", 0, "title,x,y"), ("b", 1, '"A, a",1,'), ("b", 2, "B,,"), ("c", 0, "title,x,y"), ("c", 1, ",,")]
    assert [r.line for r in R.union_rendered(rows.limit(0)).collect()] == ["printed_start,source,title"]
