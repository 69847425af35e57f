"""Rules on literal books: what needs anchors, what passes, and the gates."""

from pyspark.sql import functions as F

from pagewright.operators import pages as P
from pagewright.operators import parse, rules

OUTLINE = "book_id string, sno int, title string, kind string, printed int, label string, physical int, pdf_index int, include boolean, allow_extraction boolean"
ANCHORS = "book_id string, printed int, physical int, pdf_index int, exception boolean"
STATE = "book_id string, present boolean, hash_ok boolean, outline_approved boolean, mapping_approved boolean, approval_pdf_ok boolean, approval_outline_ok boolean"


def codes(df):
    return sorted((r.book_id, r.code) for r in df.collect())


def row(book, sno, printed=None, label=None, physical=None, index=None, include=True, kind="chapter"):
    return (book, sno, f"T{sno}", kind, printed, label, physical, index, include, True)


def test_a_page_of_some_kind_is_enough(spark):
    o = spark.createDataFrame([row("a", 1, label="ix"), row("a", 2, physical=4, index=3), row("b", 1, physical=4), row("c", 1, physical=4, index=9), row("d", 1, printed=0, include=False), row("d", 2, 3, kind="odd")], OUTLINE)
    books = o.select("book_id").distinct().withColumn("page_count", F.lit(9))
    assert codes(rules.outline_issues(o, books)) == [("a", "outline_valid"), ("b", "invalid_printed_start"), ("c", "invalid_printed_start"), ("d", "unknown_kind")]


def test_supplied_pages_need_no_anchors(spark):
    o = spark.createDataFrame([row("a", 1, 3, physical=4, index=3), row("b", 1, 3, physical=4, index=9), row("x", 1, 3)], OUTLINE)
    books = o.select("book_id").distinct().withColumn("page_count", F.lit(9))
    entries = o.select("book_id", "sno", "printed", "include", F.col("physical").alias("given_physical"), F.col("pdf_index").alias("given_index"))
    anchors = spark.createDataFrame([("x", 3, 5, 4, True)], ANCHORS)
    want = [("a", "mapping_valid"), ("b", "offset_unresolved"), ("b", "two_anchors_required"), ("b", "uncovered_entry"), ("x", "two_anchors_required")]
    assert codes(rules.mapping_issues(anchors, entries, books)) == want


def test_preflight(spark):
    o = spark.createDataFrame([row(b, n, n, physical=p, index=p - 1) for b in "abc" for n, p in ((1, 2), (2, 6 if b == "b" else 2), (3, 5))], OUTLINE)
    books = o.select("book_id").distinct().withColumn("page_count", F.lit(9))
    state = spark.createDataFrame([("a", True, True, True, True, None, True), ("b", True, True, True, True, False, False), ("c", False, True, True, True, True, True)], STATE)
    got = codes(rules.preflight_issues(o, spark.createDataFrame([], ANCHORS), books, state))
    assert got == [("a", "preflight_passed"), ("b", "approval_pdf_mismatch"), ("b", "non_monotonic_physical"), ("b", "outline_hash_mismatch"), ("c", "pdf_missing")]
    assert rules.preflight_issues(o.limit(0), spark.createDataFrame([], ANCHORS), books.limit(0), state.limit(0)).count() == 0


def test_gates(spark):
    books = spark.createDataFrame([("a",), ("b",), ("c",)], "book_id string")
    issues = spark.createDataFrame([("a", "warning"), ("b", "blocking")], "book_id string, severity string")
    assert {tuple(r) for r in rules.approve(books, issues, books.where("book_id = 'c'")).collect()} == {("a", "approved"), ("b", "blocked"), ("c", "already_approved")}
    rows = spark.createDataFrame([("a", 1, 2), ("a", 3, None), ("b", 1, 2), ("c", None, None)], "book_id string, physical_start int, physical_end int")
    assert {tuple(r) for r in rules.extractable(rows, books.where("book_id <> 'c'")).collect()} == {("a", "unresolved_rows"), ("b", "extract"), ("c", "mapping_not_approved")}
    got = spark.createDataFrame([("uncovered_entry",), ("other",)], "code string").select(rules.suggested_action(F.col("code")).alias("t")).collect()
    assert [r.t for r in got] == ["Pair a printed page close to this entry.", ""]


def test_shape_of_json_rows(spark):
    text = '[{"sno": "1", "title": "A", "colour": 1, "children": [{"sno": "2", "include": "yes"}, 7]}, "x", {"children": 3, "source": " "}, {"children": null, "include": false, "source": "toc"}, {"source": null, "include": null}]'
    flat = parse.flatten_json(spark.createDataFrame([("b", text)], "book_id string, outline string"))
    got = {(r.code, r.key) for r in rules.json_shape_issues(flat).collect()}
    assert got == {
        ("unknown_key", "$[0].colour"), ("invalid_include", "$[0].children[0].include"), ("row_not_object", "$[0].children[1]"), ("row_not_object", "$[1]"), ("invalid_children", "$[2].children"),
        ("invalid_source", "$[2].source"), ("invalid_source", "$[4].source"), ("invalid_include", "$[4].include"),
    }


def test_flattening_has_no_bottom(spark):
    deep = '{"sno": "9", "title": "[leaf \\"]"}'
    for i in range(8, 0, -1):
        sno = f'"sno": "{i}", ' if i != 5 else ""
        deep = f'{{{sno}"children": [{deep}]}}'
    flat = parse.flatten_json(spark.createDataFrame([("b", f"[{deep}]"), ("c", None), ("d", "[]")], "book_id string, outline string")).collect()
    assert {r.depth: (r.sno, r.parent_sno) for r in flat} == {i: (None if i == 5 else str(i), None if i == 1 else str(i - 1) if i != 6 else "4") for i in range(1, 10)}


def test_outline_text_has_parents_and_codes(spark):
    text = "Part One: Begin\nChapter 1 Start .... 5\n1.1 Start .... 6\n\"A, title\", 123456\n1.1.1 Deep xiv"
    got = {r.pos: r for r in parse.parse_outlines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    byline = {r.title: r for r in got.values()}
    assert byline["A, title"].page == 123456
    part = next(r for r in got.values() if r.kind == "part")
    chapter = next(r for r in got.values() if r.kind == "chapter")
    assert chapter.parent_pos == part.pos and chapter.level == 2
    assert any("roman_page" in r.codes for r in got.values())


def test_parents_of_any_level(spark):
    rows = [("b", i, lv) for i, lv in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 7, 20])]
    df = P.parents_by_level(spark.createDataFrame(rows, "book_id string, pos int, level int"))
    assert [r.parent_pos for r in df.orderBy("pos").collect()] == [None, 0, 1, 2, 3, 4, 5, 6, 7, 8, 5, 10]
    hit = P.matching_with_ancestors(df, F.col("pos") == 9)
    assert sorted(r.pos for r in hit.collect()) == list(range(10))


def test_outline_documents(spark):
    texts = [("list", '[{"sno": "1", "title": "A"}]'), ("object", '{"book": {"title": "T", "author": null}, "outline": [{"sno": "1", "children": [{"sno": "2"}]}], "x": 1}'), ("bad", "{"), ("none", None), ("word", '"x"'), ("empty", "{}"), ("odd", '{"book": 3, "outline": []}')]
    docs = parse.json_documents(spark.createDataFrame(texts, "book_id string, json string"))
    assert {r.book_id: (r.root, r.title, r.refused) for r in docs.collect()} == {
        "list": ("$", None, None), "object": ("$.outline", "T", None), "bad": ("$", None, "malformed_json"), "none": ("$", None, "malformed_json"), "word": ("$", None, "no_outline_root"), "empty": ("$", None, "no_outline_list"), "odd": ("$.outline", None, None),
    }
    assert sorted((r.book_id, r.path) for r in parse.flatten_json(docs).collect()) == [("list", "$[0]"), ("object", "$.outline[0]"), ("object", "$.outline[0].children[0]")]
    assert {(r.book_id, r.code, r.key) for r in rules.json_document_issues(docs).collect()} == {
        ("bad", "malformed_json", "$"), ("none", "malformed_json", "$"), ("word", "no_outline_root", "$"), ("empty", "no_outline_list", "$"), ("object", "unknown_key", "$.x"), ("odd", "invalid_book_metadata", "$.book"),
    }
