"""Operators on literal cases, and against plain Python on random ones."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import analytics as A
from pagewright.operators import mapping as M
from pagewright.operators import merge, pages, parse, rules
from pagewright.sources import tables
from pagewright.streaming import index


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "f, given, want",
    [
        (T.normalize_title, "  A\t–  b ", "A — b"), (T.normalize_title, None, ""), (T.merge_key, "Straße: 2!", "strasse 2"), (T.merge_key, "—", ""),
        (T.slugify, "[TAG] A — b / c", "a_b_c"), (T.slugify, " !? ", "section"), (T.slugify, "x" * 99, "x" * 80), (T.clean_text, "Don't – stop, NOW", "don't stop now"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, given, f) == want


def test_labels_and_structure(spark):
    assert tuple(one(spark, " 12 ", T.page_label)) == (12, "12", None)
    assert tuple(one(spark, "VII", T.page_label)) == (None, "vii", "roman_page")
    assert tuple(one(spark, "p. 3", T.page_label)) == (None, "p. 3", "ambiguous_page")
    assert tuple(one(spark, "Chapter two: x", T.structure)) == ("chapter", 2, True)
    assert tuple(one(spark, "1.2.3 x", T.structure)) == ("section", 3, True)
    assert tuple(one(spark, "References", T.structure)) == ("bibliography", 1, False)
    assert tuple(one(spark, "MAP 2A: Sea", T.standard_heading)) == ("[MAP] Map 2A: Sea", "caption")
    assert one(spark, "Title ...... 12", T.toc_line).page == 12
    assert one(spark, "Title 12", T.toc_line) is None
    assert tuple(one(spark, "3:9", T.printed_range)) == (3, 9) and one(spark, "9:3", T.printed_range) is None
    assert one(spark, 1234, lambda c: T.section_filename(c, F.lit("a")), "int") == "1234_a.txt"


def test_ranges(spark):
    df = spark.createDataFrame([("b", i, s, 20) for i, s in enumerate([3, 3, 8])], "book_id string, pos int, start int, max_page int")
    ends = lambda f: [(r.start, r.end) for r in f(df).orderBy("pos").collect()]
    assert ends(pages.ranges_to_next_start) == [(3, 7), (3, 7), (8, 20)] == ends(pages.ranges_of_sorted)
    assert ends(pages.ranges_to_next_row) == [(3, 3), (3, 7), (8, 20)]


def test_ordinals(spark):
    r = random.Random(2)
    rows = [("a" if r.random() < 0.7 else "b", x) for x in r.sample(range(10_000), 900)]
    got = pages.numbered(spark.createDataFrame(rows, "g string, k int"), "g", "k", "n").collect()
    want = {(g, k): i + 1 for g in "ab" for i, k in enumerate(sorted(k for h, k in rows if h == g))}
    assert {(x.g, x.k): x.n for x in got} == want


def test_extraction(spark):
    p = spark.createDataFrame([("b", i + 1, t) for i, t in enumerate(["alpha page", "middle", " ", "beta phrase", "last"])], "book_id string, page int, text string")
    o = spark.createDataFrame([("b", 1, "A", 1, 3), ("b", 2, "B", 3, 5), ("c", 1, "C", 1, 1)], "book_id string, sno int, title string, start int, end int")
    s = pages.extract_sections(p, o)
    assert {(r.book_id, r.sno): r.text for r in s.collect()} == {("b", 1): "alpha page\n\nmiddle", ("b", 2): "beta phrase\n\nlast", ("c", 1): ""}
    assert [r.sno for r in pages.search(s, "BETA phrase").collect()] == [2]
    assert pages.search(s).count() == 3
    assert {r.status for r in pages.manifest(s, "r").where("book_id = 'c'").collect()} == {"skipped"}


A4 = "book_id string, printed int, physical int, exception boolean"


@pytest.mark.parametrize(
    "anchors, page, want",
    [
        ([(1, 3), (10, 12)], 7, (9, "segment")), ([(1, 3), (10, 12)], 99, (101, "extrapolated")), ([(1, 3), (10, 13)], 5, (None, "unresolved")), ([(1, 3), (1, 4)], 1, (None, "unresolved")),
        ([(1, 3), (5, 7), (1000, 1010), (1010, 1020)], 1005, (1015, "segment")), ([(1, 3), (5, 7), (1000, 1010), (1010, 1020)], 500, (None, "unresolved")), ([(1, 3), (10, 12)], 10, (12, "anchor")),
    ],
)
def test_mapping(spark, anchors, page, want):
    a = spark.createDataFrame([("b", x, y, False) for x, y in anchors], A4)
    r = M.resolve(spark.createDataFrame([("b", page)], "book_id string, printed int"), a).first()
    assert (r.physical, r.method) == want


def test_mapping_exception_and_supplied(spark):
    a = spark.createDataFrame([("b", 1, 3, False), ("b", 10, 12, False), ("b", 7, 50, True)], A4)
    e = spark.createDataFrame([("b", 7, None, None), ("b", 8, 47, 46), ("b", 8, 30, 99), ("b", None, 5, None)], "book_id string, printed int, given_physical int, given_index int")
    got = {(r.physical, r.method) for r in M.resolve_entries(e, a).collect()}
    assert got == {(50, "exception"), (47, "supplied"), (10, "segment"), (5, "physical_only")}


def test_lines_keep_to_their_first_word(spark):
    r = random.Random(4)
    words = [("b", 1, f"w{i}", round(r.uniform(0, 60), 2), float(i), i + 1.0, "Bold" if i % 2 else "Roman", 10.0) for i in range(80)]
    df = spark.createDataFrame(words, "book_id string, page int, text string, top double, x0 double, x1 double, fontname string, size double")
    lines: list[list] = []
    for w in sorted(words, key=lambda w: (w[3], w[4])):
        if lines and abs(w[3] - lines[-1][0][3]) <= 3:
            lines[-1].append(w)
        else:
            lines.append([w])
    want = [" ".join(w[2] for w in sorted(x, key=lambda w: w[4])) for x in lines]
    assert [x.text for x in pages.cluster_lines(df).orderBy("line_no").collect()] == want


def test_outline_text():
    rows = parse.outline_rows("Contents\nAlpha .......... 3\nBeta\ngamma 18\nThird 225")
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [("Contents", "", "running_header", False), ("Alpha", "3", "dotted_leader", True), ("Beta gamma", "18", "plain_title_page", True), ("Third", "225", "plain_title_page", True)]
    assert parse.outline_rows("1,Perspective,1")[0][:3] == ("Perspective", "1", "delimited")
    assert parse.outline_rows("Preface vii")[0][:3] == ("Preface", "vii", "plain_title_page")
    assert [r[2] for r in parse.outline_rows("Chapter 1\nThe start\n17")] == ["multiline"]
    assert parse.outline_rows("") == []


def test_parts_take_a_childs_page(spark):
    df = parse.parse_outlines(spark.createDataFrame([(1, "Part I Origins\nChapter 1 First ... 5\nChapter 2 Next ... 9\nPart II\tEnds"), (2, None)], "doc_id long, text string"))
    got = [(r.kind, r.level, r.page, r.inferred) for r in df.orderBy("pos").collect()]
    assert got[:3] == [("part", 1, 5, True), ("chapter", 2, 5, False), ("chapter", 2, 9, False)]


def test_near_titles_miss_nothing(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(3, 7)))
    draft = [("b", i, i, " ".join(word() for _ in range(r.randint(1, 4))), "section", 1, i) for i in range(60)]
    cand = []
    for i in range(60):
        t = list(draft[i][3])
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randint(0, 1)] = r.choice(["", "z", "q"])
        cand.append(("b", i, None, "".join(t), "section", 1, None))
    cols = "book_id string, pos int, sno int, title string, kind string, level int, printed int"
    got = {x.cand_pos: x.d.pos for x in merge.near_titles(spark.createDataFrame(cand, cols), spark.createDataFrame(draft, cols)).collect()}
    key = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
    want = {c[1]: next((d[1] for d in draft if difflib.SequenceMatcher(None, key(c[3]), key(d[3])).ratio() >= 0.9), None) for c in cand}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_merge(spark):
    cols = "book_id string, pos int, sno int, title string, kind string, level int, printed int"
    draft = spark.createDataFrame([("b", 1, 1, "Perspective", "section", 1, 4)], cols)
    cand = spark.createDataFrame([("b", 1, 1, "Perspective", "section", 1, 1, True, False), ("b", 2, None, "Elsewhere", "section", 1, 9, True, False), ("b", 3, None, "Out", "section", 1, 2, False, False)], cols + ", include boolean, sno_explicit boolean")
    a = merge.analyse(draft, cand)
    assert {r.pos: r.category for r in a.collect()} == {1: "conflict", 2: "new", 3: "ignored"}
    assert {(r.sno, r.printed) for r in merge.apply(draft, a).collect()} == {(1, 4), (2, 9)}
    use = spark.createDataFrame([("b", 1, "use_candidate")], "book_id string, pos int, action string")
    assert {(r.sno, r.printed) for r in merge.apply(draft, a, use).collect()} == {(1, 1), (2, 9)}


def test_rules_pass_when_nothing_is_wrong(spark):
    o = spark.createDataFrame([("b", 1, "A", "chapter", 1, 3, True, True)], "book_id string, sno int, title string, kind string, printed int, physical int, include boolean, allow_extraction boolean")
    books = spark.createDataFrame([("b", 9), ("e", 9)], "book_id string, page_count int")
    assert {(r.book_id, r.code) for r in rules.outline_issues(o, books).collect()} == {("b", "outline_valid"), ("e", "empty_outline")}


def test_text_repair(spark):
    text = spark.createDataFrame([("an exam- ple of long-  term pol­icy, a- bout x- y",), (None,)], "text string")
    assert [r.text for r in A.dehyphenated(text).collect()] == ["an example of long- term policy, a- bout x- y", None]
    df = spark.createDataFrame([(1, "aa bb cccccccccc dd")], "k int, t string")
    assert [r.chunk for r in A.wrapped(df, "t", 5).orderBy("chunk_no").collect()] == ["aa bb", "cccccccccc", "dd"]
    text = "One two.  Three four!\n\n \nAn exam-\nple of it. Last words here go on.\n\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "k int, t string")
    got = lambda **how: [(r.k, r.chunk_no, r.chunk) for r in A.wrapped(df, "t", **how).orderBy("k", "chunk_no").collect()]
    assert got(width=16) == [(1, 0, "One two."), (1, 1, "Three four!"), (1, 2, "An example of"), (1, 3, "it."), (1, 4, "Last words here"), (1, 5, "go on.")]
    assert got(oneline=True) == [(1, 0, "One two. Three four!"), (1, 1, "An example of it. Last words here go on.")]
    assert got(oneline=True, join_split_words=False)[1] == (1, 1, "An exam- ple of it. Last words here go on.")


def test_weights_by_hand(spark):
    import math

    rows = [("g", 1, ["a", "b", "a"]), ("g", 2, ["a", "c"]), ("g", 3, []), ("h", 4, ["c"]), ("h", 5, None)]
    df = spark.createDataFrame(rows, "g string, u int, t array<string>")
    assert sorted(map(tuple, A.counted(df, "g", "u", F.col("t")).collect())) == [("g", 1, "a", 2), ("g", 1, "b", 1), ("g", 2, "a", 1), ("g", 2, "c", 1), ("h", 4, "c", 1)]
    idf = lambda n, k: math.log((1 + n) / (1 + k)) + 1
    a, b, c = idf(3, 2), idf(3, 1), idf(3, 1)
    one, two = math.hypot(2 * a, b), math.hypot(a, c)
    want = {("g", "a"): (2 * a / one + a / two) / 3, ("g", "b"): b / one / 3, ("g", "c"): c / two / 3, ("h", "c"): 0.5}
    got = {(r.g, r.term): r.score for r in A.weighted_top(df, "g", "u", F.col("t"), min_df=1).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert {r.term for r in A.weighted_top(df, "g", "u", F.col("t"), min_df=1, vocabulary=spark.createDataFrame([("c",)], "term string")).collect()} == {"c"}


def test_sources(spark, tmp_path):
    (tmp_path / "o.csv").write_text("Sno,title,printed_start,physical_start\n2,Heading,,9\n1,Both,3,9\n3,,4,\n")
    got = [tuple(r) for r in tables.read_starts(spark, str(tmp_path / "o.csv")).collect()]
    assert got == [(1, "Both", 3, False), (2, "Heading", 9, True)]
    s = spark.createDataFrame([("b", 1, "A", 1, 2, "alpha beta beta"), ("b", 2, "B", 3, 4, "")], tables.SECTION)
    tables.publish_run(s, str(tmp_path), "r1", "2024-01-01 00:00:00")
    s.write.json(str(tmp_path / "runs" / "run_id=r2"))  # never completed
    assert tables.read_sections(spark, str(tmp_path)).count() == 2
    assert tables.read_sections(spark, str(tmp_path), "r2").count() == 0
    assert tables.read_runs(spark, str(tmp_path)).first().written_count == 1
    q = index.keep_index(index.section_stream(spark, str(tmp_path / "runs" / "run_id=r1")), str(tmp_path / "index"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r.term, r.n) for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {("alpha", 1), ("beta", 2)}


def test_merge_inputs_take_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    from pagewright.plans import corpus

    draft, cand = corpus._merge_inputs(spark, sf)
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    assert draft.union(cand.select(draft.columns)).select("pos").distinct().count() == draft.count() + cand.count() == n
    assert corpus.merge_fuzzy(spark, sf).count() == cand.count()
