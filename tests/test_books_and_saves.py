"""The page and word source, snapshots, background jobs and edit logs."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators import edits
from pagewright.sources import books, jobs, snapshots, tables

# --- pages and words ---


def folder(path):
    (path / "a.txt").write_text("\f".join(f"page {i} of a" for i in range(1, 201)) + "\n")
    (path / "b.txt").write_bytes(b"\xff\xfe")
    (path / "c.txt").write_text("only  page\nwith two lines\f\n")
    (path / "_hidden.txt").write_text("no")
    return str(path)


def watching(log):
    """A decoder that leaves a file for each range that it is asked for."""

    def decode(f, first, last):
        import os
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as out:
            out.write(f"{first}-{last}")
        yield from books.plain_leaves(f, first, last)

    return decode


def opened(path):
    return sorted(p.read_text() for p in path.iterdir())


def test_pages_and_words(spark, tmp_path):
    root, log = tmp_path / "books", tmp_path / "log"
    root.mkdir()
    spark.dataSource.register(books.book_source(books.plain_leaves, "leaves", 16))
    got = spark.read.format("leaves").load(folder(root))
    assert got.rdd.getNumPartitions() >= 3
    rows = {(r.file, r.page): (r.text, (r.error or "")[:18]) for r in got.collect()}
    assert rows == {("b.txt", None): (None, "UnicodeDecodeError"), ("c.txt", 1): ("only  page\nwith two lines", ""), ("c.txt", 2): ("", ""), **{("a.txt", i): (f"page {i} of a", "") for i in range(1, 201)}}
    words = spark.read.format("leaves").option("what", "words").option("pattern", "c*").load(str(root)).orderBy("top", "x0").collect()
    assert [(r.text, r.top, r.x0, r.x1) for r in words] == [("only", 0.0, 0.0, 24.0), ("page", 0.0, 36.0, 60.0), ("with", 12.0, 0.0, 24.0), ("two", 12.0, 30.0, 48.0), ("lines", 12.0, 54.0, 84.0)]
    log.mkdir()
    spark.dataSource.register(books.book_source(watching(str(log)), "watched", 16))
    one = lambda file, page: books.one_page(spark, "watched", str(root), file, page).first()
    assert tuple(one("a.txt", 150)) == ("a.txt", 150, "page 150 of a", None, "text") and opened(log) == ["150-150"]
    assert one("c.txt", 2).state == "empty" and one("c.txt", 3).state == one("none", 1).state == "missing" and one("b.txt", 1).state == "unreadable"


def test_filters_reach_the_source(spark, tmp_path):
    root, log = tmp_path / "books", tmp_path / "log"
    root.mkdir()
    log.mkdir()
    spark.dataSource.register(books.book_source(watching(str(log)), "pushed", 16, True))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("pushed").load(folder(root)).where("file = 'a.txt' and page >= 40 and page < 43").collect()
        assert sorted(r.page for r in got) == [40, 41, 42] and opened(log) == ["40-42"]
        got = spark.read.format("pushed").load(str(root)).where("file in ('c.txt', 'x') and page in (2, 5)").collect()
        assert [(r.file, r.page) for r in got] == [("c.txt", 2)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


# --- snapshots ---


def test_two_writers_and_one_version(spark, tmp_path):
    root = str(tmp_path)
    df = lambda n: spark.range(n).withColumn("t", F.lit("x"))
    assert snapshots.load(spark, root, "outline") is None and snapshots.latest(spark, root, "outline") == 0
    assert snapshots.save(df(3), root, "outline", 0) == 1
    results = []

    def write(n):
        try:
            results.append((n, snapshots.save(df(n), root, "outline", 1)))
        except snapshots.Conflict:
            results.append((n, None))

    threads = [threading.Thread(target=write, args=(n,)) for n in (5, 7)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [n for n, v in results if v == 2]
    assert len(won) == 1 and len(results) == 2
    assert snapshots.load(spark, root, "outline").count() == won[0] and snapshots.load(spark, root, "outline", 1).count() == 3
    assert len(list((tmp_path / "outline").glob("data-*"))) == 2  # the other's rows are gone
    bad = df(4).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        snapshots.save(bad, root, "outline", 2)
    with pytest.raises(snapshots.Conflict):
        snapshots.save(df(1), root, "outline", 1)
    assert snapshots.latest(spark, root, "outline") == 2 and len(list((tmp_path / "outline").glob("data-*"))) == 2
    snapshots.prune(spark, root, "outline")
    assert len(list((tmp_path / "outline").glob("data-*"))) == 1 and snapshots.load(spark, root, "outline").count() == won[0]


def test_values(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.load_value(spark, root, "settings", {"theme": "plain"}) == {"theme": "plain"}
    snapshots.save_value(spark, root, "settings", {"theme": "dünkel"}, 0)
    with pytest.raises(snapshots.Conflict):
        snapshots.save_value(spark, root, "settings", 1, 0)
    with pytest.raises(snapshots.Conflict):
        snapshots._commit(spark, root, "settings", 1, {"value": 2})  # claimed meanwhile
    assert snapshots.load_value(spark, root, "settings") == {"theme": "dünkel"}
    assert not [p for p in (tmp_path / "settings" / "commits").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


# --- jobs ---

SECTIONS = "book_id string, sno int, title string, start int, end int, text string"


def test_jobs(spark, tmp_path):
    done = jobs.Job(spark, lambda job: spark.range(100).repartition(3).count(), "count")
    assert done.result() == 100 and done.status == "completed"
    p = done.progress()
    assert p.done == p.total > 0 and p.title == "count"
    failed = jobs.Job(spark, lambda job: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failed.result()
    assert failed.status == "failed"


def test_a_cancelled_run_publishes_nothing(spark, tmp_path):
    slow = F.udf(lambda i: time.sleep(0.5) or "text", "string")
    sections = spark.range(0, 400, 1, 2).select(F.lit("b").alias("book_id"), F.col("id").cast("int").alias("sno"), F.lit("t").alias("title"), F.lit(1).alias("start"), F.lit(1).alias("end"), slow("id").alias("text"))
    job = jobs.Job(spark, lambda job: tables.publish_run(sections, str(tmp_path), "r1", "2024-01-01 00:00:00"), "run")
    while job.progress().total == 0 and job.status == "running":
        time.sleep(0.1)
    assert job.status == "running"
    job.cancel()
    with pytest.raises(jobs.Cancelled):
        job.result()
    assert job.status == "cancelled"
    assert not list(tmp_path.glob("runs/run_id=*")) and not list(tmp_path.glob("history/*"))
    few = spark.createDataFrame([("b", 1, "t", 1, 1, "x")], SECTIONS)
    tables.publish_run(few, str(tmp_path), "r2", "2024-01-01 00:00:00")
    assert [r.run_id for r in tables.read_sections(spark, str(tmp_path)).collect()] == ["r2"]
    with pytest.raises(FileExistsError):
        tables.publish_run(few, str(tmp_path), "r2", "2024-01-01 00:00:00")


def test_run_ids(spark):
    ids = [r.i for r in spark.range(50).select(tables.run_id().alias("i")).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 21 and i[8] == "-" and i[:8].isdigit() and int(i[9:], 16) >= 0 for i in ids)


# --- edits ---


def by_list(entries, log):
    """What a list gives that takes the edits one by one."""
    own = [e for e in sorted(entries, key=lambda e: e[2])]
    ids, values, at_end = [e[1] for e in own], {e[1]: e[3] for e in own}, []
    for _, _, op, new, after in sorted(log, key=lambda x: x[1]):
        if op == "delete":
            ids.remove(new)
            continue
        if op == "move" and new != after:
            ids.remove(new)
        elif op == "move":
            continue
        values.setdefault(new, values[after] if op == "duplicate" else f"added {new}")
        ids.insert(0 if after is None else ids.index(after) + 1, new)
    return [(i, values[i]) for i in [*ids, *at_end]]


@pytest.mark.parametrize("seed", [1, 2])
def test_edit_logs_equal_a_list(spark, seed):
    rng = np.random.default_rng(seed)
    entries, log, added, want = [], [], [], {}
    for b in range(4):
        book = f"b{b}"
        own = [(book, f"e{i}", i, f"title {i}") for i in range(rng.integers(1, 12))]
        alive, edits_of = [e[1] for e in own], []
        for seq in range(60):
            op = str(rng.choice(["add", "move", "duplicate", "delete"], p=[0.3, 0.35, 0.2, 0.15]))
            pick = lambda: str(rng.choice(alive))
            if op == "add":
                edits_of.append((book, seq, op, f"n{seq}", None if rng.random() < 0.2 or not alive else pick()))
                added.append((book, f"n{seq}", f"added n{seq}"))
                alive.append(f"n{seq}")
            elif alive and op == "duplicate":
                edits_of.append((book, seq, op, f"c{seq}", pick()))
                alive.append(f"c{seq}")
            elif alive and op == "move":
                edits_of.append((book, seq, op, pick(), None if rng.random() < 0.2 else pick()))
            elif len(alive) > 1 and op == "delete":
                gone = pick()
                edits_of.append((book, seq, op, gone, None))
                alive.remove(gone)
        entries += own
        log += edits_of
        want[book] = by_list(own, edits_of)
    got = edits.applied(spark.createDataFrame(entries, "book_id string, id string, pos int, title string"), spark.createDataFrame(log, "book_id string, seq int, op string, id string, after string"), spark.createDataFrame(added, "book_id string, id string, title string"))
    rows = {}
    for r in sorted(got.collect(), key=lambda r: (r.book_id, r["rank"])):
        rows.setdefault(r.book_id, []).append((r.id, r.title))
    assert rows == want


def test_edits_clear_approval(spark):
    log = spark.createDataFrame([("a", 5, "add", 1, 3, None), ("a", 6, "remove", 7, 9, None), ("b", 2, "remove", 1, 1, None), ("b", 3, "add", 1, 1, True)], "book_id string, seq int, op string, printed int, physical int, exception boolean")
    approvals = spark.createDataFrame([("a", 5), ("b", 3), ("c", 0)], "book_id string, approved_seq int")
    assert sorted(r.book_id for r in edits.edited_approvals(approvals, log).collect()) == ["b", "c"]
    anchors = spark.createDataFrame([("a", 7, 9, False), ("a", 8, 10, False), ("b", 1, 1, False)], "book_id string, printed int, physical int, exception boolean")
    assert sorted(map(tuple, edits.edited_anchors(anchors, log).collect())) == [("a", 1, 3, False), ("a", 8, 10, False), ("b", 1, 1, True)]


def test_revalidation_equals_the_whole(spark):
    rng = np.random.default_rng(3)
    schema = "book_id string, pos int, sno int, title string, source_sno string, parent_sno string, start int"
    rows = [(f"b{b}", i, int(rng.integers(1, 9)), str(rng.choice(["A", "B", "", "C"])), f"{i}", f"{rng.integers(0, i + 1)}" if i else "", int(rng.integers(1, 30))) for b in range(6) for i in range(10)]
    log = [(f"b{rng.integers(0, 4)}", seq, int(rng.integers(0, 10)), *[("title", "Z"), ("sno", "3"), ("source_sno", f"x{seq}"), ("parent_sno", "q"), ("start", "2")][rng.integers(0, 5)]) for seq in range(40)]

    def rule(df):
        many = F.count("*").over(Window.partitionBy("book_id", "sno")) > 1
        known = df.select("book_id", F.col("source_sno").alias("parent_sno")).distinct()
        orphan = df.where("parent_sno <> ''").join(known, ["book_id", "parent_sno"], "left_anti").select("book_id", "pos", F.lit("orphan_parent").alias("code"))
        found = df.withColumn("many", many).select("book_id", "pos", F.when(F.col("many"), "duplicate_sno").alias("a"), F.when(F.col("title") == "", "missing_title").alias("b"))
        return found.select("book_id", "pos", F.explode(F.array_compact(F.array("a", "b"))).alias("code")).unionByName(orphan)

    df, edit = spark.createDataFrame(rows, schema), spark.createDataFrame(log, "book_id string, seq int, pos int, field string, value string")
    now, issues = edits.revalidated(df, rule(df), edit, rule)
    key = lambda d: sorted(map(tuple, d.select("book_id", "pos", "code").collect()))
    assert key(issues) == key(rule(now))
    # the cascade, one edit after the other
    body = {(r[0], r[1]): list(r) for r in rows}
    for book, pos in {(x[0], x[2]) for x in log}:
        for field, at in (("title", 3), ("sno", 2), ("start", 6), ("parent_sno", 5), ("source_sno", 4)):
            values = [x[4] for x in sorted(log, key=lambda x: x[1]) if x[:1] == (book,) and x[2] == pos and x[3] == field]
            if values:
                body[book, pos][at] = int(values[-1]) if at in (2, 6) else values[-1]
    for b, i, *_, parent, _ in rows:
        edited = any(x[0] == b and x[2] == i and x[3] == "parent_sno" for x in log)
        if parent and not edited:
            body[b, i][5] = body[b, int(parent)][4]
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, body.values()))
