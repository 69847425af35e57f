"""Edits of outlines and anchors as logs, and what hangs on them.

A log(book_id, seq, op, id, after) is applied to entries(book_id, id, pos, ...): add and move put an entry behind another (null: at
the front), duplicate adds a copy `id` behind `after`, delete takes an entry away. seq orders a book's edits; ids are
never used again.

Each place where an entry is put is a node below the place of the entry it was put behind, at that time. Reading the
nodes from above, later ones first, gives what a list gives that takes the edits one by one; nodes from which an entry was moved or
deleted hold their places but show nothing. So the order is a sort by path, and paths are found by pointer
doubling: no task takes a book's edits one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.shared import discard, written

LATEST = (1 << 62) - 1


def _paths(nodes: DataFrame) -> DataFrame:
    """nodes(book_id, node, up, own) -> (book_id, node, path): own keys from the root down, by pointer doubling."""
    now = written(nodes.select("book_id", "node", "up", F.col("own").alias("path")), "edit-paths")
    for _ in range(now.count().bit_length() + 1):
        if now.where("up is not null").isEmpty():
            break
        above = now.select(F.col("book_id").alias("b"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        on = now["book_id"].eqNullSafe(above["b"]) & (now["up"] == above["n"])
        more = written(now.join(above, on, "left").select("book_id", "node", F.col("up2").alias("up"), F.concat(F.coalesce("path2", F.lit("")), "path").alias("path")), "edit-paths")
        discard(now)
        now = more
    return now.select("book_id", "node", "path")


def applied(entries: DataFrame, log: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """The entries after the log, with rank, a string that orders a book's entries, in place of pos.

    added(book_id, id, ...) holds what add brings, with the columns of entries but pos. A copy has its source's columns. Edits that name an entry
    that isn't there (not yet, or no more) put their entry at the end of the book.
    """
    fields = [c for c in entries.columns if c != "pos"]
    puts = log.where("op in ('add', 'duplicate', 'move')")
    base = entries.select("book_id", "id", F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("1"), F.format_string("%020d", F.col("pos").cast("long"))).alias("own"))
    later = F.format_string("%020d", F.lit(LATEST) - F.col("seq"))
    node = F.struct("id", "seq")
    places = base.select("book_id", "id", "seq").union(puts.select("book_id", "id", F.col("seq").cast("long")))
    # the place of the entry behind which it was put: its last one before that edit
    asked = puts.where("after is not null").select("book_id", F.col("after").alias("id"), F.col("seq").cast("long").alias("at"), F.lit(None).cast("long").alias("seq"))
    line = places.select("book_id", "id", F.col("seq").alias("at"), "seq").union(asked)
    seen = F.last("seq", ignorenulls=True).over(Window.partitionBy("book_id", "id").orderBy("at", F.col("seq").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = line.withColumn("of", seen).where("seq is null").select(F.col("book_id").alias("b"), F.col("at").alias("s"), F.when(F.col("of").isNotNull(), F.struct("id", F.col("of").alias("seq"))).alias("up"))
    put = puts.join(found, F.col("book_id").eqNullSafe(F.col("b")) & (F.col("seq") == F.col("s")), "left")
    lost = F.col("after").isNotNull() & F.col("up").isNull()
    own = F.when(lost, F.concat(F.lit("2"), F.format_string("%020d", "seq"))).when(F.col("up").isNull(), F.concat(F.lit("0"), later)).otherwise(F.concat(F.lit("3"), later))
    nodes = base.select("book_id", node.alias("node"), F.lit(None).cast("struct<id:string,seq:bigint>").alias("up"), "own")
    nodes = nodes.union(put.select("book_id", F.struct("id", F.col("seq").cast("long").alias("seq")).alias("node"), "up", own.alias("own")))
    paths = _paths(nodes)
    gone = log.where("op = 'delete'").select("book_id", "id").distinct()
    shown = places.groupBy("book_id", "id").agg(F.max("seq").alias("seq")).join(gone, ["book_id", "id"], "left_anti").select("book_id", "id", node.alias("node"))
    rows = entries.select(fields)
    rows = rows.unionByName(added.select(fields)) if added is not None else rows
    copies = log.where("op = 'duplicate'").select("book_id", F.col("id").alias("copy"), F.col("after").alias("id"))
    while not copies.isEmpty():  # a round for each copy of a copy
        copies = written(copies, "edit-copies")
        rows = rows.unionByName(copies.join(rows, ["book_id", "id"]).withColumn("id", F.col("copy")).select(fields))
        known = rows.select("book_id", F.col("id").alias("copy"))
        rest = copies.join(known, ["book_id", "copy"], "left_anti")
        if rest.count() == copies.count():
            break
        copies = rest
    return rows.join(shown, ["book_id", "id"]).join(paths, ["book_id", "node"]).select(*fields, F.col("path").alias("rank"))


def edited_approvals(approvals: DataFrame, log: DataFrame) -> DataFrame:
    """approvals(book_id, approved_seq, ...) that no later edit of the book clears."""
    last = log.groupBy("book_id").agg(F.max("seq").alias("__last"))
    kept = approvals.join(last, "book_id", "left").where(F.col("__last").isNull() | (F.col("__last") <= F.col("approved_seq")))
    return kept.drop("__last")


def edited_anchors(anchors: DataFrame, log: DataFrame) -> DataFrame:
    """anchors(book_id, printed, physical, exception) after log(book_id, seq, op, printed, physical, exception): the last edit of an anchor says whether it stands."""
    key = ["book_id", "printed", "physical"]
    last = log.groupBy(*key).agg(F.max_by(F.struct("op", F.coalesce("exception", F.lit(False)).alias("exception")), "seq").alias("e"))
    kept = anchors.join(last, key, "left_anti")
    return kept.unionByName(last.where("e.op = 'add'").select(*key, F.col("e.exception").alias("exception")).select(anchors.columns))


def changed(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows(book_id, pos, source_sno, parent_sno, ...) after edits(book_id, seq, pos, field, value): the last value of each field, and a new
    source_sno carried on to the rows that had the old one as parent_sno, unless that was edited itself."""
    last = edits.groupBy("book_id", "pos", "field").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    wide = last.groupBy("book_id", "pos").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("v.value").alias("value")))).alias("__v"))
    own = rows.join(wide, ["book_id", "pos"], "left")
    renamed = own.where("map_contains_key(__v, 'source_sno') and source_sno <> ''").groupBy("book_id", F.col("source_sno").alias("parent_sno")).agg(F.min_by(F.element_at("__v", F.lit("source_sno")), "pos").alias("__to"))
    own = own.join(renamed, ["book_id", "parent_sno"], "left")
    has = lambda c: F.coalesce(F.map_contains_key("__v", F.lit(c)), F.lit(False))
    value = lambda c: F.element_at("__v", F.lit(c)).cast(rows.schema[c].dataType)
    out = [F.when(has(c), value(c)).otherwise(F.coalesce("__to", c) if c == "parent_sno" else F.col(c)).alias(c) if c not in ("book_id", "pos") else F.col(c) for c in rows.columns]
    return own.select(out)


def revalidated(rows: DataFrame, issues: DataFrame, edits: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) after the edits: rule(rows) is asked for the books that were edited alone; the findings of all others stay."""
    books = edits.select("book_id").distinct()
    now = changed(rows, edits)
    return now, issues.join(books, "book_id", "left_anti").unionByName(rule(now.join(books, "book_id", "left_semi")).select(issues.columns))
