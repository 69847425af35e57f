"""Printed to physical pages: anchors, segments of constant offset, and resolution.

anchors(book_id, printed, physical, exception). A segment is a run of anchors, in order of printed
page, with one offset; two anchors confirm it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
"""Printed pages of a book that are looked up in one task."""


def conflicts(anchors: DataFrame) -> DataFrame:
    """Printed pages that anchors put at different physical pages."""
    plain = anchors.where("not exception").groupBy("book_id", "printed").agg(F.sort_array(F.collect_set("physical")).alias("physical_pages"))
    return plain.where("size(physical_pages) > 1")


def clear_anchors(anchors: DataFrame) -> DataFrame:
    plain = anchors.where("not exception")
    one = plain.groupBy("book_id", "printed").agg(F.min("physical").alias("physical"), F.max("physical").alias("most"))
    return one.where("physical = most").drop("most")


def segments(anchors: DataFrame) -> DataFrame:
    """(book_id, segment, printed_start, printed_end, offset, anchors, confirmed), segments in order."""
    w = Window.partitionBy("book_id").orderBy("printed")
    a = clear_anchors(anchors).withColumn("offset", F.col("physical") - F.col("printed"))
    a = a.withColumn("new", F.when(F.lag("offset").over(w).eqNullSafe(F.col("offset")), 0).otherwise(1)).withColumn("segment", F.sum("new").over(w))
    out = a.groupBy("book_id", "segment", "offset").agg(F.min("printed").alias("printed_start"), F.max("printed").alias("printed_end"), F.count("*").alias("anchors"))
    return out.select("book_id", "segment", "printed_start", "printed_end", "offset", "anchors", (F.col("anchors") >= 2).alias("confirmed"))


def covering(pages: DataFrame, sure: DataFrame, value: str = "offset") -> DataFrame:
    """pages(book_id, printed), distinct, with inside: a value (the offset) of the segment that covers the page, or null.

    An as-of join: segments don't overlap, so the last that starts at a page or before it is the only one that can cover it. Pages and starts stand in one
    order within blocks of BLOCK pages; a segment starts anew in each block that it reaches, so no task holds a book.
    """
    reach = F.explode(F.sequence(F.floor(F.col("printed_start") / BLOCK), F.floor(F.col("printed_end") / BLOCK)))
    starts = sure.select("book_id", reach.alias("block"), F.col("printed_start").alias("from"), F.col("printed_end").alias("to"), F.col(value).alias("value"))
    starts = starts.select("book_id", "block", F.greatest(F.col("from"), F.col("block") * BLOCK).cast("long").alias("at"), F.struct("to", "value").alias("segment"), F.lit(None).cast("int").alias("printed"))
    asked = pages.select("book_id", F.floor(F.col("printed") / BLOCK).alias("block"), F.col("printed").cast("long").alias("at"), F.lit(None).cast(starts.schema["segment"].dataType).alias("segment"), "printed")
    so_far = Window.partitionBy("book_id", "block").orderBy("at", F.col("printed").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = starts.unionByName(asked).withColumn("last", F.last("segment", ignorenulls=True).over(so_far)).where("printed is not null")
    return both.select("book_id", "printed", F.when(F.col("printed") <= F.col("last.to"), F.col("last.value")).alias("inside"))


def resolve(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """entries(book_id, printed, ...) with physical and method.

    In this order: an exception for the page; conflicting anchors leave it unresolved; its anchor; the
    confirmed segment that covers it; the only confirmed segment of the book, extended; unresolved.
    """
    pages = entries.where("printed is not null").select("book_id", "printed").distinct()
    exact = anchors.where("exception").groupBy("book_id", "printed").agg(F.max("physical").alias("x"))
    seen = anchors.where("not exception").groupBy("book_id", "printed").agg(F.min("physical").alias("lo"), F.max("physical").alias("hi"))
    sure = segments(anchors).where("confirmed")
    only = sure.groupBy("book_id").agg(F.count("*").alias("n"), F.max("offset").alias("one"))
    known = covering(pages, sure).join(exact, ["book_id", "printed"], "left").join(seen, ["book_id", "printed"], "left")
    known = known.select(F.col("book_id").alias("__b"), F.col("printed").alias("__p"), "inside", "x", "lo", "hi")
    out = entries.join(known, (F.col("book_id") == F.col("__b")) & (F.col("printed") == F.col("__p")), "left").join(only, "book_id", "left")
    inside = F.col("inside")
    p = F.col("printed")
    none = F.lit(None).cast("int")
    rules = [
        (p.isNull(), none, "no_printed_page"),
        (F.col("x").isNotNull(), F.col("x"), "exception"),
        (F.col("lo") < F.col("hi"), none, "unresolved"),
        (F.col("lo").isNotNull(), F.col("lo"), "anchor"),
        (inside.isNotNull(), p + inside, "segment"),
        (F.col("n") == 1, p + F.col("one"), "extrapolated"),
    ]
    physical, method = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for cond, page, how in rules[1:]:
        physical, method = physical.when(cond, page), method.when(cond, how)
    out = out.withColumn("physical", physical.otherwise(none).cast("int")).withColumn("method", method.otherwise("unresolved"))
    return out.drop("x", "lo", "hi", "n", "one", "inside", "__b", "__p")


def resolve_entries(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """As resolve, but a supplied physical page that agrees with its index stands on its own."""
    given = (F.col("given_physical").isNotNull() & (F.col("given_index") == F.col("given_physical") - 1)) | (F.col("printed").isNull() & F.col("given_physical").isNotNull())
    out = resolve(entries, anchors)
    how = F.when(F.col("given_index") == F.col("given_physical") - 1, "supplied").otherwise("physical_only")
    return out.withColumn("method", F.when(given, how).otherwise(F.col("method"))).withColumn("physical", F.when(given, F.col("given_physical")).otherwise(F.col("physical")))


def next_anchor(resolved: DataFrame) -> DataFrame:
    """For each book the unresolved entry to anchor next: parts and chapters first, then by printed page."""
    w = Window.partitionBy("book_id").orderBy(F.col("kind").isin("part", "chapter").cast("int").desc(), F.asc_nulls_last("printed"), "sno")
    open_ = resolved.where("physical is null and printed is not null")
    return open_.withColumn("k", F.row_number().over(w)).where("k = 1").select("book_id", "sno", "title", "kind", "printed")


def physical_rows(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """rows(book_id, sno, start, end, already_physical) with physical_start, physical_end and unresolved (the page that has no place).

    Physical rows pass through. Of a printed row both ends must resolve, or it has neither.
    """
    keep = rows.columns
    placed = resolve(rows.withColumn("printed", F.col("start")), anchors).withColumnsRenamed({"physical": "__s"}).drop("printed", "method")
    placed = resolve(placed.withColumn("printed", F.col("end")), anchors).withColumnsRenamed({"physical": "__e"}).drop("printed", "method")
    given = F.col("already_physical")
    both = F.col("__s").isNotNull() & F.col("__e").isNotNull()
    ends = [F.when(given, F.col(c)).when(both, F.col(p)).alias(name) for c, p, name in (("start", "__s", "physical_start"), ("end", "__e", "physical_end"))]
    bad = F.when(~given & ~both, F.when(F.col("__s").isNull(), F.col("start")).otherwise(F.col("end")))
    return placed.select(*keep, *ends, bad.alias("unresolved"))


def overview(resolved: DataFrame, anchors: DataFrame, issues: DataFrame) -> DataFrame:
    """For each book: entries, how many have a page, the pages that they span, confirmed segments, warnings and blocking findings."""
    n = resolved.groupBy("book_id").agg(F.count("*").alias("entries"), F.count("physical").alias("resolved"), F.min("physical").alias("first_page"), F.max("physical").alias("last_page"))
    sure = segments(anchors).groupBy("book_id").agg(F.count_if("confirmed").alias("confirmed"))
    found = issues.groupBy("book_id").agg(F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "blocking").alias("blocking"))
    return n.join(sure, "book_id", "left").join(found, "book_id", "left").fillna(0, ["confirmed", "warnings", "blocking"])
