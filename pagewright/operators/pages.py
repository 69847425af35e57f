"""Pages, page ranges, sections and their search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.sources.shared import discard, written

SHARDS = 64
BLOCK = 1 << 16
"""Pages that one task looks through for the next start."""
NEST = 256
"""Rows of a block, and blocks of a run, in which the nearest smaller value is looked up."""


def numbered(df: DataFrame, group: str, order: str, name: str, total: str | None = None) -> DataFrame:
    """df with the place of each row in its group (from 1) in the order of a numeric column, and the group's size as total.

    A group may hold a third of all rows, so rows are numbered within ranges of the order column and
    shifted by the rows of earlier ranges; no task holds a whole group.
    """
    cuts = df.agg(F.percentile_approx(order, [k / SHARDS for k in range(1, SHARDS)], 10_000)).first()[0] or []
    shard = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda b: b < F.col(order))) if cuts else F.lit(0)
    df = df.withColumn("__shard", shard)
    counts = df.groupBy(group, "__shard").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(group).alias("__g"), F.col("__shard").alias("__s"), F.coalesce(before, F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(group)).alias("__all"))
    place = F.row_number().over(Window.partitionBy(group, "__shard").orderBy(order))
    joined = df.withColumn("__place", place).join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__shard") == F.col("__s")))
    joined = joined.withColumn(name, (F.col("__place") + F.col("__start")).cast("int"))
    joined = joined.withColumn(total, F.col("__all").cast("int")) if total else joined
    return joined.drop("__place", "__start", "__all", "__shard", "__g", "__s")


def pages_from_documents(docs: DataFrame) -> DataFrame:
    """(book_id, page, doc_id, text, page_count): a source is a book, its documents its pages."""
    return numbered(docs.select(F.col("source").alias("book_id"), "doc_id", "text"), "book_id", "doc_id", "page", "page_count").select("book_id", "page", "doc_id", "text", "page_count")


def in_book() -> Window:
    return Window.partitionBy("book_id").orderBy("pos")


def ranges_to_next_row(rows: DataFrame, last: str = "max_page") -> DataFrame:
    """Each row ends a page before the next row starts, not before its own start; the last at last."""
    end = F.lead("start").over(in_book()) - 1
    return rows.withColumn("end", F.greatest(F.coalesce(end, F.col(last)), F.col("start")))


def ranges_to_next_start(rows: DataFrame, last: str = "max_page") -> DataFrame:
    """Each row ends a page before the first following row with a larger start; rows in any order of start."""
    after = nearest_smaller(rows.select("book_id", (-F.col("pos")).alias("at"), (-F.col("start")).alias("value")), "book_id")
    after = after.select(F.col("book_id").alias("__g"), (-F.col("at")).alias("__p"), (-F.col("near.value")).alias("__larger"))
    joined = rows.join(after, F.col("book_id").eqNullSafe(F.col("__g")) & (F.col("pos") == F.col("__p")), "left")
    return joined.withColumn("end", F.when(F.col("__larger").isNull(), F.col(last)).otherwise(F.col("__larger") - 1)).drop("__g", "__p", "__larger")


def ranges_of_sorted(rows: DataFrame, last: str = "max_page") -> DataFrame:
    """As ranges_to_next_start for rows whose starts don't fall.

    The next larger start is looked up within blocks of BLOCK pages, and across blocks in a table of their first starts,
    so no task holds a whole book; frames that grow from the end cost a step a row.
    """
    df = rows.withColumn("__block", F.floor(F.col("start") / BLOCK))
    after = F.lead("__first").over(Window.partitionBy("__g").orderBy("__b"))
    firsts = df.groupBy(F.col("book_id").alias("__g"), F.col("__block").alias("__b")).agg(F.min("start").alias("__first")).withColumn("__after", after).drop("__first")
    w = Window.partitionBy("book_id", "__block").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__larger", F.min("start").over(w)).join(firsts, F.col("book_id").eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
    larger = F.coalesce("__larger", "__after")
    return df.withColumn("end", F.when(larger.isNull(), F.col(last)).otherwise(larger - 1)).drop("__block", "__larger", "__after", "__g", "__b")


def extract_sections(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """outline(book_id, sno, title, start, end) -> with text: its pages in order, blank ones left out.

    Ranges are spelt out to pages and joined on (book_id, page): linear however long a book is.
    """
    spelt = outline.withColumn("page", F.explode(F.expr("sequence(start, greatest(start, end))")))
    body = F.trim(F.coalesce(F.col("text"), F.lit("")))
    found = spelt.join(pages.select("book_id", "page", body.alias("body")), ["book_id", "page"], "left")
    part = F.when(F.col("body") != "", F.struct("page", "body"))
    ordered = F.sort_array(F.collect_list(part))
    keys = [c for c in outline.columns]
    return found.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["body"]), "\n\n").alias("text"))


def printed_ends(rows: DataFrame) -> DataFrame:
    """rows(book_id, pos, printed, start, end) of included entries with printed_end.

    It is a page before the next entry's printed page where that is larger, else as many pages on as the section is long;
    null where there is no printed page to count from.
    """
    after = F.lead("printed").over(in_book())
    return rows.withColumn("printed_end", F.when(after > F.coalesce("printed", F.lit(0)), after - 1).otherwise(F.col("printed") + F.col("end") - F.col("start")))


def renumbered(rows: DataFrame) -> DataFrame:
    """rows(book_id, pos, ...) with sno counted anew from 1 in order of pos."""
    return rows.withColumn("sno", F.row_number().over(in_book()))


def manifest(sections: DataFrame, run_id: str, least: int = 1) -> DataFrame:
    """Sections without their text: file name, characters, and whether the section was written or skipped as too short."""
    return sections.select(
        F.lit(run_id).alias("run_id"), "book_id", "sno", "title", F.col("start").alias("physical_start"), F.col("end").alias("physical_end"),
        (F.col("start") - 1).alias("pdf_page_index"), T.section_filename(F.col("sno"), F.col("title")).alias("txt_path"),
        F.length("text").alias("chars"), F.when(F.length("text") < least, "skipped").otherwise("written").alias("status"),
    )


def run_accounting(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("run_id", "book_id").agg(
        F.count("*").alias("expected_count"), F.count_if(F.col("status") == "written").alias("written_count"),
        F.count_if(F.col("status") == "skipped").alias("skipped_count"), F.count_if(F.col("status") == "failed").alias("failed_count"),
    )


def search(sections: DataFrame, query: str = "", book_id: str | None = None, kind: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Sections that match all that is given, cheap predicates first, with a snippet; page bounds leave out null pages."""
    out = sections
    if book_id is not None:
        out = out.where(F.col("book_id") == book_id)
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if first is not None:
        out = out.where(F.col("start") >= first)
    if last is not None:
        out = out.where(F.col("start") <= last)
    if query:
        hay = T.casefold(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
        out = out.where(hay.contains(T.casefold(F.lit(query))))
    return out.withColumn("snippet", T.snippet(F.coalesce("text", F.lit("")), query))


def search_summary(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, book_id, hits, summary) for every run record: how many of its written sections were found."""
    n = hits.groupBy("run_id", "book_id").agg(F.count("*").alias("hits"))
    got = runs.join(n, ["run_id", "book_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return got.select("run_id", "book_id", "hits", F.format_string("%d of %d", "hits", "written_count").alias("summary"))


def navigation(sections: DataFrame) -> DataFrame:
    """Each section's neighbours and its place among its book's sections."""
    w = Window.partitionBy("book_id").orderBy("sno")
    whole = Window.partitionBy("book_id")
    return sections.select(
        "book_id", "sno", F.lag("sno").over(w).alias("previous_sno"), F.lead("sno").over(w).alias("next_sno"),
        F.format_string("%d of %d", F.row_number().over(w), F.count("*").over(whole)).alias("place"),
    )


def falling_starts(rows: DataFrame) -> DataFrame:
    """Rows that start before the one above them."""
    return rows.withColumn("previous", F.lag("start").over(in_book())).where("start < previous")


def nearest_smaller(rows: DataFrame, group: str) -> DataFrame:
    """rows(group, at, value) -> (group, at, near): the last row before it, in order of at, with a smaller value.

    Rows are taken in blocks of NEST places and NEST blocks at a time. A block, or a run of blocks, shows those that follow only the rows
    below which nothing smaller comes after (its visible rows, by rising value); a row looks for its own first within its block, then among
    what the blocks before it show. Any number of values, no task holds a group, and steps grow with the rows.
    """
    kind = f"array<struct<at:{rows.schema['at'].dataType.simpleString()},value:{rows.schema['value'].dataType.simpleString()}>>"
    none = f"cast(array() as {kind})"
    over = lambda below, top: f"concat(filter({below}, z -> z.value < {top}[0].value), {top})"  # noqa: E731 - what is visible once top follows
    fold = lambda runs: f"aggregate({runs}, {none}, (s, x) -> {over('s', 'x.seen')})"
    found = rows.where("at is not null and value is not null").withColumn("b", F.floor(F.col("at") / NEST))
    blocks = found.groupBy(group, "b").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).cast(kind).alias("own"))
    blocks = blocks.withColumn("seen", F.expr(f"aggregate(own, {none}, (s, x) -> {over('s', 'array(x)')})"))
    runs = blocks.groupBy(group, F.floor(F.col("b") / NEST).alias("r")).agg(F.sort_array(F.collect_list(F.struct("b", "own", "seen"))).alias("blocks"))
    whole = runs.select(group, "r", F.expr(fold("blocks")).alias("seen")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("r", "seen"))).alias("runs"))
    before = whole.select(F.col(group).alias("__g"), F.expr(f"inline(transform(runs, (x, i) -> named_struct('__r', x.r, 'before', {fold('slice(runs, 1, i)')})))"))
    placed = runs.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("r") == F.col("__r")))
    placed = placed.select(group, F.expr(f"inline(transform(blocks, (x, i) -> named_struct('own', x.own, 'before', aggregate(slice(blocks, 1, i), before, (s, y) -> {over('s', 'y.seen')}))))"))
    last = "coalesce(try_element_at(filter(own, y -> y.at < x.at and y.value < x.value), -1), try_element_at(filter(before, y -> y.value < x.value), -1))"
    return placed.select(group, F.expr(f"inline(transform(own, x -> named_struct('at', x.at, 'near', {last})))"))


def parents_by_level(rows: DataFrame, group: str = "book_id") -> DataFrame:
    """parent_pos: the nearest row above of a smaller level, whatever levels there are."""
    near = nearest_smaller(rows.select(group, F.col("pos").alias("at"), F.col("level").alias("value")), group)
    near = near.select(F.col(group).alias("__g"), F.col("at").alias("__p"), F.col("near.at").alias("parent_pos"))
    return rows.join(near, F.col(group).eqNullSafe(F.col("__g")) & (F.col("pos") == F.col("__p")), "left").drop("__g", "__p")


def matching_with_ancestors(rows: DataFrame, cond: Column) -> DataFrame:
    """rows(book_id, pos, parent_pos) that match or lie above one that does, at any distance.

    By pointer doubling: after k rounds what lies less than 2^k above is found, and pointers reach 2^k up. It ends when
    no pointer is left, or after as many rounds as the number of rows has bits, so a circle of parents ends too.
    """
    up = written(rows.where("parent_pos is not null").select("book_id", "pos", F.col("parent_pos").alias("up")), "above")
    found = written(rows.where(cond).select("book_id", "pos").distinct(), "found")
    for _ in range(up.count().bit_length()):
        if up.isEmpty():
            break
        on = up.select(F.col("book_id").alias("b"), F.col("pos").alias("p"), F.col("up").alias("to"))
        reached = found.join(on, F.col("book_id").eqNullSafe(F.col("b")) & (F.col("pos") == F.col("p"))).select("book_id", F.col("to").alias("pos"))
        more = written(found.union(reached).distinct(), "found")
        twice = up.join(on, up["book_id"].eqNullSafe(on["b"]) & (up["up"] == on["p"])).select(up["book_id"], up["pos"], on["to"].alias("up"))
        twice = written(twice, "above")
        discard(up, found)
        up, found = twice, more
    discard(up)
    of = found.select(F.col("book_id").alias("__b"), F.col("pos").alias("__p"))
    return rows.join(of, F.col("book_id").eqNullSafe(F.col("__b")) & (F.col("pos") == F.col("__p")), "left_semi")


def text_status(pages: DataFrame, sample: int = 3, least: int = 80) -> DataFrame:
    """(book_id, page_count, status): whether the first pages hold text."""
    chars = F.sum(F.when(F.col("page") <= sample, F.length(F.trim(F.coalesce("text", F.lit(""))))).otherwise(0))
    got = pages.groupBy("book_id").agg(F.count("*").alias("page_count"), chars.alias("chars"))
    return got.select("book_id", "page_count", F.when(F.col("chars") >= least, "text-extractable").otherwise("likely-scanned").alias("status"))


def cluster_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """words(book_id, page, text, top, x0, x1, fontname, size) -> lines(book_id, page, line_no, text, top, x0, x1, avg_size, bold_ratio).

    A line takes words whose top is within the tolerance of its first word's, so the fold keeps that
    first top: a gap to the word before would let lines drift.
    """
    w = F.struct("top", "x0", "x1", "text", "size", F.when(T.is_boldish(F.col("fontname")), 1.0).otherwise(0.0).alias("bold"))
    got = words.groupBy("book_id", "page").agg(F.sort_array(F.collect_list(w)).alias("words"))
    kind = "array<struct<top:double,x0:double,x1:double,text:string,size:double,bold:double>>"
    got = got.withColumn("words", F.col("words").cast(kind))
    lines = F.expr(f"""aggregate(words, cast(array() as array<{kind}>), (acc, w) ->
        if(size(acc) = 0 or abs(w.top - element_at(acc, -1)[0].top) > {tolerance}D, concat(acc, array(array(w))),
           concat(slice(acc, 1, size(acc) - 1), array(concat(element_at(acc, -1), array(w))))))""")
    mean = lambda f: F.expr(f"aggregate(line, 0D, (s, w) -> s + w.{f}) / size(line)")
    out = got.select("book_id", "page", F.posexplode(lines).alias("line_no", "line"))
    joined = F.expr("array_join(transform(array_sort(line, (a, b) -> case when a.x0 < b.x0 then -1 when a.x0 > b.x0 then 1 else 0 end), w -> w.text), ' ')")
    out = out.select("book_id", "page", (F.col("line_no") + 1).alias("line_no"), T.squeeze(joined).alias("text"), mean("top").alias("top"), F.array_min("line.x0").alias("x0"), F.array_max("line.x1").alias("x1"), mean("size").alias("avg_size"), mean("bold").alias("bold_ratio"))
    return out.where("text <> ''")


def size_threshold(values: DataFrame, group: list[str], size: str, floor: float = 12.5) -> DataFrame:
    """The size at place floor(0.9 (n - 1)) of the positive sizes in order, not below the floor."""
    got = values.where(F.col(size) > 0).groupBy(*group).agg(F.sort_array(F.collect_list(size)).alias("s"))
    at = F.floor(F.lit(0.9).cast("double") * (F.size("s") - 1)).cast("int")
    return got.select(*group, F.greatest(F.element_at("s", at + 1).cast("double"), F.lit(floor)).alias("threshold"))


def earliest_titles(rows: DataFrame) -> DataFrame:
    """rows(book_id, title, start, y, pos) without page numbers and titles under 3 characters; of equal titles the earliest."""
    kept = rows.where(~F.trim("title").rlike(r"^\d{1,4}$") & (F.length(F.trim("title")) >= 3))
    w = Window.partitionBy("book_id", F.lower("title")).orderBy("start", "y", "pos")
    return kept.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
