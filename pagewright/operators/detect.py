"""Outlines found in the pages themselves: heading lines, contents pages, seeds and equal parts.

pages(book_id, page from 1, text), lines as cluster_lines gives them, dims(book_id, page, width).
Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import pages as P

# Patterns of heading and contents lines, thresholds and how far each search goes.
PART, CHAPTER = r"(?i)^\s*PART\s+([IVXLC]+|\d+)\b", r"(?i)^\s*CHAPTER\s+(\d+|[IVXLC]+)\b"
INTRODUCTION, THANKS = r"(?i)^\s*INTRODUCTION\b", r"(?i)^\s*ACKNOWLEDGE?MENTS?\b"
CAPTION, ZONE = rf"(?i)^\s*({T.CAPTIONS})\s+([0-9]+[A-Z]?)\b[:\-]?\s*(.*)$", r"^\s*(?:Zone|ZONE)\s+(\d+)\b"
CONTENTS = r"(?i)\b(?:contents|table\s+of\s+contents)\b"
CONTENTS_LINE = r"(?i)^(?:contents|table of contents)\b"
DOTTED, TAIL, NUMBER = r"^(.+?)\s*\.{2,}\s*(\d{1,4})\s*$", r"^(.*?)\s+(\d{1,4})\s*$", r"^\d{1,4}$"
CHAPTER_LINE = r"(?i)^(?:chapter\s+\d+\b|\d+\s+[A-Z].+)$"
BOLD, CENTERED = 0.65, 0.70
HEADER_PAGES, CONTENTS_SPAN, RUN_PAGES, SCAN_PAGES, HEAD_LINES = 20, 3, 40, 12, 6


def text_lines(text: Column) -> Column:
    """The non-blank lines of a text, white space squeezed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]"), T.squeeze), lambda x: x != "")


def is_keyword(line: Column) -> Column:
    any_ = line.rlike(PART)
    for p in (CHAPTER, INTRODUCTION, THANKS, CAPTION, ZONE):
        any_ = any_ | line.rlike(p)
    return any_


def heading_lines(lines: DataFrame, dims: DataFrame) -> DataFrame:
    """Lines that open with a heading word, or are large for their page, or bold and centred; pages without a sized line give none."""
    limit = P.size_threshold(lines, ["book_id", "page"], "avg_size")
    mid = T.centeredness(F.col("x0"), F.col("x1"), F.col("width"))
    got = lines.join(limit, ["book_id", "page"]).join(dims.select("book_id", "page", "width"), ["book_id", "page"]).withColumn("centeredness", mid)
    styled = (F.col("avg_size") >= F.col("threshold")) | ((F.col("bold_ratio") >= BOLD) & (F.col("centeredness") >= CENTERED))
    return got.where(is_keyword(F.col("text")) | styled).drop("threshold", "width")


def merge_captions(heads: DataFrame) -> DataFrame:
    """A caption takes the next heading line of its page as its title, and that line goes.

    Parts, chapters, captions and page numbers are never taken. So no caption is ever taken itself, and
    looking one line ahead and one behind settles every line. A caption with a title of its own keeps it;
    the next line goes nevertheless.
    """
    w = Window.partitionBy("book_id", "page").orderBy("top", "line_no")
    t = F.col("text")
    free = ~(t.rlike(PART) | t.rlike(CHAPTER) | t.rlike(CAPTION) | t.rlike(NUMBER))
    caption = t.rlike(CAPTION)
    got = heads.withColumns({"__free": free, "__caption": caption})
    got = got.withColumns({"__takes": F.coalesce(F.col("__caption") & F.lead("__free").over(w), F.lit(False)), "__next": F.lead("text").over(w), "__taken": F.coalesce(F.col("__free") & F.lag("__caption").over(w), F.lit(False))})
    word, own = F.regexp_extract("text", CAPTION, 1), F.trim(F.regexp_extract("text", CAPTION, 3))
    title = F.concat(F.lit("["), F.upper(word), F.lit("] "), F.initcap(F.lower(word)), F.lit(" "), F.regexp_extract("text", CAPTION, 2), F.lit(": "), F.when(own != "", own).otherwise(F.col("__next")))
    got = got.withColumn("text", F.when(F.col("__takes"), T.normalize_title(title)).otherwise(t)).where(~F.col("__taken"))
    return got.drop("__free", "__caption", "__takes", "__next", "__taken")


def contents_entries(pages: DataFrame) -> DataFrame:
    """(book_id, title, start): dotted lines of the first contents page (within 20 pages) and the two pages after it."""
    first = pages.where((F.col("page") <= HEADER_PAGES) & F.col("text").rlike(CONTENTS)).groupBy("book_id").agg(F.min("page").alias("first"))
    near = pages.join(first, "book_id").where(F.col("page").between(F.col("first"), F.col("first") + CONTENTS_SPAN - 1))
    got = near.select("book_id", "page", F.posexplode(text_lines(F.col("text"))).alias("line_no", "line")).select("book_id", "page", "line_no", T.toc_line(F.col("line")).alias("t")).where("t is not null")
    # one row for a title in either case and a page: the spelling of the last line
    one = got.groupBy("book_id", F.lower("t.title").alias("key"), F.col("t.page").alias("start")).agg(F.max_by(T.normalize_title(F.col("t.title")), F.struct("page", "line_no")).alias("title"))
    return one.select("book_id", "title", "start")


def detect_outline(pages: DataFrame, words: DataFrame, dims: DataFrame) -> DataFrame:
    """(book_id, title, start, y, kind): contents entries at printed pages (kind toc) and headings at physical ones.

    Page numbers and titles under three characters go, of equal titles the earliest stays.
    """
    heads = merge_captions(heading_lines(P.cluster_lines(words), dims))
    s = T.standard_heading(F.col("text"))
    found = heads.select("book_id", F.col("page").alias("start"), F.col("top").alias("y"), "line_no", s.alias("s")).select("book_id", "s.title", "start", "y", "s.kind", "line_no")
    listed = contents_entries(pages).select("book_id", "title", "start", F.lit(0.0).alias("y"), F.lit("toc").alias("kind"), F.lit(0).alias("line_no"))
    rows = listed.unionByName(found).withColumn("pos", F.struct((F.col("kind") != "toc").alias("found"), "line_no", "title"))
    return P.earliest_titles(rows).select("book_id", "title", "start", "y", "kind")


def draft_entries(detected: DataFrame) -> DataFrame:
    """Detected rows as draft entries in order of start: contents entries with a printed page, others with a physical one."""
    toc = F.col("kind") == "toc"
    sno = F.row_number().over(Window.partitionBy("book_id").orderBy("start", "y", "title"))
    kind = F.when(toc, "section").otherwise(F.col("kind"))
    return detected.select("book_id", sno.alias("sno"), "title", kind.alias("kind"), F.when(toc, F.col("start")).alias("printed"), F.when(~toc, F.col("start")).alias("physical"), F.when(toc, 0.85).otherwise(0.55).alias("confidence"))


def scan_pages(pages: DataFrame, early: int = SCAN_PAGES, late: int = SCAN_PAGES) -> DataFrame:
    """(book_id, page, source, confidence, text): contents pages among the first pages and index pages among the last."""
    last = pages.groupBy("book_id").agg(F.max("page").alias("__last"))
    body = F.coalesce("text", F.lit(""))
    toc = (F.col("page") <= early) & body.rlike(CONTENTS)
    index = (F.col("page") > F.col("__last") - late) & (T.casefold(body).contains("index") | T.looks_like_index(body))
    got = pages.join(last, "book_id").where((F.col("page") <= early) | (F.col("page") > F.col("__last") - late))
    got = got.withColumn("source", F.when(toc, "toc").when(index, "index")).where("source is not null")
    return got.select("book_id", "page", "source", F.when(F.col("source") == "toc", 0.9).otherwise(0.65).alias("confidence"), "text")


def contents_run(pages: DataFrame) -> DataFrame:
    """(book_id, page): the unbroken run of pages full of entries that starts at the first contents heading, within 40 pages."""
    lines = text_lines(F.col("text"))
    n = lambda p: F.size(F.filter("lines", lambda x: x.rlike(p)))
    dense = (n(DOTTED) >= 4) | ((n(r"\s\d{1,4}$") >= 6) & (F.size("lines") >= 12)) | (n(NUMBER) >= 6)
    got = pages.where(F.col("page") <= RUN_PAGES).select("book_id", "page", lines.alias("lines")).select("book_id", "page", dense.alias("dense"), F.exists("lines", lambda x: x.rlike(CONTENTS_LINE)).alias("head"))
    anchor = got.where("head").groupBy("book_id").agg(F.min("page").alias("anchor"))
    w = Window.partitionBy("book_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return got.join(anchor, "book_id").where("page >= anchor").withColumn("all", F.min("dense").over(w)).where("all").select("book_id", "page")


def run_entries(pages: DataFrame, run: DataFrame) -> DataFrame:
    """(book_id, title, start, pos) of the pages of a contents run.

    Dotted lines, then lines that end in a number (dotted ones once more, their dots kept), page by page. While a book
    has none, titles on lines of their own are taken with the number below them: only its first page with any entry can
    be read that way. Of equal (title in lower case, start) the first stays.
    """
    lines = pages.join(run, ["book_id", "page"], "left_semi").select("book_id", "page", F.posexplode(text_lines(F.col("text"))).alias("line_no", "line"))
    number = lambda p: F.regexp_extract("line", p, 2).cast("int")
    title = lambda p: F.trim(F.regexp_extract("line", p, 1))
    one = lines.where(F.col("line").rlike(DOTTED)).select("book_id", "page", F.lit(1).alias("pass"), "line_no", title(DOTTED).alias("title"), number(DOTTED).alias("start"))
    two = lines.where(F.col("line").rlike(TAIL) & ~F.col("line").rlike(CONTENTS_LINE)).select("book_id", "page", F.lit(2).alias("pass"), "line_no", title(TAIL).alias("title"), number(TAIL).alias("start"))
    plain = one.unionByName(two).where("title <> '' and start >= 1")
    alone = F.col("line").rlike(NUMBER)
    before = Window.partitionBy("book_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    block = lines.withColumn("block", F.coalesce(F.sum(alone.cast("int")).over(before), F.lit(0)))
    word = F.when(~alone & ~F.col("line").rlike(CONTENTS_LINE), F.struct("line_no", "line"))
    split = block.groupBy("book_id", "page", "block").agg(F.sort_array(F.collect_list(word)).alias("w"), F.max(F.when(alone, F.col("line").cast("int"))).alias("start"), F.max("line_no").alias("line_no"))
    split = split.select("book_id", "page", F.lit(3).alias("pass"), "line_no", F.array_join(F.transform("w", lambda x: x["line"]), " ").alias("title"), "start").where((F.col("title") != "") & F.col("start").isNotNull() & ~F.col("title").rlike(CONTENTS_LINE))
    every = plain.unionByName(split)
    first = every.groupBy("book_id").agg(F.min("page").alias("__first"), F.min(F.when(F.col("pass") < 3, F.col("page"))).alias("__plain"))
    turn = (F.col("pass") < 3) | ((F.col("page") == F.col("__first")) & ~F.col("__first").eqNullSafe(F.col("__plain")))
    kept = every.join(first, "book_id").where(turn).drop("__first", "__plain")
    same = Window.partitionBy("book_id", F.lower("title"), "start").orderBy("page", "pass", "line_no")
    kept = kept.withColumn("__k", F.row_number().over(same)).where("__k = 1")
    pos = F.row_number().over(Window.partitionBy("book_id").orderBy("page", "pass", "line_no"))
    return kept.select("book_id", "title", "start", pos.alias("pos"))


def inferred_offset(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """(book_id, offset): physical minus printed page of the first seed, found by its first two words within 40 pages; a book without a hit has no row."""
    first = seeds.groupBy("book_id").agg(F.min_by(F.struct("title", "printed"), "pos").alias("s"))
    words = F.slice(T.word_list(F.col("s.title")), 1, 2)
    first = first.select("book_id", F.lower(F.array_join(words, " ")).alias("needle"), F.col("s.printed").alias("printed")).where("needle <> ''")
    hit = pages.where(F.col("page") <= RUN_PAGES).join(first, "book_id").where(F.lower("text").contains(F.col("needle")))
    return hit.groupBy("book_id", "printed").agg(F.min("page").alias("page")).select("book_id", (F.col("page") - F.col("printed")).alias("offset"))


def chapters_from_seeds(seeds: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, title, printed, start, end) of seeds(book_id, title, printed).

    books(book_id, page_count, offset, first, last): starts are clamped to the book, each chapter ends before the next
    start, and what lies outside first to last goes. Of equal starts only the last in order of title stays.
    """
    s = seeds.join(books, "book_id").withColumn("at", F.greatest(F.lit(1), F.least(F.col("printed") + F.col("offset"), F.col("page_count"))))
    w = Window.partitionBy("book_id").orderBy("at", "title", "printed")
    s = s.withColumn("until", F.coalesce(F.lead("at").over(w) - 1, F.col("page_count")))
    return s.select("book_id", "title", "printed", F.greatest("at", "first").alias("start"), F.least("until", "last").alias("end")).where("start <= end")


def chapters_by_heading(pages: DataFrame, books: DataFrame, most: int | None = None) -> DataFrame:
    """(book_id, title, start, end): a chapter at each page of first to last with a chapter line among its first six lines.

    A book without any is cut into equal parts: six, or most (2 to 12). Chapters end before the next one, the last at last.
    """
    head = F.get(F.filter(F.slice(text_lines(F.col("text")), 1, HEAD_LINES), lambda x: x.rlike(CHAPTER_LINE)), F.lit(0))
    span = books.select("book_id", "first", "last")
    found = pages.join(span, "book_id").where(F.col("page").between(F.col("first"), F.col("last"))).select("book_id", head.alias("title"), F.col("page").alias("start"), "last").where("title is not null")
    bins = 6 if not most else max(2, min(12, most))
    width = F.greatest(F.lit(1), F.floor((F.col("last") - F.col("first") + 1) / bins)).cast("int")
    rest = span.join(found.select("book_id").distinct(), "book_id", "left_anti").select("book_id", "first", "last", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("k"))
    equal = rest.select("book_id", F.concat(F.lit("Chapter "), (F.col("k") + 1).cast("string")).alias("title"), (F.col("first") + F.col("k") * F.col("width")).alias("start"), "last")
    w = Window.partitionBy("book_id").orderBy("start")
    out = found.unionByName(equal).withColumn("end", F.coalesce(F.lead("start").over(w) - 1, F.col("last")))
    if most:
        out = out.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    return out.select("book_id", "title", "start", "end")


def chosen_chapters(pages: DataFrame, given: DataFrame, crop: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(book_id, title, start, end, way): each book's chapters from the best that there is: given seeds(book_id, title, printed, pos), else its contents run, else chapter lines.

    Printed pages are moved by the offset that the first seed shows, none where it shows none. crop(book_id, first_printed, last_printed) keeps a book's
    chapters within those pages; `most` leaves the first so many.
    """
    listed = run_entries(pages, contents_run(pages)).join(given.select("book_id").distinct(), "book_id", "left_anti")
    seeds = given.select("book_id", "title", "printed", "pos", F.lit("given").alias("way")).unionByName(listed.select("book_id", "title", F.col("start").alias("printed"), "pos", F.lit("contents").alias("way")))
    books = pages.groupBy("book_id").agg(F.max("page").alias("page_count")).join(inferred_offset(pages, seeds), "book_id", "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
    books = books.join(crop, "book_id", "left") if crop is not None else books.withColumns({"first_printed": F.lit(None).cast("int"), "last_printed": F.lit(None).cast("int")})
    first, last = F.greatest(F.lit(1), F.col("first_printed") + F.col("offset")), F.least(F.col("page_count"), F.col("last_printed") + F.col("offset"))
    books = books.select("book_id", "page_count", "offset", first.alias("first"), last.alias("last")).where("first <= last")
    way = seeds.select("book_id", "way").distinct()
    by_seed = chapters_from_seeds(seeds, books).select("book_id", "title", "start", "end").join(way, "book_id")
    rest = books.join(way, "book_id", "left_anti")
    by_line = chapters_by_heading(pages.join(rest.select("book_id"), "book_id", "left_semi"), rest, most).withColumn("way", F.lit("headings"))
    out = by_seed.unionByName(by_line)
    if most:
        out = out.withColumn("__k", F.row_number().over(Window.partitionBy("book_id").orderBy("start", "title"))).where(F.col("__k") <= most).drop("__k")
    return out


def range_text(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges(book_id, title, start, end) with their pages' texts joined by line feeds, blank pages kept."""
    spelt = ranges.withColumn("page", F.explode(F.expr("sequence(start, greatest(start, end))")))
    got = spelt.join(pages.select("book_id", "page", F.coalesce("text", F.lit("")).alias("body")), ["book_id", "page"])
    part = F.sort_array(F.collect_list(F.struct("page", "body")))
    return got.groupBy(*ranges.columns).agg(F.array_join(F.transform(part, lambda x: x["body"]), "\n").alias("text"))
