"""What a reviewer does with outlines, the library and results: events, edits and exports as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.merge import numbered_in_turn


def provenance_events(candidates: DataFrame, mode: str, recorded_at: Column) -> DataFrame:
    """candidates(book_id, pos, ...) -> (book_id, recorded_at, mode, candidates): an event a book, its candidates in order.

    Events are only ever appended to what is stored.
    """
    one = F.struct(*(c for c in ["pos", *(c for c in candidates.columns if c not in ("book_id", "pos"))]))
    got = candidates.groupBy("book_id").agg(F.sort_array(F.collect_list(one)).alias("candidates"))
    return got.select("book_id", recorded_at.alias("recorded_at"), F.lit(mode).alias("mode"), "candidates")


def registered(library: DataFrame, files: DataFrame) -> DataFrame:
    """library(book_id, filename, source_hash, size_bytes, hidden) with files(name, book_id, source_hash, size_bytes) added.

    A content that the library has comes into sight again and keeps its file name; of new ones the first name counts.
    """
    fresh = files.groupBy("book_id").agg(F.min(F.struct("name", "source_hash", "size_bytes")).alias("f"))
    both = library.join(fresh, "book_id", "full")
    pick = lambda old, new: F.coalesce(F.col(old), F.col(f"f.{new}")).alias(old)
    seen = F.when(F.col("f").isNotNull(), F.lit(False)).otherwise(F.col("hidden"))
    return both.select("book_id", pick("filename", "name"), pick("source_hash", "source_hash"), pick("size_bytes", "size_bytes"), seen.alias("hidden"))


def hidden(library: DataFrame, books: DataFrame, hide: bool = True) -> DataFrame:
    """library with the given books hidden or, hide being false, shown again; nothing is deleted."""
    named = books.select("book_id").distinct().withColumn("__named", F.lit(True))
    return library.join(named, "book_id", "left").withColumn("hidden", F.when(F.col("__named"), F.lit(hide)).otherwise(F.col("hidden"))).drop("__named").select(*library.columns)


def visible(library: DataFrame, name_part: str = "") -> DataFrame:
    """The books in sight whose file name holds the text, without regard to case."""
    return library.where(~F.col("hidden") & T.casefold(F.col("filename")).contains(T.casefold(F.lit(name_part))))


def sections_by_sno(sections: DataFrame) -> DataFrame:
    """sections(run_id, book_id, sno, pos, ...): of those with one sno in a run and book the last."""
    w = Window.partitionBy("run_id", "book_id", "sno").orderBy(F.desc("pos"))
    return sections.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def entry_sections(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """(book_id, pos, sno, title, chars, shown): each entry with the size of its section, or that it has none."""
    have = sections.select("book_id", "sno", F.length("text").alias("chars"))
    got = entries.select("book_id", "pos", "sno", "title").join(have, ["book_id", "sno"], "left")
    return got.select("book_id", "pos", "sno", "title", "chars", F.when(F.col("chars").isNull(), "Not extracted").otherwise(F.format_string("%d characters", "chars")).alias("shown"))


def by_printed_page(rows: DataFrame) -> DataFrame:
    """rows(book_id, sno, printed, ...) with pos: by printed page, those without one last, then by sno."""
    w = Window.partitionBy("book_id").orderBy(F.asc_nulls_last("printed"), "sno")
    return rows.withColumn("pos", F.row_number().over(w))


def editing_status(rows: DataFrame, approved: DataFrame) -> DataFrame:
    """(book_id, entries, modified, approved) of rows(book_id, edited) and the books approved(book_id)."""
    got = rows.groupBy("book_id").agg(F.count("*").alias("entries"), F.max(F.coalesce("edited", F.lit(False))).alias("modified"))
    ok = approved.select("book_id").distinct().withColumn("__ok", F.lit(True))
    return got.join(ok, "book_id", "left").select("book_id", "entries", "modified", F.coalesce("__ok", F.lit(False)).alias("approved"))


def appended(draft: DataFrame, accepted: DataFrame) -> DataFrame:
    """draft(book_id, sno, ...) and accepted(book_id, pos, ...), which get the numbers after the draft's largest, in order."""
    most = draft.groupBy("book_id").agg(F.max("sno").alias("__most"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("pos"))
    more = accepted.withColumn("__place", place).join(most, "book_id", "left").withColumn("sno", (F.coalesce("__most", F.lit(0)) + F.col("__place")).cast("int"))
    return draft.unionByName(more.select(*draft.columns))


def selected_numbers(rows: DataFrame) -> DataFrame:
    """rows(book_id, pos, sno) in order of pos with unique numbers: one that is missing or taken becomes the largest so far plus one."""
    return numbered_in_turn(rows.withColumn("turn", F.lit(0))).select("book_id", "pos", F.col("new_sno").alias("sno"))


def union_rendered(rows: DataFrame) -> DataFrame:
    """rows(book_id, pos, fields map) as comma-separated lines over all keys, sorted; pos 0 is the header, and without rows there is a header alone."""
    keys = [r[0] for r in rows.select(F.explode(F.map_keys("fields")).alias("k")).distinct().orderBy("k").collect()] or ["printed_start", "source", "title"]  # a row a column
    row = rows.select("book_id", "pos", *(F.element_at("fields", F.lit(k)).alias(k) for k in keys))
    head = rows.select("book_id").distinct() if not rows.isEmpty() else rows.sparkSession.createDataFrame([(None,)], f"book_id {rows.schema['book_id'].dataType.simpleString()}")
    return rendered(row, keys, "csv").unionByName(head.select("book_id", F.lit(0).cast(rows.schema["pos"].dataType).alias("pos"), F.lit(",".join(keys)).alias("line")))


def files_of_outlines(outlines: DataFrame, files: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """outlines(outline) with file: of files(file) the one named like the outline without its ending and its last _outline, _outline_clean, _contents, _toc or _index; else null."""
    stem = F.regexp_replace(F.regexp_replace("outline", r"\.[^.]*$", ""), r"(?i)(_outline(_clean)?|_contents|_toc|_index)$", "")
    named = files.select("file").distinct().withColumnRenamed("file", "__file")
    return outlines.join(named, F.concat(stem, F.lit(suffix)) == F.col("__file"), "left").withColumnRenamed("__file", "file")


def rendered(rows: DataFrame, columns: list[str], kind: str = "tsv") -> DataFrame:
    """rows(book_id, pos, ...) with line: the columns as tab-separated, comma-separated (quoted where needed) or JSON text, nulls empty."""
    if kind == "json":
        line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    elif kind == "csv":
        line = F.to_csv(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)), {"emptyValue": "", "escape": '"'})
    else:
        line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.select("book_id", "pos", line.alias("line"))


def megabytes(size: Column) -> Column:
    """A whole number of bytes in megabytes with one decimal; halves go to the even tenth, as in Python and C (Java's formats send them up)."""
    size = size.cast("long")
    tenths = F.floor(size / 1048576.0) * 10 + F.bround(F.pmod(size, F.lit(1 << 20)) * 10 / 1048576.0).cast("long")
    return F.concat((tenths / F.lit(10).cast("decimal(2,0)")).cast("decimal(20,1)").cast("string"), F.lit(" MB"))


def short_path(path: Column) -> Column:
    """The last two parts of a path."""
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -2)
