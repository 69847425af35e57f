"""CSV outlines, JSONL sections and run folders as tables.

A run is published in two steps: its sections are written to runs/run_id=..., then its record is
appended to the history. Readers see only the sections of runs with a completed record, so a run that
dies half way is never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.library import identified

OUTLINE = (
    "Sno INT, title STRING, kind STRING, printed_start INT, physical_start INT, pdf_page_index INT, confidence DOUBLE, source STRING, review_status STRING, include STRING, "
    "printed_page_label STRING, level INT, edited_by_user STRING, source_sno STRING, parent_sno STRING, raw_import_hash STRING, entry_id STRING, parent_entry_id STRING, "
    "provenance_source_type STRING, analytical_or_verbatim STRING, boundary_status STRING, boundary_basis STRING, allow_extraction STRING, notes STRING"
)
SECTION = "book_id STRING, sno INT, title STRING, start INT, end INT, text STRING"
RUN = "run_id STRING, book_id STRING, started_at TIMESTAMP, status STRING, expected_count LONG, written_count LONG"


def read_outline(spark: SparkSession, path: str) -> DataFrame:
    """An outline CSV with all 24 columns: blanks are null; include and allow_extraction default to true, edited_by_user to false."""
    df = spark.read.csv(path, header=True, schema=OUTLINE, enforceSchema=False)
    yes = lambda c: ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("0", "false", "no")
    edited = F.lower(F.trim(F.coalesce("edited_by_user", F.lit("")))).isin("1", "true", "yes")
    return df.withColumns({"include": yes("include"), "allow_extraction": yes("allow_extraction"), "edited_by_user": edited, "kind": F.lower(F.coalesce("kind", F.lit("section"))), "level": F.coalesce("level", F.lit(1))})


def read_starts(spark: SparkSession, path: str) -> DataFrame:
    """(sno, title, start, already_physical) of a short outline CSV: printed pages win over physical ones; rows without either, or without a title, are left out."""
    df = spark.read.csv(path, header=True)
    col = lambda n: F.col(n).try_cast("int") if n in df.columns else F.lit(None).cast("int")
    out = df.select(col("Sno").alias("sno"), F.trim("title").alias("title"), F.coalesce(col("printed_start"), col("physical_start")).alias("start"), col("printed_start").isNull().alias("already_physical"))
    return out.where("title <> '' and start >= 1").orderBy("sno")


def write_outline(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def run_id(day: Column | None = None) -> Column:
    """yyyymmdd and twelve hex digits, another for each row."""
    return F.concat(F.date_format(F.current_timestamp() if day is None else day, "yyyyMMdd"), F.lit("-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def publish_run(sections: DataFrame, root: str, run_id: str, started_at: str, status: str = "completed") -> None:
    """Writes the sections of a run, then its records, a row a book. A run that fails or is cancelled leaves nothing; a run_id is taken once."""
    spark = sections.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/runs/run_id={run_id}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(folder):
        raise FileExistsError(f"{run_id}: there is such a run")
    try:
        sections.write.json(f"{root}/runs/run_id={run_id}")
        written = spark.read.schema(SECTION).json(f"{root}/runs/run_id={run_id}")
        records = written.groupBy("book_id").agg(F.count("*").alias("expected_count"), F.count_if(F.col("text") != "").alias("written_count"))
        records.select(F.lit(run_id).alias("run_id"), "book_id", F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(status).alias("status"), "expected_count", "written_count").write.mode("append").json(f"{root}/history")
    except BaseException:
        fs.delete(folder, True)
        raise


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RUN).json(f"{root}/history")


def read_sections(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Sections of completed runs, of one run where run_id is given (other folders are not read)."""
    df = spark.read.schema(SECTION).option("basePath", f"{root}/runs").json(f"{root}/runs")
    df = df if run_id is None else df.where(F.col("run_id") == run_id)
    done = read_runs(spark, root).where("status = 'completed'").select("run_id").distinct()
    return df.join(done, "run_id", "left_semi")


PAGE = "file STRING, book_id STRING, page INT, text STRING, error STRING"


def read_files(spark: SparkSession, folder: str, only: str = "", pattern: str = "*.pdf") -> DataFrame:
    """(name, source_hash, book_id, size_bytes) of the files whose name contains only, in any case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.substring_index("path", "/", -1)
    return identified(files.select(name.alias("name"), "content").where(F.lower("name").contains(only.lower())))


def read_pages(spark: SparkSession, folder: str, adapter: Callable[[bytes], Iterable[str | None]], only: str = "", pattern: str = "*.pdf") -> DataFrame:
    """The pages that adapter yields for each file's bytes, counted from 1. A file that it can't read gives one row with the error and no page.

    A file is decoded in one task, batches hold 64 MB or one file: a book fits a task, a library is spread over all.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20)
    name = F.substring_index("path", "/", -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(name.alias("file"), T.book_id(F.sha2("content", 256)).alias("book_id"), "content").where(F.lower("file").contains(only.lower()))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, book, content in b.itertuples(index=False):
                try:
                    rows += [(file, book, k, text, None) for k, text in enumerate(adapter(content), 1)]
                except Exception as e:  # noqa: BLE001 - one unreadable file must not stop the library
                    rows = [r for r in rows if r[0] != file] + [(file, book, None, None, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=["file", "book_id", "page", "text", "error"]).astype({"page": "Int32"})

    return files.mapInPandas(decode, PAGE)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(title, printed) of a chapter CSV, columns title or Title and printed_start or PrintedStart; rows without a title or a page from 1 are left out."""
    df = spark.read.option("caseSensitive", "true").csv(path, header=True)
    col = lambda *names: F.coalesce(*(F.when(F.trim(n) != "", F.col(n)) for n in names if n in df.columns), F.lit(None).cast("string"))
    got = df.select(T.squeeze(col("title", "Title")).alias("title"), F.trim(col("printed_start", "PrintedStart")).try_cast("int").alias("printed"))
    return got.where("title <> '' and printed >= 1")


def read_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """(chapter, title, para_id, text, word_count) of the folders chapter_*: the non-blank lines of corpus.txt, titles from meta.json or the folder's name."""
    chapter = F.regexp_extract(F.input_file_name(), r"(chapter_[^/]+)/[^/]+$", 1)
    text = spark.read.text(f"{folder}/chapter_*/corpus.txt", wholetext=True).select(chapter.alias("chapter"), F.col("value").alias("text"))
    meta = spark.read.text(f"{folder}/chapter_*", wholetext=True, pathGlobFilter="meta.json").select(chapter.alias("chapter"), F.get_json_object("value", "$.title").alias("title"))
    lines = F.transform(T.paragraphs(F.col("text"), r"\r\n|\r|\n"), lambda x: F.trim(x))
    got = text.join(meta, "chapter", "left").select("chapter", F.coalesce("title", "chapter").alias("title"), F.posexplode(lines).alias("para_id", "text"))
    return got.select("chapter", "title", (F.col("para_id") + 1).alias("para_id"), "text", T.word_count(F.col("text")).alias("word_count"))


def outline_template(rows: DataFrame) -> DataFrame:
    """rows(book_id, title, start, y, kind[, end]) as a CSV template to fill in: pages of contents entries are printed ones, all others physical.

    Rows without a place or title come last, as in the SQL. Rows alike in both are numbered by kind and end, so that the same rows get the same numbers in every run.
    """
    toc = F.col("kind") == "toc"
    sno = F.row_number().over(Window.partitionBy("book_id").orderBy(*(F.asc_nulls_last(c) for c in ("start", "y", "title", "kind", "end") if c in rows.columns)))
    sides = [(f"{side}_{end}", cond, end) for side, cond in (("printed", toc), ("physical", ~toc)) for end in ("start", "end") if end in rows.columns]
    return rows.select("book_id", sno.alias("Sno"), "title", "kind", *(F.when(cond, F.col(c)).alias(name) for name, cond, c in sides))


def write_template(rows: DataFrame, path: str) -> None:
    """A folder of CSV files a book, book_id in the folder's name."""
    outline_template(rows).repartition("book_id").sortWithinPartitions("book_id", "Sno").write.mode("overwrite").partitionBy("book_id").csv(path, header=True)


def page_texts(pages: DataFrame) -> DataFrame:
    """(book_id, page, value): each page's text under a line with its number."""
    return pages.select("book_id", "page", F.format_string("--- Physical page %d ---\n%s", "page", F.coalesce("text", F.lit(""))).alias("value"))


def outline_text(rows: DataFrame) -> DataFrame:
    """(book_id, value): the outline as lines "title | page", by sno; a label goes before a printed page."""
    page = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("printed").cast("string"), F.lit(""))
    line = F.struct("sno", F.concat(F.coalesce("title", F.lit("")), F.lit(" | "), page).alias("line"))
    return rows.groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("value"))


def write_chapters(chapters: DataFrame, path: str, mode: str = "oneline") -> None:
    """chapters(chapter, ..., paragraphs array) as corpus files and one line of metadata each; paragraphs stand a line apart, or two with mode wrap."""
    gap = "\n" if mode == "oneline" else "\n\n"
    body = chapters.select("chapter", F.array_join("paragraphs", gap).alias("value"))
    body.write.mode("overwrite").partitionBy("chapter").text(f"{path}/corpus")
    chapters.drop("paragraphs").withColumn("paragraph_mode", F.lit(mode)).write.mode("overwrite").json(f"{path}/meta")
