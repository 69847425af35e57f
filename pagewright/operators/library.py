"""The library: identities, duplicates, run history and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T


def identified(files: DataFrame) -> DataFrame:
    """files(name, content) -> with source_hash and book_id."""
    h = F.sha2(F.col("content").cast("binary"), 256)
    return files.select("name", h.alias("source_hash"), T.book_id(h).alias("book_id"), F.octet_length("content").alias("size_bytes"))


def duplicates(files: DataFrame) -> DataFrame:
    """Files whose content another file has, with the first name that holds it."""
    first = files.groupBy("source_hash").agg(F.min("name").alias("first_name"), F.count("*").alias("copies")).where("copies > 1")
    return files.join(first, "source_hash").select("name", "book_id", "first_name", "copies")


def new_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose content the registry lacks, one a content: the first name."""
    fresh = files.join(registry.select("book_id").distinct(), "book_id", "left_anti")
    return fresh.groupBy("book_id", "source_hash", "size_bytes").agg(F.min("name").alias("name"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """For each book the run that started last, and how many there are."""
    w = Window.partitionBy("book_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    out = runs.withColumn("k", F.row_number().over(w)).withColumn("runs", F.count("*").over(Window.partitionBy("book_id")))
    return out.where("k = 1").select("book_id", "run_id", "started_at", "status", "runs")


def default_run(runs: DataFrame, saved: DataFrame) -> DataFrame:
    """(book_id, run_id): the completed run that saved(book_id, run_id) names, else the one that started last."""
    done = runs.where("status = 'completed'").join(saved.select("book_id", F.col("run_id").alias("__saved")).dropDuplicates(["book_id"]), "book_id", "left")
    first = F.struct((F.col("run_id") == F.coalesce("__saved", F.lit(""))).alias("named"), "started_at", "run_id")
    return done.groupBy("book_id").agg(F.max_by("run_id", first).alias("run_id"))


def labels(runs: DataFrame, books: DataFrame) -> DataFrame:
    """Runs with their book's file name, or its id where it is not in the library."""
    return runs.join(books.select("book_id", "filename"), "book_id", "left").select("run_id", "book_id", "status", F.coalesce("filename", F.col("book_id").cast("string")).alias("label"))


def lifecycle(books: DataFrame, facts: DataFrame) -> DataFrame:
    """facts(book_id, has_draft, outline_approved, mapping_approved, completed_runs) -> state and next action of each book."""
    b = books.select("book_id").join(facts, "book_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    done = F.coalesce("completed_runs", F.lit(0)) > 0
    state = F.when(done, "extracted").when(yes("mapping_approved"), "mapped").when(yes("outline_approved"), "outlined").when(yes("has_draft"), "drafted").otherwise("registered")
    action = F.when(done, "browse").when(yes("mapping_approved"), "extract").when(yes("outline_approved"), "map pages").when(yes("has_draft"), "review outline").otherwise("build outline")
    return b.select("book_id", state.alias("state"), action.alias("next_action"))


def shown_time(value: Column) -> Column:
    """An ISO time as date and time of day to the second, in its own offset; other text as it stands."""
    pattern = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?.*)?$"
    part = lambda k, empty: F.when(F.regexp_extract(value, pattern, k) != "", F.regexp_extract(value, pattern, k)).otherwise(empty)
    return F.when(value.rlike(pattern) & value.try_cast("timestamp").isNotNull(), F.concat(part(1, ""), F.lit(" "), part(2, "00:00"), part(3, ":00"))).otherwise(value)


def elapsed(started: Column, completed: Column) -> Column:
    """Minutes (if any) and seconds between two ISO times, never below zero; a dash where one is missing or no time."""
    at = lambda c: c.try_cast("timestamp").cast("double")
    s = F.floor(F.greatest(at(completed) - at(started), F.lit(0.0)))
    text = F.when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
    return F.when(at(completed).isNull() | at(started).isNull(), "—").otherwise(text)
