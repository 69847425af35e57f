"""A search index kept up by a stream of new section files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.analytics import tokens
from pagewright.sources.tables import SECTION


def section_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SECTION).option("recursiveFileLookup", "true").json(path)


def postings(sections: DataFrame) -> DataFrame:
    """(term, book_id, sno, n): how often a word stands in a section."""
    words = sections.select("book_id", "sno", F.explode(tokens(F.col("text"))).alias("term"))
    return words.groupBy("term", "book_id", "sno").agg(F.count("*").alias("n"))


def keep_index(stream: DataFrame, out: str, checkpoint: str):
    """Appends the postings of each batch of sections to the table out; returns the started query.

    A batch that is written again after a failure replaces its own folder, so postings count once.
    """

    def write(batch: DataFrame, number: int) -> None:
        postings(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
