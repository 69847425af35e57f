"""What the operators of this subpackage share: tables, the shared folder, written cut points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.sources.shared import discard, fresh, shared_dir, written  # noqa: F401 - the operators take them from here

BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long documents must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hash_fraction(*cols: str) -> Column:
    """A fixed pseudo-random number in [0, 1) for each row's values. Nulls alone would all get the same: with doc_id goes the text."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def excerpt(text: str, chars: int) -> Column:
    """The text, or of a longer one so many characters from a place that its hash gives. For training samples only."""
    return F.expr(f"substr({text}, cast(1 + pmod(xxhash64({text}), greatest(length({text}) - {chars}, 0) + 1) as int), {chars})")
