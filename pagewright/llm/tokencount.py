"""Token counts through a digest cache.

The cache is a Parquet table (content, n_tokens) in a folder that all executors share, with a partition for each tokenizer.
content is the SHA-256 of the normalised text (null becomes empty; nothing else may change, as every
byte counts for a byte-level tokenizer), tokenizer the digest of tokenizer file and library version.
A run takes the digests of all texts, joins them to the stored counts, encodes one text of each
digest that is missing, appends the new counts, and joins the counts back to the documents. Two runs
that append the same digest do no harm: the cache is read with one row a digest.

Rows with null doc_id and repeated rows are returned like any other; other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm._common import arrow_batches, shared_dir, table
from pagewright.llm.pieces import encoder, version

LIMIT = 1024
CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer version, a row a digest; empty where nothing is stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "content binary, n_tokens long")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == tokenizer)
    # grouped by both columns: a join on content alone then has a shuffle of its own, whose hot keys (a text of many
    # copies) adaptive execution can split
    return rows.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).select("content", "n_tokens")


def fill_cache(docs: DataFrame, tokenizer_path: str, cache: str) -> None:
    """Appends the counts of all texts of docs that the cache lacks."""
    spark = docs.sparkSession
    arrow_batches(spark)
    tokenizer = version(tokenizer_path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    distinct = docs.select(_digest(text).alias("content"), text.alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, tokenizer), "content", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path)
        for b in batches:
            n = [len(ids) // 4 for ids in tokens.encode_all(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([tokenizer] * len(n), pa.string())], ["content", "n_tokens", "tokenizer"])
        tokens.settle()

    misses.select("content", "text").mapInArrow(run, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)


def _digest(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs, filling the cache on the way."""
    fill_cache(docs, tokenizer_path, cache)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = read_cache(docs.sparkSession, cache, version(tokenizer_path))
    keyed = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), _digest(text).alias("content"))
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = shared_dir(spark, "token-cache")  # a run of its own: nothing is counted before
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
