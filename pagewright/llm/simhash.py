"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in at most three bits, one
half differs in at most one, so both share the variant of that half with that bit taken out. Every
fingerprint is indexed under its 2 x 32 one-wildcard variants; equal variants are brought together,
verified on all 64 bits, and each bucket yields the edges of a spanning forest of its links, never
all pairs. Components of those edges are the classes.

Null texts count as empty. A text without words has fingerprint zero and links like any other. Equal
fingerprints (copies, repeated rows) are aggregated before the index. Rows with a null doc_id take
part; a class of only such rows has a null component_id. No rows in, no rows out. Other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._common import arrow_batches, shuffle_partitions, table, written
from pagewright.llm.graph import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
KEEP, TEXT = "pagewright keep", "pagewright text"
"""Columns that keep_one adds for its join and takes away."""
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, chunk: int = 1 << 16) -> int:
    """The 64-bit SimHash of a whole text."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    hash64, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        h = np.array([hash64(join(words[i : i + SHINGLE]), SEED) for i in range(at, min(n, at + chunk))], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_id) for every row; fp is the fingerprint as a signed long, text_id a hash of the text."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], ["doc_id", "fp", "text_id"])

    return keyed(docs).mapInArrow(run, "doc_id long, fp long, text_id long")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_id"))


def _forest(fp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest over the links (at most MAX_BITS apart) of one bucket."""
    left = np.ones(len(fp), bool)
    for start in range(len(fp)):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            i = front.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return
            near = rest[np.bitwise_count(fp[rest] ^ fp[i]) <= MAX_BITS]
            left[near] = False
            yield from ((int(fp[i]), int(fp[j])) for j in near)
            front += near.tolist()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) -> verified edges (u, v) of fingerprints; a bucket may span batches."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64)]

    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        two = lo[hi - lo == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS]
        found = [np.stack((fp[two], fp[two + 1]), 1)]
        for a, b in zip(lo[hi - lo > 2].tolist(), hi[hi - lo > 2].tolist(), strict=True):
            found.append(np.array(list(_forest(fp[a:b])), np.int64).reshape(-1, 2))
        uv = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], ["u", "v"])

    for b in batches:
        key, fp = (np.concatenate((h, b.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held))
        if not len(key):
            continue
        end = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        if end:
            yield edges(key[:end], fp[:end])
        held = [key[end:], fp[end:]]
    if len(held[0]):
        yield edges(*held)


def links(distinct: DataFrame) -> DataFrame:
    """distinct(fp), one row a fingerprint -> edges (u, v), u < v, of verified links that keep every class connected."""
    spark = distinct.sparkSession
    half = lambda seg: F.shiftrightunsigned("fp", 32) if seg else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    keys = [half(seg).bitwiseAND(F.lit(~(1 << i))) + F.lit((seg * 32 + i) << 32) for seg in (0, 1) for i in range(32)]
    return (
        distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
        .repartition(shuffle_partitions(spark), "key")
        .sortWithinPartitions("key", "fp")
        .mapInArrow(_links, "u long, v long")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root, text_id) for every row: component_id is the smallest doc_id reachable by links."""
    return classes(written(fingerprints(docs), "simhash-fp"))


def classes(fps: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """fps(doc_id, fp, ...) -> with component_id, and root, one fingerprint of each class; more: further edges (u, v) of
    fingerprints, beside their links."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    edges = links(distinct.select("fp"))
    roots = connected_components(edges.union(more) if more is not None else edges).withColumnRenamed("node", "fp")
    of = written(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "simhash-root")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(of.join(least, "root").select("fp", "component_id", "root"), "fp")


def keep_one(docs: DataFrame, near: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs with one row of each class: one whose doc_id is the class id. Rows with one doc_id and different texts
    may be in different classes, and then one of each stays; of equal rows, one.

    Rows without a doc_id can't be named as the one that stays and are left alone.
    """
    least = F.min(F.struct("doc_id", "text_id")).alias("least")
    kept = near(docs).where("doc_id = component_id").groupBy("root").agg(least).select(F.col("least.doc_id").alias(KEEP), F.col("least.text_id").alias(TEXT))
    own = docs.withColumns({KEEP: F.col("doc_id").cast("long"), TEXT: F.xxhash64(F.col("text").cast("string"))})
    one = own.where(F.col(KEEP).isNotNull()).join(kept, [KEEP, TEXT], "left_semi").dropDuplicates([KEEP, TEXT])
    return one.unionByName(own.where(F.col(KEEP).isNull())).drop(KEEP, TEXT)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
