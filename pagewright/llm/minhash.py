"""Near copies for the pipeline: links of op10_simhash, and texts whose sets of 5-word shingles are alike.

SimHash can't do this alone: at a likeness of 0.8 two 64-bit fingerprints differ in some ten bits, and no cut
into segments that are selective at scale brings those together. So candidates come from minima of hashes.

Two texts are near copies if the Jaccard likeness of their sets of shingles (SHINGLE words, cut as in
simhash) is SIMILAR or more. Candidates share one of BANDS keys, each of ROWS least hashes; at a likeness
of 0.8 a pair has none in common once in 300,000 times. Neighbours in a key are verified first, on their whole
sets; so a group of near copies costs its size, not its square. Of the pairs that they leave in different
classes, those go on whose sketches (a byte of each of SKETCH least hashes) agree in LEAST_EQUAL places or more -
a pair that is alike fails to once in 300,000 times, too - and are verified on their whole sets. So texts that
share keys without being alike cost comparisons of sketches within a key, and no rows. Equal sets need no
key. Classes join these links and those of op10 (MAX_BITS).

Texts of fewer words than a shingle have one of all their words. Rows without a doc_id take part in links
of op10 and of equal sets; no others are sought for sets that only they have. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import simhash
from pagewright.llm._common import arrow_batches, shuffle_partitions, written
from pagewright.llm.graph import connected_components

SHINGLE = 5
SIMILAR = (4, 5)
"""The least likeness, as a fraction."""
BANDS, ROWS = 32, 5
SKETCH, LEAST_EQUAL = 640, 466
"""The latter is 4.5 standard deviations below the mean at SIMILAR."""
MANY = 1 << 16
_RNG = np.random.default_rng(simhash.SEED)
FLIP, TURN = (_RNG.integers(0, 1 << 32, SKETCH, np.uint32) | np.uint32(k) for k in (0, 1))
BAND = _RNG.integers(0, 1 << 64, SKETCH, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    words = (text or "").encode().translate(simhash.LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hash64, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([hash64(join(words[i : i + SHINGLE]), simhash.SEED) for i in range(max(1, len(words) - SHINGLE + 1))], np.uint64))


def set_id(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), simhash.SEED) - (1 << 63) if len(h) else 0


def _least(h: np.ndarray, count: int, chunk: int = 1 << 10) -> np.ndarray:
    """The least of each of count hashes over a set, mixed."""
    high = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(h), chunk):
        x = np.multiply.outer(TURN[:count], high[at : at + chunk])
        x ^= FLIP[:count, None]
        np.minimum(least, x.min(1), out=least)
    wide = (least.astype(np.uint64) + np.uint64(1)) * BAND[:count]
    return wide ^ (wide >> np.uint64(29))


def keys(h: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(h):
        return np.empty(0, np.int64)
    return (_least(h, BANDS * ROWS) * BAND[: BANDS * ROWS]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64).view(np.int64)


def sketch(h: np.ndarray) -> bytes:
    return (_least(h, SKETCH) >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_id, sid, n, keys) for every row: simhash, id and size of the shingle set, its keys."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
            sets = [shingles(t) for t in texts]
            cols = [b.column(0), pa.array(fp.view(np.int64)), b.column(2), pa.array([set_id(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64())]
            cols += [pa.array([keys(h) for h in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "text_id", "sid", "n", "keys"])

    return simhash.keyed(docs).mapInArrow(run, "doc_id long, fp long, text_id long, sid long, n long, keys array<long>")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns sorted by the first -> the columns of each value that has two rows or more; one may span batches."""
    held: list[np.ndarray] = []
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        if not len(now[0]):
            continue
        cut = np.concatenate(([0], np.flatnonzero(np.diff(now[0])) + 1))  # the last bucket may go on
        for lo, hi in zip(cut[:-1][np.diff(cut) > 1].tolist(), cut[1:][np.diff(cut) > 1].tolist(), strict=True):
            yield [x[lo:hi] for x in now]
        held = [x[cut[-1] :] for x in now]
    if held and len(held[0]) > 1:
        yield held


def _batched(parts: Iterator[tuple[np.ndarray, np.ndarray, bool]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["u", "v", "later"])
    for u, v, later in parts:
        held.append((u, v, np.full(len(u), later)))
        rows += len(u)
        if rows >= MANY:
            yield flush()
            held, rows = [], 0
    if held:
        yield flush()


def _allowed(n: np.ndarray) -> np.ndarray:
    """n, sorted -> for each place the end of the places whose size allows the likeness."""
    return np.searchsorted(n * SIMILAR[0], n * SIMILAR[1], "right")


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n, sid) -> pairs of neighbours and with the first of a bucket, later false; of buckets of
    more than three, which have other pairs, also (key, sid), later true."""

    def parts():
        for key, n, sid in _buckets(batches):
            to = _allowed(n)
            for u, v in ((sid[:-1][to[:-1] > np.arange(1, len(n))], sid[1:][to[:-1] > np.arange(1, len(n))]), (np.full(max(0, int(to[0]) - 2), sid[0]), sid[2 : to[0]])):
                yield np.minimum(u, v), np.maximum(u, v), False
            if len(n) > 3:
                yield key, sid, True

    return _batched(parts())


def _other_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, n, sid, component, sketch, keys) -> the pairs of a bucket that no link joins yet and whose
    sketches agree, each in the first key only that both have."""

    def parts():
        for key, n, sid, component, sketches, own in _buckets(batches):
            if (component == component[0]).all():
                continue
            bytes_of = np.frombuffer(b"".join(sketches.tolist()), np.uint8).reshape(len(sid), -1)
            of = np.stack(own.tolist())
            for i, end in enumerate(_allowed(n).tolist()):
                apart = np.flatnonzero(component[i + 1 : end] != component[i]) + i + 1
                apart = apart[np.count_nonzero(bytes_of[apart] == bytes_of[i], axis=1) >= LEAST_EQUAL]
                other = sid[apart[of[i][(of[apart] == of[i]).argmax(1)] == key[0]]]
                yield np.minimum(other, sid[i]), np.maximum(other, sid[i]), False

    return _batched(parts())


SET = "sid long, n long, set array<long>, keys array<long>, sketch binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, text) -> SET where the text has that set (rows of one doc_id may differ)."""
    lists = pa.list_(pa.int64())
    for b in batches:
        found = [(s, h) for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if set_id(h := shingles(t)) == s]
        cols = [pa.array([s for s, _ in found], pa.int64()), pa.array([len(h) for _, h in found], pa.int64()), pa.array([h.view(np.int64) for _, h in found], lists)]
        cols += [pa.array([keys(h) for _, h in found], lists), pa.array([sketch(h) for _, h in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["sid", "n", "set", "keys", "sketch"])


def alike(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """sets(sid, n, first, keys), one row a set, first a doc_id that has it -> verified pairs (u, v) of sids that
    keep every class connected: those of neighbours first, then all others that these don't join."""
    n = shuffle_partitions(docs.sparkSession)
    by_key = lambda df, *cols: df.repartition(n, "key").sortWithinPartitions("key", "n", "sid").select("key", "n", "sid", *cols)
    spread = sets.where("first is not null").select(F.explode("keys").alias("key"), "n", "sid")
    now = written(by_key(spread).mapInArrow(_first_pairs, "u long, v long, later boolean").distinct(), "minhash-first")
    pairs, large = now.where("not later").select("u", "v"), now.where("later").select(F.col("u").alias("key"), F.col("v").alias("sid"))
    asked = pairs.select(F.col("u").alias("sid")).union(pairs.select("v")).union(large.select("sid")).distinct()
    ids = written(sets.join(asked, "sid", "left_semi").select("sid", "first"), "minhash-asked")
    texts = docs.select(F.col("doc_id").cast("long").alias("first"), F.col("text").cast("string").alias("text"))
    whole = written(texts.join(ids, "first").select("sid", "text").mapInArrow(_sets, SET).dropDuplicates(["sid"]), "minhash-sets")

    def verified(uv: DataFrame) -> DataFrame:
        a, b = (whole.select(F.col("sid").alias(k), F.col("set").alias(f"set_{k}")) for k in ("u", "v"))
        both = F.size(F.array_intersect("set_u", "set_v"))
        enough = both * SIMILAR[1] >= (F.size("set_u") + F.size("set_v") - both) * SIMILAR[0]
        return written(uv.join(a, "u").join(b, "v").where(enough).select("u", "v"), "minhash-alike")

    found = verified(pairs)
    roots = connected_components(found).withColumnRenamed("node", "sid")
    members = large.join(roots, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    unsettled = members.join(mixed, "key", "left_semi").join(whole.drop("set"), "sid")
    others = written(by_key(unsettled, "component", "sketch", "keys").mapInArrow(_other_pairs, "u long, v long, later boolean").select("u", "v").distinct(), "minhash-others")
    return found.union(verified(others))


def near_copies(docs: DataFrame) -> DataFrame:
    """What simhash.near_duplicates returns, with links of both kinds."""
    of = written(signatures(docs), "minhash-signatures")
    sets = written(of.groupBy("sid").agg(F.min("fp").alias("r"), F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys")), "minhash-distinct")
    node = sets.select("sid", "r")
    same = of.select("fp", "sid").join(node, "sid").select(F.col("r").alias("u"), F.col("fp").alias("v"))
    found = alike(docs, sets)
    near = found.join(node.withColumnRenamed("sid", "u").withColumnRenamed("r", "x"), "u").join(node.withColumnRenamed("sid", "v").withColumnRenamed("r", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return simhash.classes(of.select("doc_id", "fp", "text_id"), same.union(near).where("u <> v").distinct())


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class of near copies, as simhash.keep_one does."""
    return simhash.keep_one(docs, near_copies)
