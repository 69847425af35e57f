"""Document fingerprints from closed syncmers.

A k-mer of K code points is an anchor if the smallest hash among its substrings of S code points lies at
its start or end. That depends on the k-mer alone, so a shared passage has the same anchors in any
context. A fingerprint keeps every distinct anchor, with the place of its first occurrence, as text:
"hash@place" in hexadecimal, joined by spaces, in order of hash; it grows with the text. A text without
such an anchor (shorter than K, say) has one for the whole text; an empty text has none.

The likeness of two fingerprints counts the shared anchors that keep the same order of places in both
(longest increasing run): with j their share of the anchors of both together, the likeness is
2 j / (1 + j), the share of common anchors in two texts of equal length. Two empty fingerprints are
alike (1), an empty and another are not (0).

Other columns are not read. Null texts count as empty. Null doc_ids come last in descending order; rows with equal doc_id follow
each other by text, descending. One row alone is its own next document. No rows in, no rows out.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._common import arrow_batches, shuffle_partitions, table

K, S = 32, 12
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
LEAST_ID = -(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and places of all anchors of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    if n >= K:
        with np.errstate(over="ignore"):
            join = lambda a, b, off, m: a[: n - m + 1] * _power(m - off) + b[off : off + n - m + 1]
            h1 = (c.astype(np.uint64) + np.uint64(1)) * MIX
            h2 = join(h1, h1, 1, 2)
            h4 = join(h2, h2, 2, 4)
            h8 = join(h4, h4, 4, 8)
            small = _mix(join(h8, h4, 8, S))
            h16 = join(h8, h8, 8, 16)
            long = join(h16, h16, 16, K)
            least, width, most = small, 1, K - S + 1
            while width < most:
                step = min(width, most - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            at = np.flatnonzero((small[: n - K + 1] == least) | (small[K - S :] == least))
            if len(at):
                return (_mix(long[at]) >> np.uint64(32)).astype(np.uint32), at
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    return np.frombuffer(hashlib.sha256(c.tobytes()).digest()[:4], "<u4"), np.zeros(1, np.int64)


def fingerprint(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All distinct hashes, in order, and the place of each one's first occurrence."""
    h, at = anchors(text or "")
    h, first = np.unique(h, return_index=True)
    return h, at[first]


def render(fp: tuple[np.ndarray, np.ndarray]) -> str:
    return " ".join(f"{h:08x}@{p:x}" for h, p in zip(fp[0].tolist(), fp[1].tolist(), strict=True))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    run: list[int] = []
    for p in b[1][j][np.argsort(a[1][i])].tolist():
        k = bisect.bisect_left(run, p)
        run[k : k + 1] = [p]
    share = len(run) / (len(a[0]) + len(b[0]) - len(shared))
    return 2 * share / (1 + share)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(pid, carry, doc_id, text): ranges of doc_id, each led by a copy of the document that comes next
    after its smallest (the largest one below the range; for the first range the largest of all)."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] + [1.0], 10_000), F.max("doc_id")).first()
    bounds = sorted({*(cuts[0] or ()), cuts[1]}) if cuts[1] is not None else [0]
    # looked up in two steps, each over about the root of the number of ranges
    each = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i : i + each] for i in range(0, len(bounds), each)]
    below = lambda bs: F.size(F.filter(bs, lambda b: b < F.col("doc_id")))
    whole = below(F.array(*(F.lit(p[-1]) for p in parts)))
    own = F.get(F.array(*(F.array(*map(F.lit, p)) for p in parts)), whole)
    rows = rows.withColumn("whole", whole).withColumn("own", own)
    pid = F.col("whole") * each + below(F.col("own"))
    to = F.array(F.struct(pid.alias("pid"), F.lit(False).alias("carry")))
    ahead = F.array(F.struct(F.pmod(pid + 1, F.lit(len(bounds))).alias("pid"), F.lit(True).alias("carry")))
    routed = rows.withColumn("to", F.when(F.array_contains("own", F.col("doc_id")), F.concat(to, ahead)).otherwise(to))
    return routed.select(F.explode("to").alias("to"), "doc_id", "text").select("to.pid", "to.carry", "doc_id", "text"), len(bounds)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for b in batches:
        out: list[tuple] = []
        for carry, doc, text in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            own = fingerprint(text)
            if not carry:
                half = len(text) // 2
                edited = text[: len(text) - half] + last[0][:half]
                fp = fingerprint(edited)
                out.append((None if doc == LEAST_ID else doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), render(own), render(fp), likeness(own, fp), likeness(own, last[1])))
            last = (text, own)
        cols = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (see op6 of the contract), and likenesses."""
    arrow_batches(docs.sparkSession)
    routed, n = with_next(docs)
    return routed.repartitionById(n, "pid").sortWithinPartitions(F.desc("carry"), "doc_id", "text").mapInArrow(_compare, SCHEMA)


def op6_syncmers(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
