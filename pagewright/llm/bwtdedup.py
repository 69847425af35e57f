"""Removal of repeated passages: every byte covered by a LENGTH-byte string that also starts earlier.

Merging the transforms of a whole corpus moves every suffix once a refinement round, which no shuffle
budget holds. So the corpus is first dealt by content, and transforms are merged where passages meet:

1. Each LENGTH-byte window names an anchor, its GRAM-byte substring of smallest hash. Consecutive
   windows with one anchor form a segment. Equal windows have equal anchors at equal offsets. Of equal
   segments within a task only the first goes on, the rest are repeats already.
2. Segments meet by anchor. Of equal segments (64 bits of anchor and 64 of content) the first stays, the rest are repeats. What remains
   undecided is segments of one anchor with different content that share the bytes next to it.
3. Only the undecided segments' bytes are dealt out, by anchor. Each shard of them gets its Burrows-
   Wheeler transform, and the shards' transforms are merged by iterative interleave refinement:
   round h orders all suffixes by h bytes from the order by h - 1, and marks where neighbours differ,
   without sorting suffixes again. After LENGTH rounds an interval without marks is a repeated string
   (its common prefix is LENGTH or more); all but its first occurrence are repeats.
4. Repeats are united by document and cut out of its bytes.

Documents are ordered by doc_id; null doc_ids come first, and rows with equal doc_id follow each other
by text, so that of a repeated row the first stays. Null texts count as empty. Other columns are not read. No rows
in, no rows out.
Texts longer than CHUNK bytes are cut into chunks of windows, which changes nothing but the segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm._common import arrow_batches, shuffle_partitions, table, written

LENGTH, GRAM = 100, 32
HALF = (LENGTH - GRAM) // 2
CHUNK = 4 << 20
SHARD = 128 << 10
MERGE = 2 << 20
"""Bytes of shards merged at once, by ranges of anchors; anchors are never divided."""
C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
NONE = 1 << 16


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * C[2]
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    n = len(data) - GRAM + 1
    h = np.full(n, C[3])
    for k in range(0, GRAM, 8):
        word = np.ndarray((n,), "<u8", data, k, (1,))
        h = (h ^ word) * C[(k // 8) % 2]
        h ^= h >> np.uint64(31)
    return _mix(h)


SEGMENT = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("ord", "<i8"), ("start", "<i8"), ("runs", "u1"), ("off", "u1"), ("left", "<i4"), ("right", "<i4")])


def segments(texts: list[bytes], ords: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """The segments of some documents (or chunks, whose places start at starts), as SEGMENT records.

    start is the first window, runs how many further windows follow, off the anchor's distance from
    start; left and right hash the GRAM bytes beside the anchor where windows reach that far.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return np.empty(0, SEGMENT)
    gram = gram_hashes(data)
    value, place, width, most = gram, np.zeros(len(gram), np.uint8), 1, LENGTH - GRAM + 1
    while width < most:  # smallest hash of each window, the first of equals
        step = min(width, most - width)
        later = value[step:] < value[:-step]
        place = np.where(later, place[step:] + np.uint8(step), place[:-step])
        value = np.where(later, value[step:], value[:-step])
        width += step
    doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - LENGTH + 1, 0))
    first = np.cumsum(np.maximum(sizes - LENGTH + 1, 0))
    window = np.arange(len(doc)) - np.concatenate(([0], first))[doc] + at[doc]
    if not len(window):
        return np.empty(0, SEGMENT)
    anchor = window + place[window]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(doc) != 0))))
    s, e, a = window[new], window[np.append(new[1:], len(window)) - 1], anchor[new]
    out = np.empty(len(new), SEGMENT)
    out["anchor"] = gram[a]
    h = np.full(len(new), C[3])
    for k in range(0, 2 * LENGTH, GRAM):  # GRAM-byte blocks that cover the content
        h = _mix((h ^ gram[np.minimum(s + k, e + LENGTH - GRAM)]) * C[0] + C[1])
        if k >= LENGTH + most - GRAM:
            break
    out["runs"], out["off"] = e - s, a - s
    out["content"] = _mix(h + out["runs"].astype(np.uint64) * C[0] + out["off"].astype(np.uint64) * C[1])
    d = doc[new]
    out["ord"], out["start"] = ords[d], s - at[d] + (0 if starts is None else starts[d])
    beside = lambda i: (gram[np.clip(i, 0, len(gram) - 1)] & np.uint64(NONE - 1)).astype(np.int32)
    out["left"] = np.where(a - s >= HALF, beside(a - GRAM), NONE)
    out["right"] = np.where(a - e < HALF, beside(a + GRAM), NONE)
    return out


def first_of_equal(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of equal segments, and the repeats."""
    order = np.lexsort((seg["start"], seg["ord"], seg["content"], seg["anchor"]))
    seg = seg[order]
    new = np.ones(len(seg), bool)
    new[1:] = (seg["anchor"][1:] != seg["anchor"][:-1]) | (seg["content"][1:] != seg["content"][:-1])
    return seg[new], seg[~new]


def undecided(seg: np.ndarray) -> np.ndarray:
    """Of different segments, those that share anchor and bytes on one side with another one."""
    hit = np.zeros(len(seg), bool)
    for side in ("left", "right"):
        order = np.lexsort((seg[side], seg["anchor"]))
        a, x = seg["anchor"][order], seg[side][order]
        same = np.zeros(len(seg) + 1, bool)
        same[1:-1] = (a[1:] == a[:-1]) & (x[1:] == x[:-1]) & (x[1:] != NONE)
        hit[order] |= same[1:] | same[:-1]
    return seg[hit]


def pack(seg: np.ndarray) -> bytes:
    """Records as bytes: columns that follow the document compressed, hashes as they are."""
    seg = seg[np.lexsort((seg["start"], seg["ord"]))]
    side = lambda x: np.where(x == NONE, 0, x).astype("<u2")
    near = [np.diff(seg["ord"], prepend=0).astype("<i8"), np.diff(seg["start"], prepend=0).astype("<i4"), seg["runs"], seg["off"], np.packbits(seg["left"] == NONE), np.packbits(seg["right"] == NONE)]
    rest = [side(seg["left"]), side(seg["right"]), seg["anchor"], seg["content"]]
    return np.int64(len(seg)).tobytes() + zstandard.compress(b"".join(c.tobytes() for c in near), 1) + b"".join(c.tobytes() for c in rest)


def unpack(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    seg = np.zeros(n, SEGMENT)
    rest = n * (2 + 2 + 8 + 8)
    body, raw = zstandard.decompress(blob[8 : len(blob) - rest]), blob[len(blob) - rest :]
    bits = (n + 7) // 8
    seg["ord"] = np.cumsum(np.frombuffer(body, "<i8", n))
    seg["start"] = np.cumsum(np.frombuffer(body, "<i4", n, 8 * n).astype(np.int64))
    seg["runs"], seg["off"] = np.frombuffer(body, "u1", n, 12 * n), np.frombuffer(body, "u1", n, 13 * n)
    none = [np.unpackbits(np.frombuffer(body, "u1", bits, 14 * n + k * bits))[:n].astype(bool) for k in (0, 1)]
    seg["left"], seg["right"] = (np.where(none[k], NONE, np.frombuffer(raw, "<u2", n, 2 * n * k)) for k in (0, 1))
    seg["anchor"], seg["content"] = np.frombuffer(raw, "<u8", n, 4 * n), np.frombuffer(raw, "<u8", n, 12 * n)
    return seg


def united(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint and non-touching [start, end) spans of the same bytes."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > end[:-1]))
    return np.stack((spans[new, 0], end[np.append(np.flatnonzero(new)[1:], len(spans)) - 1]), 1)


def by_document(ords: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(ords, kind="stable")
    ords, rows = ords[order], rows[order]
    cut = np.flatnonzero(np.diff(ords)) + 1
    for a, b in zip(np.concatenate(([0], cut)), np.append(cut, len(ords)), strict=True):
        if b > a:
            yield int(ords[a]), rows[a:b]


def _spans(seg: np.ndarray) -> np.ndarray:
    return np.stack((seg["start"], seg["start"] + seg["runs"] + LENGTH), 1)


PIECE = "pid int, ord long, kind int, data binary"
PIECES = pa.schema([("pid", pa.int32()), ("ord", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
SEGMENTS, REPEATS, OPEN, BYTES = range(4)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES, strict=True)], schema=PIECES)


def _batches(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[3])
        if size >= most or len(out) >= 20_000:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _repeat_rows(repeats: np.ndarray, n: int) -> Iterator[tuple]:
    for doc, spans in by_document(repeats["ord"], _spans(repeats)):
        yield doc % n, doc, REPEATS, united(spans).astype("<i8").tobytes()


def _chunks(texts: list[bytes], ords: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    parts = [(t[k : k + CHUNK + LENGTH - 1], o, k) for t, o in zip(texts, ords.tolist(), strict=True) if len(t) >= LENGTH for k in range(0, len(t) - LENGTH + 1, CHUNK)]
    return [p[0] for p in parts], np.array([p[1] for p in parts], np.int64), np.array([p[2] for p in parts], np.int64)


def _cut_up(n: int):
    """Documents (ord, text) -> their segments by anchor, and what repeats within the task."""

    def flush(held: list[np.ndarray]) -> Iterator[tuple]:
        if not held:
            return
        seg = np.concatenate(held)
        seg, repeats = first_of_equal(seg)
        yield from _repeat_rows(repeats, n)
        pid = (seg["anchor"] % np.uint64(n)).astype(np.int64)
        for p, own in by_document(pid, seg):
            yield p, 0, SEGMENTS, pack(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            texts, ords, starts = _chunks([(t or "").encode() for t in b.column(1).to_pylist()], b.column(0).to_numpy(zero_copy_only=False))
            if texts:
                held.append(segments(texts, ords, starts))
                size += len(held[-1])
            if size > 1_500_000:
                yield from _batches(flush(held))
                held, size = [], 0
        yield from _batches(flush(held))

    return run


def _meet(n: int):
    """All segments of some anchors -> repeats, and the undecided ones, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            own = [unpack(x) for k, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True) if k == SEGMENTS]
            passed = b.filter(pa.compute.equal(b.column(2), REPEATS))
            if passed.num_rows:
                yield passed
            held += own
        if not held:
            return
        seg, repeats = first_of_equal(np.concatenate(held))
        held.clear()
        yield from _batches(_repeat_rows(repeats, n))
        seg = undecided(seg)
        rows = np.stack((seg["anchor"].astype(np.int64), seg["start"], seg["runs"].astype(np.int64)), 1)
        yield from _batches((doc % n, doc, OPEN, r.astype("<i8").tobytes()) for doc, r in by_document(seg["ord"], rows))

    return run


def _fetch(n: int):
    """(ord, compressed text, undecided segments) -> their bytes, by anchor."""

    def pieces(held: list[tuple[np.ndarray, bytes]]) -> Iterator[tuple]:
        if not held:
            return
        rows = np.concatenate([h[0] for h in held])
        data = np.frombuffer(b"".join(h[1] for h in held), np.uint8)
        size = rows[:, 3] + LENGTH
        at = np.cumsum(size) - size
        for p, own in by_document(rows[:, 0] % n, np.arange(len(rows))):
            text = np.concatenate([data[at[i] : at[i] + size[i]] for i in own])
            yield p, 0, BYTES, np.int64(len(own)).tobytes() + rows[own].astype("<i8").tobytes() + text.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, packed, blobs in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                text = zstandard.decompress(packed)
                r = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 3)
                data = b"".join(text[s : s + k + LENGTH] for s, k in r[:, 1:].tolist())
                held.append((np.stack((r[:, 0], np.full(len(r), doc), r[:, 1], r[:, 2]), 1), data))
                size += len(data)
            if size > 16 << 20:
                yield from _batches(pieces(held))
                held, size = [], 0
        yield from _batches(pieces(held))

    return run


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of one shard by prefix doubling, from its first 7 symbols on."""
    n, width = len(text), 7
    key = np.zeros(n, np.int64)
    for k in range(width):
        key[: max(0, n - k)] |= text[k:].astype(np.int64) << (8 * (width - 1 - k))
    rank = np.empty(n, np.int64)
    while True:
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: max(0, n - width)] += rank[width:] + 1
        width *= 2


def merge(shards: list[np.ndarray], ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the shards' Burrows-Wheeler transforms by interleave refinement.

    A shard is strings of symbols, each followed by a 0. ends marks, in the shards laid end to end, the
    places where a window of interest ends; the suffixes there are what round 0 orders. Each round goes
    one symbol back from each, so after `length` rounds the windows stand in order of their symbols.
    A suffix that differs from both neighbours stays so in all later rounds and is left out.
    Returns the places of the windows that occur more than once, in order, and marks of where a window
    differs from the one before it.
    """
    order, bwt, back, at = [], [], [], 0
    for text in shards:
        sa = suffix_order(text)
        b = text[sa - 1]  # what precedes the first place is never asked for
        lf = np.empty(len(b), np.int32)  # from a suffix to the one a symbol longer
        lf[np.argsort(b, kind="stable")] = np.arange(len(b), dtype=np.int32)
        order.append(sa + at)
        bwt.append(b)
        back.append(lf + at)
        at += len(text)
    sa, b, lf = np.concatenate(order), np.concatenate(bwt), np.concatenate(back).astype(np.int32)
    row = np.flatnonzero(ends[sa]).astype(np.int32)  # round 0: one shard after the other
    new = np.zeros(len(row), bool)
    new[:1] = True
    for _ in range(length):
        # where the order by h symbols puts x, the order by h + 1 puts cx in the stretch of its symbol c
        c = b[row]
        to = np.argsort(c, kind="stable")
        block, c = np.cumsum(new, dtype=np.int32)[to], c[to]
        row = lf[row][to]
        new = np.ones(len(row) + 1, bool)
        new[1:-1] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        kept = ~(new[:-1] & new[1:])
        row, new = row[kept], new[:-1][kept]
        if not len(row):
            break
    return sa[row], new


def repeated_windows(rows: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """rows (ord, start) and bytes of segments -> (ord, place) of windows that also start earlier."""
    shards: list[np.ndarray] = []
    part, size = [], 0
    for t in texts:
        part += [t + np.uint8(1), np.zeros(1, np.uint8)]  # UTF-8 has no byte 255
        size += len(t) + 1
        if size >= SHARD:
            shards.append(np.concatenate(part))
            part, size = [], 0
    if part:
        shards.append(np.concatenate(part))
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    ends = np.arange(sizes.sum()) - np.repeat(begin, sizes) >= LENGTH
    place, new = merge(shards, ends, LENGTH)
    own = np.searchsorted(begin, place, side="right") - 1
    doc, start, block = rows[own, 0], rows[own, 1] + place - begin[own], np.cumsum(new)
    order = np.lexsort((start, doc, block))
    block, doc, start = block[order], doc[order], start[order]
    again = np.concatenate(([False], block[1:] == block[:-1])) if len(block) else np.zeros(0, bool)
    # one window may lie in several segments' bytes: the same place is no repeat of itself
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(block)))) if len(block) else np.zeros(0, int)
    again &= (doc != doc[first]) | (start != start[first])
    return np.stack((doc[again], start[again]), 1)


def _match(n: int):
    """All bytes of some anchors' undecided segments -> repeats by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts = [], []
        for b in batches:
            for blob in b.column(3).to_pylist():
                k = int(np.frombuffer(blob, "<i8", 1)[0])
                r = np.frombuffer(blob, "<i8", 4 * k, 8).reshape(-1, 4)
                data = np.frombuffer(blob, np.uint8, offset=8 + 32 * k)
                rows.append(r)
                texts += np.split(data, np.cumsum(r[:, 3] + LENGTH)[:-1])
        if not rows:
            return
        r = np.concatenate(rows)
        order = np.lexsort((r[:, 2], r[:, 1], r[:, 0]))
        r = r[order]
        size = np.cumsum(r[:, 3] + LENGTH)
        cut = np.flatnonzero(np.diff(r[:, 0])) + 1  # anchors stay whole
        a, found = 0, []
        for z in np.append(cut, len(r)).tolist():
            if z == len(r) or size[z - 1] - (size[a - 1] if a else 0) >= MERGE:
                found.append(repeated_windows(r[a:z, 1:3], [texts[i] for i in order[a:z]]))
                a = z
        w = np.concatenate(found)
        spans = np.stack((w[:, 1], w[:, 1] + LENGTH), 1)
        yield from _batches((doc % n, doc, REPEATS, united(s).astype("<i8").tobytes()) for doc, s in by_document(w[:, 0], spans))

    return run


def _ordered(docs: DataFrame) -> DataFrame:
    """(ord, doc_id, text) with a unique ord for each row in the order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    unclear = rows.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if unclear.isEmpty():
        return rows.select(F.col("doc_id").alias("ord"), "doc_id", "text")
    order = (F.asc_nulls_first("doc_id"), F.asc("text"))
    ranged = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return written(ranged.select(F.monotonically_increasing_id().alias("ord"), "doc_id", "text"), "dedup-rows")  # rises from range to range


def _squeezed(rows: DataFrame) -> DataFrame:
    """(ord, doc_id, packed): texts compressed for the shuffles that carry them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = pa.array([press.compress((t or "").encode()) for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], ["ord", "doc_id", "packed"])

    return rows.mapInArrow(run, "ord long, doc_id long, packed binary")


def repeats(rows: DataFrame) -> DataFrame:
    """rows(ord, doc_id, text) -> (ord, spans): blobs of (start, end) pairs of bytes to remove."""
    n = shuffle_partitions(rows.sparkSession)
    deal = lambda df: df.repartitionById(n, F.pmod("pid", F.lit(n)).cast("int"))
    met = written(deal(rows.select("ord", "text").mapInArrow(_cut_up(n), PIECE)).mapInArrow(_meet(n), PIECE), "dedup-met")
    still = met.where(F.col("kind") == OPEN).groupBy("ord").agg(F.collect_list("data").alias("open"))
    fetched = _squeezed(rows).join(still, "ord").select("ord", "packed", "open").mapInArrow(_fetch(n), PIECE)
    matched = written(deal(fetched).mapInArrow(_match(n), PIECE), "dedup-matched")
    both = met.where(F.col("kind") == REPEATS).union(matched)
    return both.groupBy("ord").agg(F.collect_list("data").alias("spans"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, packed, blobs in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            data = zstandard.decompress(packed)
            spans = united(np.frombuffer(b"".join(blobs or ()), "<i8").reshape(-1, 2))
            kept, at = [], 0
            for s, e in spans.tolist():
                kept.append(data[at:s])
                at = e
            kept.append(data[at:])
            rest = b"".join(kept)
            out.append((doc, len(data), len(data) - len(rest), len(spans), rest))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of docs; kept is the remaining bytes."""
    arrow_batches(docs.sparkSession)
    rows = _ordered(docs)
    joined = _squeezed(rows).join(repeats(rows), "ord", "left").select("doc_id", "packed", "spans")
    return joined.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
