"""Hard-negative mining with a vantage-point tree over norm-augmented vectors.

A vector x of norm |x| gets the component sqrt(M^2 - |x|^2), M the largest norm; an anchor a gets 0.
Then |a - x|^2 = |a|^2 + M^2 - 2 score: the highest inner product is the nearest point, and a window
of scores is an annulus around the anchor.

The tree's vantage points and radii are fitted to a sample (SAMPLE_ROWS and SAMPLE_BYTES at most, in expectation). Every row
is then led to its leaf, leaves are stored as blocks of up to BLOCK_ROWS rows, and each leaf keeps the least
and largest distance of *its own rows* to each vantage point above it. By the triangle inequality
these bound the distance, and so the score, of an anchor to anything in the leaf. Searching goes
nearest first in two steps: each anchor takes the FIRST leaves in its annulus that may come nearest, then, of the
others, those that can still hold something no worse than its k-th best. Anchors and leaves meet by an
equi-join on the leaf, in packs; scores of a pack against a block are one matrix product. What a
pair yields is k rows an anchor at most, and the best are kept by a rank with a limit before the shuffle. Results are exact:
bounds only leave out leaves that can't matter. In high dimensions bounds are weak (distances are alike)
and most leaves are visited, so work then grows as anchors times rows.

Rows with a null label, a null vector or any null or non-finite component take no part; nor do rows
without an id, which couldn't be named. Vectors of fewer components are filled up with zeros. Rows
that repeat are rows of their own, as anchors and as partners; an anchor isn't its own positive, its
copy is. Scores are exact while sums of products stay below 2^53. No rows in, no rows out. Other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.llm._common import arrow_batches, shuffle_partitions, table, written

SCALE = 256
EVERY = 50
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
"""A negative's score in hundredths of its positive's."""
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 32 << 20
LEAF_ROWS, BLOCK_ROWS = 1024, 4096
LEAST_SAMPLE = 16
"""Sampled rows of a leaf, about, at least."""
PACK_ROWS = 512
FIRST = 2
NONE, ALL = np.int64(1 << 62), np.int64(-(1 << 62))


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows with one more component, which brings them all to the norm `largest`."""
    return np.concatenate((x, np.sqrt(np.maximum(0, largest**2 - (x**2).sum(1)))[:, None]), 1)


class Tree:
    """A complete binary tree of vantage points in heap order: the left child holds what is within the radius."""

    def __init__(self, sample: np.ndarray, levels: int, largest: float):
        nodes = (1 << levels) - 1
        self.levels, self.largest, sample = levels, largest, augmented(sample, largest)
        self.vantage, self.radius = np.zeros((nodes, sample.shape[1])), np.zeros(nodes)
        own = {0: sample}
        for i in range(nodes):
            x = own.pop(i)
            if len(x):  # the point farthest from the vantage point above: its distances differ most
                self.vantage[i] = x[int(((x - self.vantage[(i - 1) // 2 if i else 0]) ** 2).sum(1).argmax())]
                away = self.away(x, i)
                self.radius[i] = np.median(away)
                own[2 * i + 1], own[2 * i + 2] = x[away <= self.radius[i]], x[away > self.radius[i]]
            else:
                own[2 * i + 1] = own[2 * i + 2] = x
        leaf = np.arange(1 << levels) + nodes
        self.path = np.zeros((len(leaf), levels), int)  # the nodes above each leaf, from the root
        for j in range(levels)[::-1]:
            leaf = (leaf - 1) // 2
            self.path[:, j] = leaf

    def away(self, x: np.ndarray, node: int | np.ndarray) -> np.ndarray:
        return np.sqrt(((x - self.vantage[node]) ** 2).sum(1))

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row and its distances to the vantage points above."""
        x = augmented(x, self.largest)
        node, seen = np.zeros(len(x), int), np.zeros((len(x), self.levels))
        for j in range(self.levels):
            seen[:, j] = self.away(x, node)
            node = 2 * node + 1 + (seen[:, j] > self.radius[node])
        return node - len(self.radius), seen


class Index:
    """The tree with what its leaves hold: lo and hi are the least and largest distances of a leaf's rows to its path."""

    def __init__(self, tree: Tree, lo: np.ndarray, hi: np.ndarray, kind: str):
        self.tree, self.lo, self.hi, self.kind = tree, lo, hi, kind
        self.slack = 1e-7 * (tree.largest + 1)

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that each leaf can have with each anchor (rows of q); none for empty leaves."""
        t = self.tree
        norm = (q**2).sum(1) + t.largest**2
        to = np.sqrt(np.maximum(0, norm[:, None] - 2 * (q @ t.vantage[:, :-1].T)))
        near, far = np.zeros((len(q), len(self.lo))), np.full((len(q), len(self.lo)), np.inf)
        for j in range(t.levels):
            d = to[:, t.path[:, j]]
            near = np.maximum(near, np.maximum(d - self.hi[:, j], self.lo[:, j] - d))
            far = np.minimum(far, d + self.hi[:, j])
        most = (norm[:, None] - np.maximum(0, near - self.slack) ** 2) / 2
        least = (norm[:, None] - (far + self.slack) ** 2) / 2
        most[:, np.isinf(self.lo[:, 0])] = -np.inf
        return least, most

    def visits(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, kth: np.ndarray | None) -> np.ndarray:
        """Anchors x leaves: is the leaf to be seen? lo, hi: windows of scores, anchors x windows.

        Without kth the leaves that may come nearest, FIRST a window; with it (the k-th best score so
        far, or ALL where there are fewer) all others that can still matter.
        """
        least, most = self.scores(q)
        first, rest = np.zeros(most.shape, bool), np.zeros(most.shape, bool)
        for w in range(lo.shape[1]):
            inside = (most >= lo[:, w, None]) & (least <= hi[:, w, None])
            best = np.where(inside, np.minimum(most, hi[:, w, None]), -np.inf)
            k = min(FIRST, best.shape[1])
            np.put_along_axis(first, np.argpartition(-best, k - 1, axis=1)[:, :k], True, 1)
            if kth is not None:
                rest |= inside & (most >= kth[:, w, None])
        return rest & ~first if kth is not None else first & (most > -np.inf)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays as rows of `width` numbers, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, offset = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    if len(flat) == len(column) * width and (np.diff(offset) == width).all():
        return flat.reshape(len(column), width).astype(float)
    out = np.zeros((len(column), width))
    n = np.diff(offset)
    row = np.repeat(np.arange(len(column)), n)
    out[row, np.arange(len(flat)) - np.repeat(offset[:-1], n)] = flat
    return out


def _raw(x: np.ndarray, kind: str = "<i8") -> bytes:
    return np.ascontiguousarray(x).astype(kind).tobytes()


def quantised(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q is floor(256 x) of each component."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = F.col("label") if label is None else label
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), own.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * SCALE).cast("double")).alias("q"))


def _blocks(rows: DataFrame, tree: Tree, width: int, kind: str, spread: np.ndarray) -> DataFrame:
    """(leaf, ids, labels, vectors, lo, hi): rows in blocks; the rows of leaf i are dealt to spread[i] tasks."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(2), width)
                leaf, seen = tree.route(x)
                salt = (np.arange(len(leaf)) + at) % spread[leaf]
                at += len(leaf)
                yield pa.RecordBatch.from_pydict({"leaf": pa.array(leaf, pa.int32()), "salt": pa.array(salt, pa.int32()), "id": b.column(0), "label": b.column(1), "x": pa.array([_raw(v, kind) for v in x]), "seen": pa.array([_raw(v, "<f8") for v in seen])})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            ids, labels = (np.array([r[i] for r in held], np.int64) for i in (1, 2))
            order = np.argsort(ids, kind="stable")
            seen = np.frombuffer(b"".join(r[4] for r in held), "<f8").reshape(len(held), tree.levels)
            rows = b"".join(held[i][3] for i in order)
            return pa.RecordBatch.from_pydict({"leaf": pa.array([held[0][0]], pa.int32()), "ids": [_raw(ids[order])], "labels": [_raw(labels[order])], "vectors": [rows], "lo": [seen.min(0).tolist()], "hi": [seen.max(0).tolist()]})

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if held and (r[0] != held[0][0] or len(held) == BLOCK_ROWS):
                    yield block()
                    held = []
                held.append(r)
        if held:
            yield block()

    routed = rows.select("vec_id", "label", "q").mapInArrow(route, "leaf int, salt int, id long, label long, x binary, seen binary")
    n = shuffle_partitions(rows.sparkSession)
    return routed.repartition(n, "leaf", "salt").sortWithinPartitions("leaf", "salt").mapInArrow(pack, "leaf int, ids binary, labels binary, vectors binary, lo array<double>, hi array<double>")


def fit(rows: DataFrame, seed: int = 0) -> tuple[Index, DataFrame] | None:
    """The index over all rows and its written blocks; None if there are no rows."""
    square = F.aggregate("q", F.lit(0.0), lambda s, c: s + c * c)
    n, width, norm, top = rows.agg(F.count("*"), F.max(F.size("q")), F.max(square), F.max(F.array_max(F.transform("q", F.abs)))).first()
    if not n:
        return None
    kind = "<i2" if (top or 0) < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    share = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, width))) / n
    few = rows.sample(False, share, seed) if share < 1 else rows
    sample = matrix(few.select("q").toArrow().column(0), width)
    levels = max(1, (min(n // LEAF_ROWS, len(sample) // LEAST_SAMPLE)).bit_length())
    tree = Tree(sample, levels, float(np.sqrt(norm)))
    of = np.bincount(tree.route(sample)[0], minlength=1 << levels) if len(sample) else np.zeros(1 << levels)
    spread = np.maximum(1, np.ceil(of / max(1, len(sample)) * n / BLOCK_ROWS)).astype(int)
    blocks = written(_blocks(rows, tree, width, kind, spread), "vp-blocks")
    lo, hi = np.full((1 << levels, levels), np.inf), np.full((1 << levels, levels), -np.inf)
    ends = blocks.select("leaf", F.posexplode(F.arrays_zip("lo", "hi")).alias("j", "x")).groupBy("leaf", "j").agg(F.min("x.lo"), F.max("x.hi"))
    for leaf, j, least, most in ends.collect():  # a row for each leaf and level
        lo[leaf, j], hi[leaf, j] = least, most
    return Index(tree, lo, hi, kind), blocks.drop("lo", "hi")


CANDIDATES = "uid long, w int, score long, id long"


def _search(state: DataFrame, index: Index, blocks: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """One step of the search: state(uid, label, q, lo, hi, kth) -> CANDIDATES, k a window and pair of pack and block at most.

    lo, hi, kth are arrays, a number for each window; kth is null in the first step. same: do partners have the anchor's label, or another?
    """

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PACK_ROWS):
                b = whole.slice(at, PACK_ROWS)
                q, uid, label = matrix(b.column("q"), width), b.column("uid").to_numpy(), b.column("label").to_numpy()
                lo, hi, kth = (np.array(b.column(c).to_pylist(), np.int64).reshape(len(q), -1) if b.column(c).null_count == 0 else None for c in ("lo", "hi", "kth"))
                to_see = index.visits(q, lo, hi, kth)
                low = lo if kth is None else np.maximum(lo, kth)
                for leaf in np.flatnonzero(to_see.any(0)):
                    m = np.flatnonzero(to_see[:, leaf])
                    yield pa.RecordBatch.from_pydict({"leaf": pa.array([leaf], pa.int32()), "uid": [_raw(uid[m])], "label": [_raw(label[m])], "q": [_raw(q[m], index.kind)], "low": [_raw(low[m])], "high": [_raw(hi[m])]})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x, kind="<i8": np.frombuffer(x, kind)
        for b in batches:
            for r in b.to_pylist():
                uid, label, ids, labels = (read(r[c]) for c in ("uid", "label", "ids", "labels"))
                score = (read(r["q"], index.kind).reshape(len(uid), width).astype(float) @ read(r["vectors"], index.kind).reshape(len(ids), width).T.astype(float)).astype(np.int64)
                fits = (label[:, None] == labels[None]) == same
                low, high = (read(r[c]).reshape(len(uid), -1) for c in ("low", "high"))
                for w in range(low.shape[1]):
                    i, j = np.nonzero(fits & (score >= low[:, w, None]) & (score <= high[:, w, None]))
                    if len(i):
                        s = score[i, j]
                        order = np.lexsort((ids[j], -s, i))
                        i, j, s = i[order], j[order], s[order]
                        rank = np.arange(len(i)) - np.searchsorted(i, i)
                        i, j, s = i[rank < k], j[rank < k], s[rank < k]
                        yield pa.RecordBatch.from_arrays([pa.array(uid[i]), pa.array(np.full(len(i), w, np.int32)), pa.array(s), pa.array(ids[j])], ["uid", "w", "score", "id"])

    seen = state.select("uid", "label", "q", "lo", "hi", "kth").mapInArrow(packs, "leaf int, uid binary, label binary, q binary, low binary, high binary")
    # merged: Spark takes packs to be as small as the anchors that they come from, and would send them all through the driver
    return seen.hint("merge").join(blocks, "leaf").mapInArrow(pairs, CANDIDATES)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("uid", "w").orderBy(F.desc("score"), "id"))
    return candidates.withColumn("rank", place).where(F.col("rank") <= k)


def nearest(state: DataFrame, index: Index, blocks: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """(uid, w, score, id, rank): the k best of each anchor and window; state(uid, label, q, lo, hi)."""
    first = written(_best(_search(state.withColumn("kth", F.lit(None).cast("array<long>")), index, blocks, width, same, k), k), "vp-first")
    kth = first.where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("m"))
    own = state.join(kth.withColumnRenamed("uid", "of"), F.col("uid") == F.col("of"), "left")
    kth = F.transform("lo", lambda _, w: F.coalesce(F.element_at("m", w), F.lit(int(ALL))))
    rest = _search(own.withColumn("kth", kth), index, blocks, width, same, k)
    return _best(first.drop("rank").unionByName(rest), k)


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """rows(vec_id, label, q) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by `every`. Positives: the first rows of the anchor's label,
    highest score first, ties by smaller vec_id. Negatives of a positive: the first rows of other labels whose score is
    `low` to `high` hundredths of the positive's.
    """
    spark = rows.sparkSession
    arrow_batches(spark)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = fit(rows)
    if found is None:
        return spark.createDataFrame([], shape)
    index, blocks = found
    width = index.tree.vantage.shape[1] - 1
    anchors = written(rows.where(F.col("vec_id") % every == 0).withColumn("uid", F.monotonically_increasing_id()), "vp-anchors")
    one = lambda v: F.array(F.lit(int(v)))
    near = nearest(anchors.withColumns({"lo": one(ALL), "hi": one(NONE)}), index, blocks, width, True, positives + 1)
    tops = near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("tops"))  # positives + 1 a row
    own = F.struct((-F.aggregate("q", F.lit(0.0), lambda s, c: s + c * c).cast("long")).alias("less"), F.col("vec_id").alias("id"))
    state = anchors.join(tops.withColumnRenamed("uid", "of"), F.col("uid") == F.col("of")).withColumn("self", F.array_position("tops", own).cast("int"))
    others = F.when(F.col("self") > 0, F.concat(F.expr("slice(tops, 1, self - 1)"), F.expr("slice(tops, self + 1, size(tops))"))).otherwise(F.col("tops"))
    state = written(state.withColumn("tops", F.slice(others, 1, positives)).where("size(tops) > 0").drop("of", "self"), "vp-positives")
    windows = {  # ceil(low p / 100) to floor(high p / 100), in whole numbers
        "lo": F.expr(f"transform(tops, t -> (t.less * -{low}L + pmod(t.less * {low}L, 100L)) div 100)"),
        "hi": F.expr(f"transform(tops, t -> (t.less * -{high}L - pmod(t.less * -{high}L, 100L)) div 100)"),
    }
    hard = written(nearest(state.withColumns(windows), index, blocks, width, False, negatives), "vp-negatives")
    of = state.select(F.col("uid").alias("of"), F.col("vec_id").alias("anchor_id"), F.posexplode("tops").alias("at", "top"))
    out = hard.join(of, (F.col("uid") == F.col("of")) & (F.col("w") == F.col("at")))
    return out.select("anchor_id", F.col("top.id").alias("positive_id"), F.col("rank").cast("int"), F.col("id").alias("negative_id"), (-F.col("top.less")).alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled() -> Column:
    """The labels of the query: of each seventh vec_id the next one of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(quantised(table(spark, sf_dir, "embeddings"), relabelled()))


ORACLE = """
with finite as (select vec_id, label, embedding from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
v as (select row_number() over () as u, cast(vec_id as bigint) as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as q from finite),
s as (select a.u as au, a.id as anchor_id, b.id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score from v a, v b where a.id % 50 = 0 and a.u <> b.u),
p as (select au, anchor_id, id as positive_id, score as positive_score, row_number() over (partition by au order by score desc, id) as k from s where same),
n as (select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.au, p.k order by s.score desc, s.id) as rank from p join s using (au)
  where p.k <= 5 and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
