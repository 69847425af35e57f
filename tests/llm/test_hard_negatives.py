"""Hard negatives of the vantage-point tree against all inner products, on hard rows."""

import math
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<float>, q string, uid int, leaf string, lo double"


def brute(rows):
    own = []
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    width = max((len(q) for *_, q in own), default=0)
    q = np.array([x + [0] * (width - len(x)) for *_, x in own], dtype=object).reshape(len(own), width)
    out = Counter()
    for k, (anchor, label, _) in enumerate(own):
        if anchor % 50 == 0:
            score = [int(s) for s in q @ q[k]]
            near = sorted((-score[j], r[0]) for j, r in enumerate(own) if j != k and r[1] == label)[:5]
            for less, positive in near:
                hard = sorted((-score[j], r[0]) for j, r in enumerate(own) if r[1] != label and 50 * -less <= 100 * score[j] <= 95 * -less)[:3]
                out.update((anchor, positive, rank, i, -less, -s) for rank, (s, i) in enumerate(hard, 1))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 0.5) for r in rows], SCHEMA)


def clustered(n, seed=3):
    """Vectors of very different norms in clusters, copies among them, with labels that cross clusters."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, 5)) * rng.uniform(0.1, 3, (6, 1))
    rows = []
    for i in range(n):
        x = centre[i % 6] + rng.normal(size=5) * 0.2
        rows.append((i, int(rng.integers(0, 4)), [float(np.float32(c)) for c in (rows[-1][2] if i % 11 == 0 and i else x)]))
    return rows


@pytest.mark.parametrize("shape", [(8, 16, 1), (1024, 4096, 2)])
def test_mining_equals_brute_force(spark, monkeypatch, shape):
    for name, v in zip(("LEAF_ROWS", "BLOCK_ROWS", "FIRST"), shape, strict=True):
        monkeypatch.setattr(hardneg, name, v)
    monkeypatch.setattr(hardneg, "LEAST_SAMPLE", 4)
    rows = clustered(400)
    rows += [(50, 1, [0.5] * 5), (50, 1, [0.5] * 5), (100, 2, [1.0]), (150, 3, []), (200, None, [1.0] * 5), (250, 1, None), (None, 1, [1.0] * 5), (300, 1, [float("nan")] * 5), (350, 2, [1.0, None, 0.0, 0.0, 0.0]), (-50, 1, [-0.5] * 5), (401, 1, [float("inf")] + [0.0] * 4)]
    df = frame(spark, rows)
    got = hardneg.mine(hardneg.quantised(df, hardneg.relabelled()))
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_bounds_leave_leaves_out():
    rows = clustered(3000)
    x = np.floor(256 * np.array([r[2] for r in rows]))
    largest = float(np.sqrt((x**2).sum(1).max()))
    tree = hardneg.Tree(x[::10], 5, largest)
    leaf, seen = tree.route(x)
    lo, hi = np.full((32, 5), np.inf), np.full((32, 5), -np.inf)
    for i in set(leaf):
        lo[i], hi[i] = seen[leaf == i].min(0), seen[leaf == i].max(0)
    index = hardneg.Index(tree, lo, hi, "<i2")
    least, most = index.scores(x[::50])
    score = x[::50] @ x.T
    assert (score <= most[:, leaf]).all() and (score >= least[:, leaf]).all()
    top = np.sort(score, axis=1)[:, -3:]
    visits = index.visits(x[::50], np.full((60, 1), hardneg.ALL), np.full((60, 1), hardneg.NONE), top[:, :1].astype(np.int64))
    assert visits.mean() < 0.5
    first = index.visits(x[::50], np.full((60, 1), hardneg.ALL), np.full((60, 1), hardneg.NONE), None)
    assert not (first & visits).any() and (first.sum(1) == hardneg.FIRST).all()


def test_few_or_no_rows(spark):
    assert hardneg.mine(hardneg.quantised(frame(spark, []))).count() == 0
    assert hardneg.mine(hardneg.quantised(frame(spark, [(0, 1, [1.0]), (1, 1, [1.0])]))).count() == 0
    assert hardneg.mine(hardneg.quantised(frame(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.75])]))).collect() == [(0, 1, 1, 2, 65536, 49152)]
    assert hardneg.mine(hardneg.quantised(frame(spark, [(0, 1, [0.0]), (1, 1, [1.0]), (3, 2, [5.0])]))).collect() == [(0, 1, 1, 3, 0, 0)]
