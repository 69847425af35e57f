"""What the review of round 3 found and the first answers to it left open."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import hardneg
from pagewright.operators import analytics as A


def test_packs_of_anchors_are_not_broadcast(spark):
    """An anchor's packs, one for each leaf to be seen, are many times the anchors; by the anchors' size Spark sent them all through the driver."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), (F.col("id") % 4).cast("int").alias("label"), F.array(*(F.sin(F.col("id") * k).cast("float") for k in range(1, 5))).alias("embedding"))
    rows = hardneg.quantised(rows)
    index, blocks = hardneg.fit(rows)
    state = rows.where("vec_id % 50 = 0").withColumnsRenamed({"vec_id": "uid"}).selectExpr("*", f"array({hardneg.ALL}) as lo", f"array({hardneg.NONE}) as hi", "cast(null as array<long>) as kth")
    found = hardneg._search(state, index, blocks, 4, True, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.groupBy("uid").count().where("count >= 6").count() == 60


def test_topics_of_chapters_in_many_blocks(spark, monkeypatch):
    """Factors and first phrases don't depend on how a chapter is dealt into blocks; phrases are found once for both."""
    rng = np.random.default_rng(2)
    names = [a + b for a in ("stone", "river", "green", "north", "light") for b in ("bridge", "water", "field", "tower", "the")]
    rows = [(g, i, " ".join(rng.choice(names[k % 3 * 8 : k % 3 * 8 + 9], 12))) for g, n in (("a", 60), ("b", 9), ("c", 1)) for i, k in enumerate(range(n))]
    df = spark.createDataFrame(rows, "chapter string, unit int, text string")
    made, got = [], []
    counts = A.phrase_counts
    monkeypatch.setattr(A, "phrase_counts", lambda *a: made.append(1) or counts(*a))
    for entries in (1 << 18, 60):
        monkeypatch.setattr(A, "BLOCK_ENTRIES", entries)
        first, topics = A.terms_and_topics(df, ("riverthe",), 6)
        got.append(([tuple(r) for r in first.orderBy("chapter", "place").collect()], [tuple(r) for r in topics.orderBy("chapter", "topic").collect()]))
    assert len(made) == 2 and got[0] == got[1] and {r[0] for r in got[0][1]} == {"a", "b"}
    terms, x = A.phrase_weights(df, ("riverthe",))
    assert x.count() > 5
    phrases = {}
    for g, i, text in rows:
        w = text.split()
        runs = [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)]
        phrases[g, i] = Counter(" ".join(r) for r in runs if r[-1] != "riverthe")
    every = Counter(x for c in phrases.values() for x in c.elements())
    for g in "abc":
        own = [c for (h, _), c in phrases.items() if h == g]
        df_ = Counter(x for c in own for x in c)
        mean = Counter()
        for c in own:
            w = {x: n * (math.log((1 + len(own)) / (1 + df_[x])) + 1) for x, n in c.items() if every[x] >= 2}
            for x, v in w.items():
                mean[x] += v / math.hypot(*w.values()) / len(own)
        want = sorted(mean, key=lambda x: (-round(mean[x], 9), x))[:6]
        assert [(r[1], r[3]) for r in got[0][0] if r[0] == g] == [(x, k) for k, x in enumerate(want, 1)]
