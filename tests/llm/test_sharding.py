"""The hypergeometric shuffle: exact sizes, exact draws, and shards that don't follow the input's order."""

from math import comb

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import sharding

SCHEMA = "doc_id long, text string, part int, place string, takes long, shard string, of int, h string"


def test_draws_follow_the_distribution(spark):
    """Uniform numbers in order of size: the counts of each value must be its probability, to within rounding."""
    n = 20_000
    for total, good, drawn in ((30, 12, 9), (10, 10, 4), (10, 0, 4), (1000, 3, 500), (17, 9, 17), (40, 25, 30)):
        u = spark.range(n).select(F.expr(sharding.hypergeometric(str(total), str(good), str(drawn), f"((id + 0.5D) / {n})")).alias("x"))
        got = {r.x: r["count"] for r in u.groupBy("x").count().collect()}
        for x in range(min(good, drawn) + 1):
            p = comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn) if drawn - x <= total - good else 0
            assert abs(got.get(x, 0) - n * p) <= 2
        assert sum(got.values()) == n and all(0 <= x <= min(good, drawn) for x in got)
    big = spark.range(400).select(F.expr(sharding.hypergeometric("10000000000L", "1250000000L", "5000000000L", sharding.uniform("id"))).alias("x"))
    x = np.array([r.x for r in big.collect()])
    sd = (5e9 * 0.125 * 0.875 * 0.5) ** 0.5
    assert abs(x.mean() - 625e6) < 4 * sd / 20 and 0.85 < x.std() / sd < 1.15


def test_matrix_sums(spark):
    rows = [(i, (i * 7) % 13) for i in range(1, 40) if (i * 7) % 13]
    got = sharding.communication(spark.createDataFrame(rows, "part int, n long"), 8, 5).collect()
    total = sum(n for _, n in rows)
    assert {r.part: sum(r.takes) for r in got} == dict(rows)
    assert [sum(c) for c in zip(*(r.takes for r in got), strict=True)] == [total // 8 + (j < total % 8) for j in range(8)]
    assert all(c >= 0 for r in got for c in r.takes)
    assert sharding.communication(spark.createDataFrame([], "part int, n long"), 8).count() == 0


def test_shuffle(spark):
    rows = [(i % 90 if i % 3 else None, None if i % 5 == 0 else "x" * (i % 7), i, "p", 1, "old", 2, "h") for i in range(997)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = sharding.shuffled(df, 8, 1)
    assert out.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"]
    got = out.collect()
    assert sorted(r.part for r in got) == list(range(997))
    sizes = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
    assert all(s == list(range(len(s))) for s in sizes) and sorted(map(len, sizes)) == [124] * 3 + [125] * 5
    order = np.array([r.part for r in sorted(got, key=lambda r: (r.shard, r.slot))])
    assert abs(np.corrcoef(order, np.arange(997))[0, 1]) < 0.13 and abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.13
    assert [r.part for r in sharding.shuffled(df, 8, 2).orderBy("shard", "slot").collect()] != order.tolist()
    assert sharding.shuffled(df.limit(0), 8).count() == 0
    assert sorted((r.shard, r.slot) for r in sharding.shuffled(df.limit(3), 8).collect()) == [(0, 0), (1, 0), (2, 0)]


def test_equal_rows_are_spread(spark):
    got = sharding.shuffled(spark.range(800).selectExpr("1 as doc_id", "'same' as text"), 8).groupBy("shard").count().collect()
    assert [r["count"] for r in got] == [100] * 8


def test_written_shards(spark, tmp_path):
    df = spark.range(500).selectExpr("id as doc_id", "concat('text ', id) as text")
    sharding.write_shards(df, str(tmp_path / "out"), 4, files=6)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(500))
    for r in got.groupBy("shard").agg(F.collect_list("slot").alias("s"), F.count("*").alias("n")).collect():
        assert sorted(r.s) == list(range(r.n)) and r.n == 125
    per_file = got.select(F.input_file_name().alias("f"), "slot").groupBy("f").agg((F.max("slot") - F.min("slot") + 1).alias("span"), F.count("*").alias("n"))
    assert per_file.where("span <> n").count() == 0
