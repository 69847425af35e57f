"""What the review of round 4 found."""

import math
from collections import Counter

import duckdb
import numpy as np

from pagewright.operators import analytics as A
from pagewright.plans import ORACLES, QUERIES, detected  # noqa: F401 - the module registers its queries


def plain_first(rows, top):
    """The first phrases of each chapter by mean tf-idf, by loops; all words have four letters at least."""
    phrases = {}
    for g, i, text in rows:
        w = text.split()
        phrases[g, i] = Counter(" ".join(w[k : k + n]) for n in (2, 3) for k in range(len(w) - n + 1))
    every = Counter(x for c in phrases.values() for x in c.elements())
    out = {}
    for g in {g for g, _ in phrases if g}:
        own = [c for (h, _), c in phrases.items() if h == g]
        df, mean = Counter(x for c in own for x in c), Counter()
        for c in own:
            w = {x: n * (math.log((1 + len(own)) / (1 + df[x])) + 1) for x, n in c.items() if every[x] >= 2}
            for x, v in w.items():
                mean[x] += v / math.hypot(*w.values()) / len(own)
        out[g] = [(x, round(mean[x], 9)) for x in sorted(mean, key=lambda x: (-round(mean[x], 9), x))[:top]]
    return out


def test_small_chapters_take_few_jobs_and_alike_phrases_one_column(spark):
    """Phrases that stand in the same paragraphs are one column of the matrix, and a chapter of one block takes no job a round; these were some 130 jobs."""
    rng = np.random.default_rng(3)
    passages = [" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)) for _ in range(12)]
    rows = [(g, i, passages[(i + k) % 12]) for k, g in enumerate("abc") for i in range(30)]
    df = spark.createDataFrame(rows, "chapter string, unit int, text string")
    spark.sparkContext.setJobGroup("topics-few", "")
    try:
        first, topics = A.terms_and_topics(df, (), 6)
        first, topics = first.collect(), topics.collect()
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("topics-few"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 60
    assert {r.chapter: r.n for r in spark.createDataFrame(topics).groupBy("chapter").count().withColumnRenamed("count", "n").collect()} == {"a": 5, "b": 5, "c": 5}
    assert all(len(r.words.split(", ")) == 8 for r in topics)
    want = plain_first(rows, 6)
    assert {(r.chapter, r.place): r.term for r in first} == {(g, k): x for g, v in want.items() for k, (x, _) in enumerate(v, 1)}
    _, x = A.phrase_weights(df, ())
    assert sum(len(r.t) // 8 for r in x.select("t").collect()) == 36


def test_frequent_phrases_are_weighed_as_all_others(spark):
    """A phrase in most paragraphs, which is counted apart, and one of a chapter without a name."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows = [(g, i, " ".join([*rng.choice(words, 4), "common phrase here", *rng.choice(words, 3)])) for g, n in (("a", 150), ("b", 40), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "chapter string, unit int, text string")
    df = df.coalesce(1)
    assert A._survey(df, ())[1].count() >= 3
    got = A.compound_tfidf(df, (), 9).collect()
    want = plain_first(rows, 9)
    assert {(r.chapter, r.place): r.term for r in got} == {(g, k): x for g, v in want.items() for k, (x, _) in enumerate(v, 1)}
    assert all(abs(r.score - dict(want[r.chapter])[r.term]) < 2e-9 for r in got)


def test_template_rows_without_place_or_title_come_last(spark, tmp_path):
    """Spark puts nulls first and DuckDB last, so that a book with one null start got other numbers throughout."""
    rows = [(k, "b" if k % 3 else "c", None if k % 5 == 0 else f"t{k % 7}", None if k % 4 == 0 else k % 3, None if k % 6 == 0 else float(k)) for k in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert len({tuple(r[1:]) for r in rows}) == 60  # no ties
    want = con.execute(ORACLES["outline_template"]).fetchall()
    got = [tuple(r) for r in QUERIES["outline_template"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 60
