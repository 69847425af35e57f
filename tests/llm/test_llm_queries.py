"""The registered queries on the smallest tables, and the pipeline against its stages' rules."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from pagewright.llm import langid, queries, simhash

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name.split("_")[0] not in ("op11", "op13"):
        table = "pages" if name.startswith("op5_") else "documents"
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
        rel = con.sql(queries.ORACLE_SQL[name])
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall()))) == sorted(repr(tuple(r)) for r in rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "token_output"]
    now = docs
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns
        counts.append(now.count())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert counts[1] == sum(bool(langid.words(t)) for t in texts.values())
    split = {d: re.sub("[A-Z]", lambda x: x[0].lower(), t).encode().split() for d, t in texts.items() if langid.words(t)}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in split.items()}
    fps = {d: simhash.fingerprint(texts[d]) for d in sets}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if group[a] != group[b] and ((fps[a] ^ fps[b]).bit_count() <= 3 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = max(group[a], group[b]), min(group[a], group[b])
                group = {k: y if g == x else g for k, g in group.items()}
    assert counts[2] == len(set(group.values()))
    assert counts[4] == counts[3] > 0.9 * counts[2]
    assert corpus_pipeline.run(spark, SF).count() == counts[4]


HARD = [
    (1, "the same words again and again", "en", "a"), (2, "the same words again and again", "en", "a"), (None, "no name but words", None, None), (None, None, None, None), (3, "", "en", "b"),
    (4, "one id and two texts", "en", "b"), (4, "one id and another text of other words", "en", "b"), (5, "12 34", "en", "a"), (6, "long " * 40_000, "en", "a"), (2, "the same words again and again", "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, lang_score string"


def test_pipeline_of_hard_rows(spark, tmp_path):
    """Nulls, copies, one id with two texts, and columns named like the operators' own."""
    docs = spark.createDataFrame([(*r, 1, 2, "k", "s") for r in HARD], COLUMNS)
    spark.createDataFrame([(1, "nothing of these")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in now.collect()), key=repr)
    assert got == sorted([(1, HARD[0][1]), (None, HARD[2][1]), (4, HARD[5][1]), (4, HARD[6][1]), (6, HARD[8][1])], key=repr)
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == 5


def test_pipeline_of_no_rows(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
