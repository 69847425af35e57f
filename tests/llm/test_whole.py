"""Operators and stages take the whole of their input."""

import numpy as np
import pytest

import corpus_pipeline
from pagewright.llm import minhash, mixing, simhash, syncmers, urltrust


@pytest.mark.parametrize("sources", [1, 4])
def test_mix_stage_keeps_every_document(spark, sources):
    df = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % sources}", 6) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.mix_sources(spark, df, "").collect()) == list(range(40))


@pytest.mark.parametrize("n", [1, 2, 10, 100])
def test_farms_of_any_size_are_blocked(spark, n):
    bad, clean = '<a href="http://bad.test/com">x</a>', '<a href="http://clean.test/">x</a>'
    pages = [(0, "http://bad.test/spam", bad), (1, "http://clean.test/", None), (2, "http://mixed.test/", clean * 9 + bad)]
    pages += [(10 + i, f"http://farm{i}.test/", bad * 9) for i in range(n)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urltrust.url_verdicts(df, (("block", "bad.test/"),)).collect()}
    assert {got[10 + i] for i in range(n)} == {"block"}
    assert got[0] == "block" and got[1] == got[2] == "allow"


def test_syncmers_find_a_short_passage_in_a_long_text():
    passage = " ".join(f"inner{i * i}" for i in range(12))
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    a = syncmers.fingerprint(long[:90_000] + passage + long[90_000:])
    assert len(a[0]) == len(set(syncmers.anchors(long[:90_000] + passage + long[90_000:])[0].tolist()))
    b = syncmers.fingerprint(passage)
    assert set(b[0].tolist()) <= set(a[0].tolist())
    assert syncmers.likeness(a, b) > 0 and syncmers.likeness(a, a) == 1


def test_near_dedup_stage_finds_shingle_sets_alike(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for i in range(120):
        t = list(rng.choice(vocabulary, rng.integers(3, 90))) if i % 3 == 0 else list(texts[-1])
        for at in rng.integers(0, len(t), (i % 3 != 0) * rng.integers(0, 3)):
            t[at] = str(rng.choice(vocabulary))
        texts.append(t)
    texts = [" ".join(t) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    fps = [simhash.fingerprint(t) for t in texts]
    group, missed = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            near = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            missed += near and (fps[i] ^ fps[j]).bit_count() > 3
            if near or (fps[i] ^ fps[j]).bit_count() <= 3:
                x, y = max(group[i], group[j]), min(group[i], group[j])
                group = [y if g == x else g for g in group]
    assert missed > 10
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(group))
    assert minhash.near_copies(df.limit(0)).count() == 0


def test_mixing_takes_more_sources_than_its_least_period(spark):
    df = spark.range(1500).selectExpr("id as doc_id", "concat('s', id % 1300) as source")
    got = mixing.interleave(df).collect()
    assert sorted(r.position for r in got) == list(range(1500)) and len({r.source for r in got}) == 1300
    assert mixing.long_enough(20) == mixing.PERIOD and mixing.long_enough(1300) == 8192
