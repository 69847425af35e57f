"""The toxicity classifier learns from every labelled document: counts, net, thresholds and language reader against plain loops."""

import numpy as np
import pytest

from pagewright.llm import toxicity

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def test_every_labelled_document_is_counted(spark):
    """Words of three documents each are all kept, however many documents there are; so are those of very long texts."""
    texts = [(f"rare{i // 3}", 0) for i in range(9000)] + [(f"common word{i % 40} vile", 1) for i in range(1500)]
    long = "plain " * 40_000
    texts += [(long + "outlying", 0)] * 3
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, None, y) for i, (_, y) in enumerate(texts)], LABELS)
    c = toxicity.train(docs, labels)
    assert all(toxicity.bucket(f"rare{i}") in c.of for i in range(3000))
    assert toxicity.bucket("outlying") in c.of


def made(spark, n=420):
    rng = np.random.default_rng(8)
    nice, rude = {"en": "walk garden river morning letter", "de": "garten fluss morgen brief"}, {"en": "vile wretch", "de": "mies wicht"}
    rows = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        text = list(rng.choice(nice[lang].split(), rng.integers(3, 12))) + list(rng.choice(rude[lang].split(), 2)) * (i % 3 == 0)
        rows.append((i, " ".join(text), "fr" if i == 5 else lang if i % 7 else None, int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:3] for r in rows] + [(1, "zz smallest text counts, not this one", "de"), (None, "no id", "en"), (9999, "no label", "en")], SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(0, 1, 0), (None, 1, 1), (3, 1, None)], LABELS)
    return rows, docs, labels


def test_against_plain_loops(spark, monkeypatch):
    rows, docs, labels = made(spark)
    monkeypatch.setattr(toxicity, "SHARD_CHARS", 6000)  # several shards
    c = toxicity.train(docs, labels)
    assert c.langs == ["de", "en", "other"] and c.trained
    counts = {}
    for _, text, _, _ in rows:
        for b in toxicity.own_buckets(text.split()):
            counts[b] = counts.get(b, 0) + 1
    kept = sorted((b for b, n in counts.items() if n >= toxicity.MIN_DOCS), key=lambda b: (-counts[b], b))
    assert c.of == {b: i + 1 for i, b in enumerate(kept)}
    at = toxicity.Rows(c.of)
    held = np.zeros((len(kept) + 1, 3))
    for _, text, lang, _ in rows:
        if lang:
            for w in text.split():
                held[at[w], {"de": 0, "en": 1}.get(lang, 2)] += 1
    want = np.log((held + 0.5) / (held.sum(0) + 0.5 * len(held)))
    assert np.allclose(c.lang_rows[1:], want[1:], atol=1e-5)
    checks = {r.doc_id for r in docs.where("pmod(xxhash64(doc_id, 'checks'), 4) = 3 and doc_id < 1000").select("doc_id").distinct().collect()}
    mine = [r for r in rows if r[0] in checks]
    z, read = c._logits([np.array([at[w] for w in r[1].split()]) for r in mine])
    y = np.array([r[3] for r in mine])
    assert 80 < len(mine) < 130

    def best(z, y):
        cuts = sorted(set(z), reverse=True)
        f1 = [2 * y[z >= x].sum() / ((z >= x).sum() + y.sum()) for x in cuts]
        k = int(np.argmax(f1))
        return (cuts[k] + cuts[min(k + 1, len(cuts) - 1)]) / 2

    nothing = c._logits([np.empty(0, int)])[0][0] + toxicity.MARGIN
    common = best(z, y)
    for k in range(3):
        m = read == k
        bad = y[m].sum()
        own = best(z[m], y[m]) if min(bad, m.sum() - bad) >= 8 else common
        assert c.cuts[k] == pytest.approx(max(nothing, common + (own - common) * bad / (bad + toxicity.SHRINK)), abs=2 / toxicity.GRID)
    scores = {r.doc_id: r.score for r in toxicity.score(docs.where("doc_id between 2 and 999"), c).collect()}
    assert np.mean([(scores[i] >= toxicity.THRESHOLD) == y for i, _, _, y in rows[2:]]) > 0.98


def test_a_round_averages_the_shards(spark):
    rng = np.random.default_rng(4)
    docs = [(s, int(rng.integers(0, 2)), rng.integers(0, 30 if s else 20, rng.integers(1, 9)).astype(np.int32)) for s in (0, 0, 1, 1, 1, 2) for _ in range(30)]
    net = toxicity.start(rng.normal(0, 1, 31))
    df = spark.createDataFrame([(s, y, bytearray(x.tobytes())) for s, y, x in docs], "shard int, toxic long, ids binary").coalesce(1)
    got = toxicity._averaged(net, df, 2, 11).p
    moved, held, sizes = [], [], []
    for s in range(3):
        own = [d for d in docs if d[0] == s]
        part = toxicity.Net.of({k: v.copy() for k, v in net.p.items()})
        toxicity.fit(part, [d[2] for d in own], np.array([d[1] for d in own], float), 2, 11)
        moved.append(part.p)
        held.append([sum(r in d[2] for d in own) for r in range(31)])
        sizes.append(len(own))
    for k, v in net.p.items():
        for i in np.ndindex(v.shape):
            weight = [h[i[0]] for h in held] if k == "e" else sizes
            want = v[i] + sum(w * (p[k][i] - v[i]) for w, p in zip(weight, moved, strict=True)) / max(1, sum(weight))
            assert got[k][i] == pytest.approx(v[i] if k == "e" and i[0] == 0 else want, abs=1e-4), (k, i)


def test_long_texts_in_pieces(monkeypatch):
    """A step doesn't hang on the pieces in which responses are looked up."""
    rng = np.random.default_rng(9)
    docs = [rng.integers(0, 50, n) for n in (0, 3, 70, 1, 12, 33)]
    y = np.array([0, 1.0, 1, 0, 0, 1])
    whole = toxicity.start(rng.normal(0, 1, 51))
    parts = toxicity.Net.of({k: v.copy() for k, v in whole.p.items()})
    whole.step(docs, y)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    parts.step(docs, y)
    assert all(np.array_equal(whole.p[k], parts.p[k]) for k in whole.p)


def test_commonest_buckets(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_ROWS", 30)
    rows = [(b * 4096, 3 + (b % 5 == 0) * b, 1) for b in range(100)] + [(7, 2, 1)]
    df = spark.createDataFrame(rows, "bucket long, n long, bad long")
    want = sorted((r for r in rows if r[1] >= 3), key=lambda r: (-r[1], r[0]))[:30]
    assert sorted(map(tuple, toxicity.commonest(df).collect())) == sorted(want)
    assert toxicity.commonest(df.limit(20)).count() == 20
