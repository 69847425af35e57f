"""Scores, thresholds and the language reader of the toxicity classifier against plain loops."""

import math
import zlib

import numpy as np
import pytest

from pagewright.llm import toxicity

NICE = {"en": "walk garden river morning letter window music", "de": "garten fluss morgen brief fenster lied haus"}
RUDE = {"en": "vile rotten wretch", "de": "mies elender wicht"}


def samples():
    rng = np.random.default_rng(6)
    out = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        bad = i % 3 == 0
        text = list(rng.choice(NICE[lang].split(), rng.integers(3, 14)))
        for _ in range(bad * int(rng.integers(1, 4))):
            text.insert(int(rng.integers(0, len(text) + 1)), str(rng.choice(RUDE[lang].split())))
        out.append((" ".join(text), lang if i % 5 else None, int(bad)))
    return out


@pytest.fixture(scope="module")
def trained():
    own = samples()
    return own, toxicity.Classifier(own)


def row(c, word):
    for name in (word, "^" + word[: toxicity.PREFIX]):
        if at := c.of.get(zlib.crc32(name.encode()) % toxicity.BUCKETS, 0):
            return at
    return 0


def logit(c, words):
    """The largest response of each filter over all windows that touch the text or the zeros after it, then the logistic layer."""
    e, p = c.net.p["e"], c.net.p
    x = [e[row(c, w)] for w in words] + [np.zeros(toxicity.DIM)] * 3
    best = [max(sum(float(x[i + j] @ p[f"w{w}"][j][:, f]) for j in range(w)) for i in range(len(words) + 1)) for w in toxicity.WIDTHS for f in range(toxicity.FILTERS)]
    return sum(max(0.0, b + float(k)) * float(o) for b, k, o in zip(best, p["c"], p["o"], strict=True)) + float(p["b"][0])


def read(c, own, words):
    """The language in whose labelled texts the words are the commonest."""
    size = len(c.of) + 1
    sums = []
    for lang in c.langs:
        counts = [0] * size
        for text, of, _ in own:
            if of == lang:
                for w in text.split():
                    counts[row(c, w)] += 1
        sums.append(sum(math.log((counts[row(c, w)] + 0.5) / (sum(counts) + 0.5 * size)) for w in words if row(c, w)))
    return int(np.argmax(sums))


def best_cut(z, y):
    """Between the document with which F1 is best, the highest first, and the next one."""
    order = sorted(range(len(z)), key=lambda i: -z[i])
    f1 = [2 * sum(y[i] for i in order[: k + 1]) / (k + 1 + sum(y)) for k in range(len(z))]
    k = f1.index(max(f1))
    return (z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2


def test_scores(trained):
    own, c = trained
    texts = ["walk garden vile river", "GARTEN wicht", "morning", "unseen words only", "", None, "rottenest walk", " ".join(["river"] * 300 + ["wretch"] + ["music"] * 300)]
    got = c.score(texts, toxicity.Rows(c.of))
    for text, score in zip(texts, got, strict=True):
        words = (text or "").lower().split()
        cut = c.cuts[read(c, own, words)]
        want = 1 / (1 + math.exp(-(logit(c, words) - cut + math.log(0.7 / 0.3))))
        assert score == pytest.approx(want, abs=1e-4)
    assert got[0] >= 0.7 and got[1] >= 0.7 and max(got[2], got[4], got[5]) < 0.7


def test_thresholds(trained):
    """One threshold for all from the fourth of the sample that wasn't trained on, moved towards each language's own by its toxic documents."""
    own, c = trained
    z = [logit(c, t.split()) for t, *_ in own]
    y = [s[2] for s in own]
    held = [i for i in range(len(own)) if i % 4 == 3]
    common = best_cut([z[i] for i in held], [y[i] for i in held])
    nothing = logit(c, []) + toxicity.MARGIN
    for k, _ in enumerate(c.langs):
        mine = [i for i in held if read(c, own, own[i][0].split()) == k]
        bad = sum(y[i] for i in mine)
        cut = best_cut([z[i] for i in mine], [y[i] for i in mine]) if bad >= 8 and len(mine) - bad >= 8 else common
        want = common + (cut - common) * bad / (bad + toxicity.SHRINK)
        assert c.cuts[k] == pytest.approx(max(want, nothing), abs=1e-3)


def test_one_label_alone_scores_nothing():
    c = toxicity.Classifier([("some words", "en", 0)] * 20)
    assert c.score(["some words", None], {}).tolist() == [0.0, 0.0]
