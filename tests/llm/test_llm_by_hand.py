"""The operators' inner rules written out once more, plainly, without their code."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from pagewright.llm import langid, minhash, mixing, simhash, syncmers, toxicity

TEXTS = ["", "one", "Two words", "a b c d", "The same THE same the Same " * 9, "x\x0by\x1cz \u00a0 q" * 7, "日本語 é İ " * 30, " ".join(f"w{i % 7}v{i}" for i in range(300)), None]


@pytest.mark.parametrize("text", TEXTS)
def test_simhash_by_hand(text):
    word, words = [], []
    for byte in (text or "").encode() + b" ":
        if byte in b" \t\n\x0b\x0c\r":
            words += ["".join(map(chr, word)).encode("latin-1")] * bool(word)
            word = []
        else:
            word.append(byte + 32 if 65 <= byte <= 90 else byte)
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_hash(codes, mix=0xD6E8FEB86659FD93, base=0x9E3779B97F4A7C15, m=(1 << 64) - 1):
    h = 0
    for c in codes:
        h = (h * base + (c + 1) * mix) & m
    h = ((h ^ (h >> 32)) * mix) & m
    return h ^ (h >> 29)


def naive_anchors(text):
    k, s = 32, 12
    out = []
    for i in range(len(text) - k + 1):
        inner = [naive_hash(map(ord, text[j : j + s])) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((naive_hash(map(ord, text[i : i + k])) >> 32, i))
    return out


@pytest.mark.parametrize("text", [" ".join(f"w{i % 7}v{i}" for i in range(60)), "ab" * 60, "日本語 é " * 20, "x" * 32])
def test_syncmers_by_hand(text):
    want = naive_anchors(text)
    h, at = syncmers.anchors(text)
    assert list(zip(h.tolist(), at.tolist(), strict=True)) == want
    first = {}
    for x, p in want:
        first.setdefault(x, p)
    assert syncmers.render(syncmers.fingerprint(text)) == " ".join(f"{x:08x}@{first[x]:x}" for x in sorted(first))


def test_syncmer_likeness_by_hand(spark):
    texts = [" ".join(f"w{i % 7}v{i + 40 * k}" for i in range(50)) for k in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def like(a, b):
        first = []
        for t in (a, b):
            f = {}
            for x, p in naive_anchors(t):
                f.setdefault(x, p)
            first.append(f)
        shared = sorted(first[0].keys() & first[1].keys(), key=first[0].get)
        longest = [1] * len(shared)
        for i in range(len(shared)):
            for j in range(i):
                if first[1][shared[j]] < first[1][shared[i]]:
                    longest[i] = max(longest[i], longest[j] + 1)
        j = max(longest, default=0) / len(first[0].keys() | first[1].keys())
        return 2 * j / (1 + j)

    for r in syncmers.fingerprints(df).collect():
        after = texts[(r.doc_id - 1) % 4]
        edited = texts[r.doc_id][: len(texts[r.doc_id]) - len(texts[r.doc_id]) // 2] + after[: len(texts[r.doc_id]) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.edited_fingerprint == syncmers.render(syncmers.fingerprint(edited))
        assert r.near_edited == pytest.approx(like(texts[r.doc_id], edited)) and r.near_next == pytest.approx(like(texts[r.doc_id], after))


def test_language_scores_by_hand(spark):
    samples = [("en", "the thing that the other thinks thing"), ("de", "der schatten schreibt die schrift schatten")] * 2
    langs = ["de", "en"]
    counts = {lang: Counter(w for la, t in samples if la == lang for w in t.split()) for lang in langs}
    seen = {w for c in counts.values() for w in c}
    parts = {n: {lang: Counter(f"<{w}>"[i : i + n] for w in counts[lang] for i in range(len(w) + 3 - n)) for lang in langs} for n in range(1, 6)}

    def evidence(word):
        if word in seen and sum(counts[la][word] for la in langs) >= 2:
            v = [math.log((counts[la][word] + 0.5) / (sum(counts[la].values()) + 0.5 * (len(seen) + 1))) for la in langs]
        else:
            for n in range(5, 0, -1):
                known = {g for la in langs for g in parts[n][la]}
                hit = [g for i in range(len(word) + 3 - n) for g in [f"<{word}>"[i : i + n]] if sum(parts[n][la][g] for la in langs) >= 2]
                if hit:
                    v = [sum(math.log((parts[n][la][g] + 0.5) / (sum(parts[n][la].values()) + 0.5 * (len(known) + 1))) for g in hit) / len(hit) for la in langs]
                    break
            else:
                return [0.0, 0.0]
        return [x - max(v) for x in v]

    scorer = langid.Scorer(langid.learned(spark.createDataFrame(samples, "lang string, text string")))
    for text in ("the thing", "schattenthing unseen", "q", "Schrift THE those", "schreiben " * 40):
        rows = [evidence(w) for w in text.lower().split()]
        mean = [sum(r[k] for r in rows) / len(rows) for k in (0, 1)]
        p = [math.exp((m - max(mean)) * min(len(rows), 12)) for m in mean]
        assert scorer.predict(text) == (langs[mean.index(max(mean))], pytest.approx(max(p) / sum(p), rel=1e-4))


def test_toxicity_gradient_against_differences():
    """One Adam step moves each parameter against the sign of its numerically measured slope."""
    rng = np.random.default_rng(2)
    net = toxicity.Net(rng.normal(0, 1, 12))
    net.p["c"] = rng.uniform(0.05, 0.1, net.p["c"].shape).astype(np.float32)  # not where the slope jumps
    docs = [rng.integers(1, 12, n) for n in (1, 4, 9, 6)]
    y = np.array([0.0, 1, 1, 0])
    start = {k: v.astype(np.float64).copy() for k, v in net.p.items()}

    def loss(p):
        total = 0.0
        for ids, label in zip(docs, y, strict=True):
            row = np.concatenate((p["e"][ids], np.zeros((4, toxicity.DIM))))
            best = [max(sum(row[i + j] @ p[f"w{w}"][j][:, f] for j in range(w)) for i in range(len(ids) + 1)) for w in toxicity.WIDTHS for f in range(toxicity.FILTERS)]
            z = np.maximum(np.array(best) + p["c"], 0) @ p["o"] + p["b"][0]
            total += np.log1p(np.exp(-z)) if label else np.log1p(np.exp(z))
        return total / len(y) + toxicity.DECAY / 2 * sum((v**2).sum() for k, v in p.items() if k != "e")

    net.step(docs, y)
    for name in ("o", "b", "c", "w1", "w2", "w3", "e"):
        for at in list(np.ndindex(start[name].shape))[1 :: max(1, start[name].size // 12)]:
            if name == "e" and not any(at[0] in d for d in docs):
                continue
            up, down = ({k: v.copy() for k, v in start.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            if name == "e":
                slope += toxicity.DECAY * start[name][at]
            moved = net.p[name][at] - start[name][at]
            if abs(slope) > 1e-3:
                assert np.sign(moved) == -np.sign(slope), (name, at, slope, moved)


def test_mixing_positions_by_simulation(spark):
    rows = [(i if i % 23 else None, ["a", "b", None, "a"][i % 4]) for i in range(600)] + [(5, "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string")
    shares, block = {"a": 4, "b": 3, None: 1}, 4
    key = lambda d: ("", 0) if d is None else (hashlib.md5(str(d).encode()).hexdigest(), d)
    queues = {s: sorted((d for d, x in rows if x == s), key=key) for s in shares}
    total, taken, at, order, slot_of = 8, dict.fromkeys(shares, 0), 0, [], {}
    while any(queues[s][taken[s] * block :] for s in shares):
        ready = []
        for s in sorted(shares, key=lambda s: (s is not None, s or "")):
            j = taken[s]
            if Fraction(j * total, shares[s]) // 1 <= at:
                ready.append((math.ceil(Fraction((j + 1) * total, shares[s])), s))
        due = min(x for x, _ in ready)
        s = next(s for x, s in ready if x == due)
        for place, d in enumerate(queues[s][taken[s] * block : (taken[s] + 1) * block]):
            slot_of[(s, taken[s], place)] = at
            order.append((d, s, taken[s], at))
        taken[s] += 1
        at += 1
    got = sorted(mixing.interleave(df, shares, block).collect(), key=lambda r: r.position)
    assert [(r.doc_id, r.source, r.block, r.slot) for r in got] == order
    assert [r.position for r in got] == list(range(len(rows)))


def test_sketches_keep_what_is_alike():
    rng = np.random.default_rng(4)
    for n in (20, 200, 3000):
        for _ in range(30):
            both = rng.integers(0, 1 << 63, n).astype(np.uint64)
            a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, n // 8).astype(np.uint64)))) for _ in range(2))
            assert (minhash.keys(a) == minhash.keys(b)).any()
            same = np.frombuffer(minhash.sketch(a), np.uint8) == np.frombuffer(minhash.sketch(b), np.uint8)
            assert same.sum() >= minhash.LEAST_EQUAL
