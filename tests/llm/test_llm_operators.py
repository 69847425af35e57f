"""The ten operators on a small fixture of hard rows, each against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagewright.llm import bwtdedup, decontam, graph, langid, mixing, simhash, syncmers, tokencount, tokenfiles, toxicity, urltrust

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, w array<string>, key long, spans string"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    (1, PASSAGE + " and an end", "en"), (2, "Ein Anfang und dann " + PASSAGE.upper(), "de"), (3, None, "en"), (4, "", None), (5, "  \n\t ", "en"), (6, "12 34", "en"), (7, LONG, "en"),
    (8, PASSAGE + " and an end", "en"), (None, "kein Name, aber ein Text mit Wörtern", "de"), (None, None, None), (9, "aaaa" * 100, "en"), (10, "ein Wort", "de"), (10, "ein Wort", "de"),
    (11, "the <|endoftext|> special 日本語 é İ", "fr"), (-5, PASSAGE + " and an end.", "en"), (12, "x\x0by\x1cz" * 40, None), (13, "Ünïcode " * 60, "fr"),
]


def rows(texts=TEXTS):
    return [(d, t, lang, None if i % 7 == 0 else f"s{i % 2}", None, 0.5, ["w"], 1, "x") for i, (d, t, lang) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def model_of(spark, samples):
    return langid.learned(spark.createDataFrame(samples, "lang string, text string"))


def test_language_id(docs, none):
    model = langid.train(docs)
    out = langid.annotate(docs, model)
    assert out.columns[: len(docs.columns)] == docs.columns
    for r in out.collect():
        assert 0 <= r.lang_score <= 1
        assert (r.lang_pred == "und") == (not langid.words(r.text))
    assert langid.reject_unknown(docs, model).count() == sum(bool(langid.words(t)) for _, t, _ in TEXTS)
    assert langid.annotate(none, langid.train(none)).count() == 0
    assert {r.lang_pred for r in langid.annotate(docs, langid.train(none)).collect()} == {"und"}


def test_language_id_of_few_or_unlabelled_texts(spark, docs):
    assert langid.Scorer(model_of(spark, [("en", "alpha beta")] * 50)).predict("alpha")[0] == "en"
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.reject_unknown(unlabelled, langid.train(unlabelled)).count() == sum(bool(langid.words(t)) for _, t, _ in TEXTS)
    model = model_of(spark, [("en", "the thing that the other thinks"), ("de", "der schatten schreibt die schrift")] * 2)
    df = spark.createDataFrame([(1, "the thing thinks"), (2, "日本語"), (3, "das schreiben"), (4, "12 34"), (5, None), (1, "the thing thinks")], "doc_id long, text string").withColumn("lang_score", F.lit("clash"))
    assert sorted(r.doc_id for r in langid.reject_unknown(df, model).collect()) == [1, 1, 3]
    assert [r.doc_id for r in langid.reject_unknown(df, model, ["de"]).collect()] == [3]
    assert langid.reject_unknown(df, model).columns == df.columns
    out = langid.annotate(df, model)
    assert sorted(out.columns) == ["doc_id", "lang_pred", "lang_score", "text"] and dict(out.dtypes)["lang_score"] == "double"


def test_samples_are_bounded_where_ids_are_null_or_equal(spark):
    word = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(4000)]
    rows = [(None if i % 2 else 7, f"{word[i % 4000]} {word[i % 4000]}", "en") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, 100)
    assert 2 < len(model.words) < 200
    assert len(langid.train(spark.createDataFrame([(1, "wort " * 200_000, "de")], "doc_id long, text string, lang string")).langs) == 1


def test_language_id_backs_off(spark):
    model = model_of(spark, [("en", "the thing that the other thinks " * 5), ("de", "der schatten schreibt die schrift " * 5)] * 2)
    assert langid.Scorer(model).predict("schreibschatten")[0] == "de"
    assert langid.Scorer(model).predict("thinkthat")[0] == "en"
    assert langid.Scorer(model).predict("1 2 3") == ("und", 0.0)


def test_token_counts_and_cache(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    cache = str(tmp_path / "cache")
    want = sorted(((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, _ in TEXTS), key=repr)
    assert bag(tokencount.token_counts(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({x or "" for _, x, _ in TEXTS})
    assert bag(tokencount.token_counts(docs, path, cache), "doc_id", "n_bytes", "n_tokens") == want
    assert spark.read.parquet(cache).count() == stored  # all found: nothing appended
    more = spark.createDataFrame(rows([(99, "a new text", "en")]), SCHEMA)
    assert tokencount.token_counts(more, path, cache).count() == 1
    assert spark.read.parquet(cache).count() == stored + 1
    assert tokencount.token_counts(none, path, str(tmp_path / "empty")).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = str(tmp_path / "corpus")
    tokenfiles.write_corpus(docs, path, out)
    got = tokenfiles.read_corpus(spark, out, ids=True).collect()
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, (_, x, _) in enumerate(TEXTS)}
    order = sorted(ids, key=lambda i: (TEXTS[i][0] is not None, TEXTS[i][0] or 0, TEXTS[i][1] is not None, (TEXTS[i][1] or "").encode()))
    start, want = 0, []
    for i in order:
        want.append((TEXTS[i][0], start, len(ids[i]), zlib.crc32(ids[i].tobytes()), ids[i].tobytes()))
        start += len(ids[i])
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got), key=lambda r: r[1]) == want
    assert tokenfiles.read_document(out, 8) == ids[7].tolist()
    assert tokenfiles.read_document(out, 777) is None
    (tmp_path / "corpus" / "dictionary.zdict").write_bytes(b"other")
    with pytest.raises(Exception, match="dictionary"):
        tokenfiles.read_corpus(spark, out).collect()
    tokenfiles.write_corpus(none, path, str(tmp_path / "none"))
    assert tokenfiles.read_corpus(spark, str(tmp_path / "none")).count() == 0


def test_toxicity(spark, none):
    rng = np.random.default_rng(3)
    vocabulary = [f"wort{i}" for i in range(300)]
    made = []
    for i in range(600):
        ws = list(rng.choice(vocabulary, rng.integers(5, 40)))
        bad = i % 3 == 0
        if bad:
            ws[rng.integers(len(ws))] = ["vile", "nasty"][i % 2]
        made.append((" ".join(ws), ["en", "de"][i % 2], int(bad)))
    c = toxicity.Classifier(made[:450])
    s = c.score([t for t, _, _ in made[450:]], toxicity.Rows(c.of))
    assert np.mean((s >= toxicity.THRESHOLD) == np.array([y for _, _, y in made[450:]], bool)) > 0.95
    odd = c.score([None, "", "vile " * 50_000], toxicity.Rows(c.of))
    assert (odd >= 0).all() and (odd <= 1).all() and odd[0] == odd[1] and odd[2] >= toxicity.THRESHOLD
    alone = [c.score([t], toxicity.Rows(c.of))[0] for t, _, _ in made[450:480]]
    assert np.allclose(alone, s[:30])  # a text's score doesn't hang on its neighbours
    few = toxicity.Classifier([("some words", "en", 1), ("other words", "en", 0)])
    assert (few.score([None, "", "unseen", "12"], toxicity.Rows(few.of)) < toxicity.THRESHOLD).all()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    untrained = toxicity.train(none, labels)
    assert toxicity.score(none, untrained).count() == 0
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert {r.score for r in toxicity.score(docs, untrained).collect()} == {0.0}


def test_url_trust(spark):
    page = lambda i, u, h=None: (i, u, h)
    link = '<a class="x" href="http://BAD.example.com/en/1">x</a>'
    pages = [page(1, "http://bad.example.com/en/1"), page(2, "https://Bad.example.com/en/72?q=1"), page(3, "http://bad.example.com/fr/1"), page(4, None), page(5, "no scheme"), page(6, "http://farm.test/a", link * 3), page(7, "http://a.example.net/de/81#x"), page(8, "http://a.example.net/de/9"), page(8, "http://a.example.net/de/9"), page(None, "http://org/es/")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urltrust.url_verdicts(df).collect()}
    assert (1, "bad.example.com", "/en/1", "com/en/", "block") in got
    assert (2, "bad.example.com", "/en/72", "example.com/en/7", "allow") in got
    assert (4, "", "", None, "allow") in got and (5, "", "", None, "allow") in got
    assert (7, "a.example.net", "/de/81", "example.net/de/8", "block") in got
    assert (8, "a.example.net", "/de/9", "net/de/", "allow") in got
    assert (None, "org", "/es/", "org/es/", "block") in got
    assert urltrust.url_verdicts(df).count() == len(pages)
    assert urltrust.url_verdicts(df.limit(0)).count() == 0


def test_url_trust_flows_along_links(spark):
    e = spark.createDataFrame([("good", "friend", 1), ("good", "good", 1), ("farm", "bad", 9), ("farm", "farm", 1), ("bad", "bad", 1), ("friend", "friend", 1)], "src string, dst string, n long")
    s = spark.createDataFrame([("good", 1.0, 0.0), ("bad", 0.0, 1.0), ("farm", 0.0, 0.0), ("friend", 0.0, 0.0)], "host string, st double, sd double")
    got = {r.host: r for r in urltrust.propagate(e, s).collect()}
    assert got["friend"].trust == pytest.approx(0.85 / 1.85) and got["friend"].distrust == 0 and got["good"].trust == 1
    assert got["farm"].distrust == pytest.approx(0.85) and got["farm"].trust == 0


def test_url_verdicts_of_hosts_without_rules(spark):
    """Some are blocked by their links (one of them in spite of a trusted link), one saved by several trusted hosts, one far away blocked through another; the SQL says the same."""
    import duckdb

    to = lambda h, n=1: f'<a href="http://{h}.test/x">x</a>' * n
    pages = [(0, "http://bad.test/spam", None), (1, "http://bad.test/other", to("clean")), (2, "http://clean.test/", None), (3, "http://mixed.test/", to("clean", 9) + to("bad")), (4, "http://good.test/a", to("friend")), (5, "http://friend.test/", to("bad", 9) + to("clean")), (6, "http://farm.test/", to("bad", 9) + to("clean")), (7, "http://far.test/", to("farm")), (8, None, to("bad")), (9, "http://kept.test/", to("bad", 7) + to("clean", 3))]
    pages += [(10 + i, f"http://g{i}.good.test/a", to("kept")) for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = (("block", "bad.test/"), ("allow", "good.test/"))
    rows = urltrust.url_verdicts(df, rules).collect()
    got = {r.host: r.verdict for r in rows}
    assert got == {"bad.test": "block", "clean.test": "allow", "mixed.test": "allow", "good.test": "allow", "friend.test": "block", "kept.test": "allow", **{f"g{i}.good.test": "allow" for i in range(3)}, "farm.test": "block", "far.test": "block", "": "block"}
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    rel = con.sql(urltrust.oracle(rules))
    at = [rel.columns.index(c) for c in rows[0].__fields__]
    assert sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall()))) == sorted(repr(tuple(r)) for r in rows)


def test_syncmers(spark, docs, none):
    got = bag(syncmers.fingerprints(docs), "doc_id", "n_chars", "edited_sha256", "fingerprint", "near_next")
    order = sorted(range(len(TEXTS)), key=lambda i: (TEXTS[i][0] is not None, TEXTS[i][0] or 0, (TEXTS[i][1] or "").encode()), reverse=True)
    want = []
    for k, i in enumerate(order):
        t, after = TEXTS[i][1] or "", TEXTS[order[(k + 1) % len(order)]][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        fp = syncmers.fingerprint(t)
        want.append((TEXTS[i][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), syncmers.render(fp), syncmers.likeness(fp, syncmers.fingerprint(after))))
    assert got == sorted(want, key=repr)
    assert syncmers.fingerprints(none).count() == 0
    one = spark.createDataFrame(rows([(1, "alone", "en")]), SCHEMA)
    assert syncmers.fingerprints(one).first().near_next == 1


def test_syncmers_are_free_of_context():
    inner = LONG[500:900]
    own = set(syncmers.anchors(inner)[0].tolist())
    for before, after in (("", ""), ("other words " * 9, "more of them " * 9), (LONG[:77], LONG[:33])):
        h, at = syncmers.anchors(before + inner + after)
        inside = {x for x, p in zip(h.tolist(), at.tolist(), strict=True) if len(before) <= p <= len(before) + len(inner) - syncmers.K}
        assert inside == own


def test_mixing(docs, none):
    got = mixing.interleave(docs).collect()
    assert len(got) == len(TEXTS) and sorted(r.position for r in got) == list(range(len(TEXTS)))
    assert mixing.interleave(none).count() == 0
    assert mixing.mixture(docs, 1.0).columns == docs.columns
    assert mixing.mixture(docs, 1.0).count() == len(TEXTS)
    assert mixing.mixture(none, 0.9).count() == 0


@pytest.mark.parametrize("shares", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 700, "b": 1, "c": 200, "d": 123}])
def test_mixing_deviates_by_less_than_a_block(shares):
    total, got = sum(shares.values()), dict.fromkeys(shares, 0)
    for s, j, release, due, slot in mixing.schedule(shares):
        assert release <= slot < due and j == got[s]
        got[s] += 1
        assert all(abs(got[x] - shares[x] * (slot + 1) / total) < 1 for x in shares)
    assert got == shares


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "Ein WORT"), (3, None), (4, "..."), (2, "ein wort"), (None, "aaaa")], "item_id long, text string").withColumn("size", F.lit(1))
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    items = {("1", tuple(cut(PASSAGE))), ("2", ("ein", "wort")), ("", ("aaaa",))}
    want = []
    for d, t, _ in TEXTS:
        w, hit, named = cut(t), set(), set()
        for name, x in items:
            n = min(13, len(x))
            grams = {x[i : i + n] for i in range(len(x) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    named.add(name)
        want.append((d, len(w), len(hit), tuple(sorted(named)), bool(hit) and 20 * len(hit) >= len(w)))
    small = decontam.decisions(docs, bench).collect()
    try:
        limit, decontam.BROADCAST_BYTES = decontam.BROADCAST_BYTES, 0
        shuffled = decontam.decisions(docs, bench).collect()
    finally:
        decontam.BROADCAST_BYTES = limit
    for got in (small, shuffled):
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=repr) == sorted(want, key=repr)
    assert decontam.drop_contaminated(docs, bench).count() == sum(not r[4] for r in want)
    clean = {r.doc_id: r.clean_text for r in decontam.cut_spans(docs, bench).collect() if r.doc_id in (1, 2, 3)}
    assert clean == {1: "and an end", 2: "ein anfang und dann", 3: None}
    assert decontam.decisions(none, bench).count() == 0
    assert {r.n_hit for r in decontam.decisions(docs, bench.limit(0)).collect()} == {0}


def removed(texts):
    """Brute force: (doc_id, bytes, kept) in order of doc_id and text."""
    seen, out = set(), []
    for d, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        out.append((d, len(b), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def test_repeats(spark, docs, none):
    got = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in bwtdedup.without_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(removed([x[:2] for x in TEXTS]), key=repr)
    assert bwtdedup.without_repeats(none).count() == 0


def test_repeats_by_random_edits(spark):
    rng = np.random.default_rng(5)
    texts = []
    for i in range(60):
        t = "".join(rng.choice(list("abc "), rng.integers(0, 500)))
        if texts and i % 3:
            o = texts[rng.integers(len(texts))][1]
            a, b = sorted(rng.integers(0, len(o) + 1, 2))
            t = t[:50] + o[a:b] + t[50:]
        texts.append((i, t + "ab" * int(rng.integers(0, 90))))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in bwtdedup.without_repeats(df).collect()]
    assert sorted(got) == sorted(removed(texts))


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    fps = [simhash.fingerprint(t) for _, t, _ in TEXTS]
    group = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 3:
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    least = {}
    for g, (d, _, _) in zip(group, TEXTS, strict=True):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    want = sorted(((d, np.uint64(f).astype(np.int64).item(), least[g]) for (d, _, _), f, g in zip(TEXTS, fps, group, strict=True)), key=repr)
    assert bag(spark.createDataFrame(got), "doc_id", "fp", "component_id") == want
    twice = spark.createDataFrame([(1, "one text"), (2, "another text of other words"), (2, "one text"), (2, "another text of other words")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(twice).collect())) == [(1, "one text"), (2, "another text of other words")]
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect() if r.doc_id is not None)
    assert kept == sorted({d for (d, _, _), g in zip(TEXTS, group, strict=True) if d is not None and d == least[g]})
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_chains_and_dense_groups(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6).tolist()
    fps = set()
    for b in base:
        for _ in range(60):
            x = b
            for bit in rng.integers(0, 63, rng.integers(0, 6)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    comp = {f: f for f in fps}
    comp.update({r.node: r.component for r in graph.connected_components(simhash.links(df)).collect()})
    group = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                x, y = max(group[a], group[b]), min(group[a], group[b])
                group = {k: y if g == x else g for k, g in group.items()}
    assert comp == group
