"""Operators without SQL against their rules written out by hand, on random inputs."""

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import analytics as A
from pagewright.operators import mapping, merge, parse
from pagewright.operators import pages as P


def test_nearest_smaller_and_ranges(spark):
    """More rows than a block and a run of blocks hold, with ties, and a book of none."""
    rng = np.random.default_rng(5)
    rows = [("a", int(i), int(v)) for i, v in enumerate(rng.integers(0, 400, 1500))] + [("b", 1000 * i, -i) for i in range(40)] + [(None, 3, 1), (None, 9, 2)]
    got = P.nearest_smaller(spark.createDataFrame(rows, "g string, at int, value int"), "g").collect()
    want = {(g, at): max(((a, v) for h, a, v in rows if h == g and a < at and v < value), default=None) for g, at, value in rows}
    assert len(got) == len(rows) and {(r.g, r.at): r.near and tuple(r.near) for r in got} == want
    starts = [("a", int(i), int(v), 999) for i, v in enumerate(rng.integers(1, 300, 700))]
    ends = P.ranges_to_next_start(spark.createDataFrame(starts, "book_id string, pos int, start int, max_page int")).collect()
    for r in ends:
        assert r.end == next((s[2] - 1 for s in starts[r.pos + 1 :] if s[2] > r.start), 999)


def test_ancestors_at_any_depth(spark):
    rows = spark.range(1000).selectExpr("'b' as book_id", "cast(id as int) as pos", "cast(id as int) as level")
    df = P.parents_by_level(rows)
    assert [r.parent_pos for r in df.orderBy("pos").collect()] == [None, *range(999)]
    assert sorted(r.pos for r in P.matching_with_ancestors(df, F.col("pos") == 700).collect()) == list(range(701))
    circle = spark.createDataFrame([("b", 1, 2), ("b", 2, 3), ("b", 3, 1), ("b", 4, 3), (None, 5, None), (None, 6, 5)], "book_id string, pos int, parent_pos int")
    assert sorted(r.pos for r in P.matching_with_ancestors(circle, F.col("pos") == 4).collect()) == [1, 2, 3, 4]
    assert sorted(r.pos for r in P.matching_with_ancestors(circle, F.col("pos") == 6).collect()) == [5, 6]
    assert P.matching_with_ancestors(circle, F.lit(False)).count() == 0


def test_covering_segments(spark, monkeypatch):
    monkeypatch.setattr(mapping, "BLOCK", 16)
    rng = np.random.default_rng(2)
    segments, at = [], 0
    for k in range(30):
        at += int(rng.integers(1, 9))
        segments.append(("a", at, at + int(rng.integers(0, 60)), k))
        at = segments[-1][2]
    pages = [("a", p) for p in range(1, at + 20)] + [("c", 4)]
    got = mapping.covering(spark.createDataFrame(pages, "book_id string, printed int"), spark.createDataFrame(segments, "book_id string, printed_start int, printed_end int, offset int")).collect()
    assert sorted((r.book_id, r.printed, -1 if r.inside is None else r.inside) for r in got) == sorted((b, p, next((k for c, x, y, k in segments if c == b and x <= p <= y), -1)) for b, p in pages)


# --- outline text: the rules, one line at a time ---

ROMAN = "[ivxlcdm]+"
LABEL = re.compile(rf"(\d{{1,6}}|{ROMAN})$", re.I)
WORD = re.compile(rf"(part|chapter)\s+(\d+|{ROMAN}|one|two|three|four|five|six|seven|eight|nine|ten)([.():\-–—]\s*|\s+)?(.*)$", re.I)
END = re.compile(rf"(.+?)\s*(\.{{2,}}|…+|·{{2,}}|_{{2,}}|\s{{2,}}|\s)\s*(\d{{1,6}}|{ROMAN})$", re.I)
PLACE = {"part": 1, "chapter": 2}


def cells_of(line):
    """Sno, title and page of a delimited line without quotes; else None."""
    for mark in "\t|,":
        if mark in line:
            f = [x.strip() for x in line.split(mark)]
            if not LABEL.match(f[-1]):
                return None
            if len(f) == 2 and f[0]:
                return "", f[0], f[1]
            return (f[0], " ".join(f[1:-1]).strip(), f[-1]) if len(f) > 2 and re.fullmatch(r"\d+(\.\d+)*", f[0]) and f[1] else None
    return None


def kind_and_level(title):
    if m := WORD.match(title):
        return m[1].lower(), PLACE[m[1].lower()]
    if m := re.match(r"(\d+(?:\.\d+)*)[.)]?\s+.", title):
        return "section", m[1].count(".") + 1
    for start, kind in (("appendix", "appendix"), ("bibliography", "bibliography"), ("references", "bibliography"), ("notes", "notes"), ("index", "index")):
        if title.casefold().startswith(start):
            return kind, 1
    return "section", 1


def read_outline(text):
    lines = [(x, x.strip()) for x in text.split("\n") if x.strip()]
    often = Counter(line.casefold() for _, line in lines)
    out, held, word = [], [], ""

    def add(title, label="", rule="", sure=0.0, sno="", kind="", level=None, codes=()):
        title = re.sub(r"\s+", " ", title).strip(" .…·_|\t")
        k, own = kind_and_level(title)
        out.append({"title": title, "label": label if label.isdigit() else label.lower(), "page": int(label) if label.isdigit() else None, "rule": rule, "sure": sure, "include": bool(title), "source": sno, "kind": kind or k, "level": level or own,
                    "codes": {*codes, *(["missing_page"] if not label else ["roman_page"] if not label.isdigit() else []), *([] if title else ["missing_title"])}})

    def odd(codes, rule, sure, line):
        add(line, rule=rule, sure=sure)
        out[-1] |= {"include": False, "codes": set(codes)}

    for raw, line in lines:
        head, end, cells = WORD.match(line), END.match(line), cells_of(line)
        alone = bool(head and not head[4])
        if re.fullmatch(r"(table\s+of\s+)?contents?(\s+continued)?", line, re.I):
            odd(["possible_running_header", "possible_noise"], "running_header", 0.15, line)
        elif often[line.casefold()] > 1 and not end and not cells:
            odd(["possible_running_header", "possible_noise", "ambiguous_page"], "repeated_noise", 0.12, line)
        elif cells:
            add(cells[1], cells[2], "delimited", 0.96, sno=cells[0], level=cells[0].count(".") + 1 if cells[0] else None)
        elif held and LABEL.match(line):
            add(" ".join(held), line, "multiline", 0.72, kind=word, level=PLACE.get(word, 1))
            held, word = [], ""
        elif end and not (alone and not re.search(r"\.{2,}|…|·{2,}|_|\t|\s{2,}", raw)):
            leader = bool(re.search(r"\.{2,}|…|·{2,}|_", end[2]))
            add(" ".join([*held, end[1].strip(" .…·_")]), end[3], "dotted_leader" if leader else "plain_title_page", 0.93 if leader else 0.82, kind=word, level=PLACE.get(word))
            held, word = [], ""
        elif head and head[4].strip():
            if held:
                add(" ".join(held), rule="ambiguous_multiline", sure=0.35, kind=word, level=PLACE.get(word, 1), codes=["ambiguous_page"])
                held = []
            add(line, rule="structural_without_page", sure=0.68, kind=head[1].lower(), level=PLACE[head[1].lower()])
        elif head:
            held, word = [*held, line], head[1].lower()
        else:
            if len(held) >= 3:
                add(" ".join(held), rule="ambiguous_multiline", sure=0.3, kind=word, level=PLACE.get(word, 1), codes=["ambiguous_page"])
                held, word = [], ""
            held.append(line)
    if held:
        add(" ".join(held), rule="ambiguous_multiline", sure=0.3, kind=word, level=PLACE.get(word, 1), codes=["ambiguous_page"])
    return finished(out)


def finished(out):
    dotted = any("." in c["source"] for c in out)
    for i, c in enumerate(out):
        c["sno"] = int(c["source"]) if c["source"] and not dotted else i + 1
        if c["kind"] == "chapter":
            c["level"] = 2 if any(x["kind"] == "part" for x in out[:i]) else 1
    for i, c in enumerate(out):
        if c["kind"] == "part" and not c["label"] and c["page"] is None:
            inside = [x for x in out[i + 1 :]]
            stop = next((j for j, x in enumerate(inside) if x["level"] <= c["level"]), len(inside))
            page = next((x["page"] for x in inside[:stop] if x["page"] is not None), None)
            if page is not None:
                c["given"] = page
    for i, c in enumerate(out):
        if "given" in c:
            c |= {"page": c["given"], "label": str(c["given"]), "sure": min(c["sure"], 0.62), "codes": c["codes"] - {"missing_page"} | {"page_inferred_from_child"}}
        above = [j for j in range(i) if out[j]["level"] < c["level"]]
        c["parent"] = above[-1] + 1 if above else None
        if c["level"] > 1 and not above:
            c["codes"] |= {"unresolved_hierarchy"}
    key = lambda c: re.sub("[^a-z0-9]+", " ", c["title"].casefold()).strip()
    for c in out:
        same = [x for x in out if key(x) == key(c)]
        c["codes"] |= ({"duplicate_title"} if len(same) > 1 and same[0]["title"] else set()) | ({"duplicate_sno"} if sum(x["sno"] == c["sno"] for x in out) > 1 else set())
    return out


LINES = [
    "Contents", "Table of  Contents continued", "Part One", "Part Two .... iv", "PART III: Of things", "  Chapter 7", "Chapter 7", "Chapter  12", "Chapter 3 Begin", "Chapter IV. Titles 17", "45", "xii", "2.3 Deep title", "2.3.1 Deeper  9",
    "A plain title 12", "Dotted title ...... 33", "Under_score_5", "Under__5", "1 | First | 10", "1.2 | Second | part | xi", "x | y | 3", "Tab\t8", "2\tTwo\t9", "Comma, 4", "3, Three, four, 5", "words with, a comma", "Appendix A", "Index 99", "notes", "Repeated line",
    "Repeated line", "A long heading that goes", "on over lines", "and more of it", "and yet more", "…", "... 5", "Chapter Ten", "Part 2", "1. One 2", "Chapter 5: Rest … 6", "Ünïcode title 7",
]


def test_outline_text(spark):
    rng = np.random.default_rng(11)
    texts = [(i, "\n".join(rng.choice(LINES, rng.integers(0, 14)))) for i in range(300)] + [(300, "  Chapter 7"), (301, "Chapter  12"), (302, "2.3 Deep title\n45"), (303, "Part One .... iv\nChapter 1 Start 7"), (304, "\n".join(LINES))]
    got = parse.parse_outlines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {"pos", "title", "page_label", "rule", "confidence", "include", "source_sno", "kind", "page", "level", "sno", "parent_pos", "parent_sno", "codes", "inferred"} <= set(got.columns)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.doc_id, {})[r.pos] = (r.title, r.page_label, r.page, r.rule, round(r.confidence, 4), r.include, r.source_sno, r.kind, r.level, r.sno, r.parent_pos, r.codes)
    for i, text in texts:
        want = {k: (c["title"], c["label"], c["page"], c["rule"], c["sure"], c["include"], c["source"], c["kind"], c["level"], c["sno"], c["parent"], sorted(c["codes"])) for k, c in enumerate(read_outline(text), 1)}
        assert rows.get(i, {}) == want, text


def test_quotes_hold_cells_together():
    assert parse.outline_rows('"A | title" | 12')[0][:2] == ("A | title", "12")
    assert parse.outline_rows('1\t"Tab\tbed"\t12')[0][:2] == ("Tab bed", "12")
    assert parse.outline_rows('"A, title", 12')[0][:2] == ("A, title", "12")


# --- merging ---


def merged(draft, cand, actions):
    key = lambda t: re.sub("[^a-z0-9]+", " ", t.casefold()).strip()
    new, clash, found = [], [], {}
    for c in cand:
        hit = None
        if not c["include"]:
            found[c["pos"]] = ("ignored", "excluded", None)
            continue
        for why, test in (
            ("same_title", lambda e, c=c: key(e["title"]) == key(c["title"])), ("same_page", lambda e, c=c: c["printed"] is not None and e["printed"] == c["printed"]),
            ("near_title", lambda e, c=c: SequenceMatcher(None, key(c["title"]), key(e["title"])).ratio() >= 0.9), ("same_sno", lambda e, c=c: c["sno_explicit"] and e["sno"] == c["sno"]),
        ):
            hit = next((e for e in draft if test(e)), None)
            if hit:
                break
        if not hit:
            new.append(c)
            found[c["pos"]] = ("new", "new", None)
            continue
        page = hit["printed"] == c["printed"] if hit["printed"] is not None or c["printed"] is not None else (hit["label"] or "").casefold() == (c["label"] or "").casefold()
        match = why == "same_title" and page and hit["kind"] == c["kind"] and hit["level"] == c["level"]
        found[c["pos"]] = ("match" if match else "conflict", why, hit["sno"])
        if not match:
            clash.append((c, hit))
    body = [dict(e) for e in draft]
    for c, hit in [(c, None) for c in new] + clash:
        action = actions.get(c["pos"], "keep_draft")
        if hit is None or action == "keep_both":
            free = max((e["sno"] for e in body), default=0) + 1
            own = c["sno"] or free
            body.append({**c, "sno": free if any(e["sno"] == own for e in body) else own})
        elif action == "use_candidate":
            at = next(i for i, e in enumerate(body) if e["sno"] == hit["sno"])
            body[at] = {**c, "sno": hit["sno"]}
    return found, sorted(((e["sno"], e["title"], e["kind"], e["level"], e["printed"]) for e in body), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_merge(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["Alpha", "alpha!", "The beta title of it", "The beta title of its", "The beta titles of it", "Gamma", "Delta", "delta ", "A long name of many words here", "A long name of many word here", "Epsilon", ""]
    rows, pos = [], 0
    books = [f"b{i}" for i in range(30)]

    def one(**more):
        nonlocal pos
        pos += 1
        printed = int(rng.integers(1, 12)) if rng.random() < 0.6 else None
        return {"pos": pos, "title": str(rng.choice(names)), "kind": str(rng.choice(["chapter", "section"])), "level": int(rng.integers(1, 3)), "printed": printed, "label": None if printed else [None, "", "xi", "XI"][rng.integers(0, 4)], **more}

    for b in books:
        draft = [one(sno=k + 1) for k in range(rng.integers(0, 5))]
        cand = [one(sno=None if rng.random() < 0.5 else int(rng.integers(0, 9)), include=bool(rng.random() < 0.9), sno_explicit=bool(rng.random() < 0.5)) for _ in range(rng.integers(0, 7))]
        rows.append((b, draft, cand, {c["pos"]: str(rng.choice(["use_candidate", "keep_both", "keep_draft"])) for c in cand}))
    base = "book_id string, pos long, sno int, title string, kind string, level int, printed int, label string"
    pick = lambda e, *more: tuple(e[c] for c in ("pos", "sno", "title", "kind", "level", "printed", "label", *more))
    draft = spark.createDataFrame([(b, *pick(e)) for b, d, *_ in rows for e in d], base)
    cand = spark.createDataFrame([(b, *pick(e, "include", "sno_explicit")) for b, _, c, _ in rows for e in c], base + ", include boolean, sno_explicit boolean")
    acts = spark.createDataFrame([(b, p, a) for b, *_, r in rows for p, a in r.items()], "book_id string, pos long, action string")
    found = merge.analyse(draft, cand)
    seen = {(r.book_id, r.pos): (r.category, r.reason, r.draft_sno) for r in found.collect()}
    body = {}
    for r in merge.apply(draft.drop("label"), found, acts).collect():
        body.setdefault(r.book_id, []).append((r.sno, r.title, r.kind, r.level, r.printed))
    for b, d, c, r in rows:
        want, after = merged(d, c, r)
        assert {p: v for (book, p), v in seen.items() if book == b} == want
        assert sorted(body.get(b, []), key=repr) == after


def test_appended_numbers_follow_one_another(spark):
    base = "book_id string, pos long, sno int, title string, kind string, level int, printed int"
    draft = spark.createDataFrame([("b", 1, 10, "Ten", "section", 1, 1)], base)
    cand = spark.createDataFrame([("b", 2, None, "Alpha", "section", 1, 2, True, False), ("b", 3, 11, "Beta", "section", 1, 3, True, True)], base + ", include boolean, sno_explicit boolean")
    got = merge.apply(draft, merge.analyse(draft, cand)).orderBy("sno").collect()
    assert [(r.sno, r.title) for r in got] == [(10, "Ten"), (11, "Alpha"), (12, "Beta")]


# --- split words and wrapping ---


def repaired(text, known=None):
    def whole(m):
        left, right = m[1], m[2]
        stays = f"{left}-{right}".lower() in A.KEEP_HYPHENS or (known is not None and (left + right).lower() not in known)
        return m[0] if stays else left + right

    return re.sub(r"-\s+\b", "- ", re.sub(r"\b([A-Za-z]{2,})- +([A-Za-z]{2,})\b", whole, text.replace("­", "")))


def chunked(text, width):
    out = []
    for block in re.split(r"\n\s*\n", text):
        block = repaired(re.sub(r"\s+", " ", block).strip())
        carry = ""
        for part in [block] if len(block) <= width else re.split(r"(?<=[.!?])\s+", block):
            joined = (carry + " " + part).strip()
            if len(joined) <= width:
                carry = joined
                continue
            out.append(carry)
            line = ""
            for word in part.split():
                if len(line) + len(word) + bool(line) > width:
                    out.append(line)
                    line = word
                else:
                    line = f"{line} {word}".strip()
            carry = line
        out.append(carry)
    return [c for c in out if c]


def random_texts(n):
    rng = np.random.default_rng(8)
    bits = ["exam- ple", "long- term", "Long-  term", "a- bout", "x- y", "one", "two.", "three!", "pol­icy", "\n", "\n \n", "\t", "über- all", "fooä- bar", "no-break", "end-", "- dash", "policy-  guided", "long- term- plan", "a" * 30, "B2- bee", "two_- three", "cd- efg- hij"]
    return [" ".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(n)]


def test_split_words_and_wrapping(spark):
    texts = random_texts(400)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert {r.i: r.text for r in A.dehyphenated(df).collect()} == {i: repaired(t) for i, t in enumerate(texts)}
    words = spark.createDataFrame([("example", 3.0), ("cdefg", 9.1), ("overall", 2.9)], "word string, zipf double")
    assert {r.i: r.text for r in A.dehyphenated(df, "text", words).collect()} == {i: repaired(t, {"example", "cdefg"}) for i, t in enumerate(texts)}
    got = {}
    for r in A.wrapped(df, "text", 24).collect():
        got.setdefault(r.i, {})[r.chunk_no] = r.chunk
    assert got == {i: dict(enumerate(c)) for i, t in enumerate(texts) if (c := chunked(t, 24))}
    clash = df.withColumn("key", F.lit(1)).withColumn("Words", F.lit(2)).withColumn("of", F.lit(3))
    assert A.dehyphenated(clash, "text", words).columns == clash.columns


# --- topics ---


def test_topics_of_each_chapter(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("a", 40), ("b", 12), ("c", 3)):
        theme = [rng.choice(60, 12, replace=False) for _ in range(3)]
        rows += [(g, i, [f"t{k:02d}" for k in rng.choice(theme[i % 3], 9)]) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, unit int, p array<string>")
    weights = A.tfidf(df, "g", "unit", F.col("p"), 1)
    x = weights.toPandas()
    units, terms = (t.toPandas() for t in A.factorised(weights))
    for g, k in (("a", 5), ("b", 4), ("c", 2)):
        own = x[x.g == g].pivot(index="unit", columns="term", values="w").fillna(0.0)
        W = np.array(units[units.g == g].set_index("unit").loc[own.index, "f"].tolist())
        H = np.array(terms[terms.g == g].set_index("term").loc[own.columns, "f"].tolist()).T
        assert (W >= 0).all() and (H >= 0).all() and not W[:, k:].any() and not H[k:].any() and H[:k].any(1).all()
        X = own.to_numpy()
        best = min(plain_nmf(X, k, seed) for seed in range(3))
        assert ((X - W @ H) ** 2).sum() <= 1.05 * best


def plain_nmf(X, k, seed):
    rng = np.random.default_rng(seed)
    W, H = rng.random((X.shape[0], k)), rng.random((k, X.shape[1]))
    for _ in range(400):
        H *= (W.T @ X) / (W.T @ W @ H + 1e-12)
        W *= (X @ H.T) / (W @ H @ H.T + 1e-12)
    return ((X - W @ H) ** 2).sum()


def test_topic_counts(spark):
    n = spark.range(1, 200).select(F.col("id").alias("n"), A.topic_count(F.col("id")).alias("k")).collect()
    assert all(r.k == (2 if r.n <= 2 else min(max(2, min(5, int(r.n**0.5) + 1)), 12, r.n - 1)) for r in n)


def test_chapter_topics(spark):
    text = {"a": ["stone bridge over river water", "river water under stone bridge", "green field near stone wall", "stone wall near green field", "river water again"], "b": ["only paragraph here"], "c": ["", "of it"]}
    rows = [(c, i, t) for c, ts in text.items() for i, t in enumerate(ts)]
    got = A.chapter_topics(spark.createDataFrame(rows, "chapter string, unit int, text string"), ("the",)).collect()
    assert [(r.chapter, r.topic) for r in sorted(got)] == [("a", 0), ("a", 1), ("a", 2)]
    assert all(r.words for r in got) and any("stone bridge" in r.words for r in got)
    assert A.chapter_topics(spark.createDataFrame([], "chapter string, unit int, text string"), ()).count() == 0
    chapters = spark.createDataFrame([("a", "On stones"), ("b", None)], "chapter string, title string")
    terms = spark.createDataFrame([("a", "stone bridge", 1), ("a", "river water", 2)], "chapter string, term string, place int")
    topics = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("a", 3, "never")], "chapter string, topic int, words string")
    lines = A.compound_summaries(chapters, terms, topics).orderBy("chapter").collect()
    assert [tuple(r) for r in lines] == [("a", "On stones", "stone bridge, river water", "Topic 1: x | Topic 2: y"), ("b", "b", "", "")]


def test_ngrams(spark):
    rows = [(["a", "b", "c", "d"],), (["a"],), ([],), (["a", "b"],)]
    got = spark.createDataFrame(rows, "w array<string>").select("w", A.ngrams(F.col("w"), 1, 3).alias("g"), A.ngrams(F.col("w"), 2, 2).alias("h")).collect()
    for r in got:
        grams = lambda n, w=r.w: [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
        assert r.g == grams(1) + grams(2) + grams(3) and r.h == grams(2)
