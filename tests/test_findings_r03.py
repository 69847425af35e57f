"""What the review of round 3 found."""

import math
import os
import random
import time
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import mixing, tokenfiles
from pagewright.operators import analytics as A
from pagewright.operators import merge
from pagewright.operators import review as R
from pagewright.sources import tables
from pagewright.sources.shared import written


def test_shown_sizes_send_halves_to_the_even_tenth(spark):
    sizes = [4096 * 40000, 3 * 4096 * 40000, 0, 1 << 20, (1 << 20) - 1, 20 * 4096 * 40001, 1 << 60, 52429 * 3, None]
    got = {r.n: r.size for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", R.megabytes(F.col("n")).alias("size")).collect()}
    assert got == {n: None if n is None else f"{n / 1048576.0:.1f} MB" for n in sizes}


def test_template_numbers_do_not_depend_on_the_order_of_rows(spark):
    rows = [("b", "T", 1, 2.0, kind, end) for kind in ("heading", "toc") for end in (3, 4)] + [("b", "S", 1, 2.0, "toc", 9)]
    shape = "book_id string, title string, start int, y double, kind string, end int"
    one, other = ([tuple(r) for r in tables.outline_template(spark.createDataFrame(given, shape).coalesce(1)).orderBy("Sno").collect()] for given in (rows, rows[::-1]))
    assert one == other
    assert [(r[1], r[2], r[3]) for r in one] == [(1, "S", "toc"), (2, "T", "heading"), (3, "T", "heading"), (4, "T", "toc"), (5, "T", "toc")]


def test_near_titles_compare_each_title_once(spark):
    """Book a has 8,000 rows a side of one title each; compared row by row these were 64 million pairs, once for each shared piece."""
    side = lambda title: spark.range(8000).select(F.lit("a").alias("book_id"), F.col("id").cast("int").alias("pos"), F.lit(None).cast("int").alias("sno"), F.lit(title).alias("title"), F.lit("section").alias("kind"), F.lit(1).alias("level"), F.lit(None).cast("int").alias("printed"))
    began = time.monotonic()
    got = merge.near_titles(side("river crossings of the north and the south"), side("river crossing of the north and the south").where("pos >= 5")).agg(F.count("*"), F.countDistinct("cand_pos"), F.min("d.pos"), F.max("d.pos")).first()
    assert tuple(got) == (8000, 8000, 5, 5)
    assert time.monotonic() - began < 40


def test_token_files_keep_the_order_of_the_mix(spark, tmp_path):
    """Of the sources a and b, whose ids lie apart, the first tokens come from both, slot by slot, and any document is found by its id."""
    docs = spark.range(600).selectExpr("id as doc_id", "concat('text number ', id) as text", "'en' as lang", "if(id < 400, 'a', 'b') as source", "1L as n_chars").repartition(7)
    place = {r.doc_id: r.position for r in mixing.interleave(docs).collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    mixed.write.parquet(str(tmp_path / "mixed"))
    for now in (spark.read.parquet(str(tmp_path / "mixed")), mixed.cache()):
        got = [r.doc_id for r in corpus_pipeline.token_output(spark, now, "").orderBy("start").collect()]
        assert got == sorted(place, key=place.get) and got != sorted(got)
    at, order = tokenfiles.file_order(spark.read.parquet(str(tmp_path / "mixed")))
    tokenfiles.write_corpus(at, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "tokens"), order=order)
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(tokenfiles.read_document(str(tmp_path / "tokens"), d) == [*tokens.encode(f"text number {d}", add_special_tokens=False).ids, 2] for d in (0, 399, 400, 599))
    assert tokenfiles.read_document(str(tmp_path / "tokens"), 600) is None


def test_terms_of_no_chance_are_not_kept(spark, monkeypatch):
    """The first terms of random groups equal a plain loop's, and the tables made on the way, such as that of all counts, don't stay on disk."""
    rng = random.Random(5)
    rows = [(f"g{i % 3}", None if i == 7 else i, [rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 5) for _ in range(20)] + [f"own{i}x{j}" for j in range(40)]) for i in range(200)]
    kept = []
    monkeypatch.setattr(A, "written", lambda df, name: kept.append(out := written(df, name)) or out)
    got = {(r.g, r.term): (r.place, r.score) for r in A.weighted_top(spark.createDataFrame(rows, "g string, u int, t array<string>"), "g", "u", F.col("t"), 4).collect()}
    assert [os.path.isdir(df.__dict__["_folder"].removeprefix("file:")) for df in kept] == [False] * (len(kept) - 1) + [True] and kept[-1].count() == 12
    want = {}
    for g in ("g0", "g1", "g2"):
        own = [Counter(t) for h, _, t in rows if h == g]
        df = Counter(x for c in own for x in c)
        idf = {x: math.log((1 + len(own)) / (1 + k)) + 1 for x, k in df.items() if k >= 2}
        mean = Counter()
        for c in own:
            w = {x: n * idf[x] for x, n in c.items() if x in idf}
            for x, v in w.items():
                mean[x] += v / math.hypot(*w.values()) / len(own)
        for place, x in enumerate(sorted(mean, key=lambda x: (-round(mean[x], 9), x))[:4], 1):
            want[g, x] = place, mean[x]
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
