"""Operators leave columns alone that have the names they use themselves."""

from pagewright.llm import decontam, mixing

HELPERS = ["__d", "__k", "__dk", "__spans", "__id", "__at", "key", "d", "k", "id", "at", "spans", "KEY_", "w", "dk", "n_words"]
PASSAGE = " ".join(f"word{i}" for i in range(20))


def frame(spark):
    rows = [(1, "an own text of some words", "a"), (2, PASSAGE, "a"), (2, PASSAGE, "b"), (None, None, None), (3, "before " * 200 + PASSAGE, "b")]
    return spark.createDataFrame([(*r, *range(len(HELPERS))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{h}` int" for h in HELPERS))


def test_decontamination(spark):
    df, bench = frame(spark), spark.createDataFrame([("q", PASSAGE)], "item_id string, text string")
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r["__d"], r.spans) for r in kept.collect()) == [(0, 0, 11), (1, 0, 11)]
    cut = decontam.cut_spans(df, bench)
    assert cut.columns == [*df.columns, "clean_text"] and cut.count() == 5
    got = {r.doc_id: (r.clean_text, r["__dk"], r.key) for r in cut.collect()}
    assert got == {1: ("an own text of some words", 2, 6), 2: ("", 2, 6), 3: (" ".join(["before"] * 200), 2, 6), None: (None, 2, 6)}


def test_mixture(spark):
    df = frame(spark)
    out = mixing.mixture(df, 1.0)
    assert out.columns == df.columns and out.count() == 5 and {r["__id"] for r in out.collect()} == {4}
