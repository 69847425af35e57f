"""The filter audit against filters applied one after the other, in every order."""

import re
from collections import Counter
from itertools import permutations

from pagewright.llm import filteraudit

SCHEMA = "doc_id long, text string, source string, good string, part int, A long, digest string, all int"
MANY = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, MANY, "a"), (2, MANY, "a"), (3, MANY, "b"), (3, MANY, "a"), (1, MANY, None), (None, MANY, "a"), (4, None, "a"), (5, "", "b"), (6, "", "b"), (7, " \t\n ", ""), (8, "word " * 80, "a"), (9, "LOUD " * 70, "b"),
    (10, MANY + " | # $", "a"), (11, MANY.upper() + " &", "b"), (12, "x" * 5000, "a"), (13, "ein\xa0Wort Ünïcode\x0b" * 30, "b"), (14, "short & LOUD", "a"), (15, "short & LOUD", "a"), (16, "é" * 20 + "A", "b"), (17, "é" * 19 + "A", "b"),
    (18, "long " * 50_000, "a"), (None, None, None),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (5, None, 1), (14, 1, 1), (None, 1, 1), (99, 1, 1), (18, 1, 0)]


def brute(rows, labels):
    texts = [(d, t or "", s or "") for d, t, s in rows]
    least = {}
    for d, t, _ in texts:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    items = []
    for d, t, s in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)) + "D" * any(c in "#$%&*|" for c in t)
        items.append((s, fails + "E" * (d is not None and t in least and least[t] < d), d in good, d in toxic))
    out = Counter()
    for part in {x[0] for x in items}:
        own, shapley, steps = [x for x in items if x[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                failing = sum(f in x[1] for x in own)
                steps.append(("".join(order), step, len(left), len(gone), failing - len(gone), sum(x[1] == f for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        out.update((part, *s[:-1], shapley[s[-1]]) for s in steps)
    return out


def test_audit(spark):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in ROWS], SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = filteraudit.audit(docs, labels)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(map(tuple, out.collect())) == brute(ROWS, LABELS)


def test_audit_of_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    one = filteraudit.audit(spark.createDataFrame([(1, MANY, "a", "x", 1, 2, "y", 3)], SCHEMA), labels)
    assert one.count() == 600 and one.where("kept <> 1 or removed <> 0 or shapley <> 0").count() == 0


def test_other_filters(spark):
    """Any number of flags: dividends add up to what is removed, exact counts to all rows."""
    rows = [(i % 2, i % 3 == 0, i % 5 == 0, i % 7 == 0, i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "p int, x boolean, y boolean, z boolean, good boolean").selectExpr("*", "not good as toxic")
    joint = filteraudit.joint_failures(df, "xyz", "p", ("good", "toxic"))
    parts = filteraudit.dividends(joint, "xyz", "p").collect()
    for p in (0, 1):
        own = [r for r in rows if r[0] == p]
        name = lambda r: "".join(f for f, bad in zip("xyz", r[1:4], strict=True) if bad)
        assert {r.filters: r.exact for r in parts if r.p == p} == {f: sum(name(r) == f for r in own) for f in ("", "x", "y", "z", "xy", "xz", "yz", "xyz")}
        assert sum(r.dividend for r in parts if r.p == p) == sum(any(r[1:4]) for r in own)
    steps = filteraudit.every_order(joint, "xyz", "p").collect()
    assert len(steps) == 2 * 6 * 3
    for p in (0, 1):
        shapley = {r.filter_order[0]: r.shapley for r in steps if r.p == p and r.step == 1}
        assert sum(shapley.values()) == 6 * sum(any(r[1:4]) for r in rows if r[0] == p)
