"""Filter interaction audit by inclusion-exclusion.

Each filter is a flag of a row: true where the row fails it. For every set of filters the rows that
fail all of it are counted as the sum of the product of its flags (joint failures, 2 ** k sums a
part and weight, one pass with partial aggregation). All else follows from these sums, whatever the
order in which filters are applied: with J(S) the joint failures of S,

* survivors of a set P of filters: the sum over S within P of (-1)^|S| J(S) (Moebius inversion);
* removed by f after P: survivors of P less survivors of P with f;
* failing f alone: the sum over S with f of (-1)^(|S| - 1) J(S);
* the Harsanyi dividend of S in the game "rows removed": (-1)^(|S| - 1) J(S); the Shapley value of f
  is the sum over S with f of dividend / |S|, times k! in whole numbers.

The audit of the training documents has five filters over the whole text (words are runs of other
characters than space and U+0009 to U+000D): A under 50 words; B less than 65 distinct words in 100;
C more than 5 letters A-Z in 100 code points; D holds one of # $ % & * |; E the text of a smaller doc_id.
E needs no windows over copies: the smallest doc_id of each repeated text is joined to its rows, and
the join may be split where a text has very many. Only digests, ids and flags are shuffled.

Null texts are empty texts, and copies of each other. A null doc_id is neither smaller nor larger than
another, so its row fails no E; rows with equal doc_id don't make each other fail E. Null parts are the part "". Labels
that repeat count once (1 if any is 1); rows without a label weigh nothing. No rows in, no rows out. Other
columns of the input are not read.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm._common import table, written

MIN_WORDS = 50
DISTINCT, CAPITALS = 65, 5
"""In a hundred: distinct words at least, letters A-Z at most."""
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
FILTERS = "ABCDE"


def text_flags(text: Column) -> dict[str, Column]:
    """The failures that a text shows by itself, A to D."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < MIN_WORDS, "B": 100 * distinct < DISTINCT * n, "C": 100 * capitals > CAPITALS * F.length(text), "D": text.rlike(SYMBOLS)}


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, A, B, C, D, E) for every row of docs: the flags are true where it fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = own.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *(c.alias(k) for k, c in text_flags(F.col("text")).items()))
    own = written(own, "audit-flags")
    repeated = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(repeated.withColumnRenamed("digest", "of"), "audit-copies")  # so that the join has a shuffle of its own, which can be split
    return own.join(first, F.col("digest") == F.col("of"), "left").withColumn("E", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("of", "first")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: whether a label says quality = 1, toxic = 1."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    known = written(known.where("good or toxic"), "audit-labels")
    return rows.join(known, F.col("doc_id") == F.col("of"), "left").drop("of").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})


def joint_failures(rows: DataFrame, filters: str | list[str], part: str, weights: tuple[str, ...] = ()) -> DataFrame:
    """rows with a boolean column a filter -> one row a part: "all" and each weight, arrays of the 2 ** k joint failures.

    Entry m counts the rows (of true weight) that fail every filter whose bit is in m; entry 0 counts all.
    """
    k = len(filters)
    flag = [F.coalesce(F.col(f), F.lit(False)).cast("long") for f in filters]

    def products(weight: Column) -> list[Column]:
        out = [weight]
        for m in range(1, 1 << k):
            low = (m & -m).bit_length() - 1
            out.append(out[m & (m - 1)] * flag[low])
        return out

    own = {"all": F.lit(1).cast("long")} | {w: F.coalesce(F.col(w), F.lit(False)).cast("long") for w in weights}
    return rows.groupBy(part).agg(*(F.array(*(F.sum(p) for p in products(w))).alias(name) for name, w in own.items()))


def _inverted(joint: str, need: str, within: str) -> Column:
    """The sum over the sets S that hold `need` and lie within `within` (masks) of (-1)^(|S| - |need|) joint(S)."""
    return F.expr(
        f"aggregate(sequence(0, size({joint}) - 1), 0L, (s, x) -> s + if((x & ({need})) = ({need}) and (x & ({within})) = x, if((bit_count(x) - bit_count({need})) % 2 = 0, 1L, -1L) * {joint}[x], 0L))"
    )


def orders(filters: str) -> list[tuple]:
    """(filter_order, step, bit of its filter, mask of those before) for every order."""
    out = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(order), step, 1 << filters.index(f), before))
            before |= 1 << filters.index(f)
    return out


def every_order(joint: DataFrame, filters: str, part: str) -> DataFrame:
    """A row for each part, order and step, from the joint failures ("all", "good" and "toxic") alone."""
    k = len(filters)
    table = json.dumps([dict(zip(("filter_order", "step", "f", "before"), r, strict=True)) for r in orders(filters)])  # k k! steps
    steps = F.explode(F.from_json(F.lit(table), "array<struct<filter_order: string, step: int, f: int, before: int>>"))
    rows = joint.withColumn("at", steps).select(part, "all", "good", "toxic", "at.*")
    share = f"aggregate(sequence(1, size(all) - 1), 0L, (s, m) -> s + if((m & f) = f, if(bit_count(m) % 2 = 1, 1L, -1L) * all[m] * {factorial(k)}L div bit_count(m), 0L))"
    removed = _inverted("all", "f", "before | f")
    return rows.select(
        part, "filter_order", "step", _inverted("all", "0", "before | f").alias("kept"), removed.alias("removed"), (F.expr("all[f]") - removed).alias("redundant"),
        _inverted("all", "f", str((1 << k) - 1)).alias("unique_fails"), _inverted("good", "f", "before | f").alias("good_lost"), _inverted("toxic", "f", "before | f").alias("toxic_lost"), F.expr(share).alias("shapley"),
    )


def dividends(joint: DataFrame, filters: str, part: str) -> DataFrame:
    """(part, filters, joint, exact, dividend): for each set of filters the rows failing all of it, those failing it and no
    other, and its Harsanyi dividend; the interactions behind the Shapley values."""
    k = len(filters)
    names = F.array(*(F.lit("".join(f for i, f in enumerate(filters) if m >> i & 1)) for m in range(1 << k)))
    rows = joint.select(part, "all", F.posexplode(names).alias("m", "filters"))
    sign = F.expr("if(bit_count(m) % 2 = 1, 1L, -1L)")
    return rows.select(part, "filters", F.expr("all[m]").alias("joint"), _inverted("all", "m", str((1 << k) - 1)).alias("exact"), F.when(F.col("m") > 0, sign * F.expr("all[m]")).otherwise(0).alias("dividend"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs' five filters: a row for each part, order and step."""
    joint = joint_failures(labelled(flagged(docs), labels), list(FILTERS), "part", ("good", "toxic"))
    return every_order(written(joint, "audit-joint"), FILTERS, "part")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The filters are applied to every row in every order; no inclusion-exclusion.
ORACLE = r"""
with words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
marks as (select doc_id, coalesce(max(case when quality = 1 then 1 else 0 end), 0) as good, coalesce(max(case when toxic = 1 then 1 else 0 end), 0) as toxic from labels group by doc_id),
flags as (select part, {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(min(doc_id) over (partition by t) < doc_id, false)} as f, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from words left join marks using (doc_id)),
fails as (select part, f['A'] as a, f['B'] as b, f['C'] as c, f['D'] as d, f['E'] as e, count(*) as n, sum(good) as good, sum(toxic) as toxic from flags group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select p.x || q.x || r.x || s.x || t.x as o from letters p, letters q, letters r, letters s, letters t where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
failed as (select part, n, good, toxic, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end) || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as bad from fails),
steps as (select o, cast(i as integer) as step, o[i] as x, o[: i - 1] as before from orders, unnest(range(1, 6)) as u(i)),
run as (select part, o, step, x, n, good, toxic, bad, contains(bad, x) as fails, before <> '' and bad <> '' and len(list_intersect(string_split(before, ''), string_split(bad, ''))) > 0 as gone from failed, steps),
sums as (select part, o, step, x, sum(case when not gone and not fails then n else 0 end) as kept, sum(case when not gone and fails then n else 0 end) as removed, sum(case when gone and fails then n else 0 end) as redundant,
  sum(case when bad = x then n else 0 end) as unique_fails, sum(case when not gone and fails then good else 0 end) as good_lost, sum(case when not gone and fails then toxic else 0 end) as toxic_lost from run group by all)
select part, o as filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley from sums
"""
