"""Mixing sources to target weights by Pfair scheduling.

Documents of each source form blocks. Target weights are whole shares c_s of a period of D slots
(their sum is D). Block j of source s is released at slot floor(j D / c_s) and due by slot
ceil((j + 1) D / c_s). D is PERIOD, or more where there are many sources (long_enough). Each slot
takes, of the blocks released, the one with the earliest deadline. As
the windows repeat with each period, one period is scheduled on the driver (D entries, a parameter)
and every block's slot follows by arithmetic. While a source lasts, after any number of slots it has
received its target within less than one block. When a source ends its slots stay empty and the
others keep their ratios; no document is dropped or repeated by the schedule.

Within a source, documents come in order of md5(doc_id), then doc_id. Null sources are one source of
their own; null doc_ids come first; rows with equal doc_id get places side by side. No rows in, no
rows out. Other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm._common import fresh, shuffle_partitions, table, written

PERIOD = 1024
BLOCK = 16
POWER = 0.7
SHARDS = 256
SHARD_ROWS = 1 << 20
"""Rows of a source (or of the mix) that are numbered in one task, about; there are SHARDS of them at least."""
SLOTS = 4
"""Slots of the period for each source on average, at least: with more sources than PERIOD / SLOTS it grows."""
BROADCAST_SLOTS = 1 << 17


def long_enough(sources: int, period: int = PERIOD) -> int:
    """The period itself, or the next power of two that has SLOTS slots for each source."""
    return max(period, 1 << (SLOTS * sources - 1).bit_length()) if sources else period


def tempered_shares(counts: dict, power: float = POWER, period: int = PERIOD) -> dict:
    """Whole shares of the period in proportion to count ** power: one at least, largest remainders first."""
    if len(counts) > period:
        raise ValueError(f"{len(counts)} sources need a period of as many slots at least; it has {period}")
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    total = sum(counts[s] ** power for s in names)
    free = period - len(names)
    exact = {s: free * counts[s] ** power / total for s in names}
    shares = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: int(exact[s]) - exact[s])[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def schedule(shares: dict) -> list[tuple]:
    """One period: (source, block, release, deadline, slot), earliest deadline first among the released."""
    period = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is not None, s or ""))
    window = lambda k, j: (j * period // shares[names[k]], -(-(j + 1) * period // shares[names[k]]))
    waiting = [(0, k, 0) for k in range(len(names))]  # by release
    ready: list[tuple[int, int, int]] = []  # by deadline
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(k, j)[1], k, j))
        due, k, j = heapq.heappop(ready)
        release = window(k, j)[0]
        assert release <= slot < due
        out.append((names[k], j, release, due, slot))
        if j + 1 < shares[names[k]]:
            heapq.heappush(waiting, (window(k, j + 1)[0], k, j + 1))
    return out


def _ranked(df: DataFrame, group: list[str], shard: Column, order: list, name: str) -> DataFrame:
    """df with name: the place of each row in its group, from 0.

    Rows are numbered within (group, shard) and shifted by the rows of earlier shards, so no task
    holds a whole group. shard must rise with order.
    """
    df = df.withColumn("__shard", shard)
    key = [*group, "__shard"]
    counts = df.groupBy(*key).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.withColumn("__place", place).join(starts, cond).withColumn(name, (F.col("__place") + F.col("__start")).cast("long")).drop("__place", "__start", "__shard", *(f"__k{i}" for i in range(len(key))))


def interleave(docs: DataFrame, shares: dict | None = None, block: int = BLOCK, power: float = POWER, period: int = PERIOD) -> DataFrame:
    """(doc_id, source, share, block, release, deadline, slot, position) for every row of docs.

    shares: whole shares by source (default: tempered from the counts of docs). Sources that it lacks
    are not asked for, and their rows have null slots and positions.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source")
    counts = {r[0]: r[1] for r in rows.groupBy("source").count().collect()}
    if shares is None:
        shares = tempered_shares(counts, power, long_enough(len(counts), period)) if counts else {}
    digits = 2
    while max(counts.values(), default=0) > SHARD_ROWS << (4 * digits):
        digits += 1
    total = sum(shares.values())
    slots = spark.createDataFrame(
        [(s, shares[s], j, slot) for s, j, _, _, slot in schedule(shares)] if shares else [], "s string, c long, j long, at long"
    )  # a row for each slot of the period
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    shard = F.when(F.col("doc_id").isNull(), -1).otherwise(F.conv(F.substring(h, 1, digits), 16, 10).cast("int"))
    ranked = _ranked(rows.withColumn("__h", F.when(F.col("doc_id").isNotNull(), h)), ["source"], shard, [F.asc_nulls_first("__h"), F.asc_nulls_first("doc_id")], "rank").drop("__h")
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block))
    small = F.broadcast if total <= BROADCAST_SLOTS else lambda df: df
    share = small(slots.select("s", "c").distinct())
    ranked = ranked.join(share, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    placed = ranked.join(small(slots.drop("c")), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") % F.col("c") == F.col("j")), "left").drop("s", "j")
    lap = F.floor(F.col("block") / F.col("c"))
    placed = placed.select(
        "doc_id", "source", (F.col("c") / F.lit(float(max(total, 1)))).alias("share"), "block",
        F.floor(F.col("block") * total / F.col("c")).alias("release"), F.ceil((F.col("block") + 1) * total / F.col("c")).alias("deadline"),
        (lap * total + F.col("at")).alias("slot"), (F.col("rank") % block).alias("__in"),
    )
    placed = written(placed, "mixing")
    last = placed.agg(F.max("slot")).first()[0] or 0
    pieces = max(SHARDS, 4 * shuffle_partitions(spark), sum(counts.values()) // SHARD_ROWS)
    taken = _ranked(placed.where("slot is not null").withColumn("__all", F.lit(0)), ["__all"], F.floor(F.col("slot") * pieces / (last + 1)).cast("int"), ["slot", "__in"], "position")
    rest = placed.where("slot is null").withColumn("position", F.lit(None).cast("long"))
    return taken.drop("__all", "__in").unionByName(rest.drop("__in"))


def mixture(docs: DataFrame, keep: float, shares: dict | None = None, block: int = BLOCK) -> DataFrame:
    """docs in the order of the mix, up to the share `keep` of its rows: sources above their target lose the rest.

    Rows with one doc_id share its first place; rows without doc_id or place come last and stay.
    """
    id_, at = fresh(docs, "id", "at")
    order = interleave(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "source"), shares, block)
    order = written(order.select(F.col("doc_id").alias(id_), F.col("position").alias(at)), "mixture")
    limit = F.lit(order.where(F.col(at).isNotNull()).count() * keep)
    placed = docs.join(order, F.col("doc_id") == F.col(id_), "left").where((F.col(at) < limit) | F.col(at).isNull())
    n = shuffle_partitions(docs.sparkSession)
    return placed.repartitionByRange(n, F.asc_nulls_last(at)).sortWithinPartitions(F.asc_nulls_last(at)).drop(id_, at)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))
