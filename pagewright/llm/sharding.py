"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame operations only.

1. Permute locally: each partition of the input is sorted by random numbers and its rows get their places.
   The rows are written, which fixes partitions and places.
2. Draw the matrix: how many rows each partition sends to each shard, given its rows and the sizes of
   the shards (law `rows`: counts at most one apart). In a uniform shuffle these counts follow the multivariate hypergeometric
   distribution. A tree over the partitions draws them: a node knows what its partitions send to
   each shard in all; its left half's share is drawn shard by shard, the right half sends the rest. All
   nodes of a level are drawn at once, so P partitions take log2(P) steps over P rows of one number a shard.
3. Exchange: places up to the first count go to shard 0, the next to shard 1, and so on.
4. Permute again: in a shard rows are ordered by a hash of (seed, partition, place). Pieces of a shard are numbered apart
   and shifted by the rows before them, so no task holds a shard.

Every draw inverts the distribution, summed outwards from its mode to SPREAD standard deviations, where what is
left is below the rounding of a double. The same files, settings and seed give the same result. Equal
rows are different rows here and may go to different shards. No column's value is read for the shuffle: nulls,
repeated rows and ids, and texts of any length are moved like others. Columns named shard or slot
are replaced, others may have any name. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm._common import fresh, shuffle_partitions, table, written

SHARDS = 8
SPREAD = 12
PIECE_ROWS = 1 << 18
"""Rows of a shard that are numbered in one task, about."""


def uniform(*key: str) -> str:
    """SQL of a number within (0, 1) that the key decides."""
    return f"((shiftrightunsigned(xxhash64({', '.join(key)}), 11) + 0.5D) / 9007199254740992D)"


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL of an exact draw: how many of `drawn` rows out of `total` are among the `good` ones; u decides, within (0, 1)."""
    let = lambda fields, body: f"transform(array({fields}), a -> {body})[0]"  # noqa: E731 - names a value once
    up = "(x.w * (a.k - j + 1D) * (a.n - j + 1D) / (j * (a.t - a.k - a.n + j + 0D)))"
    down = "(x.w * (j + 1D) * (a.t - a.k - a.n + j + 1D) / ((a.k - j + 0D) * (a.n - j + 0D)))"
    rise, fall = "if(a.hi > a.mode, sequence(a.mode + 1, a.hi), cast(array() as array<bigint>))", "if(a.lo < a.mode, sequence(a.mode - 1, a.lo), cast(array() as array<bigint>))"
    weight = lambda seq, w: f"aggregate({seq}, named_struct('s', 0D, 'w', 1D), (x, j) -> named_struct('s', x.s + x.w, 'w', {w}), x -> x.s + x.w)"  # noqa: E731 - from the mode's, 1
    walk = lambda seq, w, first, target: (  # noqa: E731 - the first value at which the sum passes the target
        f"aggregate({seq}, named_struct('s', {first}, 'w', 1D, 'v', a.mode), (x, j) -> if({target} < x.s + x.w, x, named_struct('s', x.s + x.w, 'w', {w}, 'v', j)), x -> x.v)"
    )
    pick = let("named_struct('mode', a.mode, 'lo', a.lo, 'hi', a.hi, 'n', a.n, 'k', a.k, 't', a.t, 'above', a.above, 'at', a.u * (a.above + a.below - 1D))",
               f"if(a.at < a.above, {walk(rise, up, '0D', 'a.at')}, {walk(fall, down, '-1D', '(a.at - a.above)')})")
    sums = let(f"named_struct('mode', a.mode, 'lo', a.lo, 'hi', a.hi, 'n', a.n, 'k', a.k, 't', a.t, 'u', a.u, 'above', {weight(rise, up)}, 'below', {weight(fall, down)})", pick)
    near = "cast(ceil({0} * a.sd) as bigint) + 30".format(SPREAD)
    ends = let(f"named_struct('mode', a.mode, 'lo', greatest(a.least, a.mode - ({near})), 'hi', least(a.most, a.mode + ({near})), 'n', a.n, 'k', a.k, 't', a.t, 'u', a.u)", sums)
    mode = "cast(floor((a.n + 1D) * (a.k + 1D) / (a.t + 2D)) as bigint)"
    middle = let(f"named_struct('mode', least(a.most, greatest(a.least, {mode})), 'least', a.least, 'most', a.most, 'n', a.n, 'k', a.k, 't', a.t, 'u', a.u, "
                 "'sd', sqrt(a.n * (a.k / (a.t + 0D)) * (1D - a.k / (a.t + 0D)) * ((a.t - a.n) / greatest(a.t - 1D, 1D))))", ends)  # fmt: skip
    bounds = let("named_struct('least', greatest(0L, a.n - (a.t - a.k)), 'most', least(a.n, a.k), 'n', a.n, 'k', a.k, 't', a.t, 'u', a.u)", f"if(a.least = a.most, a.least, {middle})")
    return let(f"named_struct('n', cast({drawn} as bigint), 'k', cast({good} as bigint), 't', cast({total} as bigint), 'u', {u})", bounds)


def communication(rows: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """rows(part int, n long), one a partition -> (part, takes): takes is the array of the rows that go to each shard."""
    tree = rows.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("of")).where("size(of) > 0")
    size = rows.count()
    total = "aggregate(of, 0L, (s, x) -> s + x.n)"
    tree = tree.select("of", F.expr(f"transform(sequence(0, {shards - 1}), j -> {total} div {shards} + if(j < {total} % {shards}, 1L, 0L))").alias("takes"))
    half = "size(of) div 2"
    draw = hypergeometric("s.t", "takes[j]", "s.n", uniform(f"{seed}", "of[0].part", "of[size(of) - 1].part", "j"))
    left = (
        f"aggregate(sequence(0, {shards - 1}), named_struct('x', cast(array() as array<bigint>), 'n', aggregate(slice(of, 1, {half}), 0L, (s, x) -> s + x.n), 't', {total}), "
        f"(s, j) -> transform(array({draw}), d -> named_struct('x', concat(s.x, array(d)), 'n', s.n - d, 't', s.t - takes[j]))[0], s -> s.x)"
    )
    for level in range((size - 1).bit_length() if size else 0):
        if level == 6:  # by now there are enough nodes to draw them on many executors
            tree = tree.repartition(shuffle_partitions(rows.sparkSession))
        tree = tree.withColumn("left", F.when(F.size("of") > 1, F.expr(left)))
        ends = F.expr(f"if(size(of) = 1, array(named_struct('of', of, 'takes', takes)), array(named_struct('of', slice(of, 1, {half}), 'takes', left), named_struct('of', slice(of, {half} + 1, size(of)), 'takes', zip_with(takes, left, (x, y) -> x - y))))")
        tree = tree.select(F.explode(ends).alias("node")).select("node.of", "node.takes")
    return tree.select(F.expr("of[0].part").alias("part"), "takes")


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """docs with shard (from 0) and slot (its place in the shard, from 0): every order of all rows is equally likely."""
    docs = docs.drop("shard", "slot")
    rand, place, part, at, h, piece, start, n = fresh(docs, "rand", "place", "part", "at", "h", "piece", "start", "n")
    local = docs.withColumn(rand, F.rand(seed)).sortWithinPartitions(rand).drop(rand).withColumn(place, F.monotonically_increasing_id())
    local = written(local, "shard-local")
    own = {part: F.shiftright(place, 33).cast("int"), at: F.col(place).bitwiseAND(F.lit((1 << 33) - 1))}
    counts = written(local.select(own[part].alias("part")).groupBy("part").agg(F.count("*").alias("n")), "shard-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    matrix = written(communication(counts, shards, seed), "shard-matrix")
    ends = "transform(takes, (x, i) -> aggregate(slice(takes, 1, i + 1), 0L, (s, y) -> s + y))"
    of, cuts = fresh(docs, "of", "cuts")
    sent = local.withColumns(own).join(matrix.select(F.col("part").alias(of), F.expr(ends).alias(cuts)), F.col(part) == F.col(of))
    sent = sent.withColumn("shard", F.size(F.filter(cuts, lambda c: c <= F.col(at))))
    bits = max(5, (total // (shards * PIECE_ROWS)).bit_length())
    sent = sent.withColumn(h, F.xxhash64(F.lit(seed), part, at)).withColumn(piece, F.shiftrightunsigned(h, 64 - bits).cast("int")).drop(place, of, cuts)
    held = sent.groupBy("shard", piece).agg(F.count("*").alias(n))
    before = F.sum(n).over(Window.partitionBy("shard").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1))
    shard, own_piece = fresh(docs, "to", "in")
    starts = held.select(F.col("shard").alias(shard), F.col(piece).alias(own_piece), F.coalesce(before, F.lit(0)).alias(start))
    order = F.row_number().over(Window.partitionBy("shard", piece).orderBy(h, part, at)) - 1
    out = sent.withColumn("slot", order).join(starts, (F.col("shard") == F.col(shard)) & (F.col(piece) == F.col(own_piece)))
    return out.withColumn("slot", (F.col("slot") + F.col(start)).cast("long")).select(*docs.columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 0, files: int | None = None) -> None:
    """The shuffled docs as Parquet under path/shard=k, in order of their slots within files of slots that follow one another."""
    out = shuffled(docs, shards, seed)
    n = files or max(shards, shuffle_partitions(docs.sparkSession))
    out.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("string")
    rows = table(spark, sf_dir, "documents").select("doc_id", text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    return shuffled(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
