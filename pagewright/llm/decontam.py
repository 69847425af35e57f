"""Benchmark decontamination with a hash set of normalised n-grams, in DataFrame operations only.

Words are runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased. A window is N
consecutive words of a benchmark item; an item of fewer words (not none) is one window. Each position
of a training document probes the set of window hashes, a hit is verified against the window's words,
and every word inside a verified window is hit.

The hash set is broadcast while its measured size is at most BROADCAST_BYTES. Beyond it places and hashes (no
words) are joined to it by a shuffle, and what meets is joined to its document again. Null texts have no words. Rows with equal doc_id and text get equal results and
are all returned; null doc_ids take part. Texts of any length are scanned whole. Benchmark rows that repeat count once per item_id; null
item_ids are named "". An empty benchmark hits nothing; no documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm._common import fresh, table, written

N = 13
BROADCAST_BYTES = 32 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else kept; lower() does it alone where each character is one byte."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(key, size, gram, items): each distinct window with the sorted item ids that hold it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    items = items.where("size(w) > 0").withColumn("size", F.least(F.size("w"), F.lit(n)))
    at = items.withColumn("i", F.explode(F.expr("sequence(1, size(w) - size + 1)")))
    grams = at.select("item", "size", F.expr("slice(w, i, size)").alias("g"))
    keyed = grams.select("item", "size", F.xxhash64("size", "g").alias("key"), F.array_join("g", " ").alias("gram"))
    return keyed.groupBy("key", "size", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _broadcastable(grams: DataFrame) -> bool:
    items = F.expr("aggregate(items, 0L, (s, x) -> s + octet_length(x) + 24)")
    return (grams.agg(F.sum(F.octet_length("gram") + 128 + items)).first()[0] or 0) <= BROADCAST_BYTES


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_words, spans, item_sets, copies): one row for each distinct (doc_id, text)."""
    grams = written(windows(benchmark, n), "decontam-grams")
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # at most n values
    base = docs.select("doc_id", F.xxhash64("text").alias("dk"), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    # position 0 stands for the document itself, so one scan gives documents and hits
    steps = base.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n_words") * len(sizes))))
    pos = F.when(F.col("step") > 0, F.floor((F.col("step") - 1) / max(1, len(sizes))).cast("int") + 1).otherwise(0) if len(sizes) != 1 else F.col("step")
    size = F.lit(sizes[0]) if len(sizes) == 1 else F.element_at(F.array(*map(F.lit, sizes or [1])), F.pmod(F.col("step") - 1, F.lit(max(1, len(sizes)))).cast("int") + 1)
    probe = steps.select("doc_id", "dk", "n_words", "w", pos.alias("pos"), size.alias("len"))
    gram = F.expr("slice(w, pos, len)")
    probe = probe.withColumn("h", F.when((F.col("pos") > 0) & (F.col("pos") + F.col("len") - 1 <= F.col("n_words")), F.xxhash64("len", gram)))
    verified = (F.col("h") == F.col("key")) & (F.col("len") == F.col("size"))
    same = (F.col("pos") > 0) & (F.array_join(F.slice("w", F.greatest("pos", F.lit(1)), F.col("len")), " ") == F.col("gram"))
    out = ["doc_id", "dk", "n_words", "pos", "len", "items"]
    if _broadcastable(grams):
        rows = probe.join(F.broadcast(grams), verified, "left").where((F.col("pos") == 0) | same).select(out)
    else:
        # only (document, place, hash) is dealt by hash; what meets is brought back to the words and verified there
        met = probe.where("h is not null").select("doc_id", "dk", "pos", "len", "h").join(grams, verified).select("doc_id", "dk", "pos", "len", "gram", "items").distinct()
        once = base.dropDuplicates(["doc_id", "dk"]).select(F.col("doc_id").alias("d"), F.col("dk").alias("k"), "n_words", "w")
        back = met.join(once, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("dk").eqNullSafe(F.col("k")))
        rows = probe.where("pos = 0").select(*out[:5], F.lit(None).cast("array<string>").alias("items")).union(back.where(same).select(out))
    hit = F.when(F.col("pos") > 0, F.struct("pos", "len"))
    return rows.groupBy("doc_id", "dk").agg(
        F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(hit)).alias("spans"), F.collect_set("items").alias("item_sets"), F.count_if(F.col("pos") == 0).alias("copies")
    )


def decisions(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, dk, n_words, n_hit, spans, items, contaminated): one row for each row of docs.

    A document is contaminated if words are hit and they make a twentieth of its words or more.
    """
    found = scan(docs, benchmark, n)
    covered = F.expr("aggregate(spans, named_struct('end', 0, 'hit', 0), (a, x) -> named_struct('end', greatest(a.end, x.pos + x.len - 1), 'hit', a.hit + greatest(0, x.pos + x.len - 1 - greatest(a.end, x.pos - 1)))).hit")
    found = found.withColumn("n_hit", covered).withColumn("items", F.sort_array(F.array_distinct(F.flatten("item_sets"))))
    found = found.withColumn("contaminated", F.expr("n_hit > 0 and 20L * n_hit >= n_words"))
    return found.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copy", "copies", "item_sets")


def _keyed(docs: DataFrame, found: DataFrame, how: str, *more: str) -> DataFrame:
    """docs joined to found(doc_id, dk, ...) by doc_id and text; `more` of found's columns come along under names that docs lacks."""
    key, d, k, *names = fresh(docs, "key", "d", "k", *more)
    found = found.select(F.col("doc_id").alias(d), F.col("dk").alias(k), *(F.col(c).alias(n) for c, n in zip(more, names, strict=True))).distinct()
    return docs.withColumn(key, F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(k)), how).select(*docs.columns, *names)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs without the contaminated documents; all others are kept whole, null doc_ids included."""
    return _keyed(docs, decisions(docs, benchmark, n).where("contaminated"), "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs with a column clean_text: the words outside of hits, lower-cased and joined by spaces; null texts stay null. A column of that
    name is replaced, others may have any name."""
    docs = docs.drop("clean_text")
    (spans,) = fresh(docs, "spans")
    kept = F.filter(F.transform(words(F.col("text")), lambda w, i: F.when(~F.exists(spans, lambda s: (s["pos"] <= i + 1) & (i + 1 < s["pos"] + s["len"])), w)), lambda w: w.isNotNull())
    out = _keyed(docs, decisions(docs, benchmark, n), "inner", "spans")
    return out.withColumn("clean_text", F.when(F.col("text").isNotNull(), F.array_join(kept, " "))).drop(spans)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",")
    return out.select("doc_id", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
grams as (select distinct item, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as g from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from items where len(w) > 0)),
sizes as (select distinct n from grams),
placed as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)),
hits as (select doc_id, i, placed.n, item from placed join grams on placed.g = grams.g and placed.n = grams.n),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs d left join hit using (doc_id) left join named using (doc_id)
"""
