"""Validation, merging, library and analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import analytics as A
from pagewright.operators import library as L
from pagewright.operators import merge, rules
from pagewright.plans import ORACLES, query
from pagewright.plans import inputs as I
from pagewright.plans.books import FILENAME, RESOLVED, entries

DRAFT = """o as (select p_brand as book_id, cast(p_partkey % 23 as int) as sno, case when p_partkey % 17 = 0 then ' ' else p_name end as title, case when p_partkey % 13 = 0 then 'odd' else 'section' end as kind,
case when p_partkey % 10 <> 9 then p_size - 1 end as printed, p_size as physical, case when p_partkey % 2 = 0 then p_size - 1 end as pdf_index, case when p_partkey % 4 = 1 then 'ix' end as label,
p_partkey % 3 <> 0 as include, p_partkey % 19 <> 0 as allow_extraction, p_partkey as pos from part),
books as (select p_brand as book_id, 45 as page_count from part group by 1)"""


def _draft(spark, d):
    k = F.col("p_partkey")
    part = I.table(spark, d, "part")
    o = part.select(
        F.col("p_brand").alias("book_id"), (k % 23).cast("int").alias("sno"), F.when(k % 17 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.when(k % 13 == 0, "odd").otherwise("section").alias("kind"),
        F.when(k % 10 != 9, F.col("p_size") - 1).alias("printed"), F.col("p_size").alias("physical"), F.when(k % 2 == 0, F.col("p_size") - 1).alias("pdf_index"), F.when(k % 4 == 1, "ix").alias("label"),
        (k % 3 != 0).alias("include"), (k % 19 != 0).alias("allow_extraction"), k.alias("pos"),
    )
    return o, part.select(F.col("p_brand").alias("book_id")).distinct().withColumn("page_count", F.lit(45))


def _passed(code, among="i where severity = 'blocking'"):
    return f"select book_id, 'passed' as severity, '{code}' as code, null as key from books where book_id not in (select book_id from {among})"


OUTLINE_FOUND = """select distinct book_id, 'blocking' as severity, 'duplicate_sno' as code, cast(sno as varchar) as key from (select *, count(*) over (partition by book_id, sno) as n from o) where n > 1
union all select book_id, 'blocking', 'empty_outline', null from books where book_id not in (select book_id from inc)
union all select book_id, 'blocking', 'empty_title', cast(sno as varchar) from inc where trim(title) = ''
union all select book_id, 'blocking', 'invalid_printed_start', cast(sno as varchar) from inc where coalesce(printed, 0) < 1 and label is null and pdf_index is null
union all select book_id, 'warning', 'unknown_kind', cast(sno as varchar) from inc where kind = 'odd'
union all select book_id, 'blocking', 'boundary_not_extraction_enabled', cast(sno as varchar) from inc where not allow_extraction
union all select book_id, 'blocking', 'physical_out_of_range', cast(sno as varchar) from inc where physical > 45"""


@query("issues_outline", f"with {DRAFT}, inc as (select * from o where include), i as ({OUTLINE_FOUND}) select * from i union all {_passed('outline_valid', 'i')}")
def issues_outline(spark, d):
    return rules.outline_issues(*_draft(spark, d))


@query("issues_mapping", f"""with {RESOLVED}, books as (select book_id, max(page) as page_count from pages group by 1), i as (
select book_id, 'blocking' as severity, 'two_anchors_required' as code, cast(null as varchar) as key from books where (select count(*) from anchors a where a.book_id = books.book_id and not exception) < 2
union all select book_id, 'blocking', 'anchor_out_of_range', printed || ':' || physical from anchors join books using (book_id) where physical > page_count
union all select book_id, 'blocking', 'offset_conflict', cast(printed as varchar) from anchors where not exception group by book_id, printed having count(distinct physical) > 1
union all select book_id, 'warning', 'segment_unconfirmed', cast(printed_start as varchar) from segments where not confirmed
union all select book_id, 'blocking', 'offset_unresolved', null from books where book_id not in (select book_id from segments where confirmed union all select book_id from anchors where exception)
union all select book_id, 'blocking', 'uncovered_entry', cast(sno as varchar) from resolved where physical is null)
select * from i union all {_passed("mapping_valid")}""")
def issues_mapping(spark, d):
    books = I.pages(spark, d).groupBy("book_id").agg(F.max("page").alias("page_count"))
    return rules.mapping_issues(I.anchors(spark, d), entries(spark, d), books)


# Anchors of the draft's books: (1, 2) and (30, 31), but every third book has the first alone.
STATE = r"""ranked as (select *, cast(regexp_extract(book_id, '(\d+)', 1) as int) as k from books), state as (select book_id, k, k % 5 <> 0 as present, k % 4 <> 0 as hash_ok, k % 7 <> 0 as outline_approved, k % 6 <> 1 as approval_pdf_ok, k % 9 <> 1 as approval_outline_ok, k % 3 <> 0 as mapping_approved from ranked)"""
PREFLIGHT = f"""{DRAFT}, {STATE}, have as (select * from state where present), inc as (select o.*, k % 3 = 0 as lone from o join have using (book_id) where include),
placed as (select *, case when pdf_index is not null then physical when printed is null then physical when not lone then printed + 1 when printed = 1 then 2 end as page, pdf_index is not null as brought from inc),
need as (select distinct book_id from placed where printed <> 0 and not brought), lone as (select book_id from have where k % 3 = 0)"""


@query("issue_sources", f"""with {I.ANCHORS}, {I.SEGMENTS}, i as ({ORACLES["issues_mapping"]}), pairs as (select book_id, printed || ':' || physical as key, true as pair, printed, physical from anchors
union select book_id, cast(printed as varchar), false, printed, physical from anchors where not exception),
near as (select book_id, key, pair, count(*) as anchors, string_agg(physical, ',' order by physical) as pages from pairs group by 1, 2, 3), k as (select *, case when code in ('invalid_anchor', 'index_mismatch', 'anchor_out_of_range') then true when code in ('offset_conflict', 'segment_unconfirmed') then false end as pair from i)
select k.book_id, severity, code, k.key, cast(coalesce(anchors, 0) as int) as anchors, coalesce(pages, '') as pages, (select min(segment) from segments s where s.book_id = k.book_id and not k.pair and try_cast(k.key as int) between s.printed_start and s.printed_end) as segment,
case when code = 'uncovered_entry' then cast(k.key as int) end as entry from k left join near on near.book_id = k.book_id and near.key = k.key and near.pair = k.pair""")
def issue_sources(spark, d):
    """Findings on the mapping with the anchors, segment and entry that each speaks of."""
    got = rules.issue_sources(issues_mapping(spark, d), I.anchors(spark, d))
    pages = F.array_join(F.transform("anchors", lambda a: a["physical"].cast("string")), ",")
    return got.select("book_id", "severity", "code", "key", F.size("anchors").alias("anchors"), pages.alias("pages"), "segment", "entry")


@query("issues_preflight", f"""with {PREFLIGHT}, i as (
select book_id, 'blocking' as severity, 'pdf_missing' as code, cast(null as varchar) as key from state where not present
union all select book_id, 'blocking', 'registered_hash_mismatch', null from have where not hash_ok
union all select book_id, 'blocking', 'outline_not_approved', null from have where not outline_approved
union all select book_id, 'blocking', 'approval_pdf_mismatch', null from have where outline_approved and not approval_pdf_ok
union all select book_id, 'blocking', 'outline_hash_mismatch', null from have where outline_approved and not approval_outline_ok
union all select * from ({OUTLINE_FOUND}) where book_id in (select book_id from have)
union all select book_id, 'blocking', unnest(['two_anchors_required', 'offset_unresolved']), null from lone where book_id in (select book_id from need)
union all select book_id, 'warning', 'segment_unconfirmed', '1' from lone
union all select book_id, 'blocking', 'uncovered_entry', cast(sno as varchar) from placed where page is null and printed <> 0
union all select book_id, 'blocking', 'mapping_not_approved', null from have where not mapping_approved
union all select book_id, 'blocking', 'mapped_page_invalid', cast(sno as varchar) from placed where not coalesce(page between 1 and 45, false)
union all select book_id, 'blocking', 'non_monotonic_physical', cast(sno as varchar) from (select *, lag(page) over (partition by book_id order by pos) as b from placed where page between 1 and 45) where page < b
union all select book_id, 'blocking', 'filename_collision', {FILENAME.format("title", "sno")} as f from inc group by book_id, f having count(*) > 1)
select * from i union all {_passed("preflight_passed", "i")}""")
def issues_preflight(spark, d):
    o, books = _draft(spark, d)
    k = F.col("k")
    ranked = books.withColumn("k", F.regexp_extract("book_id", r"(\d+)", 1).cast("int"))
    state = ranked.select("book_id", (k % 5 != 0).alias("present"), (k % 4 != 0).alias("hash_ok"), (k % 7 != 0).alias("outline_approved"), (k % 6 != 1).alias("approval_pdf_ok"), (k % 9 != 1).alias("approval_outline_ok"), (k % 3 != 0).alias("mapping_approved"))
    printed = F.explode(F.when(k % 3 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(30))))
    anchors = ranked.select("book_id", printed.alias("printed")).select("book_id", "printed", (F.col("printed") + 1).alias("physical"), F.col("printed").alias("pdf_index"), F.lit(False).alias("exception"))
    return rules.preflight_issues(o, anchors, books, state)


MERGE = """draft as (select p_brand as book_id, p_partkey as pos, cast(p_partkey as int) as sno, p_name as title, 'section' as kind, 1 as level, p_size as printed from part where p_partkey % 16 < 8),
cand as (select p_brand as book_id, p_partkey as pos, case when p_partkey % 4 = 0 then cast(p_partkey - 8 as int) end as sno, case when p_partkey % 5 = 0 then p_name || ' two' else p_name end as title,
'section' as kind, 1 as level, case when p_partkey % 2 = 0 then p_size else p_size + 100 end as printed, p_partkey % 9 <> 0 as include, p_partkey % 4 = 0 as sno_explicit from part where p_partkey % 16 >= 8)"""


def _merge_inputs(spark, d):
    """Draft and candidates: all of part."""
    k = F.col("p_partkey")
    part = I.table(spark, d, "part").select(F.col("p_brand").alias("book_id"), k.alias("pos"), "p_name", "p_size", "p_partkey")
    draft = part.where(k % 16 < 8).select("book_id", "pos", k.cast("int").alias("sno"), F.col("p_name").alias("title"), F.lit("section").alias("kind"), F.lit(1).alias("level"), F.col("p_size").alias("printed"))
    cand = part.where(k % 16 >= 8).select(
        "book_id", "pos", F.when(k % 4 == 0, (k - 8).cast("int")).alias("sno"), F.when(k % 5 == 0, F.concat("p_name", F.lit(" two"))).otherwise(F.col("p_name")).alias("title"), F.lit("section").alias("kind"),
        F.lit(1).alias("level"), F.when(k % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 100).alias("printed"), (k % 9 != 0).alias("include"), (k % 4 == 0).alias("sno_explicit"),
    )
    return draft, cand


@query("merge_exact", f"""with {MERGE}, k as (select *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as key from draft), c as (select *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) as key from cand),
t as (select book_id, key, min_by(sno, pos) as t, min_by(printed, pos) as tp from k group by 1, 2), p as (select book_id, printed, min_by(sno, pos) as p from k group by 1, 2), s as (select book_id, sno, min_by(sno, pos) as s from k group by 1, 2)
select c.book_id, c.pos, c.sno, c.title, c.kind, c.level, c.printed, case when not include then 'ignored' when t is not null and tp = c.printed then 'match' when t is not null or p is not null or (sno_explicit and s is not null) then 'conflict' else 'new' end as category,
case when not include then 'excluded' when t is not null then 'same_title' when p is not null then 'same_page' when sno_explicit and s is not null then 'same_sno' else 'new' end as reason,
case when not include then null when t is not null then t when p is not null then p when sno_explicit then s end as draft_sno
from c left join t using (book_id, key) left join p using (book_id, printed) left join s on s.book_id = c.book_id and s.sno = c.sno""")
def merge_exact(spark, d):
    return merge.analyse(*_merge_inputs(spark, d), fuzzy=False)


@query("merge_fuzzy")
def merge_fuzzy(spark, d):
    return merge.analyse(*_merge_inputs(spark, d))


@query("merge_apply")
def merge_apply(spark, d):
    """Of the conflicts a third each is replaced, kept beside the draft and left."""
    draft, cand = _merge_inputs(spark, d)
    found = merge.analyse(draft, cand)
    action = F.when(F.col("pos") % 3 == 0, "use_candidate").when(F.col("pos") % 3 == 1, "keep_both").otherwise("keep_draft")
    return merge.apply(draft, found, found.where("category = 'conflict'").select("book_id", "pos", action.alias("action")))


FILES = "files as (select doc_id as name, sha256(coalesce(text, '')) as source_hash, 'book-' || left(sha256(coalesce(text, '')), 16) as book_id, cast(strlen(coalesce(text, '')) as int) as size_bytes from documents)"


def _files(spark, d):
    return L.identified(I.table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("content")))


@query("book_identity", f"with {FILES} select * from files")
def book_identity(spark, d):
    return _files(spark, d)


@query("duplicate_books", f"with {FILES} select name, book_id, first_name, copies from files join (select source_hash, min(name) as first_name, count(*) as copies from files group by 1 having count(*) > 1) using (source_hash)")
def duplicate_books(spark, d):
    return L.duplicates(_files(spark, d))


@query("new_books", f"with {FILES}, known as (select distinct book_id from files where name % 3 = 0) select book_id, source_hash, size_bytes, min(name) as name from files where book_id not in (select book_id from known) group by 1, 2, 3")
def new_books(spark, d):
    f = _files(spark, d)
    return L.new_files(f, f.where("name % 3 = 0"))


RUNS = "runs as (select o_custkey as book_id, 'run-' || o_orderkey as run_id, o_orderdate as started_at, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status from orders)"


def _runs(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return I.table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderdate").alias("started_at"), status.alias("status"))


@query("latest_run", f"with {RUNS} select book_id, run_id, started_at, status, runs from (select *, row_number() over (partition by book_id order by started_at desc, run_id desc) as k, count(*) over (partition by book_id) as runs from runs) where k = 1")
def latest_run(spark, d):
    return L.latest_runs(_runs(spark, d))


@query("default_run", f"""with {RUNS}, s as (select book_id, min(run_id) as named from runs where book_id % 3 = 0 group by 1)
select book_id, coalesce(max(run_id) filter (where run_id = named), max_by(run_id, (started_at, run_id))) as run_id from runs left join s using (book_id) where status = 'completed' group by 1""")
def default_run(spark, d):
    runs = _runs(spark, d)
    return L.default_run(runs, runs.where("book_id % 3 = 0").groupBy("book_id").agg(F.min("run_id").alias("run_id")))


@query("history_labels", f"with {RUNS}, books as (select c_custkey as book_id, case when c_acctbal >= 0 then c_name end as filename from customer) select run_id, r.book_id, status, coalesce(filename, cast(r.book_id as varchar)) as label from runs r left join books b using (book_id)")
def history_labels(spark, d):
    books = I.table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.expr("case when c_acctbal >= 0 then c_name end").alias("filename"))
    return L.labels(_runs(spark, d), books)


@query("run_times", """with r as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00' as started, case when o_orderkey % 7 > 0 then strftime(o_orderdate, '%Y-%m-%d') || 'T10:0' || (o_orderkey % 4) || ':' || lpad(cast(o_orderkey % 60 as varchar), 2, '0') end as completed from orders)
select o_orderkey, replace(started, 'T', ' ') as started, case when completed is null then '—' when o_orderkey % 4 > 0 then (o_orderkey % 4) || 'm ' || (o_orderkey % 60) || 's' else (o_orderkey % 60) || 's' end as took from r""")
def run_times(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    started = F.concat(day, F.lit("T10:00:00"))
    completed = F.when(k % 7 > 0, F.concat(day, F.format_string("T10:%02d:%02d", k % 4, k % 60)))
    return I.table(spark, d, "orders").select("o_orderkey", L.shown_time(started).alias("started"), L.elapsed(started, completed).alias("took"))


@query("library_lifecycle", f"""with {RUNS}, facts as (select c_custkey as book_id, c_custkey % 2 = 0 as d, c_custkey % 4 = 0 as o, c_custkey % 8 = 0 as m, (select count(*) from runs r where r.book_id = c_custkey and status = 'completed') as n from customer)
select book_id, case when n > 0 then 'extracted' when m then 'mapped' when o then 'outlined' when d then 'drafted' else 'registered' end as state,
case when n > 0 then 'browse' when m then 'extract' when o then 'map pages' when d then 'review outline' else 'build outline' end as next_action from facts""")
def library_lifecycle(spark, d):
    books = I.table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"))
    runs = _runs(spark, d).where("status = 'completed'").groupBy("book_id").agg(F.count("*").alias("completed_runs"))
    k = F.col("book_id")
    return L.lifecycle(books, books.select(k, (k % 2 == 0).alias("has_draft"), (k % 4 == 0).alias("outline_approved"), (k % 8 == 0).alias("mapping_approved")).join(runs, "book_id", "left"))


def _paragraphs(spark, d):
    docs = I.table(spark, d, "documents").select(F.col("source").alias("chapter"), "doc_id", "text")
    return A.chapter_paragraphs(docs).where(F.col("word_count") >= A.MIN_WORDS)


PARAGRAPHS = r"""lines as (select source as chapter, doc_id, unnest(string_split(text, E'\n')) as text from documents), paras as (select chapter, doc_id, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as word_count from lines where trim(text) <> ''),
kept as (select * from paras where word_count >= 8)"""


@query("paragraph_split", f"with {PARAGRAPHS} select chapter, doc_id, count(*) as paragraphs, cast(sum(word_count) as bigint) as words from kept group by 1, 2")
def paragraph_split(spark, d):
    return _paragraphs(spark, d).groupBy("chapter", "doc_id").agg(F.count("*").alias("paragraphs"), F.sum("word_count").alias("words"))


@query("chapter_overview", f"with {PARAGRAPHS} select chapter, count(*) as n_paragraphs, cast(sum(word_count) as bigint) as n_words, round(avg(word_count), 6) as avg_words_per_para from kept group by 1")
def chapter_overview(spark, d):
    return A.chapter_overview(_paragraphs(spark, d)).withColumn("avg_words_per_para", F.round("avg_words_per_para", 6))


@query("clean_text", r"""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[–—-]', ' ', 'g'), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'))) as digest from documents""")
def clean_text(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text")).cast("binary")).alias("digest"))


WORDS = "words as (select source as book_id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}') as w from documents)"


def _words(spark, d):
    return I.table(spark, d, "documents").select(F.col("source").alias("book_id"), "doc_id", A.tokens(F.col("text")).alias("w"))


@query("ngram_counts", f"with {WORDS}, g as (select book_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as term from words where len(w) >= 2) select book_id, term, count(*) as n from g group by 1, 2 having count(*) >= 3")
def ngram_counts(spark, d):
    return _words(spark, d).select("book_id", F.explode(A.ngrams(F.col("w"), 2, 2)).alias("term")).groupBy("book_id", "term").agg(F.count("*").alias("n")).where("n >= 3")


TFIDF = f"""{WORDS}, t as (select book_id, doc_id, unnest(w) as term from words union all select book_id, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words where len(w) >= 2
union all select book_id, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words where len(w) >= 3),
tf as (select book_id, doc_id, term, count(*) as tf from t group by all), n as (select book_id, count(*) as n from words group by 1), df as (select book_id, term, count(*) as df from tf group by 1, 2 having count(*) >= 2),
w as (select tf.book_id, doc_id, tf.term, tf * (ln((1.0::double + n) / (1.0::double + df)) + 1) as w, n from tf join df using (book_id, term) join n on n.book_id = tf.book_id),
norm as (select book_id, doc_id, sqrt(sum(w * w)) as norm from w group by 1, 2), m as (select w.book_id, term, round(sum(w / norm) / max(n), 9) as score from w join norm using (book_id, doc_id) group by 1, 2),
top as (select *, row_number() over (partition by book_id order by score desc, term) as place from m qualify place <= 25)"""


def _terms(spark, d):
    return A.tfidf_top(_words(spark, d), "book_id", "doc_id", "w")


@query("tfidf_top_terms", f"with {TFIDF} select book_id, term, round(score, 6) as score, cast(place as int) as place from top")
def tfidf_top_terms(spark, d):
    return _terms(spark, d).withColumn("score", F.round("score", 6))


@query("chapter_summary", f"with {TFIDF} select book_id, string_agg(term, ', ' order by place) as summary from top where place <= 5 group by 1")
def chapter_summary(spark, d):
    return A.summaries(_terms(spark, d), "book_id")


@query("canonical_hash", """select o_orderkey, sha256('{"custkey":' || o_custkey || ',"note":null,"status":"' || o_orderstatus || '"}') as h from orders""")
def canonical_hash(spark, d):
    doc = F.struct(F.col("o_custkey").alias("custkey"), F.lit(None).cast("string").alias("note"), F.col("o_orderstatus").alias("status"))
    return I.table(spark, d, "orders").select("o_orderkey", F.sha2(F.to_json(doc, {"ignoreNullFields": "false"}).cast("binary"), 256).alias("h"))


ADJECTIVES = ("the", "and", "that")
PHRASES = rf"""{PARAGRAPHS}, numbered as (select *, row_number() over () as unit, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') as w from kept),
grams as (select chapter, unit, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) as g from numbered where len(w) >= 2 union all select chapter, unit, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) from numbered where len(w) >= 3),
p as (select chapter, unit, array_to_string(g, ' ') as term from grams where g[-1] not in ('the', 'and', 'that') and len(list_filter(g, lambda x: length(x) < 4)) = 0)"""


@query("compound_terms", f"with {PHRASES}, c as (select chapter, term, count(*) as n from p group by 1, 2) select * from c qualify n >= 2 or max(n) over (partition by chapter) < 2")
def compound_terms(spark, d):
    return A.compound_terms(_paragraphs(spark, d), ADJECTIVES)


@query("compound_tfidf", f"""with {PHRASES}, tf as (select chapter, unit, term, count(*) as tf from p group by all), n as (select chapter, count(*) as n from numbered group by 1), v as (select term from p group by 1 having count(*) >= 2),
df as (select chapter, term, count(*) as df from tf where term in (select term from v) or not exists (select * from v) group by 1, 2),
w as (select tf.chapter, unit, tf.term, tf * (ln((1.0::double + n) / (1.0::double + df)) + 1) as w, n from tf join df using (chapter, term) join n on n.chapter = tf.chapter),
norm as (select chapter, unit, sqrt(sum(w * w)) as norm from w group by 1, 2), m as (select w.chapter, term, round(sum(w / norm) / max(n), 9) as score from w join norm using (chapter, unit) group by 1, 2)
select chapter, term, round(score, 6) as score, cast(row_number() over (partition by chapter order by score desc, term) as int) as place from m qualify place <= 25""")
def compound_tfidf(spark, d):
    paras = _paragraphs(spark, d).withColumn("unit", F.struct("doc_id", "para_id"))
    return A.compound_tfidf(paras, ADJECTIVES).withColumn("score", F.round("score", 6))


def _units(spark, d):
    return _paragraphs(spark, d).withColumn("unit", F.struct("doc_id", "para_id"))


@query("topics")
def topics(spark, d):
    return A.chapter_topics(_units(spark, d), ADJECTIVES)


@query("compound_summary")
def compound_summary(spark, d):
    """Titles, the first phrases and the topics of each chapter."""
    units = _units(spark, d)
    chapters = I.table(spark, d, "documents").select(F.col("source").alias("chapter")).distinct().withColumn("title", F.concat(F.lit("On "), "chapter"))
    return A.compound_summaries(chapters, *A.terms_and_topics(units, ADJECTIVES))


# Each run of seven letters is split, so that most splits stand in words that the documents hold whole somewhere.
SPLITS = ("([a-z]{4})([a-z]{3})", "- ")
KEPT = ", ".join(f"'{x}'" for x in A.KEEP_HYPHENS)


@query("word_scores", """with w as (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) select word, count(*) as n, round(log10(count(*) * 1e9 / (select count(*) from w)), 9) as zipf from w group by 1""")
def word_scores(spark, d):
    return A.word_scores(I.table(spark, d, "documents")).withColumn("zipf", F.round("zipf", 9))


@query("dehyphenate", rf"""with words as (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents), v as (select word from words group by 1 having log10(count(*) * 1e9 / (select count(*) from words)) >= 3.0),
t as (select doc_id, regexp_replace(regexp_replace(replace(text, chr(173), ''), '{SPLITS[0]}', '\1{SPLITS[1]}\2', 'g'), '([À-ɏ])', '_\1_', 'g') as t from documents),
m as (select doc_id, t, regexp_extract_all(t, '\b[A-Za-z]{{2,}}- +[A-Za-z]{{2,}}\b') as m, string_split_regex(t, '\b[A-Za-z]{{2,}}- +[A-Za-z]{{2,}}\b') as b from t),
e as (select doc_id, unnest(range(1, len(b) + 1)) as i, unnest(b) as b, unnest(list_concat(m, [''])) as m from m),
j as (select *, regexp_replace(m, '- +', '') as whole, lower(regexp_replace(m, '- +', '-')) as pair from e),
k as (select doc_id, i, b || case when v.word is not null and pair not in ({KEPT}) then whole else m end as s from j left join v on v.word = lower(whole))
select d.doc_id, regexp_replace(regexp_replace(s, '-\s+\b', '- ', 'g'), '_([À-ɏ])_', '\1', 'g') as text from documents d left join (select doc_id, string_agg(s, '' order by i) as s from k group by 1) using (doc_id)""")
def dehyphenate(spark, d):
    """Split words joined where the documents' own vocabulary makes the whole probable."""
    docs = I.table(spark, d, "documents").select("doc_id", "text")
    split = docs.withColumn("text", F.regexp_replace("text", SPLITS[0], f"$1{SPLITS[1]}$2"))
    return A.dehyphenated(split, "text", A.word_scores(docs))


@query("wrap_chunks")
def wrap_chunks(spark, d):
    return A.wrapped(I.table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")
