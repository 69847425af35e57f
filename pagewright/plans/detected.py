"""Outlines found in pages: contents runs, headings, captions, seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import detect as D
from pagewright.plans import inputs as I
from pagewright.plans import query
from pagewright.sources import tables

# Pages made from part: each brand is a book, its rows in order its lines, seven to a page, the first page headed.
LEAVES = r"""n as (select *, cast(row_number() over (partition by p_brand order by p_partkey) as int) as k from part),
leaves as (select p_brand as book_id, cast((k - 1) // 7 + 1 as int) as page, k as line_no, case when k = 1 then 'Contents' when k = 7 and p_partkey % 2 = 0 then 'Chapter ' || p_size
when k < 7 then p_name || ' .... ' || p_size when k % 9 = 0 then '12 Map of ' || p_name else p_name end as line from n)"""


def _leaves(spark, d):
    lines = spark.sql(f"with {LEAVES.replace('//', 'div').replace('from part', 'from {part}')} select * from leaves", part=I.table(spark, d, "part"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("book_id", "page").agg(text.alias("text"))


@query("contents_entries", rf"""with {LEAVES}, e as (select book_id, page, line_no, trim(regexp_extract(line, '^(.+?)\s*\.{{2,}}\s*(\d+)$', 1)) as title, cast(regexp_extract(line, '^(.+?)\s*\.{{2,}}\s*(\d+)$', 2) as int) as start
from leaves where page <= 3 and regexp_matches(line, '\.{{2,}}\s*\d+$')) select book_id, max_by(title, line_no) as title, start from e where length(title) >= 3 group by book_id, lower(title), start""")
def contents_entries(spark, d):
    return D.contents_entries(_leaves(spark, d))


CONTENTS_RUN = r"""c as (select book_id, page, count(*) filter (where regexp_matches(line, '\.{2,}\s*\d+$')) as dotted from leaves where page <= 40 group by 1, 2),
r as (select book_id, page, min(case when dotted >= 4 then 1 else 0 end) over (partition by book_id order by page) as dense from c), run as (select book_id, page from r where dense = 1)"""


@query("contents_run", f"with {LEAVES}, {CONTENTS_RUN} select * from run")
def contents_run(spark, d):
    return D.contents_run(_leaves(spark, d))


# Every book of these leaves that has a run has dotted lines in it, so titles over their numbers never come to be read.
@query("run_entries", rf"""with {LEAVES}, {CONTENTS_RUN}, l as (select leaves.* from leaves join run using (book_id, page)),
e as (select book_id, page, 1 as pass, line_no, trim(regexp_extract(line, '^(.+?)\s*\.{{2,}}\s*(\d{{1,4}})$', 1)) as title, cast(regexp_extract(line, '(\d+)$', 1) as int) as start from l where regexp_matches(line, '^.+?\s*\.{{2,}}\s*\d{{1,4}}$')
union all select book_id, page, 2, line_no, trim(regexp_extract(line, '^(.+?)\s+(\d{{1,4}})$', 1)), cast(regexp_extract(line, '(\d+)$', 1) as int) from l where regexp_matches(line, '^.+?\s+\d{{1,4}}$') and line <> 'Contents'),
k as (select * from e where title <> '' and start >= 1 qualify row_number() over (partition by book_id, lower(title), start order by page, pass, line_no) = 1)
select book_id, title, start, cast(row_number() over (partition by book_id order by page, pass, line_no) as int) as pos from k""")
def run_entries(spark, d):
    leaves = _leaves(spark, d)
    return D.run_entries(leaves, D.contents_run(leaves))


@query("chapters_by_heading", f"""with {LEAVES}, span as (select book_id, max(page) as last from leaves group by 1),
f as (select book_id, page as start, min_by(line, line_no) as title from (select *, row_number() over (partition by book_id, page order by line_no) as h from leaves)
where h <= 6 and regexp_full_match(line, '(?i)chapter\\s+\\d+|\\d+\\s+[a-z].+') group by 1, 2),
e as (select book_id, 1 + k * greatest(1, last // 6) as start, 'Chapter ' || (k + 1) as title from span, range(6) t(k) where book_id not in (select book_id from f)), a as (select * from f union all select * from e)
select book_id, title, cast(start as int) as start, cast(coalesce(lead(start) over (partition by book_id order by start) - 1, last) as int) as "end" from a join span using (book_id)""")
def chapters_by_heading(spark, d):
    leaves = _leaves(spark, d)
    return D.chapters_by_heading(leaves, leaves.groupBy("book_id").agg(F.lit(1).alias("first"), F.max("page").alias("last")))


SEEDS = "seeds as (select p_brand as book_id, p_name as title, p_size as printed from part)"


@query("chapters_from_seeds", f"""with {SEEDS}, a as (select *, greatest(1, least(printed + 2, 45)) as s from seeds), u as (select *, coalesce(lead(s) over (partition by book_id order by s, title, printed) - 1, 45) as until from a)
select book_id, title, printed, greatest(s, 3) as start, least(until, 40) as "end" from u where greatest(s, 3) <= least(until, 40)""")
def chapters_from_seeds(spark, d):
    seeds = I.table(spark, d, "part").select(F.col("p_brand").alias("book_id"), F.col("p_name").alias("title"), F.col("p_size").alias("printed"))
    books = seeds.select("book_id").distinct().select("book_id", *(F.lit(v).alias(c) for c, v in (("page_count", 45), ("offset", 2), ("first", 3), ("last", 40))))
    return D.chapters_from_seeds(seeds, books)


# Lines with a size, a boldness and a place, made from part: each brand is a book of five pages.
SIZED = """sized as (select p_brand as book_id, cast(p_partkey % 5 as int) as page, cast(p_partkey as int) as line_no, case p_partkey % 10 when 0 then 'MAP ' || p_size when 1 then 'Chapter ' || p_size when 2 then cast(p_size as varchar)
when 3 then 'Table ' || p_size || 'b: ' || p_name else p_name end as text, p_partkey * 1.0::double as top, 10.0::double * (p_partkey % 7) as x0, 10.0::double * (p_partkey % 7) + 200 as x1, p_size / 2.0::double as avg_size, p_partkey % 4 / 3.0::double as bold_ratio from part)"""
HEADS = r"""limits as (select book_id, page, greatest(l[cast(floor(0.9::double * (len(l) - 1)) as int) + 1], 12.5::double) as threshold from (select book_id, page, list(avg_size order by avg_size) as l from sized where avg_size > 0 group by 1, 2)),
heads as (select s.*, 1 - least(1, abs((x0 + x1) / 2 - 150) / 150) as centeredness from sized s join limits using (book_id, page)
where regexp_matches(text, '^(MAP|Chapter|Table) ') or avg_size >= threshold or (bold_ratio >= 0.65::double and 1 - least(1, abs((x0 + x1) / 2 - 150) / 150) >= 0.70::double))"""


def _sized(spark, d):
    lines = spark.sql(f"with {SIZED.replace('::double', 'D').replace('varchar', 'string').replace('from part', 'from {part}')} select * from sized", part=I.table(spark, d, "part"))
    return D.heading_lines(lines, lines.select("book_id", "page").distinct().withColumn("width", F.lit(300.0)))


@query("heading_classify", f"with {SIZED}, {HEADS} select book_id, page, line_no, text from heads")
def heading_classify(spark, d):
    return _sized(spark, d).select("book_id", "page", "line_no", "text")


@query("caption_merge", rf"""with {SIZED}, {HEADS}, w as (select *, regexp_matches(text, '^(MAP|Table) ') as caption, not regexp_matches(text, '^((MAP|Table|Chapter) |\d+$)') as free from heads),
x as (select *, coalesce(caption and lead(free) over p, false) as takes, lead(text) over p as next, coalesce(free and lag(caption) over p, false) as taken from w window p as (partition by book_id, page order by top, line_no))
select book_id, page, line_no, case when takes and starts_with(text, 'MAP') then '[MAP] Map ' || substr(text, 5) || ': ' || next when takes then '[TABLE] Table ' || substr(text, 7) else text end as text from x where not taken""")
def caption_merge(spark, d):
    return D.merge_captions(_sized(spark, d)).select("book_id", "page", "line_no", "text")


@query("page_scan", f"""with {LEAVES}, p as (select book_id, page, string_agg(line, E'\\n' order by line_no) as text from leaves group by 1, 2), l as (select book_id, max(page) as last from p group by 1),
s as (select *, case when page <= 12 and regexp_matches(text, '(?i)\\bcontents\\b') then 'toc' when page > last - 12 and contains(lower(text), 'index') then 'index' end as source from p join l using (book_id))
select book_id, page, source, case source when 'toc' then 0.9::double else 0.65::double end as confidence from s where source is not null""")
def page_scan(spark, d):
    return D.scan_pages(_leaves(spark, d)).select("book_id", "page", "source", "confidence")


DETECTED = "rows as (select p_brand as book_id, p_name as title, p_size as start, p_retailprice as y, case when p_partkey % 3 = 0 then 'toc' else 'heading' end as kind, p_size + 2 as \"end\" from part)"


@query("outline_template", f"""with {DETECTED} select book_id, cast(row_number() over (partition by book_id order by start, y, title) as int) as "Sno", title, kind, case when kind = 'toc' then start end as printed_start,
case when kind = 'toc' then "end" end as printed_end, case when kind <> 'toc' then start end as physical_start, case when kind <> 'toc' then "end" end as physical_end from rows""")
def outline_template(spark, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, "toc").otherwise("heading")
    rows = I.table(spark, d, "part").select(F.col("p_brand").alias("book_id"), F.col("p_name").alias("title"), F.col("p_size").alias("start"), F.col("p_retailprice").alias("y"), kind.alias("kind"), (F.col("p_size") + 2).alias("end"))
    return tables.outline_template(rows)
