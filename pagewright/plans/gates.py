"""What a reviewer sees and what may go on: overviews, approvals, gates, help, and outlines and ranges as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import detect as D
from pagewright.operators import mapping as M
from pagewright.operators import rules
from pagewright.plans import ORACLES, corpus, query
from pagewright.plans import inputs as I
from pagewright.plans.books import RESOLVED, entries, physical_rows
from pagewright.plans.detected import LEAVES, _leaves
from pagewright.sources import tables

EVEN = "even as (select book_id from pages group by 1 having max(page) % 2 = 0)"


def _even(spark, d):
    """Books of an even number of pages: those whose mapping counts as approved here."""
    return I.pages(spark, d).groupBy("book_id").agg(F.max("page").alias("n")).where("n % 2 = 0").select("book_id")


@query("mapping_overview", f"""with {RESOLVED}, i as ({ORACLES["issues_mapping"]}), f as (select book_id, count(*) filter (where severity = 'warning') as warnings, count(*) filter (where severity = 'blocking') as blocking from i group by 1),
c as (select book_id, count(*) filter (where confirmed) as confirmed from segments group by 1), r as (select book_id, count(*) as entries, count(physical) as resolved, min(physical) as first_page, max(physical) as last_page from resolved group by 1)
select r.*, coalesce(confirmed, 0) as confirmed, coalesce(warnings, 0) as warnings, coalesce(blocking, 0) as blocking from r left join c using (book_id) left join f using (book_id)""")
def mapping_overview(spark, d):
    return M.overview(M.resolve(entries(spark, d), I.anchors(spark, d)), I.anchors(spark, d), corpus.issues_mapping(spark, d))


@query("mapping_approve", f"""with {I.PAGES}, {EVEN}, i as ({ORACLES["issues_mapping"]}) select book_id, case when book_id in (select book_id from even) then 'already_approved'
when book_id in (select book_id from i where severity = 'blocking') then 'blocked' else 'approved' end as verdict from (select distinct book_id from pages)""")
def mapping_approve(spark, d):
    return rules.approve(I.pages(spark, d).select("book_id").distinct(), corpus.issues_mapping(spark, d), _even(spark, d))


@query("extraction_gate", f"""with {I.PAGES}, {EVEN}, p as ({ORACLES["physical_rows"]}), g as (select book_id, count(*) filter (where physical_start is null or physical_end is null) as open from p group by 1)
select book_id, case when book_id not in (select book_id from even) then 'mapping_not_approved' when open > 0 then 'unresolved_rows' else 'extract' end as verdict from g""")
def extraction_gate(spark, d):
    return rules.extractable(physical_rows(spark, d), _even(spark, d))


@query("issue_actions", f"""with i as ({ORACLES["issues_mapping"]}) select book_id, code, key, case code {" ".join(f"when '{c}' then '{t}'" for c, t in rules.ACTIONS.items())} else '' end as action from i""")
def issue_actions(spark, d):
    return corpus.issues_mapping(spark, d).select("book_id", "code", "key", rules.suggested_action(F.col("code")).alias("action"))


@query("outline_text", f"""with {I.PAGES}, {I.OUTLINE}, l as (select book_id, sno, title || ' | ' || case when sno % 5 = 0 then 'v' when sno % 7 <> 0 then cast(start as varchar) else '' end as line from outline)
select book_id, string_agg(line, E'\\n' order by sno) as value from l group by 1""")
def outline_text(spark, d):
    o = I.outline(I.pages(spark, d))
    rows = o.select("book_id", "sno", "title", F.when(F.col("sno") % 5 == 0, "v").otherwise("").alias("label"), F.when(F.col("sno") % 7 != 0, F.col("start")).alias("printed"))
    return tables.outline_text(rows)


# Each book's first two lines of contents are its seeds; "p_name .... p_size" stands on page 1.
SEEDS = "seeds as (select p_brand as book_id, k as pos, p_name as title, p_size as printed from n where k in (2, 3))"


def _seeds(spark, d):
    n = spark.sql("select p_brand as book_id, cast(row_number() over (partition by p_brand order by p_partkey) as int) as pos, p_name as title, p_size as printed from {part}", part=I.table(spark, d, "part"))
    return n.where("pos in (2, 3)")


@query("inferred_offset", f"""with {LEAVES}, {SEEDS}, f as (select book_id, printed, lower(array_to_string(string_split(title, ' ')[1:2], ' ')) as needle from seeds where pos = 2)
select f.book_id, cast(min(page) - printed as int) as "offset" from f join leaves l on l.book_id = f.book_id and page <= 40 and contains(lower(line), needle) group by f.book_id, printed""")
def inferred_offset(spark, d):
    return D.inferred_offset(_leaves(spark, d), _seeds(spark, d))


@query("range_text", f"""with {LEAVES}, p as (select book_id, page, string_agg(line, E'\\n' order by line_no) as text from leaves group by 1, 2), r as (select distinct book_id, a as start, a + 2 as "end" from p, (values (1), (3)) t(a))
select r.book_id, 'from ' || start as title, start, "end", string_agg(text, E'\\n' order by page) as text from r join p on p.book_id = r.book_id and page between start and "end" group by all""")
def range_text(spark, d):
    leaves = _leaves(spark, d)
    ranges = leaves.select("book_id").distinct().select("book_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("start"))
    ranges = ranges.select("book_id", F.concat(F.lit("from "), F.col("start").cast("string")).alias("title"), "start", (F.col("start") + 2).alias("end"))
    return D.range_text(leaves, ranges)


@query("chosen_chapters")
def chosen_chapters(spark, d):
    """Books with an even number of pages have seeds of their own; the others take their contents, or chapter lines."""
    leaves = _leaves(spark, d)
    even = leaves.groupBy("book_id").agg(F.max("page").alias("n")).where("n % 2 = 0").select("book_id")
    return D.chosen_chapters(leaves, _seeds(spark, d).join(even, "book_id", "left_semi"))
