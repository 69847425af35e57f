"""Pages, outlines, ranges, sections, search, mapping and hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import mapping as M
from pagewright.operators import pages as P
from pagewright.operators import review as R
from pagewright.plans import inputs as I
from pagewright.plans import query

TRIM_TITLE = r"replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '–', '—')"


@query("pages_from_documents", f"with {I.PAGES} select book_id, page, doc_id, length(trim(text)) as chars from pages")
def pages_from_documents(spark, d):
    return I.pages(spark, d).select("book_id", "page", "doc_id", F.length(F.trim("text")).cast("long").alias("chars"))


@query("title_normalize", rf"""with {I.LINES} select pos, {TRIM_TITLE.format("line")} as title, trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')) as merge_key from lines""")
def title_normalize(spark, d):
    return I.lines(spark, d).select("pos", T.normalize_title(F.col("line")).alias("title"), T.merge_key(F.col("line")).alias("merge_key"))


SLUG = "left(coalesce(nullif(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'section'), 80)"
FILENAME = "case when {1} < 1000 then lpad(cast({1} as varchar), 3, '0') else cast({1} as varchar) end || '_' || " + SLUG + " || '.txt'"


@query("slugify_filename", f"with {I.LINES} select pos, {SLUG.format('line')} as slug, {FILENAME.format('line', 'pos')} as filename from lines")
def slugify_filename(spark, d):
    return I.lines(spark, d).select("pos", T.slugify(F.col("line")).alias("slug"), T.section_filename(F.col("pos"), F.col("line")).alias("filename"))


@query("filename_collisions", f"with {I.LINES} select book_id, {FILENAME.format('line', 'pos % 7')} as filename, count(*) as n from lines group by 1, 2 having count(*) > 1")
def filename_collisions(spark, d):
    name = T.section_filename(F.col("pos") % 7, F.col("line"))
    return I.lines(spark, d).groupBy("book_id", name.alias("filename")).agg(F.count("*").alias("n")).where("n > 1")


@query("toc_line_parse", rf"""with {I.LINES}, s as (select pos, trim(regexp_replace(line, '\s+', ' ', 'g')) as l from lines)
select pos, trim(regexp_extract(l, '^(.+?)\s*\.{{2,}}\s*(\d{{1,4}})\s*$', 1)) as title, cast(regexp_extract(l, '^(.+?)\s*\.{{2,}}\s*(\d{{1,4}})\s*$', 2) as int) as page from s
where regexp_matches(l, '^(.+?)\s*\.{{2,}}\s*(\d{{1,4}})\s*$') and length(trim(regexp_extract(l, '^(.+?)\s*\.{{2,}}\s*(\d{{1,4}})\s*$', 1))) >= 3""")
def toc_line_parse(spark, d):
    return I.lines(spark, d).select("pos", T.toc_line(F.col("line")).alias("t")).where("t is not null").select("pos", "t.title", "t.page")


LABEL = "case o_orderkey % 4 when 0 then cast(o_custkey * 997 as varchar) when 1 then 'XIV' when 2 then ' vii ' else 'p. ' || o_custkey end"


@query("page_label_classify", f"""with l as (select o_orderkey, trim({LABEL}) as s from orders) select o_orderkey, case when regexp_full_match(s, '[0-9]{{1,6}}') then cast(s as int) end as page,
case when regexp_full_match(s, '[ivxlcdmIVXLCDM]+') then lower(s) else s end as label,
case when regexp_full_match(s, '[0-9]{{1,6}}') then null when regexp_full_match(s, '[ivxlcdmIVXLCDM]+') then 'roman_page' else 'ambiguous_page' end as code from l""")
def page_label_classify(spark, d):
    label = F.expr("case o_orderkey % 4 when 0 then cast(o_custkey * 997 as string) when 1 then 'XIV' when 2 then ' vii ' else concat('p. ', o_custkey) end")
    return I.table(spark, d, "orders").select("o_orderkey", T.page_label(label).alias("p")).select("o_orderkey", "p.page", "p.label", "p.code")


@query("structure_classify", rf"""with {I.LINES}, s as (select pos, trim(line, E' ') as t from lines)
select pos, case when regexp_matches(t, '(?i)^(part|chapter)\s+(\d+|[ivxlcdm]+)') then lower(regexp_extract(t, '(?i)^(part|chapter)', 1)) when regexp_matches(t, '^\d+(\.\d+)*[.)]?\s+\S') then 'section'
when starts_with(lower(t), 'appendix') then 'appendix' else 'section' end as kind,
case when regexp_matches(t, '(?i)^chapter\s+(\d+|[ivxlcdm]+)') then 2 when regexp_matches(t, '(?i)^part\s+(\d+|[ivxlcdm]+)') then 1
when regexp_matches(t, '^\d+(\.\d+)*[.)]?\s+\S') then cast(len(string_split(regexp_extract(t, '^(\d+(?:\.\d+)*)', 1), '.')) as int) else 1 end as level from s""")
def structure_classify(spark, d):
    return I.lines(spark, d).select("pos", T.structure(F.col("line")).alias("s")).select("pos", "s.kind", "s.level")


@query("heading_standardize", rf"""with {I.LINES}, s as (select pos, {TRIM_TITLE.format("line")} as t from lines)
select pos, case when regexp_matches(t, '(?i)^part\s') then 'Part IV — ' || trim(regexp_extract(t, '(?i)^part iv\s*(.*)$', 1)) when regexp_matches(t, '(?i)^chapter\s+\d') then regexp_replace(t, '^Chapter (\d+): ', 'Chapter \1 — ')
when regexp_matches(t, '(?i)^introduction\b') then 'Introduction' when regexp_matches(t, '(?i)^map\s+\d') then '[MAP] Map ' || regexp_extract(t, '(\d+A)', 1) || ': ' || regexp_extract(t, 'A (.*)$', 1)
when regexp_matches(t, '^Zone\s+\d') then regexp_replace(t, '^Zone (\d+)- ', 'Zone \1 — ') else t end as title,
case when regexp_matches(t, '(?i)^map\s+\d') then 'caption' when regexp_matches(t, '^Zone\s+\d') then 'zone' else 'heading' end as kind from s""")
def heading_standardize(spark, d):
    return I.lines(spark, d).select("pos", T.standard_heading(F.col("line")).alias("s")).select("pos", "s.title", "s.kind")


@query("font_threshold_p90", """with s as (select source as book_id, list(n_chars / 100.0::double order by n_chars) as l from documents where n_chars > 0 group by 1)
select book_id, greatest(cast(l[cast(floor(0.9::double * (len(l) - 1)) as int) + 1] as double), 12.5::double) as threshold from s""")
def font_threshold_p90(spark, d):
    sizes = I.table(spark, d, "documents").select(F.col("source").alias("book_id"), (F.col("n_chars") / F.lit(100.0)).alias("size"))
    return P.size_threshold(sizes, ["book_id"], "size")


@query("outline_dedupe_earliest", """with t as (select p_brand as book_id, case when p_partkey % 11 = 0 then cast(p_size as varchar) else p_name end as title, p_size as start, p_retailprice as y, p_partkey as pos from part),
k as (select *, row_number() over (partition by book_id, lower(title) order by start, y, pos) as k from t where not regexp_full_match(trim(title), '[0-9]{1,4}') and length(trim(title)) >= 3)
select book_id, title, start, y, pos from k where k = 1""")
def outline_dedupe_earliest(spark, d):
    name = F.when(F.col("p_partkey") % 11 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    return P.earliest_titles(I.table(spark, d, "part").select(F.col("p_brand").alias("book_id"), name.alias("title"), F.col("p_size").alias("start"), F.col("p_retailprice").alias("y"), F.col("p_partkey").alias("pos")))


def _starts(spark, d):
    return I.table(spark, d, "part").select(F.col("p_brand").alias("book_id"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("start"), F.lit(60).alias("max_page"))


STARTS = "rows as (select p_brand as book_id, p_partkey as pos, p_size as start, 60 as max_page from part)"


@query("range_next_row", f"""with {STARTS} select book_id, pos, start, greatest(coalesce(lead(start) over (partition by book_id order by pos) - 1, max_page), start) as "end" from rows""")
def range_next_row(spark, d):
    return P.ranges_to_next_row(_starts(spark, d)).select("book_id", "pos", "start", "end")


@query("range_next_distinct", f"""with {STARTS}, n as (select a.book_id, a.pos, a.start, a.max_page, min(b.pos) as p from rows a left join rows b on a.book_id = b.book_id and b.pos > a.pos and b.start > a.start group by all)
select n.book_id, n.pos, n.start, coalesce(r.start - 1, n.max_page) as "end" from n left join rows r on r.book_id = n.book_id and r.pos = n.p""")
def range_next_distinct(spark, d):
    return P.ranges_to_next_start(_starts(spark, d)).select("book_id", "pos", "start", "end")


@query("section_extract", f"""with {I.ALL} select book_id, sno, title, start, "end", text from sections""")
def section_extract(spark, d):
    return I.sections(spark, d)


RUN = "20240101-000000000000"


@query("section_manifest", f"""with {I.ALL} select '{RUN}' as run_id, book_id, sno, title, start as physical_start, "end" as physical_end, start - 1 as pdf_page_index, {FILENAME.format("title", "sno")} as txt_path,
cast(length(text) as int) as chars, case when length(text) < 500 then 'skipped' else 'written' end as status from sections""")
def section_manifest(spark, d):
    return P.manifest(I.sections(spark, d), RUN, 500)


@query("run_accounting", f"""with {I.ALL} select '{RUN}' as run_id, book_id, count(*) as expected_count, count(*) filter (where length(text) >= 500) as written_count, count(*) filter (where length(text) < 500) as skipped_count, cast(0 as bigint) as failed_count from sections group by 2""")
def run_accounting(spark, d):
    return P.run_accounting(P.manifest(I.sections(spark, d), RUN, 500))


WANTED = "tion"
HIT = f"greatest(position('{WANTED}' in replace(lower(text), 'ß', 'ss')) - 1, 0)"


@query("section_search", f"""with {I.ALL}, h as (select *, {HIT} as p from sections where contains(replace(lower(title || E'\\n' || text), 'ß', 'ss'), '{WANTED}') and start between 2 and 40)
select book_id, sno, title, start, replace(substring(text, cast(greatest(p - 80, 0) as bigint) + 1, cast(p + {len(WANTED) + 120} - greatest(p - 80, 0) as bigint)), E'\\n', ' ') as snippet from h""")
def section_search(spark, d):
    return P.search(I.sections(spark, d), WANTED, first=2, last=40).select("book_id", "sno", "title", "start", "snippet")


@query("search_export", f"""with {I.ALL}, h as (select *, {HIT} as p from sections where contains(replace(lower(title || E'\\n' || text), 'ß', 'ss'), '{WANTED}') and start between 2 and 40),
s as (select book_id, sno, title, start, replace(substring(text, cast(greatest(p - 80, 0) as bigint) + 1, cast(p + {len(WANTED) + 120} - greatest(p - 80, 0) as bigint)), E'\\n', ' ') as snippet from h)
select book_id, sno as pos, cast(to_json({{'sno': sno, 'title': title, 'start': start, 'snippet': snippet}}) as varchar) as line from s""")
def search_export(spark, d):
    """The hits of a search as lines of JSON."""
    return R.rendered(section_search(spark, d).withColumn("pos", F.col("sno")), ["sno", "title", "start", "snippet"], "json")


@query("outline_navigation", f"""with {I.PAGES}, {I.OUTLINE} select book_id, sno, lag(sno) over w as previous_sno, lead(sno) over w as next_sno, row_number() over w || ' of ' || count(*) over (partition by book_id) as place from outline window w as (partition by book_id order by sno)""")
def outline_navigation(spark, d):
    return P.navigation(I.outline(I.pages(spark, d)))


@query("monotonic_check", f"with {STARTS} select book_id, pos, start, previous from (select *, lag(start) over (partition by book_id order by pos) as previous from rows) where start < previous")
def monotonic_check(spark, d):
    return P.falling_starts(_starts(spark, d)).select("book_id", "pos", "start", "previous")


LEVELS = "tree as (select p_brand as book_id, p_partkey as pos, p_name as title, 1 + p_size % 9 as level from part)"
PARENTS = LEVELS + ", linked as (select a.*, (select max(b.pos) from tree b where b.book_id = a.book_id and b.pos < a.pos and b.level < a.level) as parent_pos from tree a)"


def _tree(spark, d):
    rows = I.table(spark, d, "part").select(F.col("p_brand").alias("book_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), (1 + F.col("p_size") % 9).alias("level"))
    return P.parents_by_level(rows)


@query("hierarchy_parent", f"with {PARENTS} select book_id, pos, level, parent_pos from linked")
def hierarchy_parent(spark, d):
    return _tree(spark, d).select("book_id", "pos", "level", "parent_pos")


@query("hierarchy_filter", f"""with recursive {PARENTS}, seen as (select book_id, pos, parent_pos from linked where contains(title, 'blue') union select l.book_id, l.pos, l.parent_pos from seen s join linked l on l.book_id = s.book_id and l.pos = s.parent_pos)
select distinct book_id, pos from seen""")
def hierarchy_filter(spark, d):
    return P.matching_with_ancestors(_tree(spark, d), F.col("title").contains("blue")).select("book_id", "pos")


@query("text_status", f"""with {I.PAGES} select book_id, count(*) as page_count, case when sum(case when page <= 3 then length(trim(coalesce(text, ''))) else 0 end) >= 80 then 'text-extractable' else 'likely-scanned' end as status from pages group by 1""")
def text_status(spark, d):
    return P.text_status(I.pages(spark, d))


@query("anchor_conflicts", f"with {I.ANCHORS} select book_id, printed, array_to_string(list_sort(list(distinct physical)), ',') as physical_pages from anchors where not exception group by 1, 2 having count(distinct physical) > 1")
def anchor_conflicts(spark, d):
    return M.conflicts(I.anchors(spark, d)).select("book_id", "printed", F.array_join("physical_pages", ",").alias("physical_pages"))


@query("mapping_segments", f"with {I.ANCHORS}, {I.SEGMENTS} select book_id, cast(segment as bigint) as segment, printed_start, printed_end, \"offset\", anchors, confirmed from segments")
def mapping_segments(spark, d):
    return M.segments(I.anchors(spark, d))


RESOLVED = f"""{I.ANCHORS}, {I.SEGMENTS}, entries as (select book_id, page as sno, page + 1 as printed, case when page % 5 = 0 then 'chapter' else 'section' end as kind from pages),
x as (select book_id, printed, max(physical) as x from anchors where exception group by 1, 2), s as (select book_id, printed, min(physical) as lo, max(physical) as hi from anchors where not exception group by 1, 2),
o as (select book_id, count(*) as n, max("offset") as one from segments where confirmed group by 1),
joined as (select e.*, x, lo, hi, n, one, (select min("offset") from segments g where g.book_id = e.book_id and confirmed and e.printed between printed_start and printed_end) as inside
from entries e left join x using (book_id, printed) left join s using (book_id, printed) left join o using (book_id)),
resolved as (select book_id, sno, kind, printed, cast(case when x is not null then x when lo < hi then null when lo is not null then lo when inside is not null then printed + inside when n = 1 then printed + one end as int) as physical,
case when x is not null then 'exception' when lo < hi then 'unresolved' when lo is not null then 'anchor' when inside is not null then 'segment' when n = 1 then 'extrapolated' else 'unresolved' end as method from joined)"""


def entries(spark, d):
    kind = F.when(F.col("page") % 5 == 0, "chapter").otherwise("section")
    return I.pages(spark, d).select("book_id", F.col("page").alias("sno"), F.concat(F.lit("Entry "), F.col("page").cast("string")).alias("title"), (F.col("page") + 1).alias("printed"), kind.alias("kind"), F.lit(True).alias("include"))


@query("mapping_resolve", f"with {RESOLVED} select book_id, sno, printed, physical, method from resolved")
def mapping_resolve(spark, d):
    return M.resolve(entries(spark, d), I.anchors(spark, d)).select("book_id", "sno", "printed", "physical", "method")


@query("next_anchor", f"""with {RESOLVED} select book_id, sno, 'Entry ' || sno as title, kind, printed from (select *, row_number() over (partition by book_id order by kind <> 'chapter', printed, sno) as k from resolved where physical is null) where k = 1""")
def next_anchor(spark, d):
    return M.next_anchor(M.resolve(entries(spark, d), I.anchors(spark, d)))


@query("printed_ends", f"""with {STARTS}, n as (select *, case when pos % 5 <> 0 then start - 1 end as printed, start + 3 as "end" from rows), l as (select *, lead(printed) over (partition by book_id order by pos) as after from n)
select book_id, pos, printed, case when after > coalesce(printed, 0) then after - 1 else printed + "end" - start end as printed_end from l""")
def printed_ends(spark, d):
    rows = _starts(spark, d).withColumns({"printed": F.when(F.col("pos") % 5 != 0, F.col("start") - 1), "end": F.col("start") + 3})
    return P.printed_ends(rows).select("book_id", "pos", "printed", "printed_end")


@query("physical_rows", f"""with {RESOLVED}, spot as (select book_id, printed, physical from resolved), r as (select book_id, sno, printed as start, printed + case when sno = max(sno) over (partition by book_id) then 0 else 1 end as "end", sno % 7 = 0 as given from entries),
j as (select r.*, a.physical as s, b.physical as e from r left join spot a on a.book_id = r.book_id and a.printed = r.start left join spot b on b.book_id = r.book_id and b.printed = r."end")
select book_id, sno, case when given then start when e is not null then s end as physical_start, case when given then "end" when s is not null then e end as physical_end,
case when not given and s is null then start when not given and e is null then "end" end as unresolved from j""")
def physical_rows(spark, d):
    e = entries(spark, d)
    last = e.groupBy("book_id").agg(F.max("sno").alias("last"))
    end = F.col("printed") + F.when(F.col("sno") == F.col("last"), 0).otherwise(1)  # the last entry ends on its own page
    rows = e.join(last, "book_id").select("book_id", "sno", F.col("printed").alias("start"), end.alias("end"), (F.col("sno") % 7 == 0).alias("already_physical"))
    return M.physical_rows(rows, I.anchors(spark, d)).select("book_id", "sno", "physical_start", "physical_end", "unresolved")


@query("search_summary", f"""with {I.ALL}, n as (select book_id, count(*) filter (where length(text) >= 500) as w, count(*) filter (where contains(replace(lower(title || E'\\n' || text), 'ß', 'ss'), '{WANTED}')) as hits from sections group by 1)
select '{RUN}' as run_id, book_id, hits, hits || ' of ' || w as summary from n""")
def search_summary(spark, d):
    sections = I.sections(spark, d)
    return P.search_summary(P.search(sections, WANTED).withColumn("run_id", F.lit(RUN)), P.run_accounting(P.manifest(sections, RUN, 500)))
