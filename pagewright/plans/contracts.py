"""Outline contracts: each brand of part is a book with one contract, its rows the entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import contract as C
from pagewright.plans import inputs as I
from pagewright.plans import query

LAST = 45
ROWS = """n as (select *, cast(row_number() over (partition by p_brand order by p_partkey) as int) as pos from part),
rows as (select p_brand as key, pos, p_partkey as k, concat('e', pos) as entry_id, case when p_partkey % 13 = 0 then '0' else concat('', pos) end as sno, p_name as title,
case when p_partkey % 7 = 0 then 'analytical_section' when p_partkey % 17 = 0 then 'odd' else 'section' end as kind, case when p_partkey % 5 = 0 then 2 else 1 end as level,
case when p_partkey % 5 = 0 and pos > 1 then pos - 1 end as up, case when p_partkey % 11 <> 0 then p_size end as page, case when p_partkey % 11 = 0 then 'x' else concat('', p_size) end as label,
case when p_partkey % 11 = 0 then 'roman_lower' else 'arabic' end as system, p_size + 2 as physical, case when p_partkey % 19 = 0 then p_size else p_size + 1 end as pdf_index,
case when p_partkey % 3 = 0 then 'proposed' else 'verified_printed' end as status, p_partkey % 4 <> 0 as extract, case when p_partkey % 7 = 0 then 'analytical' else 'verbatim' end as origin,
case when p_partkey % 23 <> 0 then p_name end as evidence, case when p_partkey % 9 = 0 then 'z' else concat('', p_size) end as evidence_label, p_size as evidence_index, p_partkey % 8 <> 1 as include from n)"""


def _contracts(spark, d):
    rows = spark.sql(f"with {ROWS.replace('from part', 'from {part}')} select * from rows", part=I.table(spark, d, "part"))
    lit = lambda v, name: F.lit(v).alias(name)
    entry = F.struct(
        "entry_id", "sno", "title", "kind", "level", F.concat(F.lit("e"), F.col("up").cast("string")).alias("parent_entry_id"), F.col("up").cast("string").alias("parent_sno"),
        F.struct("label", F.col("page").alias("numeric"), F.col("system").alias("numbering_system")).alias("printed_start"), F.col("physical").alias("physical_start"), F.col("pdf_index").alias("pdf_page_index"),
        F.struct("status", lit("heading", "basis"), F.col("extract").alias("allow_extraction")).alias("boundary"),
        F.struct(lit("printed_toc", "source_type"), F.col("evidence_label").alias("source_page_label"), F.col("evidence_index").alias("source_pdf_index"), F.col("evidence").alias("raw_source_text"), F.col("origin").alias("analytical_or_verbatim")).alias("provenance"),
        F.struct(lit(0.5, "confidence"), lit("reviewed", "review_status")).alias("quality"), "include",
    )
    listed = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", entry.alias("e")))).alias("l"))
    odd = F.regexp_extract("key", r"(\d+)", 1).cast("int") % 2 == 1
    doc = F.struct(
        lit(C.NAME, "schema_name"), lit(C.VERSION, "schema_version"), F.struct(F.col("key").alias("book_id"), lit("b.pdf", "pdf_filename"), lit("B", "title"), lit(LAST, "total_pdf_pages")).alias("document"),
        F.struct(lit("hybrid", "method"), lit("g", "generator"), lit("all", "source_scope")).alias("generation"), F.struct(F.when(odd, "verified").otherwise("unresolved").alias("printed_to_physical_mapping_status")).alias("pagination"),
        F.transform("l", lambda x: x["e"]).alias("entries"), F.struct(lit("valid", "status"), lit("1.0.0", "validator_version")).alias("validation"), F.struct(lit("reviewed", "status")).alias("approval"),
    )
    return C.read(listed.select("key", F.to_json(doc).alias("json")))


PLACE, NAMED = "'$.entries[' || (pos - 1) || ']'", "'$.entries[' || entry_id || ']'"


def _rules(rules, path, source="rows"):
    return " union all ".join(f"select key, '{s}' as severity, '{code}' as code, {path} as path from {source} where {cond}" for s, code, cond in rules)


MODEL = [
    ("error", "invalid_kind", "kind = 'odd'"), ("error", "extraction_without_page", "include and extract and page is null"), ("error", "pdf_index_mismatch", "pdf_index <> physical - 1"),
    ("error", "unverified_extraction", "origin = 'analytical' and status = 'proposed' and extract"), ("error", "duplicate_sno", "(select count(*) from rows r where r.key = rows.key and r.sno = rows.sno) > 1"),
    ("error", "root_level", "up is null and level <> 1"), ("error", "unknown_parent", "up is not null and (select count(*) from rows r where r.key = rows.key and r.sno = '' || rows.up) = 0"),
    ("error", "level_mismatch", "up is not null and level <> (select r.level + 1 from rows r where r.key = rows.key and r.pos = rows.up)"),
]
MEANING = [
    ("error", "source_evidence_out_of_range", f"evidence_index >= {LAST}"), ("error", "missing_verbatim_evidence", "origin = 'verbatim' and evidence is null"), ("warning", "source_page_label_mismatch", "evidence_label <> label"),
    ("warning", "boundary_requires_review", "origin = 'analytical' and status = 'proposed'"), ("warning", "analytical_metadata_only", "origin = 'analytical' and include and not extract"), ("error", "physical_page_out_of_range", f"physical > {LAST}"),
]
BOOKS = f"books as (select distinct key, key as book_id, case when right(key, 1) = '3' then {LAST - 1} else {LAST} end as page_count from rows)"
ISSUES = f"issues as ({_rules(MEANING, NAMED)} union all select key, 'error', 'pdf_page_count_mismatch', '$' from books where page_count <> {LAST})"


def _semantic(spark, d):
    c = _contracts(spark, d)
    books = c.select("key", F.col("key").alias("book_id"), F.lit(None).cast("string").alias("sha256"), F.when(F.col("key").endswith("3"), LAST - 1).otherwise(LAST).alias("page_count"))
    return c, C.semantic_issues(c, books)


@query("contract_model", f"with {ROWS} {_rules(MODEL, PLACE)}")
def contract_model(spark, d):
    return C.model_issues(_contracts(spark, d))


@query("issues_contract", f"with {ROWS}, {BOOKS}, {ISSUES} select * from issues")
def issues_contract(spark, d):
    return _semantic(spark, d)[1]


@query("contract_lifecycle", "select distinct p_brand as key, case when cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) % 2 = 1 then 'page_mapped' else 'human_reviewed' end as state from part")
def contract_lifecycle(spark, d):
    return C.lifecycle(*_semantic(spark, d))


@query("contract_candidates", f"""with {ROWS}, {BOOKS}, {ISSUES}, f as (select key, path, list_sort(list(distinct code)) as codes, bool_or(severity = 'error') as bad from issues where path <> '$' group by 1, 2)
select key, pos as sno, title, page as printed, include and extract and not coalesce(bad, false) and key not in (select key from issues where path = '$') as include,
array_to_string(list_concat(coalesce(codes, []), case when page is null then ['roman_page'] else [] end, case when not extract then ['metadata_only_boundary'] else [] end), ',') as warnings
from (select *, {NAMED} as path from rows) r left join f using (key, path)""")
def contract_candidates(spark, d):
    return C.candidates(*_semantic(spark, d)).select("key", "sno", "title", "printed", "include", F.array_join("warning_codes", ",").alias("warnings"))
