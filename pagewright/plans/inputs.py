"""The book model over the driver's tables: in Spark, and as SQL common to both engines for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import pages as P

EVERY = 4
"""Every so many pages a section starts."""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return P.pages_from_documents(table(spark, d, "documents"))


def outline(pages: DataFrame) -> DataFrame:
    """(book_id, pos, sno, title, start, max_page): a section every EVERY pages."""
    heads = pages.where((F.col("page") - 1) % EVERY == 0).withColumn("sno", F.floor((F.col("page") - 1) / EVERY).cast("int") + 1)
    return heads.select("book_id", F.col("sno").alias("pos"), "sno", F.concat(F.lit("Section "), F.col("sno").cast("string")).alias("title"), F.col("page").alias("start"), F.col("page_count").alias("max_page"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    o = P.ranges_of_sorted(outline(p)).select("book_id", "sno", "title", "start", "end")
    return P.extract_sections(p, o)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(book_id, pos, line): contents, heading and caption lines made from part."""
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    text = (
        F.when(k % 8 == 0, F.concat(F.lit("Chapter "), (F.col("p_size")).cast("string"), F.lit(": "), F.col("p_name")))
        .when(k % 8 == 1, F.concat(F.lit("  Map "), F.col("p_size").cast("string"), F.lit("A - "), F.col("p_name")))
        .when(k % 8 == 2, F.concat(F.col("p_name"), F.lit(" ...... "), F.col("p_size").cast("string")))
        .when(k % 8 == 3, F.concat(F.lit("PART IV  "), F.col("p_name")))
        .when(k % 8 == 4, F.concat(F.lit("Zone "), F.col("p_size").cast("string"), F.lit("- "), F.col("p_name")))
        .when(k % 8 == 5, F.lit("INTRODUCTION to all"))
        .when(k % 8 == 6, F.concat(F.lit("1.2."), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name")))
        .otherwise(F.concat(F.lit("Appendix\t of  "), F.col("p_name")))
    )
    return part.select(F.col("p_brand").alias("book_id"), k.alias("pos"), text.alias("line"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """(book_id, printed, physical, pdf_index, exception): an anchor every third page; the offset steps every 20 pages."""
    p = pages(spark, d).where("page % 3 = 1")
    printed = F.col("page")
    physical = printed + 2 + F.floor(printed / 20).cast("int") + F.when(printed % 30 == 28, 1).otherwise(0)
    a = p.select("book_id", printed.alias("printed"), physical.alias("physical"))
    extra = a.where("printed % 9 = 1 and printed > 40").withColumn("physical", F.col("physical") + 5)
    odd = a.where("printed % 21 = 1").withColumn("printed", F.col("printed") + 1).withColumn("exception", F.lit(True))
    out = a.union(extra).withColumn("exception", F.lit(False)).unionByName(odd)
    return out.select("book_id", "printed", "physical", (F.col("physical") - 1).alias("pdf_index"), "exception")


PAGES = "pages as (select source as book_id, cast(row_number() over (partition by source order by doc_id) as int) as page, doc_id, text from documents)"
OUTLINE = f"""last as (select book_id, max(page) as max_page from pages group by 1),
outline as (select book_id, cast((page - 1) // {EVERY} + 1 as int) as sno, 'Section ' || ((page - 1) // {EVERY} + 1) as title, page as start, max_page from pages join last using (book_id) where (page - 1) % {EVERY} = 0)"""
RANGED = """ranged as (select book_id, sno, title, start, coalesce((select min(b.start) from outline b where b.book_id = a.book_id and b.start > a.start) - 1, max_page) as "end" from outline a)"""
SECTIONS = r"""sections as (select r.book_id, sno, title, start, "end", coalesce(string_agg(trim(text), E'\n\n' order by page) filter (where trim(text) <> ''), '') as text
from ranged r left join pages p on p.book_id = r.book_id and p.page between r.start and r."end" group by all)"""
ALL = ", ".join((PAGES, OUTLINE, RANGED, SECTIONS))
LINES = r"""lines as (select p_brand as book_id, p_partkey as pos, case p_partkey % 8 when 0 then 'Chapter ' || p_size || ': ' || p_name when 1 then '  Map ' || p_size || 'A - ' || p_name
when 2 then p_name || ' ...... ' || p_size when 3 then 'PART IV  ' || p_name when 4 then 'Zone ' || p_size || '- ' || p_name when 5 then 'INTRODUCTION to all'
when 6 then '1.2.' || p_size || ' ' || p_name else E'Appendix\t of  ' || p_name end as line from part)"""
ANCHORS = PAGES + """, a0 as (select book_id, page as printed, page + 2 + page // 20 + case when page % 30 = 28 then 1 else 0 end as physical from pages where page % 3 = 1),
anchors as (select book_id, printed, physical, false as exception from a0 union all select book_id, printed, physical + 5, false from a0 where printed % 9 = 1 and printed > 40
union all select book_id, printed + 1, physical, true from a0 where printed % 21 = 1)"""
SEGMENTS = """plain as (select book_id, printed, min(physical) as physical from anchors where not exception group by 1, 2 having min(physical) = max(physical)),
runs as (select *, sum(new) over (partition by book_id order by printed) as segment from (select book_id, printed, physical - printed as off, case when lag(physical - printed) over (partition by book_id order by printed) = physical - printed then 0 else 1 end as new from plain)),
segments as (select book_id, segment, min(printed) as printed_start, max(printed) as printed_end, off as "offset", count(*) as anchors, count(*) >= 2 as confirmed from runs group by book_id, segment, off)"""
