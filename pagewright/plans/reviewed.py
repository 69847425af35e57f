"""Review steps over the driver's tables: events, library edits, numbers, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import review as R
from pagewright.plans import inputs as I
from pagewright.plans import query

ROWS = "rows as (select p_brand as book_id, p_partkey as pos, cast(p_partkey % 37 as int) as sno, p_name as title, case when p_partkey % 6 <> 0 then p_size end as printed, p_partkey % 41 = 0 as edited from part)"


def _rows(spark, d):
    k = F.col("p_partkey")
    return I.table(spark, d, "part").select(F.col("p_brand").alias("book_id"), k.alias("pos"), (k % 37).cast("int").alias("sno"), F.col("p_name").alias("title"), F.when(k % 6 != 0, F.col("p_size")).alias("printed"), (k % 41 == 0).alias("edited"))


@query("provenance_events", f"""with {ROWS} select book_id, '2024-01-01T00:00:00Z' as recorded_at, 'import' as mode, cast(count(*) as bigint) as n, md5(string_agg(pos || '|' || sno || '|' || title, ',' order by pos)) as digest from rows group by 1""")
def provenance_events(spark, d):
    """One event a book; its candidates are shown as their number and a digest of them in order."""
    got = R.provenance_events(_rows(spark, d).select("book_id", "pos", "sno", "title"), "import", F.lit("2024-01-01T00:00:00Z"))
    text = F.array_join(F.transform("candidates", lambda c: F.concat_ws("|", c["pos"].cast("string"), c["sno"].cast("string"), c["title"])), ",")
    return got.select("book_id", "recorded_at", "mode", F.size("candidates").cast("long").alias("n"), F.md5(text.cast("binary")).alias("digest"))


LIBRARY = "library as (select 'book-' || c_custkey as book_id, c_name as filename, md5(c_name) as source_hash, c_nationkey as size_bytes, c_custkey % 5 = 0 as hidden from customer where c_custkey % 3 <> 0), files as (select 'copy of ' || c_name as name, 'book-' || c_custkey as book_id, md5(c_name) as source_hash, c_nationkey as size_bytes from customer where c_custkey % 4 <> 1 or c_custkey % 3 = 0 union all select c_name, 'book-' || c_custkey, md5(c_name), c_nationkey from customer where c_custkey % 7 = 0)"


def _library(spark, d):
    c = I.table(spark, d, "customer")
    key, h = F.col("c_custkey"), F.md5(F.col("c_name").cast("binary"))
    book = F.concat(F.lit("book-"), key.cast("string"))
    library = c.where(key % 3 != 0).select(book.alias("book_id"), F.col("c_name").alias("filename"), h.alias("source_hash"), F.col("c_nationkey").alias("size_bytes"), (key % 5 == 0).alias("hidden"))
    file = lambda df, name: df.select(name.alias("name"), book.alias("book_id"), h.alias("source_hash"), F.col("c_nationkey").alias("size_bytes"))
    return library, file(c.where((key % 4 != 1) | (key % 3 == 0)), F.concat(F.lit("copy of "), "c_name")).union(file(c.where(key % 7 == 0), F.col("c_name")))


@query("library_add", f"""with {LIBRARY}, f as (select book_id, min(name) as name, min(source_hash) as source_hash, min(size_bytes) as size_bytes from files group by 1)
select coalesce(l.book_id, f.book_id) as book_id, coalesce(filename, name) as filename, coalesce(l.source_hash, f.source_hash) as source_hash, coalesce(l.size_bytes, f.size_bytes) as size_bytes, case when f.book_id is not null then false else hidden end as hidden from library l full join f on l.book_id = f.book_id""")
def library_add(spark, d):
    return R.registered(*_library(spark, d))


@query("library_hide", f"with {LIBRARY} select book_id, filename, source_hash, size_bytes, hidden or book_id in (select book_id from files where name not like 'copy%') as hidden from library")
def library_hide(spark, d):
    library, files = _library(spark, d)
    return R.hidden(library, files.where("name not like 'copy%'"))


@query("library_visible", f"with {LIBRARY} select book_id, filename from library where not hidden and contains(lower(filename), 'r#00000001')")
def library_visible(spark, d):
    return R.visible(_library(spark, d)[0], "R#00000001").select("book_id", "filename")


@query("sections_by_sno", f"with {ROWS} select 'r1' as run_id, book_id, sno, max(pos) as pos, max_by(title, pos) as title from rows group by 2, 3")
def sections_by_sno(spark, d):
    return R.sections_by_sno(_rows(spark, d).select(F.lit("r1").alias("run_id"), "book_id", "sno", "pos", "title"))


@query("entry_sections", f"""with {ROWS}, s as (select book_id, sno, max_by(title, pos) as text from rows where sno % 5 <> 0 group by 1, 2)
select book_id, pos, sno, title, cast(length(text) as int) as chars, case when text is null then 'Not extracted' else length(text) || ' characters' end as shown from rows left join s using (book_id, sno)""")
def entry_sections(spark, d):
    rows = _rows(spark, d)
    held = R.sections_by_sno(rows.where("sno % 5 <> 0").select(F.lit("r1").alias("run_id"), "book_id", "sno", "pos", F.col("title").alias("text")))
    return R.entry_sections(rows, held)


@query("sort_by_printed_page", f"with {ROWS} select book_id, sno, title, printed, cast(row_number() over (partition by book_id order by printed nulls last, sno, title) as int) as pos from rows")
def sort_by_printed_page(spark, d):
    # sno repeats here, so the title settles the order among equals
    rows = _rows(spark, d).withColumn("number", F.col("sno")).withColumn("sno", F.struct("sno", "title"))
    return R.by_printed_page(rows.drop("pos")).select("book_id", F.col("number").alias("sno"), "title", "printed", "pos")


@query("editing_status", f"with {ROWS} select book_id, count(*) as entries, bool_or(edited) as modified, min(sno) filter (where sno = 3) is not null and count(*) % 2 = 0 as approved from rows group by 1")
def editing_status(spark, d):
    rows = _rows(spark, d)
    ok = rows.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.col("sno") == 3).alias("k")).where("n % 2 = 0 and k > 0")
    return R.editing_status(rows, ok)


@query("append_accepted", f"""with {ROWS}, d as (select * from rows where pos % 2 = 0), m as (select book_id, max(sno) as most from d group by 1)
select book_id, sno, title from d union all select book_id, cast(coalesce(most, 0) + row_number() over (partition by book_id order by pos) as int), title from rows left join m using (book_id) where pos % 2 = 1""")
def append_accepted(spark, d):
    rows = _rows(spark, d)
    return R.appended(rows.where("pos % 2 = 0").select("book_id", "sno", "title"), rows.where("pos % 2 = 1").select("book_id", "pos", "title"))


@query("selected_numbers", f"""with recursive {ROWS}, n as (select *, row_number() over (partition by book_id order by pos) as k from rows),
f as (select book_id, pos, k, sno, [sno] as used from n where k = 1 union all select n.book_id, n.pos, n.k, case when list_contains(used, n.sno) then list_max(used) + 1 else n.sno end, list_append(used, case when list_contains(used, n.sno) then list_max(used) + 1 else n.sno end)
from f join n on n.book_id = f.book_id and n.k = f.k + 1) select book_id, pos, sno from f""")
def selected_numbers(spark, d):
    return R.selected_numbers(_rows(spark, d))


@query("export_tsv", f"with {ROWS} select book_id, pos, concat_ws(E'\\t', sno, title, coalesce(cast(printed as varchar), '')) as line from rows")
def export_tsv(spark, d):
    return R.rendered(_rows(spark, d), ["sno", "title", "printed"])


@query("export_csv", f"""with {ROWS} select book_id, pos, sno || ',"a ""quoted"", ' || title || '",' || coalesce(cast(printed as varchar), '') as line from rows""")
def export_csv(spark, d):
    rows = _rows(spark, d).withColumn("title", F.concat(F.lit('a "quoted", '), "title"))
    return R.rendered(rows, ["sno", "title", "printed"], "csv")


@query("export_json", f"""with {ROWS} select book_id, pos, '{{"sno":' || sno || ',"title":"' || title || '","printed":' || coalesce(cast(printed as varchar), 'null') || '}}' as line from rows""")
def export_json(spark, d):
    return R.rendered(_rows(spark, d), ["sno", "title", "printed"], "json")


@query("shown_sizes", "select p_partkey, format('{:.1f} MB', p_partkey * 40000 / 1048576.0) as size, p_brand || '/' || p_partkey as path from part")
def shown_sizes(spark, d):
    k = F.col("p_partkey")
    return I.table(spark, d, "part").select("p_partkey", R.megabytes(k * 40000).alias("size"), R.short_path(F.concat(F.lit("/data/out/"), "p_brand", F.lit("/"), k.cast("string"))).alias("path"))


@query("export_union", f"""with {ROWS}, l as (select book_id, pos, case when sno % 2 = 0 then coalesce(cast(printed as varchar), '') else '' end || ',' || case when sno % 2 = 1 then 'index' else '' end || ',' || title as line from rows)
select * from l union all select distinct book_id, 0, 'printed_start,source,title' from rows""")
def export_union(spark, d):
    """Rows of two kinds in one table: columns are the union of their keys."""
    rows = _rows(spark, d)
    fields = F.when(F.col("sno") % 2 == 0, F.create_map(F.lit("title"), "title", F.lit("printed_start"), F.col("printed").cast("string"))).otherwise(F.create_map(F.lit("title"), "title", F.lit("source"), F.lit("index")))
    return R.union_rendered(rows.select("book_id", "pos", fields.alias("fields")))


OUTLINES = "outlines as (select p_partkey || case p_partkey % 5 when 0 then '_outline' when 1 then '_Outline_Clean' when 2 then '_toc' when 3 then '_index_x' else '' end || '.csv' as outline, p_partkey as k from part), files as (select distinct p_size || '.pdf' as file from part)"


@query("outline_files", f"with {OUTLINES} select outline, file from outlines left join files on file = regexp_replace(left(outline, -4), '(?i)(_outline(_clean)?|_contents|_toc|_index)$', '') || '.pdf'")
def outline_files(spark, d):
    part = I.table(spark, d, "part")
    ends = F.element_at(F.array(*map(F.lit, ("_outline", "_Outline_Clean", "_toc", "_index_x", ""))), (F.col("p_partkey") % 5).cast("int") + 1)
    outlines = part.select(F.concat(F.col("p_partkey").cast("string"), ends, F.lit(".csv")).alias("outline"))
    return R.files_of_outlines(outlines, part.select(F.concat(F.col("p_size").cast("string"), F.lit(".pdf")).alias("file")))
