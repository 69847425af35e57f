"""Validation as data: every rule is a query, every finding a row (book_id, severity, code, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import mapping

# The kinds that an entry may have.
KINDS = (
    "part", "chapter", "section", "subsection", "analytical_section", "preface", "introduction", "appendix", "bibliography", "notes",
    "index", "caption", "topic", "glossary", "acknowledgement", "other",
)


def finding(rows: DataFrame, cond: Column, severity: str, code: str, key: Column) -> DataFrame:
    return rows.where(cond).select("book_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), key.cast("string").alias("key"))


def verdict(books: DataFrame, findings: list[DataFrame], passed: str, any_finding: bool = False) -> DataFrame:
    """All findings, and a passed row for each book without a blocking one (without any, if any_finding)."""
    issues = reduce(DataFrame.unionByName, findings)
    blocked = (issues if any_finding else issues.where("severity = 'blocking'")).select("book_id").distinct()
    clear = books.select("book_id").distinct().join(blocked, "book_id", "left_anti")
    return issues.unionByName(clear.select("book_id", F.lit("passed").alias("severity"), F.lit(passed).alias("code"), F.lit(None).cast("string").alias("key")))


def optional(df: DataFrame, **kinds: str) -> DataFrame:
    """df with the columns that it lacks, null."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


def supplied(physical: Column, index: Column) -> Column:
    """Whether a row brings a physical page and an index that agree: it needs no anchors."""
    return F.coalesce(index == physical - 1, F.lit(False))


def outline_issues(outline: DataFrame, books: DataFrame) -> DataFrame:
    """outline(book_id, sno, title, kind, printed, physical, include, allow_extraction[, label, pdf_index]), books(book_id, page_count).

    Only included rows are judged, but for duplicate_sno. A row needs a printed page, a label, or a physical page that agrees
    with its index. A book passes without any finding.
    """
    o = optional(outline, label="string", pdf_index="int").join(books, "book_id")
    on = o.where("include")
    n = F.count("*").over(Window.partitionBy("book_id", "sno"))
    sno, blank = F.col("sno"), lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = books.join(outline.where("include").select("book_id").distinct(), "book_id", "left_anti")
    placeless = (F.coalesce("printed", F.lit(0)) < 1) & (F.coalesce("label", F.lit("")) == "") & ~supplied(F.col("physical"), F.col("pdf_index"))
    return verdict(books, [
        finding(o.withColumn("n", n).select("book_id", "sno", "n").distinct(), F.col("n") > 1, "blocking", "duplicate_sno", sno),
        finding(empty, F.lit(True), "blocking", "empty_outline", F.lit(None)),
        finding(on, blank("title"), "blocking", "empty_title", sno),
        finding(on, placeless, "blocking", "invalid_printed_start", sno),
        finding(on, ~F.coalesce("kind", F.lit("")).isin(*KINDS), "warning", "unknown_kind", sno),
        finding(on, ~F.coalesce("allow_extraction", F.lit(True)), "blocking", "boundary_not_extraction_enabled", sno),
        finding(on, (F.col("page_count") > 0) & (F.col("physical") > F.col("page_count")), "blocking", "physical_out_of_range", sno),
    ], "outline_valid", any_finding=True)


def placed_entries(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """The included entries with the physical page that they bring or that the anchors give."""
    return mapping.resolve_entries(optional(entries, given_physical="int", given_index="int").where("include"), anchors)


def mapping_issues(anchors: DataFrame, entries: DataFrame, books: DataFrame) -> DataFrame:
    """Findings on anchors(book_id, printed, physical, pdf_index, exception) and the entries(book_id, sno, printed, include[, given_physical,
    given_index]) that they should place. A book all of whose printed entries bring their physical page needs no anchors."""
    plain = anchors.join(books, "book_id")
    count = anchors.groupBy("book_id").agg(F.count_if(~F.col("exception")).alias("n"), F.count_if("exception").alias("x"))
    segs = mapping.segments(anchors)
    state = segs.groupBy("book_id").agg(F.count_if("confirmed").alias("sure"))
    placed = placed_entries(entries, anchors).where("printed <> 0")
    need = placed.where("method <> 'supplied'").select("book_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0))
    needy = books.join(need, "book_id", "left_semi").join(count, "book_id", "left").join(state, "book_id", "left")
    pair = F.format_string("%d:%d", "printed", "physical")
    return verdict(books, [
        finding(needy, zero("n") < 2, "blocking", "two_anchors_required", F.lit(None)),
        finding(plain, (F.col("printed") < 1) | (F.col("physical") < 1), "blocking", "invalid_anchor", pair),
        finding(plain, F.col("pdf_index") != F.col("physical") - 1, "blocking", "index_mismatch", pair),
        finding(plain, (F.col("page_count") > 0) & (F.col("physical") > F.col("page_count")), "blocking", "anchor_out_of_range", pair),
        finding(mapping.conflicts(anchors), F.lit(True), "blocking", "offset_conflict", F.col("printed")),
        finding(segs, ~F.col("confirmed"), "warning", "segment_unconfirmed", F.col("printed_start")),
        finding(needy, (zero("sure") == 0) & (zero("x") == 0), "blocking", "offset_unresolved", F.lit(None)),
        finding(placed, F.col("physical").isNull(), "blocking", "uncovered_entry", F.col("sno")),
    ], "mapping_valid")


def preflight_issues(outline: DataFrame, anchors: DataFrame, books: DataFrame, state: DataFrame) -> DataFrame:
    """Whether sections may be extracted, with the findings on outline and mapping.

    outline as for outline_issues, with pos where sno doesn't order it; state(book_id, present, hash_ok, outline_approved, mapping_approved
    [, approval_pdf_ok, approval_outline_ok]). A book whose file is missing gets that finding alone; one passes without any finding.
    """
    s = optional(books.select("book_id").join(state, "book_id", "left"), approval_pdf_ok="boolean", approval_outline_ok="boolean")
    have = s.where(F.coalesce("present", F.lit(False)))
    here = lambda df: df.join(have.select("book_id"), "book_id", "left_semi")
    known = here(books)
    entries = here(optional(outline, pdf_index="int", pos="long")).withColumns({"given_physical": F.col("physical"), "given_index": F.col("pdf_index"), "pos": F.coalesce("pos", F.col("sno"))}).drop("physical")
    on = placed_entries(entries, anchors).join(books, "book_id")
    fits = F.coalesce(F.col("physical").between(1, F.col("page_count")), F.lit(False))
    falls = on.where(fits).withColumn("before", F.lag("physical").over(Window.partitionBy("book_id").orderBy("pos")))
    name = T.section_filename(F.col("sno"), F.col("title"))
    twice = on.groupBy("book_id", name.alias("name")).agg(F.count("*").alias("n"))
    none = F.lit(None)
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    stale = lambda c: ~no("outline_approved") & ~F.coalesce(F.col(c), F.lit(True))
    parts = [outline_issues(here(outline), known), mapping_issues(here(anchors), entries, known)]
    return verdict(books, [
        finding(s, no("present"), "blocking", "pdf_missing", none),
        finding(have, no("hash_ok"), "blocking", "registered_hash_mismatch", none),
        finding(have, no("outline_approved"), "blocking", "outline_not_approved", none),
        finding(have, stale("approval_pdf_ok"), "blocking", "approval_pdf_mismatch", none),
        finding(have, stale("approval_outline_ok"), "blocking", "outline_hash_mismatch", none),
        *(p.where("severity <> 'passed'") for p in parts),
        finding(have, no("mapping_approved"), "blocking", "mapping_not_approved", none),
        finding(on, ~fits, "blocking", "mapped_page_invalid", F.col("sno")),
        finding(falls, F.col("physical") < F.col("before"), "blocking", "non_monotonic_physical", F.col("sno")),
        finding(twice, F.col("n") > 1, "blocking", "filename_collision", F.col("name")),
    ], "preflight_passed", any_finding=True)


BY_PAIR, BY_PAGE = ("invalid_anchor", "index_mismatch", "anchor_out_of_range"), ("offset_conflict", "segment_unconfirmed")
"""Codes whose key is an anchor's pair of pages, and a printed page."""


def issue_sources(issues: DataFrame, anchors: DataFrame) -> DataFrame:
    """issues(book_id, severity, code, key) of mapping_issues with what they speak of: anchors (pairs of pages), segment and entry; empty or null where a finding speaks of none.

    Anchors meet findings by pair or printed page, segments by the page that they cover, entries by their number.
    """
    pages = anchors.select("book_id", F.format_string("%d:%d", "printed", "physical").alias("key"), "printed", "physical", F.lit(True).alias("pair"))
    pages = pages.union(anchors.where("not exception").select("book_id", F.col("printed").cast("string"), "printed", "physical", F.lit(False)))
    kind = issues.withColumn("pair", F.when(F.col("code").isin(*BY_PAIR), True).when(F.col("code").isin(*BY_PAGE), False))
    at = pages.groupBy("book_id", "key", "pair").agg(F.sort_array(F.collect_set(F.struct("printed", "physical"))).alias("anchors"))
    asked = kind.where("not pair").select("book_id", F.col("key").cast("int").alias("printed")).distinct()
    inside = mapping.covering(asked, mapping.segments(anchors), "segment").select("book_id", F.col("printed").cast("string").alias("key"), F.lit(False).alias("pair"), F.col("inside").alias("segment"))
    got = kind.join(at, ["book_id", "key", "pair"], "left").join(inside, ["book_id", "key", "pair"], "left")
    none = F.array().cast(at.schema["anchors"].dataType)
    return got.select("book_id", "severity", "code", "key", F.coalesce("anchors", none).alias("anchors"), "segment", F.when(F.col("code") == "uncovered_entry", F.col("key").cast("int")).alias("entry"))


# What helps against a finding, for those who review a mapping.
ACTIONS = {
    "two_anchors_required": "Pair two printed pages with their physical pages.",
    "invalid_anchor": "Give both pages of the pair as numbers from 1 up.",
    "index_mismatch": "Set the file index to one less than the physical page.",
    "anchor_out_of_range": "Choose a physical page that the file has, or drop the pair.",
    "offset_conflict": "Keep one of the pairs for this printed page; drop the others or call them exceptions.",
    "segment_unconfirmed": "Confirm this stretch by a second pair with the same distance.",
    "offset_unresolved": "Confirm one stretch of the book by two pairs with the same distance.",
    "uncovered_entry": "Pair a printed page close to this entry.",
}


def suggested_action(code: Column) -> Column:
    """The text for a code, empty for others."""
    texts = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    return F.coalesce(texts[code], F.lit(""))


def approve(books: DataFrame, issues: DataFrame, approved: DataFrame) -> DataFrame:
    """(book_id, verdict): approved, or why not: already_approved (revoke it first), blocked. approved(book_id) holds what is approved now."""
    blocked = issues.where("severity = 'blocking'").select("book_id").distinct().withColumn("__blocked", F.lit(True))
    now = approved.select("book_id").distinct().withColumn("__now", F.lit(True))
    got = books.select("book_id").join(blocked, "book_id", "left").join(now, "book_id", "left")
    return got.select("book_id", F.when(F.col("__now"), "already_approved").when(F.col("__blocked"), "blocked").otherwise("approved").alias("verdict"))


def extractable(rows: DataFrame, approved: DataFrame) -> DataFrame:
    """(book_id, verdict) of rows with start and end resolved or null: a book is refused whole without an approved mapping or with one unresolved row."""
    got = rows.groupBy("book_id").agg(F.count_if(F.col("physical_start").isNull() | F.col("physical_end").isNull()).alias("open"))
    got = got.join(approved.select("book_id").distinct().withColumn("__ok", F.lit(True)), "book_id", "left")
    return got.select("book_id", F.when(F.col("__ok").isNull(), "mapping_not_approved").when(F.col("open") > 0, "unresolved_rows").otherwise("extract").alias("verdict"))


# The keys of an entry in a plain JSON outline.
ROW_KEYS = ("sno", "title", "kind", "printed_start", "physical_start", "pdf_index", "level", "parent_sno", "source", "include", "children")


# The keys of an outline document and of its book.
DOCUMENT_KEYS, BOOK_KEYS = ("book", "outline"), ("title", "author")


def json_document_issues(rows: DataFrame) -> DataFrame:
    """Findings on documents(book_id, json, refused), as json_documents reads them: why one can't be read, keys that are ignored, and a book that is no object."""
    keys, book = F.json_object_keys("json"), F.get_json_object("json", "$.book")
    r = rows.withColumns({"keys": keys, "book": book, "kind": F.schema_of_variant(F.try_variant_get(F.try_parse_json("json"), "$.book", "variant"))})
    r = r.withColumn("of_book", F.json_object_keys("book"))
    listed = lambda c, known: r.where(F.col("refused").isNull() | (F.col("refused") == "no_outline_list")).select("book_id", F.explode(F.array_except(c, F.array(*map(F.lit, known)))).alias("k"))
    return reduce(DataFrame.unionByName, [
        r.where("refused is not null").select("book_id", F.lit("blocking").alias("severity"), F.col("refused").alias("code"), F.lit("$").alias("key")),
        finding(listed("keys", DOCUMENT_KEYS), F.lit(True), "warning", "unknown_key", F.concat(F.lit("$."), "k")),
        finding(r, F.col("keys").isNotNull() & (F.col("kind") != "VOID") & ~F.startswith("kind", F.lit("OBJECT")), "blocking", "invalid_book_metadata", F.lit("$.book")),
        finding(listed("of_book", BOOK_KEYS), F.lit(True), "warning", "unknown_key", F.concat(F.lit("$.book."), "k")),
    ])


def json_shape_issues(rows: DataFrame) -> DataFrame:
    """Findings on what flattened entries(book_id, path, raw) are made of: entries that are no objects, keys that are ignored,
    children that are no list, and include and source of a wrong type. An absent or null children, or an absent include or source, is fine."""
    key = F.col("path")
    r = rows.withColumns({"keys": F.json_object_keys("raw"), "v": F.try_parse_json("raw")})
    o = r.where("keys is not null")
    kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
    has = lambda f: F.array_contains("keys", f)
    extra = o.select("book_id", "path", F.explode(F.array_except("keys", F.array(*map(F.lit, ROW_KEYS)))).alias("k"))
    source = F.trim(F.try_variant_get("v", "$.source", "string"))
    return reduce(DataFrame.unionByName, [
        finding(r, F.col("keys").isNull(), "blocking", "row_not_object", key),
        finding(extra, F.lit(True), "warning", "unknown_key", F.concat("path", F.lit("."), "k")),
        finding(o, has("children") & ~F.startswith(kind("children"), F.lit("ARRAY")) & (kind("children") != "VOID"), "blocking", "invalid_children", F.concat("path", F.lit(".children"))),
        finding(o, has("include") & (kind("include") != "BOOLEAN"), "blocking", "invalid_include", F.concat("path", F.lit(".include"))),
        finding(o, has("source") & ((kind("source") != "STRING") | (source == "")), "blocking", "invalid_source", F.concat("path", F.lit(".source"))),
    ])


def json_row_issues(rows: DataFrame) -> DataFrame:
    """Findings on flattened outline rows(book_id, path, parent_sno, raw), keyed by the path of the field at fault.

    Types count: pages and levels are whole numbers, not strings of digits; a printed page may be a Roman numeral in a
    string. kind is required and compared without case and outer space; level is required. Rows that are no objects are left
    to json_shape_issues.
    """
    r = rows.where(F.json_object_keys("raw").isNotNull()).withColumn("v", F.try_parse_json("raw"))
    kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant")), F.lit("VOID"))
    text = lambda f: F.trim(F.coalesce(F.get_json_object("raw", f"$.{f}"), F.lit("")))
    string = lambda f: F.when(kind(f) == "STRING", F.trim(F.try_variant_get("v", f"$.{f}", "string"))).otherwise("")
    whole = lambda f, least: F.coalesce((kind(f) == "BIGINT") & (F.try_variant_get("v", f"$.{f}", "long") >= least), F.lit(False))
    given = lambda f: kind(f) != "VOID"
    at = lambda f: F.concat("path", F.lit(f".{f}"))
    r = r.withColumn("s", text("sno")).withColumn("n", F.count("*").over(Window.partitionBy("book_id", "s")))
    known = r.where("s <> ''").select(F.col("book_id").alias("b"), F.col("s").alias("known")).distinct()
    up = F.trim(F.coalesce("parent_sno", F.lit("")))
    orphan = r.where(up != "").join(known, (F.col("book_id") == F.col("b")) & (up == F.col("known")), "left_anti")
    roman = string("printed_start").rlike(f"^{T.ROMAN}$")
    apart = F.try_variant_get("v", "$.pdf_index", "long") != F.try_variant_get("v", "$.physical_start", "long") - 1
    return reduce(DataFrame.unionByName, [
        finding(r, F.col("s") == "", "blocking", "missing_sno", at("sno")),
        finding(r, (F.col("n") > 1) & (F.col("s") != ""), "blocking", "duplicate_sno", at("sno")),
        finding(r, string("title") == "", "blocking", "missing_title", at("title")),
        finding(r, ~T.casefold(string("kind")).isin(*KINDS), "blocking", "invalid_kind", at("kind")),
        finding(r, ~given("printed_start"), "warning", "missing_printed_page", at("printed_start")),
        finding(r, roman, "warning", "roman_page", at("printed_start")),
        finding(r, given("printed_start") & ~roman & (kind("printed_start") != "BIGINT"), "blocking", "invalid_printed_page", at("printed_start")),
        finding(r, given("physical_start") & ~whole("physical_start", 1), "blocking", "invalid_physical_start", at("physical_start")),
        finding(r, given("pdf_index") & ~whole("pdf_index", 0), "blocking", "invalid_pdf_index", at("pdf_index")),
        finding(r, whole("physical_start", 1) & whole("pdf_index", 0) & apart, "blocking", "pdf_index_mismatch", at("pdf_index")),
        finding(r, ~whole("level", 1), "blocking", "invalid_level", at("level")),
        finding(orphan, F.lit(True), "blocking", "orphan_parent", at("parent_sno")),
    ])
