"""Outline contracts: one JSON document a book, checked, hashed and turned into draft entries.

documents(key, json) -> read() parses them; every rule is a row (key, severity, code, path), severity
error or warning. A field of a wrong type counts as wrong_type and is null for the rules that follow.
Text that is no JSON object gives not_an_object and nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.operators.rules import KINDS
from pagewright.sources import snapshots

# The schema (fields in alphabetical order, as the digest wants them) and its word lists.
NAME, VERSION = "book_outline_contract", "1.0.0"
ENTRY = (
    "boundary struct<allow_extraction:boolean,basis:string,end_inference:string,status:string>, entry_id string, include boolean, kind string, level int, notes string, "
    "parent_entry_id string, parent_sno string, pdf_page_index int, physical_start int, printed_start struct<label:string,numbering_system:string,numeric:int>, "
    "provenance struct<analytical_or_verbatim:string,raw_source_text:string,source_page_label:string,source_pdf_index:int,source_type:string>, "
    "quality struct<confidence:double,review_status:string,warning_codes:array<string>>, sno string, title string"
)
DOCUMENT = (
    "approval struct<approved_at:string,approved_by:string,outline_sha256:string,status:string>, "
    "document struct<author:string,book_id:string,pdf_filename:string,pdf_sha256:string,subtitle:string,title:string,total_pdf_pages:int>, "
    "generation struct<generated_at:string,generator:string,method:string,model:string,prompt_version:string,source_pages:struct<from_pdf_index:int,to_pdf_index:int>,source_scope:string>, "
    "pagination struct<default_offset:int,mapping_sidecar:string,printed_to_physical_mapping_status:string>, schema_name string, schema_version string, "
    "validation struct<errors:array<variant>,status:string,validated_at:string,validator_version:string,warnings:array<variant>>"
)
WORDS = {
    "numbering_system": ("arabic", "roman_lower", "roman_upper", "unnumbered"),
    "boundary": ("proposed", "verified_printed", "verified_physical", "rejected"),
    "end_inference": ("next_included_entry", "explicit_end", "chapter_end", "unknown"),
    "source_type": ("printed_toc", "printed_heading", "pdf_bookmark", "analytical_derivation", "ollama_candidate", "manual", "csv_import", "json_import"),
    "analytical_or_verbatim": ("verbatim", "analytical", "mixed"),
    "review_status": ("candidate", "reviewed", "approved", "rejected"),
    "method": ("human_curated", "deterministic_parser", "ollama_structured", "hybrid"),
    "mapping": ("unresolved", "provisional", "verified"),
    "validation": ("not_validated", "valid", "invalid"),
    "approval": ("draft", "reviewed", "approved", "revoked"),
}
SHA = "^[0-9a-f]{64}$"
TOP_KEYS = ("approval", "document", "entries", "generation", "pagination", "schema_name", "schema_version", "validation")


def read(documents: DataFrame) -> DataFrame:
    """documents(key, json) -> (key, doc, raw), doc null where json is no object."""
    return documents.select("key", F.from_json("json", DOCUMENT).alias("doc"), F.when(F.json_object_keys("json").isNotNull(), F.col("json")).alias("raw"))


def entries(contracts: DataFrame) -> DataFrame:
    """(key, pos, e, raw) of every entry, defaults filled in, texts trimmed."""
    items = F.from_json(F.get_json_object("raw", "$.entries"), "array<string>")
    got = contracts.where("raw is not null").select("key", F.posexplode(items).alias("pos", "raw"))
    got = got.select("key", (F.col("pos") + 1).alias("pos"), F.from_json("raw", ENTRY).alias("e"), "raw")
    e, b, p, q = F.col("e"), F.col("e.boundary"), F.col("e.printed_start"), F.col("e.quality")
    filled = e.withField("include", F.coalesce(e["include"], F.lit(True)))
    for name in ("entry_id", "sno", "title"):
        filled = filled.withField(name, F.trim(e[name]))
    filled = filled.withField("boundary", F.when(b.isNotNull(), b.withField("allow_extraction", F.coalesce(b["allow_extraction"], F.lit(False))).withField("end_inference", F.coalesce(b["end_inference"], F.lit("next_included_entry")))))
    filled = filled.withField("printed_start", F.when(p.isNotNull(), p.withField("numbering_system", F.coalesce(p["numbering_system"], F.lit("unnumbered")))))
    filled = filled.withField("quality", F.when(q.isNotNull(), q.withField("warning_codes", F.coalesce(q["warning_codes"], F.array().cast("array<string>")))))
    return got.withColumn("e", filled)


def _rows(df: DataFrame, path: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One pass over df: a row for each rule that fires."""
    hit = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for severity, code, cond in rules)))
    return df.select("key", F.explode(hit).alias("r"), path.alias("path")).select("key", "r.severity", "r.code", "path")


def _missing(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _unlisted(c: Column, words: str) -> Column:
    return ~F.coalesce(c.isin(*WORDS[words]), F.lit(False))


def _wrong(raw: str, fields: dict[str, Column]) -> Column:
    """Whether JSON has a value where the typed field is null."""
    return reduce(Column.__or__, (F.get_json_object(raw, f"$.{path}").isNotNull() & typed.isNull() for path, typed in fields.items()))


def _foreign(raw: str, known: dict[str, tuple[str, ...]]) -> Column:
    """Whether an object at one of the paths has a key that the schema lacks."""
    keys = lambda p: F.json_object_keys(F.get_json_object(raw, f"$.{p}") if p else F.col(raw))
    return reduce(Column.__or__, (F.coalesce(F.size(F.array_except(keys(p), F.array(*map(F.lit, names)))) > 0, F.lit(False)) for p, names in known.items()))


def _names(schema, *path: str) -> tuple[str, ...]:
    for p in path:
        schema = schema[p].dataType
    return tuple(schema.fieldNames())


def model_issues(contracts: DataFrame) -> DataFrame:
    """What makes a contract unreadable: fields, word lists, numbers, coordinates, boundaries, identities and parents."""
    d, top = contracts.schema["doc"].dataType, contracts.where("raw is not null")
    c = lambda path: F.col(f"doc.{path}")
    sections = ("approval", "document", "generation", "pagination", "validation")
    absent = reduce(Column.__or__, (c(s).isNull() for s in sections)) | F.from_json(F.get_json_object("raw", "$.entries"), "array<string>").isNull()
    whole = _rows(top, F.lit("$"), [
        ("error", "unknown_key", _foreign("raw", {"": TOP_KEYS, **{s: _names(d, s) for s in sections}, "generation.source_pages": ("from_pdf_index", "to_pdf_index")})),
        ("error", "missing_section", absent),
        ("error", "wrong_type", _wrong("raw", {"document.total_pdf_pages": c("document.total_pdf_pages"), "pagination.default_offset": c("pagination.default_offset")})),
        ("error", "schema_mismatch", ~(c("schema_name").eqNullSafe(F.lit(NAME)) & c("schema_version").eqNullSafe(F.lit(VERSION)))),
        ("error", "missing_field", reduce(Column.__or__, map(_missing, map(c, ("document.book_id", "document.pdf_filename", "document.title", "generation.generator", "generation.source_scope")))) | c("validation.validator_version").isNull()),
        ("error", "invalid_page_count", ~(F.coalesce(c("document.total_pdf_pages"), F.lit(0)) >= 1)),
        ("error", "invalid_digest", ~c("document.pdf_sha256").rlike(SHA) | ~c("approval.outline_sha256").rlike(SHA)),
        ("error", "invalid_value", _unlisted(c("generation.method"), "method") | _unlisted(c("pagination.printed_to_physical_mapping_status"), "mapping") | _unlisted(c("validation.status"), "validation") | _unlisted(c("approval.status"), "approval")),
        ("error", "invalid_source_pages", c("generation.source_pages").isNotNull() & ~((F.coalesce(c("generation.source_pages.from_pdf_index"), F.lit(-1)) >= 0) & F.coalesce(c("generation.source_pages.to_pdf_index") >= c("generation.source_pages.from_pdf_index"), F.lit(False)))),
    ])
    broken = contracts.where("raw is null").select("key", F.lit("error").alias("severity"), F.lit("not_an_object").alias("code"), F.lit("$").alias("path"))

    rows = entries(contracts)
    es = rows.schema["e"].dataType
    e = lambda path: F.col(f"e.{path}")
    numeric, system = e("printed_start.numeric"), e("printed_start.numbering_system")
    extract, analytical = e("boundary.allow_extraction"), e("provenance.analytical_or_verbatim").eqNullSafe(F.lit("analytical"))
    nested = ("boundary", "printed_start", "provenance", "quality")
    by = lambda k: F.count(f"e.{k}").over(Window.partitionBy("key", f"e.{k}"))
    rows = rows.withColumns({"ids": by("entry_id"), "snos": by("sno")})
    place = F.concat(F.lit("$.entries["), (F.col("pos") - 1).cast("string"), F.lit("]"))
    # parents: the last entry of a repeated id or sno counts
    up_id = rows.groupBy("key", e("entry_id").alias("up_id")).agg(F.max_by(F.struct("pos", e("level").alias("level")), "pos").alias("by_id"))
    up_sno = rows.groupBy("key", e("sno").alias("up_sno")).agg(F.max("pos").alias("by_sno"))
    rows = rows.withColumns({"up_id": e("parent_entry_id"), "up_sno": e("parent_sno")}).join(up_id, ["key", "up_id"], "left").join(up_sno, ["key", "up_sno"], "left")
    has_id, has_sno = F.col("up_id").isNotNull(), F.col("up_sno").isNotNull()
    each = _rows(rows, place, [
        ("error", "unknown_key", _foreign("raw", {"": _names(es), **{n: _names(es, n) for n in nested}})),
        ("error", "wrong_type", _wrong("raw", {p: e(p) for p in ("level", "physical_start", "pdf_page_index", "printed_start.numeric", "provenance.source_pdf_index", "quality.confidence")})),
        ("error", "missing_section", reduce(Column.__or__, (e(n).isNull() for n in nested))),
        ("error", "missing_field", _missing(e("entry_id")) | _missing(e("sno")) | _missing(e("title")) | _missing(e("boundary.basis"))),
        ("error", "invalid_kind", ~F.coalesce(e("kind").isin(*KINDS), F.lit(False))),
        ("error", "invalid_value", _unlisted(system, "numbering_system") | _unlisted(e("boundary.status"), "boundary") | _unlisted(e("boundary.end_inference"), "end_inference") | _unlisted(e("provenance.source_type"), "source_type") | _unlisted(e("provenance.analytical_or_verbatim"), "analytical_or_verbatim") | _unlisted(e("quality.review_status"), "review_status")),
        ("error", "invalid_number", ~F.coalesce(e("level").between(1, 12), F.lit(False)) | ~F.coalesce(e("quality.confidence").between(0, 1), F.lit(False)) | (numeric < 1) | (e("physical_start") < 1) | (e("pdf_page_index") < 0) | (e("provenance.source_pdf_index") < 0)),
        ("error", "arabic_without_number", (system == "arabic") & numeric.isNull()),
        ("error", "number_not_arabic", numeric.isNotNull() & (system != "arabic")),
        ("error", "label_of_unnumbered", (system == "unnumbered") & e("printed_start.label").isNotNull()),
        ("error", "half_coordinates", e("physical_start").isNull() != e("pdf_page_index").isNull()),
        ("error", "pdf_index_mismatch", e("pdf_page_index") != e("physical_start") - 1),
        ("error", "extraction_without_page", e("include") & extract & numeric.isNull()),
        ("error", "unverified_extraction", analytical & (e("boundary.status") == "proposed") & extract),
        ("error", "rejected_extraction", (e("boundary.status") == "rejected") & extract),
        ("error", "analytical_kind_mismatch", analytical != e("kind").eqNullSafe(F.lit("analytical_section"))),
        ("error", "duplicate_entry_id", F.col("ids") > 1),
        ("error", "duplicate_sno", F.col("snos") > 1),
        ("error", "half_parent", has_id != has_sno),
        ("error", "root_level", ~has_id & ~has_sno & (e("level") != 1)),
        ("error", "unknown_parent", has_id & has_sno & (F.col("by_id").isNull() | F.col("by_sno").isNull())),
        ("error", "parents_disagree", F.col("by_id.pos") != F.col("by_sno")),
        ("error", "level_mismatch", has_sno & (e("level") != F.col("by_id.level") + 1)),
    ])
    return broken.unionByName(whole).unionByName(each)


def payload_hash(contracts: DataFrame) -> DataFrame:
    """(key, payload_sha256): SHA-256 of the contract as compact JSON with sorted keys and all defaults, the approval's own digest null."""
    rows = entries(contracts).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "e"))).alias("rows"))
    got = contracts.where("doc is not null").join(rows, "key", "left")
    doc, none = F.col("doc"), F.array().cast("array<variant>")
    v = doc["validation"].withField("errors", F.coalesce(F.col("doc.validation.errors"), none)).withField("warnings", F.coalesce(F.col("doc.validation.warnings"), none))
    blank = doc["approval"].withField("outline_sha256", F.lit(None).cast("string"))
    listed = F.coalesce(F.transform("rows", lambda x: x["e"]), F.array().cast(T.ArrayType(entries(contracts).schema["e"].dataType)))
    body = F.struct(*({"approval": blank, "entries": listed, "validation": v}.get(k, doc[k]).alias(k) for k in TOP_KEYS))
    return got.select("key", F.sha2(F.to_json(body, {"ignoreNullFields": "false"}).cast("binary"), 256).alias("payload_sha256"))


def semantic_issues(contracts: DataFrame, books: DataFrame) -> DataFrame:
    """Whether readable contracts fit their books and themselves; books(key, book_id, sha256, page_count) may lack a key or hold nulls, which check nothing."""
    got = contracts.where("doc is not null").join(books, "key", "left").join(payload_hash(contracts), "key", "left")
    c = lambda path: F.col(f"doc.{path}")
    pages, approved = c("document.total_pdf_pages"), c("approval.status") == "approved"
    whole = _rows(got, F.lit("$"), [
        ("error", "book_id_mismatch", c("document.book_id") != F.col("book_id")),
        ("error", "pdf_hash_mismatch", F.col("sha256").isNotNull() & ~c("document.pdf_sha256").eqNullSafe(F.col("sha256"))),
        ("error", "pdf_page_count_mismatch", pages != F.col("page_count")),
        ("error", "source_scope_out_of_range", c("generation.source_pages.to_pdf_index") >= pages),
        ("error", "approval_hash_mismatch", approved & ~c("approval.outline_sha256").eqNullSafe(F.col("payload_sha256"))),
        ("error", "approved_without_validation", approved & (c("validation.status") != "valid")),
        ("error", "approved_without_mapping", approved & (c("pagination.printed_to_physical_mapping_status") != "verified")),
    ])
    e = lambda path: F.col(f"e.{path}")
    origin = e("provenance.analytical_or_verbatim")
    rows = entries(contracts).join(contracts.select("key", pages.alias("pages")), "key")
    each = _rows(rows, F.concat(F.lit("$.entries["), e("entry_id"), F.lit("]")), [
        ("error", "source_evidence_out_of_range", e("provenance.source_pdf_index") >= F.col("pages")),
        ("error", "missing_verbatim_evidence", (origin == "verbatim") & _missing(e("provenance.raw_source_text"))),
        ("warning", "source_page_label_mismatch", ~_missing(e("provenance.source_page_label")) & ~_missing(e("printed_start.label")) & (e("provenance.source_page_label") != e("printed_start.label"))),
        ("warning", "boundary_requires_review", (origin == "analytical") & (e("boundary.status") == "proposed")),
        ("warning", "analytical_metadata_only", (origin == "analytical") & e("include") & ~e("boundary.allow_extraction")),
        ("error", "physical_page_out_of_range", e("physical_start") > F.col("pages")),
    ])
    return whole.unionByName(each)


def lifecycle(contracts: DataFrame, issues: DataFrame) -> DataFrame:
    """(key, state): how far a contract has come, the furthest state that holds."""
    n = issues.groupBy("key").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    got = contracts.where("doc is not null").join(n, "key", "left")
    c = lambda path: F.col(f"doc.{path}")
    valid, quiet = F.coalesce("errors", F.lit(0)) == 0, F.coalesce("warnings", F.lit(0)) == 0
    checked = (c("validation.status") == "valid") & valid
    state = F.when((c("approval.status") == "approved") & valid, "extraction_ready").when(c("pagination.printed_to_physical_mapping_status") == "verified", "page_mapped")
    state = state.when(c("approval.status") == "reviewed", "human_reviewed").when(checked & quiet, "source_checked").when(checked, "schema_valid")
    return got.select("key", state.otherwise("generated_candidate").alias("state"))


STAGES = ("candidate", "reviewed", "approved")


def storable(contracts: DataFrame, books: DataFrame, stage: str) -> DataFrame:
    """(key, refused): null where a contract may be stored at the stage, else why not.

    A reviewed contract needs a valid record of validation, no error against its book and an approval of reviewed or approved; an approved one
    must be ready for extraction. A contract that breaks the model isn't stored at any stage.
    """
    if stage not in STAGES:
        raise ValueError(f"{stage} is none of {', '.join(STAGES)}")
    issues = semantic_issues(contracts, books)
    bad = issues.where("severity = 'error'").select("key").distinct().withColumn("bad", F.lit(True))
    odd = model_issues(contracts).where("severity = 'error'").select("key").distinct().withColumn("odd", F.lit(True))
    got = contracts.join(bad, "key", "left").join(odd, "key", "left").join(lifecycle(contracts, issues), "key", "left")
    c = lambda path: F.col(f"doc.{path}")
    why = F.when(F.col("doc").isNull() | F.coalesce("odd", F.lit(False)), "breaks_model")
    if stage == "reviewed":
        why = why.when(~F.coalesce(c("approval.status").isin("reviewed", "approved"), F.lit(False)), "not_reviewed").when(~c("validation.status").eqNullSafe("valid"), "not_valid").when(F.coalesce("bad", F.lit(False)), "has_errors")
    if stage == "approved":
        why = why.when(~F.col("state").eqNullSafe("extraction_ready"), "not_ready")
    return got.select("key", why.alias("refused"))


def save_stage(contracts: DataFrame, books: DataFrame, root: str, stage: str, expected: int) -> tuple[int, DataFrame]:
    """Stores the contracts that pass the stage's gate beside those stored before, as the version after `expected`: (version, refused(key, refused)).

    Of a key the new text stays. All of it appears at once or, where another writer was first, not at all.
    """
    gate = storable(contracts, books, stage)
    new = contracts.join(gate.where("refused is null").select("key"), "key", "left_semi").select("key", F.col("raw").alias("json"))
    old = snapshots.load(contracts.sparkSession, root, stage, expected) if expected else None
    rows = new if old is None else old.join(new.select("key"), "key", "left_anti").unionByName(new)
    return snapshots.save(rows, root, stage, expected), gate.where("refused is not null")


def load_stage(spark, root: str, stage: str) -> DataFrame | None:
    """The contracts of a stage as read() gives them, None if nothing was stored."""
    rows = snapshots.load(spark, root, stage)
    return None if rows is None else read(rows)


def candidates(contracts: DataFrame, issues: DataFrame) -> DataFrame:
    """Draft rows of readable contracts: entries are included where they ask for it, may be extracted, and neither they nor their contract have an error.

    warning_codes holds the entry's own codes, those of its findings, and what its page and boundary lack.
    """
    flagged = issues.where("path <> '$'").groupBy("key", "path").agg(F.sort_array(F.collect_set("code")).alias("codes"), F.bool_or(F.col("severity") == "error").alias("bad"))
    spoilt = issues.where("path = '$' and severity = 'error'").select("key").distinct().withColumn("spoilt", F.lit(True))
    rows = entries(contracts.where("doc is not null")).withColumn("path", F.concat(F.lit("$.entries["), F.col("e.entry_id"), F.lit("]")))
    got = rows.join(flagged, ["key", "path"], "left").join(spoilt, "key", "left")
    e = lambda path: F.col(f"e.{path}")
    page, system, extract = e("printed_start.numeric"), e("printed_start.numbering_system"), e("boundary.allow_extraction")
    lacks = F.array_compact(F.array(F.when(page.isNull() & system.startswith("roman"), "roman_page").when(page.isNull(), "missing_printed_page"), F.when(~extract, "metadata_only_boundary")))
    codes = F.array_distinct(F.concat(e("quality.warning_codes"), F.coalesce("codes", F.array().cast("array<string>")), lacks))
    ready = e("include") & extract & ~F.coalesce("bad", F.lit(False)) & ~F.coalesce("spoilt", F.lit(False))
    return got.select(
        "key", F.col("pos").alias("sno"), e("title"), e("kind"), page.alias("printed"), F.coalesce(e("printed_start.label"), F.lit("")).alias("label"), e("physical_start").alias("physical"), e("pdf_page_index"),
        e("level"), e("quality.confidence"), ready.alias("include"), codes.alias("warning_codes"), e("sno").alias("source_sno"), F.coalesce(e("parent_sno"), F.lit("")).alias("parent_sno"), e("entry_id"),
        F.coalesce(e("parent_entry_id"), F.lit("")).alias("parent_entry_id"), e("provenance.source_type"), e("provenance.analytical_or_verbatim"), e("boundary.status").alias("boundary_status"), extract.alias("allow_extraction"),
    )
