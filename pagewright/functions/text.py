"""Titles, labels, names and other text as Column expressions; nothing here leaves the JVM.

White space and digits follow Unicode ((?U)) where the model's own rules do. A null input gives null
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ROMAN = "[ivxlcdmIVXLCDM]+"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten"
PREFIX_KINDS = (("appendix", "appendix"), ("bibliography", "bibliography"), ("references", "bibliography"), ("notes", "notes"), ("index", "index"))
CAPTIONS = "MAP|CHART|FIGURE|TABLE|PLATE"
BOLD_FONTS = "bold|black|demi|heavy"
SNIPPET_BEFORE, SNIPPET_AFTER = 80, 120


def casefold(c: Column) -> Column:
    """Lower case with the sharp s spelt out, so that it compares like its capital form."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalize_title(c: Column) -> Column:
    return F.translate(squeeze(c), "–", "—")


def merge_key(c: Column) -> Column:
    """Titles with equal keys count as the same title; a title without a-z or 0-9 has an empty key."""
    return F.trim(F.regexp_replace(casefold(c), "[^a-z0-9]+", " "))


def slugify(c: Column, most: int = 80) -> Column:
    s = F.translate(F.lower(F.trim(c)), "—–", "--")
    s = F.regexp_replace(F.regexp_replace(s, r"^\[[a-z]+\]\s*", ""), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.substring(F.when(s == "", "section").otherwise(s), 1, most)


def section_filename(sno: Column, title: Column) -> Column:
    return F.format_string("%03d_%s.txt", sno, slugify(title))


def is_boldish(font: Column) -> Column:
    return F.coalesce(F.lower(font).rlike(BOLD_FONTS), F.lit(False))


def centeredness(x0: Column, x1: Column, width: Column) -> Column:
    """1 in the middle of a page of that width, 0 at its edges."""
    half = width / 2
    return 1 - F.least(F.lit(1.0), F.abs((x0 + x1) / 2 - half) / half)


def page_label(c: Column) -> Column:
    """struct(page, label, code): Arabic labels have a page, Roman ones are lower-cased, others are ambiguous."""
    s = F.trim(c)
    arabic, roman = s.rlike(r"^\d{1,6}$"), s.rlike(f"^{ROMAN}$")
    return F.struct(
        F.when(arabic, s.try_cast("int")).alias("page"),
        F.when(roman, F.lower(s)).otherwise(s).alias("label"),
        F.when(arabic, F.lit(None).cast("string")).when(roman, "roman_page").otherwise("ambiguous_page").alias("code"),
    )


def structure(title: Column) -> Column:
    """struct(kind, level, matched): what a title says of its place in the book."""
    t = F.trim(title)
    word = F.lower(F.regexp_extract(t, rf"(?i)^(part|chapter)\s+(\d+|[ivxlcdm]+|{NUMBER_WORDS})", 1))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)[.)]?\s+\S", 1)
    kind = F.when(word != "", word).when(number != "", "section")
    for prefix, name in PREFIX_KINDS:
        kind = kind.when(casefold(t).startswith(prefix), name)
    level = F.when(word == "chapter", 2).when(word == "part", 1).when(number != "", F.size(F.split(number, r"\."))).otherwise(1)
    return F.struct(kind.otherwise("section").alias("kind"), level.alias("level"), ((word != "") | (number != "")).alias("matched"))


def standard_heading(line: Column) -> Column:
    """struct(title, kind) of a heading line: parts, chapters, front matter, captions and zones in standard form."""
    raw = normalize_title(line)
    part = lambda p, i: F.regexp_extract(raw, p, i)
    joined = lambda head, rest: F.when(F.trim(rest) != "", F.concat(head, F.lit(" — "), F.trim(rest))).otherwise(head)
    p, c = r"(?i)^\s*PART\s+([IVXLC]+|\d+)\b[:\-]?\s*(.*)$", r"(?i)^\s*CHAPTER\s+(\d+|[IVXLC]+)\b[:\-]?\s*(.*)$"
    cap, z = rf"(?i)^\s*({CAPTIONS})\s+([0-9]+[A-Z]?)\b[:\-]?\s*(.*)$", r"^\s*(?:Zone|ZONE)\s+(\d+)\b[:\-]?\s*(.*)$"
    label = F.upper(part(cap, 1))
    named = F.concat(F.lit("["), label, F.lit("] "), F.initcap(F.lower(label)), F.lit(" "), part(cap, 2))
    cases = [
        (raw.rlike(p), joined(F.concat(F.lit("Part "), part(p, 1)), part(p, 2)), "heading"),
        (raw.rlike(c), joined(F.concat(F.lit("Chapter "), part(c, 1)), part(c, 2)), "heading"),
        (raw.rlike(r"(?i)^\s*INTRODUCTION\b"), F.lit("Introduction"), "heading"),
        (raw.rlike(r"(?i)^\s*ACKNOWLEDGE?MENTS?\b"), F.lit("Acknowledgments"), "heading"),
        (raw.rlike(cap), F.when(F.trim(part(cap, 3)) != "", F.concat(named, F.lit(": "), F.trim(part(cap, 3)))).otherwise(named), "caption"),
        (raw.rlike(z), joined(F.concat(F.lit("Zone "), part(z, 1)), part(z, 2)), "zone"),
    ]
    title, kind = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for cond, t, k in cases[1:]:
        title, kind = title.when(cond, t), kind.when(cond, k)
    return F.struct(normalize_title(title.otherwise(raw)).alias("title"), kind.otherwise("heading").alias("kind"))


def toc_line(line: Column) -> Column:
    """struct(title, page) of a contents line with dot leaders, else null."""
    s = squeeze(line)
    pattern = r"^(.+?)\s*\.{2,}\s*(\d{1,4})\s*$"
    title = F.trim(F.regexp_extract(s, pattern, 1))
    return F.when(s.rlike(pattern) & (F.length(title) >= 3), F.struct(title.alias("title"), F.regexp_extract(s, pattern, 2).cast("int").alias("page")))


def word_list(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(word_list(c))


def paragraphs(c: Column, blank: str = "\n\n") -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), blank), lambda p: F.trim(p) != "")


def snippet(body: Column, query: str) -> Column:
    """The text around the first hit in the body (its start where only the title matches), on one line."""
    at = F.greatest(F.position(casefold(F.lit(query)), casefold(body)) - 1, F.lit(0)) if query else F.lit(0)
    begin = F.greatest(at - SNIPPET_BEFORE, F.lit(0))
    end = at + max(len(query), 1) + SNIPPET_AFTER
    return F.translate(F.substring(body, begin + 1, end - begin), "\n", " ")


def clean_text(c: Column) -> Column:
    """Lower case, dashes as spaces, only a-z, 0-9, apostrophes and single spaces."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[–—-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9' ]+", " "), " +", " "))


def normalize_phrase(tokens: Column) -> Column:
    kept = F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9-]", ""))
    return F.array_join(F.filter(kept, lambda t: (t != "") & ~t.rlike("^[0-9]+$")), " ")


def printed_range(c: Column) -> Column:
    """struct(first, last) of "a:b" with 1 <= a <= b, else null."""
    a, b = (F.regexp_extract(c, r"^\s*(\d+)\s*:\s*(\d+)\s*$", i).try_cast("int") for i in (1, 2))
    return F.when((a >= 1) & (a <= b), F.struct(a.alias("first"), b.alias("last")))


def book_id(content_hash: Column) -> Column:
    return F.concat(F.lit("book-"), F.substring(content_hash, 1, 16))


def looks_like_index(c: Column) -> Column:
    """Eight lines or more, of which 35 % have a comma and a digit near the end."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    hits = F.filter(lines, lambda x: x.contains(",") & F.right(F.rtrim(x), F.lit(20)).rlike("[0-9]"))
    return (F.size(lines) >= 8) & (F.size(hits) >= 0.35 * F.size(lines))
