"""Bibliographies as column expressions: the reference list, its entries, inline marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import settings as S
from paperloom.functions.text import strip

LIST_HEADERS = (r"references?", r"bibliography", r"\d+\.?\s*references?", r"\d+\.?\s*bibliography")
ENTRY_NUMBER = r"[\[\(]?\d+[\]\)]?"
AUTHOR = r"([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def reference_section(text: Column) -> Column:
    """The text behind the first reference header (up to an appendix); without a header, at
    least three entry-like lines at the end; else null."""
    found = []
    for header in LIST_HEADERS:
        parts = F.split(text, rf"(?i)\n\s*{header}\s*\n", 2)
        found.append(F.get(parts, F.lit(1)))
    listed = F.get(F.split(strip(F.coalesce(*found)), r"(?i)\n\s*appendix\s*\n", 2), F.lit(0))

    kept = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("refs"), F.lit(False).alias("inside"), F.lit(False).alias("done"))

    def scan(acc: Column, line: Column) -> Column:
        like = line.rlike(rf"^{ENTRY_NUMBER}|\(\d{{4}}\)") | F.lower(line).rlike("doi:|arxiv:")
        stop = acc["done"] | (~like & acc["inside"] & (F.size(acc["refs"]) > 3))
        refs = F.when(stop, acc["refs"]).when(like, F.concat(acc["refs"], F.array(line))).when(acc["inside"], F.array().cast("array<string>")).otherwise(acc["refs"])
        return F.struct(refs.alias("refs"), F.when(stop, acc["inside"]).otherwise(like).alias("inside"), stop.alias("done"))

    tail = F.aggregate(F.reverse(kept), start, scan, lambda acc: acc["refs"])
    ending = F.transform(F.array(tail), lambda r: F.when(F.size(r) >= 3, F.array_join(F.reverse(r), "\n")))[0]
    return F.coalesce(listed, ending)


def tidy_references(section: Column) -> Column:
    """White space becomes single spaces, line breaks too; ten characters or fewer are dropped."""
    flat = strip(F.regexp_replace(F.coalesce(section, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > 10, flat).otherwise(F.lit(""))


def entries(section: Column) -> Column:
    """The entries of a reference list, without their numbers; shorter than 20 characters are skipped."""
    numbered = F.split(section, rf"\n\s*{ENTRY_NUMBER}\s*")
    pieces = F.when(F.size(numbered) < 2, F.split(section, "\n\n")).otherwise(numbered)
    long = F.filter(F.transform(pieces, strip), lambda p: F.length(p) >= 20)
    return F.filter(F.transform(long, lambda p: F.regexp_replace(p, rf"^\s*{ENTRY_NUMBER}\s*", "")), lambda p: p != "")


def parse_entry(raw: Column, fix_year: bool = False) -> Column:
    """The fields of one entry as a struct.

    A year outside parentheses is read as its first two digits, as published
    results have it; ``fix_year`` reads all four.
    """
    text = strip(raw)
    in_parens = _group(text, r"\((\d{4})\)").cast("int")
    loose = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    last = F.get(F.reverse(loose), F.lit(0))
    standalone = (last if fix_year else F.substring(last, 1, 2)).cast("int")
    doi, arxiv, url = _group(text, r"(?i)doi:\s*(10\.\d+/\S+)"), _group(text, r"(?i)arxiv:\s*(\d{4}\.\d{4,5})"), _group(text, r"https?://\S+", 0)
    quoted = _group(text, r'"([^"]{10,200})"')
    year = F.coalesce(in_parens, standalone)
    named = F.when(year.isNotNull(), F.replace(text, F.concat(F.lit("("), year.cast("string"), F.lit(")")), F.lit(""))).otherwise(text)
    named = F.when(quoted.isNotNull(), F.replace(named, F.concat(F.lit('"'), strip(quoted), F.lit('"')), F.lit(""))).otherwise(named)
    authors = F.slice(F.regexp_extract_all(F.substring(named, 1, 200), F.lit(AUTHOR), F.lit(1)), 1, 5)
    low = F.lower(text)
    journal, conference = low.rlike("|".join(S.JOURNAL_WORDS)), low.rlike("|".join(S.CONFERENCE_WORDS))
    both = r"(\d+)\s*\((\d+)\):\s*(\d+[-–]\d+)"
    volume, pages = _group(text, both, 1), _group(text, both, 3)
    given = lambda c, gain: F.when(c, F.lit(gain)).otherwise(F.lit(0.0))
    confidence = (
        F.lit(0.5)
        + F.when(in_parens.isNotNull(), 0.2).when(standalone.isNotNull(), 0.1).otherwise(0.0)
        + given(doi.isNotNull(), 0.3)
        + given(arxiv.isNotNull(), 0.3)
        + given(url.isNotNull(), 0.1)
        + given(quoted.isNotNull(), 0.2)
        + given(F.size(authors) > 0, 0.2)
        + given(journal | conference, 0.1)
        + given(volume.isNotNull(), 0.1)
    )
    return F.struct(
        text.alias("raw_text"),
        authors.alias("authors"),
        strip(quoted).alias("title"),
        year.alias("year"),
        F.lit(None).cast("string").alias("venue"),
        F.coalesce(volume, _group(text, r"(?i)vol\.?\s*(\d+)")).alias("volume"),
        F.when(volume.isNotNull(), pages).otherwise(_group(text, r"(?i)pp?\.?\s*(\d+[-–]\d+)")).alias("pages"),
        doi.alias("doi"),
        arxiv.alias("arxiv_id"),
        url.alias("url"),
        F.when(journal, "journal").when(conference, "conference").when(arxiv.isNotNull(), "arxiv").otherwise("misc").alias("citation_type"),
        confidence.alias("confidence"),
    )


def citations(section: Column, per_entry: bool = False, fix_year: bool = False) -> Column:
    """Parsed entries.  The default tidies the list first, which joins it into one entry at
    most, as published results have it; ``per_entry`` parses every entry of the raw list."""
    source = section if per_entry else tidy_references(section)
    return F.transform(F.coalesce(entries(source), F.array().cast("array<string>")), lambda e: parse_entry(e, fix_year))


def normalized(parsed: Column) -> Column:
    """Entries with a number from 1, a rounded confidence and whether they are usable."""
    valid = lambda c: (c["confidence"] > 0.3) & (c["year"].isNotNull() | c["arxiv_id"].isNotNull())
    return F.transform(parsed, lambda c, i: F.struct((i + 1).alias("id"), c["raw_text"].alias("raw_text"), c["authors"].alias("authors"), c["title"].alias("title"), c["year"].alias("year"), c["venue"].alias("venue"), c["volume"].alias("volume"), c["pages"].alias("pages"), c["doi"].alias("doi"), c["arxiv_id"].alias("arxiv_id"), c["url"].alias("url"), c["citation_type"].alias("type"), F.round(c["confidence"], 2).alias("confidence"), valid(c).alias("is_valid")))


def statistics(parsed: Column) -> Column:
    """Counts, mean confidence, types, range of years, and whether any has an arXiv id or DOI."""
    years = F.filter(F.transform(parsed, lambda c: c["year"]), lambda y: y.isNotNull())
    types = F.array_sort(F.array_distinct(F.transform(parsed, lambda c: c["citation_type"])))
    total = F.size(parsed)
    return F.struct(
        total.alias("total_citations"),
        F.size(F.filter(parsed, lambda c: c["confidence"] > 0.3)).alias("valid_citations"),
        F.when(total > 0, F.round(F.aggregate(parsed, F.lit(0.0), lambda a, c: a + c["confidence"]) / total, 2)).alias("avg_confidence"),
        F.map_from_arrays(types, F.transform(types, lambda t: F.size(F.filter(parsed, lambda c: c["citation_type"] == t)))).alias("types"),
        F.when(F.size(years) > 0, F.struct(F.array_min(years).alias("min"), F.array_max(years).alias("max"))).alias("years_range"),
        F.exists(parsed, lambda c: c["arxiv_id"].isNotNull()).alias("has_arxiv"),
        F.exists(parsed, lambda c: c["doi"].isNotNull()).alias("has_doi"),
    )


def inline_citations(text: Column) -> Column:
    """Array of struct<citation, position>: every number of ``[1, 2]``, then ``(Name, 2020)``.

    A position is the character offset of the match: the lengths of all pieces
    before it, and of the matches between them.
    """
    def places(pattern: str, items) -> Column:
        matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        gaps = F.transform(F.split(text, pattern), F.length)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<citation:string,position:int>>").alias("out"))
        step = lambda acc, m, g: F.struct((acc["at"] + g + F.length(m)).alias("at"), F.concat(acc["out"], F.transform(items(m), lambda c: F.struct(c.alias("citation"), (acc["at"] + g).alias("position")))).alias("out"))
        pairs = F.transform(matches, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("g")))
        return F.aggregate(pairs, start, lambda acc, p: step(acc, p["m"], p["g"]), lambda acc: acc["out"])

    numbers = places(r"\[\d+(?:,\s*\d+)*+\]", lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("["), n.cast("bigint").cast("string"), F.lit("]"))))
    named = places(r"\([A-Z][a-z]+(?:\s+et\s+al\.)?,?\s+\d{4}\)", lambda m: F.array(m))
    return F.concat(numbers, named)
