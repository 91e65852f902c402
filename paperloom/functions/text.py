"""Column expressions that clean and measure text.

A Python-style word character is spelled ``[\\p{L}\\p{N}_]``: the plain class of
Java knows ASCII only, and its Unicode variant counts combining marks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom import settings as S

WORDCHAR = r"[\p{L}\p{N}_]"
ARXIV_ID = rf"(?i)arXiv:\d{{4}}\.\d{{4,5}}v\d+(?:\s*\[[\p{{L}}\p{{N}}_.-]+\])?(?:\s*\d+\s+{WORDCHAR}+\s+\d{{4}})?"
PAGE_NUMBER = r"^\s*\d{1,3}\s*$"
#: One class for the alternatives: a repeated group recurses, and a long address overflows the stack.
URL = r"https?://[a-z$-_@.&+!*\\(),]+"
EMAIL = r"\b[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
LATEX = r"\\[a-zA-Z]+\*?\s*(?:\s*\[[^\]]*\])?\s*(?:\s*\{[^}]*\})*+"
MATH = r"\$[^$]*\$\|\$\$[^$]*\$\$"
STRICT_MATH = r"\$\$[^$]*\$\$|\$[^$]*\$"
FIGURE = r"(?i)(?:Figure|Table|Fig\.|Tab\.)\s*\d+[:.]?\s*[^\n]*"
#: Here and below a possessive repeat is one that what follows can't match a part of.
HYPHEN = rf"(?<!{WORDCHAR})(\p{{L}}++)-\s*\n\s*(\p{{L}}++)(?!{WORDCHAR})"
#: Whatever is no letter, digit, underscore, white space or ASCII punctuation: one class,
#: as a look behind takes about as long as the whole chain of patterns before it.
STRAY = r"[^\x20-\x7E\x09-\x0D\p{L}\p{N}]"
#: A character that compatibility normalisation may change or combine: none of ASCII, of
#: Latin-1 but for its few compatibility characters, and of two letters beyond it.
UNSTABLE = r"[^\x00-\x7F](?<![\u00BF-\u00FF\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u0152\u0153])"
WHITE = " \t\n\x0b\f\r"


@F.pandas_udf(StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def tokens(text: Column) -> Column:
    """Maximal runs of word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDCHAR + "+"), F.lit(0))


def deaccented(text: Column) -> Column:
    """Letters of Latin scripts without their marks, and no combining marks."""
    plain = {}
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFKD", chr(code))
        if len(parts) > 1 and parts[0].isalpha() and all(unicodedata.combining(c) for c in parts[1:]):
            plain[chr(code)] = parts[0]
    marks = "".join(chr(code) for code in range(0x300, 0x370))
    return F.translate(text, "".join(plain) + marks, "".join(plain.values()))


def normalize_unicode(text: Column, compatibility: bool = True) -> Column:
    """Compatibility normalisation, then the replacement lists.

    Python is handed only the texts with a character that the normal form may
    change (null for all others).  The lists are gone through only for texts
    with a character of theirs.
    """
    if compatibility:
        text = F.coalesce(_nfkc(F.when(text.rlike(UNSTABLE), text)), text)
    one = "".join(k for k, v in S.SAME_LENGTH.items() if v)
    gone = "".join(k for k, v in S.SAME_LENGTH.items() if not v)
    out = F.translate(text, one + gone, "".join(v for v in S.SAME_LENGTH.values() if v))
    for old, new in S.LONGER.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    listed = "".join(sorted({*S.SAME_LENGTH, *S.LONGER}))
    return F.when(F.contains(text, F.lit("`")) | text.rlike(rf"[^\x00-\x7F](?<=[{listed}])"), out).otherwise(text)


def remove_artifacts(text: Column, strict_math: bool = False, captions: bool = False) -> Column:
    """Identifiers, page numbers, addresses, LaTeX and stray characters, in this order.

    The default math pattern ends in a literal bar and so never matches plain
    ``$x$``; ``strict_math`` is what it was meant to be.  ``captions`` also
    removes figure and table captions.
    """
    out = F.regexp_replace(text, ARXIV_ID, "")
    out = F.regexp_replace(out, f"(?md){PAGE_NUMBER}", "")
    out = F.regexp_replace(out, URL, "[URL]")
    out = F.regexp_replace(out, EMAIL, "[EMAIL]")
    out = F.regexp_replace(out, LATEX, " ")
    out = F.regexp_replace(out, STRICT_MATH if strict_math else MATH, " [MATH] ")
    if captions:
        out = F.regexp_replace(out, FIGURE, "")
    return F.regexp_replace(out, STRAY, " ")


def fix_hyphenation(text: Column) -> Column:
    return F.regexp_replace(text, HYPHEN, "$1$2")


def normalize_whitespace(text: Column) -> Column:
    """Join hyphenated words, then tidy blank lines and runs of spaces."""
    out = F.regexp_replace(fix_hyphenation(text), r"\n\s*\n\s*\n+", "\n\n")
    out = F.regexp_replace(out, r"\s{3,}", " ")
    out = F.regexp_replace(out, r"(?md)^[^\S\n]++|[^\S\n]++$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\n+", "")


def clean_text(text: Column, compatibility: bool = True) -> Column:
    """The whole cleaner; null and blank texts become empty."""
    out = strip(normalize_whitespace(remove_artifacts(normalize_unicode(text, compatibility))))
    return F.when(text.isNull() | ~text.rlike(r"\S"), F.lit("")).otherwise(out)


def issue_list(*issues: Column) -> Column:
    """The non-null ones, in order."""
    return F.array_compact(F.array(*issues))


def assess(text: Column, original: Column | None = None) -> Column:
    """struct<length, word_count, issues, score> of a cleaned text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    measured = F.struct(
        F.length(text).alias("length"),
        F.size(words).alias("word_count"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))).alias("letters"),
        F.size(F.filter(words, lambda w: F.length(w) == 1)).alias("single"),
        F.size(F.array_distinct(words)).alias("different"),
    )

    def judge(m: Column) -> Column:
        n, w = F.greatest(m["length"], F.lit(1)), F.greatest(m["word_count"], F.lit(1))
        checks = [
            (m["length"] < S.MIN_TEXT_CHARS, "too_short", 0.3),
            (m["letters"] / n < 0.6, "low_alpha_ratio", 0.5),
            (m["single"] / w > 0.1, "potential_gibberish", 0.4),
            (m["different"] / w < 0.3, "excessive_repetition", 0.6),
        ]
        score = F.lit(1.0)
        for condition, _, factor in checks:
            score = score * F.when(condition, F.lit(factor)).otherwise(F.lit(1.0))
        issues = issue_list(*[F.when(c, F.lit(name)) for c, name, _ in checks])
        return F.struct(m["length"].alias("length"), m["word_count"].alias("word_count"), issues.alias("issues"), score.alias("score"))

    # one element, so that what is measured is computed once
    judged = F.transform(F.array(measured), judge)[0]
    if original is None:
        return judged
    empty = lambda issue: F.struct(F.lit(0).alias("length"), F.lit(0).alias("word_count"), F.array(F.lit(issue)).alias("issues"), F.lit(0.0).alias("score"))
    return F.when(original.isNull() | (original == ""), empty("no_text")).when(~original.rlike(r"\S"), empty("empty_text")).otherwise(judged)


def sanitize_filename(name: Column) -> Column:
    return F.trim(F.translate(name, '<>:"/\\|?*', "_" * 9))


def content_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def paper_hash(title: Column, authors: Column, published: Column) -> Column:
    return F.md5(F.concat_ws("_", F.lower(F.trim(F.coalesce(title, F.lit("")))), F.coalesce(F.get(authors, F.lit(0)), F.lit("")), F.coalesce(F.year(published).cast("string"), F.lit(""))))


def arxiv_id_from_filename(name: Column) -> Column:
    """The id of ``2301.12345v2.pdf`` or ``10.48550_arXiv.2301.12345.pdf``; else null."""
    versioned = F.regexp_extract(name, r"^(\d{4}\.\d{5}v\d+)\.pdf$", 1)
    archived = F.regexp_extract(name, r"^10\.48550_arXiv\.(\d{4}\.\d{5})\.pdf$", 1)
    return F.coalesce(F.nullif(versioned, F.lit("")), F.nullif(archived, F.lit("")))
