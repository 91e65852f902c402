"""Quality scores: one pass measures a text, all scores read the measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import settings as S
from paperloom.functions.text import WORDCHAR, issue_list, tokens, word_count

SPECIAL = r"[^\p{L}\p{N}_\s.,!?:;\"'()\[\]{}-]"
#: The repeat is possessive: Java matches a repeated group by recursion otherwise, and a run of
#: some thousand words overflows the stack, which ends the executor.
SHORT_RUN = rf"(?<!{WORDCHAR})[a-z]{{1,2}}(?!{WORDCHAR})(?:\s+[a-z]{{1,2}}(?!{WORDCHAR})){{3,}}+"


def _has(words: Column, listed: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))


def measures(text: Column) -> Column:
    """Every count that a score needs, as one narrow struct."""
    tail = F.when(F.length(text) > 200, F.regexp_replace(F.right(text, F.lit(200)), r"\s+$", "")).otherwise(text)
    low = F.lower(text)
    # the long pattern runs only where one of its phrases stands somewhere
    some_phrase = reduce(Column.__or__, [F.contains(low, F.lit(p.replace("\\", ""))) for p in S.ACADEMIC_PHRASES.split("|")])

    def of_tokens(t: Column) -> Column:
        return F.struct(
            F.size(F.filter(t, lambda w: w.isin(S.COMMON_WORDS))).alias("common"),
            (_has(t, S.ARTICLES)).cast("int").alias("articles"),
            (_has(t, S.PREPOSITIONS)).cast("int").alias("prepositions"),
            (_has(t, S.METHOD_TERMS)).cast("int").alias("method_terms"),
            (_has(t, S.RESEARCH_VERBS)).cast("int").alias("research_verbs"),
        )

    return F.struct(
        F.length(text).alias("chars"),
        word_count(text).alias("words"),
        F.transform(F.array(tokens(text)), of_tokens)[0].alias("t"),
        F.when(some_phrase, text.rlike(rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{S.ACADEMIC_PHRASES}){WORDCHAR}")).otherwise(F.lit(False)).cast("int").alias("phrases"),
        F.regexp_count(text, F.lit(SPECIAL)).alias("special"),
        F.regexp_count(text, F.lit(r"(.)\1{4,}")).alias("repeated"),
        F.regexp_count(text, F.lit(SHORT_RUN)).alias("short_runs"),
        F.regexp_count(text, F.lit(r"(?md)^\s*\d+\s*$")).alias("page_lines"),
        F.substring(tail, -1, 1).isin(".", "!", "?", '"', "'").alias("ended"),
        F.array(*[F.contains(low, F.lit(mark)) for mark in S.TRUNCATION_MARKS]).alias("truncated"),
        text.rlike(r"\S").alias("filled"),
    )


def _product(*factors: tuple[Column, float]) -> Column:
    out = F.lit(1.0)
    for condition, factor in factors:
        out = out * F.when(condition, F.lit(factor)).otherwise(F.lit(1.0))
    return out


def _ratio(value: Column) -> Column:
    """Two decimals of a share below 2 to the 26th, rounded as the binary number it is; an exact half goes to the even digit.

    Java rounds the shortest decimal digits: 0.145 is a little less than its
    digits say, and becomes 0.15 there.  So the value is held against the half
    between two hundredths in two pieces whose products are exact.
    """
    low = F.floor(value * 100)
    high = F.floor(value * (1 << 26)) / F.lit(float(1 << 26))
    past = (high * 200 - (low * 2 + 1)) + (value - high) * 200
    return F.format_string("%.2f", (low + F.when((past > 0) | ((past == 0) & (low % 2 == 1)), 1).otherwise(0)) / F.lit(100.0))


def length(m: Column) -> tuple[Column, Column]:
    n = m["chars"]
    score = F.when(n < S.MIN_TEXT_CHARS, 0.0).when(n < S.SHORT_TEXT_CHARS, 0.4).when(n > S.MAX_TEXT_CHARS, 0.6).when(n > S.LONG_TEXT_CHARS, 0.8).otherwise(1.0)
    few = m["words"] < S.MIN_WORDS
    issues = issue_list(
        F.when(n < S.MIN_TEXT_CHARS, F.concat(F.lit("text_too_short_"), n.cast("string"), F.lit("_chars"))).when(n < S.SHORT_TEXT_CHARS, F.lit("text_short")).when(n > S.MAX_TEXT_CHARS, F.concat(F.lit("text_too_long_"), n.cast("string"), F.lit("_chars"))),
        F.when(few, F.concat(F.lit("low_word_count_"), m["words"].cast("string"))),
    )
    return F.when(few, F.least(score, F.lit(0.3))).otherwise(score), issues


def readability(m: Column) -> tuple[Column, Column]:
    width = m["chars"] / F.greatest(m["words"], F.lit(1))
    groups = (m["t"]["common"] > 0).cast("int") + m["t"]["articles"] + m["t"]["prepositions"]
    special = m["special"] / F.greatest(m["chars"], F.lit(1))
    score = _product((width < 3, 0.6), (width > 15, 0.7), (groups <= 1, 0.2), (groups == 2, 0.6), (special > 0.1, 0.5), (m["repeated"] > 5, 0.7))
    issues = issue_list(
        F.when(width < 3, F.lit("very_short_words")).when(width > 15, F.lit("very_long_words")),
        F.when(groups <= 1, F.lit("likely_non_english")).when(groups == 2, F.lit("possibly_non_english")),
        F.when(special > 0.1, F.concat(F.lit("excessive_special_chars_"), _ratio(special))),
        F.when(m["repeated"] > 5, F.lit("repeated_char_patterns")),
    )
    return F.when(m["filled"], score).otherwise(F.lit(0.0)), F.when(m["filled"], issues).otherwise(F.array(F.lit("empty_text")))


def structure(m: Column, sections: Column | None = None) -> tuple[Column, Column]:
    """sections: names of the paper's sections (null or empty: not looked at)."""
    groups = m["t"]["method_terms"] + m["t"]["research_verbs"] + m["phrases"]
    score = F.lit(0.5) + F.when(groups == 3, 0.4).when(groups == 2, 0.3).when(groups == 1, 0.1).otherwise(0.0)
    missing = F.lit(None).cast("string")
    if sections is not None:
        found = F.size(F.array_intersect(sections, F.array(*[F.lit(s) for s in S.KEY_SECTIONS])))
        looked = F.coalesce(F.size(sections) > 0, F.lit(False))
        score = F.when(looked & (found >= 3), F.least(score + 0.3, F.lit(1.0))).when(looked & (found == 2), F.least(score + 0.1, F.lit(1.0))).otherwise(score)
        missing = F.when(looked & (found < 2), F.lit("missing_key_sections"))
    score = score * _product((m["short_runs"] > 10, 0.7), (m["page_lines"] > 20, 0.8))
    issues = issue_list(F.when(groups == 0, F.lit("lacks_academic_indicators")), missing, F.when(m["short_runs"] > 10, F.lit("broken_word_patterns")), F.when(m["page_lines"] > 20, F.lit("excessive_page_numbers")))
    return score, issues


def completeness(m: Column) -> tuple[Column, Column]:
    marks = [(m["truncated"][k], mark) for k, mark in enumerate(S.TRUNCATION_MARKS)]
    score = _product((~m["ended"], 0.8), *[(c, 0.3) for c, _ in marks], (m["words"] < 200, 0.4), ((m["words"] >= 200) & (m["words"] < 500), 0.7))
    issues = issue_list(F.when(~m["ended"], F.lit("abrupt_ending")), *[F.when(c, F.lit(f"truncation_indicator_{mark}")) for c, mark in marks], F.when(m["words"] < 200, F.lit("likely_incomplete")).when(m["words"] < 500, F.lit("possibly_incomplete")))
    return score, issues


def language(m: Column, target: str = "en") -> tuple[Column, Column]:
    if target != "en":
        return F.lit(1.0), F.array().cast("array<string>")
    ratio = m["t"]["common"] / m["words"]
    some = m["words"] > 0
    score = F.when(some & (ratio < 0.1), 0.1).when(some & (ratio < 0.3), 0.5).otherwise(1.0)
    issue = F.when(some & (ratio < 0.1), F.concat(F.lit("low_english_ratio_"), _ratio(ratio))).when(some & (ratio < 0.3), F.concat(F.lit("moderate_english_ratio_"), _ratio(ratio)))
    return score, issue_list(issue)


def assessment(m: Column, sections: Column | None = None) -> Column:
    """All five scores, the weighted one, issues and advice, from the measures."""
    parts = {"length": length(m), "readability": readability(m), "structure": structure(m, sections), "completeness": completeness(m), "language": language(m)}
    overall = None
    for name, weight in S.WEIGHTS.items():
        term = parts[name][0] * F.lit(weight)
        overall = term if overall is None else overall + term
    return F.struct(
        *[parts[name][0].alias(f"{name}_score") for name in parts],
        overall.alias("overall_score"),
        F.concat(*[parts[name][1] for name in parts]).alias("issues"),
        issue_list(*[F.when(parts[name][0] < 0.5, F.lit(text)) for name, text in S.ADVICE.items()]).alias("recommendations"),
    )


def category_check(categories: Column) -> Column:
    """struct<ok, issue>: target categories pass, related ones pass with a note."""
    target = F.arrays_overlap(categories, F.array(*[F.lit(c) for c in S.TARGET_CATEGORIES]))
    related = F.arrays_overlap(categories, F.array(*[F.lit(c) for c in S.RELATED_CATEGORIES]))
    none = categories.isNull() | (F.size(categories) == 0)
    ok = F.when(none, False).otherwise(F.coalesce(target | related, F.lit(False)))
    issue = F.when(none, F.lit("no_categories")).when(target, F.lit(None)).when(related, F.lit("related_categories_only")).otherwise(F.concat(F.lit("unrelated_categories_"), F.array_join(categories, ",")))
    return F.struct(ok.alias("ok"), issue.alias("issue"))


def decision(quality: Column, categories: Column | None = None, least: float = S.ACCEPT_SCORE) -> Column:
    """struct<accepted, reason>: categories (unless empty), the score, then critical issues."""
    critical = F.filter(quality["issues"], lambda i: i.rlike("|".join(S.CRITICAL_ISSUES)))
    score = quality["overall_score"]
    cases = []
    if categories is not None:
        check = category_check(categories)
        cases.append((F.coalesce(F.size(categories) > 0, F.lit(False)) & ~check["ok"], F.concat(F.lit("Category filter: "), check["issue"])))
    cases.append((score < least, F.concat(F.lit("Quality score "), _ratio(score), F.lit(f" below threshold {least}"))))
    cases.append((F.size(critical) > 0, F.concat(F.lit("Critical issue: "), F.get(critical, F.lit(0)))))
    reason = F.lit("Passed quality filters")
    accepted = F.lit(True)
    for condition, text in reversed(cases):
        reason, accepted = F.when(condition, text).otherwise(reason), F.when(condition, F.lit(False)).otherwise(accepted)
    return F.struct(accepted.alias("accepted"), reason.alias("reason"))
