"""Registered queries of the cleaning and quality operators, with their DuckDB twins."""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import settings as S
from paperloom.functions import quality as Q
from paperloom.functions import text as T
from paperloom.operators import corpus as C
from paperloom.plans.papers import FULL_TEXT, PAPERS_SQL, papers
from paperloom.session import read_table, read_texts


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸŒ"
_REPEATS = "|".join(re.escape(c).replace("'", "''") + "{5,}" for c in string.ascii_letters + string.digits + string.punctuation + " " + _ACCENTED)


def measures_sql(source: str, text: str, keep: str) -> str:
    """The CTEs t and m: measures of the column ``text`` of ``source``."""
    tail = f"CASE WHEN length({text}) > 200 THEN regexp_replace(right({text}, 200), '\\s+$', '') ELSE {text} END"
    return rf"""
t AS (SELECT {keep}, coalesce({text}, '') AS x, regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+') AS tok, {tail} AS tail FROM {source}),
m AS (SELECT * EXCLUDE (tok, tail), length(x) AS chars, len(regexp_extract_all(x, '\S+')) AS words,
  len(list_filter(tok, lambda w: list_contains({_listed(S.COMMON_WORDS)}, w))) AS common,
  list_has_any(tok, {_listed(S.ARTICLES)})::INT AS articles, list_has_any(tok, {_listed(S.PREPOSITIONS)})::INT AS prepositions,
  list_has_any(tok, {_listed(S.METHOD_TERMS)})::INT AS method_terms, list_has_any(tok, {_listed(S.RESEARCH_VERBS)})::INT AS research_verbs,
  regexp_matches(x, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{S.ACADEMIC_PHRASES})[\p{{L}}\p{{N}}_]')::INT AS phrases,
  length(x) - length(regexp_replace(x, '[^\p{{L}}\p{{N}}_\s.,!?:;"''()\[\]{{}}-]', '', 'g')) AS special,
  len(regexp_extract_all(x, '{_REPEATS}')) AS repeated,
  len(regexp_extract_all(regexp_replace(x, '[À-ÖØ-öø-ÿĀ-ž]', 'Z', 'g'), '\b[a-z]{{1,2}}\b(?:\s+[a-z]{{1,2}}\b){{3,}}')) AS short_runs,
  len(regexp_extract_all(x, '(?m)^\s*\d+\s*$')) AS page_lines,
  right(tail, 1) IN ('.', '!', '?', '"', '''') AS ended,
  list_transform({_listed(S.TRUNCATION_MARKS)}, lambda k: contains(lower(x), k)) AS truncated,
  regexp_matches(x, '\S') AS filled FROM t),
r AS (SELECT *, chars::DOUBLE / greatest(words, 1) AS width, (common > 0)::INT + articles + prepositions AS english,
  special::DOUBLE / greatest(chars, 1) AS special_ratio, method_terms + research_verbs + phrases AS academic, common::DOUBLE / words AS ratio FROM m)"""


def _f(*cases: tuple[str, float]) -> str:
    return " * ".join(["1.0::DOUBLE", *[f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 1.0::DOUBLE END" for c, v in cases]])


def _issues(*items: str) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda i: i IS NOT NULL)"


SCORES_SQL = {
    "length": (
        "CASE WHEN words < 100 THEN least(0.3::DOUBLE, CASE WHEN chars < 500 THEN 0.0 WHEN chars < 1000 THEN 0.4 WHEN chars > 100000 THEN 0.6 WHEN chars > 50000 THEN 0.8 ELSE 1.0 END::DOUBLE) ELSE CASE WHEN chars < 500 THEN 0.0 WHEN chars < 1000 THEN 0.4 WHEN chars > 100000 THEN 0.6 WHEN chars > 50000 THEN 0.8 ELSE 1.0 END::DOUBLE END",
        _issues("CASE WHEN chars < 500 THEN 'text_too_short_' || chars || '_chars' WHEN chars < 1000 THEN 'text_short' WHEN chars > 100000 THEN 'text_too_long_' || chars || '_chars' END", "CASE WHEN words < 100 THEN 'low_word_count_' || words END"),
    ),
    "readability": (
        f"CASE WHEN filled THEN {_f(('width < 3', 0.6), ('width > 15', 0.7), ('english <= 1', 0.2), ('english = 2', 0.6), ('special_ratio > 0.1', 0.5), ('repeated > 5', 0.7))} ELSE 0.0::DOUBLE END",
        "CASE WHEN filled THEN " + _issues("CASE WHEN width < 3 THEN 'very_short_words' WHEN width > 15 THEN 'very_long_words' END", "CASE WHEN english <= 1 THEN 'likely_non_english' WHEN english = 2 THEN 'possibly_non_english' END", "CASE WHEN special_ratio > 0.1 THEN 'excessive_special_chars_' || printf('%.2f', special_ratio) END", "CASE WHEN repeated > 5 THEN 'repeated_char_patterns' END") + " ELSE ['empty_text'] END",
    ),
    "structure": (
        f"(0.5::DOUBLE + CASE academic WHEN 3 THEN 0.4 WHEN 2 THEN 0.3 WHEN 1 THEN 0.1 ELSE 0.0 END::DOUBLE) * {_f(('short_runs > 10', 0.7), ('page_lines > 20', 0.8))}",
        _issues("CASE WHEN academic = 0 THEN 'lacks_academic_indicators' END", "CASE WHEN short_runs > 10 THEN 'broken_word_patterns' END", "CASE WHEN page_lines > 20 THEN 'excessive_page_numbers' END"),
    ),
    "completeness": (
        _f(("NOT ended", 0.8), *[(f"truncated[{k + 1}]", 0.3) for k in range(len(S.TRUNCATION_MARKS))], ("words < 200", 0.4), ("words >= 200 AND words < 500", 0.7)),
        _issues("CASE WHEN NOT ended THEN 'abrupt_ending' END", *[f"CASE WHEN truncated[{k + 1}] THEN 'truncation_indicator_{mark}' END" for k, mark in enumerate(S.TRUNCATION_MARKS)], "CASE WHEN words < 200 THEN 'likely_incomplete' WHEN words < 500 THEN 'possibly_incomplete' END"),
    ),
    "language": (
        "CASE WHEN words > 0 AND ratio < 0.1 THEN 0.1 WHEN words > 0 AND ratio < 0.3 THEN 0.5 ELSE 1.0 END::DOUBLE",
        _issues("CASE WHEN words > 0 AND ratio < 0.1 THEN 'low_english_ratio_' || printf('%.2f', ratio) WHEN words > 0 AND ratio < 0.3 THEN 'moderate_english_ratio_' || printf('%.2f', ratio) END"),
    ),
}
_OVERALL = " + ".join(f"{n}_score * {w}::DOUBLE" for n, w in S.WEIGHTS.items())
_CRITICAL = "|".join(S.CRITICAL_ISSUES)
SCORED_SQL = (
    "s AS (SELECT *, " + ", ".join(f"{score} AS {n}_score, {issues} AS {n}_issues" for n, (score, issues) in SCORES_SQL.items()) + " FROM r),\n"
    f"o AS (SELECT *, {_OVERALL} AS overall_score, list_concat({', '.join(f'{n}_issues' for n in ('length', 'readability'))}) AS i1 FROM s),\n"
    "q AS (SELECT * EXCLUDE (i1), list_concat(list_concat(list_concat(i1, structure_issues), completeness_issues), language_issues) AS issues FROM o)"
)


def _decision_sql(categories: bool) -> str:
    target, related = _listed(S.TARGET_CATEGORIES), _listed(S.RELATED_CATEGORIES)
    bad = f"(len(categories) > 0 AND NOT (list_has_any(categories, {target}) OR list_has_any(categories, {related})))" if categories else "false"
    note = "'unrelated_categories_' || array_to_string(categories, ',')" if categories else "''"
    first = f"list_filter(issues, lambda i: regexp_matches(i, '{_CRITICAL}'))"
    return f"""d AS (SELECT *, CASE WHEN {bad} THEN 'Category filter: ' || {note} WHEN overall_score < 0.1 THEN 'Quality score ' || printf('%.2f', overall_score) || ' below threshold 0.1'
      WHEN len({first}) > 0 THEN 'Critical issue: ' || {first}[1] ELSE 'Passed quality filters' END AS reason FROM q),
j AS (SELECT *, reason = 'Passed quality filters' AS accepted FROM d)"""


_RAW = measures_sql("documents", "text", "doc_id, lang, source")
_PAPER = measures_sql("papers", "full_text", "arxiv_id, categories, lang")


def _one_score(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = read_texts(spark, sf_dir).withColumn("m", F.explode(F.array(Q.measures(F.col("text")))))
        score, issues = getattr(Q, name)(F.col("m"))
        return docs.select("doc_id", F.round(score, 6).alias("score"), F.array_join(issues, "|").alias("issues"))

    sql = f"WITH {_RAW} SELECT doc_id, round({SCORES_SQL[name][0]}, 6) AS score, array_to_string({SCORES_SQL[name][1]}, '|') AS issues FROM r"
    return query, sql


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = C.with_quality(papers(spark, sf_dir), "full_text", categories="categories")
    q = F.col("quality_metrics")
    return judged.select("arxiv_id", *[F.round(q[f"{n}_score"], 6).alias(f"{n}_score") for n in S.WEIGHTS], F.round(q["overall_score"], 6).alias("overall_score"), F.array_join(q["issues"], "|").alias("issues"), F.size(q["recommendations"]).alias("recommendations"), "accepted", "reason")


def acceptance_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: clean, score and decide on every document, by language."""
    usable = C.usable_papers(read_texts(spark, sf_dir), "text")
    judged = C.with_quality(usable.select("lang", "text"))
    return judged.groupBy("lang").agg(F.count("*").alias("total"), F.count_if("accepted").alias("accepted"), F.round(F.avg("quality_metrics.overall_score"), 6).alias("avg_score"))


def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rejection_histogram(C.with_quality(papers(spark, sf_dir), "cleaned_text", categories="categories"))


def acceptance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.acceptance(C.with_quality(papers(spark, sf_dir), "cleaned_text", categories="categories"))
    return out.withColumn("acceptance_rate", F.round("acceptance_rate", 6))


def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = Q.category_check(F.col("categories"))
    return papers(spark, sf_dir).select("arxiv_id", check["ok"].alias("ok"), check["issue"].alias("issue"))


# --- cleaning ---------------------------------------------------------------

_W = r"[\p{L}\p{N}_]"
_CHAIN = [
    (rf"(?i)arXiv:\d{{4}}\.\d{{4,5}}v\d+(?:\s*\[[\p{{L}}\p{{N}}_.-]+\])?(?:\s*\d+\s+{_W}+\s+\d{{4}})?", ""),
    (r"(?m)^\s*\d{1,3}\s*$", ""),
    (r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+", "[URL]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\\[a-zA-Z]+\*?\s*(?:\s*\[[^\]]*\])?\s*(?:\s*\{[^}]*\})*", " "),
    (r"\$[^$]*\$\|\$\$[^$]*\$\$", " [MATH] "),
    (r"[^\p{L}\p{N}_\s[:punct:]]", " "),
]
_SPACE = [(r"(\p{L}+)-\s*\n\s*(\p{L}+)", r"\1\2"), (r"\n\s*\n\s*\n+", "\n\n"), (r"\s{3,}", " "), (r"(?m)^[^\S\n]+|[^\S\n]+$", ""), (r"\n{3,}", "\n\n"), (r"^\n+", "")]


def _replaced(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        new = "' || chr(10) || chr(10) || '".join(p.replace("'", "''") for p in new.split("\n\n"))
        text = f"regexp_replace({text}, '" + pattern.replace("'", "''").replace("\n", "\\n") + f"', '{new}', 'g')"
    return text


def _mapped(text: str) -> str:
    for old, new in {**S.SAME_LENGTH, **S.LONGER}.items():
        text = f"replace({text}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}')"
    return text


ARTIFACTS_SQL = _replaced("full_text", _CHAIN)
CLEAN_SQL = f"regexp_replace({_replaced(_replaced(_mapped('full_text'), _CHAIN), _SPACE)}, '^\\s+|\\s+$', '', 'g')"


def clean_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("arxiv_id", T.remove_artifacts(F.col("full_text")).alias("text"))


def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("arxiv_id", T.normalize_whitespace(F.col("full_text")).alias("text"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("arxiv_id", T.clean_text(F.col("full_text")).alias("cleaned_text"))


def text_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_texts(spark, sf_dir).withColumn("q", F.explode(F.array(T.assess(F.col("text"), F.col("text")))))
    return found.select("doc_id", F.col("q.length").alias("length"), F.col("q.word_count").alias("word_count"), F.array_join("q.issues", "|").alias("issues"), F.round("q.score", 6).alias("score"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("arxiv_id", T.content_hash(F.col("cleaned_text")).alias("text_hash"), T.paper_hash(F.col("title"), F.col("authors"), F.col("published")).alias("paper_hash"))


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("text_hash"))
    return docs.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def filename_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers from file names, and names made safe for a file system."""
    name = F.expr("case doc_id % 4 when 0 then concat('2301.', lpad(cast(doc_id as string), 5, '0'), 'v1.pdf') when 1 then concat('10.48550_arXiv.2301.', lpad(cast(doc_id as string), 5, '0'), '.pdf') when 2 then concat('paper <', cast(doc_id as string), '>: a/b.pdf') else null end")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return docs.select("doc_id", T.arxiv_id_from_filename(F.col("name")).alias("arxiv_id"), T.sanitize_filename(F.col("name")).alias("safe_name"))


_NAME = "case doc_id % 4 when 0 then '2301.' || lpad(doc_id::varchar, 5, '0') || 'v1.pdf' when 1 then '10.48550_arXiv.2301.' || lpad(doc_id::varchar, 5, '0') || '.pdf' when 2 then 'paper <' || doc_id || '>: a/b.pdf' else null end"

QUERIES, ORACLES = {}, {}
for _name in ("length", "readability", "structure", "completeness", "language"):
    QUERIES[f"doc_{_name}_quality"], ORACLES[f"doc_{_name}_quality"] = _one_score(_name)
for _query, _sql in (
    (doc_quality, f"WITH {PAPERS_SQL}, {_PAPER}, {SCORED_SQL}, {_decision_sql(True)} SELECT arxiv_id, {', '.join(f'round({n}_score, 6) AS {n}_score' for n in S.WEIGHTS)}, round(overall_score, 6) AS overall_score, array_to_string(issues, '|') AS issues, ({' + '.join(f'({n}_score < 0.5)::INT' for n in S.ADVICE)}) AS recommendations, accepted, reason FROM j"),
    (acceptance_by_lang, f"WITH d0 AS (SELECT * FROM documents WHERE text <> '' AND length(text) >= 100), {measures_sql('d0', 'text', 'lang')}, {SCORED_SQL}, {_decision_sql(False)} SELECT lang, count(*) AS total, count(*) FILTER (accepted) AS accepted, round(avg(overall_score), 6) AS avg_score FROM j GROUP BY lang"),
    (rejection_histogram, f"WITH {PAPERS_SQL}, {measures_sql('papers', 'cleaned_text', 'categories')}, {SCORED_SQL}, {_decision_sql(True)} SELECT string_split(reason, ':')[1] AS reason, count(*) AS papers FROM j WHERE NOT accepted GROUP BY 1"),
    (acceptance_stats, f"WITH {PAPERS_SQL}, {measures_sql('papers', 'cleaned_text', 'categories')}, {SCORED_SQL}, {_decision_sql(True)} SELECT count(*) AS total, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, round(avg(accepted::INT), 6) AS acceptance_rate FROM j"),
    (category_filter, f"WITH {PAPERS_SQL}, f AS (SELECT arxiv_id, categories, list_has_any(categories, {_listed(S.TARGET_CATEGORIES)}) AS target, list_has_any(categories, {_listed(S.RELATED_CATEGORIES)}) AS related FROM papers) SELECT arxiv_id, len(categories) > 0 AND (target OR related) AS ok, CASE WHEN len(categories) = 0 THEN 'no_categories' WHEN target THEN NULL WHEN related THEN 'related_categories_only' ELSE 'unrelated_categories_' || array_to_string(categories, ',') END AS issue FROM f"),
    (clean_artifacts, f"WITH {PAPERS_SQL} SELECT arxiv_id, {ARTIFACTS_SQL} AS text FROM papers"),
    (normalize_whitespace, f"WITH {PAPERS_SQL} SELECT arxiv_id, {_replaced('full_text', _SPACE)} AS text FROM papers"),
    (clean_text, f"WITH {PAPERS_SQL} SELECT arxiv_id, {CLEAN_SQL} AS cleaned_text FROM papers"),
    (text_assessment, rf"""WITH w AS (SELECT doc_id, text, length(text) AS n, regexp_extract_all(text, '\S+') AS ws, length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS letters FROM documents),
k AS (SELECT *, len(ws) AS words, len(list_filter(ws, lambda x: length(x) = 1)) AS single, len(list_distinct(ws)) AS different FROM w),
c AS (SELECT *, n < 500 AS a, letters::DOUBLE / greatest(n, 1) < 0.6 AS b, single::DOUBLE / greatest(words, 1) > 0.1 AS g, different::DOUBLE / greatest(words, 1) < 0.3 AS e FROM k)
SELECT doc_id, n::INT AS length, words::INT AS word_count, array_to_string({_issues("CASE WHEN a THEN 'too_short' END", "CASE WHEN b THEN 'low_alpha_ratio' END", "CASE WHEN g THEN 'potential_gibberish' END", "CASE WHEN e THEN 'excessive_repetition' END")}, '|') AS issues, round({_f(('a', 0.3), ('b', 0.5), ('g', 0.4), ('e', 0.6))}, 6) AS score FROM c"""),
    (content_hash, f"WITH {PAPERS_SQL} SELECT arxiv_id, substr(md5(cleaned_text), 1, 12) AS text_hash, md5(lower(trim(title)) || '_' || authors[1] || '_' || year(published)) AS paper_hash FROM papers"),
    (exact_dup_groups, "SELECT substr(md5(text), 1, 12) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"),
    (filename_ids, rf"WITH n AS (SELECT doc_id, {_NAME} AS name FROM documents) SELECT doc_id, CASE WHEN regexp_matches(name, '^\d{{4}}\.\d{{5}}v\d+\.pdf$') THEN regexp_extract(name, '^(.*)\.pdf$', 1) WHEN regexp_matches(name, '^10\.48550_arXiv\.\d{{4}}\.\d{{5}}\.pdf$') THEN regexp_extract(name, '(\d{{4}}\.\d{{5}})\.pdf$', 1) END AS arxiv_id, trim(regexp_replace(name, '[<>:\"/\\|?*]', '_', 'g')) AS safe_name FROM n"),
):
    QUERIES[_query.__name__], ORACLES[_query.__name__] = _query, _sql
