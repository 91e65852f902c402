"""Registered queries of the section and citation operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import settings as S
from paperloom.functions import citations as K
from paperloom.operators import sections as X
from paperloom.plans.papers import PAPERS_SQL, papers


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select(F.col("arxiv_id").alias("doc_id"), F.col("full_text").alias("text"))


def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.section_headers(_texts(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_sections(_texts(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.section_summary(X.extract_sections(_texts(spark, sf_dir)))
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6)).withColumn("sections_found", F.array_join("sections_found", "|"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunk_sections(X.extract_sections(_texts(spark, sf_dir)), confidence=S.CHUNK_CONFIDENCE)


def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.number_batches(chunks(spark, sf_dir).select("doc_id", "chunk_id", "char_count"), "doc_id", "chunk_id")
    return out.groupBy("batch").agg(F.count("*").alias("chunk_count"), F.sum("char_count").alias("chars"), F.min("doc_id").alias("first_doc"))


def simple_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.simple_sections(_texts(spark, sf_dir))


def reference_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", K.reference_section(F.col("text")).alias("refs"))


def _entries(spark: SparkSession, sf_dir: str, per_entry: bool) -> DataFrame:
    found = _texts(spark, sf_dir).select("doc_id", K.reference_section(F.col("text")).alias("refs"))
    return found.select("doc_id", F.explode(F.array(K.citations(F.col("refs"), per_entry))).alias("parsed"))


def citation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _entries(spark, sf_dir, True).select("doc_id", F.explode(K.normalized(F.col("parsed"))).alias("c")).select("doc_id", "c.*")
    return one.drop("venue").withColumn("authors", F.array_join("authors", "|")).withColumnRenamed("id", "entry")


def citation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.statistics(F.col("parsed"))
    out = _entries(spark, sf_dir, False).withColumn("s", F.explode(F.array(s)))
    types = F.array_join(F.transform(F.map_entries("s.types"), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return out.select("doc_id", "s.total_citations", "s.valid_citations", "s.avg_confidence", types.alias("types"), F.col("s.years_range.min").alias("year_min"), F.col("s.years_range.max").alias("year_max"), "s.has_arxiv", "s.has_doi")


def inline_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.inline(K.inline_citations(F.col("text"))))


_TITLES = " UNION ALL ".join(f"SELECT '{r.name}' AS name, '{X.header_pattern(r)}' AS pattern, {r.position}::DOUBLE AS expected, {r.min_words} AS min_words, {r.max_words} AS max_words" for r in S.SECTION_RULES)
HEADERS_SQL = rf"""{PAPERS_SQL},
rules AS ({_TITLES}),
texts AS (SELECT arxiv_id AS doc_id, full_text AS text FROM papers),
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n, len(string_split(text, chr(10))) AS total FROM texts),
ps AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS head FROM ls),
hs AS (
  SELECT doc_id, name, pos, n::INT AS line_num, min_words, max_words,
    greatest(0.0, least(1.0, 0.5::DOUBLE
      + CASE WHEN abs(expected - n::DOUBLE / total) < 0.1 THEN 0.3 WHEN abs(expected - n::DOUBLE / total) < 0.3 THEN 0.1 ELSE -0.2 END::DOUBLE
      + CASE WHEN upper(head) = head AND lower(head) <> head THEN 0.1 ELSE 0.0 END::DOUBLE
      + CASE WHEN regexp_matches(head, '^[1-9]\.') THEN 0.2 ELSE 0.0 END::DOUBLE + CASE WHEN length(head) < 50 THEN 0.1 ELSE 0.0 END::DOUBLE
      - CASE WHEN regexp_matches(lower(head), 'figure|table|eq\.|equation') THEN 0.4 ELSE 0.0 END::DOUBLE)) AS confidence
  FROM ps JOIN rules ON regexp_matches(head, pattern) WHERE length(head) BETWEEN 1 AND 200)"""
SECTIONS_SQL = rf"""{HEADERS_SQL},
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY pos, confidence DESC) AS r FROM hs WHERE confidence > 0.3) WHERE r = 1),
ends AS (SELECT f.*, t.text, lead(f.pos, 1, length(t.text)) OVER (PARTITION BY doc_id ORDER BY f.pos, f.confidence DESC, f.name)::INT AS end_pos FROM firsts f JOIN texts t USING (doc_id)),
bodies AS (SELECT *, substr(text, pos + 1, end_pos - pos) AS body FROM ends),
contents AS (SELECT *, CASE WHEN contains(body, chr(10)) THEN regexp_replace(regexp_replace(body, '^[^\n]*\n', ''), '^\s+|\s+$', '', 'g') ELSE '' END AS content FROM bodies),
kept AS (SELECT doc_id, name, content, pos AS start_pos, end_pos, confidence FROM contents WHERE len(regexp_extract_all(content, '\S+')) BETWEEN min_words AND max_words),
fronts AS (SELECT doc_id, min(pos) AS pos FROM firsts GROUP BY doc_id),
secs AS (
  SELECT * FROM kept
  UNION ALL SELECT doc_id, 'body', regexp_replace(text, '^\s+|\s+$', '', 'g'), 0, length(text)::INT, 0.8 FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM kept) AND regexp_matches(text, '\S')
  UNION ALL SELECT doc_id, 'introduction_unlabeled', regexp_replace(substr(text, 1, pos), '^\s+|\s+$', '', 'g'), 0, pos, 0.6 FROM texts JOIN fronts USING (doc_id)
    WHERE pos > 100 AND len(regexp_extract_all(substr(text, 1, pos), '\S+')) > 50 AND doc_id IN (SELECT doc_id FROM kept))"""
_ORDER = "[" + ", ".join(f"'{s}'" for s in S.SECTION_ORDER) + "]"
CHUNKS_SQL = rf"""{SECTIONS_SQL},
pieces AS (SELECT doc_id, name, content, list_position({_ORDER}, name) AS o, CASE WHEN length(content) <= 1000 THEN [content] ELSE string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS ss FROM secs),
walk AS (
  SELECT doc_id, name, o, ss, 1 AS i, ss[1] AS cur, length(ss[1]) + 1 AS n, false AS closed, NULL::VARCHAR AS done FROM pieces
  UNION ALL
  SELECT doc_id, name, o, ss, i + 1, CASE WHEN n + length(ss[i + 1]) > 1000 THEN ss[i + 1] ELSE cur || ' ' || ss[i + 1] END,
    CASE WHEN n + length(ss[i + 1]) > 1000 THEN length(ss[i + 1]) + 1 ELSE n + length(ss[i + 1]) + 1 END,
    n + length(ss[i + 1]) > 1000, CASE WHEN n + length(ss[i + 1]) > 1000 THEN cur END
  FROM walk WHERE i < len(ss)),
cut AS (SELECT doc_id, name, o, i, done AS text FROM walk WHERE closed UNION ALL SELECT doc_id, name, o, i + 1, cur FROM walk WHERE i = len(ss)),
chunked AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o, i) - 1)::INT AS chunk_id, name AS section, text, length(text)::INT AS char_count, len(regexp_extract_all(text, '\S+'))::INT AS word_count, 0.8::DOUBLE AS section_confidence FROM cut)"""

_HEADER_CASE = "CASE " + " ".join(f"WHEN low = '{h}' OR starts_with(low, '{h} ') OR ends_with(low, ' {h}') THEN '{h}'" for h in S.SIMPLE_HEADERS) + " END"
_SIMPLE = rf"""WITH {PAPERS_SQL},
ls AS (SELECT arxiv_id AS doc_id, unnest(string_split(full_text, chr(10))) AS line, unnest(range(len(string_split(full_text, chr(10))))) AS n FROM papers),
h AS (SELECT *, lower(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS low FROM ls),
g AS (SELECT *, {_HEADER_CASE} AS header FROM h),
r AS (SELECT *, sum((header IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS run, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'body') AS name FROM g),
c AS (SELECT doc_id, name, run, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\s+|\s+$', '', 'g') AS content FROM r WHERE header IS NULL AND regexp_matches(line, '\S') GROUP BY ALL)
SELECT doc_id, name AS header, max_by(content, run) AS content FROM c GROUP BY 1, 2"""

# the decorated text has a reference header, so the list behind it is the section
_REFS = rf"""{PAPERS_SQL},
refs AS (SELECT arxiv_id AS doc_id, string_split(string_split(regexp_replace(regexp_replace(full_text, '(?i)\n\s*references?\s*\n', chr(1)), '(?i)\n\s*appendix\s*\n', chr(2)), chr(1))[2], chr(2))[1] AS refs FROM papers)"""
_FLAT = r"flat AS (SELECT doc_id, regexp_replace(regexp_replace(refs, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS flat FROM refs)"


def _parsed(source: str) -> str:
    """Fields of the column raw of ``source`` (doc_id, entry, raw)."""
    group = lambda pattern, g=1: f"nullif(regexp_extract(raw, '{pattern}', {g}), '')"
    return rf"""
p1 AS (SELECT *, {group(r'\((\d{4})\)')}::INT AS y1, regexp_extract_all(raw, '\b((?:19|20)\d{{2}})\b', 1) AS ys, {group(r'(?i)doi:\s*(10\.\d+/\S+)')} AS doi, {group(r'(?i)arxiv:\s*(\d{4}\.\d{4,5})')} AS arxiv_id,
  {group(r'https?://\S+', 0)} AS url, {group('"([^"]{10,200})"')} AS title, lower(raw) AS low, {group(r'(\d+)\s*\((\d+)\):\s*(\d+[-–]\d+)')} AS v1, {group(r'(\d+)\s*\((\d+)\):\s*(\d+[-–]\d+)', 3)} AS g1 FROM {source}),
p2 AS (SELECT *, coalesce(y1, substr(ys[-1], 1, 2)::INT) AS year, regexp_matches(low, '{"|".join(S.JOURNAL_WORDS)}') AS journal, regexp_matches(low, '{"|".join(S.CONFERENCE_WORDS)}') AS conference FROM p1),
p3 AS (SELECT *, regexp_extract_all(substr(CASE WHEN title IS NOT NULL THEN replace(CASE WHEN year IS NOT NULL THEN replace(raw, '(' || year || ')', '') ELSE raw END, '"' || title || '"', '') WHEN year IS NOT NULL THEN replace(raw, '(' || year || ')', '') ELSE raw END, 1, 200), '([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)', 1)[1:5] AS authors FROM p2),
p4 AS (SELECT *, 0.5::DOUBLE + CASE WHEN y1 IS NOT NULL THEN 0.2 WHEN len(ys) > 0 THEN 0.1 ELSE 0.0 END::DOUBLE + CASE WHEN doi IS NOT NULL THEN 0.3 ELSE 0.0 END::DOUBLE + CASE WHEN arxiv_id IS NOT NULL THEN 0.3 ELSE 0.0 END::DOUBLE
  + CASE WHEN url IS NOT NULL THEN 0.1 ELSE 0.0 END::DOUBLE + CASE WHEN title IS NOT NULL THEN 0.2 ELSE 0.0 END::DOUBLE + CASE WHEN len(authors) > 0 THEN 0.2 ELSE 0.0 END::DOUBLE + CASE WHEN journal OR conference THEN 0.1 ELSE 0.0 END::DOUBLE + CASE WHEN v1 IS NOT NULL THEN 0.1 ELSE 0.0 END::DOUBLE AS conf,
  CASE WHEN journal THEN 'journal' WHEN conference THEN 'conference' WHEN arxiv_id IS NOT NULL THEN 'arxiv' ELSE 'misc' END AS type,
  coalesce(v1, {group(r'(?i)vol\.?\s*(\d+)')}) AS volume, CASE WHEN v1 IS NOT NULL THEN g1 ELSE {group(r'(?i)pp?\.?\s*(\d+[-–]\d+)')} END AS pages FROM p3)"""


_NUM = r"[\[\(]?\d+[\]\)]?"
_FIELDS = rf"""WITH {_REFS},
es AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(refs, '\n\s*{_NUM}\s*', chr(3), 'g'), chr(3)), lambda e: regexp_replace(e, '^\s+|\s+$', '', 'g')), lambda e: length(e) >= 20)) AS e, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(refs, '\n\s*{_NUM}\s*', chr(3), 'g'), chr(3)), lambda e: regexp_replace(e, '^\s+|\s+$', '', 'g')), lambda e: length(e) >= 20), 1) AS entry FROM refs),
rw AS (SELECT doc_id, entry, regexp_replace(regexp_replace(e, '^\s*{_NUM}\s*', ''), '^\s+|\s+$', '', 'g') AS raw FROM es), {_parsed('rw')}
SELECT doc_id, entry::INT AS entry, raw AS raw_text, array_to_string(authors, '|') AS authors, title, year, volume, pages, doi, arxiv_id, url, type, round(conf, 2) AS confidence, conf > 0.3 AND (year IS NOT NULL OR arxiv_id IS NOT NULL) AS is_valid FROM p4"""
_STATS = rf"""WITH {_REFS}, {_FLAT},
rw AS (SELECT doc_id, 1 AS entry, regexp_replace(flat, '^\s*{_NUM}\s*', '') AS raw FROM flat WHERE length(flat) >= 20), {_parsed('rw')}
SELECT doc_id, count(*)::INT AS total_citations, count(*) FILTER (conf > 0.3)::INT AS valid_citations, round(avg(conf), 2) AS avg_confidence, any_value(type) || '=1' AS types, min(year) AS year_min, max(year) AS year_max, bool_or(arxiv_id IS NOT NULL) AS has_arxiv, bool_or(doi IS NOT NULL) AS has_doi FROM p4 GROUP BY doc_id"""
_INLINE = rf"""WITH {PAPERS_SQL},
x AS (SELECT arxiv_id AS doc_id, full_text AS text, regexp_extract_all(full_text, '\[\d+(?:,\s*\d+)*\]') AS ns, regexp_extract_all(full_text, '\([A-Z][a-z]+(?:\s+et\s+al\.)?,?\s+\d{{4}}\)') AS a,
  string_split(regexp_replace(full_text, '\[\d+(?:,\s*\d+)*\]', chr(1), 'g'), chr(1)) AS gn, string_split(regexp_replace(full_text, '\([A-Z][a-z]+(?:\s+et\s+al\.)?,?\s+\d{{4}}\)', chr(1), 'g'), chr(1)) AS ga FROM papers),
u AS (SELECT doc_id, 0 AS kind, unnest(ns) AS m, unnest(range(1, len(ns) + 1)) AS i, ns AS ms, gn AS g FROM x UNION ALL SELECT doc_id, 1, unnest(a), unnest(range(1, len(a) + 1)), a, ga FROM x),
w AS (SELECT doc_id, kind, m, (list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda s: length(s))), 0))::INT AS position FROM u)
SELECT doc_id, '[' || unnest(regexp_extract_all(m, '\d+'))::BIGINT || ']' AS citation, position FROM w WHERE kind = 0 UNION ALL SELECT doc_id, m, position FROM w WHERE kind = 1"""

QUERIES = {f.__name__: f for f in (section_headers, sections, section_summary, chunks, chunk_batches, simple_sections, reference_section, citation_fields, citation_stats, inline_citations)}
ORACLES = {
    "section_headers": f"WITH {HEADERS_SQL} SELECT doc_id, name, pos, line_num, round(confidence, 6) AS confidence FROM hs",
    "sections": f"WITH {SECTIONS_SQL} SELECT doc_id, name, content, start_pos, end_pos, 1 AS level, round(confidence, 6) AS confidence FROM secs",
    "section_summary": rf"WITH {SECTIONS_SQL} SELECT doc_id, count(*) AS total_sections, sum(len(regexp_extract_all(content, '\S+')))::BIGINT AS total_words, string_agg(name, '|' ORDER BY (name = 'introduction_unlabeled')::INT, start_pos, name) AS sections_found, round(avg(confidence), 6) AS avg_confidence, bool_or(name = 'abstract') AS has_abstract, bool_or(name IN ('introduction', 'introduction_unlabeled')) AS has_introduction, bool_or(name = 'conclusion') AS has_conclusion, bool_or(name = 'references') AS has_references FROM secs GROUP BY doc_id",
    "chunks": f"WITH RECURSIVE {CHUNKS_SQL} SELECT * FROM chunked",
    "chunk_batches": f"WITH RECURSIVE {CHUNKS_SQL}, b AS (SELECT *, ((row_number() OVER (ORDER BY doc_id, chunk_id) - 1) // 1000)::INT AS batch FROM chunked) SELECT batch, count(*) AS chunk_count, sum(char_count)::BIGINT AS chars, min(doc_id) AS first_doc FROM b GROUP BY batch",
    "simple_sections": _SIMPLE,
    "reference_section": rf"WITH {_REFS} SELECT doc_id, regexp_replace(refs, '^\s+|\s+$', '', 'g') AS refs FROM refs",
    "citation_fields": _FIELDS,
    "citation_stats": _STATS,
    "inline_citations": _INLINE,
}
