"""Registered queries of the source, projection and pipeline operators, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import settings as S
from paperloom.functions import text as T
from paperloom.operators import corpus as C
from paperloom.operators import evaluation as E
from paperloom.operators import learning as L
from paperloom.operators import sections as X
from paperloom.plans import clean
from paperloom.plans.learn import LEARNABLE
from paperloom.plans.papers import PAPERS_SQL, papers
from paperloom.plans.quality_queries import _issues, _listed
from paperloom.scratch import scratch_root
from paperloom.session import read_table, read_texts
from paperloom.sources import feeds
from paperloom.sources.store import Store, load_results, save_results


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed entries made of documents, parsed into papers."""
    docs = read_table(spark, sf_dir, "documents")
    entries = docs.select(
        F.concat(F.lit("http://feeds.example.org/abs/2301."), F.col("doc_id").cast("string"), F.lit("v1")).alias("id"),
        F.concat(F.lit(" A title\nnumber "), F.col("doc_id").cast("string"), F.lit(" ")).alias("title"),
        F.substring("text", 1, 80).alias("summary"),
        F.lit("2023-01-02T03:04:05Z").alias("published"),
        F.lit("2023-02-03T04:05:06Z").alias("updated"),
        F.array(F.struct(F.col("lang").alias("term")), F.struct(F.col("source").alias("term"))).alias("tags"),
        F.array(F.struct(F.concat(F.lit("Author "), "source").alias("name"))).alias("authors"),
    )
    out = feeds.parse_entries(entries)
    return out.withColumn("authors", F.array_join("authors", ",")).withColumn("categories", F.array_join("categories", ","))


def papers_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("case when doc_id % 2 = 0 then concat('2301.', lpad(cast(doc_id as string), 5, '0'), 'v1.pdf') else 'other.pdf' end")
    files = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("/pdf/"), name).alias("path"), T.arxiv_id_from_filename(name).alias("arxiv_id"))
    out = feeds.papers_from_pdfs(files)
    return out.select("arxiv_id", "title", F.array_join("categories", ",").alias("categories"), "pdf_path", "pdf_downloaded", "pdf_processed")


def prepared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that models, embeddings and crawled papers use."""
    rows = papers(spark, sf_dir).select("arxiv_id", "title", F.lit("A summary.").alias("summary"), F.col("cleaned_text").alias("full_text"))
    out = feeds.embedding_text(feeds.model_text(feeds.truncated(rows), 500, "full_text"))
    return out.select("arxiv_id", "model_text", "embedding_text", F.length("full_text").alias("kept_chars"))


def eligible_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First categories that can be learned, in classes of at least three papers."""
    first = F.get("categories", F.lit(0))
    rows = papers(spark, sf_dir).select("arxiv_id", first.alias("category")).where(F.col("category").isin(*LEARNABLE))
    return C.class_distribution(C.enough_samples(rows, "category"), "category")


def best_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first best row of a metric grid for each method (events as the grid)."""
    grid = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), F.round("value", 1).alias("score"), F.col("event_id").alias("k"))
    return E.first_best(grid, "score", "k", "method").select("method", "k", "score")


def per_entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many papers have how many entries and usable ones, when every entry is read."""
    from paperloom.functions import citations as K

    parsed = papers(spark, sf_dir).select(F.explode(F.array(K.normalized(K.citations(K.reference_section(F.col("full_text")), per_entry=True)))).alias("c"))
    counted = parsed.select(F.size("c").alias("entries"), F.size(F.filter("c", lambda x: x["is_valid"])).alias("usable"))
    return counted.groupBy("entries", "usable").agg(F.count("*").alias("papers"))


def hyphen_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assessment of texts whose hyphenated words are joined."""
    rows = papers(spark, sf_dir).select("arxiv_id", T.fix_hyphenation(F.col("full_text")).alias("x"))
    found = rows.withColumn("q", F.explode(F.array(T.assess(F.col("x")))))
    return found.groupBy(F.array_join("q.issues", "|").alias("issues")).agg(F.count("*").alias("papers"), F.sum("q.word_count").alias("words"))


def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning run: what was accepted, by reason, and the chunks made of it."""
    result = clean.run(papers(spark, sf_dir).drop("cleaned_text"))
    chunks = result.chunks.groupBy("section").agg(F.count("*").alias("rows"), F.sum("char_count").alias("chars"))
    reasons = result.rejected.groupBy(C.reason_key(F.col("reason")).alias("reason")).agg(F.count("*").alias("rows"))
    return chunks.select(F.lit("chunks").alias("kind"), F.col("section").alias("name"), "rows", "chars").union(reasons.select(F.lit("rejected"), "reason", "rows", F.lit(0).cast("long")))


def clean_pipeline_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cleaning run makes of each paper."""
    result = clean.run(papers(spark, sf_dir).drop("cleaned_text"))
    kept = ["arxiv_id", F.length("cleaned_text").alias("chars"), F.col("text_quality.word_count").alias("words"), F.size("citations").alias("citations"), "accepted"]
    return result.papers.select(*kept).unionByName(result.rejected.select(*kept))


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{scratch_root(spark)}/store-{uuid.uuid4().hex[:12]}")


def stored_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers written to a store and read back, with what was noted about them."""
    store = _store(spark)
    rows = papers(spark, sf_dir).select("arxiv_id", "title", "categories", F.substring("full_text", 1, 500).alias("full_text"), "cleaned_text")
    store.save_papers(rows)
    note = F.col("processing_metadata")
    return spark.read.parquet(f"{store.path}/papers").select("arxiv_id", "title", note["text_hash"].alias("text_hash"), note["original_length"].alias("original_length"), note["cleaned_length"].alias("cleaned_length"))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two runs in a store; the later run's, by batch."""
    store = _store(spark)
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), (F.col("doc_id") % 7).cast("int").alias("batch"))
    store.save_chunks(rows.where("doc_id % 2 = 0"), "first")
    store.save_chunks(rows, "second")
    return store.load_chunks("second").groupBy("batch").agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"))


def stored_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset and vectors (given twice) in a store: rows of each table."""
    store = _store(spark)
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("arxiv_id"), "lang")
    store.save_dataset(docs, docs.where("lang = 'en'"))
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    store.add_embeddings(vectors.where("key % 3 = 0"))
    store.add_embeddings(vectors)
    return store.stats().select("kind", "rows")


def json_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as gzipped JSON lines and loaded again; a missing one is left out."""
    path = f"{scratch_root(spark)}/results-{uuid.uuid4().hex[:12]}"
    save_results(path, papers=papers(spark, sf_dir).select("arxiv_id", "title", "categories", "published"))
    found = load_results(spark, path, "papers", "missing")
    return found["papers"].select("arxiv_id", "title", F.array_join("categories", ",").alias("categories"), F.col("published").cast("date").alias("published"), F.lit(found["missing"] is None).alias("other_missing"))


def budgeted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events within a budget of 300, 100 of which exist already."""
    return C.budgeted(read_table(spark, sf_dir, "events"), 300, [F.desc("ts"), F.col("event_id")], 100).select("event_id", "ts")


def clustering_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of event types, judged as clusterings."""
    rows = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.round(F.avg("value") / 100, 4).alias("silhouette"), F.countDistinct("user_id").alias("clusters"))
    return E.evaluate_clusterings(rows)


def run_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sources as steps of a run, those with labelled documents count as completed."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True))
    docs = read_table(spark, sf_dir, "documents").where("source is not null").join(labels, "doc_id", "left")
    steps = docs.groupBy(F.col("source").alias("step")).agg(F.coalesce(F.bool_or("seen"), F.lit(False)).alias("completed"))
    return E.run_rates(steps).withColumn("success_rate", F.round("success_rate", 6))


_STOPS = sorted({*S.DOMAIN_STOP_WORDS, *S.COMMON_WORDS})


def topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each text a topic model would read."""
    return read_texts(spark, sf_dir).select("doc_id", F.size(L.topic_tokens(F.coalesce("text", F.lit("")), _STOPS)).alias("words"))


def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section counts of every text, of blank ones too (every seventh is blanked)."""
    text = F.when(F.col("arxiv_id") % 7 == 0, F.lit(" ")).otherwise(F.col("full_text"))
    found = X.summaries(papers(spark, sf_dir).select(F.col("arxiv_id").alias("doc_id"), text.alias("text")))
    return found.where("doc_id % 7 = 0").select("doc_id", "total_sections", "total_words", "avg_confidence", "has_abstract", F.size("sections_found").alias("names"))


QUERIES = {f.__name__: f for f in (clean_pipeline_papers, stored_papers, stored_chunks, stored_dataset, json_dataset, budgeted_events, clustering_verdicts, run_rates, topic_words, section_summaries)}
QUERIES |= {f.__name__: f for f in (feed_entries, papers_from_files, prepared_texts, eligible_classes, best_by_method, per_entry_counts, hyphen_assessment, clean_pipeline)}
_LEARNABLE = "[" + ", ".join(f"'{c}'" for c in LEARNABLE) + "]"
ORACLES = {
    "feed_entries": "SELECT '2301.' || doc_id || 'v1' AS arxiv_id, 'A title number ' || doc_id AS title, trim(replace(substr(text, 1, 80), chr(10), ' ')) AS summary, 'Author ' || source AS authors, lang || ',' || source AS categories, TIMESTAMP '2023-01-02 03:04:05' AS published, TIMESTAMP '2023-02-03 04:05:06' AS updated, 'http://feeds.example.org/pdf/2301.' || doc_id || 'v1.pdf' AS pdf_url, false AS pdf_downloaded, false AS pdf_processed FROM documents",
    "papers_from_files": "SELECT '2301.' || lpad(doc_id::VARCHAR, 5, '0') || 'v1' AS arxiv_id, 'Existing Paper 2301.' || lpad(doc_id::VARCHAR, 5, '0') || 'v1' AS title, 'cs.AI' AS categories, '/pdf/2301.' || lpad(doc_id::VARCHAR, 5, '0') || 'v1.pdf' AS pdf_path, true AS pdf_downloaded, false AS pdf_processed FROM documents WHERE doc_id % 2 = 0",
    "prepared_texts": f"WITH {PAPERS_SQL} SELECT arxiv_id, title || '. ' || substr(cleaned_text, 1, 500) AS model_text, title || ' A summary. ' || substr(cleaned_text, 1, 3000) AS embedding_text, least(length(cleaned_text), 5000)::INT AS kept_chars FROM papers",
    "eligible_classes": f"WITH {PAPERS_SQL}, c AS (SELECT categories[1] AS label, count(*) AS rows FROM papers WHERE list_contains({_LEARNABLE}, categories[1]) GROUP BY 1) SELECT label, rows FROM c WHERE rows >= 3 OR (SELECT count(*) FROM c WHERE rows >= 3) < 2",
    "best_by_method": "WITH g AS (SELECT event_type AS method, round(value, 1) AS score, event_id AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, k) AS r FROM g) SELECT method, k, score FROM r WHERE r = 1",
    "per_entry_counts": "SELECT 3 AS entries, 3 AS usable, count(*) AS papers FROM documents",
    "hyphen_assessment": rf"""WITH {PAPERS_SQL}, x AS (SELECT regexp_replace(full_text, '(\p{{L}}+)-\s*\n\s*(\p{{L}}+)', '\1\2', 'g') AS t FROM papers),
k AS (SELECT length(t) AS n, regexp_extract_all(t, '\S+') AS ws, length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS letters FROM x),
c AS (SELECT len(ws) AS words, n < 500 AS a, letters::DOUBLE / n < 0.6 AS b, len(list_filter(ws, lambda w: length(w) = 1))::DOUBLE / len(ws) > 0.1 AS g, len(list_distinct(ws))::DOUBLE / len(ws) < 0.3 AS e FROM k)
SELECT array_to_string({_issues("CASE WHEN a THEN 'too_short' END", "CASE WHEN b THEN 'low_alpha_ratio' END", "CASE WHEN g THEN 'potential_gibberish' END", "CASE WHEN e THEN 'excessive_repetition' END")}, '|') AS issues, count(*) AS papers, sum(words)::BIGINT AS words FROM c GROUP BY 1""",
}
ORACLES |= {
    "stored_papers": f"WITH {PAPERS_SQL} SELECT arxiv_id, title, substr(md5(cleaned_text), 1, 12) AS text_hash, length(substr(full_text, 1, 500))::INT AS original_length, length(cleaned_text)::INT AS cleaned_length FROM papers",
    "stored_chunks": "SELECT (doc_id % 7)::INT AS batch, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1",
    "stored_dataset": "SELECT 'dataset_papers' AS kind, count(*) AS rows FROM documents UNION ALL SELECT 'dataset_chunks', count(*) FROM documents WHERE lang = 'en' UNION ALL SELECT 'embeddings', count(*) FROM embeddings",
    "json_dataset": f"WITH {PAPERS_SQL} SELECT arxiv_id, title, array_to_string(categories, ',') AS categories, published, true AS other_missing FROM papers",
    "budgeted_events": "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 200",
    "clustering_verdicts": "WITH g AS (SELECT event_type AS method, round(avg(value) / 100, 4) AS silhouette, count(DISTINCT user_id) AS clusters FROM events GROUP BY 1), b AS (SELECT min(method) AS m FROM g WHERE silhouette = (SELECT max(silhouette) FROM g)) SELECT method, silhouette, clusters, CASE WHEN silhouette >= 0.7 THEN 'Excellent' WHEN silhouette >= 0.5 THEN 'Good' WHEN silhouette >= 0.25 THEN 'Fair' ELSE 'Poor' END AS verdict, method = m AS best FROM g, b",
    "run_rates": "WITH s AS (SELECT source, bool_or(doc_id IN (SELECT doc_id FROM labels)) AS completed FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT count(*) AS steps, count(*) FILTER (completed) AS completed, round(avg(completed::INT), 6) AS success_rate, bool_and(completed) AS overall FROM s",
    "topic_words": rf"SELECT doc_id, len(list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '\p{{L}}{{3,15}}') AND NOT list_contains({_listed(_STOPS)}, w)))::INT AS words FROM documents",
    "section_summaries": "SELECT doc_id, 0::BIGINT AS total_sections, 0::BIGINT AS total_words, 0.0::DOUBLE AS avg_confidence, false AS has_abstract, 0 AS names FROM documents WHERE doc_id % 7 = 0",
}
