"""Registered queries of the relational, vector, evaluation and learning operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import corpus as C
from paperloom.operators import evaluation as E
from paperloom.operators import learning as L
from paperloom.operators import vectors as V
from paperloom.plans.papers import PAPERS_SQL, papers
from paperloom.plans.quality_queries import SCORED_SQL, measures_sql
from paperloom.plans.structure_queries import CHUNKS_SQL
from paperloom.session import read_table, read_texts

_DAY = "DATE '2020-01-01'"


def usable_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.usable_papers(papers(spark, sf_dir), "cleaned_text", 400).groupBy("lang").agg(F.count("*").alias("papers"))


def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_categories(papers(spark, sf_dir))


def paper_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = papers(spark, sf_dir).select((F.col("arxiv_id") % 2 == 0).alias("pdf_downloaded"), F.when(F.col("arxiv_id") % 3 == 0, True).alias("pdf_processed"))
    return C.paper_stats(flagged)


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.balanced_sample(papers(spark, sf_dir), 50).select("category", "rank", "arxiv_id", "published")


def balanced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").withColumn("categories", F.array("event_type"))
    return C.balanced_sample(events, 20, at="ts", key="event_id").select("category", "rank", "event_id", "user_id")


def feed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.feed_window(papers(spark, sf_dir), ["cs.AI", "cs.CL"], datetime(2020, 3, 1), datetime(2021, 12, 31), 100)
    return found.select("arxiv_id", "published", F.array_join("categories", ",").alias("categories"))


def upsert_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored papers, then two rounds of partial changes; the last one wins."""
    rows = papers(spark, sf_dir)
    stored = rows.where("arxiv_id % 3 <> 0").select("arxiv_id", "title", F.col("lang").alias("note"), F.lit(False).alias("done"))
    changes = rows.where("arxiv_id % 2 = 0").select("arxiv_id", F.concat("title", F.lit(" v2")).alias("title"), F.when(F.col("arxiv_id") % 4 == 0, "seen").alias("note"), F.lit(2).alias("seq"))
    earlier = changes.select("arxiv_id", F.lit("old").alias("title"), F.lit("old").alias("note"), F.lit(1).alias("seq"))
    return C.upsert(stored, C.latest_by_key(changes.unionByName(earlier), "arxiv_id", "seq").drop("seq"), "arxiv_id")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return C.latest_by_key(events, "user_id", "ts", "event_id")


def unprocessed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.not_yet(read_table(spark, sf_dir, "documents").select("doc_id", "source"), read_table(spark, sf_dir, "labels"), "doc_id")


def papers_for_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    hits = V.nearest(vectors, vectors.where("vec_id = 7"), 10).select(F.col("vec_id").alias("arxiv_id"), "rank")
    return C.papers_for_hits(papers(spark, sf_dir).select("arxiv_id", "title", "lang"), hits, "arxiv_id")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 20 asks."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return V.nearest(vectors, vectors.where("vec_id % 20 = 0"), 10).withColumn("distance", F.round("distance", 6))


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding labels as clusters (9 is noise) of the papers of the same number."""
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("arxiv_id"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("label"))
    rows = papers(spark, sf_dir).select("arxiv_id", "title", "categories", (F.length("cleaned_text") % 100 / 100).alias("quality_score"))
    return V.cluster_profile(rows.join(vectors, "arxiv_id"), key="arxiv_id")


def cluster_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _profiled(spark, sf_dir).withColumn("avg_quality_score", F.round("avg_quality_score", 6))
    return out.select("cluster", "size", "avg_quality_score", F.array_join("sample_titles", "|").alias("sample_titles"), F.array_join("paper_ids", "|").alias("paper_ids"), F.array_join(F.transform("top_categories", lambda t: F.concat_ws("=", t["category"], t["papers"])), "|").alias("top_categories"))


def cluster_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.cluster_composition(_profiled(spark, sf_dir))
    return out.select("clusters", *[F.round(c, 6).cast("double").alias(c) for c in out.columns if c != "clusters"])


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.category_rollup(_profiled(spark, sf_dir))


def cluster_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.dispersion(read_table(spark, sf_dir, "embeddings"))
    return out.select("rows", "clusters", *[F.round(c, 4).alias(c) for c in ("inertia", "between", "calinski_harabasz")])


def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.silhouette(read_table(spark, sf_dir, "embeddings")).withColumn("silhouette", F.round("silhouette", 6))


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.class_distribution(read_table(spark, sf_dir, "documents"), "lang")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.stratified_split(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain rule as the classifier: long documents are called good, very long ones odd."""
    docs = read_table(spark, sf_dir, "documents")
    rule = F.when(F.col("n_chars") > 9000, "odd").when(F.col("n_chars") > 700, "good").otherwise("poor")
    truth = F.when(F.col("quality") == 1, "good").otherwise("poor")
    return read_table(spark, sf_dir, "labels").join(docs, "doc_id").select(truth.alias("label"), rule.alias("prediction"))


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.class_metrics(E.confusion(_predictions(spark, sf_dir)))
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.overall_metrics(E.class_metrics(E.confusion(_predictions(spark, sf_dir))))
    return out.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")], "classes", "rows", "verdict", "imbalanced")


def _terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    docs = read_texts(spark, sf_dir)
    return E.document_terms(docs, F.filter(T.tokens(F.col("text")), lambda w: F.length(w).between(3, 15))), docs.count()


def vocabulary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000 terms at most, as the learning run takes them (vocabulary and the next two: short lists)."""
    terms, n = _terms(spark, sf_dir)
    return E.vocabulary(terms, n, 5, 0.8, 10000)


def tfidf_weights_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, n = _terms(spark, sf_dir)
    return E.tfidf(terms, E.vocabulary(terms, n, 2, 0.95, 10000), n).withColumn("weight", F.round("weight", 6))


def u_mass_coherence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, n = _terms(spark, sf_dir)
    return _coherence(terms, E.vocabulary(terms, n, 5, 0.8, 10000))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, n = _terms(spark, sf_dir)
    return E.vocabulary(terms, n, 5, 0.8, 500)


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, n = _terms(spark, sf_dir)
    return E.tfidf(terms, E.vocabulary(terms, n, 5, 0.8, 100), n).withColumn("weight", F.round("weight", 6))


def u_mass_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics: the commonest terms by first letter, as a fixed grouping."""
    terms, n = _terms(spark, sf_dir)
    return _coherence(terms, E.vocabulary(terms, n, 5, 0.8, 300))


def _coherence(terms: DataFrame, listed: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    listed = listed.withColumn("topic", F.substring("term", 1, 1))
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("total"), "term"))).where("rank <= 5")
    return E.u_mass(ranked, terms).withColumn("u_mass", F.round("u_mass", 6))


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ml_dataset(C.with_quality(papers(spark, sf_dir), "cleaned_text"))


def ml_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).select("arxiv_id", "title", F.length("text").alias("chars"), F.array_join("categories", ",").alias("categories"), F.round("quality_score", 6).alias("quality_score"))


def ml_dataset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.plans.structure_queries import chunks

    out = C.ml_dataset_meta(_dataset(spark, sf_dir), chunks(spark, sf_dir))
    return out.select("total_papers", "total_chunks", F.array_join("categories", ",").alias("categories"), F.round("avg_quality_score", 6).alias("avg_quality_score"))


def dbscan_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dbscan(read_table(spark, sf_dir, "embeddings"), 0.9, 3)


def dbscan_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eps over all embeddings."""
    return L.dbscan_sweep(read_table(spark, sf_dir, "embeddings"))


def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.kmeans_sweep(L.with_vectors(read_table(spark, sf_dir, "embeddings"), "embedding"), seeds=range(L.SEED, L.SEED + 10))


def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pca(L.with_vectors(read_table(spark, sf_dir, "embeddings"), "embedding"), "vec_id")


def _tfidf_model(spark: SparkSession, sf_dir: str, features: int = 5000):
    docs = read_texts(spark, sf_dir)
    return L.tfidf_pipeline(features, bigrams=False).fit(docs), docs


def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lda_topics(read_texts(spark, sf_dir))


def lsa_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, docs = _tfidf_model(spark, sf_dir)
    return L.lsa_topics(model.transform(docs), L.vocabulary_of(model))


def classifier_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = read_texts(spark, sf_dir).join(read_table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("category"))
    return L.contest(labelled, "category", "doc_id")


_KNN = "d AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS distance FROM embeddings v, embeddings q WHERE {0}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM d)"
_PROFILE = f"""{PAPERS_SQL},
rows_ AS (SELECT p.arxiv_id, title, categories, (length(cleaned_text) % 100) / 100::DOUBLE AS quality_score, CASE WHEN label = 9 THEN 'noise' ELSE label::VARCHAR END AS cluster FROM papers p JOIN embeddings ON vec_id = arxiv_id),
base AS (SELECT cluster, count(*) AS size, avg(quality_score) AS avg_quality_score FROM rows_ GROUP BY cluster),
heads AS (SELECT cluster, string_agg(title, '|' ORDER BY arxiv_id) FILTER (r <= 3) AS sample_titles, string_agg(arxiv_id::VARCHAR, '|' ORDER BY arxiv_id) FILTER (r <= 10) AS paper_ids FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY arxiv_id) AS r FROM rows_) GROUP BY cluster),
cats AS (SELECT cluster, category, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, category) AS r FROM (SELECT cluster, unnest(categories) AS category FROM rows_) GROUP BY cluster, category),
tops AS (SELECT cluster, string_agg(category || '=' || n, '|' ORDER BY r) AS top_categories FROM cats WHERE r <= 5 GROUP BY cluster)"""
_CELLS = "x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY 1, 2), g AS (SELECT dim, sum(q - s * s / n) AS w, sum(s * s / n) AS b, sum(s) AS s, sum(n) AS n, count(*) AS k FROM c GROUP BY dim), a AS (SELECT max(n)::BIGINT AS rows, max(k)::BIGINT AS clusters, sum(w) AS inertia, sum(b - s * s / n) AS between FROM g)"
_PRED = "p AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label, CASE WHEN n_chars > 9000 THEN 'odd' WHEN n_chars > 700 THEN 'good' ELSE 'poor' END AS prediction FROM labels JOIN documents USING (doc_id)), cls AS (SELECT label FROM p UNION SELECT prediction FROM p), cm AS (SELECT c.label, (SELECT count(*) FROM p WHERE p.label = c.label) AS support, (SELECT count(*) FROM p WHERE p.prediction = c.label) AS predicted, (SELECT count(*) FROM p WHERE p.prediction = c.label AND p.label = c.label) AS hit FROM cls c), pr AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0 END::DOUBLE AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END::DOUBLE AS recall FROM cm), fm AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END::DOUBLE AS f1 FROM pr)"
_TERMS = r"tk AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) BETWEEN 3 AND 15)) AS term FROM documents), dt AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY 1, 2), nd AS (SELECT count(*) AS n FROM documents), va AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM dt GROUP BY term), vb AS (SELECT va.* FROM va, nd WHERE df >= 5 AND df <= 0.8 * n)"
_DATASET = f"{PAPERS_SQL}, {measures_sql('papers', 'cleaned_text', 'arxiv_id, title, categories')}, {SCORED_SQL}, ds AS (SELECT arxiv_id, title, x, categories, overall_score FROM q WHERE overall_score >= 0.3)"

_QUERIES = (
    usable_papers, top_categories, paper_stats, balanced_sample, balanced_events, feed_window, upsert_papers, latest_events, unprocessed_docs, papers_for_hits, knn_topk,
    cluster_analysis, cluster_composition, category_rollup, cluster_dispersion, silhouette_exact, class_distribution, stratified_split, class_metrics, overall_metrics,
    vocabulary, tfidf_weights, u_mass_coherence, vocabulary_all, tfidf_weights_all, u_mass_coherence_all, ml_dataset, ml_dataset_meta, dbscan_components, dbscan_sweep, kmeans_sweep, pca_2d, lda_topics, lsa_topics, classifier_contest,
)
QUERIES = {f.__name__: f for f in _QUERIES} | {"knn_topk_due": knn_topk}
ORACLES = {
    "usable_papers": "SELECT lang, count(*) AS papers FROM documents WHERE text <> '' AND length(text) >= 400 GROUP BY lang",
    "top_categories": f"WITH {PAPERS_SQL} SELECT category, count(*) AS papers FROM (SELECT unnest(categories) AS category FROM papers) GROUP BY category ORDER BY papers DESC, category LIMIT 10",
    "paper_stats": "SELECT count(*) AS total, count(*) FILTER (doc_id % 2 = 0) AS downloaded, count(*) FILTER (doc_id % 3 = 0) AS processed FROM documents",
    "balanced_sample": f"WITH {PAPERS_SQL}, r AS (SELECT category, arxiv_id, published, row_number() OVER (PARTITION BY category ORDER BY published DESC, arxiv_id)::INT AS rank FROM (SELECT *, unnest(categories) AS category FROM papers)) SELECT category, rank, arxiv_id, published FROM r WHERE rank <= 50",
    "balanced_events": "WITH r AS (SELECT event_type AS category, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id)::INT AS rank FROM events) SELECT category, rank, event_id, user_id FROM r WHERE rank <= 20",
    "feed_window": f"WITH {PAPERS_SQL} SELECT arxiv_id, published, array_to_string(categories, ',') AS categories FROM papers WHERE list_has_any(categories, ['cs.AI', 'cs.CL']) AND published BETWEEN DATE '2020-03-01' AND DATE '2021-12-31' ORDER BY published DESC, arxiv_id LIMIT 100",
    "upsert_papers": f"WITH {PAPERS_SQL}, o AS (SELECT arxiv_id, title, lang AS note, false AS done FROM papers WHERE arxiv_id % 3 <> 0), n AS (SELECT arxiv_id, title || ' v2' AS title, CASE WHEN arxiv_id % 4 = 0 THEN 'seen' END AS note FROM papers WHERE arxiv_id % 2 = 0) SELECT coalesce(n.arxiv_id, o.arxiv_id) AS arxiv_id, CASE WHEN n.arxiv_id IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.arxiv_id IS NOT NULL THEN n.note ELSE o.note END AS note, o.done FROM o FULL JOIN n ON o.arxiv_id = n.arxiv_id",
    "latest_events": "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "unprocessed_docs": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "papers_for_hits": f"WITH {PAPERS_SQL}, {_KNN.format('q.vec_id = 7')} SELECT arxiv_id, title, lang, rank FROM papers JOIN k ON vec_id = arxiv_id WHERE rank <= 10",
    "knn_topk": f"WITH {_KNN.format('q.vec_id % 20 = 0')} SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM k WHERE rank <= 10",
    "cluster_analysis": f"WITH {_PROFILE} SELECT cluster, size, round(avg_quality_score, 6) AS avg_quality_score, sample_titles, paper_ids, top_categories FROM base JOIN heads USING (cluster) LEFT JOIN tops USING (cluster)",
    "cluster_composition": f"WITH {_PROFILE} SELECT count(*) AS clusters, " + ", ".join(f"round({f}({c})::DOUBLE, 6) AS {n}_{k}" for n, c in (("quality", "avg_quality_score"), ("size", "size")) for k, f in (("avg", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + ", round(CASE WHEN min(size) > 0 THEN max(size)::DOUBLE / min(size) ELSE 0.0 END, 6) AS imbalance FROM base WHERE cluster <> 'noise'",
    "category_rollup": f"WITH {_PROFILE} SELECT category, sum(n)::BIGINT AS papers FROM cats WHERE r <= 5 AND cluster <> 'noise' GROUP BY category ORDER BY papers DESC, category LIMIT 10",
    "cluster_dispersion": f"WITH {_CELLS} SELECT rows, clusters, round(inertia, 4) AS inertia, round(between, 4) AS between, round((between / (clusters - 1)) / (inertia / (rows - clusters)), 4) AS calinski_harabasz FROM a",
    "silhouette_exact": "WITH d AS (SELECT a.vec_id AS a, a.label AS la, b.label AS lb, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), m AS (SELECT a, la, lb, avg(d) AS d FROM d GROUP BY 1, 2, 3), p AS (SELECT a, max(d) FILTER (la = lb) AS own, min(d) FILTER (la <> lb) AS other FROM m GROUP BY a) SELECT round(avg(CASE WHEN own IS NULL OR other IS NULL THEN 0.0 ELSE (other - own) / greatest(own, other) END), 6) AS silhouette FROM p",
    "class_distribution": "SELECT lang AS label, count(*) AS rows FROM documents GROUP BY lang",
    "stratified_split": "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.7) THEN 'train' ELSE 'test' END AS split FROM labels",
    "class_metrics": f"WITH {_PRED} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM fm",
    "overall_metrics": f"WITH {_PRED}, o AS (SELECT sum(hit) / sum(support) AS accuracy, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted, count(*) AS classes, sum(support)::BIGINT AS rows FROM fm) SELECT round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro, round(f1_weighted, 6) AS f1_weighted, classes, rows, CASE WHEN accuracy >= 0.9 THEN 'Excellent' WHEN accuracy >= 0.8 THEN 'Good' WHEN accuracy >= 0.7 THEN 'Fair' ELSE 'Poor' END AS verdict, f1_weighted > f1_macro AS imbalanced FROM o",
    "vocabulary": f"WITH {_TERMS} SELECT term, df, total FROM vb ORDER BY total DESC, term LIMIT 500",
    "tfidf_weights": f"WITH {_TERMS}, v AS (SELECT * FROM vb ORDER BY total DESC, term LIMIT 100), w AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w FROM dt JOIN v USING (term), nd) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w",
    "u_mass_coherence": f"WITH {_TERMS}, v AS (SELECT * FROM vb ORDER BY total DESC, term LIMIT 300), r AS (SELECT *, substr(term, 1, 1) AS topic, row_number() OVER (PARTITION BY substr(term, 1, 1) ORDER BY total DESC, term) AS rank FROM v), k AS (SELECT * FROM r WHERE rank <= 5), pr AS (SELECT a.topic, a.term AS better, b.term AS worse, a.df FROM k a JOIN k b ON a.topic = b.topic AND a.rank < b.rank) SELECT topic, round(avg(ln((coalesce((SELECT count(*) FROM dt x JOIN dt y USING (doc_id) WHERE x.term = better AND y.term = worse), 0) + 1.0::DOUBLE) / df)), 6) AS u_mass FROM pr GROUP BY topic",
    "ml_dataset": f"WITH {_DATASET} SELECT arxiv_id, title, length(x)::INT AS chars, array_to_string(categories, ',') AS categories, round(overall_score, 6) AS quality_score FROM ds",
    "ml_dataset_meta": f"WITH RECURSIVE {CHUNKS_SQL}, {_DATASET.removeprefix(PAPERS_SQL + ', ')}, " + "z AS (SELECT count(*) AS total_papers, coalesce(avg(overall_score), 0.0) AS a FROM ds) SELECT total_papers, (SELECT count(*) FROM chunked) AS total_chunks, (SELECT string_agg(DISTINCT c, ',' ORDER BY c) FROM (SELECT unnest(categories) AS c FROM ds)) AS categories, round(a, 6) AS avg_quality_score FROM z",
    "dbscan_components": "WITH RECURSIVE e AS (SELECT * FROM embeddings), d AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) <= 0.9), core AS (SELECT a FROM d GROUP BY a HAVING count(*) >= 3), l AS (SELECT d.a, d.b FROM d JOIN core x ON x.a = d.a JOIN core y ON y.a = d.b), reach AS (SELECT a, a AS r FROM core UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.a), comp AS (SELECT a, min(r) AS c FROM reach GROUP BY a), lab AS (SELECT e.vec_id, coalesce((SELECT min(c) FROM comp WHERE comp.a = e.vec_id), (SELECT min(c) FROM d JOIN comp ON comp.a = d.b WHERE d.a = e.vec_id), -1) AS cluster FROM e) SELECT vec_id, cluster FROM lab",
}
ORACLES["knn_topk_due"] = ORACLES["knn_topk"]
ORACLES["vocabulary_all"] = ORACLES["vocabulary"].replace("LIMIT 500", "LIMIT 10000")
ORACLES["tfidf_weights_all"] = ORACLES["tfidf_weights"].replace("LIMIT 100", "LIMIT 10000").replace("df >= 5 AND df <= 0.8 * n", "df >= 2 AND df <= 0.95 * n")
ORACLES["u_mass_coherence_all"] = ORACLES["u_mass_coherence"].replace("LIMIT 300", "LIMIT 10000")
