"""Evaluation of classifiers, clusterings and topics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import settings as S
from paperloom.scratch import cut


def stratified_split(rows: DataFrame, label: str, key: str, train: float = 0.7) -> DataFrame:
    """Add split: of each class, the first ``train`` share in the order of md5(key) trains."""
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key)
    n = F.count("*").over(Window.partitionBy(label))
    return rows.withColumn("split", F.when(F.row_number().over(order) <= F.floor(n * train), "train").otherwise("test"))


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predictions.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of each class; nothing over nothing is 0."""
    cells = matrix.select(F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")),
    )).alias("x")).select("x.*")
    sums = cells.groupBy(F.col("c").alias("label")).agg(*[F.sum(k).alias(k) for k in ("support", "predicted", "hit")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    return sums.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support", "hit")


def overall_metrics(metrics: DataFrame) -> DataFrame:
    """accuracy, f1_macro, f1_weighted, classes, rows, and the verdict on them."""
    total = F.sum("support")
    out = metrics.agg((F.sum("hit") / total).alias("accuracy"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / total).alias("f1_weighted"), F.count("*").alias("classes"), total.alias("rows"))
    return out.withColumn("verdict", classification_verdict(F.col("accuracy"))).withColumn("imbalanced", F.col("f1_weighted") > F.col("f1_macro"))


def classification_verdict(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.9, "Excellent").when(accuracy >= 0.8, "Good").when(accuracy >= 0.7, "Fair").otherwise("Poor")


def clustering_verdict(method: Column, silhouette: Column, clusters: Column) -> Column:
    kmeans = F.when(silhouette >= 0.7, "Excellent").when(silhouette >= 0.5, "Good").when(silhouette >= 0.25, "Fair").otherwise("Poor")
    dbscan = F.when((clusters > 1) & (silhouette >= 0.3), "Good").when(clusters > 1, "Fair").otherwise("Poor")
    return F.when(method == "dbscan", dbscan).otherwise(kmeans)


def evaluate_clusterings(results: DataFrame) -> DataFrame:
    """(method, silhouette, clusters) with verdict and best: the method of the greatest silhouette,
    of equal ones the first by name."""
    judged = results.withColumn("verdict", clustering_verdict(F.col("method"), F.col("silhouette"), F.col("clusters")))
    top = judged.agg(F.max(F.struct(F.col("silhouette"))).alias("t"))  # one row
    first = judged.join(F.broadcast(top), F.col("silhouette") == F.col("t.silhouette"), "left_semi").agg(F.min("method").alias("_first"))
    return judged.join(F.broadcast(first)).withColumn("best", F.col("method") == F.col("_first")).drop("_first")


def recommendations(overall: DataFrame | None, clusterings: DataFrame | None) -> list[str]:
    """What to do next, from one row of overall metrics and the judged clusterings."""
    out = []
    row = overall.first() if overall is not None else None
    if row is not None:
        out.append(S.CLASSIFIER_ADVICE["weak" if row["accuracy"] < S.LEAST_ACCURACY else "imbalanced" if row["imbalanced"] else "fine"])
    best = clusterings.where("best").first() if clusterings is not None else None
    if best is not None:
        out.append(S.CLUSTER_ADVICE["weak" if best["silhouette"] < S.LEAST_SILHOUETTE else "fine"])
    return out


def run_rates(steps: DataFrame, needed: tuple[str, ...] = ()) -> DataFrame:
    """One row of (step, completed): steps, completed, success_rate, overall (all of ``needed``, or all)."""
    counted = F.col("step").isin(*needed) if needed else F.lit(True)
    return steps.agg(F.count("*").alias("steps"), F.count_if("completed").alias("completed"), F.avg(F.col("completed").cast("double")).alias("success_rate"), F.coalesce(F.bool_and(F.when(counted, F.col("completed"))), F.lit(False)).alias("overall"))


def first_best(grid: DataFrame, metric: str, order: str, *by: str) -> DataFrame:
    """The row of the greatest metric; of several the first in ``order``."""
    columns = [c for c in grid.columns if c not in (metric, order, *by)]
    best = grid.groupBy(*by).agg(F.max(F.struct(F.col(metric), (-F.col(order)).alias("_o"), *columns)).alias("b"))
    return best.select(*by, (-F.col("b._o")).alias(order), F.col(f"b.{metric}"), *[F.col(f"b.{c}") for c in columns])


def document_terms(docs: DataFrame, terms: Column, key: str = "doc_id") -> DataFrame:
    """key, term, tf.

    Documents are dealt by key before they are taken apart, so counts (and what
    is done by key with them) need no exchange: a document is far smaller than
    the rows of its terms.
    """
    return docs.repartition(key).select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vocabulary(doc_terms: DataFrame, documents: int, min_docs: int = 2, max_share: float = 0.95, size: int = 10000) -> DataFrame:
    """term, df, total of the most frequent terms that are neither too rare nor too common."""
    counts = doc_terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    kept = counts.where((F.col("df") >= min_docs) & (F.col("df") <= max_share * documents))
    return kept.orderBy(F.desc("total"), "term").limit(size)


def tfidf(doc_terms: DataFrame, vocab: DataFrame, documents: int, key: str = "doc_id", sublinear: bool = False) -> DataFrame:
    """key, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), scaled to unit length."""
    tf = F.lit(1.0) + F.log("tf") if sublinear else F.col("tf").cast("double")
    vocab = cut(vocab.select("term", "df"), "vocabulary")  # of files, so that the planner knows its size and the terms stay with their document
    raw = doc_terms.join(vocab, "term").withColumn("w", tf * (F.log((F.lit(1.0) + documents) / (F.lit(1.0) + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))


def u_mass(topic_terms: DataFrame, doc_terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """topic, u_mass from (topic, term, rank): mean log of (documents with both + 1) over
    documents with the better-ranked one.  Only topic terms are joined; these
    and their documents are written once, for the passes over them."""
    topic_terms = cut(topic_terms.select("topic", "term", "rank"), "topics")
    used = cut(doc_terms.join(topic_terms.select("term").distinct(), "term", "left_semi").select(key, "term"), "used")
    alone = used.groupBy("term").agg(F.count("*").alias("n"))
    ranked = topic_terms.select("topic", "term", "rank")
    pairs = ranked.alias("a").join(ranked.alias("b"), (F.col("a.topic") == F.col("b.topic")) & (F.col("a.rank") < F.col("b.rank"))).select(F.col("a.topic").alias("topic"), F.col("a.term").alias("better"), F.col("b.term").alias("worse"))
    wanted = pairs.select("better", "worse").distinct()
    together = wanted.join(used.withColumnRenamed("term", "better"), "better").join(used.withColumnRenamed("term", "worse"), ["worse", key]).groupBy("better", "worse").agg(F.count("*").alias("both"))
    scored = pairs.join(together, ["better", "worse"], "left").join(alone.withColumnRenamed("term", "better"), "better")
    return scored.groupBy("topic").agg(F.avg(F.log((F.coalesce("both", F.lit(0)) + F.lit(1.0)) / F.col("n"))).alias("u_mass"))
