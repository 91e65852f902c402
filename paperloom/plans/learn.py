"""The learning run: dataset in, classification, clusters, topics and a summary out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import evaluation as E
from paperloom.operators import learning as L
from paperloom.operators import vectors as V
from paperloom.sources.feeds import model_text
from paperloom.sources.store import logger

#: Categories that a classifier learns.
LEARNABLE = ("cs.AI", "cs.CL", "cs.LG", "cs.CV", "cs.IR", "cs.NE", "cs.CY", "cs.HC", "cs.RO", "cs.SE", "cs.CR", "cs.DB", "cs.DC", "cs.SI", "stat.ML")
MIN_PAPERS = 10


#: Steps without which a run counts as failed.
NEEDED = ("loaded", "classified", "clustered")


def usable_texts(papers: DataFrame) -> DataFrame:
    """Papers that have a text: the column text, or abstract where there is no such column."""
    if "text" not in papers.columns:
        if "abstract" not in papers.columns:
            raise ValueError("no column text or abstract")
        papers = papers.withColumn("text", F.col("abstract"))
    return papers.where("text is not null")


def learn(dataset: DataFrame, key: str = "arxiv_id", features: int = 5000, ks: range = range(3, 15), topics: int = 10) -> dict[str, DataFrame]:
    """Tables of the run by name; steps that lack data or fail are left out.

    A step fails on its own (the reason is logged): summary tells which ones
    ran, rates how many, and whether all that are needed did.
    """
    out: dict[str, DataFrame] = {}
    dataset = usable_texts(dataset)
    enough = dataset.limit(MIN_PAPERS).count() >= MIN_PAPERS
    spark = dataset.sparkSession
    done: list[tuple[str, bool]] = [("loaded", enough)]

    def classify() -> bool:
        first = F.get("categories", F.lit(0))
        labelled = model_text(dataset, 1000).withColumn("category", first).where(F.col("category").isin(*LEARNABLE))
        if labelled.select("category").distinct().limit(2).count() < 2:
            return False
        out["contest"] = L.contest(labelled.select(key, F.col("model_text").alias("text"), "category"), "category", key, features)
        return True

    def texts() -> DataFrame:
        return model_text(dataset, 500).select(key, "title", "categories", "quality_score", F.col("model_text").alias("text"))

    def cluster() -> bool:
        from pyspark.ml.clustering import KMeans

        vectors = L.tfidf_pipeline(features).fit(texts()).transform(texts())
        out["kmeans"] = L.kmeans_sweep(vectors, ks)
        best = out["kmeans"].where("best").first()
        if best is None:
            return False
        labels = KMeans(k=best["k"], seed=L.SEED, featuresCol="features", predictionCol="label").fit(vectors).transform(vectors)
        out["profile"] = V.cluster_profile(labels.select(key, "title", "categories", "quality_score", "label"), key=key)
        out["composition"] = V.cluster_composition(out["profile"])
        out["clusterings"] = E.evaluate_clusterings(out["kmeans"].where("best").select(F.lit("kmeans").alias("method"), "silhouette", F.col("k").cast("long").alias("clusters")))
        return True

    def model_topics() -> bool:
        out["topics"] = L.lda_topics(texts(), topics, 10, features)
        return True

    for name, step in (("classified", classify), ("clustered", cluster), ("topics", model_topics)):
        if enough:
            try:
                done.append((name, step()))
            except Exception as reason:  # one step's failure doesn't end the run
                logger(__name__).warning("%s: %s", name, reason)
                done.append((name, False))
    out["summary"] = spark.createDataFrame(done, "step string, completed boolean")
    out["rates"] = E.run_rates(out["summary"], NEEDED)
    return out
