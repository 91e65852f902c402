"""Features, topic models, classifiers and clusterings on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import settings as S
from paperloom.functions.text import deaccented
from paperloom.operators import tiles as X
from paperloom.operators.vectors import silhouette, squared_distance
from paperloom.scratch import cut, drop_cut

SEED = 42


def with_vectors(rows: DataFrame, column: str, out: str = "features") -> DataFrame:
    return rows.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def stop_words(more: Iterable[str] = ()) -> list[str]:
    """The English list that ships with the engine, words common to all papers, and any others."""
    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *S.DOMAIN_STOP_WORDS, *more})


def topic_tokens(text: Column, stops: Iterable[str] | None = None) -> Column:
    """Lower-cased words without accents, of 3 to 15 letters, that are no stop words.

    No lemmas: they need a dictionary that the engine lacks.
    """
    listed = F.array(*[F.lit(w) for w in (stop_words() if stops is None else stops)])
    words = F.regexp_extract_all(deaccented(F.lower(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike(r"^\p{L}{3,15}$") & ~F.array_contains(listed, w))


def tfidf_pipeline(features: int = 10000, min_df: float = 2, max_df: float = 0.95, bigrams: bool = True, text: str = "text", counts_only: bool = False) -> Pipeline:
    """Tokens without stop words, one- and two-word terms, counts, IDF and unit length (sparse throughout)."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        StopWordsRemover(inputCol="tokens", outputCol="words"),
    ]
    terms = "words"
    if bigrams:
        stages += [NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")]
        terms = "terms"
    stages.append(CountVectorizer(inputCol=terms, outputCol="features" if counts_only else "tf", vocabSize=features, minDF=min_df, maxDF=max_df))
    if not counts_only:
        stages += [IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features", p=2.0)]
    return Pipeline(stages=stages)


def vocabulary_of(model: PipelineModel) -> list[str]:
    return next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))


def kmeans_sweep(rows: DataFrame, ks: Iterable[int] = range(3, 15), seeds: Iterable[int] = (SEED,), features: str = "features") -> DataFrame:
    """k, silhouette (squared Euclidean), inertia, best for each k; of equal ones the first k is best."""
    spark, n = rows.sparkSession, rows.count()
    rows = rows.persist()
    judge = ClusteringEvaluator(featuresCol=features, predictionCol="cluster")
    found = []
    for k in ks:
        if k >= n:
            continue
        models = [KMeans(k=k, seed=s, featuresCol=features, predictionCol="cluster").fit(rows) for s in seeds]
        best = min(models, key=lambda m: m.summary.trainingCost)
        found.append((k, float(judge.evaluate(best.transform(rows))), float(best.summary.trainingCost)))
    rows.unpersist()
    top = max((s for _, s, _ in found), default=None)
    first = next((k for k, s, _ in found if s == top), None)
    return spark.createDataFrame([(k, s, i, k == first) for k, s, i in found], "k int, silhouette double, inertia double, best boolean")


def pca(rows: DataFrame, key: str, k: int = 2, features: str = "features") -> DataFrame:
    """key, x, y: the plot coordinates of each row (a sign may differ between runs of other data)."""
    model = PCA(k=k, inputCol=features, outputCol="pc").fit(rows)
    at = vector_to_array("pc")
    return model.transform(rows).select(key, at[0].alias("x"), at[1].alias("y"))


def lda_topics(docs: DataFrame, topics: int = 10, terms: int = 10, features: int = 5000, iterations: int = 100, text: str = "text", fit_priors: bool = True) -> DataFrame:
    """topic, rank, word, weight, document_frequency, log_perplexity of an online LDA model.

    ``fit_priors`` learns how much of each topic a document has beforehand.
    """
    model = tfidf_pipeline(features, min_df=2, bigrams=False, text=text, counts_only=True).fit(docs)
    counts = model.transform(docs).persist()
    lda = LDA(k=topics, maxIter=iterations, optimizer="online", seed=SEED, featuresCol="features", optimizeDocConcentration=fit_priors).fit(counts)
    words = F.array(*[F.lit(w) for w in vocabulary_of(model)])
    shares = lda.transform(counts).select(F.posexplode(vector_to_array("topicDistribution")).alias("topic", "p")).groupBy("topic").agg(F.sum("p").alias("document_frequency"))
    listed = lda.describeTopics(terms).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    perplexity = float(lda.logPerplexity(counts))
    shares = cut(shares, "shares")  # read after the counts are let go
    counts.unpersist()
    return listed.join(shares, "topic").select("topic", (F.col("rank") + 1).alias("rank"), F.get(words, F.col("t.termIndices")).alias("word"), F.col("t.termWeights").alias("weight"), "document_frequency", F.lit(perplexity).alias("log_perplexity"))


def document_topics(model, counts: DataFrame, key: str, least: float = 0.1) -> DataFrame:
    """key, topic, share of the topics with at least ``least`` of a document."""
    return model.transform(counts).select(key, F.posexplode(vector_to_array("topicDistribution")).alias("topic", "share")).where(F.col("share") >= least)


def lsa_topics(rows: DataFrame, vocabulary: list[str], components: int = 10, terms: int = 10, features: str = "features") -> DataFrame:
    """component, rank, word, weight, explained, cumulative: the strongest words (by absolute weight) of a truncated SVD.

    The decomposition of the sparse rows is the distributed one of the matrix
    library; only the components come back.
    """
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    spark = rows.sparkSession
    held = MLUtils.convertVectorColumnsFromML(rows.select(features), features).persist()  # the iterations read it many times
    svd = RowMatrix(held).computeSVD(min(components, len(vocabulary)), computeU=False)
    held.unpersist()
    squares = [float(s) ** 2 for s in svd.s]
    total = sum(squares) or 1.0
    right = svd.V.toArray()
    found = []
    for c in range(right.shape[1]):
        weights = np.abs(right[:, c])
        near = np.flatnonzero(weights >= np.partition(weights, -min(terms, len(weights)))[-min(terms, len(weights))])
        order = sorted(near.tolist(), key=lambda i: (-weights[i], vocabulary[i]))[:terms]
        sign = 1.0 if right[order[0], c] >= 0 else -1.0
        found += [(c, r + 1, vocabulary[i], float(sign * right[i, c]), squares[c] / total, sum(squares[: c + 1]) / total) for r, i in enumerate(order)]
    return spark.createDataFrame(found, "component int, rank int, word string, weight double, explained double, cumulative double")


def contest(rows: DataFrame, category: str, key: str, features: int = 10000, folds: int | None = None) -> DataFrame:
    """model, cv_f1, test_f1, accuracy, best: class-weighted logistic regression against a linear SVM.

    Rows are split 70 : 30 in each class in the order of md5(key).  The kernel
    of the SVM is linear: Spark has no other.
    """
    from paperloom.operators.evaluation import stratified_split

    spark = rows.sparkSession
    indexed = StringIndexer(inputCol=category, outputCol="label", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    split = stratified_split(indexed, category, key)
    model = tfidf_pipeline(features).fit(split.where("split = 'train'"))
    ready = model.transform(split).select(key, "label", "split", "features")
    sizes = ready.where("split = 'train'").groupBy("label").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("all"), F.count("*").alias("k")).first()
    weighted = ready.join(F.broadcast(sizes), "label").withColumn("weight", F.lit(float(whole["all"])) / (F.lit(float(whole["k"])) * F.col("n"))).persist()
    train, test = weighted.where("split = 'train'"), weighted.where("split = 'test'")
    smallest = int(sizes.agg(F.min("n")).first()[0])
    folds = folds or max(2, min(5, smallest // 2))
    f1 = MulticlassClassificationEvaluator(metricName="f1")
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
    found = []
    for name, learner in (("linear_svm", OneVsRest(classifier=LinearSVC(maxIter=20))), ("logistic_regression", LogisticRegression(maxIter=100, weightCol="weight"))):
        folded = CrossValidator(estimator=learner, estimatorParamMaps=ParamGridBuilder().build(), evaluator=f1, numFolds=folds, seed=SEED).fit(train)
        tested = folded.bestModel.transform(test)
        found.append((name, float(folded.avgMetrics[0]), float(f1.evaluate(tested)), float(accuracy.evaluate(tested))))
    weighted.unpersist()
    top = max(x[2] for x in found)
    first = next(x[0] for x in found if x[2] == top)
    return spark.createDataFrame([(*x, x[0] == first) for x in found], "model string, cv_f1 double, test_f1 double, accuracy double, best boolean")


def predictions(model, rows: DataFrame, labels: list[str], *keep: str) -> DataFrame:
    """Columns to keep, predicted_category, confidence, all_probabilities (map)."""
    names = F.array(*[F.lit(x) for x in labels])
    p = vector_to_array("probability")
    return model.transform(rows).select(*keep, F.get(names, F.col("prediction").cast("int")).alias("predicted_category"), F.array_max(p).alias("confidence"), F.map_from_arrays(names, p).alias("all_probabilities"))


#: Neighbours are looked for in cells of this many dimensions.
CELL_DIMENSIONS = 2


def near_pairs(vectors: DataFrame, eps: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b) of all ordered pairs within ``eps``, each row with itself too.

    The dimensions that vary most are cut into cells as wide as ``eps``; rows
    meet only those of their own and the touching cells, then distances decide.
    Where ``eps`` is wide against the data, cells are few and all pairs meet.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("a"), F.col(vector).alias("x"))
    spreads = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.var_pop(F.col("v").cast("double")).alias("s"))
    widest = [r["dim"] for r in spreads.orderBy(F.desc("s"), "dim").limit(CELL_DIMENSIONS).collect()]
    cells = [F.floor(F.get("x", F.lit(d)).cast("double") / max(eps, 1e-12)) for d in widest]
    left = rows.select("a", "x", F.struct(F.lit(0), *cells).alias("cell"))
    around = [F.lit(0).alias("c0")]
    right = rows.select(F.col("a").alias("b"), F.col("x").alias("y"), *[c.alias(f"c{k + 1}") for k, c in enumerate(cells)])
    for k in range(len(cells)):
        right = right.withColumn(f"c{k + 1}", F.explode(F.array(*[F.col(f"c{k + 1}") + d for d in (-1, 0, 1)])))
    right = right.select("b", "y", F.struct(*around, *[F.col(f"c{k + 1}") for k in range(len(cells))]).alias("cell"))
    return left.join(right, "cell").where(F.sqrt(squared_distance(F.col("x"), F.col("y"))) <= eps).select("a", "b")


def dbscan(vectors: DataFrame, eps: float, min_samples: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster: the least key of the cluster's core points, -1 for noise.

    Core points have ``min_samples`` neighbours within ``eps``, themselves
    included.  Neighbours are counted, core points joined, and border points
    given the least label they reach, in tiles of all pairs; no pair is listed.
    What the tasks have joined is joined further by spreading the least label
    until nothing changes; a label also takes over its own label, so rounds grow
    as the logarithm of a chain.  Every round is written to files, and the one
    before it deleted.  Rows without a vector are noise.
    """
    kind = vectors.schema[key].dataType.simpleString()
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(1)).alias("dims")).first()
    rows = X.block_rows(vectors, size["n"])
    blocks = cut(X.packed(vectors, key, vector, rows), "blocks")
    near = X.neighbours(X.crossed(blocks, blocks, size["n"], size["dims"]), eps, kind)
    core = cut(near.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select(F.col("key").alias("a")), "core")
    dense = vectors.select(F.col(key).alias("a"), F.col(vector).alias("x")).join(core, "a")
    blocks = cut(X.packed(dense, "a", "x", rows), "blocks")
    forest = cut(X.linked(X.crossed(blocks, blocks, size["n"], size["dims"]), eps, kind).distinct(), "forest")
    links = cut(core.select("a", F.col("a").alias("b")).unionByName(forest.select(F.col("key").alias("a"), F.col("root").alias("b"))).unionByName(forest.select(F.col("root").alias("a"), F.col("key").alias("b"))), "links")
    labels = core.select("a", F.col("a").alias("c"))
    changed, rounds = True, 0
    while changed:
        spread = links.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("c").alias("c"))
        further = labels.select(F.col("a").alias("c"), F.col("c").alias("d"))
        spread = cut(spread.join(further, "c").select("a", F.least("c", "d").alias("c")), "labels")
        changed = not spread.join(labels.withColumnRenamed("c", "old"), "a").where("c <> old").isEmpty()
        if rounds:
            drop_cut(labels)
        labels, rounds = spread, rounds + 1
    named = vectors.select(F.col(key).alias("a"), F.col(vector).alias("x")).join(labels, "a")
    rest = vectors.select(F.col(key).alias("a"), F.col(vector).alias("x")).join(core, "a", "left_anti")
    met = X.crossed(X.packed(rest, "a", "x", rows), X.packed(named, "a", "x", rows, label=F.col("c")), size["n"], size["dims"])
    border = X.reached(met, eps, kind).groupBy(F.col("key").alias("a")).agg(F.min("label").alias("border"))
    out = vectors.select(F.col(key).alias("a")).join(labels, "a", "left").join(border, "a", "left")
    return out.select(F.col("a").alias(key), F.coalesce("c", "border", F.lit(-1)).alias("cluster"))


def dbscan_sweep(vectors: DataFrame, radii: Iterable[float] = (0.1, 0.3, 0.5, 0.7, 1.0), min_samples: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """eps, clusters, noise, silhouette (without noise), best for each eps that gives two clusters or more;
    of equal ones the first eps is best."""
    found = []
    for eps in radii:
        labelled = cut(vectors.select(key, vector).join(dbscan(vectors, eps, min_samples, key, vector), key), "clusters")
        sizes = labelled.agg(F.count_if(F.col("cluster") == -1).alias("noise"), F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters")).first()
        if sizes["clusters"] >= 2:
            found.append((float(eps), sizes["clusters"], sizes["noise"], float(silhouette(labelled, "cluster", key, vector, noise=-1).first()[0])))
    top = max((x[3] for x in found), default=None)
    first = next((x[0] for x in found if x[3] == top), None)
    return vectors.sparkSession.createDataFrame([(*x, x[0] == first) for x in found], "eps double, clusters long, noise long, silhouette double, best boolean")


def embedded(rows: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "embedding_text", out: str = "embedding", batch: int = 32) -> DataFrame:
    """``rows`` with the vectors of their texts (null: of an empty text).

    ``encoder`` makes, once for each Python worker task, a function from a list of at
    most ``batch`` texts to their vectors.  Texts go to Python in Arrow batches;
    no row leaves its task.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for part in parts:
            texts = part.fillna("").tolist()
            vectors = [v for k in range(0, len(texts), batch) for v in encode(texts[k : k + batch])]
            yield pd.Series([[float(x) for x in v] for v in vectors])

    return rows.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def topic_report(topics: DataFrame, coherence: DataFrame, variance: DataFrame | None = None) -> DataFrame:
    """One row: topics, log_perplexity, u_mass (their mean), and, of a decomposition, what it explains."""
    one = topics.agg(F.countDistinct("topic").alias("topics"), F.max("log_perplexity").alias("log_perplexity"))
    out = one.join(F.broadcast(coherence.agg(F.avg("u_mass").alias("u_mass"))))
    return out if variance is None else out.join(F.broadcast(variance.agg(F.max("cumulative").alias("explained"))))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """A model of any kind that :func:`save_model` wrote: its files name its class."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(path, spark)
