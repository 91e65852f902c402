"""Embedding columns: exact nearest neighbours, cluster quality, cluster profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import tiles as X

#: Bytes of query vectors that a task holds.
QUERY_BYTES = 32 << 20


def squared_distance(a: Column, b: Column) -> Column:
    apart = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(apart, F.lit(0.0), lambda s, d: s + d * d)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key, distance: the ``k`` nearest rows of each query (ties: least key).

    Queries come in parts of bounded bytes, each held by the tasks that go through
    all rows; a task keeps its own best ``k`` before rows are exchanged.  Rows
    without key or vector, or of another length, are near nothing.
    """
    kinds = queries.schema[key].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    asked = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(1)).alias("dims")).first()
    rows = X.packed(vectors, key, vector, X.block_rows(vectors, vectors.count()))
    met = X.crossed(rows, X.packed(queries, key, vector), asked["n"], asked["dims"], QUERY_BYTES)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "key"))
    found = X.best(met, k, kinds).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("key").alias(key), "distance")


def _exploded(vectors: DataFrame, label: str, key: str, vector: str) -> DataFrame:
    return vectors.select(key, label, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(vectors: DataFrame, label: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """label, n, centroid (array); sums are combined map-side."""
    means = _exploded(vectors, label, key, vector).groupBy(label, "dim").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda c: c["m"]).alias("centroid"))


def dispersion(vectors: DataFrame, label: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row: rows, clusters, inertia, between, calinski_harabasz.

    From sums and sums of squares by cluster and dimension: no pass over pairs.
    """
    x = _exploded(vectors, label, key, vector)
    cells = x.groupBy(label, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    within = cells.withColumn("within", F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    dims = within.groupBy("dim").agg(F.sum("within").alias("w"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("c"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("k"))
    total = dims.agg(F.max("n").alias("rows"), F.max("k").alias("clusters"), F.sum("w").alias("inertia"), F.sum(F.col("c") - F.col("s") * F.col("s") / F.col("n")).alias("between"))
    ch = F.when((F.col("clusters") > 1) & (F.col("rows") > F.col("clusters")), (F.col("between") / (F.col("clusters") - 1)) / (F.col("inertia") / (F.col("rows") - F.col("clusters"))))
    return total.withColumn("calinski_harabasz", ch)


def silhouette(vectors: DataFrame, label: str = "label", key: str = "vec_id", vector: str = "embedding", noise: int | None = None) -> DataFrame:
    """One row: the mean silhouette with Euclidean distances, exact; rows of the label ``noise`` are left out.

    Blocks of points meet in tiles; distances are summed by point and cluster as
    they are made, and the sums, not the pairs, are exchanged.  The cost is
    quadratic by definition: use :func:`dispersion` where that is too much.
    Rows without key or vector are left out; one without label is in no cluster and scores 0.
    """
    rows = (vectors if noise is None else vectors.where(F.col(label) != noise)).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dims")).collect()
    alone = sum(r["n"] for r in sizes if r[label] is None)
    rows, sizes = rows.where(F.col(label).isNotNull()), [r for r in sizes if r[label] is not None]
    n, dims = sum(r["n"] for r in sizes), max((r["dims"] for r in sizes), default=1)
    left = X.packed(rows, key, vector, X.block_rows(rows, n, len(sizes)), label=F.col(label))
    parts = X.summed(X.crossed(left, X.packed(rows, key, vector, label=F.col(label)), n, dims), [(r[label], r["n"]) for r in sizes])
    return parts.agg((F.coalesce(F.sum("total"), F.lit(0.0)) / F.nullif(F.coalesce(F.sum("n"), F.lit(0)) + alone, F.lit(0))).alias("silhouette"))


def cluster_profile(rows: DataFrame, label: str = "label", key: str = "doc_id", titles: int = 3, ids: int = 10, categories: int = 5) -> DataFrame:
    """For each cluster: size, first titles and ids (by key), top categories, mean quality.

    -1 is noise.  Only the first few rows of a cluster are ever collected.
    """
    named = rows.withColumn("cluster", F.when(F.col(label) == -1, F.lit("noise")).otherwise(F.col(label).cast("string")))
    base = named.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("quality_score").alias("avg_quality_score"))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(key))).where(F.col("r") <= max(titles, ids))
    heads = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "title", F.col(key).alias("id")))).alias("h"))
    counts = named.select("cluster", F.explode("categories").alias("category")).groupBy("cluster", "category").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "category"))).where(F.col("r") <= categories)
    top = best.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "category", "n"))).alias("t"))
    out = base.join(heads, "cluster", "left").join(top, "cluster", "left")
    return out.select("cluster", "size", "avg_quality_score", F.slice(F.transform("h", lambda x: x["title"]), 1, titles).alias("sample_titles"), F.slice(F.transform("h", lambda x: x["id"]), 1, ids).alias("paper_ids"), F.transform("t", lambda x: F.struct(x["category"].alias("category"), x["n"].alias("papers"))).alias("top_categories"))


def cluster_composition(profile: DataFrame) -> DataFrame:
    """One row over all clusters but noise: quality and size statistics, imbalance."""
    real = profile.where("cluster <> 'noise'")
    q, n = "avg_quality_score", "size"
    return real.agg(
        F.count("*").alias("clusters"),
        *[f(q).alias(f"quality_{name}") for name, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
        *[f(n).alias(f"size_{name}") for name, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
        F.when(F.min(n) > 0, F.max(n) / F.min(n)).otherwise(F.lit(0.0)).alias("imbalance"),
    )


def category_rollup(profile: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent categories over the clusters' top lists."""
    rows = profile.where("cluster <> 'noise'").select(F.explode("top_categories").alias("t"))
    return rows.groupBy(F.col("t.category").alias("category")).agg(F.sum("t.papers").alias("papers")).orderBy(F.desc("papers"), "category").limit(n)
