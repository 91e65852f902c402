"""Stored results: papers, chunks, datasets, statistics, retention."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import content_hash
from paperloom.operators.evaluation import recommendations


def logger(name: str, level: int = logging.INFO) -> logging.Logger:
    log = logging.getLogger(name)
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
        log.setLevel(level)
    return log


class Store:
    """A folder of Parquet tables: papers/, chunks/ (by batch), dataset_papers/, dataset_chunks/, embeddings/."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _has(self, name: str) -> bool:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(self._at(name))
        return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)

    # --- papers
    def save_papers(self, papers: DataFrame, mode: str = "append") -> dict[str, int]:
        """Papers with an id are written, with what was done to them; the others are counted."""
        done = F.struct(F.current_timestamp().alias("processed_at"), content_hash(F.col("cleaned_text")).alias("text_hash"), F.length(F.coalesce("full_text", F.lit(""))).alias("original_length"), F.length("cleaned_text").alias("cleaned_length"))
        counts = papers.agg(F.count_if(F.col("arxiv_id").isNotNull()).alias("saved"), F.count_if(F.col("arxiv_id").isNull()).alias("failed")).first()
        papers.where("arxiv_id is not null").withColumn("processing_metadata", done).write.mode(mode).parquet(self._at("papers"))
        return {"saved": counts["saved"], "failed": counts["failed"]}

    def load_paper(self, arxiv_id: str, text_only: bool = False) -> DataFrame:
        """One paper; ``text_only`` reads five columns, so no second copy is stored."""
        found = self.spark.read.parquet(self._at("papers")).where(F.col("arxiv_id") == arxiv_id)
        return found.select("arxiv_id", "title", "cleaned_text", "categories", F.col("quality_metrics.overall_score").alias("quality_score")) if text_only else found

    # --- chunks
    def save_chunks(self, chunks: DataFrame, run: str) -> None:
        """Chunks by batch, under a run's name, so a later scan can leave earlier runs out."""
        chunks.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "batch").parquet(self._at("chunks"))

    def load_chunks(self, run: str | None = None, batch: int | None = None, limit: int | None = None) -> DataFrame:
        out = self.spark.read.parquet(self._at("chunks"))
        out = out if run is None else out.where(F.col("run") == run)
        out = out if batch is None else out.where(F.col("batch") == batch)
        return out.limit(limit) if limit else out

    # --- datasets
    def save_dataset(self, papers: DataFrame, chunks: DataFrame, name: str = "dataset") -> None:
        papers.write.mode("overwrite").parquet(self._at(f"{name}_papers"))
        chunks.write.mode("overwrite").parquet(self._at(f"{name}_chunks"))

    def load_dataset(self, name: str = "dataset") -> tuple[DataFrame, DataFrame] | None:
        if not self._has(f"{name}_papers"):
            return None
        return self.spark.read.parquet(self._at(f"{name}_papers")), self.spark.read.parquet(self._at(f"{name}_chunks"))

    def add_embeddings(self, rows: DataFrame) -> None:
        """Append vectors by key; keys that are stored already are left alone."""
        if self._has("embeddings"):
            rows = rows.join(self.spark.read.parquet(self._at("embeddings")).select("key"), "key", "left_anti")
        rows.dropDuplicates(["key"]).write.mode("append").parquet(self._at("embeddings"))

    # --- statistics and retention
    def files(self, name: str) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self._at(name)).select("path", "modificationTime", "length")

    def stats(self) -> DataFrame:
        """kind, files, size_mb, rows of each table that is there."""
        out = None
        for kind in ("papers", "chunks", "dataset_papers", "dataset_chunks", "embeddings"):
            if self._has(kind) and not self.files(kind).isEmpty():
                rows = self.spark.read.parquet(self._at(kind)).agg(F.count("*").alias("rows"))
                part = self.files(kind).agg(F.count("*").alias("files"), F.round(F.sum("length") / (1 << 20), 2).alias("size_mb")).join(rows).select(F.lit(kind).alias("kind"), "files", "size_mb", "rows")
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "kind string, files bigint, size_mb double, rows bigint")

    def cleanup(self, keep_days: int = 30, now: datetime | None = None) -> int:
        """Delete chunk files older than ``keep_days``; returns how many."""
        if not self._has("chunks"):
            return 0
        limit = (now or datetime.now(timezone.utc)) - timedelta(days=keep_days)
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        old = [r["path"] for r in self.files("chunks").where(F.unix_timestamp("modificationTime") < int(limit.timestamp())).select("path").collect()]
        for path in old:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, False)
        return len(old)


def read_json_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Papers and chunks of a dataset kept as one JSON object (gzip by file name)."""
    whole = spark.read.option("multiLine", True).json(path)

    def rows(part: str) -> DataFrame:
        kinds = dict(whole.dtypes)
        if not kinds.get(part, "").startswith("array<struct"):  # missing or empty
            return spark.createDataFrame([], "arxiv_id string")
        return whole.select(F.explode(part).alias("x")).select("x.*")

    return rows("papers"), rows("chunks")


def write_json(df: DataFrame, path: str) -> None:
    """Lines of JSON, gzip-compressed; non-ASCII kept, times in ISO form."""
    df.write.mode("overwrite").option("compression", "gzip").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a JSON file or folder (gzip by name); None where it is missing or holds no JSON object."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    found = spark.read.option("multiLine", True).json(path)
    return None if not found.columns or found.columns == ["_corrupt_record"] else found


def save_results(path: str, **tables: DataFrame) -> None:
    """Each result table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        write_json(df, f"{path.rstrip('/')}/{name}")


def load_results(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame | None]:
    """The result tables of these names, None for those that aren't there."""
    root = path.rstrip("/")
    out = {}
    for name in names:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        out[name] = spark.read.json(f"{root}/{name}") if there else None
    return out


def evaluation_report(overall: DataFrame | None = None, clusterings: DataFrame | None = None, categories: DataFrame | None = None) -> str:
    """The text report of a run: classifier, clusterings (best first), top categories, what to do next."""
    lines = ["MODEL EVALUATION REPORT", "=" * 23, "", "Classification"]
    row = overall.first() if overall is not None else None
    if row is None:
        lines.append("  No classification results available.")
    else:
        lines.append(f"  Overall Assessment: {row['verdict']}")
        lines += [f"  {name}: {row[column]:.3f}" for name, column in (("Accuracy", "accuracy"), ("F1 Weighted", "f1_weighted"), ("F1 Macro", "f1_macro"))]
        lines += [f"  Classes Handled: {row['classes']}", f"  Test Samples: {row['rows']}"]
        if row["imbalanced"]:
            lines.append(f"  Imbalance: weighted F1 lies {row['f1_weighted'] - row['f1_macro']:.3f} above macro F1")
    lines += ["", "Clustering"]
    methods = [] if clusterings is None else clusterings.orderBy(F.desc("best"), "method").limit(100).collect()
    for m in methods:
        lines.append(f"  {m['method'].upper()}: {m['verdict']}, clusters {m['clusters']}, silhouette {m['silhouette']:.3f}" + " (best)" * bool(m["best"]))
    if not methods:
        lines.append("  No clustering results available.")
    if categories is not None:
        lines += ["", "Top Categories", *[f"  {r['category']}: {r['papers']}" for r in categories.orderBy(F.desc("papers"), "category").limit(3).collect()]]
    return "\n".join([*lines, "", "Recommendations", *[f"  {x}" for x in recommendations(overall, clusterings)]])


def report(title: str, **tables: DataFrame) -> str:
    """A text report over small result tables (at most 100 rows of each are shown)."""
    parts = [title, "=" * len(title)]
    for name, df in tables.items():
        parts += ["", name.replace("_", " ")]
        parts += ["  " + json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False) for r in df.limit(100).collect()]
    return "\n".join(parts)
