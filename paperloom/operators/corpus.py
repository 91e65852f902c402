"""Relational operators on paper tables: samples, top lists, upserts, set tests, statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import settings as S
from paperloom.functions import quality as Q


def with_quality(papers: DataFrame, text: str = "text", sections: str | None = None, categories: str | None = None, least: float = S.ACCEPT_SCORE) -> DataFrame:
    """Add quality_metrics, accepted and reason.

    The measures pass through a one-row generator: the planner can't copy their
    expressions into every score that reads them.
    """
    measured = papers.withColumn("_m", F.explode(F.array(Q.measures(F.coalesce(F.col(text), F.lit(""))))))
    judged = measured.withColumn("quality_metrics", F.explode(F.array(Q.assessment(F.col("_m"), F.col(sections) if sections else None)))).drop("_m")
    decided = Q.decision(F.col("quality_metrics"), F.col(categories) if categories else None, least)
    return judged.withColumn("_d", F.explode(F.array(decided))).withColumn("accepted", F.col("_d.accepted")).withColumn("reason", F.col("_d.reason")).drop("_d")


def reason_key(reason: Column) -> Column:
    return F.split_part(reason, F.lit(":"), F.lit(1))


def rejection_histogram(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("accepted")).groupBy(reason_key(F.col("reason")).alias("reason")).agg(F.count("*").alias("papers"))


def acceptance(judged: DataFrame, *by: str) -> DataFrame:
    """total, accepted, rejected, acceptance_rate (of everything, or by columns)."""
    return judged.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.avg(F.col("accepted").cast("double")).alias("acceptance_rate"),
    )


def usable_papers(papers: DataFrame, text: str = "full_text", least: int = 100) -> DataFrame:
    """Papers with a text of at least ``least`` characters."""
    return papers.where((F.col(text) != "") & (F.length(text) >= least))


def feed_window(papers: DataFrame, categories: list[str] | None, start: datetime | None = None, end: datetime | None = None, limit: int = 100, at: str = "published", key: str = "arxiv_id") -> DataFrame:
    """The newest papers of any of the categories (none: all) in a range of dates; open ends allowed."""
    out = papers
    if categories:
        out = out.where(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])))
    if start is not None:
        out = out.where(F.col(at) >= F.lit(start))
    if end is not None:
        out = out.where(F.col(at) <= F.lit(end))
    return out.orderBy(F.desc(at), key).limit(limit)


def balanced_sample(papers: DataFrame, n: int, categories: list[str] | None = None, at: str = "published", key: str = "arxiv_id") -> DataFrame:
    """The newest ``n`` papers of each category; a paper of two categories may come twice.

    A rank filter on the window lets each task keep its own best ``n`` before
    rows are exchanged.
    """
    rows = papers.withColumn("category", F.explode("categories"))
    if categories:
        rows = rows.where(F.col("category").isin(categories))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc(at), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def budgeted(rows: DataFrame, budget: int, order: list[Column], existing: int = 0) -> DataFrame:
    """Rows admitted in order until, with those that exist, the budget is met."""
    return rows.orderBy(*order).limit(max(0, budget - existing))


def top_categories(papers: DataFrame, n: int = 10) -> DataFrame:
    counts = papers.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("papers"))
    return counts.orderBy(F.desc("papers"), "category").limit(n)


def paper_stats(papers: DataFrame) -> DataFrame:
    """total, downloaded, processed in one pass."""
    return papers.agg(F.count("*").alias("total"), F.count_if(F.coalesce("pdf_downloaded", F.lit(False))).alias("downloaded"), F.count_if(F.coalesce("pdf_processed", F.lit(False))).alias("processed"))


def latest_by_key(changes: DataFrame, key: str, *seq: str) -> DataFrame:
    """The last change of each key.  Maxima are taken map-side; no group is sorted."""
    others = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max(F.struct(*seq, *[c for c in others if c not in seq])).alias("_last")).select(key, *[F.col("_last")[c].alias(c) for c in others])


def upsert(stored: DataFrame, changes: DataFrame, key: str, present: str | None = None) -> DataFrame:
    """``stored`` with ``changes`` (one row for each key) merged in field by field.

    Columns that ``changes`` lacks keep their value; a column it has overwrites,
    even with null.  ``present`` names a column of ``changes`` with an array of
    the fields that a row sets, where that differs by row.  A change without key
    names no row and is dropped; stored rows without key stay as they are.
    """
    changes = changes.where(F.col(key).isNotNull())
    given = [c for c in changes.columns if c not in (key, present)]
    old, new = stored.alias("o"), changes.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new = F.coalesce(F.col("n._new"), F.lit(False))
    columns = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in [c for c in stored.columns if c != key]:
        sets = is_new if present is None else is_new & F.array_contains(f"n.{present}", c)
        columns.append(F.when(sets, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in given else F.col(f"o.{c}").alias(c))
    columns += [F.col(f"n.{c}").alias(c) for c in given if c not in stored.columns]
    return joined.select(*columns)


def not_yet(papers: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Papers without a row in ``done``: skip what was downloaded or processed before."""
    return papers.join(done.select(key).distinct(), key, "left_anti")


def papers_for_hits(papers: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Papers of a result list, with its rank column, so the order of similarity is kept."""
    return papers.join(hits, key)


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("rows"))


def enough_samples(rows: DataFrame, label: str, least: int = 3) -> DataFrame:
    """Rows of classes with at least ``least`` rows; all rows if fewer than two classes remain."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    good = counts.where(F.col("_n") >= least)
    enough = good.agg((F.count("*") >= 2).alias("_enough"))  # one row
    kept = counts.join(F.broadcast(enough)).where(~F.col("_enough") | (F.col("_n") >= least)).select(label)
    return rows.join(kept, label, "left_semi")


def ml_dataset(judged: DataFrame, key: str = "arxiv_id", least: float = S.DATASET_SCORE) -> DataFrame:
    """key, title, text, categories, quality_score of the papers good enough to learn from."""
    score = F.coalesce(F.col("quality_metrics.overall_score"), F.lit(0.0))
    return judged.where(score >= least).select(key, "title", F.col("cleaned_text").alias("text"), "categories", score.alias("quality_score"))


def ml_dataset_meta(dataset: DataFrame, chunks: DataFrame, dropped: Column | None = None) -> DataFrame:
    """One row: papers, chunks, distinct categories (sorted), mean score."""
    papers = dataset.agg(F.count("*").alias("total_papers"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"))
    return papers.join(F.broadcast(chunks.agg(F.count("*").alias("total_chunks"))))
