"""The cleaning pipeline: clean, sections, citations, quality, chunks, dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import settings as S
from paperloom.functions import citations as K
from paperloom.functions import text as T
from paperloom.operators import corpus as C
from paperloom.operators import sections as X
from paperloom.scratch import cut


@dataclass(frozen=True)
class Result:
    papers: DataFrame  # accepted, with everything found
    rejected: DataFrame
    sections: DataFrame
    chunks: DataFrame
    dataset: DataFrame
    stats: DataFrame


def clean_papers(papers: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Add cleaned_text, text_quality, text_sections (map), citations, citation_stats."""
    cleaned = papers.withColumn("cleaned_text", F.explode(F.array(T.clean_text(F.col("full_text")))))
    cleaned = cut(cleaned.withColumn("text_quality", T.assess(F.col("cleaned_text"), F.col("full_text"))), "cleaned")
    found = X.extract_sections(cleaned.select(key, F.col("cleaned_text").alias("text")), key)
    entries = F.array_sort(F.collect_list(F.struct("start_pos", "name", "content")))
    maps = found.groupBy(key).agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["name"], e["content"]))).alias("text_sections"))
    parsed = cleaned.join(maps, key, "left").withColumn("_c", F.explode(F.array(K.citations(K.reference_section(F.col("cleaned_text"))))))
    return parsed.withColumn("citations", K.normalized(F.col("_c"))).withColumn("citation_stats", K.statistics(F.col("_c"))).drop("_c")


def run(papers: DataFrame, key: str = "arxiv_id", text: str = "full_text") -> Result:
    """Everything derived from a table of papers (key, title, categories, and a text).

    Cleaned papers and judged ones are written once each; all tables of the
    result read them.
    """
    cleaned = clean_papers(C.usable_papers(papers.withColumnRenamed(text, "full_text") if text != "full_text" else papers), key)
    judged = cut(C.with_quality(cleaned.withColumn("_names", F.map_keys("text_sections")), "cleaned_text", "_names", "categories").drop("_names"), "judged")
    accepted = judged.where("accepted")
    sections = accepted.select(key, F.col("title").alias("paper_title"), "categories", F.col("quality_metrics.overall_score").alias("quality_score"), F.explode("text_sections").alias("name", "content")).withColumn("confidence", F.lit(S.CHUNK_CONFIDENCE))
    chunks = X.chunk_sections(sections, key)
    carried = accepted.select(key, F.col("title").alias("paper_title"), "categories", F.col("quality_metrics.overall_score").alias("quality_score"))
    return Result(accepted, judged.where(~F.col("accepted")), sections, chunks.join(carried, key), C.ml_dataset(accepted, key), C.acceptance(judged))


def ready_to_learn(result: Result, least: int = 50) -> bool:
    """Whether enough papers were accepted."""
    return result.papers.limit(least).count() >= least
