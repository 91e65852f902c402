"""Shared pieces: tables, held-out folds, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.scratch import cut, drop_cut, scratch_root
from paperloom.session import spread

__all__ = ["cut", "drop_cut", "has_word", "held_out", "scratch_root", "small_batches", "table"]

#: Rows of an Arrow batch handed to Python; bounds a worker's memory when texts are long.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; small ones are dealt to all cores, as one row group of long texts is one task."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small batches (runtime SQL settings)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def held_out(doc_id: Column) -> Column:
    """The fold that no model sees: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def has_word(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
