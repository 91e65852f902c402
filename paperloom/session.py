"""Sessions with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution re-plans joins and splits skewed partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

#: Bytes of a table for each core, below which its rows are dealt anew.
SPREAD_BYTES = 4 << 20


def session(app: str = "paperloom", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in more.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows of a small table to all cores.

    A file of one row group is one task, however long its texts take; a table
    with more than SPREAD_BYTES a core has tasks enough and is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(2 * cores) if size < cores * SPREAD_BYTES else rows


def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, for work that is heavy for its size."""
    return spread(read_table(spark, sf_dir, "documents"))
