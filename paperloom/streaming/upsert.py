"""Incremental upkeep of a paper table from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from paperloom.operators.corpus import latest_by_key, upsert


def apply_changes(changes: DataFrame, table: str, key: str, seq: str) -> None:
    """Merge one batch into ``table`` (a folder with numbered versions; readers take the last).

    The table keeps ``seq``: a change older than what a key has, from whichever
    batch, is left out, and of equal ones the later batch wins.  Changes without
    key are dropped.
    """
    spark = changes.sparkSession
    now = current_version(spark, table)
    latest = latest_by_key(changes.where(F.col(key).isNotNull()), key, seq)
    if now is None:
        merged = latest
    else:
        stored = spark.read.parquet(f"{table}/v={now}")
        have = stored.select(key, F.col(seq).alias("_have"))
        fresh = latest.join(have, key, "left").where(F.col("_have").isNull() | (F.col(seq) >= F.col("_have"))).drop("_have")
        merged = upsert(stored, fresh, key)
    merged.write.mode("overwrite").parquet(f"{table}/v={0 if now is None else now + 1}")


def current_version(spark: SparkSession, table: str) -> int | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    names = [s.getPath() for s in fs.listStatus(where)]
    done = [int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{p.getName()}/_SUCCESS"))]
    return max(done, default=None)


def upsert_stream(spark: SparkSession, source: str, schema: StructType | str, table: str, key: str, seq: str, checkpoint: str) -> StreamingQuery:
    """Start a query that merges new files of ``source`` into ``table``, once each."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_changes(batch, table, key, seq)).trigger(availableNow=True).start()
