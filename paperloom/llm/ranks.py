"""Ranks and running sums that no single task computes for a whole key.

Rows are dealt into ordered buckets; bucket totals are summed first, then each
bucket is ordered on its own.  A key with a third of all rows spreads over all
of its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ordered buckets of one key.
BUCKETS = 4096


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows that come before, within ``keys``.

    ``bucket`` must not decrease along ``order``; ``keys`` and ``bucket`` are not null.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(starts, [*keys, bucket])
    return out.withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_start")


def seeded(seed: str, *parts: Column) -> Column:
    """60 uniform bits as a long, from the MD5 of the seed and the parts (null: empty)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A source as a key without nulls; its order is by code point, null last."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("s"), source))
