"""Proportional stratified interleaving: shards that all hold the mixture of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut
from paperloom.llm.ranks import BUCKETS, running_sum, seeded, source_key

SHARDS = 24
SEED = "shards-1"


def _placed(docs: DataFrame, carried: list[Column], shards: int, seed: str) -> DataFrame:
    rows = docs.select(*carried, "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("key", source_key(F.col("source"))).withColumn("shuffled", seeded(seed, F.col("doc_id"), F.col("text_crc32")))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("shuffled", 48).cast("int"))
    order = [F.col(c) for c in ("shuffled", "doc_id", "text_crc32", "size")]
    # a row for each source, in a file: the planner sees its size and joins accordingly
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    ranked = running_sum(rows, ["key"], "bucket", order, F.lit(1), "rank").drop("bucket")
    placed = ranked.join(sizes, "key").withColumn("fraction", (F.col("rank") + F.lit(0.5)) / F.col("n"))

    placed = placed.withColumn("bucket", F.least(F.floor(F.col("fraction") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("_n"))  # BUCKETS rows at most
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("bucket").orderBy("fraction", "key", *order)
    at = placed.join(F.broadcast(starts), "bucket").withColumn("place", F.col("_start") + F.row_number().over(inside) - 1)
    out = at.withColumn("shard", F.expr(f"cast((place * {shards}) div _all as int)"))
    return out.withColumn("slot", (F.col("place") - F.expr(f"(shard * _all + {shards - 1}) div {shards}")).cast("long"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, shard, slot of each row of ``docs``.

    Rows of a source are shuffled by a seeded hash and ranked; row r of n gets
    the fraction (r - 0.5) / n.  All rows are ordered by fraction (then source)
    and cut into ``shards`` runs whose lengths differ by one at most, so each
    run holds every source in proportion.

    size is the UTF-8 length of the text (null: 0) plus 8.  Rows without doc_id
    or source are dealt like others (the null source is a source of its own);
    repeated rows each get a slot.  Other columns are ignored.  No rows, no result.
    """
    return _placed(docs, [], shards, seed).select("doc_id", "source", "size", "text_crc32", "fraction", "shard", "slot")


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``docs`` with two more columns, shard and slot (columns of these names are replaced)."""
    out = _placed(docs, [F.struct(*docs.columns).alias("row")], shards, seed)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
