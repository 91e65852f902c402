"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import cut, drop_cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node hands its neighbours to the least of them."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(id, component) of every node of ``edges``; component is the least id reachable.

    Alternates the large-star and small-star contractions (Kiveris et al. 2014)
    until the link table is a set of stars.  Every round writes its links to the
    scratch folder; no round gathers a node's neighbours, it only takes minima.
    """
    now = cut(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == before or not mark.n:
            break
        before = (mark.n, mark.h)
        after = cut(_stars(_stars(now, True), False), "links")
        drop_cut(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
