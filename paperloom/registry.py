"""All registered queries of the engine (without the subpackage for training data)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans import corpus_queries, quality_queries, source_queries, structure_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (quality_queries, structure_queries, corpus_queries, source_queries):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
