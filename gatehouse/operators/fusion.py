"""Fusing ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(long: DataFrame, query: str, cand: str, rank: str, source: str, k: int = 60, limit: int | None = None) -> DataFrame:
    """(query, cand, score, rank) of rows (query, source, cand, rank): the sum of 1/(k + rank), ties by the first
    appearance (sources in order, then rank)."""
    scores = long.groupBy(query, cand).agg(F.round(F.sum(1.0 / (k + F.col(rank))), 12).alias("score"), F.min(F.struct(F.col(source).alias("s"), F.col(rank).alias("r"))).alias("first"))
    best = Window.partitionBy(query).orderBy(F.desc("score"), "first")
    out = scores.withColumn("fused_rank", F.row_number().over(best).cast("long"))
    out = out if limit is None else out.where(F.col("fused_rank") <= limit)
    return out.select(query, cand, "score", F.col("fused_rank").alias("rank"))


def merged(primary: Column, secondary: Column, limit: int) -> Column:
    """Two lists of ids end to end, each id once at its first place, cut to ``limit``."""
    return F.slice(F.array_distinct(F.concat(primary, secondary)), 1, limit)
