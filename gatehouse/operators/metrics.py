"""Rank metrics and rates as aggregates.  Empty input gives zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order


def rate(condition: Column) -> Column:
    return F.round(F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0)), 6)


def share(part: Column, whole: Column) -> Column:
    """How often ``part`` holds where ``whole`` does; 0 where it never does."""
    return F.round(F.coalesce(F.try_divide(F.count_if(part & whole).cast("double"), F.count_if(whole)), F.lit(0.0)), 6)


def mean(value: Column) -> Column:
    return F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6)


def rank_aggregates(rank: Column | str, recalls: tuple[int, ...] = (3, 5, 10)) -> list[Column]:
    """n, acc_at_1, recall_at_k, mrr, mean_rank."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return [F.count(r).alias("n"), rate(r == 1).alias("acc_at_1"), *[rate(r <= k).alias(f"recall_at_{k}") for k in recalls], mean(1.0 / r).alias("mrr"), mean(r.cast("double")).alias("mean_rank")]


def rank_metrics(df: DataFrame, rank: str, by: list[str] | None = None, recalls: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*rank_aggregates(rank, recalls))


def worst_group(df: DataFrame, by: list[str], group: str, delta: str) -> DataFrame:
    """(``by``, worst_group, worst_group_delta, group_count): the group of the least mean, the first by name on ties."""
    means = df.groupBy(*by, F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("all")).alias("g")).agg(F.round(F.avg(delta), 6).alias("d"))
    out = means.groupBy(*by).agg(F.min(F.struct("d", "g")).alias("w"), F.count(F.lit(1)).alias("group_count"))
    return out.select(*by, F.col("w.g").alias("worst_group"), F.col("w.d").alias("worst_group_delta"), "group_count")


def value_counts(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(field, value, n): the k most frequent values of each column, ties by value; blanks count as ``unknown``."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias("value")) for c in columns])))
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("field").orderBy(F.desc("n"), "value")  # stops at k rows of a field in each task before it shuffles
    return counts.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def order_quantiles(df: DataFrame, value: str) -> DataFrame:
    """n, mean, max, p50 = sorted[n // 2], p95 = sorted[int(0.95 n)]: order statistics, found from value counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    whole = counts.agg(F.sum("c").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"), F.max("v").alias("max"))
    total = F.col("total")
    return whole.join(order.at_weights(counts, "v", "c", {"p50": F.floor(total / 2), "p95": F.floor(total * 0.95)}))  # one row each
