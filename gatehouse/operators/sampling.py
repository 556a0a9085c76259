"""Splits, subsamples and negatives by a portable hash (seed, key): the same in any engine and at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import portable_hash
from . import order


def placed(df: DataFrame, key: str, seed: int | str, by: list[str] | None = None) -> DataFrame:
    """Adds nth (from 0) in the shuffled order and n, over all rows or each group of ``by``.

    Groups are numbered in one order over all of them, from which each group's first number is taken, so a group with
    a third of all rows is in no one task.  Over all rows, these are counted by the hash's upper bits, and numbered within
    each of these buckets.
    """
    h = portable_hash(seed, F.col(key))
    if by:
        rows = order.ordered(df.withColumn("_h", h), [*by, "_h", key], "_g")
        groups = rows.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("n"))
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
        return rows.join(groups, same).select(*df.columns, (F.col("_g") - F.col("_first")).alias("nth"), "n")
    rows = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 22).cast("int"))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("c"))  # 1,024 buckets at most
    total = counts.agg(F.array_sort(F.collect_list(F.struct("_b", "c"))).alias("a"))
    before = total.select(F.explode(F.transform("a", lambda x: F.struct(x["_b"].alias("_b"), F.aggregate(F.filter("a", lambda y: y["_b"] < x["_b"]), F.lit(0).cast("long"), lambda s, y: s + y["c"]).alias("before"), F.aggregate("a", F.lit(0).cast("long"), lambda s, y: s + y["c"]).alias("n")))).alias("p")).select("p.*")
    nth = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return rows.withColumn("_r", nth).join(F.broadcast(before), "_b").withColumn("nth", F.col("before") + F.col("_r") - 1).drop("_h", "_b", "_r", "before")


def three_way(nth: Column, n: Column, proposal: float, selection: float, least: int = 0) -> Column:
    """Split by place: int(n * ratio) rows each, ``least`` at least for the first two, the rest locked."""
    cut = lambda r: F.greatest(F.lit(least), F.floor(n * r))
    return F.when(nth < cut(proposal), "proposal").when(nth < cut(proposal) + cut(selection), "selection").otherwise("locked_test")


def balanced(df: DataFrame, key: str, label: str, per_label: int, seed: int | str) -> DataFrame:
    """The first ``per_label`` rows of each label in shuffled order."""
    return placed(df, key, seed, [label]).where(F.col("nth") < per_label).drop("nth", "n")


def group_fold(group: Column, folds: int, seed: int | str) -> Column:
    """A fold for each group, so that no group is in two."""
    return F.pmod(portable_hash(seed, group), F.lit(folds)).cast("int")


def negatives(df: DataFrame, pool: DataFrame, key: str, label: str, count: int, seed: int | str) -> DataFrame:
    """(key, cand, place): ``count`` rows of a ``pool`` of another label for each row, seeded.

    Each label has its ring of pool rows in shuffled order; a row starts at a hashed place and walks on, so the work is
    rows x count, not rows x pool.
    """
    ring = placed(pool, key, f"{seed}:ring", [label]).select(F.col(label).alias("other"), F.col(key).alias("cand"), F.col("nth").alias("at"), F.col("n").alias("size"))
    sizes = pool.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    table = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "size"))).alias("labels"))  # labels: few
    rows = df.join(F.broadcast(table))
    others = F.filter("labels", lambda x: x["l"] != F.col(label))
    pick = lambda i: F.get(others, F.pmod(portable_hash(seed, F.col(key)) + i, F.size(others)).cast("int"))
    asked = rows.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(i.alias("place"), pick(i)["l"].alias("other"), F.pmod(portable_hash(f"{seed}:at", F.concat(F.col(key).cast("string"), F.lit(":"), i.cast("string"))), pick(i)["size"]).alias("at")))).alias("a")).select(key, "a.*")
    return asked.join(ring, ["other", "at"]).select(key, "cand", "place")


def balanced_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """Adds fold: whole groups, dealt out from the largest on, back and forth.  Two folds differ by the largest group at
    most: they gain on each other by no more than a round's range, and the rounds' ranges add up to no more than that."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = order.ordered(sizes, [F.desc("_n"), "_g"], "_place")
    there = F.col("_place") % folds
    fold = F.when(F.floor(F.col("_place") / folds) % 2 == 0, there).otherwise(folds - 1 - there).cast("int")
    return df.join(dealt.select("_g", fold.alias("fold")), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
