"""Numbering rows in a total order without one task that has them all.

Rows are exchanged by ranges of the order, sorted in their task and written with their place in it; the ranges' sizes,
one row a task, give what stands before each range and return by broadcast.  Ranges are cut by all columns of the order,
so rows that share its first (a frequent value, or null) are cut by the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

#: Bits of a row's place within its task.
WITHIN = 33


def _sorted(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` written in order, with _part (which range) and _at (the place in it)."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialize(rows, "ordered").withColumns({"_part": F.shiftright("_id", WITHIN), "_at": F.col("_id").bitwiseAND((1 << WITHIN) - 1)}).drop("_id")


def _ranges(rows: DataFrame, weight: Column) -> DataFrame:
    """(_part, _weight, _before, _total), a row a task."""
    sums = rows.groupBy("_part").agg(F.sum(weight).alias("_weight"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", "_weight", F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_before"), F.sum("_weight").over(Window.partitionBy()).alias("_total"))


def ordered(df: DataFrame, order: list[Column | str], name: str = "nth", total: str | None = None) -> DataFrame:
    """Adds ``name``, the row's number from 0 in a total order, and ``total``, the number of rows."""
    rows = _sorted(df, order)
    out = rows.join(F.broadcast(_ranges(rows, F.lit(1)).drop("_weight")), "_part").withColumn(name, F.col("_before") + F.col("_at"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_at", "_before", "_total")


def dense(df: DataFrame, index: str, name: str = "nth", total: str | None = None) -> DataFrame:
    """``ordered`` by one column whose values are distinct, however far apart."""
    return ordered(df, [index], name, total)


def ranked(df: DataFrame, column: str, tie: str, name: str = "nth", total: str | None = None) -> DataFrame:
    """``ordered`` by a column (nulls first), ties by another."""
    return ordered(df, [F.col(column).asc_nulls_first(), tie], name, total)


def at_place(df: DataFrame, column: str, tie: str, place: Column) -> DataFrame:
    """One row (``column``): the value at a place of the order, from 0; ``place`` may use ``total``, the number of rows."""
    return ranked(df.select(column, tie), column, tie, "nth", "total").where(F.col("nth") == place).select(column)


def at_weights(df: DataFrame, value: str, weight: str, places: dict[str, Column]) -> DataFrame:
    """One row with a column for each of ``places``: the value that stands at this place from 0, if each distinct ``value``
    were repeated ``weight`` times.  A place may use ``total``, the sum of weights; without rows there is null.

    Only the ranges that hold a place are summed up row by row."""
    rows = _sorted(df.select(F.col(value).alias("v"), F.col(weight).alias("w")), ["v"])
    wanted = F.inline(F.array(*[F.struct(F.lit(k).alias("name"), p.alias("place")) for k, p in places.items()]))
    ranges = _ranges(rows, F.col("w")).withColumnRenamed("_total", "total").select("*", wanted)
    ranges = ranges.where((F.col("_before") <= F.col("place")) & (F.col("place") < F.col("_before") + F.col("_weight")))
    upto = F.sum("w").over(Window.partitionBy("name", "_part").orderBy("_at"))
    inside = rows.join(F.broadcast(ranges), "_part").withColumn("upto", F.col("_before") + upto)
    found = inside.where((F.col("upto") - F.col("w") <= F.col("place")) & (F.col("place") < F.col("upto")))
    return found.agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in places])
