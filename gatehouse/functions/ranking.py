"""Margins, rank and hit fallbacks.  Where conventions differ they are parameters without defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A miss that has no rank.
NO_RANK = 1_000_000_000


def margin(scores: Column, missing: str) -> Column:
    """First minus second of an array of structs with ``score``.  Missing: ``null``, ``zero`` or ``inf``."""
    value = F.get(scores, F.lit(0))["score"] - F.get(scores, F.lit(1))["score"]
    return {"null": value, "zero": F.coalesce(value, F.lit(0.0)), "inf": F.coalesce(value, F.lit(float("inf")))}[missing]


def rounded(c: Column, digits: int) -> Column:
    """The double times 10 ** digits to the nearest whole, halves away from zero, as the SQL of the queries has it.  ``F.round``
    goes by a double's shortest decimal: it takes 0.145, which lies below its name, up to 0.15."""
    return F.round(c * 10.0**digits) / 10.0**digits


def gate(value: Column, threshold: Column | float, inclusive: bool) -> Column:
    """A low margin triggers; null never does."""
    return F.coalesce(value <= threshold if inclusive else value < threshold, F.lit(False))


def rank_value(order: tuple[str, ...], columns: list[str], prediction: str = "prediction", target: str = "target") -> Column:
    """The first rank present in ``order``; else 1 or NO_RANK by prediction against target."""
    have = [F.col(c) for c in order if c in columns]
    if prediction in columns and target in columns:
        have.append(F.when(F.col(prediction) == F.col(target), 1).otherwise(NO_RANK))
    if not have:
        raise ValueError(f"no rank among {columns}")
    return F.coalesce(*have).cast("long")


def reciprocal(rank: Column) -> Column:
    return F.when(rank > 0, 1.0 / rank).otherwise(0.0)


def bucket(nth: Column, n: Column, buckets: int) -> Column:
    """Equal-frequency bucket of the nth (from 0) of n rows: floor(nth * buckets / n), which is not ntile."""
    return F.floor(nth * buckets / n).cast("int")


def order_statistic(values: Column, index: Column) -> Column:
    """The index-th (from 0) of the sorted values."""
    return F.get(F.sort_array(values), index.cast("int"))


def portable_hash(seed: int | str | Column, key: Column) -> Column:
    """32 bits of MD5, the same in any engine: seeds splits, shuffles and draws."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
