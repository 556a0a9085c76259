"""Paired bootstrap and multiplicity.

Rows that count alike are interchangeable, so a draw of n rows with replacement is a draw of counts: a multinomial one over
the kinds of rows.  At any size it is made by a binary tree over the kinds, in their order: a node's count goes to its
left half by a binomial draw, which inverts one uniform number, a 32-bit word of the MD5 of ``seed:round:node / 4``.  So
rounds are the same in any engine and at any partitioning, and a round costs as many draws as there are kinds, whatever
n is.  Many kinds (the groups of a cluster bootstrap) are cut into blocks, subtrees that find their own counts on the way
down from the root, so no task has them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import order_statistic
from . import order

#: Rounds drawn by a task at once, and groups in a block (a power of two).
BLOCK, GROUPS = 500, 256
#: The places of the 2.5 % and 97.5 % bounds among R sorted rounds; E interpolates.
CONVENTIONS = {
    "A": (lambda r: max(0, int(0.025 * r) - 1), lambda r: min(r - 1, int(0.975 * r))),
    "B": (lambda r: int(0.025 * r), lambda r: min(r - 1, int(0.975 * r))),
    "C": (lambda r: int(0.025 * (r - 1)), lambda r: int(0.975 * (r - 1))),
    "D": (lambda r: int(0.025 * r), lambda r: max(0, int(0.975 * r) - 1)),
}


def bounds(values: Column, rounds: int, convention: str) -> tuple[Column, Column]:
    """(lower, upper) of an array of the rounds' statistics."""
    low, high = CONVENTIONS[convention]
    return order_statistic(values, F.lit(low(rounds))), order_statistic(values, F.lit(high(rounds)))


def paired_counts(df: DataFrame, by: list[str], base: Column, new: Column) -> DataFrame:
    """(by, n, fixes, regressions, delta, regression_rate) of paired hits."""
    d = new.cast("int") - base.cast("int")
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(d > 0).alias("fixes"), F.count_if(d < 0).alias("regressions"))
    return out.withColumns({"delta": F.round((F.col("fixes") - F.col("regressions")) / F.col("n"), 6), "regression_rate": F.round(F.col("regressions") / F.col("n"), 6)})


@lru_cache(maxsize=1 << 14)
def _cumulative(n: int, p: float) -> tuple[int, np.ndarray]:
    """(first, distribution function from there on) of a binomial, as far as a 32-bit number can tell it from 0 and 1."""
    mode, reach = int((n + 1) * p), int(8 * np.sqrt(n * p * (1 - p))) + 40
    first, last = max(0, mode - reach), min(n, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1) * (p / (1 - p))))])
    mass = np.exp(log - log.max())
    return first, np.cumsum(mass) / mass.sum()


def binomial(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """For each n and uniform u the least count whose distribution function exceeds u."""
    if p <= 0 or p >= 1:
        return n * int(p >= 1)
    flat, u, out = n.ravel(), u.ravel(), np.zeros(n.size, np.int64)
    by = np.argsort(flat, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(flat[by])) + 1) if len(by) else []:
        first, table = _cumulative(int(flat[part[0]]), p)
        out[part] = first + np.searchsorted(table, u[part], side="right")
    return np.minimum(out, flat).reshape(n.shape)


def uniforms(seed: int | str, rounds: range, nodes: np.ndarray) -> np.ndarray:
    """[round, node]: numbers between 0 and 1; one MD5 has four."""
    groups, at = np.unique(nodes // 4, return_inverse=True)
    raw = b"".join(hashlib.md5(f"{seed}:{r}:{g}".encode()).digest() for r in rounds for g in groups.tolist())
    drawn = np.frombuffer(raw, ">u4").reshape(len(rounds), 4 * len(groups))
    return (drawn[:, 4 * at + nodes % 4] + 0.5) / (1 << 32)


def expand(many: np.ndarray, node: int, first: int, height: int, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], rounds: range, seed: int | str) -> np.ndarray:
    """[round, leaf]: the counts of the 2 ** height leaves from ``first`` on, below a node that has ``many`` each round.
    ``weight`` gives the weight of the leaves from one number to another."""
    counts, nodes = many[:, None], np.array([node])
    for h in range(height, 0, -1):
        start = first + (np.arange(len(nodes)) << h)
        whole, left = weight(start, start + (1 << h)), weight(start, start + (1 << h - 1))
        share = np.where(whole > 0, left / np.maximum(whole, 1), 0.0)
        u, taken = uniforms(seed, rounds, nodes), np.zeros_like(counts)
        for p in np.unique(share):
            same = share == p
            taken[:, same] = binomial(counts[:, same], float(p), u[:, same])
        counts = np.stack([taken, counts - taken], 2).reshape(len(counts), -1)
        nodes = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel()
    return counts


def drawn_counts(weights: np.ndarray, rounds: range, seed: int | str) -> np.ndarray:
    """[round, kind]: how often each kind is drawn, where there are as many draws as rows."""
    before = np.concatenate([[0], np.cumsum(weights)])
    upto = lambda k: before[np.minimum(k, len(weights))]
    height = (len(weights) - 1).bit_length()
    return expand(np.full(len(rounds), before[-1]), 1, 0, height, lambda a, b: upto(b) - upto(a), rounds, seed)[:, : len(weights)]


def blocks_of(rounds: int) -> Column:
    """The numbers of the blocks of rounds, a row each."""
    return F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // BLOCK) - 1))).alias("block")


def resampled(kinds: DataFrame, by: list[str], rounds: int, seed: int | str) -> DataFrame:
    """(by, n, round, sums): the sums of a round's values.  ``kinds`` has (by, k: how many rows are of each kind, v: each
    kind's values), a row a comparison."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                span = range(BLOCK * row["block"], min(rounds, BLOCK * (row["block"] + 1)))
                weights = np.asarray(row["k"], np.int64)
                sums = drawn_counts(weights, span, seed) @ np.stack([np.asarray(x, float) for x in row["v"]])
                out = pd.DataFrame({c: [row[c]] * len(span) for c in by})
                out["n"], out["round"], out["sums"] = int(weights.sum()), np.array(span, np.int32), list(sums)
                yield out

    rows = kinds.select(*by, F.col("k").cast("array<long>").alias("k"), F.col("v").cast("array<array<double>>").alias("v"), blocks_of(rounds))
    dealt = rows.repartition(int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "block")
    schema = "".join(f"`{c}` {kinds.schema[c].dataType.simpleString()}, " for c in by) + "n long, round int, sums array<double>"
    return dealt.mapInPandas(run, schema)


def drawn(counts: DataFrame, by: list[str], rounds: int, seed: int | str) -> DataFrame:
    """(by, round, value): the mean difference of each round, from ``counts`` (by, n, fixes, regressions)."""
    kinds = counts.where("n > 0").select(*by, F.array("fixes", "regressions", F.col("n") - F.col("fixes") - F.col("regressions")).alias("k"), F.expr("array(array(1.0), array(-1.0), array(0.0))").alias("v"))
    return resampled(kinds, by, rounds, seed).select(*by, "round", (F.get("sums", F.lit(0)) / F.col("n")).alias("value"))


def paired_bootstrap(counts: DataFrame, by: list[str], rounds: int, seed: int | str, convention: str) -> DataFrame:
    """``counts`` with ci_low and ci_high; without rows both are 0."""
    boots = drawn(counts, by, rounds, seed).groupBy(*by)
    if convention == "E":
        quantile = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
        ci = boots.agg(quantile(0.025).alias("ci_low"), quantile(0.975).alias("ci_high"))
    else:
        low, high = bounds(F.col("v"), rounds, convention)
        ci = boots.agg(F.collect_list("value").alias("v")).select(*by, F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))
    out = counts.join(ci, by, "left") if by else counts.join(F.broadcast(ci))
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ci_low", "ci_high")})


def paired_ranks(df: DataFrame, by: list[str], base: str, new: str, rounds: int, seed: int | str) -> DataFrame:
    """(by, n, hit_delta, hit_low, hit_high, mrr_delta, mrr_low, mrr_high): hits and reciprocal ranks by the same draws,
    with the bounds of C.  Rows with the same two ranks are of one kind."""
    pairs = df.groupBy(*by, F.col(base).alias("a"), F.col(new).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    hit = ((F.col("b") == 1).cast("int") - (F.col("a") == 1).cast("int")).alias("hit")
    mrr = (1.0 / F.col("b") - 1.0 / F.col("a")).alias("mrr")
    kinds = pairs.select(*by, "a", "b", "k", hit, mrr)
    mean = lambda c, name: F.round(F.sum(F.col("k") * F.col(c)) / F.sum("k"), 6).alias(name)
    listed = F.array_sort(F.collect_list(F.struct("a", "b", "k", "hit", "mrr"))).alias("s")
    whole = kinds.groupBy(*by).agg(F.sum("k").alias("n"), mean("hit", "hit_delta"), mean("mrr", "mrr_delta"), listed)
    many = resampled(whole.select(*by, F.transform("s", lambda x: x["k"]).alias("k"), F.transform("s", lambda x: F.array(x["hit"].cast("double"), x["mrr"])).alias("v")), by, rounds, seed)
    boots = many.select(*by, (F.get("sums", F.lit(0)) / F.col("n")).alias("h"), F.round(F.get("sums", F.lit(1)) / F.col("n"), 9).alias("m"))
    ends = boots.groupBy(*by).agg(F.collect_list("h").alias("h"), F.collect_list("m").alias("m"))
    limits = [F.round(v, 6).alias(f"{name}_{side}") for name, c in (("hit", "h"), ("mrr", "m")) for side, v in zip(("low", "high"), bounds(F.col(c), rounds, "C"), strict=True)]
    return whole.drop("s").join(ends.select(*by, *limits), by)


def cluster_bootstrap(df: DataFrame, group: str, delta: str, rounds: int, seed: int | str) -> DataFrame:
    """(n, groups, delta, ci_low, ci_high): whole groups are drawn, with all their members, and pooled; E bounds.

    Groups are summed and numbered in their order, and dealt out by blocks of ``GROUPS``; a block and ``BLOCK`` rounds
    give a row of sums a round, which an aggregate merges."""
    sums = df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(delta).cast("double").alias("s"))
    numbered = order.ordered(sums, ["g"], "nth", "total")
    total = numbered.agg(F.max("total").alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    shift = (GROUPS - 1).bit_length()
    listed = numbered.groupBy(F.shiftright("nth", shift).alias("part")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("nth", "n", "s"))).alias("x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                span = range(BLOCK * row["block"], min(rounds, BLOCK * (row["block"] + 1)))
                counts = block_counts(row["total"], row["part"], span, seed, GROUPS)
                n, s = (np.array([x[c] for x in row["x"]], float) for c in ("n", "s"))
                yield pd.DataFrame({"round": np.array(span, np.int32), "n": counts[:, : len(n)] @ n, "s": counts[:, : len(n)] @ s})

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn_ = listed.select("*", blocks_of(rounds)).repartition(tasks, "part", "block").mapInPandas(run, "round int, n double, s double")
    boots = drawn_.groupBy("round").agg((F.sum("s") / F.sum("n")).alias("value"))
    q = boots.agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = total.join(q)  # one row each
    return out.select("n", F.col("groups").cast("long").alias("groups"), F.round(F.col("s") / F.col("n"), 6).alias("delta"), F.round(F.col("q")[0], 6).alias("ci_low"), F.round(F.col("q")[1], 6).alias("ci_high"))


def block_counts(groups: int, part: int, rounds: range, seed: int | str, size: int) -> np.ndarray:
    """[round, group of the block]: of ``groups`` draws, how many fall to each group of a block of ``size``; the way down from
    the root gives the block's own count."""
    depth, height = (groups - 1).bit_length(), (size - 1).bit_length()
    weight = lambda a, b: np.minimum(b, groups) - np.minimum(a, groups)
    many, below = np.full(len(rounds), groups), max(0, depth - height)
    for level in range(below):
        place = part >> below - level
        start, end = place << depth - level, place + 1 << depth - level
        u = uniforms(seed, rounds, np.array([(1 << level) + place]))[:, 0]
        left = binomial(many, float(weight(start, (start + end) // 2) / weight(start, end)), u)
        many = many - left if part >> below - level - 1 & 1 else left
    return expand(many, (1 << below) + part, part << height, min(depth, height), weight, rounds, seed)


def holm(df: DataFrame, name: str, p: str) -> DataFrame:
    """Adds p_holm: the running maximum of min(1, (m - i + 1) p) in the order of p.  One family of tests."""
    w = Window.orderBy(p, name)
    stepped = df.withColumn("_s", F.least(F.lit(1.0), (F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(w) + 1) * F.col(p)))
    return stepped.withColumn("p_holm", F.round(F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6)).drop("_s")


def max_t(boots: DataFrame, observed: DataFrame, name: str) -> DataFrame:
    """(name, p_maxt): how often the round's largest |z| over all contrasts reaches the contrast's own.
    ``boots`` has (name, round, value), ``observed`` (name, delta)."""
    spread = boots.groupBy(name).agg(F.stddev_samp("value").alias("sd"), F.avg("value").alias("mid"))
    z = boots.join(F.broadcast(spread), name).groupBy("round").agg(F.max(F.abs(F.try_divide(F.col("value") - F.col("mid"), F.col("sd")))).alias("top"))
    own = observed.join(F.broadcast(spread), name).select(name, F.round(F.abs(F.try_divide("delta", "sd")), 9).alias("z"))
    tops = z.agg(F.collect_list(F.round("top", 9)).alias("tops"))
    return own.join(F.broadcast(tops)).select(name, F.round((F.size(F.filter("tops", lambda t: t >= F.col("z"))) + 1) / (F.size("tops") + 1), 6).alias("p_maxt"))


def verdict(low: Column, high: Column, sesoi: float) -> Column:
    """What an interval says of zero, and of a smallest effect of interest."""
    return F.when(low > 0, "positive").when(high < 0, "negative").when((low > -sesoi) & (high < sesoi), "equivalent").otherwise("inconclusive")


def t_below(t: Column, df: Column) -> Column:
    """The probability that |T| stays below ``t`` >= 0 for whole degrees of freedom: the finite series in the angle whose
    tangent is t / sqrt(df)."""
    sine, cosine2 = t / F.sqrt(df + t * t), df / (df + t * t)
    odd = df % 2
    # terms of 1 + 1/2 c^2 + 1/2 3/4 c^4 ... (even) or c (1 + 2/3 c^2 + 2/3 4/5 c^4 ...) (odd)
    steps = F.greatest(F.floor((df - 2 - odd) / 2), F.lit(0)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * cosine2 * (2 * k - 1 + odd) / (2 * k + odd)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start, add, lambda acc: acc["sum"])
    angle = F.atan2(sine, F.sqrt(cosine2))
    of_odd = (angle + F.when(df > 1, sine * F.sqrt(cosine2) * series).otherwise(0.0)) * (2 / np.pi)
    return F.when(odd == 1, of_odd).otherwise(sine * series)


def t_quantile(p: float, df: Column) -> Column:
    """The t below which |T| stays with probability ``p``, for any whole degrees of freedom from 1 on, by halving."""
    start = F.struct(F.lit(0.0).alias("low"), F.lit(64.0).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        short = t_below(middle, df) < p
        return F.struct(F.when(short, middle).otherwise(acc["low"]).alias("low"), F.when(short, acc["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(52)), start, halve, lambda acc: (acc["low"] + acc["high"]) / 2)


def t_interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, ci_low, ci_high) across any number of seeds by Student's t at 95 %; null bounds for one seed.

    The quantile is found once for each number of seeds."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    sizes = out.where("n > 1").select(F.col("n").alias("_n")).distinct().withColumn("_t", t_quantile(0.95, F.col("_n") - 1))
    half = F.col("_t") * F.col("sd") / F.sqrt("n")
    return out.join(sizes, F.col("n") == F.col("_n"), "left").select(*by, "n", F.round("m", 6).alias("mean"), F.round(F.col("m") - half, 6).alias("ci_low"), F.round(F.col("m") + half, 6).alias("ci_high"))
