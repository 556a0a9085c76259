"""Probing representations: inner splits, layer choice, grouped folds, factorial contrasts and moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import portable_hash, rounded
from . import metrics, sampling, similarity

#: Pooling methods, and the conditionings of a probe.
POOL_METHODS = ("mean", "std", "stats", "attn")
SUBSETS = ("all", "audio")


def pool_spec(spec: str, methods: tuple[str, ...] = POOL_METHODS) -> tuple[str, str]:
    """(subset, method) of ``subset[_method]``: all tokens unless the spec begins with ``audio``, and the mean unless it names
    a method."""
    first, found, rest = spec.partition("_")
    method = rest if found else "mean"
    if method not in methods:
        raise ValueError(f"unknown pool method {method!r} in {spec!r}")
    return SUBSETS[first.startswith("audio")], method


def conditionings(names: list[str], built_in: dict[str, str], arms: dict[str, str]) -> dict[str, str | None]:
    """What each conditioning tells the encoder: nothing for the baseline, else its own text or the arm's."""
    out: dict[str, str | None] = {}
    for name in names:
        if name == "baseline":
            out[name] = None
        elif name in built_in or name in arms:
            out[name] = built_in.get(name, arms.get(name))
        else:
            raise ValueError(f"unknown conditioning: {name}")
    return out


def inner_split(df: DataFrame, key: str, fit: float, seed: int | str) -> DataFrame:
    """Adds part: ``fit`` for int(n * fit) rows, one at least, in shuffled order, else ``val``."""
    rows = sampling.placed(df, key, seed)
    return rows.withColumn("part", F.when(F.col("nth") < F.greatest(F.lit(1), F.floor(F.col("n") * fit)), "fit").otherwise("val")).drop("nth", "n")


def group_split(group: Column, val: float, seed: int | str) -> Column:
    """``val`` for about that share of the groups, else ``fit``: no group is in both."""
    return F.when(portable_hash(seed, group) / float(1 << 32) < val, "val").otherwise("fit")


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, accuracy) of rows (by, correct)."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), metrics.rate(F.col("correct")).alias("accuracy"))


def choose(table: DataFrame, by: list[str], option: str, value: str, place: str) -> DataFrame:
    """(by, ``option``, ``value``): the option with the largest value, the first by ``place`` on ties."""
    best = table.groupBy(*by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(place)).alias("p"), F.col(option).alias("o"))).alias("b"))
    return best.select(*by, F.col("b.o").alias(option), F.col("b.v").alias(value))


def layer_table(table: DataFrame, rows: str, columns: str, names: list[str], value: str = "accuracy") -> DataFrame:
    """A long table as one row for each of ``rows`` and one column for each of ``names``."""
    return table.groupBy(rows).pivot(columns, names).agg(F.max(value))


def conditioning_report(matrix: DataFrame, rewards: DataFrame, baseline: str) -> DataFrame:
    """For each factor the conditioning with the best reward (the first by place), its test accuracy, the baseline's and the
    difference, and whether the factor's own conditioning is the best on the test.  ``matrix`` has (cond, place, factor,
    accuracy), ``rewards`` (cond, place, factor, reward)."""
    picked = choose(rewards, ["factor"], "cond", "reward", "place").select("factor", F.col("cond").alias("selected"), "reward")
    own = matrix.select("factor", F.col("cond").alias("selected"), F.col("accuracy").alias("test_selected"))
    base = matrix.where(F.col("cond") == baseline).select("factor", F.col("accuracy").alias("test_baseline"))
    top = choose(matrix, ["factor"], "cond", "accuracy", "place").select("factor", (F.col("cond") == F.col("factor")).alias("diagonal"))
    out = picked.join(own, ["factor", "selected"]).join(base, "factor").join(top, "factor")
    return out.withColumn("delta", F.round(F.col("test_selected") - F.col("test_baseline"), 6))


def above_chance(rows: DataFrame) -> DataFrame:
    """Rows (ci_low, ci_high, accuracy, chance) with their ratio to chance, whether the interval lies above it, and a sentence."""
    above = F.col("ci_low") > F.col("chance")
    span = F.concat(F.lit("CI ["), F.col("ci_low").cast("string"), F.lit(", "), F.col("ci_high").cast("string"), F.lit("]"))
    said = F.when(above, F.concat(span, F.lit(" lies above chance "), F.col("chance").cast("string"))).otherwise(F.concat(span, F.lit(" includes chance "), F.col("chance").cast("string")))
    return rows.withColumns({"ratio_over_chance": rounded(F.col("accuracy") / F.col("chance"), 2), "ci_excludes_chance": above, "interpretation": said})


def rank_order(scores: Column) -> Column:
    """The places of an array's entries from the largest to the smallest, ties by place."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def affine_rank_order(scores: Column, alpha: float, beta: float) -> Column:
    """The same under alpha * score + beta: it does not change while alpha is positive, and anything else is an error."""
    if alpha <= 0:
        raise ValueError("alpha must be positive to keep the order")
    return rank_order(F.transform(scores, lambda x: x * alpha + beta))


def per_group(df: DataFrame, key: str, group: str, target: int, seed: int | str) -> DataFrame:
    """About ``target`` rows that cover every group: ceil(target / groups) of each, one at least."""
    groups = df.select(group).distinct().count()
    return sampling.balanced(df, key, group, max(1, -(-target // max(groups, 1))), seed)


def card_draws(df: DataFrame, key: str, label: str, pool: int, draws: int, size: int, seed: int | str) -> DataFrame:
    """Adds part and draw: of each label ``pool`` rows are cards, cut into ``draws`` disjoint draws of ``size`` (null for those
    left over), all others are evaluated.  A label without a row to evaluate fails the job."""
    if pool < draws * size:
        raise ValueError(f"a pool of {pool} has no {draws} draws of {size}")
    rows = sampling.placed(df, key, seed, [label])
    checked = F.when(F.col("n") > pool, F.col("nth")).otherwise(F.raise_error(F.concat(F.lit("too few rows of label "), F.col(label).cast("string"))).cast("long"))
    rows = rows.withColumn("nth", checked)
    card = F.col("nth") < pool
    draw = F.floor(F.col("nth") / size)
    return rows.select(*df.columns, F.when(card, "card").otherwise("eval").alias("part"), F.when(card & (draw < draws), draw).cast("int").alias("draw"))


def factor_contrasts(hits: DataFrame, key: str, arms: list[str], contrasts: dict[str, tuple[str, str]]) -> DataFrame:
    """(contrast, n, delta, fixes, regressions): each sample's hits in an arm are averaged over its draws, and arms compared
    sample by sample.  ``hits`` has (key, arm, draw, hit)."""
    mean = hits.groupBy(key).pivot("arm", arms).agg(F.avg(F.col("hit").cast("double")))
    pairs = F.array(*[F.struct(F.lit(name).alias("contrast"), (F.col(a) - F.col(b)).alias("d")) for name, (a, b) in contrasts.items()])
    long = mean.select(F.inline(pairs)).where("d IS NOT NULL")
    return long.groupBy("contrast").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("delta"), F.count_if(F.col("d") > 0).alias("fixes"), F.count_if(F.col("d") < 0).alias("regressions"))


def moves(rows: DataFrame) -> DataFrame:
    """Mean, median and maximum of how far a context moves a query (move) and of how far its labels do (sens), and a verdict."""
    out = rows.agg(*[F.round(f(c), 6).alias(f"{c}_{n}") for c in ("move", "sens") for n, f in (("mean", F.avg), ("p50", F.median), ("max", F.max))])
    verdict = F.when(F.col("move_mean") < 0.01, "query ignores its context").when(F.col("sens_mean") < 0.01, "context shifts, labels do not matter").otherwise("label sensitive")
    return out.withColumn("verdict", verdict)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; zero where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def demo_document(demos: Column, query: Column, header: str = "") -> Column:
    """A few-shot document: a text, then for each demo (clip, label) its clip and label, then the query's clip, as structs
    (type, value)."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    shown = F.flatten(F.transform(demos, lambda d: F.array(part("audio", d["clip"]), part("text", F.concat(F.lit(" "), d["label"], F.lit(". "))))))
    return F.concat(F.array(part("text", F.lit(f"passage: {header}"))), shown, F.array(part("audio", query)))


def nested_choice(rows: DataFrame, option: str, place: str, baseline: object, by: str = "fold") -> DataFrame:
    """(``by``, ``option``, dev_accuracy, n, accuracy, baseline_accuracy, delta): for each fold the option that is best on all
    other folds (the first by ``place``), and what it does on the fold itself.  ``rows`` has (by, option, place, correct)."""
    table = rows.groupBy(by, option, place).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("hits"))
    whole = table.groupBy(option, place).agg(F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    table = table.join(whole, [option, place]).withColumns({"dev_accuracy": share(F.col("all_hits") - F.col("hits"), F.col("all_n") - F.col("n")), "accuracy": share(F.col("hits"), F.col("n"))})
    picked = choose(table, [by], option, "dev_accuracy", place)
    base = table.where(F.col(option) == baseline).select(by, F.col("accuracy").alias("baseline_accuracy"))
    out = picked.join(table.select(by, option, "n", "accuracy"), [by, option]).join(base, by)
    return out.withColumn("delta", F.round(F.col("accuracy") - F.col("baseline_accuracy"), 6))


def linear_probe(df: DataFrame, key: str, vector: str, label: str, fold: str, ridge: float = 1.0) -> DataFrame:
    """(``key``, ``label``, ``fold``, prediction): each fold predicted by a ridge classifier fitted on all others.

    Tasks sum up the Gram matrix of the vectors (with a constant) and their sums by label, one row a fold; an aggregate adds
    these, number by number, so the driver gets d x (d + labels) numbers a fold, whatever the rows.  A fold's own sums are
    taken from the whole, and the weights follow in closed form.  The constant is not shrunk; ties go to the first label.
    Rows without a vector or label take no part."""
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("__v"), F.col(label).alias("__y"), F.col(fold).alias("__f"))
    names = [r[0] for r in rows.select("__y").distinct().orderBy("__y").limit(4097).collect()]
    if len(names) > 4096:
        raise ValueError("a probe has up to 4,096 labels")
    place = {y: k for k, y in enumerate(names)}

    def widened(batch: pa.RecordBatch) -> np.ndarray:
        x = similarity.matrix(batch.column("__v"))
        return np.hstack([x, np.ones((len(x), 1))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            if batch.num_rows:
                x, folds = widened(batch), np.array(batch.column("__f").to_pylist())
                y = np.zeros((len(x), len(names)))
                y[np.arange(len(x)), [place[v] for v in batch.column("__y").to_pylist()]] = 1
                for f in np.unique(folds):
                    own = folds == f
                    found[int(f)] = found.get(int(f), 0) + np.hstack([x[own].T @ x[own], x[own].T @ y[own]])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([m.ravel() for m in found.values()], pa.list_(pa.float64()))], ["f", "m"])

    added = rows.mapInArrow(sums, "f int, m array<double>").select("f", F.posexplode("m").alias("at", "x")).groupBy("f", "at").agg(F.sum("x").alias("x"))
    folds: dict[int, np.ndarray] = {}
    for r in added.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("m")).select("f", F.transform("m", lambda e: e["x"]).alias("m")).collect():
        flat = np.array(r["m"])
        d = int((-len(names) + np.sqrt(len(names) ** 2 + 4 * len(flat))) / 2 + 0.5)
        folds[r["f"]] = flat.reshape(d, d + len(names))
    whole, weights = sum(folds.values()), {}
    for f, own in folds.items():
        rest = whole - own
        d = len(rest)
        shrink = ridge * np.eye(d)
        shrink[-1, -1] = 1e-9
        weights[f] = np.linalg.solve(rest[:, :d] + shrink, rest[:, d:])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, f = widened(batch), np.array(batch.column("__f").to_pylist())
                said = np.zeros(len(x), np.int64)
                for k in np.unique(f):
                    said[f == k] = np.round(x[f == k] @ weights[int(k)], 9).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("__y"), batch.column("__f"), pa.array([names[k] for k in said], batch.schema.field("__y").type)], [key, label, fold, "prediction"])

    kind = lambda c: df.schema[c].dataType.simpleString()
    return rows.mapInArrow(predict, f"`{key}` {kind(key)}, `{label}` {kind(label)}, `{fold}` int, prediction {kind(label)}")
