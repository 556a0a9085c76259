"""Fitting gates on one part of the rows and applying them to another: thresholds, grids, selection, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records
from ..functions.ranking import NO_RANK, portable_hash, rounded
from ..functions.text import col, label_family
from . import gates, metrics, order, resample

#: The margins that every family gate tries, and how many of the observed ones a pair gate tries.
FAMILY_POINTS = (0.0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.075, 0.1, 0.15, 0.2)
MOST_POINTS, ROUND = 100, 4
MATRIX_MODES = ("global_candidate", "same_family", "changed_same_family", "same_family_low_margin", "margin_low")
FITTED_MODES = ("same_family_low_margin", "margin_low")
#: Pair gates that take the alternate from their threshold on; the others do up to theirs.
FROM_ABOVE = ("alt_high_margin", "alt_margin_advantage", "top_score_advantage")


def spread_points(df: DataFrame, values: dict[str, Column], most: int = MOST_POINTS) -> dict[str, list[float]]:
    """For each name the distinct values, in order, if there are up to ``most``, else as many of them at even places, rounded
    half to even; without values, zero.  All names are ordered in one pass, and ``most`` numbers of each are collected."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in values.items()])))
    rows = order.ordered(long.where("value IS NOT NULL").distinct(), ["name", "value"])
    ends = {r["name"]: (r["first"], r["n"]) for r in rows.groupBy("name").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
    places = {first + (i if n <= most else round(i * (n - 1) / (most - 1))) for first, n in ends.values() for i in range(min(n, most))}
    found: dict[str, list[float]] = {k: [] for k in values}
    for r in rows.where(F.col("nth").isin(sorted(places))).select("name", "value").collect() if places else []:
        found[r["name"]].append(r["value"])
    return {k: sorted(v) or [0.0] for k, v in found.items()}


def spread(df: DataFrame, value: str, most: int = MOST_POINTS) -> DataFrame:
    """(value): ``spread_points`` of one column."""
    points = spread_points(df, {value: F.col(value)}, most)[value]
    return df.sparkSession.createDataFrame([(x,) for x in points], f"`{value}` double")


def place_in(value: str, points: list[float], strict: bool) -> str:
    """SQL for how many of the ordered ``points`` lie below the column ``value`` (or, not ``strict``, at it): a binary search
    in compiled code."""

    def search(a: int, b: int) -> str:
        if a == b:
            return str(a)
        m = (a + b) // 2
        return f"CASE WHEN {points[m]!r}D {'<' if strict else '<='} {value} THEN {search(m + 1, b)} ELSE {search(a, m)} END"

    return f"CASE WHEN {value} IS NOT NULL THEN {search(0, len(points))} END"


def pair_values() -> dict[str, Column]:
    """What each pair gate compares with its threshold, from columns base_margin, alt_margin, base_top, alt_top."""
    base, alt = F.col("base_margin"), F.col("alt_margin")
    gap, top = F.round(alt - base, 6), F.round(F.col("alt_top") - F.col("base_top"), 6)
    return {"raw_low_margin": base, "alt_high_margin": alt, "alt_margin_advantage": gap, "top_score_advantage": top, "disagreement_raw_low_margin": base}


def pair_points(rows: DataFrame) -> dict[str, list[float]]:
    """The thresholds that each gate tries."""
    values = pair_values()
    found = spread_points(rows, {k: v for k, v in values.items() if k != "disagreement_raw_low_margin"})
    return found | {"disagreement_raw_low_margin": found["raw_low_margin"]}


def gated(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows under the one (policy, t) of ``grid``, with use_alt, the chosen rank and base_hit."""
    use = gates.pair_choice(F.col("policy"), F.col("t"), F.col("base_margin"), F.col("alt_margin"), F.col("base_top"), F.col("alt_top"), F.col("agree"))
    return rows.join(F.broadcast(grid.limit(1))).withColumn("use_alt", use).withColumns({"rank": F.when(F.col("use_alt"), F.col("alt_rank")).otherwise(F.col("base_rank")), "base_hit": F.col("base_rank") == 1})


def pair_leaderboard(rows: DataFrame, points: dict[str, list[float]]) -> DataFrame:
    """Metrics of each (policy, t), with place from 1: by accuracy, recall at 3, mrr, then the fewer alternates, policy and t.

    A sweep: a row falls once into a gate's cell between two thresholds, cells are counted, and running sums over the
    cells tell each threshold what changes where its rows take the alternate.  The cost is the rows and the grid."""
    spark, values = rows.sparkSession, pair_values()
    base, alt = F.col("base_rank"), F.col("alt_rank")
    true = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    told = lambda r: {"hits": true(r == 1), "top3": true(r <= 3), "top5": true(r <= 5), "known": true(r.isNotNull()), "mrr": F.coalesce(1.0 / r, F.lit(0.0))}
    counts = {k: a - told(base)[k] for k, a in told(alt).items()}
    counts |= {"used": F.lit(1), "fixes": true(alt == 1) * (1 - true(base == 1)), "regressions": true(base == 1) * (1 - true(alt == 1))}
    cells = ["struct('always_alternate' AS policy, 0 AS cell)"]
    for policy, points_ in points.items():
        if policy in FROM_ABOVE:  # numbered from the highest threshold
            cell = f"{len(points_)} - {place_in(policy, points_, strict=False)}"
        else:
            cell = place_in(policy, points_, strict=True)
        if policy == "disagreement_raw_low_margin":
            cell = f"CASE WHEN agree THEN 0 ELSE {cell} END"
        cells.append(f"struct('{policy}' AS policy, {cell} AS cell)")
    told_of = rows.select("agree", *[v.alias(k) for k, v in counts.items()], *[v.cast("double").alias(k) for k, v in values.items()])
    moved = told_of.select(*counts, F.expr(f"inline(array({', '.join(cells)}))")).where("cell IS NOT NULL")
    moved = moved.groupBy("policy", "cell").agg(*[F.sum(k).alias(k) for k in counts])
    grid = [("always_baseline", 0, 0.0), ("always_alternate", 0, 0.0)]
    for policy, points_ in points.items():
        places = points_[::-1] if policy in FROM_ABOVE else points_
        grid += [(policy, k, t) for k, t in enumerate(places)]
    tried = spark.createDataFrame(grid, "policy string, cell int, t double")  # MOST_POINTS rows a gate
    upto = Window.partitionBy("policy").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    run = tried.join(moved, ["policy", "cell"], "left").select("policy", "t", *[F.coalesce(F.sum(k).over(upto), F.lit(0)).alias(k) for k in counts])
    whole = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"_{k}") for k, v in told(base).items()])
    share = lambda c, of="n": F.round(F.coalesce(F.try_divide(c.cast("double"), F.col(of)), F.lit(0.0)), 6)
    board = run.join(F.broadcast(whole)).withColumn("ranked", F.col("known") + F.col("_known")).select(
        "policy", "t", "n", share(F.col("hits") + F.col("_hits")).alias("accuracy"), share(F.col("top3") + F.col("_top3")).alias("recall_at_3"), share(F.col("top5") + F.col("_top5")).alias("recall_at_5"),
        share(F.col("mrr") + F.col("_mrr"), "ranked").alias("mrr"), share(F.col("used")).alias("alternate_rate"), F.col("fixes").cast("long").alias("fixes"), F.col("regressions").cast("long").alias("regressions"),
    ).where("n > 0")
    best = Window.orderBy(F.desc("accuracy"), F.desc("recall_at_3"), F.desc("mrr"), "alternate_rate", "policy", "t")  # over the grid
    return board.withColumn("place", F.row_number().over(best).cast("long"))


def fitted_gate(validation: DataFrame, test: DataFrame, rounds: int, seed: int | str) -> DataFrame:
    """The pair gate that leads on ``validation``, held to ``test``: (policy, t, validation_accuracy, test metrics, paired
    difference from the test's baseline and its bounds by convention C)."""
    board = pair_leaderboard(validation, pair_points(validation))
    lead = board.where("place = 1").select("policy", "t", F.col("accuracy").alias("validation_accuracy"))
    chosen = gated(test, lead.select("policy", "t"))
    counts = resample.paired_counts(chosen, ["policy", "t"], F.col("base_hit"), F.col("rank") == 1)
    ci = resample.paired_bootstrap(counts, ["policy", "t"], rounds, seed, "C").select("policy", "t", "delta", "ci_low", "ci_high")
    return gates.chosen_metrics(chosen, ["policy", "t"]).join(ci, ["policy", "t"]).join(F.broadcast(lead), ["policy", "t"])


def matrix_choice(mode: Column, base: Column, alt: Column, base_margin: Column, threshold: Column) -> Column:
    """True where a mode of the matrix takes the candidate; a margin that is missing never routes."""
    low = F.coalesce(base_margin < threshold, F.lit(False))
    same = label_family(base) == label_family(alt)
    return (
        F.when(mode == "raw", False).when(mode == "global_candidate", True).when(mode == "same_family", same).when(mode == "changed_same_family", same & (base != alt))
        .when(mode == "same_family_low_margin", same & low).otherwise(low)
    )


def tool_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (use_alt, base, alt, target): success, route, unsafe (another family) and boundary (same family) rates, fixes."""
    said = F.when(F.col("use_alt"), F.col("alt")).otherwise(F.col("base"))
    ok, was, same = said == F.col("target"), F.col("base") == F.col("target"), label_family(said) == label_family("target")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), metrics.rate(ok).alias("accuracy_at_1"), metrics.rate(F.col("use_alt")).alias("route_rate"), metrics.rate(~ok & ~same).alias("unsafe_wrong_tool_rate"), metrics.rate(~ok & same).alias("boundary_error_rate"),
        F.count_if(ok & ~was).alias("fixes"), F.count_if(was & ~ok).alias("regressions"),
    )


def family_gate(rows: DataFrame, mode: Column, threshold: Column) -> DataFrame:
    return rows.withColumn("use_alt", matrix_choice(mode, F.col("base"), F.col("alt"), F.col("base_margin"), threshold))


def select_threshold(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, mode, threshold): of the fitted modes the threshold with the best accuracy, then the fewest regressions, the
    lowest route rate and the smallest threshold; the other modes have zero.  Thresholds are the fixed points and the
    observed margins, rounded.

    A sweep: rows are counted by their rounded margin and whether they lie below it, and running sums over these tell
    each threshold what routing all margins below it changes."""
    base, alt, target = F.col("base"), F.col("alt"), F.col("target")
    gain = ((alt == target).cast("int") - (base == target).cast("int")).alias("gain")
    loss = ((base == target) & (alt != target)).cast("int").alias("loss")
    same = label_family(base) == label_family(alt)
    margin = rounded(F.col("base_margin"), ROUND)
    kept = rows.select(*by, gain, loss, same.alias("same"), (base == target).cast("int").alias("was"), margin.alias("t"), (F.col("base_margin") < margin).alias("below"))
    whole = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("was").alias("was"))
    counted = kept.where("t IS NOT NULL").groupBy(*by, "t", "below", "same").agg(F.count(F.lit(1)).alias("used"), F.sum("gain").alias("gain"), F.sum("loss").alias("loss"))
    fixed = whole.select(*by, F.explode(F.array(*[F.lit(x) for x in FAMILY_POINTS])).alias("t"))
    tried = counted.select(*by, "t").unionByName(fixed).distinct().withColumn("mode", F.explode(F.array(*[F.lit(m) for m in FITTED_MODES])))
    moved = counted.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in FITTED_MODES]))).where("same OR mode = 'margin_low'")
    zero = F.lit(0).cast("long")
    events = moved.select(*by, "mode", "t", F.when(F.col("below"), 0).otherwise(2).alias("step"), "used", "gain", "loss")
    events = events.unionByName(tried.select(*by, "mode", "t", F.lit(1).alias("step"), zero.alias("used"), zero.alias("gain"), zero.alias("loss")))
    upto = Window.partitionBy(*by, "mode").orderBy("t", "step").rangeBetween(Window.unboundedPreceding, 0)  # a few rows a threshold
    run = events.select(*by, "mode", "t", "step", *[F.sum(c).over(upto).alias(c) for c in ("used", "gain", "loss")]).where("step = 1")
    board = run.join(whole, by) if by else run.join(F.broadcast(whole))
    share = lambda c: F.round(c / F.col("n"), 6)
    order_ = F.struct((-share(F.col("was") + F.col("gain"))).alias("a"), F.col("loss").alias("r"), share(F.col("used")).alias("u"), F.col("t").alias("threshold"))
    best = board.groupBy(*by, "mode").agg(F.min(order_).alias("b"))
    rest = whole.select(*by, F.explode(F.array(*[F.lit(m) for m in MATRIX_MODES if m not in FITTED_MODES])).alias("mode"), F.lit(0.0).alias("threshold"))
    return best.select(*by, "mode", F.col("b.threshold").alias("threshold")).unionByName(rest)


def seeded(rows: DataFrame, seeds: list[int], selection: float, key: str = "sample_id") -> DataFrame:
    """Rows once for each seed, with split_seed and part: ``selection`` or ``locked``.  The cut is a hash below the ratio, so
    the parts' sizes are near it."""
    many = rows.withColumn("split_seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    unit = portable_hash(F.concat(F.lit("split"), F.col("split_seed").cast("string")), F.col(key)) / float(1 << 32)
    return many.withColumn("part", F.when(unit < selection, "selection").otherwise("locked"))


def policy_matrix(rows: DataFrame, seeds: list[int], selection: float, rounds: int, boot_seed: int | str) -> DataFrame:
    """(split_seed, mode, threshold, locked metrics, delta and bounds by convention D): every mode fitted on the selection part
    of every seed and held to its locked part.  ``rows`` has (sample_id, base, alt, target, base_margin)."""
    parts = seeded(rows, seeds, selection)
    fit, locked = parts.where("part = 'selection'"), parts.where("part = 'locked'")
    chosen = select_threshold(fit, ["split_seed"])
    held = family_gate(locked.join(F.broadcast(chosen), "split_seed"), F.col("mode"), F.col("threshold"))
    by = ["split_seed", "mode"]
    said = F.when(F.col("use_alt"), F.col("alt")).otherwise(F.col("base"))
    counts = resample.paired_counts(held, by, F.col("base") == F.col("target"), said == F.col("target"))
    ci = resample.paired_bootstrap(counts, by, rounds, boot_seed, "D").select(*by, "delta", "regression_rate", "ci_low", "ci_high")
    return tool_rates(held, [*by, "threshold"]).join(ci, by)


def matrix_summary(runs: DataFrame) -> DataFrame:
    """The matrix over its seeds: one row a mode."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return runs.groupBy("mode").agg(
        F.count(F.lit(1)).alias("seed_count"), F.count_if(F.col("delta") > 0).alias("positive_delta_count"), mean("delta", "mean_delta"), F.min("delta").alias("min_delta"), mean("ci_low", "mean_ci_lower"), mean("accuracy_at_1", "mean_locked_acc"),
        mean("route_rate", "mean_route_rate"), mean("regression_rate", "mean_regression_rate"), mean("unsafe_wrong_tool_rate", "mean_unsafe_wrong_tool_rate"), mean("boundary_error_rate", "mean_boundary_error_rate"),
    )


def raw_summary(rows: DataFrame, seeds: list[int], selection: float) -> DataFrame:
    """The baseline on each seed's locked part, once a seed, then over the seeds: the row that modes are compared with."""
    locked = seeded(rows, seeds, selection).where("part = 'locked'")
    per = tool_rates(family_gate(locked, F.lit("raw"), F.lit(0.0)), ["split_seed"])
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    out = per.agg(F.count(F.lit(1)).alias("seed_count"), mean("accuracy_at_1", "mean_locked_acc"), mean("unsafe_wrong_tool_rate", "mean_unsafe_wrong_tool_rate"), mean("boundary_error_rate", "mean_boundary_error_rate"))
    return out.withColumn("mode", F.lit("raw"))


def of_mode(summary: DataFrame, mode: str) -> DataFrame:
    """One mode's row of a matrix's summary; none if the mode was not run."""
    return summary.where(F.col("mode") == mode)


def materialized(rows: DataFrame, policy_id: str, mode: str, threshold: float) -> DataFrame:
    """A gate as an ordinary result: each row's chosen prediction, with what the gate saw."""
    out = family_gate(rows, F.lit(mode), F.lit(threshold))
    said = F.when(F.col("use_alt"), F.col("alt")).otherwise(F.col("base"))
    return out.select(
        "sample_id", "target", said.alias("prediction"), (said == F.col("target")).alias("hit_at_1"), F.lit(policy_id).alias("policy_id"), F.lit(mode).alias("gate_mode"), F.lit(threshold).alias("gate_threshold"), F.col("use_alt").alias("used_candidate"),
        F.col("base").alias("baseline_prediction"), F.col("alt").alias("candidate_prediction"), F.col("base_margin").alias("baseline_margin"),
    )


def reranked(rows: DataFrame, top_k: int, threshold: float, mode: str, min_texts: int = 0, max_ties: int = 0, budget: int = 0, tie: str = "vec_id") -> DataFrame:
    """A low-margin reranker: rows (sample_id, target, base_hit, margin, scores) whose margin is up to the threshold, whose
    first candidates have enough different texts and not too many ties, and within the budget (in row order) take the
    verifier's choice: the first candidate that hits (``oracle``) or the first of all (``none``).  A deployed miss has no
    rank."""
    if mode not in ("oracle", "none"):
        raise ValueError(f"no local reranker: {mode}")
    seen = rows.withColumns({"unique_text_count": records.unique_texts("scores", top_k), "top_tie_count": records.top_ties("scores", top_k)})
    wanted = F.coalesce(F.col("margin") <= threshold, F.lit(False))
    if min_texts > 0:
        wanted = wanted & (F.col("unique_text_count") >= min_texts)
    if max_ties > 0:
        wanted = wanted & (F.col("top_tie_count") <= max_ties)
    seen = seen.withColumn("_wanted", wanted)
    if budget > 0:
        seen = gates.budgeted(seen, "_wanted", [tie], budget).withColumnRenamed("spent", "rerouted")
    else:
        seen = seen.withColumn("rerouted", F.col("_wanted"))
    hits = F.transform(F.slice("scores", 1, top_k), lambda x: records.candidate_hit(F.col("sample_id"), F.col("target"), x, "auto"))
    first = F.coalesce(F.nullif(F.array_position(hits, True), F.lit(0)), F.lit(1)) if mode == "oracle" else F.lit(1)
    chosen = F.get("scores", (F.when(F.col("rerouted"), first).otherwise(1) - 1).cast("int"))
    hit = records.candidate_hit(F.col("sample_id"), F.col("target"), chosen, "auto")
    out = seen.withColumns({"selected_sample_id": chosen["sample_id"], "hit_at_1": F.coalesce(hit, F.lit(False))})
    return out.withColumn("rank", F.when(F.col("hit_at_1"), 1).otherwise(NO_RANK).cast("long")).drop("_wanted", "scores")


def rerank_summary(rows: DataFrame) -> DataFrame:
    """(sample_count, route_count, fixes, regressions and rank metrics) of ``reranked`` rows."""
    hit, base = F.col("hit_at_1"), F.col("base_hit")
    return rows.agg(F.count(F.lit(1)).alias("sample_count"), F.count_if("rerouted").alias("route_count"), F.count_if(hit & ~base).alias("fix_count"), F.count_if(base & ~hit).alias("regression_count"), *metrics.rank_aggregates("rank", (3, 5))[1:4])


#: What a verifier is asked for each task, how its input is named, and what caution adds.
VERIFIER_TASKS = {
    "tool_intent": ("You are verifying a spoken command intent.  Choose the tool intent label that best matches the user's utterance.  Prefer exact user goal and action boundary over broad topical similarity.", "Spoken command transcript"),
    "translation": ("You are verifying speech translation retrieval.  Choose the English candidate that best translates the source-language utterance. Prefer meaning equivalence over topical association.", "Source utterance transcript"),
    "other": ("Choose the candidate that best matches the query.", "Query"),
}
CONSERVATIVE = " Candidate A is the embedding model's current top-1. Keep A unless another candidate is clearly and directly better. If uncertain, choose A."
VERIFIER_SCHEMA = 'Return strict JSON only with this schema:\n{"choice":"A", "confidence":0.0, "reason":"short reason"}'


def verifier_prompt(query: Column | str, scores: Column | str, top_k: int, task: str, conservative: bool = False) -> Column:
    """What a verifier is asked about the first ``top_k`` candidates, listed as indented JSON."""
    text, name = VERIFIER_TASKS.get(task, VERIFIER_TASKS["other"])
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    choice = lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (i + 1).cast("int"), F.lit(1))
    item = lambda x, i: F.concat(F.lit('  {\n    "choice": "'), choice(i), F.lit('",\n    "candidate": '), quoted(x["text"]), F.lit(',\n    "retrieval_score": '), F.coalesce(x["score"].cast("string"), F.lit("null")), F.lit("\n  }"))
    listed = F.array_join(F.transform(F.slice(col(scores), 1, top_k), item), ",\n")
    said = text + (CONSERVATIVE if conservative else "")
    return F.concat(F.lit(f"{said}\n\n{name}:\n"), F.coalesce(col(query), F.lit("")), F.lit("\n\nCandidates:\n[\n"), listed, F.lit(f"\n]\n\n{VERIFIER_SCHEMA}"))


def verifier_choice(response: Column, top_k: int, candidates: Column) -> tuple[Column, Column]:
    """(index, whether it is a fallback) of a verifier's JSON: a letter outside the candidates falls back to the first."""
    said = F.upper(F.trim(F.coalesce(F.try_variant_get(F.try_parse_json(response), "$.choice", "string"), F.lit(""))))
    at = F.when(F.length(said) == 1, F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), said) - 1).otherwise(-1)
    bad = (at < 0) | (at >= F.least(F.lit(top_k), F.size(candidates)))
    return F.when(bad, 0).otherwise(at).cast("int"), bad
