"""Selection protocols: proposal, selection and locked test; accept gates; stability over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import rounded
from . import metrics, resample, sampling


def common_ids(df: DataFrame, key: str = "sample_id", candidate: str = "candidate") -> DataFrame:
    """The keys that every candidate has."""
    n = df.select(candidate).distinct().count()
    return df.groupBy(key).agg(F.count_distinct(candidate).alias("c")).where(F.col("c") == n).select(key)


def split(df: DataFrame, seed: int | str, proposal: float = 0.2, selection: float = 0.3, least: int = 0, key: str = "sample_id") -> DataFrame:
    """Adds split to the rows whose key all candidates have."""
    ids = sampling.placed(common_ids(df, key), key, seed)
    return df.join(ids.select(key, sampling.three_way(F.col("nth"), F.col("n"), proposal, selection, least).alias("split")), key)


def leaderboard(df: DataFrame, by: list[str], r3_weight: float = 0.1, mrr_weight: float = 0.1) -> DataFrame:
    """n, acc_at_1, recall_at_3, recall_at_5, mrr, mean_rank, reward of each candidate (with its pos) and split."""
    out = df.groupBy(*by).agg(*metrics.rank_aggregates("rank", (3, 5)))
    return out.withColumn("reward", rounded(F.col("acc_at_1") + r3_weight * F.col("recall_at_3") + mrr_weight * F.col("mrr"), 6))


def best(board: DataFrame, by: list[str], keys: list[Column]) -> DataFrame:
    """The first row of each group in the order of ``keys``; boards are small."""
    return board.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where("_n = 1").drop("_n")


def reject_reasons(clauses: list[tuple[Column, str]]) -> Column:
    """The names of the clauses that hold, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in clauses])), ",")


def evaluated(df: DataFrame, baseline: str, by: list[str], group: str, rounds: int, seed: int, protect: float, min_lcb: float = 0.0, max_regression: float = 0.03, max_protected: float = 0.0, min_worst: float = -0.05) -> DataFrame:
    """Each candidate in each group of ``by`` against the baseline: metrics, paired statistics (convention C),
    protected regressions, the worst group, reject reasons and status.  ``df`` has rank, hit, base_hit, base_margin."""
    keys = [*by, "candidate", "pos"]
    board = leaderboard(df, keys)
    counts = resample.paired_counts(df, keys, F.col("base_hit"), F.col("hit"))
    ci = resample.paired_bootstrap(counts, keys, rounds, seed, "C").drop("n").withColumnsRenamed({"delta": "hit_delta", "ci_low": "hit_lcb", "ci_high": "hit_ucb", "fixes": "fix_count", "regressions": "regression_count"})
    guarded = F.col("base_hit") & F.coalesce(F.col("base_margin") >= protect, F.lit(False))
    safe = df.groupBy(*keys).agg(F.count_if(guarded).alias("protected_total"), metrics.share(~F.col("hit"), guarded).alias("protected_regression_rate"))
    worst = metrics.worst_group(df.withColumn("_d", F.col("hit").cast("double") - F.col("base_hit").cast("double")), keys, group, "_d")
    out = board.join(ci, keys).join(safe, keys).join(worst, keys)
    delta, lcb, reg, prot, low = (F.col(c) for c in ("hit_delta", "hit_lcb", "regression_rate", "protected_regression_rate", "worst_group_delta"))
    reasons = reject_reasons([(delta <= 0, "mean_delta_not_positive"), (lcb <= min_lcb, "bootstrap_lcb_not_positive"), (reg > max_regression, "regression_rate_too_high"), (prot > max_protected, "protected_regression_rate_too_high"), (low < min_worst, "worst_group_delta_too_low")])
    own = F.col("candidate") == baseline
    out = out.withColumn("reject_reasons", F.when(own, "").otherwise(reasons))
    fine = (reg <= max_regression) & (prot <= max_protected) & (low >= min_worst)
    status = F.when(own, "baseline").when(F.col("reject_reasons") == "", "accepted").when((delta > 0) & fine, "underpowered_positive").when((delta < 0) | ~fine, "harmful_rejected").otherwise("raw_fallback")
    return out.withColumns({"candidate_status": status, "accepted": own | (F.col("reject_reasons") == "")})


def decision(board: DataFrame, baseline: str, by: list[str]) -> DataFrame:
    """(by, selected, selected_status, diagnostic, diagnostic_status, locked_accepted, decision) of ``evaluated`` rows
    with a split: the best accepted candidate on selection, else the baseline, then held to the locked test."""
    rows = board.where("split = 'selection'")
    other = rows.where(F.col("candidate") != baseline)
    taken = best(other.where("accepted"), by, [F.desc("reward"), F.desc("hit_delta"), F.desc("mrr"), F.col("pos")]) if by else best(other.where("accepted").withColumn("_a", F.lit(1)), ["_a"], [F.desc("reward"), F.desc("hit_delta"), F.desc("mrr"), F.col("pos")]).drop("_a")
    priority = F.when(F.col("candidate_status") == "underpowered_positive", 3).when(F.col("candidate_status") == "harmful_rejected", 2).when(F.col("candidate_status") == "raw_fallback", 1).otherwise(0)
    seen = best(other.withColumn("_p", priority), by, [F.desc("_p"), F.desc("hit_delta"), F.desc("mrr"), F.desc("reward"), F.col("pos")])
    out = rows.select(*by).distinct().join(taken.select(*by, F.col("candidate").alias("selected")), by, "left").join(seen.select(*by, F.col("candidate").alias("diagnostic"), F.col("candidate_status").alias("diagnostic_status")), by, "left")
    out = out.withColumn("selected", F.coalesce("selected", F.lit(baseline)))
    locked = board.where("split = 'locked_test'").select(*by, F.col("candidate").alias("selected"), F.col("accepted").alias("locked_accepted"), F.col("hit_delta").alias("locked_hit_delta"), F.col("hit_lcb").alias("locked_hit_lcb"), F.col("regression_rate").alias("locked_regression_rate"))
    out = out.join(locked, [*by, "selected"], "left")
    word = F.when(F.col("selected") != baseline, F.when(F.col("locked_accepted"), "accepted").otherwise("selected_not_validated")).when(F.col("diagnostic_status").isin("underpowered_positive", "harmful_rejected"), F.col("diagnostic_status")).otherwise("raw_fallback")
    return out.withColumn("decision", word)


def stability(decisions: DataFrame, min_selection: float = 0.6, min_locked: float = 0.6, max_regression: float = 0.03) -> DataFrame:
    """Over seeds: how often each candidate is selected and holds, and whether it is accepted."""
    total = decisions.agg(F.count(F.lit(1)).alias("total_runs"))
    out = decisions.groupBy(F.col("selected").alias("name")).agg(F.count(F.lit(1)).alias("selected_count"), metrics.rate(F.col("locked_accepted")).alias("locked_pass_rate"), metrics.mean(F.col("locked_hit_delta")).alias("mean_locked_delta"), metrics.mean(F.col("locked_hit_lcb")).alias("mean_locked_lcb"), metrics.mean(F.col("locked_regression_rate")).alias("mean_locked_regression_rate"))
    out = out.join(F.broadcast(total)).withColumn("selection_rate", F.round(F.col("selected_count") / F.col("total_runs"), 6))
    reasons = reject_reasons([(F.col("selection_rate") < min_selection, "selection_rate_too_low"), (F.col("locked_pass_rate") < min_locked, "locked_pass_rate_too_low"), (F.col("mean_locked_delta") <= 0, "mean_locked_delta_not_positive"), (F.col("mean_locked_regression_rate") > max_regression, "mean_regression_rate_too_high")])
    return out.withColumn("reject_reasons", reasons).withColumn("accepted", F.col("reject_reasons") == "")


def accept_asr_like(board: DataFrame, baseline: str, recall_weight: float = 0.1, mrr_weight: float = 0.1, max_recall_regression: float = 0.0, max_regression: float = 0.03) -> DataFrame:
    """Candidates of a board with acc_at_1, recall_at_3, mrr, ci_low, regression_rate held to the five clauses."""
    utility = F.col("acc_at_1") + recall_weight * F.col("recall_at_3") + mrr_weight * F.col("mrr")
    base = board.where(F.col("candidate") == baseline).select(F.col("acc_at_1").alias("b1"), F.col("recall_at_3").alias("b3"), utility.alias("bu"))
    out = board.where(F.col("candidate") != baseline).join(F.broadcast(base))
    out = out.withColumns({"primary_delta": F.round(F.col("acc_at_1") - F.col("b1"), 6), "recall_delta": F.round(F.col("recall_at_3") - F.col("b3"), 6), "utility_delta": rounded(utility - F.col("bu"), 6)})
    reasons = reject_reasons([(F.col("primary_delta") <= 0, "primary_metric_not_improved"), (F.col("utility_delta") <= 0, "utility_not_improved"), (F.col("recall_delta") < -max_recall_regression, "recall_regression"), (F.col("ci_low") <= 0, "paired_ci_lower_bound_not_positive"), (F.col("regression_rate") > max_regression, "paired_regression_rate_too_high")])
    return out.withColumn("reject_reasons", reasons).withColumn("accepted", F.col("reject_reasons") == "").drop("b1", "b3", "bu")


def accept_tool(board: DataFrame, baseline: str, mrr_weight: float = 0.5, max_primary_regression: float = 0.0, max_unsafe_increase: float = 0.0, max_regression: float = 0.03) -> DataFrame:
    """Candidates with acc_at_1, recall_at_3, mrr, unsafe_rate, regression_rate held to the four clauses."""
    base = board.where(F.col("candidate") == baseline).select(F.col("acc_at_1").alias("b1"), F.col("recall_at_3").alias("b3"), F.col("mrr").alias("bm"), F.col("unsafe_rate").alias("bu"))
    out = board.where(F.col("candidate") != baseline).join(F.broadcast(base))
    out = out.withColumns({"primary_delta": F.round(F.col("acc_at_1") - F.col("b1"), 6), "quality_delta": rounded(F.col("recall_at_3") - F.col("b3") + mrr_weight * (F.col("mrr") - F.col("bm")), 6), "unsafe_delta": F.round(F.col("unsafe_rate") - F.col("bu"), 6)})
    reasons = reject_reasons([(F.col("primary_delta") < -max_primary_regression, "primary_metric_regression"), (F.col("quality_delta") <= 0, "candidate_quality_not_improved"), (F.col("unsafe_delta") > max_unsafe_increase, "unsafe_wrong_tool_increased"), (F.col("regression_rate") > max_regression, "paired_regression_rate_too_high")])
    return out.withColumn("reject_reasons", reasons).withColumn("accepted", F.col("reject_reasons") == "").drop("b1", "b3", "bm", "bu")


ACCEPT_FAMILIES = {"asr_like": accept_asr_like, "tool": accept_tool}


def accept(family: str, board: DataFrame, baseline: str, **limits: float) -> DataFrame:
    """The accept gate of a family: (family, candidate, primary_delta, regression_rate, reject_reasons, accepted)."""
    if family not in ACCEPT_FAMILIES:
        raise ValueError(f"unsupported family: {family}")
    out = ACCEPT_FAMILIES[family](board, baseline, **limits)
    return out.select(F.lit(family).alias("family"), "candidate", "primary_delta", "regression_rate", "reject_reasons", "accepted")
