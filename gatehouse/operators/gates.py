"""Gates between a baseline and an alternate row, voting over runs, and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, resample

#: The gates of a pair of rows, and those between text and audio.
PAIR_GATES = ("always_baseline", "always_alternate", "raw_low_margin", "alt_high_margin", "alt_margin_advantage", "top_score_advantage", "disagreement_raw_low_margin")
FAMILY_MODES = ("same_family", "changed_same_family", "same_family_low_margin", "low_margin")
AUDIO_GATES = ("text_only", "audio_only", "audio_text", "audio_on_invalid", "audio_on_text_audio_disagreement", "audio_on_text_equals_noquery", "audio_on_disagreement_or_text_equals_noquery", "audio_on_text_first_candidate", "audio_on_hint_pred_overlap_ge_0_80", "audio_on_hint_pred_overlap_ge_0_95")

ORDER_POLICIES = ("always_translation", "translation_if_original_top1_else_generic", "translation_if_original_top1_or_generic_not_original_top1_else_generic", "translation_if_original_top1_else_retrieval_top1")


def pair_choice(policy: Column, t: Column, base_margin: Column, alt_margin: Column, base_top: Column, alt_top: Column, agree: Column) -> Column:
    """True where a pair gate takes the alternate.  The disagreement gate takes it where both agree."""
    low = base_margin <= t
    return (
        F.when(policy == "always_baseline", False).when(policy == "always_alternate", True).when(policy == "raw_low_margin", low)
        .when(policy == "alt_high_margin", alt_margin >= t).when(policy == "alt_margin_advantage", F.round(alt_margin - base_margin, 6) >= t)
        .when(policy == "top_score_advantage", F.round(alt_top - base_top, 6) >= t).otherwise(agree | low)
    )


def family_choice(mode: Column, base: Column, alt: Column, base_margin: Column, t: Column) -> Column:
    """True where a family gate takes the alternate; margins are compared strictly."""
    same = F.split_part(base, F.lit("_"), F.lit(1)) == F.split_part(alt, F.lit("_"), F.lit(1))
    low = base_margin < t
    return F.when(mode == "same_family", same).when(mode == "changed_same_family", same & (base != alt)).when(mode == "same_family_low_margin", same & low).otherwise(low)


def order_choice(policy: Column, generic: Column, translation: Column, top: Column) -> tuple[Column, Column]:
    """(prediction, whether the translation is taken) when candidates are shown in another order; ``top`` is the first
    of the retrieval's own order."""
    steady = translation.eqNullSafe(top)
    taken = F.when(policy == ORDER_POLICIES[0], True).when(policy == ORDER_POLICIES[2], steady | ~generic.eqNullSafe(top)).otherwise(steady)
    return F.when(taken, translation).when(policy == ORDER_POLICIES[3], top).otherwise(generic), taken


def order_robustness(rows: DataFrame, most_regressions: float = 0.03) -> DataFrame:
    """One row a policy and its decision, from rows (policy, shown, delta, ci_low, regression_rate, fixes, regressions,
    route_rate); ``shown`` is ``base`` or names a shuffle."""
    shuffled, fair = F.col("shown") != "base", (F.col("delta") > 0) & (F.col("regression_rate") <= most_regressions)
    strict, weak = fair & (F.col("ci_low") > 0), fair & (F.col("ci_low") >= 0)
    out = rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("order_count"), F.count_if(shuffled).alias("shuffle_count"),
        F.round(F.avg("delta"), 8).alias("mean_delta"), F.min("delta").alias("min_delta"),
        F.round(F.avg(F.when(shuffled, F.col("delta"))), 8).alias("shuffle_mean_delta"), F.min(F.when(shuffled, F.col("delta"))).alias("shuffle_min_delta"),
        F.count_if(strict).alias("strict_accept_count"), F.count_if(weak).alias("weak_accept_count"),
        F.count_if(strict & shuffled).alias("shuffle_strict_accept_count"), F.count_if(weak & shuffled).alias("shuffle_weak_accept_count"),
        F.max("regression_rate").alias("max_regression_rate"), F.sum("fixes").alias("total_fixes"), F.sum("regressions").alias("total_regressions"),
        F.round(F.avg("route_rate"), 8).alias("mean_route_rate"),
    )
    said = (
        F.when(F.col("shuffle_strict_accept_count") == F.col("shuffle_count"), "strict_order_robust_accept")
        .when(F.col("shuffle_weak_accept_count") == F.col("shuffle_count"), "weak_order_robust_accept")
        .when((F.col("min_delta") > 0) & (F.col("max_regression_rate") <= most_regressions), "partial_order_repair")
        .otherwise("diagnostic_only")
    )
    return out.withColumn("decision", said)


def audio_choice(gate: Column, text: Column, audio: Column, noquery: Column, invalid: Column, first: Column, overlap: Column) -> Column:
    """True where a gate leaves the text row."""
    differ, equal = ~text.eqNullSafe(audio), F.coalesce((noquery != "") & (text == noquery), F.lit(False))
    return (
        F.when(gate == "text_only", False).when(gate.isin("audio_only", "audio_text"), True).when(gate == "audio_on_invalid", invalid)
        .when(gate == "audio_on_text_audio_disagreement", invalid | differ).when(gate == "audio_on_text_equals_noquery", invalid | equal)
        .when(gate == "audio_on_disagreement_or_text_equals_noquery", invalid | differ | equal)
        .when(gate == "audio_on_text_first_candidate", invalid | first)
        .when(gate == "audio_on_hint_pred_overlap_ge_0_80", invalid | (overlap >= 0.8)).otherwise(invalid | (overlap >= 0.95))
    )


def audio_cost(gate: Column, triggered: Column, text: Column, audio: Column, noquery: Column) -> Column:
    """The cost of all branches that the gate evaluated, even where the text stays."""
    zero = F.lit(0.0)
    text, audio, noquery = (F.coalesce(x, zero) for x in (text, audio, noquery))
    return (
        F.when(gate == "text_only", text).when(gate.isin("audio_only", "audio_text"), audio)
        .when(gate == "audio_on_text_audio_disagreement", text + audio).when(gate == "audio_on_disagreement_or_text_equals_noquery", text + noquery + audio)
        .when(gate == "audio_on_text_equals_noquery", text + noquery + F.when(triggered, audio).otherwise(zero))
        .otherwise(text + F.when(triggered, audio).otherwise(zero))
    )


def chosen_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (use_alt, rank, base_hit): accuracy, recalls, mrr, alternate_rate, fixes, regressions."""
    hit, base = F.col("rank") == 1, F.col("base_hit")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), metrics.rate(hit).alias("accuracy"), metrics.rate(F.col("rank") <= 3).alias("recall_at_3"), metrics.rate(F.col("rank") <= 5).alias("recall_at_5"),
        metrics.mean(1.0 / F.col("rank")).alias("mrr"), metrics.rate(F.col("use_alt")).alias("alternate_rate"), F.count_if(hit & ~base).alias("fixes"), F.count_if(base & ~hit).alias("regressions"),
    )


def budgeted(df: DataFrame, route: str, order: list[str], budget: int, by: list[str] | None = None) -> DataFrame:
    """Adds ``spent``: routed rows in order while the budget lasts.  The first ``budget`` routed rows are found by a
    top-k, so no task orders all rows."""
    routed = df.where(route)
    if by:
        first = routed.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= budget)
    else:
        first = routed.orderBy(*order).limit(budget)
    keys = [*(by or []), *order]
    return df.join(first.select(*keys, F.lit(True).alias("spent")), keys, "left").withColumn("spent", F.coalesce("spent", F.lit(False)))


def vote(df: DataFrame, key: str, run: str, prediction: str, rank: str, base_run: str) -> DataFrame:
    """(key, prediction, votes, runs, agreement, vote_margin, tie, base_votes): the majority of runs; ties go to the
    base run's prediction, then the lower average rank, then by name."""
    counts = df.groupBy(key, prediction).agg(F.count(F.lit(1)).alias("votes"), F.max((F.col(run) == base_run).cast("int")).alias("base"), F.round(F.avg(rank), 6).alias("avg_rank"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("base")).alias("b"), F.col("avg_rank").alias("r"), F.col(prediction).alias("p"))))
    out = counts.groupBy(key).agg(ordered.alias("o"), F.sum("votes").alias("runs"), F.max(F.when(F.col("base") == 1, F.col("votes"))).alias("base_votes"))
    top, second = -F.col("o")[0]["v"], F.coalesce(-F.get(F.col("o"), F.lit(1))["v"], F.lit(0))
    return out.select(key, F.col("o")[0]["p"].alias("prediction"), top.alias("votes"), "runs", F.round(top / F.col("runs"), 6).alias("agreement"), F.round((top - second) / F.col("runs"), 6).alias("vote_margin"), (top == second).alias("tie"), F.coalesce("base_votes", F.lit(0)).cast("long").alias("base_votes"))


#: What a vote's gates try.
AGREEMENTS, VOTE_MARGINS, BASE_VOTES = (0.5, 0.75, 1.0), (0, 1, 2, 3, 4), (0, 1, 2)


def consistency_gates() -> list[tuple[str, str]]:
    """(policy, condition in SQL) of all gates between a base run and the vote of many: columns said, base, votes, second,
    runs, base_votes."""
    grid = [(f"self_if_agreement_ge_{a}_margin_ge_{m}", f"votes >= {a} * runs AND votes - second >= {m}") for a in AGREEMENTS for m in VOTE_MARGINS]
    few = [(f"self_if_base_vote_le_{k}", f"base_votes <= {k}") for k in BASE_VOTES]
    return [("base", "false"), ("majority", "true"), *grid, ("self_when_base_loses_vote", "base_votes < votes"), *few]


def consistency_sweep(votes: DataFrame, rounds: int, seed: int | str) -> DataFrame:
    """(policy, n, success, delta, ci_low, ci_high, fixes, regressions, regression_rate, route_rate, decision, place): every
    gate over rows (said, base, target, votes, second, runs, base_votes), the best first.

    Rows are counted once by their two verdicts and vote, and gates are tried on the counts."""
    base_ok, said_ok, moved = F.col("base") == F.col("target"), F.col("said") == F.col("target"), F.col("said") != F.col("base")
    counts = votes.groupBy(base_ok.alias("base_ok"), said_ok.alias("said_ok"), moved.alias("moved"), "votes", "second", "runs", "base_votes").agg(F.count(F.lit(1)).alias("c"))
    policies = F.array(*[F.struct(F.lit(name).alias("policy"), F.expr(rule).alias("taken")) for name, rule in consistency_gates()])
    tried = counts.select("*", F.inline(policies))
    ok = F.when(F.col("taken"), F.col("said_ok")).otherwise(F.col("base_ok"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0))
    told = tried.groupBy("policy").agg(F.sum("c").alias("n"), total(ok).alias("right"), total(ok & ~F.col("base_ok")).alias("fixes"), total(F.col("base_ok") & ~ok).alias("regressions"), total(F.col("taken") & F.col("moved")).alias("routed"))
    share = lambda c: F.round(F.col(c) / F.col("n"), 6)
    told = told.withColumns({"success": share("right"), "delta": F.round((F.col("fixes") - F.col("regressions")) / F.col("n"), 6), "regression_rate": share("regressions"), "route_rate": share("routed")})
    out = resample.paired_bootstrap(told, ["policy"], rounds, seed, "D")
    good = (F.col("delta") > 0) & (F.col("ci_low") > 0) & (F.col("regression_rate") <= 0.03)
    decision = F.when(F.col("policy") == "base", "fallback").when(good, "accepted").when(F.col("delta") > 0, "weak_trend_rejected").otherwise("rejected")
    best = Window.orderBy(F.desc("delta"), "regressions", "route_rate", "policy")  # a row a gate
    return out.select("policy", "n", "success", "delta", "ci_low", "ci_high", "fixes", "regressions", "regression_rate", "route_rate", decision.alias("decision"), F.row_number().over(best).alias("place"))


def aligned(rows: DataFrame, key: str, run: str, names: list[str], value: str, strict: bool = True) -> DataFrame:
    """(``key``, a column for each run, missing): the runs of each key side by side; ``missing`` counts those without a row,
    which ``strict`` makes an error.  A run with two rows of a key is an error, too."""
    many = rows.groupBy(key).pivot(run, names).agg(F.count(F.lit(1)).alias("n"), F.first(value).alias("v"))
    gone = sum((F.coalesce(F.col(f"{n}_n"), F.lit(0)) == 0).cast("int") for n in names)
    twice = F.greatest(*[F.coalesce(F.col(f"{n}_n"), F.lit(0)) for n in names], F.lit(0)) > 1
    said = lambda what: F.raise_error(F.concat(F.lit(f"{what} for "), F.col(key).cast("string"))).cast("int")
    told = F.when(twice, said("a run has two rows")).when((gone > 0) & F.lit(strict), said("a run has no row")).otherwise(gone)
    return many.select(key, *[F.col(f"{n}_v").alias(n) for n in names], told.alias("missing"))
