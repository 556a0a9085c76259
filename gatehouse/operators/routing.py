"""Training-free routing: policies are rows of a small literal table, evaluated by CASE over all rows in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, resample

#: The route policies, and the styles that are no dialect.
POLICIES = ("asr_confidence_branch", "asr_primary", "dialect_aware_branch", "disagreement_rerank", "omni_primary", "rrf")
STANDARD_STYLES = ("mandarin", "noisy_mandarin", "clean", "standard", "unknown")


def source_rank(source: str) -> Column:
    return F.col({"asr": "asr_rank", "omni": "omni_rank", "rrf": "rrf_rank", "best_of_views_oracle": "best_of_two_rank", "oracle_best": "best_of_two_rank"}[source])


def unreliable(confidence_below: float, wer_from: float) -> Column:
    """A strong dialect, a low confidence, or a high error rate; what is missing never triggers."""
    style = F.lower(F.coalesce(F.nullif(F.col("tts_dialect"), F.lit("")), F.col("query_style"), F.lit("")))
    return ((style != "") & ~style.isin(*STANDARD_STYLES)) | F.coalesce(F.col("confidence") < confidence_below, F.lit(False)) | F.coalesce(F.col("asr_wer") >= wer_from, F.lit(False))


def routed(df: DataFrame, policies: tuple[str, ...] = POLICIES, confidence_below: float = 0.6, wer_from: float = 0.6, unrouted: str = "asr", fallback: str = "rrf") -> DataFrame:
    """Each row under each policy: policy, routed, source, rank, hit, asr_hit."""
    rows = df.withColumn("policy", F.explode(F.array(*[F.lit(p) for p in policies])))
    p = F.col("policy")
    taken = F.when(p == "disagreement_rerank", F.coalesce("disagreement", F.lit(False))).when(p == "asr_confidence_branch", F.coalesce(F.col("confidence") < confidence_below, F.lit(False))).when(p == "dialect_aware_branch", unreliable(confidence_below, wer_from)).otherwise(False)
    rows = rows.withColumn("routed", taken)
    r = F.col("routed")
    choose = lambda value: (
        F.when(p == "omni_primary", value("omni")).when(p == "rrf", value("rrf"))
        .when(p == "disagreement_rerank", F.when(r, value(fallback)).otherwise(value(unrouted)))
        .when(p.isin("asr_confidence_branch", "dialect_aware_branch"), F.when(r, value("omni")).otherwise(value("asr")))
        .otherwise(value("asr"))
    )
    name = choose(lambda s: F.lit(s))
    source = F.when((p == "disagreement_rerank") & r, F.lit(f"fallback_{fallback}")).otherwise(name)
    out = rows.withColumns({"rank": choose(source_rank), "source": source})
    return out.withColumns({"hit": F.col("rank") == 1, "asr_hit": F.col("asr_rank") == 1})


def leaderboard(rows: DataFrame, rounds: int = 200, seed: int = 42) -> DataFrame:
    """One row for each policy of ``routed``: rank metrics, rates, rescues of ASR failures, regressions, and the paired
    interval against ASR (convention A)."""
    hit, base = F.col("hit"), F.col("asr_hit")
    out = rows.groupBy("policy").agg(
        *metrics.rank_aggregates("rank"),
        metrics.rate(F.col("routed")).alias("route_rate"),
        F.when(F.first("policy") == "disagreement_rerank", metrics.rate(F.col("routed"))).otherwise(0.0).alias("api_call_rate"),
        F.count_if(hit & ~base).alias("rescue_count"),
        metrics.share(hit, ~base).alias("rescue_rate"),
        F.count_if(base & ~hit).alias("regression_count"),
        metrics.rate(base & ~hit).alias("regression_rate"),
    )
    counts = resample.paired_counts(rows, ["policy"], base, hit)
    ci = resample.paired_bootstrap(counts, ["policy"], rounds, seed, "A")
    ci = ci.select("policy", F.col("delta").alias("delta_vs_asr"), F.col("ci_low").alias("lcb_vs_asr"), F.col("ci_high").alias("ucb_vs_asr"))
    return out.join(ci, "policy").orderBy(F.desc("acc_at_1"), F.desc("mrr"), "api_call_rate", "policy")


#: Rule kinds of offline policies: a constant action, or a condition with two actions.
ACTIONS = ("asr", "omni", "rrf")


def offline_policies(confidence: tuple[float, ...] = (0.3, 0.5, 0.7), asr_margin: tuple[float, ...] = (0.02, 0.05, 0.1), omni_margin: tuple[float, ...] = (0.02, 0.05, 0.1)) -> list[tuple[str, str, float | None, str, str]]:
    """(policy_id, kind, threshold, then, else), in the order in which ties are won."""
    out: list[tuple[str, str, float | None, str, str]] = [(f"constant_{a}", "constant", None, a, a) for a in ACTIONS]
    out += [(f"disagreement_to_{a}", "if_disagreement", None, a, "asr") for a in ("omni", "rrf")]
    out += [(f"confidence_below_{t:g}_to_{a}", "if_confidence_below", t, a, "asr") for t in confidence for a in ("omni", "rrf")]
    out += [(f"asr_margin_below_{t:g}_to_{a}", "if_asr_margin_below", t, a, "asr") for t in asr_margin for a in ("omni", "rrf")]
    return out + [(f"omni_margin_above_{t:g}_to_omni", "if_omni_margin_above", t, "omni", "asr") for t in omni_margin]


def under_rules(df: DataFrame, policies: list[tuple[str, str, float | None, str, str]], mrr_weight: float = 0.1, regression_penalty: float = 0.5, baseline: str = "asr") -> DataFrame:
    """Each row under each rule: policy_id, place, action, rank, hit, base_hit, regression, reward."""
    rules = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("policy_id"), F.lit(k).alias("kind"), F.lit(t).cast("double").alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (n, k, t, a, b) in enumerate(policies)])
    rows = df.select("*", F.inline(rules))
    k, t = F.col("kind"), F.col("t")
    test = F.when(k == "constant", True).when(k == "if_disagreement", F.col("disagreement")).when(k == "if_confidence_below", F.col("confidence") < t).when(k == "if_asr_margin_below", F.col("asr_margin") < t).otherwise(F.col("omni_margin") >= t)
    rows = rows.withColumn("action", F.when(F.coalesce(test, F.lit(False)), F.col("a")).otherwise(F.col("b")))
    rank = F.when(F.col("action") == "omni", F.col("omni_rank")).when(F.col("action") == "rrf", F.col("rrf_rank")).otherwise(F.col("asr_rank"))
    rows = rows.withColumns({"rank": rank, "base_hit": source_rank(baseline) == 1})
    rows = rows.withColumn("hit", F.col("rank") == 1).withColumn("regression", F.col("base_hit") & ~F.col("hit"))
    return rows.withColumn("reward", F.col("hit").cast("double") + mrr_weight / F.col("rank") - regression_penalty * F.col("regression").cast("double"))


def rule_metrics(rows: DataFrame, by: list[str], baseline: str = "asr") -> DataFrame:
    """n, reward, acc_at_1, mrr, regressions, route rate, and the entropy of the actions (natural log, + 1e-12)."""
    n = F.count(F.lit(1))
    part = lambda a: F.count_if(F.col("action") == a) / n
    term = lambda a: F.when(part(a) > 0, -part(a) * F.log(part(a) + 1e-12)).otherwise(0.0)
    return rows.groupBy(*by).agg(
        n.alias("n"), metrics.mean(F.col("reward")).alias("reward"), metrics.rate(F.col("hit")).alias("acc_at_1"), metrics.mean(1.0 / F.col("rank")).alias("mrr"),
        F.count_if("regression").alias("regression_count"), metrics.rate(F.col("action") != baseline).alias("route_rate"),
        (F.round(sum((term(a) for a in ACTIONS), F.lit(0.0)), 6) + 0.0).alias("policy_entropy"),
    )
