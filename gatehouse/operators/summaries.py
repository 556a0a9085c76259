"""Fixed-shape reports over runs and other reports.  Reports are small; rows are reduced by aggregates before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import nested
from ..functions.text import col, non_blank, shorten
from . import metrics

#: Conditions in their order, where a task's report keeps its metrics and under which names, words that tell a
#: neighbouring translation, and what a gate's reason says of a case.
STRESS_CONDITIONS = ("text_only", "audio_only", "audio_text")
RESCUE_CONDITIONS = ("no_query", "text_only", "audio_only", "audio_text")
RESCUE_CONTRASTS = (("audio_only", "text_only"), ("audio_text", "text_only"), ("audio_text", "audio_only"))
RESULT_PATHS = {
    "rag": ("$.metrics.test.n", "$.metrics.test.omni", ("text_accuracy", "text_recall_at_3", "text_recall_at_5", "text_mrr", "text_mean_rank")),
    "tool": ("$.metrics.omni_audio.n", "$.metrics.omni_audio.metrics", ("accuracy_at_1", "accuracy_at_3", "accuracy_at_5", "mrr", "mean_rank")),
    "asr_like": ("$.metrics.test.n", "$.metrics.test.text", ("text_accuracy", "text_recall_at_3", "text_recall_at_5", "text_mrr", "text_mean_rank")),
}
RESULT_NAMES = ("acc_at_1", "recall_at_3", "recall_at_5", "mrr", "mean_rank")
ROW_PATHS = {"rag": "$.metrics.test.rows", "tool": "$.metrics.omni_audio.rows", "asr_like": "$.metrics.test.rows"}
NEIGHBOUR_WORDS = ("matter", "problem", "homework", "finished")
GATE_REASONS = (("text_equals_noquery", "text_hint_uninformative"), ("overlap", "text_candidate_overlap_trigger"), ("first_candidate", "position_sensitive_trigger"))


def result_metrics(document: Column | str, task: str) -> dict[str, Column]:
    """n and the rank metrics of a task's report (JSON); a missing recall at 5 is zero."""
    if task not in RESULT_PATHS:
        raise ValueError(f"unknown task: {task}")
    n, place, fields = RESULT_PATHS[task]
    got = {name: nested(document, f"{place}.{f}", "double", 0.0 if name == "recall_at_5" else None) for name, f in zip(RESULT_NAMES, fields, strict=True)}
    return {"n": nested(document, n, "long"), **got}


def task_rows(document: Column | str, task: str, row: str) -> Column:
    """The rows of a task's report as an array of structs of the type ``row``."""
    if task not in ROW_PATHS:
        raise ValueError(f"unknown task: {task}")
    return nested(document, ROW_PATHS[task], f"array<{row}>")


def first_complete(reports: DataFrame, least: int, place: str = "place") -> DataFrame:
    """Of reports (``place``, n, ...) the first with n of ``least`` or more, else the last; an error if there are none."""
    whole = F.coalesce(F.col("n"), F.lit(0)) >= least
    rest = [c for c in reports.columns if c != place]
    first = F.min(F.when(whole, F.struct(place, *rest)))
    last = F.max(F.struct(place, *rest))
    one = reports.agg(F.coalesce(first, last, F.raise_error(F.lit("none of the expected reports exists")).cast(reports.select(F.struct(place, *rest).alias("x")).schema["x"].dataType)).alias("r"))
    return one.select("r.*")


def labelled(summaries: DataFrame, tokens: tuple[str, ...], place: str = "place") -> DataFrame:
    """The first summary (place, label, ...) whose label has all tokens; an error if none has."""
    rest = [c for c in summaries.columns if c != place]
    has = reduce(lambda a, b: a & b, [F.contains(F.coalesce("label", F.lit("")), F.lit(t)) for t in tokens])
    one = summaries.where(has).agg(F.min(F.struct(place, *rest)).alias("r"))
    kind = one.schema["r"].dataType
    return one.select(F.coalesce("r", F.raise_error(F.lit(f"no label has all of {tokens}")).cast(kind)).alias("r")).select("r.*")


def policy_table(board: DataFrame, by: list[str], policies: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """A leaderboard as one wide row for each of ``by``: <policy>_<value>."""
    pick = lambda p, v: F.max(F.when(F.col("policy") == p, F.col(v))).alias(f"{p}_{v}")
    return board.groupBy(*by).agg(*[pick(p, v) for p in policies for v in values])


def decisions(rows: DataFrame) -> DataFrame:
    """Counts and means of rows (decision, selected_delta_vs_text, selected_audio_cost, audio_cost_reduction_rate)."""
    accepted = F.col("decision") == "accepted"
    mean = lambda c: metrics.mean(F.coalesce(F.col(c), F.lit(0.0))).alias(f"mean_{c}")
    return rows.agg(F.count(F.lit(1)).alias("dataset_count"), F.count_if(accepted).alias("accepted_count"), F.count_if(~F.coalesce(accepted, F.lit(False))).alias("fallback_count"), mean("selected_delta_vs_text"), mean("selected_audio_cost"), mean("audio_cost_reduction_rate"))


def verifier_budget(rows: DataFrame, most_regressions: int = 6) -> DataFrame:
    """Rows (delta, route_rate, regression_count) with their benefit per routed row and a decision."""
    good = (F.coalesce("regression_count", F.lit(0)) <= most_regressions) & (F.col("delta") > 0)
    per = F.when(F.coalesce("route_rate", F.lit(0.0)) != 0, F.round(F.col("delta") / F.col("route_rate"), 6))
    return rows.withColumns({"component": F.lit("low_margin_verifier"), "cost_type": F.lit("route_rate"), "cost_value": F.col("route_rate"), "benefit_per_cost": per, "decision": F.when(good, "accepted").otherwise("reject")})


def stress(conditions: DataFrame) -> DataFrame:
    """(dataset, place, task, failure_mode_after_policy and the rates) of rows (dataset, condition, rates), the known
    conditions alone, in their order."""
    place = F.array_position(F.array(*[F.lit(c) for c in STRESS_CONDITIONS]), F.col("condition"))
    mode = F.when(F.col("condition") == "audio_text", "corrupted text dominates if fused blindly").otherwise("wrong memory")
    rows = conditions.withColumn("place", place).where("place > 0")
    rest = [c for c in conditions.columns if c not in ("dataset", "condition")]
    return rows.select("dataset", "place", F.concat("dataset", F.lit(" "), "condition").alias("task"), F.lit("query_audio_rescue").alias("policy_type"), *rest, mode.alias("failure_mode_after_policy"))


def rescue(rows: DataFrame, by: list[str]) -> DataFrame:
    """Paired contrasts between conditions: (by, contrast, n, success of both, delta, fixes, regressions) of rows
    (by, condition, sample_id, task_success)."""
    known = rows.where(F.col("condition").isin(*RESCUE_CONDITIONS))
    wide = known.groupBy(*by, "sample_id").agg(*[F.max(F.when(F.col("condition") == c, F.col("task_success").cast("int"))).alias(c) for c in RESCUE_CONDITIONS])
    pairs = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("contrast"), F.col(a).alias("new"), F.col(b).alias("base")) for a, b in RESCUE_CONTRASTS])
    long = wide.select(*by, F.inline(pairs)).where("new IS NOT NULL AND base IS NOT NULL")
    return long.groupBy(*by, "contrast").agg(
        F.count(F.lit(1)).alias("n"), metrics.rate(F.col("new") == 1).alias("success"), metrics.rate(F.col("base") == 1).alias("base_success"), metrics.mean((F.col("new") - F.col("base")).cast("double")).alias("delta"),
        F.count_if(F.col("new") > F.col("base")).alias("fixes"), F.count_if(F.col("new") < F.col("base")).alias("regressions"),
    )


def packing(before: DataFrame, after: DataFrame, tokens: str, budget: int) -> DataFrame:
    """What packing did to prompts' tokens: (n, means, maxima, p95 and overflow rates before and after, and their changes)."""

    def side(df: DataFrame, name: str) -> DataFrame:
        over = df.agg(metrics.rate(F.col(tokens) > budget).alias(f"{name}_overflow_rate"))
        q = metrics.order_quantiles(df, tokens)
        return q.select("n", F.col("mean").alias(f"{name}_mean_prompt_tokens"), F.col("max").alias(f"{name}_max_prompt_tokens"), F.col("p95").alias(f"{name}_p95_prompt_tokens")).join(over)

    both = side(before, "original").join(side(after, "packed").drop("n"))  # one row each
    return both.select(
        "*", F.round(F.col("original_mean_prompt_tokens") - F.col("packed_mean_prompt_tokens"), 6).alias("mean_token_reduction"), F.round(F.col("packed_overflow_rate") - F.col("original_overflow_rate"), 6).alias("overflow_rate_delta"),
        F.lit(budget).alias("context_token_budget"),
    )


def cost_deltas(runs: DataFrame, by: list[str], run: str, baseline: str, values: tuple[str, ...], ratio: str) -> DataFrame:
    """Each run against the baseline of its group: <value>_delta, and the ratio of the value ``ratio``."""
    base = runs.where(F.col(run) == baseline).select(*by, *[F.col(v).alias(f"_{v}") for v in dict.fromkeys((*values, ratio))])
    other = runs.where(F.col(run) != baseline)
    both = other.join(F.broadcast(base), by) if by else other.join(F.broadcast(base))  # one row a group
    return both.select(*by, run, *[F.round(F.col(v) - F.col(f"_{v}"), 6).alias(f"{v}_delta") for v in values], F.round(F.try_divide(F.col(ratio), F.col(f"_{ratio}")), 6).alias(f"{ratio}_ratio"))


def readiness(locked: DataFrame, by: list[str], baseline: str) -> DataFrame:
    """(by, raw_acc_at_1, alternative_count, max_instruction_delta, alternative_regressions) of locked-test rows (candidate,
    acc_at_1, hit_delta, regression_count)."""
    other = F.col("candidate") != baseline
    return locked.groupBy(*by).agg(
        F.max(F.when(~other, F.col("acc_at_1"))).alias("raw_acc_at_1"), F.count_if(other).alias("alternative_count"), F.coalesce(F.max(F.when(other, F.col("hit_delta"))), F.lit(0.0)).alias("max_instruction_delta"),
        F.coalesce(F.sum(F.when(other, F.col("regression_count"))), F.lit(0)).cast("long").alias("alternative_regressions"),
    )


def sections(parts: dict[str, DataFrame]) -> DataFrame:
    """Several small reports as one table; columns that a part lacks are null."""
    named = [df.withColumn("section", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def packed_failure(base: str, packed: str) -> Column:
    """Why a packed run failed: two structs (task_success, wrong_memory, invalid_output)."""
    b, p = F.col(base), F.col(packed)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(flag(p["invalid_output"]), "packed_invalid_output").when(~flag(p["task_success"]) & flag(p["wrong_memory"]), "packed_wrong_memory")
        .when(flag(b["task_success"]) & ~flag(p["task_success"]), "packing_regression").otherwise("packed_other_failure")
    )


def gate_case(regression: Column, reason: Column) -> Column:
    """What kind of case a gated row is, by the first part of its reason that is known."""
    out = F.when(F.coalesce(regression, F.lit(False)), "audio_gate_regression")
    for part, name in GATE_REASONS:
        out = out.when(F.contains(F.coalesce(reason, F.lit("")), F.lit(part)), name)
    return out.otherwise("gate_case")


def translation_regression(base: Column | str, target: Column | str, selected: Column | str) -> Column:
    """Why a verified translation became wrong."""
    b, t, s = (F.lower(F.coalesce(col(c), F.lit(""))) for c in (base, target, selected))
    near = reduce(lambda x, y: x | y, [F.contains(s, F.lit(w)) for w in NEIGHBOUR_WORDS])
    moved = (s != "") & (t != "") & (s != t)
    return F.when(moved & near, "semantic_neighbor_translation").when(moved, "translation_style_or_boundary_conflict").when((b != "") & (t != "") & (b != t), "base_wrong_verifier_failed_to_rescue").otherwise("verifier_regression")


def paired_runs(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, base, new): two runs' rows as structs, of the keys that both have."""
    side = lambda df, name: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))
    return side(base, "base").join(side(new, "new"), key)


def packing_cases(base: DataFrame, packed: DataFrame, key: str, fixes: int, regressions: int) -> DataFrame:
    """The first fixes and regressions between two runs: fixes of overflowing or invalid rows before others, then by key.
    Rows have task_success, invalid_output, prediction and model_output."""
    both = paired_runs(base, packed, key).where("base.task_success != new.task_success")
    over = F.coalesce(F.col("base.invalid_output"), F.lit(False)) | F.contains(F.coalesce(F.col("base.model_output"), F.lit("")), F.lit("exceeds the available context"))
    rows = both.select(
        key, F.when(F.col("new.task_success"), "fix").otherwise("regression").alias("case_type"), over.alias("base_invalid_or_overflow"), F.col("base.prediction").alias("base_prediction"), F.col("new.prediction").alias("policy_prediction"),
        shorten(F.col("base.model_output"), 220).alias("base_output"), shorten(F.col("new.model_output"), 220).alias("packed_output"),
    )
    first = rows.where("case_type = 'fix'").orderBy(F.col("base_invalid_or_overflow").desc(), key).limit(fixes)
    return first.unionByName(rows.where("case_type = 'regression'").orderBy(key).limit(regressions))


def packing_counts(base: DataFrame, packed: DataFrame, key: str) -> DataFrame:
    """(compared, fixes, regressions, remaining_failures) between two runs."""
    b, n = F.col("base.task_success"), F.col("new.task_success")
    return paired_runs(base, packed, key).agg(F.count(F.lit(1)).alias("compared"), F.count_if(n & ~b).alias("fixes"), F.count_if(b & ~n).alias("regressions"), F.count_if(~n).alias("remaining_failures"))


def failure_cases(base: DataFrame, packed: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` rows by key that the packed run fails, with their class."""
    rows = paired_runs(base, packed, key).where("NOT new.task_success")
    return rows.select(key, packed_failure("base", "new").alias("case_type"), F.col("base.prediction").alias("original_prediction"), F.col("new.prediction").alias("packed_prediction"), F.col("base.task_success").alias("original_success")).orderBy(key).limit(most)


def gate_cases(rows: DataFrame, selected: DataFrame, most: int, key: str = "sample_id") -> DataFrame:
    """The first ``most`` rescues and regressions under each data set's selected gate: rows (dataset, gate, key, rescue,
    regression, reason), ``selected`` (dataset, gate)."""
    mine = rows.join(F.broadcast(selected), ["dataset", "gate"]).where("rescue OR regression")
    return mine.select("dataset", F.col("gate").alias("selected_gate"), key, gate_case(F.col("regression"), F.col("reason")).alias("case_type"), "rescue", "regression").orderBy("dataset", key).limit(most)


def verifier_cases(rows: DataFrame, most: int, key: str = "sample_id") -> DataFrame:
    """The first ``most`` regressions, with their class, and the first ``most`` fixes of rows (key, base_hit, hit_at_1,
    base_prediction, target, selected)."""
    made = lambda df, kind: df.select(key, kind.alias("case_type"), "base_prediction", "target", "selected").orderBy(key).limit(most)
    lost = made(rows.where("base_hit AND NOT hit_at_1"), translation_regression("base_prediction", "target", "selected"))
    return lost.unionByName(made(rows.where("NOT base_hit AND hit_at_1"), F.lit("low_margin_fix")))


def best_policy(rows: DataFrame, by: list[str], accepted: Column, delta: str) -> DataFrame:
    """(by, policy): the policy with the largest (accepted, delta), the first by place on ties."""
    best = rows.groupBy(*by).agg(F.max(F.struct(accepted.cast("int").alias("a"), F.col(delta).alias("d"), (-F.col("place")).alias("p"), "policy")).alias("b"))
    return best.select(*by, F.col("b.policy").alias("policy"), (F.col("b.a") == 1).alias("accepted"))


#: The policies between a generic run and the vote of several.
VOTE_POLICIES = ("always_multivote", "multivote_if_original_top1_else_generic", "multivote_if_original_top1_or_generic_not_original_top1_else_generic")


def vote_choice(policy: Column, generic: Column, vote: Column, generic_rank: Column, vote_rank: Column) -> tuple[Column, Column]:
    """(prediction, whether the vote is taken); ranks are places in the retrieval's own order."""
    taken = F.when(policy == VOTE_POLICIES[0], True).when(policy == VOTE_POLICIES[1], vote_rank == 1).otherwise((vote_rank == 1) | (generic_rank != 1))
    return F.when(taken, vote).otherwise(generic), taken


def long_metrics(df: DataFrame, by: list[str], prefix: str = "") -> DataFrame:
    """(by, metric, value): the numbers of a report as rows, as a tracking store takes them."""
    numbers = [f.name for f in df.schema.fields if f.name not in by and f.dataType.typeName() in ("double", "float", "long", "integer")]
    return df.select(*by, F.inline(F.array(*[F.struct(F.lit(f"{prefix}{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])))


def keyed_baseline(rows: DataFrame | None, like: DataFrame, key: str = "query_id") -> DataFrame:
    """An optional baseline report by its key, the last row of each; without one an empty table of the same columns."""
    if rows is None:
        return like.where(F.lit(False))
    rest = [c for c in rows.columns if c != key]
    return rows.where(non_blank(F.col(key).cast("string")).isNotNull()).groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*")
