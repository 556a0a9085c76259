"""Gates fitted on one half of the driver's rankings and held to the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import rounded
from ..operators import fitting as T
from ..shared import materialize
from ..views import HYBRID_SQL, candidate_lists, hybrid, label_name
from .evaluation import FIT_ROUNDS, ROUNDS, boot_sql, ci_sql
from .registry import hash_sql, registry

QUERIES, ORACLE_SQL, query = registry()
NAME = "(['alarm', 'email', 'music', 'play'])[{0} % 4 + 1] || '_' || {0}"


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head view as the baseline and the full view as its alternate."""
    h = hybrid(spark, sf_dir)
    return h.select(
        "vec_id", F.col("asr_rank").alias("base_rank"), F.col("omni_rank").alias("alt_rank"), F.col("asr_margin").alias("base_margin"), F.col("omni_margin").alias("alt_margin"),
        F.col("asr_score").alias("base_top"), F.col("omni_score").alias("alt_top"), (F.col("asr_top") == F.col("omni_top")).alias("agree"),
    )


def points_sql(name: str, value: str, rows: str) -> str:
    """CTE ``name`` (t): up to 100 of the distinct values at even places of their order."""
    return f"""{name}_v AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT {value} AS t FROM {rows})),
{name} AS (SELECT t FROM {name}_v WHERE n <= 100 OR nth IN (SELECT CAST(round_even(i * (m - 1) / 99e0, 0) AS BIGINT) FROM range(100) AS r(i), (SELECT max(n) AS m FROM {name}_v)))"""


VALIDATION_SQL = HYBRID_SQL + ", va AS (SELECT * FROM h WHERE vec_id % 2 = 0), " + ", ".join(
    points_sql(n, v, "va") for n, v in (("p1", "asr_margin"), ("p2", "omni_margin"), ("p3", "round(omni_margin - asr_margin, 6)"), ("p4", "round(omni_score - asr_score, 6)"))
) + """, gr AS (SELECT 'always_baseline' AS policy, 0e0 AS t UNION ALL SELECT 'always_alternate', 0e0 UNION ALL SELECT 'raw_low_margin', t FROM p1 UNION ALL SELECT 'alt_high_margin', t FROM p2
   UNION ALL SELECT 'alt_margin_advantage', t FROM p3 UNION ALL SELECT 'top_score_advantage', t FROM p4 UNION ALL SELECT 'disagreement_raw_low_margin', t FROM p1),
gu AS (SELECT policy, t, vec_id, asr_rank, asr_rank = 1 AS base_hit, CASE policy WHEN 'always_baseline' THEN false WHEN 'always_alternate' THEN true WHEN 'raw_low_margin' THEN asr_margin <= t WHEN 'alt_high_margin' THEN omni_margin >= t
   WHEN 'alt_margin_advantage' THEN round(omni_margin - asr_margin, 6) >= t WHEN 'top_score_advantage' THEN round(omni_score - asr_score, 6) >= t ELSE asr_top = omni_top OR asr_margin <= t END AS use_alt, omni_rank FROM h, gr),
gc AS (SELECT *, CASE WHEN use_alt THEN omni_rank ELSE asr_rank END AS rank FROM gu)"""
CHOSEN = """count(*) AS n, round(avg(CAST(rank = 1 AS INT)), 6) AS accuracy, round(avg(CAST(rank <= 3 AS INT)), 6) AS recall_at_3, round(avg(CAST(rank <= 5 AS INT)), 6) AS recall_at_5, round(avg(1e0 / rank), 6) AS mrr, round(avg(CAST(use_alt AS INT)), 6) AS alternate_rate,
  count(*) FILTER (WHERE rank = 1 AND NOT base_hit) AS fixes, count(*) FILTER (WHERE base_hit AND rank <> 1) AS regressions"""
BOARD_SQL = VALIDATION_SQL + f""", bd AS (SELECT policy, t, {CHOSEN} FROM gc WHERE vec_id % 2 = 0 GROUP BY policy, t),
bp AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, recall_at_3 DESC, mrr DESC, alternate_rate, policy, t) AS place FROM bd)"""


@query(f"WITH {BOARD_SQL} SELECT * FROM bp")
def fitted_policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fixed policies and five gates at up to 100 thresholds each, on the even rows."""
    rows = materialize(pair_rows(spark, sf_dir).where("vec_id % 2 = 0"), "pairs")
    return T.pair_leaderboard(rows, T.pair_points(rows))


@query(f"""WITH {BOARD_SQL}, te AS (SELECT gc.*, bp.accuracy AS validation_accuracy FROM gc JOIN bp ON gc.policy = bp.policy AND gc.t = bp.t WHERE place = 1 AND vec_id % 2 = 1),
cn AS (SELECT policy, count(*) AS n, count(*) FILTER (WHERE rank = 1 AND NOT base_hit) AS fixes, count(*) FILTER (WHERE base_hit AND rank <> 1) AS regressions FROM te GROUP BY policy), {boot_sql("cn", "policy", FIT_ROUNDS)}, {ci_sql("policy", "C", FIT_ROUNDS)},
tm AS (SELECT policy, t, any_value(validation_accuracy) AS validation_accuracy, {CHOSEN} FROM te GROUP BY policy, t)
SELECT tm.*, round((fixes - regressions) / CAST(n AS DOUBLE), 6) AS delta, ci_low, ci_high FROM tm JOIN ci ON tm.policy = ci.policy""")
def fitted_policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading gate of the even rows, held to the odd ones."""
    rows = materialize(pair_rows(spark, sf_dir), "pairs")
    return T.fitted_gate(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), FIT_ROUNDS, 42)


SEEDS = (3, 11, 29)


def tool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two views as tool calls; one margin in nine is missing."""
    h = hybrid(spark, sf_dir)
    return h.select("sample_id", "target", label_name(F.col("asr_top")).alias("base"), label_name(F.col("omni_top")).alias("alt"), F.when(F.col("vec_id") % 9 > 0, F.col("asr_margin")).alias("base_margin"))


FAMILY = "split_part({0}, '_', 1) = split_part({1}, '_', 1)"
TOOL_SQL = HYBRID_SQL + f""", tr AS (SELECT sample_id, target, {NAME.format("asr_top")} AS base, {NAME.format("omni_top")} AS alt, CASE WHEN vec_id % 9 > 0 THEN asr_margin END AS m FROM h),
sd AS (SELECT unnest([3, 11, 29]) AS split_seed), sp AS (SELECT tr.*, split_seed, {hash_sql("'split' || split_seed", "sample_id")} / 4294967296e0 < 0.4 AS fit FROM tr, sd),
th AS (SELECT DISTINCT split_seed, round(m, 4) AS t FROM sp WHERE fit AND m IS NOT NULL UNION SELECT split_seed, unnest([0e0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.075, 0.1, 0.15, 0.2]) FROM sd),
tc AS (SELECT sp.*, mode, t, CASE WHEN mode = 'margin_low' THEN coalesce(m < t, false) ELSE {FAMILY.format("base", "alt")} AND coalesce(m < t, false) END AS use_alt FROM sp JOIN th ON sp.split_seed = th.split_seed, (SELECT unnest(['same_family_low_margin', 'margin_low']) AS mode) WHERE fit),
tb AS (SELECT split_seed, mode, t, round(avg(CAST(CASE WHEN use_alt THEN alt ELSE base END = target AS INT)), 6) AS a, count(*) FILTER (WHERE base = target AND CASE WHEN use_alt THEN alt ELSE base END <> target) AS r, round(avg(CAST(use_alt AS INT)), 6) AS u FROM tc GROUP BY ALL),
ts AS (SELECT split_seed, mode, t AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY split_seed, mode ORDER BY a DESC, r, u, t) AS nth FROM tb) WHERE nth = 1 UNION ALL SELECT split_seed, unnest(['global_candidate', 'same_family', 'changed_same_family']), 0e0 FROM sd),
lk AS (SELECT sp.*, mode, threshold, CASE mode WHEN 'global_candidate' THEN true WHEN 'same_family' THEN {FAMILY.format("base", "alt")} WHEN 'changed_same_family' THEN {FAMILY.format("base", "alt")} AND base <> alt
   WHEN 'same_family_low_margin' THEN {FAMILY.format("base", "alt")} AND coalesce(m < threshold, false) ELSE coalesce(m < threshold, false) END AS use_alt FROM sp JOIN ts ON sp.split_seed = ts.split_seed WHERE NOT fit),
ld AS (SELECT *, CASE WHEN use_alt THEN alt ELSE base END AS said, base = target AS was FROM lk),
cn AS (SELECT split_seed, mode, count(*) AS n, count(*) FILTER (WHERE said = target AND NOT was) AS fixes, count(*) FILTER (WHERE was AND said <> target) AS regressions FROM ld GROUP BY 1, 2),
{boot_sql("cn", "split_seed, mode")}, {ci_sql("split_seed, mode", "D")},
lm AS (SELECT split_seed, mode, threshold, count(*) AS n, round(avg(CAST(said = target AS INT)), 6) AS accuracy_at_1, round(avg(CAST(use_alt AS INT)), 6) AS route_rate, round(avg(CAST(said <> target AND NOT {FAMILY.format("said", "target")} AS INT)), 6) AS unsafe_wrong_tool_rate,
   round(avg(CAST(said <> target AND {FAMILY.format("said", "target")} AS INT)), 6) AS boundary_error_rate, count(*) FILTER (WHERE said = target AND NOT was) AS fixes, count(*) FILTER (WHERE was AND said <> target) AS regressions FROM ld GROUP BY 1, 2, 3),
mx AS (SELECT lm.*, round((fixes - regressions) / CAST(n AS DOUBLE), 6) AS delta, round(regressions / CAST(n AS DOUBLE), 6) AS regression_rate, ci_low, ci_high FROM lm JOIN ci ON lm.split_seed = ci.split_seed AND lm.mode = ci.mode)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.policy_matrix(materialize(tool_rows(spark, sf_dir), "tools"), list(SEEDS), 0.4, ROUNDS, 42)


@query(f"WITH {TOOL_SQL} SELECT split_seed, mode, threshold, n, accuracy_at_1, route_rate, unsafe_wrong_tool_rate, boundary_error_rate, fixes, regressions, delta, regression_rate, ci_low, ci_high FROM mx")
def tool_policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five modes at three seeds, thresholds fitted on two rows in five."""
    return matrix(spark, sf_dir)


SUMMARY = """mode, count(*) AS seed_count, count(*) FILTER (WHERE delta > 0) AS positive_delta_count, round(avg(delta), 6) AS mean_delta, min(delta) AS min_delta, round(avg(ci_low), 6) AS mean_ci_lower, round(avg(accuracy_at_1), 6) AS mean_locked_acc, round(avg(route_rate), 6) AS mean_route_rate,
  round(avg(regression_rate), 6) AS mean_regression_rate, round(avg(unsafe_wrong_tool_rate), 6) AS mean_unsafe_wrong_tool_rate, round(avg(boundary_error_rate), 6) AS mean_boundary_error_rate"""


@query(f"WITH {TOOL_SQL} SELECT {SUMMARY} FROM mx GROUP BY mode")
def tool_matrix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.matrix_summary(matrix(spark, sf_dir))


@query(f"WITH {TOOL_SQL} SELECT {SUMMARY} FROM mx WHERE mode = 'same_family' GROUP BY mode")
def tool_matrix_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.of_mode(T.matrix_summary(matrix(spark, sf_dir)), "same_family")


@query(f"""WITH {TOOL_SQL}, rw AS (SELECT split_seed, round(avg(CAST(base = target AS INT)), 6) AS a, round(avg(CAST(base <> target AND NOT {FAMILY.format("base", "target")} AS INT)), 6) AS u, round(avg(CAST(base <> target AND {FAMILY.format("base", "target")} AS INT)), 6) AS b FROM sp WHERE NOT fit GROUP BY split_seed)
SELECT 'raw' AS mode, count(*) AS seed_count, round(avg(a), 6) AS mean_locked_acc, round(avg(u), 6) AS mean_unsafe_wrong_tool_rate, round(avg(b), 6) AS mean_boundary_error_rate FROM rw""")
def tool_matrix_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw_summary(tool_rows(spark, sf_dir), list(SEEDS), 0.4)


@query(f"""WITH {TOOL_SQL}, ma AS (SELECT *, {FAMILY.format("base", "alt")} AND coalesce(m < 0.05, false) AS u FROM tr)
SELECT sample_id, target, CASE WHEN u THEN alt ELSE base END AS prediction, CASE WHEN u THEN alt ELSE base END = target AS hit_at_1, 'gate_v1' AS policy_id, 'same_family_low_margin' AS gate_mode, 0.05e0 AS gate_threshold, u AS used_candidate, base AS baseline_prediction, alt AS candidate_prediction, m AS baseline_margin FROM ma""")
def materialized_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.materialized(tool_rows(spark, sf_dir), "gate_v1", "same_family_low_margin", 0.05)


def rerank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best labels; texts repeat modulo 3, so that some lists have few texts."""
    text = lambda label: F.concat(F.lit("t"), (label % 3).cast("string"))
    item = lambda x: F.struct(x["sample_id"].alias("sample_id"), text(x["sample_id"].cast("long")).alias("text"), rounded(x["score"], 2).alias("score"))
    margin = F.round(F.get("scores", F.lit(0))["score"] - F.get("scores", F.lit(1))["score"], 6)
    rows = candidate_lists(spark, sf_dir, 5).select("vec_id", F.col("label").cast("string").alias("sample_id"), text(F.col("label")).alias("target"), margin.alias("margin"), F.transform("scores", item).alias("scores"))
    return rows.withColumn("base_hit", (F.get("scores", F.lit(0))["text"] == F.col("target")) | (F.get("scores", F.lit(0))["sample_id"] == F.col("sample_id")))


RERANK_SQL = HYBRID_SQL + """, rl AS (SELECT vec_id, label, cand, r_omni, round(s_omni, 2) AS s, s_omni, cand % 3 = label % 3 AS ok FROM lr WHERE r_omni <= 5),
rg AS (SELECT vec_id, label, count(DISTINCT cand % 3) FILTER (WHERE r_omni <= 3) AS unique_text_count, round(max(s_omni) FILTER (WHERE r_omni = 1) - max(s_omni) FILTER (WHERE r_omni = 2), 6) AS margin, max(s) FILTER (WHERE r_omni = 1) AS top,
   bool_or(ok) FILTER (WHERE r_omni = 1) AS base_hit, min(r_omni) FILTER (WHERE ok AND r_omni <= 3) AS first, list(cand ORDER BY r_omni) AS cands FROM rl GROUP BY vec_id, label),
rt AS (SELECT rg.*, (SELECT count(*) FROM rl WHERE rl.vec_id = rg.vec_id AND r_omni <= 3 AND abs(s - top) <= 1e-9) AS top_tie_count FROM rg),
rw AS (SELECT *, margin <= 0.05 AND unique_text_count >= 2 AND top_tie_count <= 2 AS wanted FROM rt),
rb AS (SELECT *, wanted AND sum(CAST(wanted AS INT)) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING) <= 60 AS rerouted FROM rw),
rr AS (SELECT vec_id, margin, unique_text_count, top_tie_count, rerouted, base_hit, cands[CASE WHEN rerouted THEN coalesce(first, 1) ELSE 1 END] AS chosen, label FROM rb),
ro AS (SELECT vec_id, margin, CAST(unique_text_count AS BIGINT) AS unique_text_count, top_tie_count, rerouted, base_hit, CAST(chosen AS VARCHAR) AS selected_sample_id, chosen % 3 = label % 3 AS hit_at_1, CASE WHEN chosen % 3 = label % 3 THEN 1 ELSE 1000000000 END AS rank FROM rr)"""


@query(f"WITH {RERANK_SQL} SELECT * FROM ro")
def reranked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 rows of a low margin, with two texts or more and two ties at most, take the first candidate that hits."""
    out = T.reranked(rerank_rows(spark, sf_dir), 3, 0.05, "oracle", min_texts=2, max_ties=2, budget=60)
    return out.select("vec_id", "margin", F.col("unique_text_count").cast("long").alias("unique_text_count"), F.col("top_tie_count").cast("long").alias("top_tie_count"), "rerouted", "base_hit", "selected_sample_id", "hit_at_1", "rank")


@query(f"""WITH {RERANK_SQL} SELECT count(*) AS sample_count, count(*) FILTER (WHERE rerouted) AS route_count, count(*) FILTER (WHERE hit_at_1 AND NOT base_hit) AS fix_count, count(*) FILTER (WHERE base_hit AND NOT hit_at_1) AS regression_count,
  round(avg(CAST(rank = 1 AS INT)), 6) AS acc_at_1, round(avg(CAST(rank <= 3 AS INT)), 6) AS recall_at_3, round(avg(CAST(rank <= 5 AS INT)), 6) AS recall_at_5 FROM ro""")
def rerank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.rerank_summary(T.reranked(rerank_rows(spark, sf_dir), 3, 0.05, "oracle", min_texts=2, max_ties=2, budget=60))


@query(f"""WITH {HYBRID_SQL}, q AS (SELECT vec_id, string_agg('  {{' || chr(10) || '    "choice": "' || substr('AB', CAST(r_omni AS INT), 1) || '",' || chr(10) || '    "candidate": "' || {NAME.format("cand")} || '",' || chr(10) || '    "retrieval_score": null' || chr(10) || '  }}', ',' || chr(10) ORDER BY r_omni) AS c FROM lr WHERE r_omni <= 2 GROUP BY vec_id)
SELECT vec_id, 'Choose the candidate that best matches the query. Candidate A is the embedding model''s current top-1. Keep A unless another candidate is clearly and directly better. If uncertain, choose A.' || chr(10) || chr(10) || 'Query:' || chr(10) || 'query ' || vec_id || chr(10) || chr(10) || 'Candidates:' || chr(10) || '[' || chr(10) || c || chr(10) || ']' || chr(10) || chr(10)
  || 'Return strict JSON only with this schema:' || chr(10) || '{{"choice":"A", "confidence":0.0, "reason":"short reason"}}' AS prompt, CASE WHEN vec_id % 4 = 1 THEN 1 ELSE 0 END AS choice, vec_id % 4 >= 2 AS fallback FROM q""")
def verifier_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a verifier is asked, and what becomes of its four kinds of answers: two good ones, a letter too far, no JSON."""
    rows = candidate_lists(spark, sf_dir, 2).select("vec_id", F.concat(F.lit("query "), F.col("vec_id").cast("string")).alias("q"), F.transform("scores", lambda x: F.struct(x["text"].alias("text"), F.lit(None).cast("double").alias("score"))).alias("scores"))
    said = F.element_at(F.array(*[F.lit(x) for x in ('{"choice": "A"}', '{"choice": " b "}', '{"choice": "C"}', "B")]), (F.col("vec_id") % 4 + 1).cast("int"))
    at, bad = T.verifier_choice(said, 2, F.col("scores"))
    return rows.select("vec_id", T.verifier_prompt("q", "scores", 2, "other", conservative=True).alias("prompt"), at.alias("choice"), bad.alias("fallback"))
