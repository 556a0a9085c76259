"""Routing, resampling, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates, metrics, resample, routing, sampling, selection
from ..views import HYBRID_SQL, RUNS_SQL, hybrid, runs
from .registry import hash_sql, registry

QUERIES, ORACLE_SQL, query = registry()
#: Rounds of most bootstraps, of routing boards and splits, and of gates and policies that are fitted.
ROUNDS, BOARD_ROUNDS, FIT_ROUNDS, SEED = 5000, 10_000, 2000, 42


def tree_sql(name: str, kinds: str, by: str, depth: int, rounds: int, seed: str) -> str:
    """CTE ``name`` (by, round, j, x): how often each kind is drawn, from ``kinds`` (by, j from 0, w), up to 2 ** depth of them.

    Level by level a node's draws are split between its halves: the least count whose binomial distribution function,
    tabled here by logarithms of the gamma function, exceeds a word of the MD5 of seed:round:node / 4."""
    out = [
        f"{name}_k AS (SELECT {by}, j, w, CASE WHEN max(j) OVER (PARTITION BY {by}) = 0 THEN 0 ELSE length(bin(max(j) OVER (PARTITION BY {by}))) END AS d FROM {kinds})",
        f"{name}_s0 AS (SELECT {by}, d, r.round, CAST(1 AS BIGINT) AS node, CAST(sum(w) AS BIGINT) AS m FROM {name}_k, range({rounds}) AS r(round) GROUP BY {by}, d, r.round)",
    ]
    for level in range(depth):
        n = f"{name}_{level}"
        out += [
            f"{n}w AS (SELECT {by}, {1 << level} + (j >> (d - {level})) AS node, CAST(sum(w) AS BIGINT) AS b, CAST(sum(CASE WHEN (j >> (d - {level + 1})) & 1 = 0 THEN w ELSE 0 END) AS BIGINT) AS a FROM {name}_k WHERE d > {level} GROUP BY ALL)",
            f"{n}q AS (SELECT *, (CAST('0x' || substr(md5({seed} || ':' || CAST(round AS VARCHAR) || ':' || CAST(node // 4 AS VARCHAR)), CAST(1 + 8 * (node % 4) AS INT), 8) AS BIGINT) + 0.5e0) / 4294967296e0 AS u FROM {name}_s{level} JOIN {n}w USING ({by}, node) WHERE b > 0)",
            f"{n}p AS (SELECT m, a, b, i, exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + i * ln(CAST(a AS DOUBLE) / b) + (m - i) * ln(1 - CAST(a AS DOUBLE) / b)) AS mass FROM (SELECT *, unnest(range(m + 1)) AS i FROM (SELECT DISTINCT m, a, b FROM {n}q WHERE a > 0 AND a < b)))",
            f"{n}c AS (SELECT m, a, b, i, sum(mass) OVER (PARTITION BY m, a, b ORDER BY i) AS c FROM {n}p)",
            f"{n}x AS (SELECT q.*, CASE WHEN q.a = 0 THEN 0 WHEN q.a = q.b THEN q.m ELSE least(q.m, coalesce(t.i + 1, 0)) END AS x FROM {n}q AS q ASOF LEFT JOIN {n}c AS t ON q.m = t.m AND q.a = t.a AND q.b = t.b AND q.u >= t.c)",
            f"{name}_s{level + 1} AS (SELECT {by}, d, round, 2 * node AS node, x AS m FROM {n}x WHERE x > 0 UNION ALL SELECT {by}, d, round, 2 * node + 1, m - x FROM {n}x WHERE m > x UNION ALL SELECT {by}, d, round, node, m FROM {name}_s{level} WHERE d <= {level})",
        ]
    return ",\n".join([*out, f"{name} AS (SELECT {by}, round, node - (1 << d) AS j, m AS x FROM {name}_s{depth})"])


def boot_sql(counts: str, by: str, rounds: int = ROUNDS, seed: str = f"'{SEED}'") -> str:
    """CTE boots (by, round, value): the draws of ``counts`` (by, n, fixes, regressions)."""
    return f"""
bk AS (SELECT {by}, unnest([0, 1, 2]) AS j, unnest([fixes, regressions, n - fixes - regressions]) AS w FROM {counts} WHERE n > 0),
{tree_sql("bt", "bk", by, 2, rounds, seed)},
boots AS (SELECT {by}, round, sum(CASE j WHEN 0 THEN x WHEN 1 THEN -x ELSE 0 END) / CAST(any_value(n) AS DOUBLE) AS value FROM bt JOIN {counts} USING ({by}) GROUP BY {by}, round)"""


def ci_sql(by: str, convention: str, rounds: int = ROUNDS) -> str:
    low, high = (f(rounds) for f in resample.CONVENTIONS[convention])
    return f"ci AS (SELECT {by}, round((list_sort(list(value)))[{low + 1}], 6) AS ci_low, round((list_sort(list(value)))[{high + 1}], 6) AS ci_high FROM boots GROUP BY {by})"


COUNTS_SQL = "SELECT candidate, count(*) AS n, count(*) FILTER (WHERE hit AND NOT base_hit) AS fixes, count(*) FILTER (WHERE base_hit AND NOT hit) AS regressions FROM runs GROUP BY candidate"
METRICS_SQL = """count(*) AS n, round(avg(CAST(rank = 1 AS INT)), 6) AS acc_at_1, round(avg(CAST(rank <= 3 AS INT)), 6) AS recall_at_3, round(avg(CAST(rank <= 5 AS INT)), 6) AS recall_at_5,
    round(avg(CAST(rank <= 10 AS INT)), 6) AS recall_at_10, round(avg(1e0 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank"""

ROUTED_SQL = HYBRID_SQL + """,
pol AS (SELECT unnest(['asr_confidence_branch', 'asr_primary', 'dialect_aware_branch', 'disagreement_rerank', 'omni_primary', 'rrf']) AS policy),
st AS (SELECT *, lower(coalesce(nullif(tts_dialect, ''), query_style, '')) AS style FROM h),
rt AS (SELECT *, CASE policy WHEN 'disagreement_rerank' THEN disagreement WHEN 'asr_confidence_branch' THEN coalesce(confidence < 0.6, false)
          WHEN 'dialect_aware_branch' THEN (style <> '' AND style NOT IN ('mandarin', 'noisy_mandarin', 'clean', 'standard', 'unknown')) OR coalesce(confidence < 0.6, false) OR coalesce(asr_wer >= 0.6, false)
          ELSE false END AS routed FROM st, pol),
pr AS (SELECT *, asr_rank = 1 AS asr_hit, CASE policy WHEN 'omni_primary' THEN omni_rank WHEN 'rrf' THEN rrf_rank WHEN 'disagreement_rerank' THEN CASE WHEN routed THEN rrf_rank ELSE asr_rank END
          WHEN 'asr_primary' THEN asr_rank ELSE CASE WHEN routed THEN omni_rank ELSE asr_rank END END AS rank,
          CASE policy WHEN 'omni_primary' THEN 'omni' WHEN 'rrf' THEN 'rrf' WHEN 'disagreement_rerank' THEN CASE WHEN routed THEN 'fallback_rrf' ELSE 'asr' END
          WHEN 'asr_primary' THEN 'asr' ELSE CASE WHEN routed THEN 'omni' ELSE 'asr' END END AS source FROM rt)"""


@query(f"WITH {HYBRID_SQL} SELECT sample_id, target, asr_rank, omni_rank, rrf_rank, best_of_two_rank, asr_margin, omni_margin, disagreement, confidence, asr_wer, query_style, tts_dialect FROM h")
def hybrid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("sample_id", "target", "asr_rank", "omni_rank", "rrf_rank", "best_of_two_rank", "asr_margin", "omni_margin", "disagreement", "confidence", "asr_wer", "query_style", "tts_dialect")


@query(f"WITH {ROUTED_SQL} SELECT sample_id, policy, routed, source, rank, rank = 1 AS hit, asr_hit FROM pr")
def route_policy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routed(hybrid(spark, sf_dir)).select("sample_id", "policy", "routed", "source", "rank", "hit", "asr_hit")


@query(f"""WITH {ROUTED_SQL},
cn AS (SELECT policy, count(*) AS n, count(*) FILTER (WHERE rank = 1 AND NOT asr_hit) AS fixes, count(*) FILTER (WHERE asr_hit AND rank <> 1) AS regressions FROM pr GROUP BY policy),
{boot_sql("cn", "policy", BOARD_ROUNDS)}, {ci_sql("policy", "A", BOARD_ROUNDS)},
mt AS (SELECT policy, {METRICS_SQL}, round(avg(CAST(routed AS INT)), 6) AS route_rate,
         CASE WHEN policy = 'disagreement_rerank' THEN round(avg(CAST(routed AS INT)), 6) ELSE 0e0 END AS api_call_rate,
         count(*) FILTER (WHERE rank = 1 AND NOT asr_hit) AS rescue_count,
         round(coalesce(count(*) FILTER (WHERE rank = 1 AND NOT asr_hit) / nullif(CAST(count(*) FILTER (WHERE NOT asr_hit) AS DOUBLE), 0), 0), 6) AS rescue_rate,
         count(*) FILTER (WHERE asr_hit AND rank <> 1) AS regression_count, round(avg(CAST(asr_hit AND rank <> 1 AS INT)), 6) AS regression_rate FROM pr GROUP BY policy)
SELECT mt.*, round((fixes - regressions) / CAST(cn.n AS DOUBLE), 6) AS delta_vs_asr, ci_low AS lcb_vs_asr, ci_high AS ucb_vs_asr FROM mt JOIN cn ON mt.policy = cn.policy JOIN ci ON mt.policy = ci.policy""")
def route_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.leaderboard(routing.routed(hybrid(spark, sf_dir)), BOARD_ROUNDS, SEED)


@query(f"WITH {RUNS_SQL} SELECT candidate, {METRICS_SQL} FROM runs GROUP BY candidate")
def rank_metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_metrics(runs(spark, sf_dir), "rank", ["candidate"])


@query(f"WITH {RUNS_SQL} SELECT candidate, query_style, {METRICS_SQL} FROM runs GROUP BY candidate, query_style")
def rank_metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_metrics(runs(spark, sf_dir), "rank", ["candidate", "query_style"])


def bootstrap(spark: SparkSession, sf_dir: str, convention: str) -> DataFrame:
    counts = resample.paired_counts(runs(spark, sf_dir), ["candidate"], F.col("base_hit"), F.col("hit"))
    return resample.paired_bootstrap(counts, ["candidate"], ROUNDS, SEED, convention)


def bootstrap_oracle(convention: str) -> str:
    ci = ci_sql("candidate", convention) if convention != "E" else "ci AS (SELECT candidate, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high FROM boots GROUP BY candidate)"
    return f"""WITH {RUNS_SQL}, cn AS ({COUNTS_SQL}), {boot_sql("cn", "candidate")}, {ci}
SELECT cn.candidate, n, fixes, regressions, round((fixes - regressions) / CAST(n AS DOUBLE), 6) AS delta, round(regressions / CAST(n AS DOUBLE), 6) AS regression_rate, ci_low, ci_high FROM cn JOIN ci ON cn.candidate = ci.candidate"""


for _c in "ABCDE":
    QUERIES[f"paired_bootstrap_{_c}"] = lambda spark, sf_dir, c=_c: bootstrap(spark, sf_dir, c)
    ORACLE_SQL[f"paired_bootstrap_{_c}"] = bootstrap_oracle(_c)


_LOW, _HIGH = (f(ROUNDS) + 1 for f in resample.CONVENTIONS["C"])


@query(f"""WITH {RUNS_SQL}, r AS (SELECT candidate, asr_rank, rank, count(*) AS w, any_value(CAST(hit AS INT) - CAST(base_hit AS INT)) AS hd, any_value(1e0 / rank - 1e0 / asr_rank) AS md FROM runs GROUP BY 1, 2, 3),
kd AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY asr_rank, rank) - 1 AS j FROM r), kk AS (SELECT candidate, j, w FROM kd),
{tree_sql("kt", "kk", "candidate", 7, ROUNDS, f"'{SEED}'")},
b AS (SELECT candidate, round, sum(x * hd) / CAST(sum(x) AS DOUBLE) AS h, round(sum(x * md) / sum(x), 9) AS m FROM kt JOIN kd USING (candidate, j) GROUP BY 1, 2),
c AS (SELECT candidate, round(list_sort(list(h))[{_LOW}], 6) AS hit_low, round(list_sort(list(h))[{_HIGH}], 6) AS hit_high, round(list_sort(list(m))[{_LOW}], 6) AS mrr_low, round(list_sort(list(m))[{_HIGH}], 6) AS mrr_high FROM b GROUP BY 1),
o AS (SELECT candidate, CAST(sum(w) AS BIGINT) AS n, round(sum(w * hd) / CAST(sum(w) AS DOUBLE), 6) AS hit_delta, round(sum(w * md) / sum(w), 6) AS mrr_delta FROM kd GROUP BY candidate)
SELECT * FROM o JOIN c USING (candidate)""")
def shared_draw_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and reciprocal ranks against the head view, by the same draws."""
    return resample.paired_ranks(runs(spark, sf_dir), ["candidate"], "asr_rank", "rank", ROUNDS, SEED)


#: Orders in which candidates are shown; the view's prediction changes with the order for some rows.
SHOWN = ("base", "shuffle_seed7", "shuffle_seed17", "shuffle_seed29")
ORDER_SQL = HYBRID_SQL + ", so AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(SHOWN)) + ") AS v(k, shown)), po AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in gates.ORDER_POLICIES) + f"""]) AS policy),
oa AS (SELECT label, shown, omni_top AS top, CASE WHEN (vec_id + k) % 5 > 0 THEN asr_top ELSE rrf_top END AS gen, CASE WHEN (vec_id * 3 + k) % 4 > 0 THEN rrf_top ELSE omni_top END AS trans FROM h, so),
ob AS (SELECT *, CASE policy WHEN '{gates.ORDER_POLICIES[0]}' THEN true WHEN '{gates.ORDER_POLICIES[2]}' THEN trans = top OR gen <> top ELSE trans = top END AS taken FROM oa, po),
oc AS (SELECT *, gen = label AS base_ok, CASE WHEN taken THEN trans WHEN policy = '{gates.ORDER_POLICIES[3]}' THEN top ELSE gen END = label AS ok FROM ob),
cn AS (SELECT policy, shown, count(*) AS n, count(*) FILTER (WHERE ok AND NOT base_ok) AS fixes, count(*) FILTER (WHERE base_ok AND NOT ok) AS regressions, round(avg(CAST(taken AS INT)), 6) AS route_rate FROM oc GROUP BY 1, 2),
{boot_sql("cn", "policy, shown")}, {ci_sql("policy, shown", "D")},
oj AS (SELECT cn.*, round((fixes - regressions) / CAST(n AS DOUBLE), 6) AS delta, round(regressions / CAST(n AS DOUBLE), 6) AS rr, ci_low FROM cn JOIN ci ON cn.policy = ci.policy AND cn.shown = ci.shown),
oq AS (SELECT *, delta > 0 AND rr <= 0.03 AND ci_low > 0 AS strict, delta > 0 AND rr <= 0.03 AND ci_low >= 0 AS weak, shown <> 'base' AS shuffled FROM oj),
os AS (SELECT policy, count(*) AS order_count, count(*) FILTER (WHERE shuffled) AS shuffle_count, round(avg(delta), 8) AS mean_delta, min(delta) AS min_delta, round(avg(delta) FILTER (WHERE shuffled), 8) AS shuffle_mean_delta, min(delta) FILTER (WHERE shuffled) AS shuffle_min_delta,
  count(*) FILTER (WHERE strict) AS strict_accept_count, count(*) FILTER (WHERE weak) AS weak_accept_count, count(*) FILTER (WHERE strict AND shuffled) AS shuffle_strict_accept_count, count(*) FILTER (WHERE weak AND shuffled) AS shuffle_weak_accept_count,
  max(rr) AS max_regression_rate, CAST(sum(fixes) AS BIGINT) AS total_fixes, CAST(sum(regressions) AS BIGINT) AS total_regressions, round(avg(route_rate), 8) AS mean_route_rate FROM oq GROUP BY policy)"""


@query(f"""WITH {ORDER_SQL} SELECT *, CASE WHEN shuffle_strict_accept_count = shuffle_count THEN 'strict_order_robust_accept' WHEN shuffle_weak_accept_count = shuffle_count THEN 'weak_order_robust_accept' WHEN min_delta > 0 AND max_regression_rate <= 0.03 THEN 'partial_order_repair' ELSE 'diagnostic_only' END AS decision FROM os""")
def order_gate_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a policy that distrusts the order of candidates hold in every order?"""
    orders = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("shown")) for k, s in enumerate(SHOWN)]))
    h = hybrid(spark, sf_dir).select("vec_id", "label", "asr_top", "omni_top", "rrf_top", orders)
    v, k = F.col("vec_id"), F.col("k")
    generic, translation = F.when((v + k) % 5 > 0, F.col("asr_top")).otherwise(F.col("rrf_top")), F.when((v * 3 + k) % 4 > 0, F.col("rrf_top")).otherwise(F.col("omni_top"))
    rows = h.select("label", "shown", F.col("omni_top").alias("top"), generic.alias("generic"), translation.alias("translation"), F.explode(F.array(*[F.lit(p) for p in gates.ORDER_POLICIES])).alias("policy"))
    chosen, taken = gates.order_choice(F.col("policy"), F.col("generic"), F.col("translation"), F.col("top"))
    rows = rows.select("policy", "shown", taken.alias("taken"), (F.col("generic") == F.col("label")).alias("base_ok"), (chosen == F.col("label")).alias("ok"))
    by = ["policy", "shown"]
    ci = resample.paired_bootstrap(resample.paired_counts(rows, by, F.col("base_ok"), F.col("ok")), by, ROUNDS, SEED, "D")
    return gates.order_robustness(ci.join(rows.groupBy(*by).agg(metrics.rate(F.col("taken")).alias("route_rate")), by))


@query(f"""WITH {RUNS_SQL}, g AS (SELECT target AS g, count(*) AS n, sum(CAST(hit AS INT) - CAST(base_hit AS INT)) AS s FROM runs WHERE candidate = 'omni' GROUP BY target),
a AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS j FROM g), ka AS (SELECT 'all' AS one, j, 1 AS w FROM a),
{tree_sql("kt", "ka", "one", 4, ROUNDS, f"'{SEED}'")},
b AS (SELECT round, sum(x * s) / CAST(sum(x * n) AS DOUBLE) AS value FROM kt JOIN a USING (j) GROUP BY round)
SELECT CAST((SELECT sum(n) FROM g) AS BIGINT) AS n, (SELECT count(*) FROM g) AS groups, round((SELECT sum(s) / CAST(sum(n) AS DOUBLE) FROM g), 6) AS delta,
       round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high FROM b""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).where("candidate = 'omni'").withColumn("d", F.col("hit").cast("double") - F.col("base_hit").cast("double"))
    return resample.cluster_bootstrap(r, "target", "d", ROUNDS, SEED)


PVALUE_SQL = f"""WITH {RUNS_SQL}, cn AS (SELECT query_style || ':' || candidate AS name, count(*) AS n, count(*) FILTER (WHERE hit AND NOT base_hit) AS fixes, count(*) FILTER (WHERE base_hit AND NOT hit) AS regressions
    FROM runs WHERE candidate <> 'asr' GROUP BY query_style, candidate), {boot_sql("cn", "name")}"""


def contrasts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(counts, boots) of each candidate against the baseline in each style."""
    r = runs(spark, sf_dir).where("candidate != 'asr'").withColumn("name", F.concat("query_style", F.lit(":"), "candidate"))
    counts = resample.paired_counts(r, ["name"], F.col("base_hit"), F.col("hit"))
    return counts, resample.drawn(counts, ["name"], ROUNDS, SEED)


@query(PVALUE_SQL + f""", p AS (SELECT name, round((least(count(*) FILTER (WHERE value <= 0), count(*) FILTER (WHERE value >= 0)) * 2 + 1) / CAST({ROUNDS} + 1 AS DOUBLE), 6) AS p FROM boots GROUP BY name),
s AS (SELECT *, least(1e0, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS stepped FROM p)
SELECT name, p, round(max(stepped) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s""")
def holm_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, boots = contrasts(spark, sf_dir)
    p = boots.groupBy("name").agg(F.round((F.least(F.count_if(F.col("value") <= 0), F.count_if(F.col("value") >= 0)) * 2 + 1) / (ROUNDS + 1), 6).alias("p"))
    return resample.holm(p, "name", "p")


@query(PVALUE_SQL + """, sd AS (SELECT name, stddev_samp(value) AS sd, avg(value) AS mid FROM boots GROUP BY name),
z AS (SELECT round, round(max(abs((value - mid) / nullif(sd, 0))), 9) AS top FROM boots JOIN sd ON boots.name = sd.name GROUP BY round),
o AS (SELECT cn.name, round(abs(round((fixes - regressions) / CAST(n AS DOUBLE), 6) / nullif(sd, 0)), 9) AS z FROM cn JOIN sd ON cn.name = sd.name)
SELECT name, round(((SELECT count(*) FROM z WHERE top >= o.z) + 1) / CAST((SELECT count(top) FROM z) + 1 AS DOUBLE), 6) AS p_maxt FROM o""")
def maxt_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, boots = contrasts(spark, sf_dir)
    return resample.max_t(boots, counts.select("name", "delta"), "name")


@query(PVALUE_SQL + """, ci AS (SELECT name, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high FROM boots GROUP BY name)
SELECT name, ci_low, ci_high, CASE WHEN ci_low > 0 THEN 'positive' WHEN ci_high < 0 THEN 'negative' WHEN ci_low > -0.05 AND ci_high < 0.05 THEN 'equivalent' ELSE 'inconclusive' END AS verdict FROM ci""")
def tost_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, _ = contrasts(spark, sf_dir)
    out = resample.paired_bootstrap(counts, ["name"], ROUNDS, SEED, "E")
    return out.select("name", "ci_low", "ci_high", resample.verdict(F.col("ci_low"), F.col("ci_high"), 0.05).alias("verdict"))


@query(f"""WITH {RUNS_SQL}, f AS (SELECT candidate, {hash_sql("'7'", "target")} % 5 AS fold, avg(CAST(hit AS INT)) AS acc FROM runs GROUP BY candidate, fold),
s AS (SELECT candidate, count(acc) AS n, avg(acc) AS m, stddev_samp(acc) AS sd FROM f GROUP BY candidate)
SELECT candidate, n, round(m, 6) AS mean, round(m - t * sd / sqrt(n), 6) AS ci_low, round(m + t * sd / sqrt(n), 6) AS ci_high
FROM (SELECT *, CASE n - 1 WHEN 1 THEN 12.706204736432095e0 WHEN 2 THEN 4.302652729911275e0 WHEN 3 THEN 3.182446305284263e0 WHEN 4 THEN 2.776445105197799e0 END AS t FROM s)""")
def across_seed_t_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = runs(spark, sf_dir).withColumn("fold", sampling.group_fold(F.col("target"), 5, 7)).groupBy("candidate", "fold").agg(F.avg(F.col("hit").cast("double")).alias("acc"))
    return resample.t_interval(folds, ["candidate"], "acc")


@query(f"""WITH {RUNS_SQL}, g AS (SELECT candidate, coalesce(nullif(query_style, ''), 'all') AS g, round(avg(CAST(hit AS INT) - CAST(base_hit AS INT)), 6) AS d FROM runs GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY d, g) AS nth, count(*) OVER (PARTITION BY candidate) AS group_count FROM g)
SELECT candidate, g AS worst_group, d AS worst_group_delta, group_count FROM r WHERE nth = 1""")
def worst_group_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).withColumn("d", F.col("hit").cast("double") - F.col("base_hit").cast("double"))
    return metrics.worst_group(r, ["candidate"], "query_style", "d")


RULES = routing.offline_policies()
RULES_SQL = HYBRID_SQL + ", pol AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{k}', {'CAST(NULL AS DOUBLE)' if t is None else f'{t}e0'}, '{a}', '{b}')" for i, (n, k, t, a, b) in enumerate(RULES)) + f""") AS v(place, policy_id, kind, t, a, b)),
sp AS (SELECT sample_id, (row_number() OVER (ORDER BY hs, sample_id) - 1) AS nth, count(*) OVER () AS n FROM (SELECT sample_id, {hash_sql("'42'", "sample_id")} AS hs FROM h)),
ac AS (SELECT h.*, pol.*, CASE WHEN nth < floor(sp.n * 0.2) THEN 'proposal' WHEN nth < floor(sp.n * 0.2) + floor(sp.n * 0.3) THEN 'selection' ELSE 'locked_test' END AS split,
    CASE WHEN coalesce(CASE kind WHEN 'constant' THEN true WHEN 'if_disagreement' THEN disagreement WHEN 'if_confidence_below' THEN confidence < t WHEN 'if_asr_margin_below' THEN asr_margin < t ELSE omni_margin >= t END, false) THEN a ELSE b END AS action
    FROM h, pol JOIN sp ON sp.sample_id = h.sample_id),
rw AS (SELECT *, CASE action WHEN 'omni' THEN omni_rank WHEN 'rrf' THEN rrf_rank ELSE asr_rank END AS rank FROM ac),
ru AS (SELECT *, rank = 1 AS hit, asr_rank = 1 AND rank <> 1 AS regression, CAST(rank = 1 AS INT) + 0.1e0 / rank - 0.5e0 * CAST(asr_rank = 1 AND rank <> 1 AS INT) AS reward FROM rw),
cnt AS (SELECT split, policy_id, place, action, count(*) AS c FROM ru GROUP BY ALL),
ent AS (SELECT split, policy_id, round(sum(-p * ln(p + 1e-12)), 6) + 0e0 AS policy_entropy FROM (SELECT split, policy_id, c / CAST(sum(c) OVER (PARTITION BY split, policy_id) AS DOUBLE) AS p FROM cnt) GROUP BY split, policy_id),
rm AS (SELECT split, policy_id, place, count(*) AS n, round(avg(reward), 6) AS reward, round(avg(CAST(hit AS INT)), 6) AS acc_at_1, round(avg(1e0 / rank), 6) AS mrr, count(*) FILTER (WHERE regression) AS regression_count, round(avg(CAST(action <> 'asr' AS INT)), 6) AS route_rate FROM ru GROUP BY split, policy_id, place)"""


def split_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = sampling.placed(hybrid(spark, sf_dir), "sample_id", SEED)
    h = h.withColumn("split", sampling.three_way(F.col("nth"), F.col("n"), 0.2, 0.3))
    return routing.rule_metrics(routing.under_rules(h, RULES), ["split", "policy_id", "place"])


@query(f"WITH {RULES_SQL} SELECT rm.split, rm.policy_id, CAST(rm.place AS INT) AS place, n, reward, acc_at_1, mrr, regression_count, route_rate, policy_entropy FROM rm JOIN ent ON rm.split = ent.split AND rm.policy_id = ent.policy_id")
def policy_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rules(spark, sf_dir)


@query(f"""WITH {RULES_SQL}, top AS (SELECT policy_id FROM rm WHERE split = 'selection' ORDER BY reward DESC, acc_at_1 DESC, place LIMIT 1)
SELECT rm.policy_id, n, reward, acc_at_1, mrr, regression_count, route_rate, round(acc_at_1 - (SELECT acc_at_1 FROM rm WHERE split = 'locked_test' AND policy_id = 'constant_asr'), 6) AS delta
FROM rm JOIN top ON rm.policy_id = top.policy_id WHERE rm.split = 'locked_test'""")
def offline_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule with the best reward on selection, reported on the locked test."""
    board = split_rules(spark, sf_dir)
    top = board.where("split = 'selection'").orderBy(F.desc("reward"), F.desc("acc_at_1"), "place").limit(1).select("policy_id")
    locked = board.where("split = 'locked_test'")
    base = locked.where("policy_id = 'constant_asr'").select(F.col("acc_at_1").alias("b"))
    out = locked.join(F.broadcast(top), "policy_id").join(F.broadcast(base))
    return out.select("policy_id", "n", "reward", "acc_at_1", "mrr", "regression_count", "route_rate", F.round(F.col("acc_at_1") - F.col("b"), 6).alias("delta"))


SPLIT_SQL = RUNS_SQL + f""", ids AS (SELECT DISTINCT sample_id FROM runs),
pl0 AS (SELECT sample_id, row_number() OVER (ORDER BY {hash_sql("'42'", "sample_id")}, sample_id) - 1 AS nth, count(*) OVER () AS n FROM ids),
sp AS (SELECT sample_id, CASE WHEN nth < greatest(1, floor(n * 0.2)) THEN 'proposal' WHEN nth < greatest(1, floor(n * 0.2)) + greatest(1, floor(n * 0.3)) THEN 'selection' ELSE 'locked_test' END AS split FROM pl0),
sr AS (SELECT runs.*, split FROM runs JOIN sp ON runs.sample_id = sp.sample_id),
bd AS (SELECT split, candidate, pos, count(*) AS n, round(avg(CAST(rank = 1 AS INT)), 6) AS acc_at_1, round(avg(CAST(rank <= 3 AS INT)), 6) AS recall_at_3, round(avg(CAST(rank <= 5 AS INT)), 6) AS recall_at_5,
       round(avg(1e0 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank FROM sr GROUP BY split, candidate, pos),
lb AS (SELECT *, round(acc_at_1 + 0.1 * recall_at_3 + 0.1 * mrr, 6) AS reward FROM bd)"""


@query(f"WITH {SPLIT_SQL} SELECT split, count(*) AS n FROM sp GROUP BY split")
def hash_split_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return selection.split(r, SEED, least=1).select("sample_id", "split").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SPLIT_SQL}, top AS (SELECT candidate FROM lb WHERE split = 'selection' ORDER BY reward DESC, acc_at_1 DESC, mrr DESC, recall_at_3 DESC, pos LIMIT 1)
SELECT split, candidate, n, acc_at_1, recall_at_3, recall_at_5, mrr, mean_rank, reward, candidate = (SELECT candidate FROM top) AS selected FROM lb""")
def strict_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaderboards of the three splits; ``selected`` marks the winner on selection."""
    board = selection.leaderboard(selection.split(runs(spark, sf_dir), SEED, least=1), ["split", "candidate", "pos"])
    top = board.where("split = 'selection'").orderBy(F.desc("reward"), F.desc("acc_at_1"), F.desc("mrr"), F.desc("recall_at_3"), "pos").limit(1).select(F.col("candidate").alias("top"))
    return board.join(F.broadcast(top)).withColumn("selected", F.col("candidate") == F.col("top")).drop("top", "pos")


SEEDS = (11, 12, 13, 14)
SELECTOR_SQL = RUNS_SQL + ", sd AS (SELECT unnest([" + ", ".join(map(str, SEEDS)) + f"""]) AS seed), ids AS (SELECT DISTINCT seed, sample_id FROM runs, sd),
pl0 AS (SELECT seed, sample_id, row_number() OVER (PARTITION BY seed ORDER BY {hash_sql("CAST(seed AS VARCHAR)", "sample_id")}, sample_id) - 1 AS nth, count(*) OVER (PARTITION BY seed) AS n FROM ids),
sp AS (SELECT seed, sample_id, CASE WHEN nth < floor(n * 0.2) THEN 'proposal' WHEN nth < floor(n * 0.2) + floor(n * 0.3) THEN 'selection' ELSE 'locked_test' END AS split FROM pl0),
sr AS (SELECT runs.*, seed, split FROM runs JOIN sp ON runs.sample_id = sp.sample_id),
k AS (SELECT seed, split, candidate, pos, count(*) AS n, round(avg(CAST(rank = 1 AS INT)), 6) AS acc_at_1, round(avg(CAST(rank <= 3 AS INT)), 6) AS recall_at_3, round(avg(1e0 / rank), 6) AS mrr,
   count(*) FILTER (WHERE hit AND NOT base_hit) AS fixes, count(*) FILTER (WHERE base_hit AND NOT hit) AS regressions,
   round(coalesce(count(*) FILTER (WHERE NOT hit AND base_hit AND base_margin >= 0.05) / nullif(CAST(count(*) FILTER (WHERE base_hit AND base_margin >= 0.05) AS DOUBLE), 0), 0), 6) AS prot FROM sr GROUP BY seed, split, candidate, pos),
kk AS (SELECT *, round(acc_at_1 + 0.1 * recall_at_3 + 0.1 * mrr, 6) AS reward, round((fixes - regressions) / CAST(n AS DOUBLE), 6) AS hit_delta, round(regressions / CAST(n AS DOUBLE), 6) AS reg, seed || ':' || split || ':' || candidate AS id FROM k),
{boot_sql("kk", "id")}, {ci_sql("id", "C")},
wg AS (SELECT seed, split, candidate, min(d) AS worst FROM (SELECT seed, split, candidate, coalesce(nullif(query_style, ''), 'all') AS g, round(avg(CAST(hit AS INT) - CAST(base_hit AS INT)), 6) AS d FROM sr GROUP BY ALL) GROUP BY seed, split, candidate),
ev AS (SELECT kk.*, coalesce(ci_low, 0) AS lcb, worst, concat_ws(',', CASE WHEN hit_delta <= 0 THEN 'mean_delta_not_positive' END, CASE WHEN coalesce(ci_low, 0) <= 0 THEN 'bootstrap_lcb_not_positive' END,
   CASE WHEN reg > 0.03 THEN 'regression_rate_too_high' END, CASE WHEN prot > 0 THEN 'protected_regression_rate_too_high' END, CASE WHEN worst < -0.05 THEN 'worst_group_delta_too_low' END) AS why,
   reg <= 0.03 AND prot <= 0 AND worst >= -0.05 AS fine FROM kk LEFT JOIN ci ON kk.id = ci.id JOIN wg ON kk.seed = wg.seed AND kk.split = wg.split AND kk.candidate = wg.candidate),
es AS (SELECT *, CASE WHEN candidate = 'asr' THEN '' ELSE why END AS reasons, CASE WHEN candidate = 'asr' THEN 'baseline' WHEN why = '' THEN 'accepted' WHEN hit_delta > 0 AND fine THEN 'underpowered_positive' WHEN hit_delta < 0 OR NOT fine THEN 'harmful_rejected' ELSE 'raw_fallback' END AS status FROM ev),
tk AS (SELECT seed, candidate FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY reward DESC, hit_delta DESC, mrr DESC, pos) AS nth FROM es WHERE split = 'selection' AND candidate <> 'asr' AND status = 'accepted') WHERE nth = 1),
dg AS (SELECT seed, candidate, status FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY CASE status WHEN 'underpowered_positive' THEN 3 WHEN 'harmful_rejected' THEN 2 WHEN 'raw_fallback' THEN 1 ELSE 0 END DESC, hit_delta DESC, mrr DESC, reward DESC, pos) AS nth FROM es WHERE split = 'selection' AND candidate <> 'asr') WHERE nth = 1),
de AS (SELECT sd.seed, coalesce(tk.candidate, 'asr') AS selected, dg.candidate AS diagnostic, dg.status AS diagnostic_status FROM sd LEFT JOIN tk ON sd.seed = tk.seed LEFT JOIN dg ON sd.seed = dg.seed),
dc AS (SELECT de.*, es.status IN ('accepted', 'baseline') AS locked_accepted, es.hit_delta AS locked_hit_delta, es.lcb AS locked_hit_lcb, es.reg AS locked_regression_rate,
   CASE WHEN selected <> 'asr' THEN CASE WHEN es.status = 'accepted' THEN 'accepted' ELSE 'selected_not_validated' END WHEN diagnostic_status IN ('underpowered_positive', 'harmful_rejected') THEN diagnostic_status ELSE 'raw_fallback' END AS decision
   FROM de JOIN es ON es.seed = de.seed AND es.split = 'locked_test' AND es.candidate = de.selected)"""


def selector_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    ids = selection.common_ids(r).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS]))).withColumn("_k", F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("sample_id")))
    from ..functions.ranking import portable_hash
    from pyspark.sql import Window

    w = Window.partitionBy("seed")
    placed = ids.withColumn("_h", portable_hash(F.col("seed"), F.col("sample_id"))).withColumns({"nth": F.row_number().over(w.orderBy("_h", "sample_id")).cast("long") - 1, "n": F.count(F.lit(1)).over(w)})
    split = placed.select("seed", "sample_id", sampling.three_way(F.col("nth"), F.col("n"), 0.2, 0.3).alias("split"))
    return selection.evaluated(r.join(split, "sample_id"), "asr", ["seed", "split"], "query_style", ROUNDS, SEED, 0.05)


@query(f"WITH {SELECTOR_SQL} SELECT seed, split, candidate, n, acc_at_1, recall_at_3, mrr, reward, hit_delta, lcb AS hit_lcb, reg AS regression_rate, prot AS protected_regression_rate, worst AS worst_group_delta, reasons AS reject_reasons, status AS candidate_status FROM es")
def task_level_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selector_board(spark, sf_dir).select("seed", "split", "candidate", "n", "acc_at_1", "recall_at_3", "mrr", "reward", "hit_delta", "hit_lcb", "regression_rate", "protected_regression_rate", "worst_group_delta", "reject_reasons", "candidate_status")


@query(f"WITH {SELECTOR_SQL} SELECT seed, selected, diagnostic, diagnostic_status, locked_accepted, locked_hit_delta, locked_hit_lcb, locked_regression_rate, decision FROM dc")
def selector_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.decision(selector_board(spark, sf_dir), "asr", ["seed"]).select("seed", "selected", "diagnostic", "diagnostic_status", "locked_accepted", "locked_hit_delta", "locked_hit_lcb", "locked_regression_rate", "decision")


@query(f"""WITH {SELECTOR_SQL}, s AS (SELECT selected AS name, count(*) AS selected_count, (SELECT count(*) FROM dc) AS total_runs, round(avg(CAST(locked_accepted AS INT)), 6) AS locked_pass_rate, round(avg(locked_hit_delta), 6) AS mean_locked_delta,
   round(avg(locked_hit_lcb), 6) AS mean_locked_lcb, round(avg(locked_regression_rate), 6) AS mean_locked_regression_rate FROM dc GROUP BY selected),
t AS (SELECT *, round(selected_count / CAST(total_runs AS DOUBLE), 6) AS selection_rate FROM s),
u AS (SELECT *, concat_ws(',', CASE WHEN selection_rate < 0.6 THEN 'selection_rate_too_low' END, CASE WHEN locked_pass_rate < 0.6 THEN 'locked_pass_rate_too_low' END, CASE WHEN mean_locked_delta <= 0 THEN 'mean_locked_delta_not_positive' END, CASE WHEN mean_locked_regression_rate > 0.03 THEN 'mean_regression_rate_too_high' END) AS reject_reasons FROM t)
SELECT *, reject_reasons = '' AS accepted FROM u""")
def selector_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stability(selection.decision(selector_board(spark, sf_dir), "asr", ["seed"]))


ACCEPT_SQL = RUNS_SQL + f""", cn AS ({COUNTS_SQL}), {boot_sql("cn", "candidate")}, {ci_sql("candidate", "B")},
m AS (SELECT candidate, round(avg(CAST(rank = 1 AS INT)), 6) AS acc_at_1, round(avg(CAST(rank <= 3 AS INT)), 6) AS recall_at_3, round(avg(1e0 / rank), 6) AS mrr,
      round(avg(CAST(prediction <> target AND split_part(prediction, '_', 1) <> split_part(target, '_', 1) AS INT)), 6) AS unsafe_rate FROM runs GROUP BY candidate),
b AS (SELECT m.*, round(regressions / CAST(n AS DOUBLE), 6) AS regression_rate, ci_low FROM m JOIN cn ON m.candidate = cn.candidate JOIN ci ON m.candidate = ci.candidate),
a AS (SELECT * FROM b WHERE candidate = 'asr')"""


def accept_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    family = lambda c: F.split_part(F.col(c), F.lit("_"), F.lit(1))
    board = r.groupBy("candidate").agg(*metrics.rank_aggregates("rank", (3,)), metrics.rate((F.col("prediction") != F.col("target")) & (family("prediction") != family("target"))).alias("unsafe_rate"))
    ci = resample.paired_bootstrap(resample.paired_counts(r, ["candidate"], F.col("base_hit"), F.col("hit")), ["candidate"], ROUNDS, SEED, "B")
    return board.join(ci.select("candidate", "regression_rate", "ci_low"), "candidate")


@query(f"""WITH {ACCEPT_SQL}, d AS (SELECT b.candidate, round(b.acc_at_1 - a.acc_at_1, 6) AS primary_delta, round(b.recall_at_3 - a.recall_at_3, 6) AS recall_delta,
   round(b.acc_at_1 + 0.1 * b.recall_at_3 + 0.1 * b.mrr - (a.acc_at_1 + 0.1 * a.recall_at_3 + 0.1 * a.mrr), 6) AS utility_delta, b.ci_low, b.regression_rate FROM b, a WHERE b.candidate <> 'asr'),
r AS (SELECT *, concat_ws(',', CASE WHEN primary_delta <= 0 THEN 'primary_metric_not_improved' END, CASE WHEN utility_delta <= 0 THEN 'utility_not_improved' END, CASE WHEN recall_delta < 0 THEN 'recall_regression' END, CASE WHEN ci_low <= 0 THEN 'paired_ci_lower_bound_not_positive' END, CASE WHEN regression_rate > 0.03 THEN 'paired_regression_rate_too_high' END) AS reject_reasons FROM d)
SELECT *, reject_reasons = '' AS accepted FROM r""")
def accept_gate_asr_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.accept_asr_like(accept_board(spark, sf_dir), "asr").select("candidate", "primary_delta", "recall_delta", "utility_delta", "ci_low", "regression_rate", "reject_reasons", "accepted")


@query(f"""WITH {ACCEPT_SQL}, d AS (SELECT b.candidate, round(b.acc_at_1 - a.acc_at_1, 6) AS primary_delta, round(b.recall_at_3 - a.recall_at_3 + 0.5 * (b.mrr - a.mrr), 6) AS quality_delta,
   round(b.unsafe_rate - a.unsafe_rate, 6) AS unsafe_delta, b.regression_rate FROM b, a WHERE b.candidate <> 'asr'),
r AS (SELECT *, concat_ws(',', CASE WHEN primary_delta < 0 THEN 'primary_metric_regression' END, CASE WHEN quality_delta <= 0 THEN 'candidate_quality_not_improved' END, CASE WHEN unsafe_delta > 0 THEN 'unsafe_wrong_tool_increased' END, CASE WHEN regression_rate > 0.03 THEN 'paired_regression_rate_too_high' END) AS reject_reasons FROM d)
SELECT *, reject_reasons = '' AS accepted FROM r""")
def accept_gate_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.accept_tool(accept_board(spark, sf_dir), "asr").select("candidate", "primary_delta", "quality_delta", "unsafe_delta", "regression_rate", "reject_reasons", "accepted")


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {hash_sql("'5'", "CAST(doc_id AS VARCHAR)")}, doc_id) AS nth FROM documents)
SELECT doc_id, lang FROM p WHERE nth <= 20""")
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 20 documents of each language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return sampling.balanced(docs, "doc_id", "lang", 20, 5)


@query(f"""SELECT {hash_sql("'9'", "source")} % 4 AS fold, count(*) AS n, count(DISTINCT source) AS groups FROM documents GROUP BY 1""")
def group_split_no_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy(sampling.group_fold(F.col("source"), 4, 9).cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("groups"))


@query(f"""WITH {ACCEPT_SQL}, d AS (SELECT b.*, round(b.acc_at_1 - a.acc_at_1, 6) AS primary_delta, round(b.recall_at_3 - a.recall_at_3, 6) AS recall_delta, round(b.acc_at_1 + 0.1 * b.recall_at_3 + 0.1 * b.mrr - (a.acc_at_1 + 0.1 * a.recall_at_3 + 0.1 * a.mrr), 6) AS utility_delta,
   round(b.recall_at_3 - a.recall_at_3 + 0.5 * (b.mrr - a.mrr), 6) AS quality_delta, round(b.unsafe_rate - a.unsafe_rate, 6) AS unsafe_delta FROM b, a WHERE b.candidate <> 'asr'),
r AS (SELECT 'asr_like' AS family, candidate, primary_delta, regression_rate, concat_ws(',', CASE WHEN primary_delta <= 0 THEN 'primary_metric_not_improved' END, CASE WHEN utility_delta <= 0 THEN 'utility_not_improved' END, CASE WHEN recall_delta < 0 THEN 'recall_regression' END, CASE WHEN ci_low <= 0 THEN 'paired_ci_lower_bound_not_positive' END, CASE WHEN regression_rate > 0.03 THEN 'paired_regression_rate_too_high' END) AS reject_reasons FROM d
   UNION ALL SELECT 'tool', candidate, primary_delta, regression_rate, concat_ws(',', CASE WHEN primary_delta < 0 THEN 'primary_metric_regression' END, CASE WHEN quality_delta <= 0 THEN 'candidate_quality_not_improved' END, CASE WHEN unsafe_delta > 0 THEN 'unsafe_wrong_tool_increased' END, CASE WHEN regression_rate > 0.03 THEN 'paired_regression_rate_too_high' END) FROM d)
SELECT *, reject_reasons = '' AS accepted FROM r""")
def accept_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family's gate over the same board."""
    board = accept_board(spark, sf_dir)
    return selection.accept("asr_like", board, "asr").unionByName(selection.accept("tool", board, "asr"))
