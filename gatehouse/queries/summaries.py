"""Reports over runs: the driver's rankings play runs, its conversations and documents play reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, routing
from ..operators import summaries as S
from ..views import HYBRID_SQL, hybrid, table
from .evaluation import METRICS_SQL, ROUTED_SQL
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

COND_SQL = HYBRID_SQL + """, cd AS (SELECT vec_id, query_style AS style, unnest(['no_query', 'text_only', 'audio_only', 'audio_text', 'other']) AS condition, asr_rank, omni_rank, rrf_rank FROM h),
cr AS (SELECT vec_id, style, condition, CASE condition WHEN 'no_query' THEN vec_id % 10 = 0 WHEN 'text_only' THEN asr_rank = 1 WHEN 'audio_only' THEN omni_rank = 1 WHEN 'audio_text' THEN rrf_rank = 1 ELSE true END AS ok FROM cd WHERE NOT (condition = 'audio_text' AND vec_id % 6 = 0))"""


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding under five conditions; one in six lacks the fourth."""
    parts = {"no_query": F.col("vec_id") % 10 == 0, "text_only": F.col("asr_rank") == 1, "audio_only": F.col("omni_rank") == 1, "audio_text": F.col("rrf_rank") == 1, "other": F.lit(True)}
    rows = F.array(*[F.struct(F.lit(k).alias("condition"), v.alias("task_success")) for k, v in parts.items()])
    return hybrid(spark, sf_dir).select("sample_id", "vec_id", F.col("query_style").alias("dataset"), F.inline(rows)).where("NOT (condition = 'audio_text' AND vec_id % 6 = 0)")


@query(f"""WITH {COND_SQL}, s AS (SELECT style, condition, round(avg(CAST(ok AS INT)), 6) AS task_success FROM cr GROUP BY 1, 2)
SELECT style AS dataset, CAST(list_position(['text_only', 'audio_only', 'audio_text'], condition) AS BIGINT) AS place, style || ' ' || condition AS task, 'query_audio_rescue' AS policy_type, task_success, CASE WHEN condition = 'audio_text' THEN 'corrupted text dominates if fused blindly' ELSE 'wrong memory' END AS failure_mode_after_policy FROM s WHERE condition IN ('text_only', 'audio_only', 'audio_text')""")
def stress_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stress(conditions(spark, sf_dir).groupBy("dataset", "condition").agg(metrics.rate(F.col("task_success")).alias("task_success")))


@query(f"""WITH {COND_SQL}, p AS (SELECT a.style, a.condition || '_vs_' || b.condition AS contrast, CAST(a.ok AS INT) AS n1, CAST(b.ok AS INT) AS n0 FROM cr a JOIN cr b ON a.vec_id = b.vec_id WHERE (a.condition, b.condition) IN (('audio_only', 'text_only'), ('audio_text', 'text_only'), ('audio_text', 'audio_only')))
SELECT style AS dataset, contrast, count(*) AS n, round(avg(n1), 6) AS success, round(avg(n0), 6) AS base_success, round(avg(n1 - n0), 6) AS delta, count(*) FILTER (WHERE n1 > n0) AS fixes, count(*) FILTER (WHERE n1 < n0) AS regressions FROM p GROUP BY 1, 2""")
def rescue_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rescue(conditions(spark, sf_dir), ["dataset"])


@query("""WITH t AS (SELECT length(text) AS a, length(text) // 3 AS b FROM documents), o AS (SELECT list_sort(list(a)) AS a, list_sort(list(b)) AS b, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(CAST(a > 2000 AS INT)) AS oa, avg(CAST(b > 2000 AS INT)) AS ob FROM t)
SELECT n, round(ma, 6) AS original_mean_prompt_tokens, a[n] AS original_max_prompt_tokens, a[CAST(floor(n * 0.95) AS BIGINT) + 1] AS original_p95_prompt_tokens, round(oa, 6) AS original_overflow_rate, round(mb, 6) AS packed_mean_prompt_tokens, b[n] AS packed_max_prompt_tokens,
  b[CAST(floor(n * 0.95) AS BIGINT) + 1] AS packed_p95_prompt_tokens, round(ob, 6) AS packed_overflow_rate, round(round(ma, 6) - round(mb, 6), 6) AS mean_token_reduction, round(round(ob, 6) - round(oa, 6), 6) AS overflow_rate_delta, 2000 AS context_token_budget FROM o""")
def packing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and a third of each, as prompts before and after packing."""
    d = table(spark, sf_dir, "documents").select(F.length("text").cast("long").alias("tokens"))
    return S.packing(d, d.select(F.floor(F.col("tokens") / 3).alias("tokens")), "tokens", 2000)


RUNS_SQL = """r AS (SELECT role, avg(length(text)) AS latency, avg(CAST(turn % 2 = 0 AS INT)) AS success FROM conversations GROUP BY role)"""


@query(f"""WITH {RUNS_SQL}, v AS (SELECT role, round(latency, 6) AS latency, round(success, 6) AS success FROM r), b AS (SELECT * FROM v WHERE role = 'user')
SELECT v.role, round(v.success - b.success, 6) AS success_delta, round(v.latency - b.latency, 6) AS latency_delta, round(v.latency / b.latency, 6) AS latency_ratio FROM v, b WHERE v.role <> 'user'""")
def run_cost_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as runs, held against the users'."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    runs = c.groupBy("role").agg(metrics.mean(F.length("text").cast("double")).alias("latency"), metrics.rate(F.col("turn") % 2 == 0).alias("success"))
    return S.cost_deltas(runs, [], "role", "user", ("success", "latency"), "latency")


@query(f"""WITH {ROUTED_SQL}, mt AS (SELECT query_style, policy, {METRICS_SQL}, round(avg(CAST(routed AS INT)), 6) AS route_rate FROM pr GROUP BY 1, 2)
SELECT query_style, max(acc_at_1) FILTER (WHERE policy = 'asr_primary') AS asr_primary_acc_at_1, max(mrr) FILTER (WHERE policy = 'asr_primary') AS asr_primary_mrr, max(route_rate) FILTER (WHERE policy = 'asr_primary') AS asr_primary_route_rate,
  max(acc_at_1) FILTER (WHERE policy = 'dialect_aware_branch') AS dialect_aware_branch_acc_at_1, max(mrr) FILTER (WHERE policy = 'dialect_aware_branch') AS dialect_aware_branch_mrr, max(route_rate) FILTER (WHERE policy = 'dialect_aware_branch') AS dialect_aware_branch_route_rate,
  max(acc_at_1) FILTER (WHERE policy = 'rrf') AS rrf_acc_at_1, max(mrr) FILTER (WHERE policy = 'rrf') AS rrf_mrr, max(route_rate) FILTER (WHERE policy = 'rrf') AS rrf_route_rate FROM mt GROUP BY query_style""")
def dialect_route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaderboard by style as one wide row a style."""
    rows = routing.routed(hybrid(spark, sf_dir))
    board = rows.groupBy("query_style", "policy").agg(*metrics.rank_aggregates("rank"), metrics.rate(F.col("routed")).alias("route_rate"))
    return S.policy_table(board, ["query_style"], ("asr_primary", "dialect_aware_branch", "rrf"), ("acc_at_1", "mrr", "route_rate"))


LOCK_SQL = HYBRID_SQL + """, lo AS (SELECT query_style, unnest(['asr', 'omni', 'rrf']) AS candidate, asr_rank, unnest([asr_rank, omni_rank, rrf_rank]) AS rank FROM h),
lb AS (SELECT query_style, candidate, round(avg(CAST(rank = 1 AS INT)), 6) AS acc_at_1, round(avg(CAST(rank = 1 AS INT) - CAST(asr_rank = 1 AS INT)), 6) AS hit_delta, count(*) FILTER (WHERE asr_rank = 1 AND rank <> 1) AS regression_count FROM lo GROUP BY 1, 2)"""


def locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(f"{n}_rank").alias("rank")) for n in ("asr", "omni", "rrf")])
    rows = hybrid(spark, sf_dir).select("query_style", "asr_rank", F.inline(named))
    hit, base = F.col("rank") == 1, F.col("asr_rank") == 1
    return rows.groupBy("query_style", "candidate").agg(metrics.rate(hit).alias("acc_at_1"), metrics.mean(hit.cast("double") - base.cast("double")).alias("hit_delta"), F.count_if(base & ~hit).alias("regression_count"))


@query(f"""WITH {LOCK_SQL} SELECT query_style, max(acc_at_1) FILTER (WHERE candidate = 'asr') AS raw_acc_at_1, count(*) FILTER (WHERE candidate <> 'asr') AS alternative_count, max(hit_delta) FILTER (WHERE candidate <> 'asr') AS max_instruction_delta, CAST(sum(regression_count) FILTER (WHERE candidate <> 'asr') AS BIGINT) AS alternative_regressions FROM lb GROUP BY 1""")
def readiness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.readiness(locked(spark, sf_dir), ["query_style"], "asr")


@query(f"""WITH {LOCK_SQL} SELECT query_style, candidate AS policy, acc_at_1, hit_delta AS delta, regression_count, 'low_margin_verifier' AS component, 'route_rate' AS cost_type, CASE WHEN candidate = 'asr' THEN 0e0 ELSE 0.5e0 END AS cost_value, CASE WHEN candidate <> 'asr' THEN round(hit_delta / 0.5e0, 6) END AS benefit_per_cost,
  CASE WHEN regression_count <= 6 AND hit_delta > 0 THEN 'accepted' ELSE 'reject' END AS decision, CASE WHEN candidate = 'asr' THEN 0e0 ELSE 0.5e0 END AS route_rate FROM lb""")
def verifier_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = locked(spark, sf_dir).withColumnsRenamed({"candidate": "policy", "hit_delta": "delta"})
    return S.verifier_budget(rows.withColumn("route_rate", F.when(F.col("policy") == "asr", 0.0).otherwise(0.5)))


@query(f"""WITH {LOCK_SQL}, d AS (SELECT CASE WHEN hit_delta > 0 THEN 'accepted' ELSE 'fallback' END AS decision, hit_delta AS d, regression_count / 1e1 AS a, CASE WHEN candidate <> 'rrf' THEN acc_at_1 END AS r FROM lb)
SELECT count(*) AS dataset_count, count(*) FILTER (WHERE decision = 'accepted') AS accepted_count, count(*) FILTER (WHERE decision <> 'accepted') AS fallback_count, round(avg(d), 6) AS mean_selected_delta_vs_text, round(avg(a), 6) AS mean_selected_audio_cost, round(avg(coalesce(r, 0)), 6) AS mean_audio_cost_reduction_rate FROM d""")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = locked(spark, sf_dir).select(
        F.when(F.col("hit_delta") > 0, "accepted").otherwise("fallback").alias("decision"), F.col("hit_delta").alias("selected_delta_vs_text"), (F.col("regression_count") / 10).alias("selected_audio_cost"),
        F.when(F.col("candidate") != "rrf", F.col("acc_at_1")).alias("audio_cost_reduction_rate"),
    )
    return S.decisions(rows)


@query(f"""WITH {LOCK_SQL}, s AS (SELECT row_number() OVER (ORDER BY query_style, candidate) AS place, query_style || '/' || candidate || '_run' AS label, acc_at_1 FROM lb) SELECT place, label, acc_at_1 FROM s WHERE contains(label, 'rrf') AND contains(label, 'run') ORDER BY place LIMIT 1""")
def labelled_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first summary whose label has all tokens."""
    from pyspark.sql import Window

    rows = locked(spark, sf_dir).select(F.row_number().over(Window.orderBy("query_style", "candidate")).cast("long").alias("place"), F.concat("query_style", F.lit("/"), "candidate", F.lit("_run")).alias("label"), "acc_at_1")  # a dozen rows
    return S.labelled(rows, ("rrf", "run"))


@query(f"""WITH {LOCK_SQL}, m AS (SELECT query_style, candidate, unnest(['run.acc_at_1', 'run.hit_delta', 'run.regression_count']) AS metric, unnest([acc_at_1, hit_delta, CAST(regression_count AS DOUBLE)]) AS value FROM lb) SELECT * FROM m""")
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.long_metrics(locked(spark, sf_dir), ["query_style", "candidate"], "run.")


@query(f"""WITH {LOCK_SQL} SELECT 'alternatives' AS section, query_style AS name, acc_at_1 AS value, CAST(NULL AS BIGINT) AS n FROM lb WHERE candidate = 'omni' UNION ALL SELECT 'styles', query_style, NULL, count(*) FROM h GROUP BY query_style""")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports of different columns as one table."""
    one = locked(spark, sf_dir).where("candidate = 'omni'").select(F.col("query_style").alias("name"), F.col("acc_at_1").alias("value"))
    two = hybrid(spark, sf_dir).groupBy(F.col("query_style").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return S.sections({"alternatives": one, "styles": two}).select("section", "name", "value", "n")


@query("""WITH d AS (SELECT doc_id, doc_id % 3 AS k, (doc_id % 100) / 1e2 AS x FROM documents)
SELECT doc_id, (['rag', 'tool', 'asr_like'])[k + 1] AS task, doc_id AS n, x AS acc_at_1, x + 0.125 AS recall_at_3, CASE WHEN k = 1 THEN 0e0 ELSE x + 0.25 END AS recall_at_5, x / 2 AS mrr, 3.5e0 AS mean_rank, CAST(2 AS INT) AS rows FROM d""")
def result_document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of three tasks as JSON; the second task lacks its recall at 5."""
    v, x = F.col("doc_id"), F.col("doc_id") % 100 / 100
    names = {"rag": ("text_accuracy", "text_recall_at_3", "text_recall_at_5", "text_mrr", "text_mean_rank"), "tool": ("accuracy_at_1", "accuracy_at_3", None, "mrr", "mean_rank")}
    names["asr_like"] = names["rag"]
    values = (x, x + 0.125, x + 0.25, x / 2, F.lit(3.5))
    block = lambda t: F.struct(*[c.alias(n) for n, c in zip(names[t], values, strict=True) if n])
    rows = F.array(F.struct(F.lit("a").alias("sample_id")), F.struct(F.lit("b").alias("sample_id"))).alias("rows")
    inner = {"rag": F.struct(v.alias("n"), block("rag").alias("omni"), rows), "tool": F.struct(v.alias("n"), block("tool").alias("metrics"), rows), "asr_like": F.struct(v.alias("n"), block("asr_like").alias("text"), rows)}
    place = {"rag": "test", "tool": "omni_audio", "asr_like": "test"}
    d = table(spark, sf_dir, "documents").select("doc_id", *[F.to_json(F.struct(F.struct(inner[t].alias(place[t])).alias("metrics"))).alias(t) for t in names])
    parts = []
    for k, t in enumerate(names):
        got = S.result_metrics(t, t)
        one = d.where(v % 3 == k).select("doc_id", F.lit(t).alias("task"), *[F.round(c, 6).alias(n) if n != "n" else c.alias(n) for n, c in got.items()], F.size(S.task_rows(t, t, "struct<sample_id:string>")).alias("rows"))
        parts.append(one)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT place, n, name FROM (SELECT doc_id AS place, doc_id % 40 AS n, lang AS name FROM documents) WHERE n >= 37 ORDER BY place LIMIT 1""")
def first_complete_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return S.first_complete(d.select(F.col("doc_id").alias("place"), (F.col("doc_id") % 40).alias("n"), F.col("lang").alias("name")), 37)


PACK_SQL = HYBRID_SQL + """, b AS (SELECT sample_id, vec_id, asr_rank = 1 AS ok, vec_id % 11 = 0 AS bad, vec_id % 13 = 0 AS over FROM h), p AS (SELECT sample_id, omni_rank = 1 AS ok, vec_id % 17 = 0 AS bad, omni_rank > 2 AS wrong FROM h),
bp AS (SELECT b.sample_id, b.ok AS b_ok, p.ok AS p_ok, b.bad OR b.over AS b_over, p.bad, p.wrong FROM b JOIN p ON b.sample_id = p.sample_id)"""


def two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The head view as the run before packing, the full view as the one after."""
    h = hybrid(spark, sf_dir)
    v = F.col("vec_id")
    base = h.select("sample_id", (F.col("asr_rank") == 1).alias("task_success"), (v % 11 == 0).alias("invalid_output"), F.lit(False).alias("wrong_memory"), F.concat(F.lit("b"), F.col("asr_top").cast("string")).alias("prediction"), F.when(v % 13 == 0, "request exceeds the available context size").otherwise("A").alias("model_output"))
    new = h.select("sample_id", (F.col("omni_rank") == 1).alias("task_success"), (v % 17 == 0).alias("invalid_output"), (F.col("omni_rank") > 2).alias("wrong_memory"), F.concat(F.lit("p"), F.col("omni_top").cast("string")).alias("prediction"), F.lit("B").alias("model_output"))
    return base, new


@query(f"""WITH {PACK_SQL} SELECT * FROM (SELECT sample_id, 'fix' AS case_type, b_over AS base_invalid_or_overflow FROM bp WHERE p_ok AND NOT b_ok ORDER BY b_over DESC, sample_id LIMIT 12) UNION ALL SELECT * FROM (SELECT sample_id, 'regression', b_over FROM bp WHERE b_ok AND NOT p_ok ORDER BY sample_id LIMIT 8)""")
def packing_case_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.packing_cases(*two_runs(spark, sf_dir), "sample_id", 12, 8).select("sample_id", "case_type", "base_invalid_or_overflow")


@query(f"WITH {PACK_SQL} SELECT count(*) AS compared, count(*) FILTER (WHERE p_ok AND NOT b_ok) AS fixes, count(*) FILTER (WHERE b_ok AND NOT p_ok) AS regressions, count(*) FILTER (WHERE NOT p_ok) AS remaining_failures FROM bp")
def packing_case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.packing_counts(*two_runs(spark, sf_dir), "sample_id")


@query(f"""WITH {PACK_SQL} SELECT sample_id, CASE WHEN bad THEN 'packed_invalid_output' WHEN wrong THEN 'packed_wrong_memory' WHEN b_ok THEN 'packing_regression' ELSE 'packed_other_failure' END AS case_type, b_ok AS original_success FROM bp WHERE NOT p_ok ORDER BY sample_id LIMIT 40""")
def failure_case_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.failure_cases(*two_runs(spark, sf_dir), "sample_id", 40).select("sample_id", "case_type", "original_success")


GATE_SQL = HYBRID_SQL + """, g AS (SELECT query_style AS dataset, sample_id, unnest(['audio_on_invalid', 'audio_on_overlap']) AS gate, omni_rank = 1 AND asr_rank > 1 AS rescue, asr_rank = 1 AND omni_rank > 1 AS regression, (['invalid', 'text_equals_noquery', 'overlap>=0.8', 'first_candidate'])[vec_id % 4 + 1] AS reason FROM h)"""


@query(f"""WITH {GATE_SQL} SELECT dataset, gate AS selected_gate, sample_id, CASE WHEN regression THEN 'audio_gate_regression' WHEN contains(reason, 'text_equals') THEN 'text_hint_uninformative' WHEN contains(reason, 'overlap') THEN 'text_candidate_overlap_trigger' WHEN contains(reason, 'first') THEN 'position_sensitive_trigger' ELSE 'gate_case' END AS case_type, rescue, regression
FROM g WHERE (rescue OR regression) AND ((dataset = 'clean' AND gate = 'audio_on_invalid') OR (dataset = 'wu' AND gate = 'audio_on_overlap')) ORDER BY dataset, sample_id LIMIT 30""")
def gate_case_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, hit, base = F.col("vec_id"), F.col("omni_rank") == 1, F.col("asr_rank") == 1
    reason = F.element_at(F.array(*[F.lit(x) for x in ("invalid", "text_equals_noquery", "overlap>=0.8", "first_candidate")]), (v % 4 + 1).cast("int"))
    gates = F.explode(F.array(F.lit("audio_on_invalid"), F.lit("audio_on_overlap")))
    rows = hybrid(spark, sf_dir).select(F.col("query_style").alias("dataset"), "sample_id", gates.alias("gate"), (hit & ~base).alias("rescue"), (base & ~hit).alias("regression"), reason.alias("reason"))
    selected = spark.createDataFrame([("clean", "audio_on_invalid"), ("wu", "audio_on_overlap")], "dataset string, gate string")
    return S.gate_cases(rows, selected, 30)


@query(f"""WITH {HYBRID_SQL}, v AS (SELECT sample_id, asr_rank = 1 AS base_hit, omni_rank = 1 AS hit, CASE WHEN vec_id % 4 = 0 THEN '' ELSE 'said ' || asr_top END AS base, 'want ' || label AS target, CASE vec_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'my Homework ' || omni_top ELSE 'said ' || omni_top END AS selected FROM h)
SELECT * FROM (SELECT sample_id, CASE WHEN selected <> '' AND contains(selected, 'Homework') THEN 'semantic_neighbor_translation' WHEN selected <> '' THEN 'translation_style_or_boundary_conflict' WHEN base <> '' THEN 'base_wrong_verifier_failed_to_rescue' ELSE 'verifier_regression' END AS case_type FROM v WHERE base_hit AND NOT hit ORDER BY sample_id LIMIT 25)
UNION ALL SELECT * FROM (SELECT sample_id, 'low_margin_fix' FROM v WHERE NOT base_hit AND hit ORDER BY sample_id LIMIT 25)""")
def verifier_case_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    said = lambda c: F.concat(F.lit("said "), F.col(c).cast("string"))
    selected = F.when(v % 3 == 0, "").when(v % 3 == 1, F.concat(F.lit("my Homework "), F.col("omni_top").cast("string"))).otherwise(said("omni_top"))
    rows = hybrid(spark, sf_dir).select(
        "sample_id", (F.col("asr_rank") == 1).alias("base_hit"), (F.col("omni_rank") == 1).alias("hit_at_1"), F.when(v % 4 == 0, "").otherwise(said("asr_top")).alias("base_prediction"), F.concat(F.lit("want "), F.col("label").cast("string")).alias("target"), selected.alias("selected")
    )
    return S.verifier_cases(rows, 25).select("sample_id", "case_type")


VOTE_SQL = HYBRID_SQL + ", vp AS (SELECT unnest([0, 1, 2]) AS place, unnest(['" + "', '".join(S.VOTE_POLICIES) + """']) AS policy),
vr AS (SELECT query_style AS dataset, place, policy, label, asr_top AS generic, rrf_top AS vote, CASE place WHEN 0 THEN true WHEN 1 THEN rrf_top = omni_top ELSE rrf_top = omni_top OR asr_top <> omni_top END AS taken FROM h, vp),
vs AS (SELECT dataset, place, policy, round(avg(CAST(taken AS INT)), 6) AS route_rate, round(avg(CAST(CASE WHEN taken THEN vote ELSE generic END = label AS INT) - CAST(generic = label AS INT)), 6) AS delta, count(*) FILTER (WHERE generic = label AND CASE WHEN taken THEN vote ELSE generic END <> label) AS regressions FROM vr GROUP BY 1, 2, 3)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head view as the generic run, the fusion as the vote, and the full view's first label as the original's."""
    named = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(p).alias("policy")) for k, p in enumerate(S.VOTE_POLICIES)])
    h = hybrid(spark, sf_dir).select(F.col("query_style").alias("dataset"), "label", "asr_top", "rrf_top", "omni_top", F.inline(named))
    at = lambda c: F.when(F.col(c) == F.col("omni_top"), 1).otherwise(999)
    said, taken = S.vote_choice(F.col("policy"), F.col("asr_top"), F.col("rrf_top"), at("asr_top"), at("rrf_top"))
    ok, base = said == F.col("label"), F.col("asr_top") == F.col("label")
    return h.groupBy("dataset", "place", "policy").agg(metrics.rate(taken).alias("route_rate"), metrics.mean(ok.cast("double") - base.cast("double")).alias("delta"), F.count_if(base & ~ok).alias("regressions"))


@query(f"WITH {VOTE_SQL} SELECT * FROM vs")
def vote_policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir)


@query(f"WITH {VOTE_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY regressions <= 3 DESC, delta DESC, place) AS nth FROM vs) SELECT dataset, policy, regressions <= 3 AS accepted FROM b WHERE nth = 1")
def vote_best_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_policy(votes(spark, sf_dir), ["dataset"], F.col("regressions") <= 3, "delta")


@query("WITH b AS (SELECT doc_id % 50 AS query_id, max(doc_id) AS score FROM documents WHERE doc_id % 50 > 0 GROUP BY 1) SELECT CAST(query_id AS VARCHAR) AS query_id, score FROM b")
def keyed_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key; blank keys are left out."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 50 > 0, (F.col("doc_id") % 50).cast("string")).otherwise("").alias("query_id"), F.col("doc_id").alias("score"))
    return S.keyed_baseline(d, d).unionByName(S.keyed_baseline(None, d))
