"""Reports over results, plans of steps, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics, selection
from ..plans import commands, instructions, steps
from ..streaming import resume
from ..views import HYBRID_SQL, RUNS_SQL, hybrid, runs, table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
ARMS = instructions.task_arms("rag")


LANGS_SQL = "lg AS (SELECT lang, count(*) AS docs FROM documents WHERE lang IS NOT NULL GROUP BY lang)"


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, docs): each language is a data set of its own to the plans."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))


def for_each_language(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows``, which are as few as a plan's steps, once for each language."""
    return languages(spark, sf_dir).join(F.broadcast(rows))


@query(f"""WITH {LANGS_SQL} SELECT lang, task, arms, told, docs * arms AS texts FROM lg, (VALUES ('arms', 18, 17), ('rag', 7, 6), ('tool', 7, 6), ('asr_like', 7, 6), ('dialect', 4, 3), ('translation', 6, 5)) AS v(task, arms, told)""")
def instruction_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many arms each task has, one of which says nothing, and how many texts they make of each language's documents."""
    tasks = {"arms": list(instructions.all_arms().items())} | {t: instructions.task_arms(t) for t in instructions.TASK_ARMS}
    rows = spark.createDataFrame([(t, a, said) for t, arms in tasks.items() for a, said in arms], "task string, arm string, said string")
    counted = rows.groupBy("task").agg(F.count_distinct("arm").cast("int").alias("arms"), F.count_if(F.col("said") != "").cast("int").alias("told"))
    return for_each_language(spark, sf_dir, counted).select("lang", "task", "arms", "told", (F.col("docs") * F.col("arms")).alias("texts"))


@query("""SELECT conv_id, turn, arm, opening FROM conversations JOIN (VALUES ('constructed_asr_transcript', 'Represent the spoken audio for transcript-level ASR semantic matching. Match it to the literal transcript candidate. Treat candidates as equivalent only when they express same spoken content, not merely same topic.'),
('constructed_rag_grounding', 'Represent the spoken audio for spoken question evidence retrieval. Match it to the passage or rule that directly supports the answer. Treat candidates as equivalent only when they express grounded answer support rather than surface lexical overlap.'),
('constructed_tool_intent', 'Represent the spoken audio for spoken command tool selection. Match it to the most specific executable tool or intent schema. Treat candidates as equivalent only when they express same user action and operational intent.'),
('constructed_translation', 'Represent the spoken audio for cross-lingual speech translation matching. Match it to the equivalent target-language translation candidate. Treat candidates as equivalent only when they express same cross-lingual meaning.')) AS v(arm, opening)
ON arm = (['constructed_asr_transcript', 'constructed_rag_grounding', 'constructed_tool_intent', 'constructed_translation'])[conv_id % 4 + 1] WHERE role = 'user'""")
def constructed_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's message is encoded with: the beginnings of the texts that are built from cards, dealt out by conversation."""
    end = F.instr("instruction", " Pay special attention")
    rows = instructions.arms_table(spark).where("startswith(arm, 'constructed_')")
    openings = rows.select("arm", F.left("instruction", end - 1).alias("opening"))
    names = F.array(*[F.lit(f"constructed_{x}") for x in ("asr_transcript", "rag_grounding", "tool_intent", "translation")])
    spoken = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    return spoken.select("conv_id", "turn", F.get(names, (F.col("conv_id") % 4).cast("int")).alias("arm")).join(F.broadcast(openings), "arm")  # four arms


PLANS_SQL = """a AS (SELECT 'rag' AS task, unnest(['raw', 'exact_condition_matching', 'policy_grounding', 'v2_qa_answer_boundary', 'constructed_rag_grounding', 'negation_exception_sensitive', 'dialect_robust_semantic']) AS arm
  UNION ALL SELECT 'tool', unnest(['raw', 'tool_specific_intent', 'v2_tool_action_boundary', 'constructed_tool_intent', 'exact_condition_matching', 'negation_exception_sensitive', 'dialect_robust_semantic'])
  UNION ALL SELECT 'asr_like', unnest(['raw', 'transcript_like', 'v2_asr_literal_boundary', 'constructed_asr_transcript', 'semantic_qa', 'dialect_robust_semantic', 'exact_condition_matching'])
  UNION ALL SELECT 'translation', unnest(['raw', 'translation_semantic', 'v2_translation_argument_boundary', 'constructed_translation', 'semantic_qa', 'transcript_like'])),
s AS (SELECT 'rag' AS task, unnest([1, 2, 3]) AS i, unnest(['cache_text', 'cache_omni_audio', 'evaluate_hybrid_from_cache']) AS step UNION ALL SELECT 'tool', 1, 'evaluate_tool_omni_audio' UNION ALL SELECT 'asr_like', 1, 'evaluate_asr_like_omni_selection' UNION ALL SELECT 'translation', 1, 'evaluate_translation_omni_selection'),
p AS (SELECT a.task, arm, i, step FROM a JOIN s ON a.task = s.task)"""


def plans(spark: SparkSession) -> DataFrame:
    parts = [steps.flatten(steps.build_plan(spark, t, "manifest.jsonl", "Driver docs")).withColumn("task", F.lit(t)) for t in ("rag", "tool", "asr_like", "translation")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {LANGS_SQL}, {PLANS_SQL} SELECT lang, task, arm, CAST(i AS INT) AS step_index, step FROM p, lg")
def plan_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of all plans for each language."""
    return for_each_language(spark, sf_dir, plans(spark)).select("lang", "task", "arm", "step_index", "step")


@query(f"""WITH {LANGS_SQL}, {PLANS_SQL} SELECT lang, task, arm, step, CASE WHEN step = 'cache_text' OR arm = 'raw' AND step <> 'cache_omni_audio' THEN 'skipped_existing' ELSE 'blocked' END AS status,
  'manifest not found: manifest.jsonl' || CASE WHEN step = 'evaluate_hybrid_from_cache' THEN '; not found before eval: outputs/cache_agentic_taxonomy_rag_driver_docs_' || arm || '_omni.pt' ELSE '' END AS warnings FROM p, lg""")
def plan_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the manifest is missing, and the shared text cache and the results of the first arm exist."""
    flat = plans(spark)
    there = flat.where("step = 'cache_text' OR (startswith(step, 'evaluate') AND arm = 'raw')").select(F.col("output").alias("path"))
    parts = [steps.statuses(flat.where(F.col("task") == t).drop("task"), there, execute=True).withColumn("task", F.lit(t)) for t in ("rag", "tool", "asr_like", "translation")]
    told = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return for_each_language(spark, sf_dir, told).select("lang", "task", "arm", "step", "status", "warnings")


STEP = {"manifest": "data/m.jsonl", "output": "out/x.json", "max_samples": 0, "seed": 0, "score_count": 0, "test_size": 20}


@query(f"""WITH {LANGS_SQL} SELECT lang, place, step, replace(command, 'data/m.jsonl', 'data/' || lang || '.jsonl') AS command FROM lg, (VALUES (0, 'cache_text', 'python mainline/cache_audio_memory_embeddings.py --cache-kind text --manifest data/m.jsonl --output out/x.json --text-model q3 --max-samples 0 --test-size 20 --seed 0'),
(1, 'evaluate_asr_like_omni_selection', 'python mainline/omni_embed_selection.py --manifest data/m.jsonl --output out/x.json --omni-model o --audio-query-instruction say it --candidate-count 8 --max-samples 0 --seed 0 --include-rows'),
(2, 'evaluate_translation_omni_selection', 'python ../../scripts/transcript_candidate_retrieval.py --manifest ../../data/m.jsonl --output ../../out/x.json --model /models/o --route direct_omni --query-field source_text --max-samples 0 --seed 0'),
(3, 'evaluate_tool_omni_audio', 'python mainline/audio_nlp_label_classification.py --manifest data/m.jsonl --output out/x.json --task intent --routes omni_audio --max-samples 0 --seed 0')) AS v(place, step, command)""")
def plan_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps as command lines for each language's manifest: zero is left out but for two flags, null and false are, true is
    its flag alone."""
    given = [
        STEP | {"step": "cache_text", "text_model": "q3", "query_text_source": ""}, STEP | {"step": "evaluate_asr_like_omni_selection", "omni_model": "o", "audio_instruction": "say it", "candidate_count": 8, "same_intent_negatives": 0},
        STEP | {"step": "evaluate_translation_omni_selection", "omni_model": "/models/o", "candidate_count": None}, STEP | {"step": "evaluate_tool_omni_audio", "task": "intent", "label_example_count": False},
    ]
    lines = for_each_language(spark, sf_dir, commands.commands(spark, given))
    return lines.select("lang", "place", "step", F.replace("command", F.lit("data/m.jsonl"), F.concat(F.lit("data/"), "lang", F.lit(".jsonl"))).alias("command"))


CASE_SQL = """c AS (SELECT p.policy, m.prompt_mode, 'run/x_' || p.name || '_' || m.prompt_mode || '.json' AS output, 'run/x_' || p.name || '_' || m.prompt_mode || '.backend.log' AS backend_log FROM (VALUES ('raw', 'raw'), ('v2 card', 'v2_card')) AS p(policy, name), (VALUES ('letter'), ('json')) AS m(prompt_mode))"""


@query(f"""WITH {CASE_SQL}, r AS (SELECT CASE WHEN turn % 2 = 0 THEN 'run/x_raw_letter.json' ELSE 'run/x_v2_card_json.json' END AS output, count(*) AS n, round(avg(CAST(conv_id % 3 = 0 AS INT)), 6) AS accuracy, count(*) FILTER (WHERE conv_id % 3 = 0) AS correct FROM conversations GROUP BY 1)
SELECT c.*, n, accuracy, correct FROM c LEFT JOIN r ON c.output = r.output""")
def case_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two policies under two prompts; two of the four cases have results."""
    plan = commands.cases(spark, ["raw", "v2 card"], ["letter", "json"], "run/x")
    results = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.when(F.col("turn") % 2 == 0, "run/x_raw_letter.json").otherwise("run/x_v2_card_json.json").alias("output"), (F.col("conv_id") % 3 == 0).alias("correct"))
    return commands.case_results(plan, results)


@query(f"""WITH {LANGS_SQL} SELECT lang, place, replace(line, 'run/x', 'run/' || lang) AS line FROM lg, (VALUES (0, '#!/usr/bin/env bash'), (1, 'set -euo pipefail'), (2, 'run --policy raw --mode json > run/x_raw_json.json'), (3, 'run --policy raw --mode letter > run/x_raw_letter.json')) AS v(place, line)""")
def case_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = commands.cases(spark, ["raw"], ["letter", "json"], "run/x")
    lines = commands.script(plan, lambda _: F.concat(F.lit("run --policy "), "policy", F.lit(" --mode "), "prompt_mode", F.lit(" > "), "output"))
    return for_each_language(spark, sf_dir, lines).select("lang", "place", F.replace("line", F.lit("run/x"), F.concat(F.lit("run/"), "lang")).alias("line"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, quality FROM labels l WHERE toxic = 0 AND EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)")
def resume_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done rows of the same configuration (here: not toxic) are reused."""
    return resume.reused(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "toxic", "0").select("doc_id", "quality")


@query(f"""WITH {RUNS_SQL}, m AS (SELECT candidate, round(avg(CAST(hit AS INT)), 6) AS acc_at_1, round(avg(1e0 / rank), 6) AS mrr, round(avg(CAST(rank <= 3 AS INT)), 6) AS recall_at_3 FROM runs GROUP BY candidate),
a AS (SELECT * FROM (VALUES ('asr'), ('omni'), ('rrf'), ('caption')) AS v(arm)) SELECT arm, CASE WHEN m.candidate IS NULL THEN 'missing' ELSE 'ok' END AS status, acc_at_1, mrr, recall_at_3 FROM a LEFT JOIN m ON a.arm = m.candidate""")
def taxonomy_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms left-joined to results; an arm without one is missing."""
    m = metrics.rank_metrics(runs(spark, sf_dir), "rank", ["candidate"], (3,))
    arms = spark.createDataFrame([(a,) for a in ("asr", "omni", "rrf", "caption")], "arm string")
    out = arms.join(m, F.col("arm") == F.col("candidate"), "left")
    return out.select("arm", F.when(F.col("candidate").isNull(), "missing").otherwise("ok").alias("status"), "acc_at_1", "mrr", "recall_at_3").orderBy(F.desc_nulls_last("acc_at_1"), F.desc("mrr"), F.desc("recall_at_3"), "arm")


@query(f"""WITH {RUNS_SQL}, o AS (SELECT * FROM runs WHERE candidate = 'omni'), f AS (SELECT 'fix' AS kind, sample_id, base_margin FROM o WHERE hit AND NOT base_hit ORDER BY base_margin, vec_id LIMIT 5), r AS (SELECT 'regression' AS kind, sample_id, base_margin FROM o WHERE base_hit AND NOT hit ORDER BY base_margin, vec_id LIMIT 5)
SELECT * FROM f UNION ALL SELECT * FROM r""")
def badcase_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the five fixes and five regressions of least margin."""
    o = runs(spark, sf_dir).where("candidate = 'omni'")
    few = lambda cond, kind: o.where(cond).orderBy(F.asc_nulls_last("base_margin"), "vec_id").limit(5).select(F.lit(kind).alias("kind"), "sample_id", "base_margin")
    return few("hit AND NOT base_hit", "fix").unionByName(few("base_hit AND NOT hit", "regression"))


@query("""WITH req AS (SELECT * FROM (VALUES ('core', 'en'), ('core', 'de'), ('extra', 'fr'), ('extra', 'xx'), ('none', 'yy')) AS v(claim, lang)), have AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT claim, count(*) AS required, count(have.lang) AS present, coalesce(string_agg(req.lang, ',' ORDER BY req.lang) FILTER (WHERE have.lang IS NULL), '') AS missing, CASE WHEN count(have.lang) = count(*) THEN 'covered' WHEN count(have.lang) > 0 THEN 'partial' ELSE 'absent' END AS coverage FROM req LEFT JOIN have ON req.lang = have.lang GROUP BY claim""")
def coverage_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required evidence less what there is, and the class of each claim."""
    required = spark.createDataFrame([("core", "en"), ("core", "de"), ("extra", "fr"), ("extra", "xx"), ("none", "yy")], "claim string, lang string")
    have = table(spark, sf_dir, "documents").select("lang").distinct().withColumn("has", F.lit(True))
    r = F.count(F.lit(1))
    p = F.count("has")
    missing = F.array_join(F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.col("lang")))), ",")
    return required.join(have, "lang", "left").groupBy("claim").agg(r.alias("required"), p.alias("present"), missing.alias("missing"), F.when(p == r, "covered").when(p > 0, "partial").otherwise("absent").alias("coverage"))


@query(f"""WITH {RUNS_SQL}, e AS (SELECT * FROM (VALUES ('asr', 'n', 500e0), ('omni', 'n', 1e0), ('none', 'n', 1e0)) AS v(candidate, metric, expected)), o AS (SELECT candidate, CAST(count(*) AS DOUBLE) AS observed FROM runs GROUP BY candidate)
SELECT e.candidate, expected, observed, CASE WHEN observed IS NULL THEN 'missing_source' WHEN abs(observed - expected) <= 0.0007 THEN 'pass' ELSE 'mismatch' END AS status FROM e LEFT JOIN o ON e.candidate = o.candidate""")
def evidence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected numbers held to observed ones within a tolerance."""
    expected = spark.createDataFrame([("asr", 500.0), ("omni", 1.0), ("none", 1.0)], "candidate string, expected double")
    observed = runs(spark, sf_dir).groupBy("candidate").agg(F.count(F.lit(1)).cast("double").alias("observed"))
    status = F.when(F.col("observed").isNull(), "missing_source").when(F.abs(F.col("observed") - F.col("expected")) <= 7e-4, "pass").otherwise("mismatch")
    return expected.join(observed, "candidate", "left").select("candidate", "expected", "observed", status.alias("status"))


@query(f"""WITH {RUNS_SQL}, o AS (SELECT sample_id, vec_id % 4 AS shuffle, hit, base_hit FROM runs WHERE candidate = 'omni'), d AS (SELECT shuffle, avg(CAST(hit AS INT) - CAST(base_hit AS INT)) AS delta, avg(CAST(base_hit AND NOT hit AS INT)) AS reg FROM o GROUP BY shuffle)
SELECT round(min(delta), 6) AS min_delta, round(avg(delta), 6) AS mean_delta, round(max(abs(delta)), 6) AS max_abs_delta, round(max(reg), 6) AS max_regression_rate,
 CASE WHEN round(max(abs(delta)), 6) <= 0.01 THEN 'stable' WHEN round(max(abs(delta)), 6) <= 0.03 AND round(max(reg), 6) <= 0.03 THEN 'mostly_stable' WHEN round(max(abs(delta)), 6) <= 0.1 THEN 'order_sensitive' ELSE 'unstable' END AS decision FROM d""")
def order_stability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas over four orders (here: id classes), and what they say."""
    o = runs(spark, sf_dir).where("candidate = 'omni'").groupBy((F.col("vec_id") % 4).alias("shuffle")).agg(F.avg(F.col("hit").cast("double") - F.col("base_hit").cast("double")).alias("delta"), F.avg((F.col("base_hit") & ~F.col("hit")).cast("double")).alias("reg"))
    s = o.agg(F.round(F.min("delta"), 6).alias("min_delta"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.max(F.abs("delta")), 6).alias("max_abs_delta"), F.round(F.max("reg"), 6).alias("max_regression_rate"))
    d, r = F.col("max_abs_delta"), F.col("max_regression_rate")
    return s.withColumn("decision", F.when(d <= 0.01, "stable").when((d <= 0.03) & (r <= 0.03), "mostly_stable").when(d <= 0.1, "order_sensitive").otherwise("unstable"))


@query(f"""WITH {HYBRID_SQL}, t AS (SELECT unnest([0.01e0, 0.05e0]) AS tau), o AS (SELECT tau, round(avg(CAST(CASE WHEN asr_margin <= tau THEN asr_rank <= 3 ELSE asr_rank = 1 END AS INT)), 6) AS oracle FROM h, t GROUP BY tau), r AS (SELECT 0.05e0 AS tau, round(avg(CAST(asr_rank = 1 AS INT)), 6) AS random FROM h)
SELECT o.tau, oracle, random, round(oracle - random, 6) AS gain FROM o LEFT JOIN r ON o.tau = r.tau""")
def cost_curve_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle rows left-joined with control rows by threshold."""
    h = hybrid(spark, sf_dir)
    low = F.col("asr_margin") <= F.col("tau")
    o = h.withColumn("tau", F.explode(F.array(F.lit(0.01), F.lit(0.05)))).groupBy("tau").agg(metrics.rate(F.when(low, F.col("asr_rank") <= 3).otherwise(F.col("asr_rank") == 1)).alias("oracle"))
    r = h.agg(metrics.rate(F.col("asr_rank") == 1).alias("random")).withColumn("tau", F.lit(0.05))
    return o.join(r, "tau", "left").select("tau", "oracle", "random", F.round(F.col("oracle") - F.col("random"), 6).alias("gain"))


@query(f"""WITH {RUNS_SQL}, m AS (SELECT candidate, avg(CAST(hit AS INT)) AS acc, CASE candidate WHEN 'asr' THEN 1e0 WHEN 'omni' THEN 4e0 ELSE 5e0 END AS cost FROM runs GROUP BY candidate), b AS (SELECT acc, cost FROM m WHERE candidate = 'asr'), f AS (SELECT acc, cost FROM m WHERE candidate = 'omni')
SELECT m.candidate, round(m.acc - b.acc, 6) AS delta, round((m.acc - b.acc) / nullif(f.acc - b.acc, 0), 6) AS retained_gain, round(1 - m.cost / f.cost, 6) AS cost_reduction, round((m.acc - b.acc) / nullif(m.cost - b.cost, 0), 6) AS benefit_per_cost FROM m, b, f""")
def deployability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain kept and cost saved against the full run; a division by nothing is null."""
    m = runs(spark, sf_dir).groupBy("candidate").agg(F.avg(F.col("hit").cast("double")).alias("acc")).withColumn("cost", F.when(F.col("candidate") == "asr", 1.0).when(F.col("candidate") == "omni", 4.0).otherwise(5.0))
    one = m.agg(*[F.max(F.when(F.col("candidate") == c, F.col(x))).alias(f"{c}_{x}") for c in ("asr", "omni") for x in ("acc", "cost")])
    d = F.col("acc") - F.col("asr_acc")
    return m.join(F.broadcast(one)).select("candidate", F.round(d, 6).alias("delta"), F.round(F.try_divide(d, F.col("omni_acc") - F.col("asr_acc")), 6).alias("retained_gain"), F.round(1 - F.col("cost") / F.col("omni_cost"), 6).alias("cost_reduction"), F.round(F.try_divide(d, F.col("cost") - F.col("asr_cost")), 6).alias("benefit_per_cost"))


@query(f"""WITH {RUNS_SQL}, m AS (SELECT 'selector' AS layer, candidate AS name, round(avg(CAST(hit AS INT) - CAST(base_hit AS INT)), 6) AS delta FROM runs GROUP BY candidate), s AS (SELECT 'stability', query_style, round(avg(CAST(hit AS INT) - CAST(base_hit AS INT)), 6) FROM runs WHERE candidate = 'omni' GROUP BY query_style)
SELECT layer, name, delta, delta > 0 AS accepted FROM (SELECT * FROM m UNION ALL SELECT * FROM s)""")
def effect_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two kinds in one schema."""
    d = metrics.mean(F.col("hit").cast("double") - F.col("base_hit").cast("double")).alias("delta")
    r = runs(spark, sf_dir)
    a = r.groupBy(F.col("candidate").alias("name")).agg(d).withColumn("layer", F.lit("selector"))
    b = r.where("candidate = 'omni'").groupBy(F.col("query_style").alias("name")).agg(d).withColumn("layer", F.lit("stability"))
    return a.unionByName(b).select("layer", "name", "delta", (F.col("delta") > 0).alias("accepted"))


@query(f"""WITH {RUNS_SQL}, m AS (SELECT candidate, avg(CAST(hit AS INT)) AS p, avg(CAST(rank <= 3 AS INT)) AS a, avg(CAST(split_part(prediction, '_', 1) <> split_part(target, '_', 1) AS INT)) AS u FROM runs GROUP BY candidate)
SELECT candidate, round(p + 0.1 * a - 0.2 * u, 6) AS utility, CASE WHEN candidate = 'asr' THEN 'baseline' WHEN p > (SELECT p FROM m WHERE candidate = 'asr') AND u <= (SELECT u FROM m WHERE candidate = 'asr') THEN 'accepted' ELSE 'raw_fallback' END AS decision FROM m""")
def unified_policy_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = lambda c: F.split_part(F.col(c), F.lit("_"), F.lit(1))
    a = lambda c: F.avg(c.cast("double"))
    m = runs(spark, sf_dir).groupBy("candidate").agg(a(F.col("hit")).alias("p"), a(F.col("rank") <= 3).alias("a"), a(family("prediction") != family("target")).alias("u"))
    base = m.where("candidate = 'asr'").select(F.col("p").alias("bp"), F.col("u").alias("bu"))
    decision = F.when(F.col("candidate") == "asr", "baseline").when((F.col("p") > F.col("bp")) & (F.col("u") <= F.col("bu")), "accepted").otherwise("raw_fallback")
    return m.join(F.broadcast(base)).select("candidate", F.round(F.col("p") + 0.1 * F.col("a") - 0.2 * F.col("u"), 6).alias("utility"), decision.alias("decision"))


@query(f"""WITH {HYBRID_SQL} SELECT sample_id, CASE WHEN asr_rank = 1 THEN 'correct' WHEN asr_rank <= 3 AND asr_margin < 0.02 THEN 'low_margin_near_miss' WHEN asr_rank <= 3 THEN 'near_miss' WHEN omni_rank = 1 THEN 'rescued_by_audio' ELSE 'retrieval_failure' END AS kind FROM h""")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("asr_rank")
    kind = F.when(r == 1, "correct").when((r <= 3) & (F.col("asr_margin") < 0.02), "low_margin_near_miss").when(r <= 3, "near_miss").when(F.col("omni_rank") == 1, "rescued_by_audio").otherwise("retrieval_failure")
    return hybrid(spark, sf_dir).select("sample_id", kind.alias("kind"))
