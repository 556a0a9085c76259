"""Candidate memories and answers over the driver's rankings: a query is an embedding, its candidates are labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answering as A
from ..operators import memory as M
from ..operators import rag as R
from ..views import HYBRID_SQL, candidate_lists, hybrid, label_name, label_ranks
from .registry import hash_sql, registry

QUERIES, ORACLE_SQL, query = registry()
NAME = "(['alarm', 'email', 'music', 'play'])[{0} % 4 + 1] || '_' || {0}"


def own(label: Column) -> Column:
    return F.concat(F.col("vec_id").cast("string"), F.lit(":"), label.cast("string"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's view of every label as a manifest row; some lack a clip or a domain."""
    c = F.col("cand")
    return label_ranks(spark, sf_dir).select(
        own(c).alias("sample_id"), label_name(c).alias("answer"), F.lit("labels").alias("dataset"), F.when(c % 3 > 0, F.concat(F.lit("clips/"), c.cast("string"))).alias("audio_path"),
        F.when(c % 5 > 0, F.split_part(label_name(c), F.lit("_"), F.lit(1))).alias("domain"), F.concat(F.lit("about "), label_name(c)).alias("context"),
    )


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best labels of each embedding; the text of one in four is blank."""
    one = lambda x: F.struct(x["rank"].alias("rank"), own(x["sample_id"]).alias("sample_id"), F.when(x["sample_id"].cast("long") % 4 > 0, x["text"]).otherwise("").alias("text"), x["score"].alias("score"))
    return candidate_lists(spark, sf_dir, 5).select(own(F.col("label")).alias("sample_id"), F.transform("scores", one).alias("scores"))


MEMORY_SQL = HYBRID_SQL + f""", mc AS (SELECT vec_id, label, cand, r_omni, vec_id || ':' || cand AS id, CASE WHEN cand % 4 > 0 THEN {NAME.format("cand")} ELSE 'about ' || {NAME.format("cand")} END AS summary, {NAME.format("cand")} AS name FROM lr WHERE r_omni <= 3)"""


@query(f"""WITH {MEMORY_SQL} SELECT vec_id || ':' || label AS sample_id, string_agg(id, ',' ORDER BY r_omni) AS ids, string_agg(summary, ',' ORDER BY r_omni) AS summaries, string_agg(name, ',' ORDER BY r_omni) AS labels, string_agg(CASE WHEN cand % 3 > 0 THEN 'clips/' || cand ELSE '' END, ',' ORDER BY r_omni) AS clips,
  string_agg(CASE WHEN cand % 5 > 0 THEN split_part(name, '_', 1) END, ',' ORDER BY r_omni) AS domains, bool_or(cand = label) AS retrieval_hit_at_k, {NAME.format("label")} AS gold_answer FROM mc GROUP BY vec_id, label""")
def memory_use_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.from_retrieval(retrieved(spark, sf_dir), pairs(spark, sf_dir), 3, include_audio=True)
    each = lambda f: F.array_join(F.transform("candidate_memories", lambda x: x[f]), ",")
    return rows.select("sample_id", each("memory_id").alias("ids"), each("summary").alias("summaries"), each("label").alias("labels"), each("audio_path").alias("clips"), F.nullif(each("domain"), F.lit("")).alias("domains"), "retrieval_hit_at_k", "gold_answer")


@query(f"""WITH {MEMORY_SQL}, g AS (SELECT vec_id, bool_or(cand = label) AS hit, count(*) AS n FROM mc GROUP BY vec_id) SELECT count(*) AS row_count, round(avg(CAST(hit AS INT)), 6) AS retrieval_hit_at_k, round(avg(n), 6) AS mean_candidates FROM g""")
def memory_manifest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.retrieval_report(M.from_retrieval(retrieved(spark, sf_dir), pairs(spark, sf_dir), 3))


@query(f"""WITH {MEMORY_SQL}, t AS (SELECT *, replace(name, '_', ' ') AS words, split_part(name, '_', 1) AS family FROM mc WHERE cand <> 7)
SELECT vec_id, string_agg(name, ',' ORDER BY r_omni) AS ids, bool_or(cand = label) AS hit,
  string_agg('Tool intent: ' || name || '. Intent family: ' || family || '. Select this only when the spoken command asks for ' || words || '; do not select nearby tools from another intent family.', '|' ORDER BY r_omni) AS boundary,
  string_agg('Tool intent: ' || name || '. Intent family: ' || family || '. User goal: ' || words || '.', '|' ORDER BY r_omni) AS card FROM t GROUP BY vec_id""")
def tool_memory_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as memories; a blank label is left out."""
    label = lambda x: F.when(x["sample_id"] != "7", x["text"]).otherwise("")
    top = F.transform("scores", lambda x: F.struct(x["rank"].alias("rank"), label(x).alias("label"), x["score"].alias("score")))
    rows = candidate_lists(spark, sf_dir, 3).select(F.col("vec_id").alias("sample_id"), "target", top.alias("top_labels"))
    made = {m: M.from_labels(rows, 3, m).select(F.col("sample_id").alias("vec_id"), "candidate_memories", "retrieval_hit_at_k") for m in ("boundary_card", "tool_card")}
    text = lambda f: F.array_join(F.transform("candidate_memories", lambda x: x[f]), "|" if f == "summary" else ",")
    one = made["boundary_card"].select("vec_id", text("memory_id").alias("ids"), F.col("retrieval_hit_at_k").alias("hit"), text("summary").alias("boundary"))
    return one.join(made["tool_card"].select("vec_id", text("summary").alias("card")), "vec_id").where("ids != ''")


USE_SQL = MEMORY_SQL + f""", pc AS (SELECT vec_id, label, vec_id || ':' || label AS sample_id, vec_id % 4 > 0 AS heard, list(id ORDER BY r_omni) AS ids, list(cand ORDER BY r_omni) AS cands, count(*) FILTER (WHERE cand % 3 > 0) AS clips, string_agg(summary, ' ' ORDER BY r_omni) AS said FROM mc GROUP BY vec_id, label),
ch AS (SELECT *, 'oracle' AS mode, sample_id AS prediction FROM pc UNION ALL SELECT *, 'first', ids[1] FROM pc UNION ALL SELECT *, 'random', ids[{hash_sql("'9'", "sample_id")} % len(ids) + 1] FROM pc UNION ALL SELECT *, 'none', '' FROM pc),
ur AS (SELECT sample_id, mode, prediction, prediction = sample_id AS task_success, list_contains(ids, prediction) AND prediction = sample_id AS grounded_memory_use, prediction <> '' AND prediction <> sample_id AS wrong_memory, prediction = '' AS invalid_output,
   CAST(heard AS INT) + CAST(CASE WHEN mode = 'first' THEN 0 ELSE least(clips, 2) END AS DOUBLE) AS audio_cost, CAST(len(string_split(said, ' ')) AS BIGINT) AS text_cost, ids[1] = sample_id AND prediction <> sample_id AS regression_vs_text_only FROM ch)"""


def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.from_retrieval(retrieved(spark, sf_dir), pairs(spark, sf_dir), 3, include_audio=True)
    rows = rows.withColumn("query_audio_path", F.when(F.split_part("sample_id", F.lit(":"), F.lit(1)).cast("long") % 4 > 0, "q.wav"))
    said = F.array_join(F.transform("candidate_memories", lambda x: x["summary"]), " ")
    choice = lambda mode: M.local_choice(mode, "candidate_memories", "gold_memory_id", 9) if mode != "none" else F.lit("")
    run = lambda mode, base: M.use_rows(rows, base, "text_summary_only" if mode == "first" else "dual_summary_plus_audio", choice(mode), said, audio_limit=2).withColumn("mode", F.lit(mode))
    text = run("first", None)
    out = text
    for mode in ("oracle", "random", "none"):
        out = out.unionByName(run(mode, text))
    return out


@query(f"WITH {USE_SQL} SELECT * FROM ur")
def memory_use_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return used(spark, sf_dir).select("sample_id", "mode", "prediction", "task_success", "grounded_memory_use", "wrong_memory", "invalid_output", "audio_cost", "text_cost", "regression_vs_text_only")


USE_RATES = "count(*) AS n, " + ", ".join(f"round(avg(CAST({c} AS INT)), 6) AS {c}" for c in ("task_success", "grounded_memory_use", "wrong_memory", "invalid_output", "regression_vs_text_only"))


@query(f"WITH {USE_SQL} SELECT mode, {USE_RATES}, round(avg(text_cost), 6) AS mean_text_cost, round(avg(audio_cost), 6) AS mean_audio_cost, count(*) FILTER (WHERE regression_vs_text_only) AS regression_count FROM ur GROUP BY mode")
def memory_use_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.use_summary(used(spark, sf_dir), ["mode"])


@query(f"""WITH {USE_SQL} SELECT mode, count(*) AS n, round(avg(CAST(grounded_memory_use AS INT)), 6) AS success, round(avg(CAST(task_success AS INT)), 6) AS task_success, round(avg(CAST(invalid_output AS INT)), 6) AS invalid_output, round(avg(CAST(wrong_memory AS INT)), 6) AS wrong_memory,
  count(*) FILTER (WHERE invalid_output) AS http_error_count, count(*) FILTER (WHERE regression_vs_text_only) AS regression_count, 0e0 AS mean_latency_ms, round(avg(text_cost), 6) AS mean_text_cost, round(avg(audio_cost), 6) AS mean_audio_cost FROM ur GROUP BY mode""")
def memory_run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = used(spark, sf_dir).withColumn("parse_method", F.when(F.col("invalid_output"), "http_error").otherwise("letter"))
    return M.run_summary(rows, ["mode"], "grounded_memory_use")


@query(f"""WITH {MEMORY_SQL}, l AS (SELECT *, substr('ABC', CAST(r_omni AS INT), 1) AS letter FROM mc), g AS (SELECT vec_id, string_agg(letter || '. ' || summary, chr(10) ORDER BY r_omni) AS lines, coalesce(string_agg(CASE WHEN cand % 3 > 0 THEN letter END, ', ' ORDER BY r_omni), 'none') AS heard,
  string_agg(letter || '. Memory id: ' || id || '. Summary: ' || summary || CASE WHEN name <> summary THEN '. Label: ' || name ELSE '' END, ' ' ORDER BY r_omni) AS full_lines,
  string_agg(letter || '. Memory id: ' || id || CASE WHEN name <> summary THEN '. Label: ' || name ELSE '' END || CASE WHEN cand % 3 > 0 THEN '. Audio clip reference: clips/' || cand ELSE '' END, chr(10) ORDER BY r_omni) AS clip_lines FROM l GROUP BY vec_id)
SELECT vec_id, 'Listen to the query audio and choose the candidate memory whose text and audio best match it.' || chr(10) || 'Reply with exactly one capital option letter and nothing else.' || chr(10) || 'Query text/ASR hint: hint ' || vec_id || chr(10) || 'Audio attachments are ordered as: query audio first, then candidate memory audio clips ' || heard || '.' || chr(10) || chr(10) || lines AS compact,
  'Use only the text summaries of candidate memories. Select the memory that best answers or matches the spoken query. This is a fixed-candidate memory-use evaluation. Do not answer the user directly unless the candidate itself is the answer. Reply with exactly this JSON shape: {{"answer":"A"}}. Task family: family Spoken query text or ASR hint: hint ' || vec_id || ' Candidate memories: ' || full_lines AS flat, clip_lines AS clips FROM g""")
def memory_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.from_retrieval(retrieved(spark, sf_dir), pairs(spark, sf_dir), 3, include_audio=True)
    rows = rows.select(F.split_part("sample_id", F.lit(":"), F.lit(1)).cast("long").alias("vec_id"), "candidate_memories")
    rows = rows.withColumns({"hint": F.concat(F.lit("hint "), F.col("vec_id").cast("string")), "family": F.lit("family")})
    compact = M.prompt("dual_summary_plus_audio", "letter", "candidate_memories", "hint", "family", compact=True, show_hint=True)
    flat = M.prompt("text_summary_only", "json", "candidate_memories", "hint", "family", flat=True)
    clips = F.array_join(M.candidate_lines("candidate_memories", "audio_clip_only", False), "\n")
    return rows.select("vec_id", compact.alias("compact"), flat.alias("flat"), clips.alias("clips"))


@query(f"""WITH {HYBRID_SQL}, u AS (SELECT DISTINCT target AS name FROM h), o AS (SELECT sample_id, target, name, row_number() OVER (PARTITION BY sample_id ORDER BY {hash_sql("'5:others:' || sample_id", "name")}, name) AS nth FROM h, u WHERE name <> target),
m AS (SELECT sample_id, target, name FROM o WHERE nth <= 3 UNION ALL SELECT sample_id, target, target FROM h), p AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY {hash_sql("'5:order:' || sample_id", "name")}, name) AS place FROM m)
SELECT sample_id, string_agg(substr('ABCDEFGH', CAST(place AS INT), 1) || '. ' || name, '|' ORDER BY place) AS options, max(CASE WHEN name = target THEN substr('ABCDEFGH', CAST(place AS INT), 1) END) AS gold FROM p GROUP BY sample_id""")
def lettered_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and three others of the universe of labels."""
    h = hybrid(spark, sf_dir).select("sample_id", "target")
    universe = h.agg(F.array_sort(F.collect_set("target")).alias("universe"))  # the label bank
    options, gold = M.lettered_options("target", F.col("universe"), 4, 5, "sample_id")
    return h.join(F.broadcast(universe)).select("sample_id", F.array_join(options, "|").alias("options"), gold.alias("gold"))


@query("""SELECT role, count(*) AS n, round(avg(CAST(turn % 5 > 0 AND conv_id % 3 > 0 AS INT)), 6) AS valid_rate, round(avg(CAST(turn % 2 = 0 AS INT)), 6) AS parse_rate, round(avg(CAST(turn % 4 = 0 AS INT)), 6) AS accuracy, round(avg(length(text)), 6) AS mean_latency_ms, count(*) FILTER (WHERE conv_id % 7 = 0) AS overflows FROM conversations GROUP BY role""")
def chat_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = F.when(F.col("conv_id") % 7 == 0, "error: request exceeds the available context size").otherwise("fine")
    rows = c.select(
        "role", (F.col("turn") % 5 == 0).cast("int").alias("returncode"), F.when(F.col("conv_id") % 3 == 0, "timeout").otherwise("").alias("error"), F.when(F.col("turn") % 2 == 0, "A").alias("prediction_letter"), (F.col("turn") % 4 == 0).alias("correct"),
        F.length("text").alias("latency_ms"), M.overflowed(out).alias("over"),
    )
    return M.chat_summary(rows, ["role"]).join(rows.groupBy("role").agg(F.count_if("over").alias("overflows")), "role")


def answer_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, samples, keys): each embedding asks for its label among the three best of either view; labels of one remainder modulo 5 share a
    document, and the odd ones carry no document of their own."""
    r, c = label_ranks(spark, sf_dir), F.col("cand")
    item = F.struct(own(c).alias("sample_id"), F.when(c % 2 == 0, label_name(c)).otherwise("").alias("document"))
    top = lambda rank: F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), item.alias("x")))), 1, 3), lambda p: p["x"])
    rows = r.groupBy("vec_id", "label").agg(top("r_asr").alias("asr_top_k"), top("r_omni").alias("omni_top_k")).select(own(F.col("label")).alias("sample_id"), F.lit("heard").alias("asr_text"), "asr_top_k", "omni_top_k")
    samples = r.select(
        own(c).alias("sample_id"), F.concat(F.col("vec_id").cast("string"), F.lit("-"), (c % 5).cast("string")).alias("document_id"), F.concat(F.lit("doc "), label_name(c)).alias("document_text"), F.split_part(label_name(c), F.lit("_"), F.lit(1)).alias("domain"),
        F.when(c % 3 > 0, "ask").alias("intent"), F.when(c % 2 > 0, "clean").alias("query_style"), F.lit("").alias("tts_dialect"),
    )
    gold = label_name(F.col("label"))
    keys = r.where("cand = label").select(own(F.col("label")).alias("sample_id"), gold.alias("gold_answer"), gold.alias("key_decision"), F.array(F.array(gold, F.lit(""))).alias("required_terms"), F.array(F.lit("play_3")).alias("forbidden_terms"))
    return rows, samples, keys


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.evaluate(*answer_inputs(spark, sf_dir))


ANSWERS_SQL = HYBRID_SQL + f""", al AS (SELECT vec_id, label, list(cand ORDER BY r_asr) FILTER (WHERE r_asr <= 3) AS a, list(cand ORDER BY r_omni) FILTER (WHERE r_omni <= 3) AS o FROM lr GROUP BY vec_id, label),
au AS (SELECT *, a[1] AS base, {NAME.format("label")} AS gold, {NAME.format("a[1]")} AS name FROM al),
aa AS (SELECT *, CASE WHEN base % 2 = 0 THEN name ELSE 'doc ' || name END AS answer, base % 5 = label % 5 AS grounded, len(list_filter(a, lambda x: x % 5 = label % 5)) > 0 AS in_use, base % 4 = label % 4 AND base % 3 > 0 AND label % 3 > 0 AS domain FROM au),
ap AS (SELECT *, contains(replace(answer, '_', ' '), replace(gold, '_', ' ')) AS term, contains(replace(answer, '_', ' '), 'play 3') AS bad FROM aa),
ar AS (SELECT vec_id || ':' || label AS sample_id, vec_id || '-' || label % 5 AS document_id, CASE WHEN label % 2 > 0 THEN 'clean' ELSE '' END AS query_style, vec_id || ':' || base AS baseline_choice_id, array_to_string(list_transform(a, lambda x: vec_id || ':' || x), ',') AS used_candidate_ids, grounded AS grounded_target_pass, base = label AS grounded_sample_pass,
  domain AS grounded_domain_intent_pass, answer AS answer_text, term AND NOT bad AS answer_pass, CAST(term AS INT) + 0e0 AS required_terms_recall, bad AS forbidden_violation,
  CASE WHEN term AND NOT bad THEN 'none' WHEN NOT in_use THEN 'retrieval_miss' WHEN NOT grounded AND domain THEN 'same_cluster_neighbor' WHEN NOT domain THEN 'asr_semantic_drift' ELSE 'generation_miss' END AS error_type FROM ap)"""


@query(f"WITH {ANSWERS_SQL} SELECT * FROM ar")
def rag_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answers(spark, sf_dir)
    return out.select("sample_id", "document_id", "query_style", "baseline_choice_id", F.array_join("used_candidate_ids", ",").alias("used_candidate_ids"), "grounded_target_pass", "grounded_sample_pass", "grounded_domain_intent_pass", "answer_text", "answer_pass", "required_terms_recall", "forbidden_violation", "error_type")


@query(f"""WITH {ANSWERS_SQL}, s AS (SELECT 'all' AS section, '' AS value, * FROM ar UNION ALL SELECT 'query_style', CASE WHEN query_style = '' THEN 'unknown' ELSE query_style END, * FROM ar UNION ALL SELECT 'tts_dialect', 'unknown', * FROM ar)
SELECT section, value, count(*) AS n, round(avg(CAST(answer_pass AS INT)), 6) AS answer_pass, round(avg(required_terms_recall), 6) AS required_terms_recall, round(avg(CAST(forbidden_violation AS INT)), 6) AS forbidden_rate, round(avg(CAST(grounded_target_pass AS INT)), 6) AS grounded_target_acc, round(avg(CAST(error_type = 'retrieval_miss' AS INT)), 6) AS retrieval_miss_rate FROM s GROUP BY section, value""")
def rag_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.report(answers(spark, sf_dir))


@query(f"WITH {ANSWERS_SQL} SELECT sample_id, error_type, answer_text FROM ar WHERE NOT answer_pass ORDER BY sample_id LIMIT 20")
def rag_bad_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bad_cases(answers(spark, sf_dir), 20).select("sample_id", "error_type", "answer_text")


@query("""WITH p AS (SELECT item_id, text, 'You answer a spoken question using only the provided knowledge documents.' || chr(10) || 'Return the shortest exact answer phrase that is supported by one document.' || chr(10) || 'Prefer copying the phrase from the document instead of paraphrasing it.' || chr(10) || 'Do not explain your reasoning. Do not add extra facts.' || chr(10) || 'If none of the documents contains a supported answer, return: NOT ENOUGH INFORMATION' || chr(10) || chr(10) || 'Spoken question transcript: q' || item_id || chr(10) || chr(10) || 'Knowledge documents:' || chr(10) || '1. ' || text || chr(10) || '2. other' || chr(10) || chr(10) || 'Final answer:' AS short FROM benchmark)
SELECT item_id, short, 'You are a strict but rule-bound RAG evaluator.' || chr(10) || 'Judge the system answer only by the provided rule key and selected document.' || chr(10) || 'Do not use outside knowledge. Do not reward fluent but unsupported answers.' || chr(10) || 'Return compact JSON only; no markdown.' || chr(10) || chr(10) || 'Rules:' || chr(10) || '1. pass=true only if the answer covers the key_decision.' || chr(10) || '2. required_terms are OR groups. For each group, a paraphrase is acceptable if it clearly expresses the same condition.' || chr(10) || '3. If the answer states any forbidden_terms or their clear meaning, forbidden_violation=true and pass=false.' || chr(10)
  || '4. If the selected document is the wrong neighboring rule and changes the answer, grounding_error=true and pass=false.' || chr(10) || '5. If the answer refuses despite enough evidence in the selected document, pass=false.' || chr(10) || chr(10) || 'User question: q' || item_id || chr(10) || 'ASR text: ' || chr(10) || 'Gold answer: g' || chr(10) || 'Key decision: k' || chr(10) || 'Required term groups: [["a", "b \\"c\\""], ["d"]]' || chr(10) || 'Forbidden terms: []' || chr(10) || 'Selected document: ' || text || chr(10) || 'System answer: s' || chr(10) || chr(10) || 'Schema: {"pass": true, "required_coverage": 1.0, "forbidden_violation": false, "grounding_error": false, "reason": "short reason"}' AS judge FROM p""")
def rag_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("q", F.concat(F.lit("q"), F.col("item_id").cast("string")))
    text = lambda x: F.lit(x)
    required = F.array(F.array(text("a"), text('b "c"')), F.array(text("d")))
    judge = A.judge_prompt(F.col("q"), F.lit(None).cast("string"), text("g"), text("k"), required, F.array().cast("array<string>"), F.col("text"), text("s"))
    return b.select("item_id", A.answer_prompt("q", F.array("text", text("other")), "extractive_short").alias("short"), judge.alias("judge"))


AUDIT_SQL = ANSWERS_SQL + f""", au2 AS (SELECT vec_id || ':' || label AS sample_id, label, a, list_transform(a, lambda x: 'doc ' || (['alarm', 'email', 'music', 'play'])[x % 4 + 1] || ' ' || x) AS docs, (['alarm', 'email', 'music', 'play'])[label % 4 + 1] || ' ' || label AS want FROM al),
av AS (SELECT sample_id, contains(docs[1], want) AND NOT contains(docs[1], 'play 3') AS first, contains(array_to_string(docs, ' '), want) AND NOT contains(array_to_string(docs, ' '), 'play 3') AS context FROM au2),
ad AS (SELECT sample_id, answer_pass, first AS first_doc_has_answer, first AS selected_doc_has_answer, context AS context_has_answer, answer_pass AND context AND NOT first AS context_recovery, NOT answer_pass AND context AS context_pollution_or_generation_miss, NOT context AS retrieval_miss_by_answer_key, error_type FROM ar JOIN av USING (sample_id))"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, samples, keys = answer_inputs(spark, sf_dir)
    return R.context_audit(answers(spark, sf_dir), samples.select("sample_id", F.col("document_text").alias("document")), keys.select("sample_id", "required_terms", "forbidden_terms"))


@query(f"WITH {AUDIT_SQL} SELECT * FROM ad")
def answer_context_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the answer was: in the first document, in the selected one, in the context."""
    return audited(spark, sf_dir)


@query(f"""WITH {AUDIT_SQL} SELECT error_type, count(*) AS n, round(avg(CAST(answer_pass AS INT)), 6) AS answer_pass, round(avg(CAST(first_doc_has_answer AS INT)), 6) AS first_doc_has_answer, round(avg(CAST(selected_doc_has_answer AS INT)), 6) AS selected_doc_has_answer, round(avg(CAST(context_has_answer AS INT)), 6) AS context_has_answer,
  round(avg(CAST(context_recovery AS INT)), 6) AS context_recovery, round(avg(CAST(context_pollution_or_generation_miss AS INT)), 6) AS context_pollution_or_generation_miss, round(avg(CAST(retrieval_miss_by_answer_key AS INT)), 6) AS retrieval_miss_by_answer_key,
  count(*) FILTER (context_recovery) AS context_recovery_count, count(*) FILTER (context_pollution_or_generation_miss) AS context_pollution_or_generation_miss_count, count(*) FILTER (retrieval_miss_by_answer_key) AS retrieval_miss_by_answer_key_count FROM ad GROUP BY error_type""")
def answer_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.audit_report(audited(spark, sf_dir), ["error_type"])
