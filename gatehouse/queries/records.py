"""Accessors of result records, over the driver's rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.ranking import rank_value, rounded
from ..views import HYBRID_SQL, candidate_lists, hybrid, table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
NAME = "(['alarm', 'email', 'music', 'play'])[{0} % 4 + 1] || '_' || {0}"


@query(f"""WITH {HYBRID_SQL}, f AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN rrf_rank = 1 END AS hit, CASE WHEN vec_id % 2 = 0 THEN omni_rank = 1 END AS text_hit, CASE WHEN vec_id % 3 = 0 THEN asr_rank = 1 END AS sample_hit,
  CASE WHEN vec_id % 4 = 0 THEN omni_rank END AS text_rank, CASE WHEN vec_id % 3 = 1 THEN asr_rank END AS sample_rank, rrf_rank AS rank FROM h)
SELECT vec_id, CAST(coalesce(text_hit, hit, sample_hit, coalesce(text_rank, sample_rank, rank) = 1) AS DOUBLE) AS selector_text, CAST(coalesce(sample_hit, hit, text_hit, coalesce(text_rank, sample_rank, rank) = 1) AS DOUBLE) AS selector_sample,
  CAST(coalesce(hit, text_hit, sample_hit, coalesce(text_rank, sample_rank, rank) = 1) AS DOUBLE) AS selector_auto, CAST(coalesce(hit, sample_hit, text_hit, coalesce(rank, sample_rank) = 1) AS DOUBLE) AS paired_auto,
  CAST(coalesce(text_hit, hit, sample_hit, coalesce(rank, sample_rank) = 1) AS DOUBLE) AS paired_text FROM f""")
def hit_coalesce_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that have some of their hit fields: the two orders differ where text and sample disagree."""
    v = F.col("vec_id")
    h = hybrid(spark, sf_dir).select(
        "vec_id", F.when(v % 5 == 0, F.col("rrf_rank") == 1).alias("hit_at_1"), F.when(v % 2 == 0, F.col("omni_rank") == 1).alias("text_hit_at_1"),
        F.when(v % 3 == 0, F.col("asr_rank") == 1).alias("sample_hit_at_1"), F.when(v % 4 == 0, F.col("omni_rank")).alias("text_rank"),
        F.when(v % 3 == 1, F.col("asr_rank")).alias("sample_rank"), F.col("rrf_rank").alias("rank"),
    )
    own, paired = rank_value(("text_rank", "sample_rank", "rank"), h.columns), rank_value(("rank", "sample_rank"), h.columns)
    asked = {"selector_text": ("text", "selector", own), "selector_sample": ("sample", "selector", own), "selector_auto": ("auto", "selector", own), "paired_auto": ("auto", "paired", paired), "paired_text": ("text", "paired", paired)}
    return h.select("vec_id", *[R.hit_value(h.columns, mode, order, rank).alias(k) for k, (mode, order, rank) in asked.items()])


@query(f"""WITH {HYBRID_SQL}, c AS (SELECT vec_id, label, r_omni, cand, round(s_omni, 2) AS s, {NAME.format("cand % 3")} AS text FROM lr WHERE r_omni <= 5),
t AS (SELECT vec_id, max(s) FILTER (WHERE r_omni = 1) AS top FROM c GROUP BY vec_id)
SELECT c.vec_id, count(DISTINCT text) FILTER (WHERE r_omni <= 4) AS unique_texts, count(*) FILTER (WHERE r_omni <= 4 AND abs(s - top) <= 1e-9) AS top_ties,
  coalesce(max(r_omni) FILTER (WHERE cand = c.label), 999) AS label_rank, max(CAST(cand AS VARCHAR)) FILTER (WHERE r_omni = 1) AS first, coalesce(max(r_omni) FILTER (WHERE cand = c.label) - 1, -1) AS label_index,
  coalesce(min(r_omni) FILTER (WHERE text = {NAME.format("label % 3")}), 1000000000) AS text_gold_rank, coalesce(min(r_omni) FILTER (WHERE cand = c.label), 1000000000) AS sample_gold_rank,
  coalesce(min(r_omni) FILTER (WHERE cand = c.label OR text = {NAME.format("label % 3")}), 1000000000) AS auto_gold_rank, string_agg(text, '|' ORDER BY r_omni) FILTER (WHERE r_omni <= 3) AS shown
FROM c JOIN t ON c.vec_id = t.vec_id GROUP BY c.vec_id, c.label""")
def candidate_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five candidates of three texts, with scores of two digits so that some tie."""
    rows = candidate_lists(spark, sf_dir, 5)
    text = lambda label: F.concat(F.element_at(F.array(*[F.lit(x) for x in ("alarm", "email", "music")]), (label + 1).cast("int")), F.lit("_"), label.cast("string"))
    scores = F.transform("scores", lambda x: F.struct(x["rank"].alias("rank"), x["sample_id"].alias("sample_id"), text(x["sample_id"].cast("long") % 3).alias("text"), rounded(x["score"], 2).alias("score")))
    rows = rows.select("vec_id", F.col("label").cast("string").alias("own"), text(F.col("label") % 3).alias("target"), scores.alias("scores"))
    ids, own, target = F.transform("scores", lambda x: x["sample_id"]), F.col("own"), F.col("target")
    memories = F.transform("scores", lambda x: F.struct(x["sample_id"].alias("memory_id"), x["text"].alias("summary")))
    rank = lambda mode: R.gold_rank(own, target, "scores", mode)
    return rows.select(
        "vec_id", R.unique_texts("scores", 4).cast("long").alias("unique_texts"), R.top_ties("scores", 4).cast("long").alias("top_ties"), R.rank_in(ids, own).alias("label_rank"),
        R.first_id(ids).alias("first"), F.coalesce(R.memory_index(memories, own), F.lit(-1)).cast("long").alias("label_index"),
        rank("text").alias("text_gold_rank"), rank("sample").alias("sample_gold_rank"), rank("auto").alias("auto_gold_rank"),
        F.array_join(F.transform(R.top_candidates(["scores"], 3), lambda x: x["candidate"]), "|").alias("shown"),
    )


@query(f"""WITH {HYBRID_SQL}, c AS (SELECT vec_id, label, r_omni, cand FROM lr WHERE r_omni <= 5),
g AS (SELECT vec_id, label, count(*) FILTER (WHERE cand % 3 > 0) AS heard, max({NAME.format("cand")}) FILTER (WHERE cand = label) AS chosen FROM c GROUP BY vec_id, label)
SELECT vec_id, CAST(vec_id % 4 > 0 AS INT) + 0e0 AS text_cost, CAST(vec_id % 4 > 0 AS INT) + CAST(heard AS DOUBLE) AS audio_cost, CAST(vec_id % 4 > 0 AS INT) + CAST(least(heard, 2) AS DOUBLE) AS limited_cost, CAST(least(heard, 2) AS DOUBLE) AS memory_cost, chosen FROM g""")
def memory_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two memories of three have a clip, three queries of four."""
    rows = candidate_lists(spark, sf_dir, 5)
    clip = lambda x: F.when(x["sample_id"].cast("long") % 3 > 0, F.concat(F.lit("clips/"), x["sample_id"])).otherwise("")
    memories = F.transform("scores", lambda x: F.struct(x["sample_id"].alias("memory_id"), x["text"].alias("summary"), clip(x).alias("audio_path")))
    rows = rows.select("vec_id", F.col("label").cast("string").alias("own"), memories.alias("memories"), F.when(F.col("vec_id") % 4 > 0, "query.wav").alias("query_audio"))
    cost = lambda **more: R.audio_seconds("query_audio", "memories", **more)
    return rows.select("vec_id", cost(memory_audio=False).alias("text_cost"), cost(memory_audio=True).alias("audio_cost"), cost(memory_audio=True, limit=2).alias("limited_cost"), cost(memory_audio=True, limit=2, use_query=False).alias("memory_cost"), R.memory_of("memories", "own")["summary"].alias("chosen"))


@query(f"""WITH {HYBRID_SQL} SELECT vec_id, sample_id AS id, asr_rank = 1 AS hit, asr_rank <= 3 AS r3, asr_rank <= 5 AS r5, round(1e0 / asr_rank, 6) AS mrr,
  CASE WHEN vec_id % 3 = 0 THEN 'n/a' ELSE '0.' || vec_id END AS threshold, 'run_' || vec_id || '_v_1' AS name, 'ValueError:no Bearer <redacted> at ' || vec_id || ' and more' AS error,
  CASE WHEN vec_id % 2 = 0 THEN target WHEN vec_id % 3 = 0 THEN query_style ELSE 'text ' || vec_id END AS query, CASE WHEN vec_id % 4 = 0 THEN 'asr ' || vec_id WHEN vec_id % 3 = 0 AND query_style <> '' THEN query_style ELSE 'text ' || vec_id END AS asr_query FROM (SELECT * REPLACE (CASE WHEN vec_id % 3 = 0 AND query_style = '' THEN 'text ' || vec_id ELSE query_style END AS query_style) FROM h)""")
def record_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, thresholds, redacted errors, required fields and the text that a route asks with."""
    v = F.col("vec_id").cast("string")
    h = hybrid(spark, sf_dir).withColumns(
        {
            "policy": F.when(F.col("vec_id") % 3 == 0, "always").otherwise(F.concat(F.lit("verifier tau=0."), v)),
            "question": F.when(F.col("vec_id") % 2 == 0, F.col("target")), "asr": F.when(F.col("vec_id") % 4 == 0, F.concat(F.lit("asr "), v)).otherwise(""),
            "transcript": F.when(F.col("vec_id") % 3 == 0, F.col("query_style")), "text": F.concat(F.lit("text "), v),
        }
    )
    message = F.concat(F.lit("no Bearer abc.DEF-1 at\n"), v, F.lit(" and more"))
    fields = R.rank_fields(F.col("asr_rank"), F.col("asr_rank") == 1)
    return h.select(
        "vec_id", R.required("sample_id", "sample_id", "vec_id").alias("id"), fields["hit"].alias("hit"), fields["r3"].alias("r3"), fields["r5"].alias("r5"), F.round(fields["mrr"], 6).alias("mrr"),
        R.policy_threshold("policy").alias("threshold"), R.safe_name(F.concat(F.lit("run "), v, F.lit(":v.1"))).alias("name"), R.safe_error(F.lit("ValueError"), message).alias("error"),
        R.query_text("direct", "question", "asr").alias("query"), R.query_text("asr_text", "question", "asr").alias("asr_query"),
    )


OPTIONS = ("A. red apple pie", "B. green tea", "plain option", "D. blue sky over fields")


@query("""WITH o AS (SELECT doc_id, doc_id % 8 AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'B' WHEN 1 THEN 'B' WHEN 2 THEN 'D' WHEN 3 THEN 'A' WHEN 6 THEN 'C' ELSE '' END AS letter,
  CASE k WHEN 0 THEN 'letter' WHEN 1 THEN 'content_exact' WHEN 2 THEN 'content_overlap' WHEN 3 THEN 'letter' WHEN 4 THEN 'no_final_channel' WHEN 6 THEN 'content_exact' ELSE 'none' END AS method,
  CASE k WHEN 2 THEN 0.75 WHEN 4 THEN 0.0 WHEN 5 THEN 0.0 WHEN 7 THEN round(2 / 3e0, 6) ELSE 1.0 END::DOUBLE AS score, 'green tea' AS second FROM o""")
def content_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that name an option's letter, repeat its content, overlap with it, or stop in their thoughts."""
    outputs = ("thinking A <|channel>final (B)", "I say: Green tea!", "the sky is blue, it lies over", "<|channel>thought x <channel|> A.", "<|channel>thought it may be", "", "one <channel|> the plain option", "red and apple")
    options = F.array(*[F.lit(x) for x in OPTIONS])
    said = F.element_at(F.array(*[F.lit(x) for x in outputs]), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("said"), R.option_bodies(options).alias("options"))
    c = rows.select("doc_id", R.channel_choice("said", "options").alias("c"), F.get("options", F.lit(1)).alias("second"))
    return c.select("doc_id", "c.letter", "c.method", F.round("c.score", 6).alias("score"), "second")


TAILS = ("", " answer: c", ' "answer": "D" or A', " Option：b then A", " <channel|> H and E")


@query(r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') || (['', ' answer: c', ' "answer": "D" or A', ' Option：b then A', ' <channel|> H and E'])[conv_id % 5 + 1] AS s FROM conversations),
g AS (SELECT *, string_split(s, '<channel|>')[-1] AS g FROM t),
l AS (SELECT *, nullif(upper(regexp_extract(g, '(?i)"answer"\s*:\s*"([A-H])"', 1)), '') AS j, nullif(upper(regexp_extract(g, '(?i)\b(?:answer|option|choice)\s*[:：]\s*([A-H])\b', 1)), '') AS n, nullif(upper(regexp_extract(g, '(?i)\b(?:answer|option|choice)\s*[:?]\s*([A-H])\b', 1)), '') AS m,
   regexp_extract_all(regexp_replace(upper(g), '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-H])(?:$|[^\p{L}\p{N}_])', 1) AS alone, regexp_extract_all(regexp_replace(upper(s), '([^A-Z0-9])', '\1\1', 'g'), '(?:^|[^A-Z0-9])([A-H])(?:$|[^A-Z0-9])', 1) AS every FROM g)
SELECT conv_id, turn, coalesce(j, n, alone[1], '') AS policy, coalesce(CASE WHEN coalesce(j, m) <= 'D' THEN coalesce(j, m) END, list_filter(alone, lambda x: x <= 'D')[-1], '') AS memory, coalesce(every[-1], '') AS chat FROM l""")
def letter_cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters that three parsers find in whole messages, some of which name an answer at their end."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*[F.lit(x) for x in TAILS]), (F.col("conv_id") % 5 + 1).cast("int")))
    letter = lambda parser: F.when(parser["method"].isin("letter", "chat_last_letter"), parser["letter"]).otherwise("")
    rows = c.select("conv_id", "turn", said.alias("said"), R.option_bodies(F.array(*[F.lit(x) for x in OPTIONS])).alias("options"))
    return rows.select("conv_id", "turn", letter(R.channel_choice("said", "options")).alias("policy"), letter(R.memory_choice("said", "options")).alias("memory"), letter(R.chat_choice("said", "options")).alias("chat"))


@query("""WITH t AS (SELECT doc_id, doc_id % 3 AS a, doc_id % 4 AS b FROM documents)
SELECT doc_id, repeat('0', CAST(a + 2 AS INT)) || repeat('1', CAST(b + 1 AS INT)) || '00' AS last, '0' || repeat('1', CAST(a AS INT)) || CASE WHEN a = 0 THEN '0' || repeat('1', CAST(b + 1 AS INT)) ELSE '0' || repeat('0', CAST(b + 1 AS INT)) END || '00' AS first FROM t""")
def audio_run_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lists with two runs of the audio token (the first may be empty); which tokens are the query's clip."""
    v = F.col("doc_id")
    tokens = F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(9), (v % 3).cast("int")), F.array(F.lit(2)), F.array_repeat(F.lit(9), (v % 4 + 1).cast("int")), F.array(F.lit(3), F.lit(4)))
    mask = lambda which: F.array_join(F.transform(R.run_mask(F.col("tokens"), F.lit(9), which), lambda x: x.cast("int").cast("string")), "")
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens")).select("doc_id", mask("last").alias("last"), mask("first").alias("first"))
