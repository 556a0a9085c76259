"""Retrieval-augmented answers, memory manifests, chains of retrieval and use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import answers_match
from ..functions.ranking import portable_hash
from ..functions.text import collapse_ws, word_count
from ..operators import metrics, rag, sampling
from ..views import HYBRID_SQL, hybrid, table
from .registry import hash_sql, registry

QUERIES, ORACLE_SQL, query = registry()
NORM = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"


def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer to a question whose key terms are its first and third word (any of two spellings),
    and whose forbidden term is one of four; languages and sources play domains and styles."""
    d = table(spark, sf_dir, "documents")
    w = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    other = F.element_at(F.array(F.lit("the"), F.lit("zzz"), F.lit(""), F.lit("qqq")), (F.col("doc_id") % 4 + 1).cast("int"))
    required = F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.get(w, F.lit(0)), F.lit("absent")), F.array(F.coalesce(F.get(w, F.lit(2)), F.lit("nothing")))))
    d = rag.with_score(d.select("doc_id", "lang", "source", "text", required.alias("required"), F.array(other).alias("forbidden")), "text", "required", "forbidden")
    d = d.select("doc_id", "lang", "source", "required_terms_recall", "forbidden_violation", "answer_pass")
    v = F.col("doc_id")
    kind = rag.error_type(F.col("answer_pass"), v % 2 == 0, v % 3 == 0, v % 3 == 0, v % 5 == 0, v % 7 != 0, v % 4 == 0)
    return d.withColumn("error_type", kind)


ANSWER_SQL = f"""w AS (SELECT doc_id, lang, source, text, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS w, (['the', 'zzz', '', 'qqq'])[doc_id % 4 + 1] AS other FROM documents),
t AS (SELECT *, {NORM.format("text")} AS norm FROM w),
g AS (SELECT *, doc_id % 9 = 0 AS free, (w[1] <> '' AND contains(norm, {NORM.format("w[1]")})) OR contains(norm, 'absent') AS g1, coalesce(w[3], 'nothing') <> '' AND contains(norm, {NORM.format("coalesce(w[3], 'nothing')")}) AS g2, other <> '' AND contains(norm, other) AS bad FROM t),
a AS (SELECT doc_id, lang, source, CASE WHEN free THEN 1e0 ELSE (CAST(g1 AS INT) + CAST(g2 AS INT)) / 2e0 END AS required_terms_recall, bad AS forbidden_violation, (free OR (g1 AND g2)) AND NOT bad AS answer_pass FROM g),
ae AS (SELECT *, CASE WHEN answer_pass THEN 'none' WHEN doc_id % 2 <> 0 THEN 'retrieval_miss' WHEN doc_id % 3 <> 0 AND doc_id % 5 = 0 THEN 'same_cluster_neighbor' WHEN doc_id % 7 <> 0 AND doc_id % 4 <> 0 THEN 'asr_semantic_drift' ELSE 'generation_miss' END AS error_type FROM a)"""


@query(f"WITH {ANSWER_SQL} SELECT doc_id, required_terms_recall, forbidden_violation, answer_pass FROM a")
def rag_local_answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_rows(spark, sf_dir).select("doc_id", "required_terms_recall", "forbidden_violation", "answer_pass")


@query(f"WITH {ANSWER_SQL} SELECT error_type, count(*) AS n FROM ae GROUP BY error_type")
def rag_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_rows(spark, sf_dir).groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


RATES = "count(*) AS n, round(avg(CAST(answer_pass AS INT)), 6) AS answer_pass, round(avg(required_terms_recall), 6) AS required_terms_recall, round(avg(CAST(forbidden_violation AS INT)), 6) AS forbidden_rate, round(avg(CAST(error_type = 'generation_miss' AS INT)), 6) AS generation_error_rate"


@query(f"WITH {ANSWER_SQL} SELECT {RATES} FROM ae")
def rag_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.answer_metrics(answer_rows(spark, sf_dir), [[]]).drop("all_lang")


@query(f"WITH {ANSWER_SQL} SELECT lang, source, CAST(grouping(lang) AS INT) AS all_lang, CAST(grouping(source) AS INT) AS all_source, {RATES} FROM ae GROUP BY GROUPING SETS ((), (lang), (source))")
def rag_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.answer_metrics(answer_rows(spark, sf_dir), [[], ["lang"], ["source"]])


CHAIN_SQL = HYBRID_SQL + ", u AS (SELECT *, asr_rank <= 5 AS hit, omni_rank = 1 AND vec_id % 4 > 0 AS used FROM h)"


def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved by the head view (top 5), used if the full view is right in three rows of four."""
    return hybrid(spark, sf_dir).withColumns({"hit": F.col("asr_rank") <= 5, "used": (F.col("omni_rank") == 1) & (F.col("vec_id") % 4 > 0)})


CHAIN = """count(*) AS n, round(avg(CAST(hit AS INT)), 6) AS hit_rate, round(avg(CAST(used AS INT)), 6) AS use_success, round(coalesce(count(*) FILTER (WHERE hit AND used) / nullif(CAST(count(*) FILTER (WHERE hit) AS DOUBLE), 0), 0), 6) AS use_given_hit,
  round(avg(CAST(hit AND NOT used AS INT)), 6) AS hit_but_use_fail, round(avg(CAST(NOT hit AND used AS INT)), 6) AS miss_but_success"""


@query(f"WITH {CHAIN_SQL} SELECT query_style, {CHAIN} FROM u GROUP BY query_style")
def retrieval_use_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.chain(chain_rows(spark, sf_dir), ["query_style"])


@query(f"""WITH {CHAIN_SQL} SELECT split_part(target, '_', 1) AS family, count(*) AS n, round(avg(CAST(used AS INT)), 6) AS success, round(avg(CAST(hit AS INT)), 6) AS grounded, count(*) FILTER (WHERE used AND asr_rank > 1) AS fixes, count(*) FILTER (WHERE NOT used AND asr_rank = 1) AS regressions FROM u GROUP BY 1""")
def family_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = chain_rows(spark, sf_dir)
    base = F.col("asr_rank") == 1
    return u.groupBy(F.split_part("target", F.lit("_"), F.lit(1)).alias("family")).agg(F.count(F.lit(1)).alias("n"), metrics.rate(F.col("used")).alias("success"), metrics.rate(F.col("hit")).alias("grounded"), F.count_if(F.col("used") & ~base).alias("fixes"), F.count_if(~F.col("used") & base).alias("regressions"))


@query(f"""WITH {CHAIN_SQL} SELECT CASE WHEN used AND hit THEN 'grounded_success' WHEN used THEN 'ungrounded_success' WHEN hit THEN 'use_failure' ELSE 'retrieval_failure' END AS stage, count(*) AS n FROM u GROUP BY 1""")
def rag_compare_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, used = F.col("hit"), F.col("used")
    stage = F.when(used & hit, "grounded_success").when(used, "ungrounded_success").when(hit, "use_failure").otherwise("retrieval_failure")
    return chain_rows(spark, sf_dir).groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


#: Cards of the labels by their remainder: a letter, the letter and its text, and two spellings of a word.
CARDS = ("Task\nAnswer: A\n", "Task\nAnswer: a. alpha\nend", 'Answer:  "Beta"', "beta ;")
SHORT = ("a", "a. alpha", "beta", "beta")
USE_SQL = HYBRID_SQL + ", " + f"""uc AS (SELECT query_style, (['{"', '".join(SHORT)}'])[label % 4 + 1] AS gold, (['{"', '".join(SHORT)}'])[omni_top % 4 + 1] AS said, omni_top = label OR omni_top % 4 = label % 4 AS grounded, label IN (omni_top, asr_top, rrf_top) AS in_context FROM h),
ut AS (SELECT *, gold = said OR (gold = 'a' AND said LIKE 'a.%') OR (said = 'a' AND gold LIKE 'a.%') AS passed FROM uc),
ue AS (SELECT *, CASE WHEN passed THEN 'none' WHEN NOT in_context THEN 'retrieval_miss' WHEN NOT grounded THEN 'wrong_memory_selected' ELSE 'answer_parse_or_generation_miss' END AS e FROM ut)"""


@query(f"""WITH {USE_SQL} SELECT query_style, count(*) AS n, round(avg(CAST(passed AS INT)), 6) AS answer_pass, round(avg(CAST(grounded AS INT)), 6) AS grounded_target_acc, round(avg(CAST(in_context AS INT)), 6) AS context_gold_rate,
  round(avg(CAST(in_context AND NOT passed AS INT)), 6) AS generation_miss_rate, round(avg(CAST(NOT in_context AS INT)), 6) AS retrieval_miss_rate, round(avg(CAST(NOT grounded AND NOT passed AS INT)), 6) AS wrong_memory_answer_rate,
  count(*) FILTER (WHERE e = 'none') AS n_none, count(*) FILTER (WHERE e = 'retrieval_miss') AS n_retrieval_miss, count(*) FILTER (WHERE e = 'wrong_memory_selected') AS n_wrong_memory_selected, count(*) FILTER (WHERE e = 'answer_parse_or_generation_miss') AS n_answer_parse_or_generation_miss
FROM ue GROUP BY query_style""")
def final_task_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full view's first candidate is the memory in use; the context is the first of each view."""
    card = lambda label: F.element_at(F.array(*[F.lit(c) for c in CARDS]), (F.col(label) % 4 + 1).cast("int"))
    h = hybrid(spark, sf_dir).select("query_style", "label", "omni_top", "asr_top", "rrf_top", card("label").alias("gold"), card("omni_top").alias("selected"))
    same = (F.col("omni_top") == F.col("label")) | (collapse_ws("selected") == collapse_ws("gold"))
    rows = h.select("query_style", answers_match("selected", "gold").alias("answer_pass"), same.alias("grounded"), F.col("label").isin(F.col("omni_top"), F.col("asr_top"), F.col("rrf_top")).alias("in_context"))
    return rag.final_use(rows.withColumn("error_type", rag.use_stage(F.col("answer_pass"), F.col("in_context"), F.col("grounded"))), ["query_style"])


@query("""WITH p AS (SELECT conv_id, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM conversations WHERE trim(text) <> ''), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM p)
SELECT any_value(c) AS n, round(avg(n), 6) AS mean, CAST(max(n) AS BIGINT) AS max, CAST(max(n) FILTER (WHERE i = c // 2) AS BIGINT) AS p50, CAST(max(n) FILTER (WHERE i = CAST(floor(c * 0.95) AS BIGINT)) AS BIGINT) AS p95 FROM o""")
def prompt_budget_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per message: mean, largest, and two order statistics, from the counts of each length."""
    c = table(spark, sf_dir, "conversations").where("trim(text) != ''").select(word_count("text").alias("words"))
    return metrics.order_quantiles(c, "words")


NEG_SQL = f"""pool AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {hash_sql("'21:ring'", "CAST(doc_id AS VARCHAR)")}, doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM documents),
sz AS (SELECT lang, any_value(size) AS size FROM pool GROUP BY lang),
ot AS (SELECT a.lang AS own, b.lang, b.size, row_number() OVER (PARTITION BY a.lang ORDER BY b.lang) - 1 AS i, count(*) OVER (PARTITION BY a.lang) AS m FROM sz a JOIN sz b ON a.lang <> b.lang),
ask AS (SELECT doc_id, lang, r.i AS place, {hash_sql("'21'", "CAST(doc_id AS VARCHAR)")} + r.i AS pick, {hash_sql("'21:at'", "CAST(doc_id AS VARCHAR) || ':' || CAST(r.i AS VARCHAR)")} AS spot FROM documents, range(3) AS r(i)),
ng AS (SELECT ask.doc_id, pool.doc_id AS cand, place FROM ask JOIN ot ON ot.own = ask.lang AND ot.i = ask.pick % ot.m JOIN pool ON pool.lang = ot.lang AND pool.pos = spot % ot.size)"""


@query(f"WITH {NEG_SQL} SELECT doc_id, cand, CAST(place AS INT) AS place FROM ng")
def memory_manifest_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives of another language for each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.negatives(d, d, "doc_id", "lang", 3, 21)


@query(f"""WITH {NEG_SQL}, m AS (SELECT doc_id, doc_id AS cand, true AS is_gold FROM documents UNION ALL SELECT doc_id, cand, false FROM ng),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {hash_sql("'22'", "CAST(doc_id AS VARCHAR) || ':' || CAST(cand AS VARCHAR)")}, cand, is_gold) AS nth FROM m)
SELECT doc_id, string_agg(CAST(cand AS VARCHAR), ',' ORDER BY nth) AS candidates, CAST(max(nth) FILTER (WHERE is_gold) AS INT) AS gold_place FROM o GROUP BY doc_id""")
def memory_from_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and negatives as one shuffled candidate list per query, with the place of gold."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    neg = sampling.negatives(d, d, "doc_id", "lang", 3, 21).select("doc_id", "cand", F.lit(False).alias("is_gold"))
    rows = d.select("doc_id", F.col("doc_id").alias("cand"), F.lit(True).alias("is_gold")).unionByName(neg)
    h = portable_hash(22, F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("cand").cast("string")))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(h.alias("h"), "cand", "is_gold"))).alias("c"))
    return lists.select("doc_id", F.array_join(F.transform("c", lambda x: x["cand"].cast("string")), ",").alias("candidates"), F.array_position(F.transform("c", lambda x: x["is_gold"]), True).cast("int").alias("gold_place"))


@query("""WITH b AS (SELECT item_id, text FROM benchmark) SELECT b.item_id, count(d.doc_id) AS documents, min(d.doc_id) AS first_id FROM b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id""")
def rag_context_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold a benchmark item whole.  Items are keyed by their second to ninth word (the first may be
    glued to what stands before it): documents send their runs of eight words, and only those that are a key are
    compared in full."""
    gram = 8
    split = lambda c: F.split(c, r"[ \n]")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    keyed = items.withColumn("key", F.xxhash64(F.array_join(F.slice(split(F.col("item")), 2, gram), " ")))
    heads = keyed.select("key").distinct()
    words = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", r"[ \n]").alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - gram + 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, gram), " ")))
    found = words.select("doc_id", F.explode(F.array_distinct(grams)).alias("key")).join(heads, "key", "left_semi").distinct()
    hits = found.join(keyed, "key").join(words.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item"))).select("item_id", "doc_id").distinct()
    n = hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("first_id"))
    return items.join(n, "item_id", "left").select("item_id", F.coalesce("k", F.lit(0)).alias("documents"), "first_id")
