"""Deterministic views over the driver's tables that give every operator real rows.

The tables hold no retrieval results, so rankings are made: each embedding is ranked against the mean vector of each
label, once with all dimensions (the ``omni`` view) and once with the first 16 (the ``asr`` view).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import similarity

HEAD = slice(0, 16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, cand, s_asr, r_asr, s_omni, r_omni, r_rrf): every embedding against every label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    return similarity.rank_views(e, similarity.bank(e), ["vec_id", "label"], {"asr": HEAD, "omni": slice(None)})


def candidate_lists(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(vec_id, label, target, scores): each embedding's ``k`` best labels by the full view, as (rank, sample_id, text,
    score) in order."""
    r = label_ranks(spark, sf_dir).where(F.col("r_omni") <= k)
    one = F.struct(F.col("r_omni").alias("rank"), F.col("cand").cast("string").alias("sample_id"), label_name(F.col("cand")).alias("text"), F.col("s_omni").alias("score"))
    lists = r.groupBy("vec_id", "label").agg(F.array_sort(F.collect_list(one)).alias("scores"))
    return lists.select("vec_id", "label", label_name(F.col("label")).alias("target"), "scores")


def label_name(label: F.Column) -> F.Column:
    """A tool-like name: the family by the label's remainder, then the label."""
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in ("alarm", "email", "music", "play")]), (label % 4 + 1).cast("int")), F.lit("_"), label.cast("string"))


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each embedding, as a hybrid retrieval row."""
    r = label_ranks(spark, sf_dir)
    pick = lambda rank, place, value: F.max(F.when(F.col(rank) == place, F.col(value)))
    own = lambda rank: F.max(F.when(F.col("cand") == F.col("label"), F.col(rank)))
    h = r.groupBy("vec_id", "label").agg(
        own("r_asr").alias("asr_rank"), own("r_omni").alias("omni_rank"), own("r_rrf").alias("rrf_rank"),
        pick("r_asr", 1, "cand").alias("asr_top"), pick("r_omni", 1, "cand").alias("omni_top"), pick("r_rrf", 1, "cand").alias("rrf_top"),
        pick("r_asr", 1, "s_asr").alias("asr_score"), pick("r_omni", 1, "s_omni").alias("omni_score"),
        F.round(pick("r_asr", 1, "s_asr") - pick("r_asr", 2, "s_asr"), 6).alias("asr_margin"), F.round(pick("r_omni", 1, "s_omni") - pick("r_omni", 2, "s_omni"), 6).alias("omni_margin"),
    )
    v = F.col("vec_id")
    return h.select(
        v.cast("string").alias("sample_id"), "vec_id", "label", label_name(F.col("label")).alias("target"), "asr_rank", "omni_rank", "rrf_rank",
        F.least("asr_rank", "omni_rank").alias("best_of_two_rank"), "asr_top", "omni_top", "rrf_top", "asr_score", "omni_score", "asr_margin", "omni_margin",
        (F.col("asr_top") != F.col("omni_top")).alias("disagreement"),
        F.when(v % 11 != 0, F.round(F.least(F.lit(1.0), F.col("asr_margin") * 10), 6)).alias("confidence"),
        F.when(v % 7 != 0, (v % 10) / 10).alias("asr_wer"),
        F.element_at(F.array(F.lit("clean"), F.lit("wu"), F.lit("noisy_mandarin"), F.lit("")), (F.col("label") % 4 + 1).cast("int")).alias("query_style"),
        F.when(v % 5 == 0, "cantonese").alias("tts_dialect"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of four candidate runs: (candidate, pos, sample_id, target, prediction, rank, hit, base_margin)."""
    h = hybrid(spark, sf_dir)
    parts = [("asr", "asr_rank", "asr_top"), ("omni", "omni_rank", "omni_top"), ("rrf", "rrf_rank", "rrf_top")]
    rows = F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(i).cast("long").alias("pos"), F.col(r).alias("rank"), label_name(F.col(t)).alias("prediction")) for i, (n, r, t) in enumerate(parts)])
    long = h.select("sample_id", "vec_id", "target", "query_style", F.col("asr_margin").alias("base_margin"), "asr_rank", F.inline(rows))
    return long.withColumns({"hit": F.col("rank") == 1, "base_hit": F.col("asr_rank") == 1})


#: The same views as DuckDB common table expressions.
HYBRID_SQL = """
x AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
bank AS (SELECT label AS cand, p, avg(v) AS m FROM x GROUP BY label, p),
bn AS (SELECT cand, sqrt(sum(m * m)) AS n, sqrt(sum(m * m) FILTER (WHERE p <= 16)) AS nh FROM bank GROUP BY cand),
xn AS (SELECT vec_id, label, sqrt(sum(v * v)) AS n, sqrt(sum(v * v) FILTER (WHERE p <= 16)) AS nh FROM x GROUP BY vec_id, label),
dt AS (SELECT x.vec_id, bank.cand, sum(x.v * bank.m) AS d, sum(x.v * bank.m) FILTER (WHERE x.p <= 16) AS dh FROM x JOIN bank ON x.p = bank.p GROUP BY x.vec_id, bank.cand),
sc AS (SELECT dt.vec_id, xn.label, dt.cand, round(d / (xn.n * bn.n), 6) AS s_omni, round(dh / (xn.nh * bn.nh), 6) AS s_asr
       FROM dt JOIN xn ON dt.vec_id = xn.vec_id JOIN bn ON dt.cand = bn.cand),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s_asr DESC, cand) AS r_asr, row_number() OVER (PARTITION BY vec_id ORDER BY s_omni DESC, cand) AS r_omni FROM sc),
lr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(1e0 / (60 + r_asr) + 1e0 / (60 + r_omni), 12) DESC, r_asr) AS r_rrf FROM rk),
hp AS (SELECT vec_id, label, max(CASE WHEN cand = label THEN r_asr END) AS asr_rank, max(CASE WHEN cand = label THEN r_omni END) AS omni_rank,
              max(CASE WHEN cand = label THEN r_rrf END) AS rrf_rank, max(CASE WHEN r_asr = 1 THEN cand END) AS asr_top, max(CASE WHEN r_omni = 1 THEN cand END) AS omni_top,
              max(CASE WHEN r_rrf = 1 THEN cand END) AS rrf_top, max(CASE WHEN r_asr = 1 THEN s_asr END) AS asr_score, max(CASE WHEN r_omni = 1 THEN s_omni END) AS omni_score,
              round(max(CASE WHEN r_asr = 1 THEN s_asr END) - max(CASE WHEN r_asr = 2 THEN s_asr END), 6) AS asr_margin,
              round(max(CASE WHEN r_omni = 1 THEN s_omni END) - max(CASE WHEN r_omni = 2 THEN s_omni END), 6) AS omni_margin FROM lr GROUP BY vec_id, label),
h AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, *, (['alarm', 'email', 'music', 'play'])[label % 4 + 1] || '_' || label AS target,
             least(asr_rank, omni_rank) AS best_of_two_rank, asr_top <> omni_top AS disagreement,
             CASE WHEN vec_id % 11 <> 0 THEN round(least(1e0, asr_margin * 10), 6) END AS confidence,
             CASE WHEN vec_id % 7 <> 0 THEN (vec_id % 10) / 1e1 END AS asr_wer,
             (['clean', 'wu', 'noisy_mandarin', ''])[label % 4 + 1] AS query_style, CASE WHEN vec_id % 5 = 0 THEN 'cantonese' END AS tts_dialect FROM hp)"""
RUNS_SQL = HYBRID_SQL + """,
rn AS (SELECT 'asr' AS candidate, 0 AS pos, sample_id, vec_id, target, query_style, asr_margin AS base_margin, asr_rank, asr_rank AS rank, asr_top AS top FROM h
       UNION ALL SELECT 'omni', 1, sample_id, vec_id, target, query_style, asr_margin, asr_rank, omni_rank, omni_top FROM h
       UNION ALL SELECT 'rrf', 2, sample_id, vec_id, target, query_style, asr_margin, asr_rank, rrf_rank, rrf_top FROM h),
runs AS (SELECT candidate, CAST(pos AS BIGINT) AS pos, sample_id, vec_id, target, query_style, base_margin, asr_rank, rank, rank = 1 AS hit, asr_rank = 1 AS base_hit,
                (['alarm', 'email', 'music', 'play'])[top % 4 + 1] || '_' || top AS prediction FROM rn)"""
