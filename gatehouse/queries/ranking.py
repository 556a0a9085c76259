"""Similarity, rankings, margins, gates and voting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranking as R
from ..operators import fusion, gates, metrics, order, similarity
from ..views import HYBRID_SQL, RUNS_SQL, hybrid, label_name, label_ranks, runs, table
from .evaluation import ROUNDS, SEED, boot_sql, ci_sql
from .registry import hash_sql, registry

QUERIES, ORACLE_SQL, query = registry()
K = 5

#: Stated queries (ids divisible by 50) against all vectors.
TOPK_SQL = """x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM x GROUP BY vec_id),
d AS (SELECT q.vec_id AS query, c.vec_id AS cand, sum(q.v * c.v) AS d FROM x q JOIN x c ON q.p = c.p WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2),
s AS (SELECT query, cand, round(d / (a.n * b.n), 6) AS score FROM d JOIN n a ON a.vec_id = query JOIN n b ON b.vec_id = cand),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, cand) AS rank FROM s),
tk AS (SELECT * FROM r WHERE rank <= 5)"""


def top(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return similarity.top_k(e.where("vec_id % 50 = 0"), e, k)


@query(f"WITH {TOPK_SQL} SELECT query, cand, score, rank FROM tk")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, sf_dir)


@query(f"""WITH {TOPK_SQL}, v AS (SELECT query, e.label, count(*) AS n, round(sum(score), 6) AS s FROM tk JOIN embeddings e ON e.vec_id = tk.cand GROUP BY query, e.label),
b AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY n DESC, s DESC, label) AS nth FROM v)
SELECT count(*) AS n, round(avg(CAST(b.label = e.label AS INT)), 6) AS accuracy FROM b JOIN embeddings e ON e.vec_id = b.query WHERE nth = 1""")
def knn_probe_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    said = similarity.knn_vote(top(spark, sf_dir), e).join(e.withColumnRenamed("vec_id", "query"), "query")
    return said.agg(F.count(F.lit(1)).alias("n"), metrics.rate(F.col("prediction") == F.col("label")).alias("accuracy"))


@query(f"""WITH {TOPK_SQL}, m AS (SELECT query, max(CAST(a.label = b.label AS INT)) AS found FROM tk JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = cand GROUP BY query)
SELECT count(*) AS n, round(avg(found), 6) AS recall FROM m""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    t = top(spark, sf_dir).join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), "query").join(e.select(F.col("vec_id").alias("cand"), "label"), "cand")
    return t.groupBy("query").agg(F.max((F.col("own") == F.col("label")).cast("int")).alias("found")).agg(F.count(F.lit(1)).alias("n"), metrics.rate(F.col("found") == 1).alias("recall"))


@query(f"WITH {HYBRID_SQL} SELECT vec_id, cand, s_omni AS score, r_omni AS rank FROM lr")
def label_bank_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_ranks(spark, sf_dir).select("vec_id", "cand", F.col("s_omni").alias("score"), F.col("r_omni").alias("rank"))


@query(f"WITH {RUNS_SQL} SELECT target, prediction, count(*) AS n FROM runs WHERE candidate = 'asr' AND target <> prediction GROUP BY target, prediction ORDER BY n DESC, target, prediction LIMIT 20")
def confusion_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).where("candidate = 'asr' AND target != prediction")
    return r.groupBy("target", "prediction").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target", "prediction").limit(20)


@query(f"""WITH {HYBRID_SQL}, g AS (SELECT vec_id, cand % 4 AS gate, max(s_asr) AS s FROM lr GROUP BY 1, 2), t AS (SELECT vec_id, gate, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, gate) AS nth FROM g),
p AS (SELECT lr.*, row_number() OVER (PARTITION BY lr.vec_id ORDER BY s_omni DESC, cand) AS rank, count(*) OVER (PARTITION BY lr.vec_id) AS pool FROM lr JOIN t ON lr.vec_id = t.vec_id AND lr.cand % 4 = t.gate WHERE nth <= 2)
SELECT vec_id, coalesce(max(CASE WHEN cand = label THEN rank END), max(pool) + 1) AS rank, max(pool) AS pool FROM p GROUP BY vec_id""")
def gated_retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages: the two best families by the head view, then only their labels; a miss ranks behind the pool."""
    r = label_ranks(spark, sf_dir).withColumn("gate", F.col("cand") % 4)
    by = Window.partitionBy("vec_id")
    best = r.groupBy("vec_id", "gate").agg(F.max("s_asr").alias("s")).withColumn("g", F.row_number().over(by.orderBy(F.desc("s"), "gate"))).where("g <= 2")
    p = r.join(best.select("vec_id", "gate"), ["vec_id", "gate"]).withColumns({"rank": F.row_number().over(by.orderBy(F.desc("s_omni"), "cand")).cast("long"), "pool": F.count(F.lit(1)).over(by)})
    return p.groupBy("vec_id").agg(F.coalesce(F.max(F.when(F.col("cand") == F.col("label"), F.col("rank"))), F.max("pool") + 1).alias("rank"), F.max("pool").alias("pool"))


@query(f"WITH {HYBRID_SQL} SELECT vec_id, cand, round(1e0 / (60 + r_asr) + 1e0 / (60 + r_omni), 12) AS score, r_rrf AS rank FROM lr WHERE r_rrf <= 5")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = label_ranks(spark, sf_dir)
    long = r.select("vec_id", "cand", F.inline(F.array(F.struct(F.lit(1).alias("source"), F.col("r_asr").alias("rank")), F.struct(F.lit(2).alias("source"), F.col("r_omni").alias("rank")))))
    return fusion.rrf(long, "vec_id", "cand", "rank", "source", limit=5)


@query(f"""WITH {HYBRID_SQL}, u AS (SELECT vec_id, cand, r_asr AS place FROM lr WHERE r_asr <= 3 UNION ALL SELECT vec_id, cand, 3 + r_omni FROM lr WHERE r_omni <= 3),
f AS (SELECT vec_id, cand, min(place) AS place FROM u GROUP BY 1, 2) SELECT vec_id, string_agg(CAST(cand AS VARCHAR), ',' ORDER BY place) AS merged FROM f GROUP BY vec_id""")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = label_ranks(spark, sf_dir)
    first = lambda rank: F.transform(F.slice(F.array_sort(F.collect_list(F.struct(rank, "cand"))), 1, 3), lambda s: s["cand"].cast("string"))
    lists = r.groupBy("vec_id").agg(first("r_asr").alias("a"), first("r_omni").alias("o"))
    return lists.select("vec_id", F.array_join(fusion.merged(F.col("a"), F.col("o"), 26), ",").alias("merged"))


@query(f"""WITH {HYBRID_SQL}, t AS (SELECT vec_id, max(r_omni) FILTER (WHERE cand = label) AS sample_rank, min(r_omni) FILTER (WHERE cand % 4 = label % 4) AS text_rank FROM lr GROUP BY vec_id)
SELECT vec_id, sample_rank, text_rank FROM t""")
def text_rank_vs_sample_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of the gold label, and the best rank among labels of the same text (here: the same family)."""
    r = label_ranks(spark, sf_dir)
    own, same = F.col("cand") == F.col("label"), F.col("cand") % 4 == F.col("label") % 4
    return r.groupBy("vec_id").agg(F.max(F.when(own, F.col("r_omni"))).alias("sample_rank"), F.min(F.when(same, F.col("r_omni"))).alias("text_rank"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_extendedprice DESC) AS gold FROM lineitem)
SELECT count(*) AS n, round(avg(CAST(rank = 1 AS INT)), 6) AS acc_at_1, round(avg(CAST(rank <= 3 AS INT)), 6) AS recall_at_3, round(avg(CAST(rank <= 5 AS INT)), 6) AS recall_at_5, round(avg(1e0 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank FROM l WHERE gold = 1""")
def orderline_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists at scale: lines of an order by price, the gold line has the largest discount.  The gold line and
    its rank come from one aggregate over sorted small arrays, so rows are shuffled once and never sorted globally."""
    line = F.struct((-F.col("l_extendedprice")).alias("p"), F.col("l_linenumber").alias("l"))
    gold = F.min(F.struct((-F.col("l_discount")).alias("d"), F.col("l_linenumber").alias("l"), (-F.col("l_extendedprice")).alias("p")))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"), gold.alias("g"))
    rank = F.size(F.filter("lines", lambda x: (x["p"] < F.col("g.p")) | ((x["p"] == F.col("g.p")) & (x["l"] < F.col("g.l"))))) + 1
    return orders.select(rank.cast("long").alias("rank")).agg(*metrics.rank_aggregates("rank", (3, 5)))


@query(f"""WITH {HYBRID_SQL}, s AS (SELECT lr.vec_id, label, s_omni, r_omni FROM lr WHERE r_omni <= 2 AND (vec_id % 3 > 0 OR r_omni = 1)),
m AS (SELECT vec_id, round(max(CASE WHEN r_omni = 1 THEN s_omni END) - max(CASE WHEN r_omni = 2 THEN s_omni END), 6) AS m FROM s GROUP BY vec_id)
SELECT vec_id, m AS margin_null, coalesce(m, 0) AS margin_zero, coalesce(m, CAST('inf' AS DOUBLE)) = CAST('inf' AS DOUBLE) AS never_routed, coalesce(m < 0.05, false) AS strict_low, coalesce(m <= 0.05, false) AS inclusive_low FROM m""")
def score_margins_three_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins where a third of the rows have one score only."""
    r = label_ranks(spark, sf_dir).where("r_omni <= 2 AND (vec_id % 3 > 0 OR r_omni = 1)")
    s = r.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_omni", F.col("s_omni").alias("score")))), lambda x: F.struct(x["score"].alias("score"))).alias("scores"))
    null, zero, inf = (R.margin(F.col("scores"), m) for m in ("null", "zero", "inf"))
    m = F.round(null, 6)
    return s.select("vec_id", m.alias("margin_null"), F.round(zero, 6).alias("margin_zero"), (inf == float("inf")).alias("never_routed"), R.gate(m, 0.05, False).alias("strict_low"), R.gate(m, 0.05, True).alias("inclusive_low"))


@query(f"""WITH {RUNS_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY base_margin, vec_id) - 1) * 4 // count(*) OVER () AS bucket FROM runs WHERE candidate = 'omni')
SELECT CAST(bucket AS INT) AS bucket, count(*) AS n, round(avg(CAST(base_hit AS INT)), 6) AS base_acc, round(avg(CAST(hit AS INT)), 6) AS acc, count(*) FILTER (WHERE hit AND NOT base_hit) AS fixes, count(*) FILTER (WHERE base_hit AND NOT hit) AS regressions FROM b GROUP BY bucket""")
def margin_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-frequency buckets by margin; their edges are order statistics of the counted (margin, id) pairs."""
    r = order.ranked(runs(spark, sf_dir).where("candidate = 'omni'"), "base_margin", "vec_id", "nth", "total")
    b = r.withColumn("bucket", R.bucket(F.col("nth"), F.col("total"), 4))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), metrics.rate(F.col("base_hit")).alias("base_acc"), metrics.rate(F.col("hit")).alias("acc"), F.count_if(F.col("hit") & ~F.col("base_hit")).alias("fixes"), F.count_if(F.col("base_hit") & ~F.col("hit")).alias("regressions"))


@query(f"""WITH {RUNS_SQL}, o AS (SELECT * FROM runs WHERE candidate = 'omni'), t AS (SELECT (list_sort(list(base_margin)))[greatest(1, CAST(floor(count(*) * 0.3) AS BIGINT))] AS t FROM o)
SELECT t AS threshold, round(avg(CAST(base_margin <= t AS INT)), 6) AS route_rate, round(avg(CAST(CASE WHEN base_margin <= t THEN hit ELSE base_hit END AS INT)), 6) AS accuracy FROM o, t GROUP BY t""")
def margin_gate_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = runs(spark, sf_dir).where("candidate = 'omni'")
    place = F.greatest(F.lit(0), F.floor(F.col("total") * 0.3) - 1)
    t = order.at_place(o, "base_margin", "vec_id", place).select(F.col("base_margin").alias("threshold"))
    low = F.col("base_margin") <= F.col("threshold")
    return o.join(F.broadcast(t)).groupBy("threshold").agg(metrics.rate(low).alias("route_rate"), metrics.rate(F.when(low, F.col("hit")).otherwise(F.col("base_hit"))).alias("accuracy"))


PAIR_SQL = HYBRID_SQL + """, pg AS (SELECT * FROM (VALUES ('always_baseline', 0e0), ('always_alternate', 0e0), ('raw_low_margin', 0.02e0), ('raw_low_margin', 0.05e0), ('alt_high_margin', 0.05e0), ('alt_margin_advantage', 0.02e0), ('top_score_advantage', 0.01e0), ('disagreement_raw_low_margin', 0.02e0)) AS v(policy, t)),
pc AS (SELECT policy, t, asr_rank = 1 AS base_hit, CASE policy WHEN 'always_baseline' THEN false WHEN 'always_alternate' THEN true WHEN 'raw_low_margin' THEN asr_margin <= t WHEN 'alt_high_margin' THEN omni_margin >= t
   WHEN 'alt_margin_advantage' THEN round(omni_margin - asr_margin, 6) >= t WHEN 'top_score_advantage' THEN round(omni_score - asr_score, 6) >= t ELSE asr_top = omni_top OR asr_margin <= t END AS use_alt, asr_rank, omni_rank FROM h, pg)"""
GRID = (("always_baseline", 0.0), ("always_alternate", 0.0), ("raw_low_margin", 0.02), ("raw_low_margin", 0.05), ("alt_high_margin", 0.05), ("alt_margin_advantage", 0.02), ("top_score_advantage", 0.01), ("disagreement_raw_low_margin", 0.02))


@query(f"""WITH {PAIR_SQL}, ch AS (SELECT *, CASE WHEN use_alt THEN omni_rank ELSE asr_rank END AS rank FROM pc)
SELECT policy, t, count(*) AS n, round(avg(CAST(rank = 1 AS INT)), 6) AS accuracy, round(avg(CAST(rank <= 3 AS INT)), 6) AS recall_at_3, round(avg(CAST(rank <= 5 AS INT)), 6) AS recall_at_5, round(avg(1e0 / rank), 6) AS mrr,
  round(avg(CAST(use_alt AS INT)), 6) AS alternate_rate, count(*) FILTER (WHERE rank = 1 AND NOT base_hit) AS fixes, count(*) FILTER (WHERE base_hit AND rank <> 1) AS regressions FROM ch GROUP BY policy, t""")
def candidate_policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(t).alias("t")) for p, t in GRID])
    rows = hybrid(spark, sf_dir).select("*", F.inline(grid))
    use = gates.pair_choice(F.col("policy"), F.col("t"), F.col("asr_margin"), F.col("omni_margin"), F.col("asr_score"), F.col("omni_score"), F.col("asr_top") == F.col("omni_top"))
    rows = rows.withColumn("use_alt", use).withColumns({"rank": F.when(F.col("use_alt"), F.col("omni_rank")).otherwise(F.col("asr_rank")), "base_hit": F.col("asr_rank") == 1})
    return gates.chosen_metrics(rows, ["policy", "t"])


@query(f"""WITH {RUNS_SQL}, md AS (SELECT unnest(['same_family', 'changed_same_family', 'same_family_low_margin', 'low_margin']) AS mode), o AS (SELECT a.*, b.prediction AS base FROM runs a JOIN runs b ON a.sample_id = b.sample_id AND b.candidate = 'asr' WHERE a.candidate = 'omni'),
c AS (SELECT mode, CASE mode WHEN 'same_family' THEN f WHEN 'changed_same_family' THEN f AND base <> prediction WHEN 'same_family_low_margin' THEN f AND base_margin < 0.05 ELSE base_margin < 0.05 END AS use_alt, hit, base_hit, base, prediction, target
   FROM (SELECT *, split_part(base, '_', 1) = split_part(prediction, '_', 1) AS f FROM o), md),
d AS (SELECT *, CASE WHEN use_alt THEN hit ELSE base_hit END AS ok, CASE WHEN use_alt THEN prediction ELSE base END AS said FROM c)
SELECT mode, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS success, round(avg(CAST(NOT ok AND split_part(said, '_', 1) <> split_part(target, '_', 1) AS INT)), 6) AS unsafe_rate,
  round(avg(CAST(NOT ok AND split_part(said, '_', 1) = split_part(target, '_', 1) AS INT)), 6) AS boundary_rate, round(avg(CAST(use_alt AS INT)), 6) AS route_rate FROM d GROUP BY mode""")
def tool_family_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    base = r.where("candidate = 'asr'").select("sample_id", F.col("prediction").alias("base"))
    o = r.where("candidate = 'omni'").join(base, "sample_id").withColumn("mode", F.explode(F.array(*[F.lit(m) for m in gates.FAMILY_MODES])))
    o = o.withColumn("use_alt", gates.family_choice(F.col("mode"), F.col("base"), F.col("prediction"), F.col("base_margin"), F.lit(0.05)))
    ok = F.when(F.col("use_alt"), F.col("hit")).otherwise(F.col("base_hit"))
    said = F.when(F.col("use_alt"), F.col("prediction")).otherwise(F.col("base"))
    same = F.split_part(said, F.lit("_"), F.lit(1)) == F.split_part("target", F.lit("_"), F.lit(1))
    return o.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), metrics.rate(ok).alias("success"), metrics.rate(~ok & ~same).alias("unsafe_rate"), metrics.rate(~ok & same).alias("boundary_rate"), metrics.rate(F.col("use_alt")).alias("route_rate"))


TAUS = (0.0, 0.01, 0.02, 0.05, 0.1)
CURVE_SQL = HYBRID_SQL + ", ta AS (SELECT unnest([0e0, 0.01e0, 0.02e0, 0.05e0, 0.1e0]) AS tau)"


@query(f"""WITH {CURVE_SQL} SELECT tau, count(*) AS n, round(avg(CAST(asr_margin <= tau AS INT)), 6) AS route_rate, round(avg(CAST(CASE WHEN asr_margin <= tau THEN asr_rank <= 3 ELSE asr_rank = 1 END AS INT)), 6) AS accuracy,
  count(*) FILTER (WHERE asr_margin <= tau AND asr_rank <= 3 AND asr_rank > 1) AS fixes, round(avg(1e0 / CASE WHEN asr_margin <= tau THEN CASE WHEN asr_rank <= 3 THEN 1 ELSE 1000000000 END ELSE CASE WHEN asr_rank = 1 THEN 1 ELSE 1000000000 END END), 6) AS mrr FROM h, ta GROUP BY tau""")
def low_margin_oracle_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verifier that finds gold among the top 3 of rows with a margin up to tau; a deployed miss has no rank."""
    rows = hybrid(spark, sf_dir).withColumn("tau", F.explode(F.array(*[F.lit(t) for t in TAUS])))
    routed = R.gate(F.col("asr_margin"), F.col("tau"), True)
    ok = F.when(routed, F.col("asr_rank") <= 3).otherwise(F.col("asr_rank") == 1)
    rank = F.when(ok, 1).otherwise(R.NO_RANK)
    return rows.groupBy("tau").agg(F.count(F.lit(1)).alias("n"), metrics.rate(routed).alias("route_rate"), metrics.rate(ok).alias("accuracy"), F.count_if(routed & (F.col("asr_rank") <= 3) & (F.col("asr_rank") > 1)).alias("fixes"), metrics.mean(1.0 / rank).alias("mrr"))


@query(f"""WITH {HYBRID_SQL}, r AS (SELECT *, asr_margin <= 0.05 AS routed, sum(CAST(asr_margin <= 0.05 AS INT)) OVER (ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS used FROM h)
SELECT count(*) AS n, count(*) FILTER (WHERE routed) AS routed, count(*) FILTER (WHERE routed AND used <= 40) AS spent, round(avg(CAST(CASE WHEN routed AND used <= 40 THEN asr_rank <= 3 ELSE asr_rank = 1 END AS INT)), 6) AS accuracy FROM r""")
def low_margin_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 routed rows in row order are verified: the budget is the feature."""
    rows = gates.budgeted(hybrid(spark, sf_dir), "asr_margin <= 0.05", ["vec_id"], 40)
    ok = F.when(F.col("spent"), F.col("asr_rank") <= 3).otherwise(F.col("asr_rank") == 1)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("asr_margin") <= 0.05).alias("routed"), F.count_if("spent").alias("spent"), metrics.rate(ok).alias("accuracy"))


@query(f"""WITH {CURVE_SQL}, c AS (SELECT tau, count(*) FILTER (WHERE asr_margin <= tau) AS k FROM h, ta GROUP BY tau), r AS (SELECT *, row_number() OVER (ORDER BY {hash_sql("'3'", "sample_id")}, sample_id) AS nth FROM h)
SELECT c.tau, round(avg(CAST(nth <= k AS INT)), 6) AS route_rate, round(avg(CAST(CASE WHEN nth <= k THEN asr_rank <= 3 ELSE asr_rank = 1 END AS INT)), 6) AS accuracy FROM r, c GROUP BY c.tau""")
def random_same_rate_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many random rows routed as the margin gate routes."""
    from ..operators import sampling

    h = hybrid(spark, sf_dir)
    k = h.agg(*[F.count_if(F.col("asr_margin") <= t).alias(f"k{i}") for i, t in enumerate(TAUS)])
    rows = sampling.placed(h, "sample_id", 3).join(F.broadcast(k)).select("nth", "asr_rank", F.inline(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"k{i}").alias("k")) for i, t in enumerate(TAUS)])))
    routed = F.col("nth") < F.col("k")
    return rows.groupBy("tau").agg(metrics.rate(routed).alias("route_rate"), metrics.rate(F.when(routed, F.col("asr_rank") <= 3).otherwise(F.col("asr_rank") == 1)).alias("accuracy"))


VOTE_SQL = RUNS_SQL + """, vc AS (SELECT sample_id, prediction, count(*) AS votes, max(CAST(candidate = 'asr' AS INT)) AS base, round(avg(rank), 6) AS avg_rank FROM runs GROUP BY sample_id, prediction),
vn AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY votes DESC, base DESC, avg_rank, prediction) AS nth, sum(votes) OVER (PARTITION BY sample_id) AS all_votes FROM vc),
vt AS (SELECT sample_id, max(CASE WHEN nth = 1 THEN prediction END) AS prediction, max(CASE WHEN nth = 1 THEN votes END) AS votes, CAST(max(all_votes) AS BIGINT) AS runs, coalesce(max(CASE WHEN nth = 2 THEN votes END), 0) AS second, coalesce(max(CASE WHEN base = 1 THEN votes END), 0) AS base_votes FROM vn GROUP BY sample_id)"""


@query(f"WITH {VOTE_SQL} SELECT sample_id, prediction, votes, runs, round(votes / CAST(runs AS DOUBLE), 6) AS agreement, round((votes - second) / CAST(runs AS DOUBLE), 6) AS vote_margin, votes = second AS tie, base_votes FROM vt")
def self_consistency_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.vote(runs(spark, sf_dir), "sample_id", "candidate", "prediction", "rank", "asr")


@query(f"""WITH {VOTE_SQL}, gt AS (SELECT * FROM (VALUES ('base', 0e0, 0e0), ('majority', 0e0, 0e0), ('agreement', 0.6e0, 0e0), ('agreement', 0.6e0, 0.34e0), ('agreement', 1e0, 0e0), ('base_loses', 0e0, 0e0), ('base_votes_le', 1e0, 0e0)) AS v(gate, a, m)),
j AS (SELECT gt.*, vt.prediction AS said, r.prediction AS base, r.target, CASE gate WHEN 'base' THEN false WHEN 'majority' THEN true WHEN 'agreement' THEN round(votes / CAST(runs AS DOUBLE), 6) >= a AND round((votes - second) / CAST(runs AS DOUBLE), 6) >= m WHEN 'base_loses' THEN vt.prediction <> r.prediction ELSE base_votes <= a END AS taken
   FROM vt JOIN runs r ON r.sample_id = vt.sample_id AND r.candidate = 'asr', gt)
SELECT gate, a, m, round(avg(CAST(taken AS INT)), 6) AS route_rate, round(avg(CAST(CASE WHEN taken THEN said ELSE base END = target AS INT)), 6) AS accuracy, count(*) FILTER (WHERE base = target AND CASE WHEN taken THEN said ELSE base END <> target) AS regressions FROM j GROUP BY gate, a, m""")
def self_consistency_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    v = gates.vote(r, "sample_id", "candidate", "prediction", "rank", "asr").withColumnRenamed("prediction", "said")
    spec = [("base", 0.0, 0.0), ("majority", 0.0, 0.0), ("agreement", 0.6, 0.0), ("agreement", 0.6, 0.34), ("agreement", 1.0, 0.0), ("base_loses", 0.0, 0.0), ("base_votes_le", 1.0, 0.0)]
    rows = v.join(r.where("candidate = 'asr'").select("sample_id", F.col("prediction").alias("base"), "target"), "sample_id").select("*", F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(a).alias("a"), F.lit(m).alias("m")) for g, a, m in spec])))
    g = F.col("gate")
    taken = F.when(g == "base", False).when(g == "majority", True).when(g == "agreement", (F.col("agreement") >= F.col("a")) & (F.col("vote_margin") >= F.col("m"))).when(g == "base_loses", F.col("said") != F.col("base")).otherwise(F.col("base_votes") <= F.col("a"))
    chosen = F.when(taken, F.col("said")).otherwise(F.col("base"))
    return rows.groupBy("gate", "a", "m").agg(metrics.rate(taken).alias("route_rate"), metrics.rate(chosen == F.col("target")).alias("accuracy"), F.count_if((F.col("base") == F.col("target")) & (chosen != F.col("target"))).alias("regressions"))


SWEEP_SQL = VOTE_SQL + ", gt AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {k})" for k, (n, _) in enumerate(gates.consistency_gates())) + """) AS v(policy, k)),
ge AS (SELECT 0 AS k, 0e0 AS a, 0 AS m UNION ALL SELECT 2 + 5 * i + m, ([0.5e0, 0.75e0, 1e0])[i + 1], m FROM range(3) AS r(i), range(5) AS q(m)),
gj AS (SELECT policy, vt.prediction AS said, r.prediction AS base, r.target, CASE WHEN policy = 'base' THEN false WHEN policy = 'majority' THEN true WHEN policy = 'self_when_base_loses_vote' THEN base_votes < votes WHEN policy LIKE 'self_if_base%' THEN base_votes <= CAST(right(policy, 1) AS INT)
   ELSE votes / CAST(runs AS DOUBLE) >= a AND votes - second >= m END AS taken FROM vt JOIN runs r ON r.sample_id = vt.sample_id AND r.candidate = 'asr', gt LEFT JOIN ge ON ge.k = gt.k AND gt.k > 1),
gk AS (SELECT *, base = target AS was, CASE WHEN taken THEN said ELSE base END = target AS ok FROM gj),
cn AS (SELECT policy, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS success, count(*) FILTER (ok AND NOT was) AS fixes, count(*) FILTER (was AND NOT ok) AS regressions, round(avg(CAST(taken AND said <> base AS INT)), 6) AS route_rate FROM gk GROUP BY policy)"""


@query(f"""WITH {SWEEP_SQL}, {boot_sql("cn", "policy")}, {ci_sql("policy", "D")},
sw AS (SELECT cn.*, round((fixes - regressions) / CAST(n AS DOUBLE), 6) AS delta, round(regressions / CAST(n AS DOUBLE), 6) AS regression_rate, ci_low, ci_high FROM cn JOIN ci USING (policy))
SELECT policy, n, success, delta, ci_low, ci_high, fixes, regressions, regression_rate, route_rate, CASE WHEN policy = 'base' THEN 'fallback' WHEN delta > 0 AND ci_low > 0 AND regression_rate <= 0.03 THEN 'accepted' WHEN delta > 0 THEN 'weak_trend_rejected' ELSE 'rejected' END AS decision,
  CAST(row_number() OVER (ORDER BY delta DESC, regressions, route_rate, policy) AS INT) AS place FROM sw""")
def consistency_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 21 gates between the base run and the vote of three."""
    r = runs(spark, sf_dir)
    v = gates.vote(r, "sample_id", "candidate", "prediction", "rank", "asr").withColumnRenamed("prediction", "said")
    second = F.round(F.col("votes") - F.col("vote_margin") * F.col("runs")).cast("long")
    rows = v.withColumn("second", second).join(r.where("candidate = 'asr'").select("sample_id", F.col("prediction").alias("base"), "target"), "sample_id")
    return gates.consistency_sweep(rows, ROUNDS, SEED)


@query(f"""WITH {RUNS_SQL}, k AS (SELECT * FROM runs WHERE candidate <> 'rrf' OR vec_id % 13 > 0) SELECT sample_id, max(prediction) FILTER (candidate = 'asr') AS asr, max(prediction) FILTER (candidate = 'omni') AS omni, max(prediction) FILTER (candidate = 'rrf') AS rrf, CAST(3 - count(*) AS INT) AS missing FROM k GROUP BY sample_id""")
def aligned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs side by side; a thirteenth of the rows lacks one."""
    rows = runs(spark, sf_dir).where("candidate != 'rrf' OR vec_id % 13 > 0")
    return gates.aligned(rows, "sample_id", "candidate", ["asr", "omni", "rrf"], "prediction", strict=False)


AUDIO_SQL = HYBRID_SQL + ", ag AS (SELECT unnest([" + ", ".join(f"'{g}'" for g in gates.AUDIO_GATES) + """]) AS gate),
ar AS (SELECT vec_id, label, CAST(asr_top AS VARCHAR) AS text_pred, CAST(omni_top AS VARCHAR) AS audio_pred, CASE WHEN vec_id % 6 > 0 THEN CAST(rrf_top AS VARCHAR) ELSE '' END AS noquery_pred, vec_id % 13 = 0 AS invalid, asr_top = 0 AS first, coalesce(confidence, 0) AS overlap,
   10e0 + vec_id % 5 AS text_cost, 30e0 + vec_id % 7 AS audio_cost, 5e0 AS noquery_cost FROM h),
ac AS (SELECT *, CASE gate WHEN 'text_only' THEN false WHEN 'audio_only' THEN true WHEN 'audio_text' THEN true WHEN 'audio_on_invalid' THEN invalid WHEN 'audio_on_text_audio_disagreement' THEN invalid OR text_pred <> audio_pred
   WHEN 'audio_on_text_equals_noquery' THEN invalid OR (noquery_pred <> '' AND text_pred = noquery_pred) WHEN 'audio_on_disagreement_or_text_equals_noquery' THEN invalid OR text_pred <> audio_pred OR (noquery_pred <> '' AND text_pred = noquery_pred)
   WHEN 'audio_on_text_first_candidate' THEN invalid OR first WHEN 'audio_on_hint_pred_overlap_ge_0_80' THEN invalid OR overlap >= 0.8 ELSE invalid OR overlap >= 0.95 END AS triggered FROM ar, ag),
ax AS (SELECT *, CASE WHEN gate = 'text_only' THEN text_cost WHEN gate IN ('audio_only', 'audio_text') THEN audio_cost WHEN gate = 'audio_on_text_audio_disagreement' THEN text_cost + audio_cost WHEN gate = 'audio_on_disagreement_or_text_equals_noquery' THEN text_cost + noquery_cost + audio_cost
   WHEN gate = 'audio_on_text_equals_noquery' THEN text_cost + noquery_cost + CASE WHEN triggered THEN audio_cost ELSE 0 END ELSE text_cost + CASE WHEN triggered THEN audio_cost ELSE 0 END END AS cost,
   CAST(CASE WHEN triggered THEN audio_pred ELSE text_pred END = CAST(label AS VARCHAR) AS BOOLEAN) AS ok, text_pred = CAST(label AS VARCHAR) AS text_ok FROM ac),
am AS (SELECT gate, count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS success, round(avg(CAST(triggered AS INT)), 6) AS gate_rate, count(*) FILTER (WHERE ok AND NOT text_ok) AS rescues, count(*) FILTER (WHERE text_ok AND NOT ok) AS regressions, round(avg(cost), 6) AS mean_cost FROM ax GROUP BY gate)"""


def audio_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hybrid(spark, sf_dir)
    v = F.col("vec_id")
    rows = h.select("vec_id", F.col("label").cast("string").alias("label"), F.col("asr_top").cast("string").alias("text_pred"), F.col("omni_top").cast("string").alias("audio_pred"), F.when(v % 6 > 0, F.col("rrf_top").cast("string")).otherwise("").alias("noquery_pred"), (v % 13 == 0).alias("invalid"), (F.col("asr_top") == 0).alias("first"), F.coalesce("confidence", F.lit(0.0)).alias("overlap"), (10.0 + v % 5).alias("text_cost"), (30.0 + v % 7).alias("audio_cost"), F.lit(5.0).alias("noquery_cost"))
    rows = rows.withColumn("gate", F.explode(F.array(*[F.lit(g) for g in gates.AUDIO_GATES])))
    rows = rows.withColumn("triggered", gates.audio_choice(F.col("gate"), F.col("text_pred"), F.col("audio_pred"), F.col("noquery_pred"), F.col("invalid"), F.col("first"), F.col("overlap")))
    cost = gates.audio_cost(F.col("gate"), F.col("triggered"), F.col("text_cost"), F.col("audio_cost"), F.col("noquery_cost"))
    return rows.withColumns({"cost": cost, "ok": F.when(F.col("triggered"), F.col("audio_pred")).otherwise(F.col("text_pred")) == F.col("label"), "text_ok": F.col("text_pred") == F.col("label")})


def audio_metrics(rows: DataFrame) -> DataFrame:
    ok, text = F.col("ok"), F.col("text_ok")
    return rows.groupBy("gate").agg(F.count(F.lit(1)).alias("n"), metrics.rate(ok).alias("success"), metrics.rate(F.col("triggered")).alias("gate_rate"), F.count_if(ok & ~text).alias("rescues"), F.count_if(text & ~ok).alias("regressions"), metrics.mean(F.col("cost")).alias("mean_cost"))


@query(f"WITH {AUDIO_SQL} SELECT * FROM am")
def query_audio_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_metrics(audio_rows(spark, sf_dir))


@query(f"""WITH {AUDIO_SQL}, u AS (SELECT gate, n, success, regressions, mean_cost, round(success - (SELECT success FROM am WHERE gate = 'text_only') - 0.001 * mean_cost - 0.5 * regressions / n, 6) AS utility, success > (SELECT success FROM am WHERE gate = 'text_only') AND regressions / CAST(n AS DOUBLE) <= 0.2 AS accepted FROM am),
s AS (SELECT gate FROM u WHERE accepted ORDER BY utility DESC, success DESC, gate LIMIT 1)
SELECT gate, success, mean_cost, utility, accepted, gate = coalesce((SELECT gate FROM s), 'text_only') AS selected FROM u""")
def audio_gate_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted gate of the best utility (success less cost and regressions), else text only."""
    m = audio_metrics(audio_rows(spark, sf_dir))
    base = m.where("gate = 'text_only'").select(F.col("success").alias("b"))
    u = m.join(F.broadcast(base)).withColumns({"utility": R.rounded(F.col("success") - F.col("b") - 0.001 * F.col("mean_cost") - 0.5 * F.col("regressions") / F.col("n"), 6), "accepted": (F.col("success") > F.col("b")) & (F.col("regressions") / F.col("n") <= 0.2)})
    top = u.where("accepted").orderBy(F.desc("utility"), F.desc("success"), "gate").limit(1).agg(F.coalesce(F.max("gate"), F.lit("text_only")).alias("top"))
    return u.join(F.broadcast(top)).select("gate", "success", "mean_cost", "utility", "accepted", (F.col("gate") == F.col("top")).alias("selected"))


@query(f"""WITH {AUDIO_SQL}, p AS (SELECT gate, vec_id % 2 AS part, count(*) AS n, avg(CAST(ok AS INT)) AS s, avg(cost) AS c FROM ax GROUP BY 1, 2)
SELECT gate, CAST(sum(n) AS BIGINT) AS n, round(sum(s * n) / sum(n), 6) AS success, round(sum(c * n) / sum(n), 6) AS mean_cost FROM p GROUP BY gate""")
def audio_gate_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean and a stressed part (here by parity) mixed by their sizes, from the parts' summaries alone."""
    parts = audio_rows(spark, sf_dir).groupBy("gate", (F.col("vec_id") % 2).alias("part")).agg(F.count(F.lit(1)).alias("k"), F.avg(F.col("ok").cast("double")).alias("s"), F.avg("cost").alias("c"))
    mixed = lambda x: F.round(F.sum(F.col(x) * F.col("k")) / F.sum("k"), 6)
    return parts.groupBy("gate").agg(F.sum("k").alias("n"), mixed("s").alias("success"), mixed("c").alias("mean_cost"))


@query(f"""WITH {RUNS_SQL}, s AS (SELECT sample_id, count(DISTINCT prediction) AS distinct_predictions, max(CASE WHEN candidate = 'asr' THEN prediction END) AS base, max(CASE WHEN candidate = 'rrf' THEN prediction END) AS alt, any_value(target) AS target FROM runs GROUP BY sample_id)
SELECT count(*) AS n, round(avg(CAST(distinct_predictions > 1 AS INT)), 6) AS trigger_rate, round(avg(CAST(CASE WHEN distinct_predictions > 1 THEN alt ELSE base END = target AS INT)), 6) AS accuracy FROM s""")
def selective_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unstable over runs (more than one prediction) takes the fused answer."""
    r = runs(spark, sf_dir)
    of = lambda c: F.max(F.when(F.col("candidate") == c, F.col("prediction")))
    s = r.groupBy("sample_id").agg(F.count_distinct("prediction").alias("k"), of("asr").alias("base"), of("rrf").alias("alt"), F.max("target").alias("target"))
    return s.agg(F.count(F.lit(1)).alias("n"), metrics.rate(F.col("k") > 1).alias("trigger_rate"), metrics.rate(F.when(F.col("k") > 1, F.col("alt")).otherwise(F.col("base")) == F.col("target")).alias("accuracy"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, round(list_avg(v), 6) AS mean, round(list_aggregate(v, 'stddev_pop'), 6) AS std, round(list_max(v), 6) AS top FROM e""")
def stats_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics pooling over an array, in array functions."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    e = e.withColumn("m", mean)
    std = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / F.size("v"))
    return e.select("vec_id", F.round("m", 6).alias("mean"), F.round(std, 6).alias("std"), F.round(F.array_max("v"), 6).alias("top"))


@query("""WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)
SELECT vec_id, round(avg(v) FILTER (WHERE p % 4 = 0 AND (p // 4) % 2 = 0), 6) AS first, round(avg(v) FILTER (WHERE p % 4 = 3 AND (p // 4) % 2 = 0), 6) AS last FROM x GROUP BY vec_id""")
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector as frames of four numbers, of which every other is masked."""
    e = table(spark, sf_dir, "embeddings")
    n = F.floor(F.size("embedding") / 4).cast("int")
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("embedding", i * 4 + 1, 4))
    e = e.select("vec_id", frames.alias("frames"), F.transform(F.sequence(F.lit(0), n - 1), lambda i: i % 2 == 0).alias("mask"))
    e = e.withColumn("m", similarity.masked_mean(F.col("frames"), F.col("mask")))
    return e.select("vec_id", F.round(F.col("m")[0], 6).alias("first"), F.round(F.col("m")[3], 6).alias("last"))


@query(f"WITH {RUNS_SQL} SELECT candidate, round(avg(CAST(prediction = target AS INT)), 6) AS primary_rate, round(avg(CAST(rank <= 3 AS INT)), 6) AS aux_rate, round(avg(CAST(prediction <> target AND split_part(prediction, '_', 1) <> split_part(target, '_', 1) AS INT)), 6) AS unsafe_rate, round(avg(CAST(prediction = target AS INT)) + 0.1 * avg(CAST(rank <= 3 AS INT)) - 0.2 * avg(CAST(prediction <> target AND split_part(prediction, '_', 1) <> split_part(target, '_', 1) AS INT)), 6) AS utility FROM runs GROUP BY candidate")
def tool_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = lambda c: F.split_part(F.col(c), F.lit("_"), F.lit(1))
    ok, aux = F.col("prediction") == F.col("target"), F.col("rank") <= 3
    bad = ~ok & (family("prediction") != family("target"))
    a = lambda c: F.avg(c.cast("double"))
    return runs(spark, sf_dir).groupBy("candidate").agg(metrics.rate(ok).alias("primary_rate"), metrics.rate(aux).alias("aux_rate"), metrics.rate(bad).alias("unsafe_rate"), F.round(a(ok) + 0.1 * a(aux) - 0.2 * a(bad), 6).alias("utility"))
