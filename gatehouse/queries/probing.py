"""Probes of the driver's embeddings: 16 dimensions play a layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import portable_hash
from ..operators import metrics, sampling, similarity
from ..operators import order as O  # noqa: E741
from ..operators import manifests, probes
from ..views import HYBRID_SQL, hybrid, runs, RUNS_SQL, table
from .registry import hash_sql, registry

QUERIES, ORACLE_SQL, query = registry()
LAYERS, K = (0, 1, 2, 3), 5

PROBE_SQL = """x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
n AS (SELECT vec_id, p // 16 AS layer, sqrt(sum(v * v)) AS n FROM x GROUP BY 1, 2),
d AS (SELECT q.vec_id AS query, c.vec_id AS cand, q.p // 16 AS layer, sum(q.v * c.v) AS d FROM x q JOIN x c ON q.p = c.p WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2, 3),
s AS (SELECT query, cand, d.layer, round(d / (a.n * b.n), 6) AS score FROM d JOIN n a ON a.vec_id = query AND a.layer = d.layer JOIN n b ON b.vec_id = cand AND b.layer = d.layer WHERE d.layer < 4),
k AS (SELECT *, row_number() OVER (PARTITION BY query, layer ORDER BY score DESC, cand) AS rank FROM s),
f AS (SELECT k.*, unnest(['label', 'half']) AS factor, unnest([e.label, e.label // 5]) AS vote FROM k JOIN embeddings e ON e.vec_id = k.cand WHERE rank <= 5),
vt AS (SELECT query, layer, factor, vote, count(*) AS c, round(sum(score), 6) AS s FROM f GROUP BY 1, 2, 3, 4),
vp AS (SELECT *, row_number() OVER (PARTITION BY query, layer, factor ORDER BY c DESC, s DESC, vote) AS nth FROM vt),
pr AS (SELECT query, layer, factor, vote = CASE factor WHEN 'label' THEN e.label ELSE e.label // 5 END AS correct FROM vp JOIN embeddings e ON e.vec_id = query WHERE nth = 1),
pt AS (SELECT layer, factor, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM pr GROUP BY 1, 2)"""


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, layer, factor, correct): the five nearest neighbours' vote, by each layer's dimensions, all layers and factors in
    one pass over the vectors."""
    e = table(spark, sf_dir, "embeddings")
    near = similarity.top_k_views(e.where("vec_id % 50 = 0"), e, K, {str(layer): slice(16 * layer, 16 * layer + 16) for layer in LAYERS})
    factors = F.inline(F.array(F.struct(F.lit("label").alias("factor"), F.col("label")), F.struct(F.lit("half").alias("factor"), F.floor(F.col("label") / 5).cast("int").alias("label"))))
    labels = e.select("vec_id", factors)
    said = similarity.knn_vote(near, labels, extra=["view"], factor="factor")
    own = labels.withColumnRenamed("vec_id", "query")
    return said.join(own, ["query", "factor"]).select("query", F.col("view").cast("int").alias("layer"), "factor", (F.col("prediction") == F.col("label")).alias("correct"))


@query(f"WITH {PROBE_SQL} SELECT CAST(layer AS INT) AS layer, max(accuracy) FILTER (WHERE factor = 'label') AS label, max(accuracy) FILTER (WHERE factor = 'half') AS half FROM pt GROUP BY layer")
def layer_factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.layer_table(probes.accuracy(probed(spark, sf_dir), ["layer", "factor"]), "layer", "factor", ["label", "half"])


@query(f"WITH {PROBE_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY accuracy DESC, layer) AS nth FROM pt) SELECT factor, CAST(layer AS INT) AS layer, accuracy FROM b WHERE nth = 1")
def best_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best layer for each factor, chosen on the rows that it is reported on."""
    return probes.choose(probes.accuracy(probed(spark, sf_dir), ["layer", "factor"]), ["factor"], "layer", "accuracy", "layer")


DEV_SQL = PROBE_SQL + f""", dv AS (SELECT *, {hash_sql("'7'", "CAST(query AS VARCHAR)")} / 4294967296e0 < 0.5 AS val FROM pr), dt AS (SELECT layer, factor, val, round(avg(CAST(correct AS INT)), 6) AS a FROM dv GROUP BY 1, 2, 3),
dc AS (SELECT factor, layer, a, row_number() OVER (PARTITION BY factor ORDER BY a DESC, layer) AS nth FROM dt WHERE val)"""


@query(f"WITH {DEV_SQL} SELECT dc.factor, CAST(dc.layer AS INT) AS layer, dc.a AS devval, dt.a AS accuracy FROM dc JOIN dt ON dc.factor = dt.factor AND dc.layer = dt.layer AND NOT dt.val WHERE nth = 1")
def dev_selected_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best layer on an inner part, reported on the other."""
    rows = probed(spark, sf_dir).withColumn("part", probes.group_split(F.col("query").cast("string"), 0.5, 7))
    table_ = probes.accuracy(rows, ["layer", "factor", "part"])
    picked = probes.choose(table_.where("part = 'val'"), ["factor"], "layer", "accuracy", "layer").withColumnRenamed("accuracy", "devval")
    return picked.join(table_.where("part = 'fit'").select("factor", "layer", "accuracy"), ["factor", "layer"])


@query(f"""WITH {PROBE_SQL}, m AS (SELECT CASE layer WHEN 0 THEN 'baseline' WHEN 1 THEN 'label' WHEN 2 THEN 'half' ELSE 'other' END AS cond, layer AS place, factor, accuracy FROM pt),
rw AS (SELECT cond, place, factor, round(1 - accuracy, 6) AS reward FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY reward DESC, place) AS nth FROM rw), t AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY accuracy DESC, place) AS nth FROM m)
SELECT p.factor, p.cond AS selected, reward, o.accuracy AS test_selected, b.accuracy AS test_baseline, t.cond = p.factor AS diagonal, round(o.accuracy - b.accuracy, 6) AS delta FROM p JOIN m o ON o.factor = p.factor AND o.cond = p.cond JOIN m b ON b.factor = p.factor AND b.cond = 'baseline' JOIN t ON t.factor = p.factor AND t.nth = 1 WHERE p.nth = 1""")
def conditioning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers as conditionings; the reward is the error, so that it differs from the test."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("baseline", "label", "half", "other")]), F.col("layer") + 1)
    t = probes.accuracy(probed(spark, sf_dir), ["layer", "factor"]).select(name.alias("cond"), F.col("layer").alias("place"), "factor", "accuracy")
    return probes.conditioning_report(t, t.select("cond", "place", "factor", F.round(1 - F.col("accuracy"), 6).alias("reward")), "baseline")


@query(f"""WITH {HYBRID_SQL}, g AS (SELECT vec_id, target, {hash_sql("'13'", "target")} % 3 AS fold, asr_rank = 1 AS base, omni_rank = 1 AS sel FROM h)
SELECT CAST(fold AS INT) AS fold, count(*) AS n, count(DISTINCT target) AS groups, round(avg(CAST(base AS INT)), 6) AS acc_base, round(avg(CAST(sel AS INT)), 6) AS acc_sel, round(avg(CAST(sel AS INT) - CAST(base AS INT)), 6) AS delta FROM g GROUP BY 1""")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds that share no group, and both arms' accuracy in each."""
    base, sel = F.col("asr_rank") == 1, F.col("omni_rank") == 1
    rows = hybrid(spark, sf_dir).withColumn("fold", sampling.group_fold(F.col("target"), 3, 13))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("groups"), metrics.rate(base).alias("acc_base"), metrics.rate(sel).alias("acc_sel"), metrics.mean(sel.cast("double") - base.cast("double")).alias("delta"))


@query(f"""WITH {RUNS_SQL}, c AS (SELECT candidate, count(*) AS n, round(avg(CAST(hit AS INT)), 6) AS accuracy FROM runs GROUP BY candidate), d AS (SELECT *, round(accuracy - 0.05, 6) AS ci_low, round(accuracy + 0.05, 6) AS ci_high, 0.1e0 AS chance FROM c)
SELECT candidate, accuracy, round(accuracy / chance, 2) AS ratio_over_chance, ci_low > chance AS ci_excludes_chance FROM d""")
def above_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = probes.accuracy(runs(spark, sf_dir).withColumnRenamed("hit", "correct"), ["candidate"])
    a = F.col("accuracy")
    return probes.above_chance(rows.withColumns({"ci_low": F.round(a - 0.05, 6), "ci_high": F.round(a + 0.05, 6), "chance": F.lit(0.1)})).select("candidate", "accuracy", "ratio_over_chance", "ci_excludes_chance")


@query("""WITH v AS (SELECT vec_id, [embedding[1], embedding[2], embedding[1], embedding[4]] AS s FROM embeddings), o AS (SELECT vec_id, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS i FROM v)
SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY x DESC, i) AS plain, string_agg(CAST(i AS VARCHAR), ',' ORDER BY x DESC, i) AS moved FROM o GROUP BY vec_id""")
def affine_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with a tie keep their order under 2 x score - 3."""
    x = F.col("embedding")
    s = F.transform(F.array(x[0], x[1], x[0], x[3]), lambda v: v.cast("double"))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return table(spark, sf_dir, "embeddings").select("vec_id", text(probes.rank_order(s)).alias("plain"), text(probes.affine_rank_order(s, 2.0, -3.0)).alias("moved"))


@query(f"""WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {hash_sql("'4'", "CAST(doc_id AS VARCHAR)")}, doc_id) AS nth FROM documents) SELECT doc_id, lang FROM o WHERE nth <= (SELECT CAST(ceil(50e0 / count(DISTINCT lang)) AS BIGINT) FROM documents)""")
def stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 50 documents, as many of each language."""
    return probes.per_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 50, 4)


DRAW_SQL = f"""cd AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {hash_sql("'8'", "CAST(doc_id AS VARCHAR)")}, doc_id) - 1 AS nth FROM documents),
dr AS (SELECT doc_id, lang, CASE WHEN nth < 8 THEN 'card' ELSE 'eval' END AS part, CASE WHEN nth < 6 THEN CAST(nth // 3 AS INT) END AS draw FROM cd)"""


@query(f"WITH {DRAW_SQL} SELECT * FROM dr")
def card_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two disjoint draws of three cards a language out of eight; all others are evaluated."""
    return probes.card_draws(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 8, 2, 3, 8)


ARMS = ["naive", "schema", "policy"]


@query(f"""WITH {HYBRID_SQL}, hh AS (SELECT vec_id, draw, unnest(['naive', 'schema', 'policy']) AS arm, unnest([asr_rank <= draw + 1, omni_rank <= draw + 1, rrf_rank = 1]) AS hit FROM h, (SELECT unnest([0, 1]) AS draw)),
mh AS (SELECT vec_id, avg(CAST(hit AS INT)) FILTER (WHERE arm = 'naive') AS n, avg(CAST(hit AS INT)) FILTER (WHERE arm = 'schema') AS s, avg(CAST(hit AS INT)) FILTER (WHERE arm = 'policy') AS p FROM hh GROUP BY vec_id),
ct AS (SELECT unnest(['schema_effect', 'policy_effect', 'total']) AS contrast, unnest([s - n, p - s, p - n]) AS d FROM mh)
SELECT contrast, count(*) AS n, round(avg(d), 6) AS delta, count(*) FILTER (WHERE d > 0) AS fixes, count(*) FILTER (WHERE d < 0) AS regressions FROM ct GROUP BY contrast""")
def factor_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arms over two draws; a sample's hits are averaged before arms are compared."""
    draws = F.explode(F.array(F.lit(0), F.lit(1)))
    h = hybrid(spark, sf_dir).select("vec_id", "asr_rank", "omni_rank", "rrf_rank", draws.alias("draw"))
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), c.alias("hit")) for a, c in zip(ARMS, (F.col("asr_rank") <= F.col("draw") + 1, F.col("omni_rank") <= F.col("draw") + 1, F.col("rrf_rank") == 1), strict=True)])
    pairs = {"schema_effect": ("schema", "naive"), "policy_effect": ("policy", "schema"), "total": ("policy", "naive")}
    return probes.factor_contrasts(h.select("vec_id", "draw", F.inline(arms)), "vec_id", ARMS, pairs)


MOVE_SQL = """x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings), q AS (SELECT vec_id, p % 16 AS p, max(v) FILTER (WHERE p < 16) AS a, max(v) FILTER (WHERE p >= 16 AND p < 32) AS b, max(v) FILTER (WHERE p >= 32 AND p < 48) AS c FROM x GROUP BY 1, 2),
mv AS (SELECT vec_id, 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS move, 1 - sum(b * c) / (sqrt(sum(b * b)) * sqrt(sum(c * c))) AS sens, sqrt(sum((a - b) * (a - b))) AS gap FROM q GROUP BY vec_id)"""


@query(f"""WITH {MOVE_SQL}, m AS (SELECT round(avg(move), 6) AS move_mean, round(median(move), 6) AS move_p50, round(max(move), 6) AS move_max, round(avg(sens), 6) AS sens_mean, round(median(sens), 6) AS sens_p50, round(max(sens), 6) AS sens_max FROM mv)
SELECT *, CASE WHEN move_mean < 0.01 THEN 'query ignores its context' WHEN sens_mean < 0.01 THEN 'context shifts, labels do not matter' ELSE 'label sensitive' END AS verdict FROM m""")
def context_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stretches of an embedding as the query without, with right and with wrong demos."""
    part = lambda k: F.slice("embedding", 16 * k + 1, 16)
    rows = table(spark, sf_dir, "embeddings").select((1 - probes.cosine(part(0), part(1))).alias("move"), (1 - probes.cosine(part(1), part(2))).alias("sens"))
    return probes.moves(rows)


@query(f"WITH {MOVE_SQL} SELECT vec_id, round(gap, 4) AS gap FROM mv")
def demo_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a demo moves the vector: the length of the difference."""
    part = lambda k: F.slice("embedding", 16 * k + 1, 16)
    gap = F.sqrt(F.aggregate(probes.minus(part(0), part(1)), F.lit(0.0), lambda s, v: s + v * v))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(gap, 4).alias("gap"))


@query("""SELECT vec_id, 'text:passage: h|audio:a' || vec_id || '|text: one. |audio:b|text: two. |audio:q' AS document FROM embeddings""")
def demo_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    demo = lambda clip, label: F.struct(clip.alias("clip"), F.lit(label).alias("label"))
    demos = F.array(demo(F.concat(F.lit("a"), F.col("vec_id").cast("string")), "one"), demo(F.lit("b"), "two"))
    doc = probes.demo_document(demos, F.lit("q"), "h")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(doc, lambda p: F.concat(p["type"], F.lit(":"), p["value"])), "|").alias("document"))


@query("""SELECT doc_id, lang FROM documents""")
def full_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of a data set, checked to be disjoint."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return manifests.full_pool(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 <> 0"), "doc_id")


@query(f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_sql("'6'", "CAST(doc_id AS VARCHAR)")}, doc_id) - 1 AS nth, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN nth < greatest(1, CAST(floor(n * 0.7) AS BIGINT)) THEN 'fit' ELSE 'val' END AS part FROM o""")
def inner_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.inner_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.7, 6)


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_quantity, l_orderkey * 8 + l_linenumber) - 1 AS nth FROM lineitem) SELECT l_orderkey, l_linenumber, nth FROM o""")
def exact_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's place by quantity, of which there are 50, ties by its key: numbered without one task that sees all."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"))
    return O.ranked(rows, "l_quantity", "key").select("l_orderkey", "l_linenumber", "nth")
