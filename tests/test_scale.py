"""Paths that only large inputs take, and plans that must not gather rows in one task."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse import shared
from gatehouse.functions import text
from gatehouse.operators import fitting, gates, metrics, order, probes, resample, similarity
from gatehouse.plans import commands
from gatehouse.queries import evaluation


def test_draws_of_many_rows_are_multinomial(spark):
    counts = spark.createDataFrame([("big", 3_000_000_000, 300_000_000, 150_000_000), ("mid", 5000, 600, 350), ("none", 2000, 0, 0)], "name string, n long, fixes long, regressions long")
    got = resample.drawn(counts, ["name"], 2000, 42).groupBy("name").agg(F.count("*").alias("rounds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).collect()
    for r in got:
        n, f, g = {"big": (3e9, 3e8, 1.5e8), "mid": (5000, 600, 350), "none": (2000, 0, 0)}[r.name]
        mean = (f - g) / n
        sd = np.sqrt(((f + g) / n - mean**2) / n)
        assert r.rounds == 2000 and abs(r.mean - mean) <= 4 * sd / np.sqrt(2000) + 1e-12 and abs(r.sd - sd) <= 0.1 * sd + 1e-12
    again = resample.drawn(counts.repartition(3), ["name"], 50, 42)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, resample.drawn(counts, ["name"], 50, 42).collect()))


def test_binomials_invert_their_distribution():
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.02), (300, 0.9)):
        mass = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        upto = np.cumsum(mass)
        u = np.random.default_rng(1).random(500)
        want = np.searchsorted(upto, u, side="right")
        assert (resample.binomial(np.full(500, n), p, u) == want).all()
    assert resample.binomial(np.array([0, 5]), 1.0, np.array([0.1, 0.2])).tolist() == [0, 5]
    mixed = np.array([3, 9, 3, 0, 9])
    u = np.array([0.2, 0.9, 0.7, 0.5, 0.01])
    assert resample.binomial(mixed, 0.4, u).tolist() == [int(resample.binomial(np.array([n]), 0.4, np.array([x]))[0]) for n, x in zip(mixed, u, strict=True)]


def test_draws_hang_on_the_seed_and_round_alone():
    weights = np.array([5, 0, 120, 33, 1, 1, 840])
    whole = resample.drawn_counts(weights, range(60), 9)
    assert (whole.sum(1) == 1000).all() and (whole[:, 1] == 0).all()
    assert (whole[20:35] == resample.drawn_counts(weights, range(20, 35), 9)).all()
    assert (whole != resample.drawn_counts(weights, range(60), 10)).any()
    assert abs(resample.drawn_counts(weights, range(3000), 1).mean(0) - weights).max() < 1


def test_blocks_find_their_own_counts():
    for groups in (1, 5, 8, 9, 61, 64):
        whole = resample.drawn_counts(np.ones(groups, np.int64), range(40), 3)
        parts = np.concatenate([resample.block_counts(groups, k, range(40), 3, 8) for k in range(-(-groups // 8))], 1)
        assert (parts[:, :groups] == whole).all() and (parts[:, groups:] == 0).all()


def test_cluster_bootstrap_of_many_groups(spark, monkeypatch):
    """Blocks of eight groups give what one block gives; 200,000 groups are never in one row."""
    rows = [(k % 61, float((k * 7) % 5 - 1)) for k in range(900)]
    df = spark.createDataFrame(rows, "g long, d double").repartition(3)
    one = resample.cluster_bootstrap(df, "g", "d", 700, 5).first()
    monkeypatch.setattr(resample, "GROUPS", 8)
    assert resample.cluster_bootstrap(df, "g", "d", 700, 5).first() == one
    monkeypatch.undo()
    many = spark.range(400_000).select((F.col("id") % 200_000).alias("g"), (F.col("id") % 3 - 1.0).alias("d"))
    got = resample.cluster_bootstrap(many, "g", "d", 40, 5).first()
    assert (got.n, got.groups) == (400_000, 200_000) and -0.01 < got.ci_low <= got.delta <= got.ci_high < 0.01


def test_cluster_bootstrap_of_more_groups_than_a_block_matches_sql(spark):
    """300 groups take nine levels, one more than a block has (and than the SQL of grouped_cv_interval)."""
    rows = [(k % 300, float((k * k) % 5 - 1)) for k in range(1000)]
    got = resample.cluster_bootstrap(spark.createDataFrame(rows, "g long, d double").repartition(3), "g", "d", 200, 5).first()
    tree = evaluation.tree_sql("kt", "ka", "one", 9, 200, "'5'")
    want = duckdb.sql(f"""WITH r AS (SELECT unnest(range(1000)) AS k), gs AS (SELECT k % 300 AS j, count(*) AS n, sum((k * k) % 5 - 1) AS s FROM r GROUP BY 1), ka AS (SELECT 'all' AS one, j, 1 AS w FROM gs), {tree},
    b AS (SELECT round, sum(x * s) / CAST(sum(x * n) AS DOUBLE) AS value FROM kt JOIN gs USING (j) GROUP BY round) SELECT round(quantile_cont(value, 0.025), 6), round(quantile_cont(value, 0.975), 6) FROM b""").fetchall()[0]
    assert got.groups == 300 and (got.ci_low, got.ci_high) == want


def test_student_t_of_any_number_of_seeds(spark):
    known = {1: 12.706204736, 2: 4.302652730, 3: 3.182446305, 4: 2.776445105, 10: 2.228138852, 11: 2.200985160, 30: 2.042272456, 101: 1.983731003, 1000: 1.962339081}
    df = spark.createDataFrame([(k,) for k in known], "df long")
    assert all(abs(r.t - known[r.df]) < 1e-8 for r in df.select("df", resample.t_quantile(0.95, F.col("df")).alias("t")).collect())
    seeds = spark.createDataFrame([("a", float(k % 7)) for k in range(200)] + [("b", 1.0)], "name string, v double")
    got = {r.name: r for r in resample.t_interval(seeds, ["name"], "v").collect()}
    v = np.arange(200) % 7
    half = 1.971956544 * v.std(ddof=1) / np.sqrt(200)
    assert abs(got["a"].ci_low - (v.mean() - half)) < 1e-5 and abs(got["a"].ci_high - (v.mean() + half)) < 1e-5
    assert got["b"].n == 1 and got["b"].ci_low is None


def pair_rows(r, n):
    maybe = lambda x: None if r.random() < 0.1 else round(x, 2)
    return [(r.randint(1, 7), r.randint(1, 7), maybe(r.random()), maybe(r.random()), r.random(), r.random(), r.random() < 0.4) for _ in range(n)]


def test_the_sweep_of_pair_gates_matches_each_threshold_alone(spark):
    r = random.Random(8)
    schema = "base_rank int, alt_rank int, base_margin double, alt_margin double, base_top double, alt_top double, agree boolean"
    df = spark.createDataFrame(pair_rows(r, 300), schema).repartition(3)
    points = fitting.pair_points(df)
    assert all(v == sorted(v) and len(v) <= 100 for v in points.values()) and len(points["top_score_advantage"]) == 100
    board = fitting.pair_leaderboard(df, points).collect()
    assert len(board) == 2 + sum(map(len, points.values())) and sorted(x.place for x in board) == list(range(1, len(board) + 1))
    for x in r.sample(board, 12) + board[:3]:
        grid = spark.createDataFrame([(x.policy, x.t)], "policy string, t double")
        (alone,) = gates.chosen_metrics(fitting.gated(df, grid), ["policy", "t"]).collect()
        assert all(abs(alone[c] - x[c]) < 1e-6 if isinstance(alone[c], float) else alone[c] == x[c] for c in alone.asDict()), x


def test_the_sweep_takes_ten_million_rows(spark):
    rows = spark.range(10_000_000).select((F.col("id") % 5 + 1).cast("int").alias("base_rank"), (F.col("id") % 3 + 1).cast("int").alias("alt_rank"), ((F.col("id") % 1009) / 1009).alias("base_margin"), ((F.col("id") % 997) / 997).alias("alt_margin"), F.lit(0.5).alias("base_top"), ((F.col("id") % 7) / 7).alias("alt_top"), (F.col("id") % 11 == 0).alias("agree"))
    board = fitting.pair_leaderboard(rows, {"raw_low_margin": [0.1, 0.5], "alt_high_margin": [0.2, 0.9]}).collect()
    assert len(board) == 6 and all(x.n == 10_000_000 for x in board)
    low = next(x for x in board if x.policy == "raw_low_margin" and x.t == 0.5)
    assert abs(low.alternate_rate - 505 / 1009) < 1e-4


def test_the_threshold_sweep_matches_each_threshold_alone(spark):
    r = random.Random(9)
    label = lambda: f"{r.choice('ab')}_{r.randrange(3)}"
    data = [(k, label(), label(), label(), None if r.random() < 0.1 else r.random() / 4) for k in range(400)]
    df = spark.createDataFrame(data, "sample_id long, base string, alt string, target string, base_margin double")
    got = {x.mode: x.threshold for x in fitting.select_threshold(df, []).collect()}
    points = {*fitting.FAMILY_POINTS, *(round(m, 4) for *_, m in data if m is not None)}
    for mode in fitting.FITTED_MODES:
        def score(t):
            used = [m is not None and m < t and (mode == "margin_low" or b[0] == a[0]) for _, b, a, _, m in data]
            said = [(a if u else b) == c for (_, b, a, c, _), u in zip(data, used, strict=True)]
            lost = sum(b == c and not s for (_, b, _, c, _), s in zip(data, said, strict=True))
            return (-round(sum(said) / 400, 6), lost, round(sum(used) / 400, 6), t)

        assert got[mode] == min(points, key=score)
    assert {m: t for m, t in got.items() if m not in fitting.FITTED_MODES} == {m: 0.0 for m in fitting.MATRIX_MODES if m not in fitting.FITTED_MODES}


def test_rows_are_numbered_in_order_with_hot_values(spark):
    r = random.Random(2)
    data = [(k, None if k % 17 == 0 else 3.5 if k % 3 else r.random() * 9) for k in r.sample(range(10**6), 4000)]
    df = spark.createDataFrame(data, "id long, v double").repartition(5)
    got = order.ranked(df, "v", "id", "nth", "total").collect()
    want = sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))
    assert [(x.id, x.v) for x in sorted(got, key=lambda x: x.nth)] == want and [x.nth for x in sorted(got, key=lambda x: x.nth)] == list(range(4000))
    assert {x.total for x in got} == {4000}
    assert "SinglePartition" not in order.ranked(df, "v", "id")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert order.ranked(df.limit(0), "v", "id").collect() == []
    numbers = order.dense(df.select((F.col("id") * 7).alias("i")), "i").collect()
    assert [x.nth for x in sorted(numbers, key=lambda x: x.i)] == list(range(4000))
    sparse = order.dense(df.select(F.xxhash64("id").alias("i")), "i").collect()
    assert [x.nth for x in sorted(sparse, key=lambda x: x.i)] == list(range(4000))


def test_order_statistics_without_gathering_values(spark):
    r = random.Random(6)
    values = [r.choice([1, 5, 5, 5, r.randrange(10**6)]) for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long").repartition(5)
    got = metrics.order_quantiles(df, "v").first()
    ordered = sorted(values)
    assert (got.n, got.max, got.p50, got.p95) == (3001, ordered[-1], ordered[1500], ordered[int(0.95 * 3001)])
    empty = metrics.order_quantiles(df.where("v < 0"), "v").first()
    assert empty.n is None and empty.p50 is None


def test_search_by_cells_matches_search_in_one_block(spark, monkeypatch):
    g = np.random.default_rng(4)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.round(g.normal(size=(300, 8)), 1))] + [(300, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = lambda: sorted(map(tuple, similarity.top_k(df, df, 4).collect()))
    whole = found()
    assert len(whole) == 1200
    monkeypatch.setattr(similarity, "BLOCK", 37)
    monkeypatch.setattr(similarity, "CELL", 50)
    assert found() == whole
    assert similarity.top_k(df.limit(0), df, 4).collect() == [] and similarity.top_k(df, df.limit(0), 4).collect() == []


def test_spread_takes_even_places(spark):
    df = spark.createDataFrame([(x / 7,) for x in range(350)] * 2 + [(None,)], "m double")
    values = sorted({x / 7 for x in range(350)})
    got = sorted(r.m for r in fitting.spread(df, "m").collect())
    assert got == sorted({values[round(i * 349 / 99)] for i in range(100)})
    assert [r.m for r in fitting.spread(df.where("m < 0"), "m").collect()] == [0.0]


def test_value_counts_keep_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("",), ("c",)], "x string")
    assert [tuple(r) for r in metrics.value_counts(df, ["x"], 2).orderBy("n", "value").collect()] == [("x", "a", 2), ("x", "b", 2)]


def test_errors_of_probes_and_plans(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(20)], "id long, label string")
    with pytest.raises(ValueError):
        probes.card_draws(df, "id", "label", 4, 3, 2, 1)
    with pytest.raises(Exception, match="too few rows"):
        probes.card_draws(df, "id", "label", 10, 2, 2, 1).collect()
    with pytest.raises(ValueError):
        probes.affine_rank_order(F.array(F.lit(1.0)), 0.0, 1.0)
    assert probes.pool_spec("audio_std") == ("audio", "std") and probes.pool_spec("all") == ("all", "mean")
    with pytest.raises(ValueError):
        probes.pool_spec("all_last")
    assert probes.conditionings(["baseline", "x"], {"x": "told"}, {}) == {"baseline": None, "x": "told"}
    with pytest.raises(ValueError):
        commands.argv({"step": "other"})
    assert commands.argument("--seed", 0) == ["--seed", "0"] and commands.argument("--n", 0) == [] and commands.argument("--on", True) == ["--on"]


def test_written_tables_leave_no_shuffles_and_no_settings(spark):
    before = spark.conf.get(shared.CLEANUP, None)
    rows = spark.range(1000).withColumn("g", F.col("id") % 7)
    sums = rows.groupBy("g").agg(F.sum("id").alias("s"))
    out = shared.materialize(sums, "sums")
    assert spark.conf.get(shared.CLEANUP, None) == before
    want = sorted(map(tuple, sums.collect()))  # what led to it can be run again
    assert sorted(map(tuple, out.collect())) == want and out.schema == sums.schema
    with shared.scratch(spark, keep=1):
        first, last = shared.materialize(sums, "first"), shared.materialize(sums, "last")
    assert sorted(map(tuple, last.collect())) == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(first._gatehouse_path)
    shared.release(last)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(last._gatehouse_path)


def test_no_cell_of_a_cut_bank_is_lost(spark):
    """Both sides of a cell meet, into however many partitions they are dealt out."""
    g = np.random.default_rng(8)
    rows = spark.createDataFrame([(k, [float(x) for x in g.normal(size=4)]) for k in range(30)], "id long, embedding array<double>")
    labels = spark.createDataFrame([(k, [float(x) for x in g.normal(size=4)]) for k in range(11)], "label long, vector array<double>")
    views = {"asr": slice(0, 2), "omni": slice(None)}
    want = sorted(map(tuple, similarity.rank_views(rows, labels, ["id"], views).collect()))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, similarity.rank_views(rows, labels, ["id"], views, most_labels=4).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(want) == 330 and got == want


def test_evidence_makes_its_answer_once_a_text(spark):
    """Not in the lambda that goes over the sentences, where a text would cost its sentences times its length."""
    long = " ".join(f"Line {k} is here." for k in range(3000))
    texts = [(0, long + " The end is near. Or not."), (1, long), (2, "no stop"), (3, ""), (4, None), (5, "One. TWO here. two")]
    answers = {0: "END", 1: "line 2999", 2: "x", 3: "", 4: None, 5: "two"}
    df = spark.createDataFrame([(k, t, answers[k]) for k, t in texts], "id long, t string, a string")
    out = df.select("id", text.choose_evidence("t", F.concat(F.lit(""), F.replace("a", F.lit("marker"))), 80).alias("e"))
    assert {r.id: r.e for r in out.collect()} == {0: "The end is near.", 1: "Line 2999 is here.", 2: "no stop", 3: "", 4: "", 5: "TWO here."}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("marker") == 1
