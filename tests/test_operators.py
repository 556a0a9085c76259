"""Semantics that are easy to get wrong, on rows written by hand."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gatehouse.functions import parsing as P
from gatehouse.functions import ranking as R
from gatehouse.functions import text as T
from gatehouse.operators import fusion, gates, metrics, rag, resample, routing, sampling, selection, similarity
from gatehouse.plans import instructions, steps
from gatehouse.sources import readers, sinks
from gatehouse.streaming import resume


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_interval_conventions():
    at = {c: tuple(f(200) for f in pair) for c, pair in resample.CONVENTIONS.items()}
    assert at == {"A": (4, 195), "B": (5, 195), "C": (4, 194), "D": (5, 194)}
    assert [f(1) for f in resample.CONVENTIONS["D"]] == [0, 0]


def test_margins_and_gates(spark):
    df = spark.createDataFrame([([Row(score=0.9), Row(score=0.7)],), ([Row(score=0.9)],), ([],), (None,)], "s array<struct<score:double>>")
    got = [tuple(None if v is None else round(v, 6) for v in r) for r in df.select(*[R.margin(F.col("s"), m) for m in ("null", "zero", "inf")]).collect()]
    assert got == [(0.2, 0.2, 0.2)] + [(None, 0.0, float("inf"))] * 3
    r = one(spark, strict=R.gate(F.lit(0.1), 0.1, False), low=R.gate(F.lit(0.1), 0.1, True), none=R.gate(F.lit(None).cast("double"), 0.1, True))
    assert tuple(r) == (False, True, False)


def test_rank_fallbacks_differ(spark):
    df = spark.createDataFrame([(None, 3, 2, "a", "a"), (None, None, None, "a", "b")], "text_rank long, sample_rank long, rank long, prediction string, target string")
    orders = [("text_rank", "sample_rank", "rank"), ("rank", "text_rank", "sample_rank")]
    assert [tuple(r) for r in df.select(*[R.rank_value(o, df.columns) for o in orders]).collect()] == [(3, 2), (R.NO_RANK, R.NO_RANK)]
    with pytest.raises(ValueError):
        R.rank_value(("x",), ["y"])


def test_buckets_are_not_ntile(spark):
    got = [r[0] for r in spark.range(10).select(R.bucket(F.col("id"), F.lit(10), 4)).collect()]
    assert got == [i * 4 // 10 for i in range(10)]


def test_rank_metrics_of_a_few_ranks_and_of_none(spark):
    df = spark.createDataFrame([(1,), (2,), (6,)], "rank long")
    r = metrics.rank_metrics(df, "rank", recalls=(3,)).first()
    assert (r.n, r.acc_at_1, r.recall_at_3, r.mean_rank, r.mrr) == (3, 0.333333, 0.666667, 3.0, 0.555556)
    r = metrics.rank_metrics(df.where("rank > 9"), "rank").first()
    assert (r.n, r.acc_at_1, r.mrr, r.mean_rank) == (0, 0.0, 0.0, 0.0)


def test_order_quantiles(spark):
    values = [5, 1, 9, 9, 2, 7, 7, 3]
    r = metrics.order_quantiles(spark.createDataFrame([(v,) for v in values], "v long"), "v").first()
    s = sorted(values)
    assert (r.n, r["max"], r.p50, r.p95) == (8, 9, s[4], s[int(0.95 * 8)])


HYBRID = "sample_id string, asr_rank long, omni_rank long, rrf_rank long, best_of_two_rank long, disagreement boolean, confidence double, query_style string, tts_dialect string, asr_wer double, asr_margin double, omni_margin double"


def test_routes(spark):
    df = spark.createDataFrame([("a", 1, 2, 1, 1, True, 0.9, "clean", None, None, 0.5, 0.1), ("b", 4, 1, 1, 1, True, 0.4, "wu", None, None, 0.01, 0.2), ("c", 2, 3, 4, 2, False, None, "", "", 0.7, None, None)], HYBRID)
    rows = {(r.sample_id, r.policy): (r.routed, r.source, r["rank"]) for r in routing.routed(df).collect()}
    assert rows["a", "dialect_aware_branch"] == (False, "asr", 1) and rows["b", "dialect_aware_branch"] == (True, "omni", 1)
    assert rows["c", "dialect_aware_branch"] == (True, "omni", 3) and rows["c", "asr_confidence_branch"] == (False, "asr", 2)
    assert rows["a", "disagreement_rerank"] == (True, "fallback_rrf", 1)
    board = {r.policy: r for r in routing.leaderboard(routing.routed(df.where("sample_id != 'c'")), 50).collect()}
    assert board["rrf"].acc_at_1 == 1.0 and board["dialect_aware_branch"].rescue_count == 1 and board["asr_primary"].rescue_rate == 0.0
    assert board["disagreement_rerank"].api_call_rate == 1.0 and board["rrf"].api_call_rate == 0.0
    rules = routing.under_rules(df, routing.offline_policies())
    assert rules.where("policy_id = 'confidence_below_0.5_to_omni'").select("sample_id", "action").collect() == [Row("a", "asr"), Row("b", "omni"), Row("c", "asr")]
    assert len(routing.offline_policies()) == 20


def test_fusion(spark):
    long = spark.createDataFrame([("q", 1, "b", 1), ("q", 1, "a", 2), ("q", 2, "a", 1), ("q", 2, "c", 2), ("q", 2, "d", 3)], "query string, source int, cand string, rank int")
    got = fusion.rrf(long, "query", "cand", "rank", "source").orderBy("rank").collect()
    assert [r.cand for r in got] == ["a", "b", "c", "d"]
    tie = spark.createDataFrame([("q", 1, "x", 1), ("q", 2, "y", 1)], "query string, source int, cand string, rank int")
    assert [r.cand for r in fusion.rrf(tie, "query", "cand", "rank", "source").orderBy("rank").collect()] == ["x", "y"]
    r = one(spark, m=fusion.merged(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c")), 26))
    assert r.m == ["b", "a", "c"]


def test_pair_gates(spark):
    args = lambda policy, agree: gates.pair_choice(F.lit(policy), F.lit(0.1), F.lit(0.1), F.lit(0.3), F.lit(0.5), F.lit(0.55), F.lit(agree))
    r = one(spark, a=args("raw_low_margin", False), b=args("alt_margin_advantage", False), c=args("top_score_advantage", False), d=args("disagreement_raw_low_margin", True))
    assert tuple(r) == (True, True, False, True)


def test_vote_ties_go_to_the_base_run(spark):
    df = spark.createDataFrame([("k", "r1", "x", 2), ("k", "r2", "y", 1), ("m", "r1", "x", 1), ("m", "r2", "y", 1), ("m", "r3", "y", 1)], "key string, run string, prediction string, rank long")
    got = {r.key: r for r in gates.vote(df, "key", "run", "prediction", "rank", "r1").collect()}
    assert (got["k"].prediction, got["k"].tie, got["k"].agreement) == ("x", True, 0.5)
    assert (got["m"].prediction, got["m"].votes, got["m"].base_votes, got["m"].vote_margin) == ("y", 2, 1, 0.333333)


def test_budget_is_spent_in_row_order(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "i long, low boolean")
    assert sorted(r.i for r in gates.budgeted(df, "low", ["i"], 3).where("spent").collect()) == [0, 2, 4]


def test_audio_costs_count_every_branch(spark):
    cost = lambda gate, hit: gates.audio_cost(F.lit(gate), F.lit(hit), F.lit(1.0), F.lit(10.0), F.lit(100.0))
    r = one(spark, a=cost("audio_on_text_audio_disagreement", False), b=cost("audio_on_invalid", False), c=cost("audio_on_text_equals_noquery", False), d=cost("audio_on_disagreement_or_text_equals_noquery", False), e=cost("audio_only", True))
    assert tuple(r) == (11.0, 1.0, 101.0, 111.0, 10.0)


def test_splits(spark):
    df = spark.range(10).withColumn("k", F.col("id").cast("string"))
    placed = sampling.placed(df, "k", 7)
    assert sorted(r.nth for r in placed.collect()) == list(range(10)) and {r.n for r in placed.collect()} == {10}
    count = lambda least: {r.s: r.c for r in placed.groupBy(sampling.three_way(F.col("nth"), F.col("n"), 0.2, 0.3, least).alias("s")).agg(F.count("*").alias("c")).collect()}
    assert count(1) == {"proposal": 2, "selection": 3, "locked_test": 5}
    tiny = sampling.placed(df.where("id < 3"), "k", 7)
    assert {r.s for r in tiny.select(sampling.three_way(F.col("nth"), F.col("n"), 0.1, 0.4).alias("s")).collect()} == {"selection", "locked_test"}
    again = {r.k: r.nth for r in sampling.placed(df.repartition(5), "k", 7).collect()}
    assert again == {r.k: r.nth for r in placed.collect()}


def test_groups_stay_in_one_fold_and_negatives_have_another_label(spark):
    df = spark.range(60).select("id", (F.col("id") % 6).cast("string").alias("g"))
    folds = df.select("g", sampling.group_fold(F.col("g"), 3, 1).alias("f")).distinct().groupBy("g").count()
    assert {r["count"] for r in folds.collect()} == {1}
    neg = sampling.negatives(df, df, "id", "g", 4, 9)
    joined = neg.join(df, "id").join(df.select(F.col("id").alias("cand"), F.col("g").alias("h")), "cand")
    assert joined.count() == 240 and joined.where("g = h").count() == 0


def test_holm_and_intervals(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r.name: r.p_holm for r in resample.holm(df, "name", "p").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    r = resample.t_interval(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), [], "v").first()
    assert (r["mean"], r.ci_low, r.ci_high) == (2.0, round(2 - 4.302653 / 3**0.5, 6), round(2 + 4.302653 / 3**0.5, 6))
    words = [one(spark, v=resample.verdict(F.lit(a), F.lit(b), 0.1)).v for a, b in ((0.01, 1.0), (-1.0, -0.1), (-0.05, 0.05), (-1.0, 1.0))]
    assert words == ["positive", "negative", "equivalent", "inconclusive"]


def test_bootstrap_of_equal_runs_is_zero_and_of_better_ones_positive(spark):
    df = spark.createDataFrame([("x", True, True)] * 20 + [("y", i < 4, True) for i in range(20)], "c string, base boolean, new boolean")
    counts = resample.paired_counts(df, ["c"], F.col("base"), F.col("new"))
    got = {r.c: r for r in resample.paired_bootstrap(counts, ["c"], 100, 1, "C").collect()}
    assert (got["x"].ci_low, got["x"].ci_high, got["x"].delta) == (0.0, 0.0, 0.0)
    assert 0.4 < got["y"].ci_low <= got["y"].delta == 0.8 <= got["y"].ci_high <= 1.0


def selector(spark, hits):
    rows = [(c, i, str(k), "alarm_set" if k % 2 else "email_send", 1 if h else 2, h, hits["base"][k], 0.1) for i, (c, hs) in enumerate(hits.items()) for k, h in enumerate(hs)]
    return spark.createDataFrame(rows, "candidate string, pos long, sample_id string, target string, rank long, hit boolean, base_hit boolean, base_margin double").withColumn("split", F.lit("selection")).withColumn("g", T.label_family("target"))


def test_candidate_statuses(spark):
    base = [False] * 12 + [True] * 8
    df = selector(spark, {"base": base, "good": [True] * 20, "bad": [False] * 20, "slight": [True] + [False] * 11 + [True] * 8, "trade": [True] * 19 + [False]})
    got = {r.candidate: r for r in selection.evaluated(df, "base", ["split"], "g", 100, 1, 0.05).collect()}
    assert {c: r.candidate_status for c, r in got.items()} == {"base": "baseline", "good": "accepted", "bad": "harmful_rejected", "slight": "underpowered_positive", "trade": "harmful_rejected"}
    assert got["trade"].reject_reasons == "regression_rate_too_high,protected_regression_rate_too_high"
    assert got["bad"].reject_reasons.startswith("mean_delta_not_positive,bootstrap_lcb_not_positive")


def test_stability(spark):
    df = spark.createDataFrame([("good", True, 0.1, 0.01, 0.0)] * 3 + [("other", True, 0.1, 0.01, 0.0)], "selected string, locked_accepted boolean, locked_hit_delta double, locked_hit_lcb double, locked_regression_rate double")
    assert {r.name: r.accepted for r in selection.stability(df).collect()} == {"good": True, "other": False}
    two = df.where("selected = 'good'").limit(2).unionByName(df.where("selected = 'other'")).unionByName(df.where("selected = 'other'"))
    assert not any(r.accepted for r in selection.stability(two).collect())


def test_answers(spark):
    def score(answer, required, forbidden):
        groups = F.array(*[F.array(*[F.lit(t) for t in g]) for g in required]) if required else F.array().cast("array<array<string>>")
        bad = F.array(*[F.lit(t) for t in forbidden]).cast("array<string>")
        df = spark.range(1).select(F.lit(answer).alias("answer"), groups.alias("required"), bad.alias("forbidden"))
        return tuple(rag.with_score(df, "answer", "required", "forbidden").select("required_terms_recall", "forbidden_violation", "answer_pass").first())

    assert score("The Deposit is due.", [["deposit", "fee"], ["due"]], ["refund"]) == (1.0, False, True)
    assert score("anything", [], []) == (1.0, False, True)
    assert score("refunded deposit", [["deposit"]], ["refund"]) == (1.0, True, False)
    assert score("x", [[""], ["x"]], [""]) == (0.5, False, False)
    kind = lambda *a: one(spark, e=rag.error_type(*[F.lit(x) for x in a])).e
    assert [kind(True, False, False, False, False, False, False), kind(False, False, True, False, False, True, False), kind(False, True, True, False, True, True, False), kind(False, True, False, False, True, True, False), kind(False, True, True, True, True, True, False), kind(False, True, True, True, True, True, True)] == ["none", "retrieval_miss", "over_override", "same_cluster_neighbor", "asr_semantic_drift", "generation_miss"]


def test_text(spark):
    r = one(
        spark, a=T.normalize_match_text(F.lit(" Ünï-Code 漢字, OK! ")), b=T.slugify(F.lit("Policy Grounding!")), c=T.slugify(F.lit("  ")), d=T.word_count(F.lit("  ")), e=T.word_count(F.lit("a b c")),
        f=T.drop_words(F.lit("a b c d e")), g=T.drop_words(F.lit("a b")), h=T.token_error_rate(F.lit("the cat sat down now"), F.lit("the bat sat now")), i=T.token_error_rate(F.lit(""), F.lit("x")), j=T.token_error_rate(F.lit(None), F.lit("")),
        k=T.shorten(F.lit("abcdefghij"), 8), l=T.remap_prefix(F.lit("/a/b"), "/a", "/z"), m=T.normalize_candidate_text(F.lit(" 漢 字 A b "), True), n=T.choose_evidence(F.lit("One. Two three! Four?"), F.lit("THREE"), 50), o=T.token_error_rate(F.lit("x"), F.lit("")),
    )
    assert tuple(r) == ("n code 漢字 ok", "policy_grounding", "empty", 0, 3, "a c e", "a b", 0.4, 1.0, 0.0, "abcde...", "/z/b", "漢字 a b", "Two three!", 1.0)


def test_parsing(spark):
    passed, score, reason = P.judge_fields(F.lit('Sure: ```{"pass": true, "score": 0.5}``` ok'))
    r = one(
        spark, a=P.first_letter(F.lit("maybe b, then C")), b=P.last_letter(F.lit("maybe b, then C")), c=P.option_map(F.lit("A. x y B) z A: w")), d=P.card_answer(F.lit("Q: q\nANSWER:  yes  no\nend")), e=P.card_answer(F.lit("plain  text")),
        f=P.runs(F.array(*[F.lit(x) for x in (7, 7, 0, 7)]), F.lit(7)), g=P.runs(F.array().cast("array<int>"), F.lit(7)), h=P.overlap_coefficient(F.lit("a b c"), F.lit("b c d e")), i=P.nested(F.lit('{"a": {"b": 3}}'), "$.a.b", "int", 0), j=P.nested(F.lit("no"), "$.a", "int", 9), p=passed, s=score, t=reason,
    )
    assert (r.a, r.b, r.c, r.d, r.e) == ("B", "C", {"A": "w", "B": "z"}, "yes no", "plain text")
    assert ([tuple(x) for x in r.f], r.g, round(r.h, 6), r.i, r.j, r.p, r.s, r.t) == ([(0, 2), (3, 4)], [], 0.666667, 3, 9, True, 0.5, "")


def test_vectors(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 2.0], 1), (2, [3.0, 0.1], 0), (3, [0.0, 0.0], 1), (4, None, 1)], "vec_id long, embedding array<double>, label int")
    bank = {r.label: [round(x, 6) for x in r.vector] for r in similarity.bank(e).collect()}
    assert bank == {0: [2.0, 0.05], 1: [0.0, 1.0]}
    top = similarity.top_k(e.where("vec_id = 0"), e, 2)
    assert [(r.cand, r["rank"]) for r in top.orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert similarity.knn_vote(top, e).collect() == [Row(query=0, prediction=0)]
    assert similarity.top_k(e.where("vec_id > 9"), e, 2).collect() == []
    m = one(spark, m=similarity.masked_mean(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0))), F.array(F.lit(False), F.lit(True))), n=similarity.masked_mean(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0))), F.array(F.lit(False), F.lit(False))))
    assert (m.m, m.n) == ([3.0, 6.0], [2.0, 4.0])


def test_plans(spark):
    flat = steps.flatten(steps.build_plan(spark, "rag", "m.jsonl", "Policy Docs!", ("raw", "policy_grounding")))
    got = [(r.arm, r.step_index, r.step) for r in flat.orderBy("arm", "step_index").collect()]
    assert got[:3] == [("policy_grounding", 1, "cache_text"), ("policy_grounding", 2, "cache_omni_audio"), ("policy_grounding", 3, "evaluate_hybrid_from_cache")] and len(got) == 6
    assert "policy_docs" in flat.first().output
    with pytest.raises(ValueError):
        instructions.task_arms("rag", ("nothing",))
    assert len(instructions.all_arms()) == 18 and instructions.all_arms()["constructed_tool_intent"].endswith("when a more specific tool is implied.")


def test_reading_and_writing(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"sample_id": "a", "text": "x"}\n\n{"sample_id": "a", "text": "y", "more": 1}\n')
    m = readers.read_jsonl(spark, f"file://{tmp_path}/m.jsonl").where("sample_id IS NOT NULL").withColumn("line", F.monotonically_increasing_id())
    assert readers.last_wins(m, "sample_id", ["line"]).first().text == "y" and readers.first_wins(m, "sample_id", ["line"]).first().text == "x"
    (tmp_path / "r.json").write_text('{"metrics": {"test": {"rows": [{"id": "q", "rank": 2}]}}}')
    assert [(r.candidate, r.sample_id, r["rank"]) for r in readers.candidates(spark, {"raw": f"file://{tmp_path}/r.json"}, "raw").collect()] == [("raw", "q", 2)]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="no rows at"):
        readers.read_report_rows(spark, f"file://{tmp_path}/bad.json").collect()
    assert readers.spec("a=b=c") == ("a", "b=c")
    with pytest.raises(ValueError):
        readers.spec("=x")
    clips = readers.clips(spark.createDataFrame([("d/1001_IEO_ANG_HI.wav",), ("1002_X_zzz_LO.wav",)], "path string")).collect()
    assert [(c.speaker, c.emotion) for c in clips] == [("1001", "anger"), ("1002", "zzz")]
    r = one(spark, a=readers.audio_kind(F.lit(b"RIFF1234"), F.lit("x.mp3")), b=readers.audio_kind(F.lit(b"none"), F.lit("X.OGG")))
    assert tuple(r) == (".wav", ".ogg")
    board = spark.createDataFrame([("b|c", 0.5, None), ("a", 1.0, 2)], "name string, acc double, n int")
    assert [x.line for x in sinks.markdown(board, ["name"]).orderBy("line_no").collect()] == ["| name | acc | n |", "|---|---|---|", "| a | 1.0000 | 2 |", "| b\\|c | 0.5000 |  |"]
    sinks.write_csv(board, f"file://{tmp_path}/out", ["name"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 2
    assert sinks.fingerprint(board, ["name", "acc"]).collect() == sinks.fingerprint(board.orderBy(F.desc("name")).repartition(3), ["name", "acc"]).collect()


def test_resuming_stream(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), k) for k in range(6)], "sample_id string, v long")
    rows.write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):
        source = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
        resume.evaluate_stream(source, lambda b: b.withColumn("ok", F.col("v") % 2 == 0), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
        rows.unionByName(spark.createDataFrame([("9", 9)], rows.schema)).write.mode("append").parquet(f"file://{tmp_path}/in")
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(r.sample_id for r in got) == ["0", "1", "2", "3", "4", "5", "9"]
    done = spark.createDataFrame([("1", "c1"), ("2", "c2")], "sample_id string, config string")
    assert resume.remaining(rows, done, config="config", value="c1").count() == 5 and resume.reused(rows, done).count() == 2


def test_answers_match_by_text_or_by_a_bare_letter(spark):
    from gatehouse.functions.parsing import answers_match

    rows = [("Answer: B", "b", True), ("b) blue", "B", True), ("b", "B: blue", True), ("blue", "b", False), ("bc", "b", False), ("“x", "x", False),
            ('Answer: "Paris"', "paris", True), ("Paris ;", "paris", True), ('"Paris" ;', "paris", False), ("", "", False), (None, "a", False), ("甲；", "甲", True), ("e", "e. east", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").select(answers_match("a", "b").alias("got"), "want")
    assert [r.got for r in df.collect()] == [r[2] for r in rows]


def test_order_policies(spark):
    from gatehouse.operators.gates import ORDER_POLICIES, order_choice

    df = spark.createDataFrame([(p, g, t) for p in ORDER_POLICIES for g, t in (("x", "x"), ("x", "y"), ("y", "x"), ("y", "z"))], "p string, g string, t string")
    chosen, taken = order_choice(F.col("p"), F.col("g"), F.col("t"), F.lit("x"))
    got = [(r.c, r.k) for r in df.select(chosen.alias("c"), taken.alias("k")).collect()]
    assert [c for c, _ in got] == ["x", "y", "x", "z", "x", "x", "x", "y", "x", "x", "x", "z", "x", "x", "x", "x"]
    assert [k for _, k in got] == [True] * 4 + [True, False, True, False] + [True, False, True, True] + [True, False, True, False]
