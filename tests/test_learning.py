"""Pooling, folds, probes, nested comparison, numbered lines, resumed runs: odd inputs and plain versions."""

import json
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gatehouse import queries
from gatehouse.functions import records
from gatehouse.operators import answering, fitting, gates, nested, probes, rag, sampling, selection, similarity
from gatehouse.queries import learning
from gatehouse.sources import readers
from gatehouse.streaming import resume


def plain_pool(frames, keep, method):
    h = np.array([f for f, k in zip(frames, keep, strict=True) if k], float).reshape(-1, 3)
    if not len(h):
        mean, std = np.zeros(3), np.full(3, math.sqrt(1e-6))
    else:
        mean, weight = h.mean(0), np.full(len(h), 1 / len(h))
        if method == "attn":
            e = np.exp(h @ mean / math.sqrt(3))
            weight = e / e.sum()
            mean = weight @ h
        std = np.sqrt(weight @ (h - mean) ** 2 + 1e-6)
    out = {"mean": mean, "std": std}.get(method, np.concatenate([mean, std]))
    return out / (np.linalg.norm(out) or 1)


def test_pooling_matches_a_plain_version(spark):
    r = random.Random(1)
    rows = [(k, [[r.gauss(0, 1) for _ in range(3)] for _ in range(r.randint(1, 6))], None) for k in range(40)]
    rows = [(k, f, [r.random() < 0.4 for _ in f]) for k, f, _ in rows] + [(50, [], []), (51, None, None), (52, [[1.0, 2.0, 3.0]], [None])]
    specs = {f"{s}_{m}": (s, m) for s in ("all", "audio") for m in ("mean", "std", "stats", "attn")}
    df = spark.createDataFrame(rows, "id long, frames array<array<double>>, mask array<boolean>").repartition(3)
    got = {x.id: x for x in similarity.pooled(df, ["id"], "frames", "mask", specs).collect()}
    for k, frames, mask in rows:
        frames, mask = frames or [], mask or []
        for name, (subset, method) in specs.items():
            keep = [True] * len(frames) if subset == "all" or not any(mask) else [bool(m) for m in mask]
            assert np.allclose(got[k][name], plain_pool(frames, keep, method), atol=1e-9), (k, name)
    with pytest.raises(ValueError):
        similarity.pooled(df, ["id"], "frames", "mask", {"x": ("all", "median")})


def test_folds_differ_by_the_largest_group_at_most(spark):
    r = random.Random(3)
    for folds in (2, 3, 5):
        rows = [(f"g{g}",) for g in range(40) for _ in range(int(r.paretovariate(0.8)) % 200 + 1)] + [(None,)] * 7
        out = sampling.balanced_folds(spark.createDataFrame(rows, "g string"), "g", folds).groupBy("g", "fold").count().collect()
        assert len({x.g for x in out}) == len(out)  # no group is in two folds
        sizes = [sum(x["count"] for x in out if x.fold == f) for f in range(folds)]
        assert max(sizes) - min(sizes) <= max(x["count"] for x in out) and sum(sizes) == len(rows)


def test_linear_probe_matches_numpy(spark):
    g = np.random.default_rng(5)
    middles = g.normal(size=(4, 6))
    y = g.integers(0, 4, 300)
    x = middles[y] + g.normal(size=(300, 6)) * 0.7
    fold = np.arange(300) % 3
    rows = [(int(k), [float(v) for v in x[k]], f"l{y[k]}", int(fold[k])) for k in range(300)] + [(900, None, "l1", 0), (901, [0.0] * 6, None, 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string, fold int").repartition(4)
    got = {r.id: r.prediction for r in probes.linear_probe(df, "id", "v", "label", "fold", ridge=2.0).collect()}
    wide, hot = np.hstack([x, np.ones((300, 1))]), np.eye(4)[y]
    want = {}
    for f in range(3):
        fit = fold != f
        w = np.linalg.solve(wide[fit].T @ wide[fit] + np.diag([2.0] * 6 + [1e-9]), wide[fit].T @ hot[fit])
        want |= {int(k): f"l{c}" for k, c in zip(np.flatnonzero(~fit), (wide[~fit] @ w).argmax(1), strict=True)}
    assert got == want and np.mean([want[k] == f"l{y[k]}" for k in range(300)]) > 0.8


def test_linear_probe_query_matches_numpy(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    x, y = np.array([[*v, 1.0] for _, v, _ in rows]), np.array([c for *_, c in rows])
    speaker = np.floor(np.sqrt([k for k, *_ in rows])).astype(int)
    groups, sizes = np.unique(speaker, return_counts=True)
    dealt = {int(g): (i % 4 if i // 4 % 2 == 0 else 3 - i % 4) for i, g in enumerate(groups[np.lexsort((groups, -sizes))])}
    fold = np.array([dealt[int(s)] for s in speaker])
    labels, want = np.unique(y), {}
    hot = (y[:, None] == labels).astype(float)
    shrink = np.diag([1.0] * (x.shape[1] - 1) + [1e-9])
    for f in range(4):
        fit = fold != f
        w = np.linalg.solve(x[fit].T @ x[fit] + shrink, x[fit].T @ hot[fit])
        want |= {rows[k][0]: int(labels[c]) for k, c in zip(np.flatnonzero(~fit), np.round(x[~fit] @ w, 9).argmax(1), strict=True)}
    assert {r.vec_id: r.prediction for r in queries.QUERIES["probe_linear"](spark, folder).collect()} == want


def test_nested_choice_does_not_look_at_its_own_fold(spark):
    # on fold 0 option b is best, on all others a
    rows = [(f, o, p, (o == "b") == (f == 0)) for f in range(3) for o, p in (("a", 0), ("b", 1)) for _ in range(4)]
    got = {r.fold: r for r in probes.nested_choice(spark.createDataFrame(rows, "fold int, option string, place int, correct boolean"), "option", "place", "b").collect()}
    assert got[0].option == "a" and got[0].accuracy == 0.0 and got[0].baseline_accuracy == 1.0 and got[0].delta == -1.0
    assert got[1].option == "a" and got[1].dev_accuracy == 0.5


def test_nested_documents_leaf_by_leaf(spark):
    a = {"x": 1, "y": {"z": [1.0, 2, {"w": "s"}], "e": {}, "n": None}, "l": [[1, 2], []], "t": True, "only": 1}
    b = {"x": 1.0, "y": {"z": [1.0000001, 2.5, {"w": "t"}, 4], "e": {}, "n": 0}, "l": [[1], []], "t": True, "more": [5]}
    frame = lambda *docs: spark.createDataFrame([(k, json.dumps(d) if not isinstance(d, str) else d) for k, d in enumerate(docs)], "id long, j string").select("id", F.parse_json("j").alias("doc"))
    got = {(r.id, r.path): r.status for r in nested.compare(frame(b, 5, "null"), frame(a, 5.0, "[]"), ["id"], "doc").collect()}
    assert got == {
        (0, "$.x"): "equal", (0, "$.y.z[0]"): "close", (0, "$.y.z[1]"): "differs", (0, "$.y.z[2].w"): "differs", (0, "$.y.z[3]"): "extra", (0, "$.y.e"): "equal", (0, "$.y.n"): "differs",
        (0, "$.l[0][0]"): "equal", (0, "$.l[0][1]"): "missing", (0, "$.l[1]"): "equal", (0, "$.t"): "equal", (0, "$.only"): "missing", (0, "$.more[0]"): "extra", (1, "$"): "equal", (2, "$"): "differs",
    }
    told = {r.id: (r.passed, r.mismatches) for r in nested.verdicts(nested.compare(frame(b, 5), frame(a, 5.0), ["id"], "doc"), ["id"]).collect()}
    assert told[1] == (True, []) and not told[0][0] and "$.y.z[3]" in told[0][1]
    deep = {'{"a": [{"b": "}]]"}], "c": {}}': 3, "1": 0, '["\\"[[", []]': 2, '"[["': 0}
    assert {r.j: r.d for r in spark.createDataFrame([(j,) for j in deep], "j string").select("j", nested.nesting(F.parse_json("j")).alias("d")).collect()} == deep


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    texts = {"a.txt": [f"line {k} " + "x" * (k % 90) for k in range(700)], "b.txt": ["one"], "c.txt": ["", "", "z"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = readers.numbered_lines(spark, f"file://{tmp_path}")
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 20
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(name, k, line) for name, lines in sorted(texts.items()) for k, line in enumerate(lines)]


def test_numbered_lines_go_to_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """More text makes more files, not larger ones, and lines are numbered on from one to the next."""
    spark.range(3000).select((F.col("id") * 7919 % 3000 * 2).alias("doc_id"), F.when(F.col("id") % 50 > 0, F.expr("repeat('a\r\nb ', 40)")).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(learning, "folder", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(learning, "FILE_BYTES", 50_000, raising=False)
    got = {r.doc_id: r.line_no for r in queries.QUERIES["numbered_lines"](spark, f"file://{tmp_path}").collect()}
    assert got == {2 * k: k for k in range(3000)}
    sizes = [p.stat().st_size for p in (tmp_path / "lines").glob("part-*")]
    assert len(sizes) == 12 and max(sizes) < 150_000


def test_a_run_is_resumed_where_it_broke_off(spark, tmp_path):
    rows, output, seen = spark.createDataFrame([(k, k % 4) for k in range(40)], "id long, v long"), f"file://{tmp_path}/out", []

    def evaluate(stop=None, failing=()):
        def run(left):
            if len(seen) == stop:
                raise RuntimeError("broken off")
            seen.append(left.count())
            return left.select("id", F.when(F.col("v").isin(*failing) if failing else F.lit(False), "bad").alias("error"), (F.col("v") * 10).alias("answer"))

        return run

    go = lambda f, config: resume.resumed(rows, f, output, config, "id", 4)
    with pytest.raises(RuntimeError):
        go(evaluate(2), {"m": 1})
    first = sum(seen)
    assert 0 < first < 40
    done = go(evaluate(failing=(3,)), {"m": 1})
    assert sum(seen) == 40 + 0 and done.count() == 40  # what was complete is not evaluated again
    failed = [r.id for r in done.collect() if r.error]
    assert failed and all(k % 4 == 3 for k in failed)
    seen.clear()
    done = go(evaluate(), {"m": 1}).collect()
    assert sum(seen) == len(failed) and all(r.complete and r.answer == 10 * (r.id % 4) for r in done) and len(done) == 40
    seen.clear()
    assert go(evaluate(), {"m": 1}).count() == 40 and sum(seen) == 0
    go(evaluate(), {"m": 2})
    assert sum(seen) == 40  # another configuration
    assert resume.fingerprint({"a": 1, "b": 2}) == resume.fingerprint({"b": 2, "a": 1}) != resume.fingerprint({"a": 1}) == resume.fingerprint({"a": 1, "b": 2}, ("a",))


def test_families_rank_against_their_own_labels(spark):
    rows = [(0, "f", "a", [1.0, 0.0]), (1, "f", "b", [1.0, 0.1]), (2, "g", "c", [0.0, 1.0]), (3, "f", "zz", [1.0, 0.0]), (4, "none", "a", [1.0, 1.0]), (5, None, "a", [1.0, 1.0]), (6, "g", "c", None)]
    df = spark.createDataFrame(rows, "id long, fam string, label string, embedding array<double>")
    labels = spark.createDataFrame([("f", "a", [1.0, 0.0]), ("f", "b", [0.0, 1.0]), ("g", "c", [0.0, 1.0])], "fam string, label string, vector array<double>")
    got = {(r.id, r.arm): (r["rank"], r.top) for r in similarity.group_ranks(df, labels, ["id"], "fam", "label", {"all": slice(None), "first": slice(0, 1)}).collect()}
    assert got == {(0, "all"): (1, "a"), (1, "all"): (2, "a"), (2, "all"): (1, "c"), (3, "all"): (None, "a"), (0, "first"): (1, "a"), (1, "first"): (2, "a"), (2, "first"): (1, "c"), (3, "first"): (None, "a")}
    with pytest.raises(ValueError):
        similarity.group_ranks(df, labels, ["id"], "fam", "label", {"all": slice(None)}, most_labels=2)


def test_a_hot_label_is_numbered_like_any_other(spark):
    rows = [(k, "hot" if k % 3 else f"l{k % 5}") for k in range(300)] + [(1000, None), (1001, None)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(5)
    got = sampling.placed(df, "id", 7, ["label"]).collect()
    for label in {r.label for r in got}:
        mine = sorted(r.nth for r in got if r.label == label)
        assert mine == list(range(len(mine))) and {r.n for r in got if r.label == label} == {len(mine)}
    assert len(got) == len(rows)


def test_an_answer_without_a_key_is_an_error(spark):
    listed = "array<struct<sample_id:string,document:string>>"
    rows = spark.createDataFrame([("s1", "hi", [("s1", "d")], []), ("s2", "ho", [("s1", "d")], [])], f"sample_id string, asr_text string, asr_top_k {listed}, omni_top_k {listed}")
    samples = spark.createDataFrame([("s1", "t"), ("s2", "t")], "sample_id string, text string")
    keys = lambda *ids: spark.createDataFrame([(i, "d", None, [["d"]], []) for i in ids], "sample_id string, gold_answer string, key_decision string, required_terms array<array<string>>, forbidden_terms array<string>")
    assert answering.evaluate(rows, samples, keys("s1", "s2", "s3")).count() == 2
    with pytest.raises(Exception, match="no answer key for s2"):
        answering.evaluate(rows, samples, keys("s1")).collect()


def test_parser_cascades(spark):
    options = ["red apple pie", "green tea"]
    said = {
        "between A and B. Answer: B": ("B", "B", "B"), "B, no, A": ("B", "A", "A"), "option: C or A": ("C", "A", "A"), "x_H green tea": ("B", "B", "H"), "Green  TEA": ("B", "B", "B"),
        "<|channel>thought A": ("", "", "A"), "<|channel>thought A <|channel>final it is B": ("B", "B", "B"), '{"answer": "a"} b': ("A", "A", "B"), "D": ("D", "", "D"), "": ("", "", ""), "the pie of red": ("", "", ""),
    }
    df = spark.createDataFrame([(x, options) for x in [*said, None]], "said string, options array<string>")
    got = {r.said: (r.p["letter"], r.m["letter"], r.c["letter"]) for r in df.select("said", records.channel_choice("said", "options").alias("p"), records.memory_choice("said", "options").alias("m"), records.chat_choice("said", "options").alias("c")).collect()}
    assert got == said | {None: ("", "", "")}


def test_runs_side_by_side(spark):
    rows = spark.createDataFrame([("s1", "a", "x"), ("s1", "b", "y"), ("s2", "a", "z")], "id string, run string, said string")
    got = {r.id: (r.a, r.b, r.missing) for r in gates.aligned(rows, "id", "run", ["a", "b"], "said", strict=False).collect()}
    assert got == {"s1": ("x", "y", 0), "s2": ("z", None, 1)}
    with pytest.raises(Exception, match="a run has no row for s2"):
        gates.aligned(rows, "id", "run", ["a", "b"], "said").collect()
    with pytest.raises(Exception, match="two rows for s1"):
        gates.aligned(rows.unionByName(rows), "id", "run", ["a", "b"], "said", strict=False).collect()
    assert len(gates.consistency_gates()) == 21
    with pytest.raises(ValueError):
        selection.accept("other", rows, "a")


def test_context_audit(spark):
    rows = spark.createDataFrame([("q1", True, ["d1", "d2"], "d2", "none"), ("q2", False, [], None, "miss"), ("q3", False, ["d2", "no"], "no", "miss")], "sample_id string, answer_pass boolean, used_candidate_ids array<string>, selected_candidate_id string, error_type string")
    documents = spark.createDataFrame([("d1", "nothing here"), ("d2", "the Key is 7")], "sample_id string, document string")
    keys = spark.createDataFrame([(f"q{k}", [["key is 7"]], []) for k in (1, 2, 3)], "sample_id string, required_terms array<array<string>>, forbidden_terms array<string>")
    got = {r.sample_id: tuple(r)[1:-1] for r in rag.context_audit(rows, documents, keys).collect()}
    assert got == {"q1": (True, False, True, True, True, False, False), "q2": (False, False, False, False, False, False, True), "q3": (False, True, False, True, False, True, False)}
    with pytest.raises(Exception, match="no answer key for q3"):
        rag.context_audit(rows, documents, keys.where("sample_id != 'q3'")).collect()


@pytest.fixture(scope="module")
def halfway(tmp_path_factory):
    """Embeddings whose scores against five labels lie halfway between two cents, beside one that is a tie if they go down
    (or up)."""
    pairs = [(k / 200, (k - 1) / 200) for k in range(1, 140)] + [(-k / 200, -(k + 1) / 200) for k in range(1, 81)]
    vectors = [[1e9 * (p == c) for p in range(64)] for c in range(5)]
    for a, b in pairs:
        v = [a, b, *[min(b, 0) - 0.02 * k for k in (1, 2, 3)]]
        vectors.append([*v, *[0.0] * 58, math.sqrt(1 - sum(x * x for x in v))])
    folder = tmp_path_factory.mktemp("halfway")
    label = pa.array([k % 5 for k in range(len(vectors))], pa.int32())
    pq.write_table(pa.table({"vec_id": range(len(vectors)), "label": label, "embedding": pa.array(vectors, pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["candidate_accessors", "reranked_rows"])
def test_scores_halfway_between_cents_round_as_in_sql(spark, halfway, name):
    df = queries.QUERIES[name](spark, halfway)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{halfway}/embeddings.parquet'")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def differing(got, sql):
    """The rows (key, value) that are not those of the SQL."""
    return {tuple(r) for r in got.collect()} ^ set(duckdb.sql(sql).fetchall())


def test_weighted_sums_of_rounded_numbers_round_as_in_sql(spark):
    r = random.Random(3)
    rows = [("base", 0.5, 0.25, 0.125, 0.1, 0.0, 0.0)] + [(f"c{k}", *(round(r.random(), 6) for _ in range(4)), 0.0, 0.0) for k in range(4000)]
    names = ["candidate", "acc_at_1", "recall_at_3", "mrr", "unsafe_rate", "ci_low", "regression_rate"]
    df = spark.createDataFrame(rows, names)
    board = pa.table(dict(zip(names, zip(*rows, strict=True), strict=True)))
    duckdb.register("board", board)
    both = "FROM board b, (SELECT * FROM board WHERE candidate = 'base') a WHERE b.candidate <> 'base'"
    utility = f"SELECT b.candidate, round(b.acc_at_1 + 0.1 * b.recall_at_3 + 0.1 * b.mrr - (a.acc_at_1 + 0.1 * a.recall_at_3 + 0.1 * a.mrr), 6) {both}"
    quality = f"SELECT b.candidate, round(b.recall_at_3 - a.recall_at_3 + 0.5 * (b.mrr - a.mrr), 6) {both}"
    assert not differing(selection.accept_asr_like(df, "base").select("candidate", "utility_delta"), utility)
    assert not differing(selection.accept_tool(df, "base").select("candidate", "quality_delta"), quality)


def test_rewards_round_as_in_sql(spark):
    r = random.Random(4)
    ranks = pa.table({"candidate": [k // 7 for k in range(28_000)], "rank": [r.randint(1, 9) for _ in range(28_000)]})
    df = spark.createDataFrame(ranks.to_pandas())
    duckdb.register("ranks", ranks)
    sql = """WITH m AS (SELECT candidate, round(avg(CAST(rank = 1 AS INT)), 6) AS a, round(avg(CAST(rank <= 3 AS INT)), 6) AS b, round(avg(1e0 / rank), 6) AS c FROM ranks GROUP BY candidate)
    SELECT candidate, round(a + 0.1 * b + 0.1 * c, 6) FROM m"""
    assert not differing(selection.leaderboard(df, ["candidate"]).select("candidate", "reward"), sql)


def test_ratios_to_chance_round_as_in_sql(spark):
    rows = spark.range(1000).select(((F.col("id") * 2 + 1) / 2000).alias("accuracy"), F.lit(0.1).alias("chance"), F.lit(0.0).alias("ci_low"), F.lit(1.0).alias("ci_high"))
    sql = "SELECT a, round(a / 0.1e0, 2) FROM (SELECT (2 * range + 1) / 2000e0 AS a FROM range(1000))"
    assert not differing(probes.above_chance(rows).select("accuracy", "ratio_over_chance"), sql)


def test_fitted_thresholds_round_as_in_sql(spark):
    """A margin halfway between two thresholds is routed by its own if that goes up, else by the next, 0.99."""
    at = spark.range(2500, 9500).select((F.col("id") / 10000 + 0.00005).alias("m")).select(F.round("m", 6).alias("m"))
    rows = at.select("m", F.inline(F.array(*[F.struct(F.lit(t).alias("target"), x.alias("base_margin")) for t, x in (("a_2", F.col("m")), ("a_1", F.lit(0.99)))])))
    got = fitting.select_threshold(rows.withColumns({"base": F.lit("a_1"), "alt": F.lit("a_2")}), ["m"]).where("mode = 'margin_low'").select("m", "threshold")
    assert not differing(got, "SELECT m, CASE WHEN m < round(m, 4) THEN round(m, 4) ELSE 0.99e0 END FROM (SELECT round(range / 1e4 + 0.00005e0, 6) AS m FROM range(2500, 9500))")
