import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, q string, list int, shard int, score double, lo int"


def taking_part(rows):
    out = []
    for key, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.append((key, [math.floor(256 * float(np.float32(x))) for x in v], label))
    return out


def brute(rows, negatives=5, low=80, high=100, anchor=lambda i: i % 10 == 0):
    rows, out = taking_part(rows), []
    last = lambda r: (r[0] is None, r[0] or 0)
    for a, (key, q, label) in enumerate(rows):
        if key is None or not anchor(key):
            continue
        scored = [(sum(x * y for x, y in zip(q, v, strict=False)), i, other) for b, (i, v, other) in enumerate(rows) if a != b]
        first = lambda xs: sorted(xs, key=lambda s: (-s[0], last((s[1],))))
        for score, i, _ in first(s for s in scored if s[2] == label)[:5]:
            window = [s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score]
            out += [(key, i, rank, n, score, s) for rank, (s, n, _) in enumerate(first(window)[:negatives], 1)]
    return out


def told(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def check(spark, rows, anchor=lambda i: i % 10 == 0, **named):
    df = spark.createDataFrame([(*r, 3, "x", 1, 2, 0.5, 4) for r in rows], SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, anchor(F.col("id")), **named)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, named.get("negatives", 5), named.get("low", 80), named.get("high", 100), anchor)
    assert told(tuple(r) for r in got.collect()) == told(want)
    return want


def made(seed, n, width=8, labels=4):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(k, [m + r.gauss(0, 0.4) for m in middles[k % 6]], r.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("shard,searches,together", [(4096, 16384, 1024), (37, 7, 5)])
def test_rows_match_brute_force(spark, monkeypatch, shard, searches, together):
    """In one shard, and in many that several tasks share."""
    for name, value in (("SHARD_ROWS", shard), ("SEARCHES", searches), ("TOGETHER", together), ("CANDIDATES", 50 * together)):
        monkeypatch.setattr(negatives, name, value)
    assert check(spark, made(1, 400))


def test_nulls_ties_repeats_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 20)
    rows = made(2, 80, 3, 2)
    rows += [(90, None, 1), (91, [1.0, None, 0.0], 1), (92, [math.nan, 1.0, 0.0], 0), (93, [math.inf, 0.0, 0.0], 0), (94, [1.0, 1.0, 1.0], None)]
    rows += [(100, [1.0], 0), (101, [], 1), (100, [1.0], 0), (None, [1.0, 0.5, 0.0], 1), (None, [1.0, 0.5, 0.0], 0), (110, [-0.001, 0.0, 0.0], 1)]
    rows += [(200 + k, [0.5, 0.5, 0.25], k % 2) for k in range(30)]  # equal scores
    check(spark, rows)


def test_a_vector_that_a_third_of_all_rows_repeat(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD_ROWS", 25)
    rows = made(3, 120) + [(1000 + k, [0.6] * 8, k % 2) for k in range(60)]
    check(spark, rows)


def test_other_windows_and_negative_scores(spark):
    rows = [(k, [math.cos(k), math.sin(k)], k % 3) for k in range(60)]
    check(spark, rows, low=50, high=90, negatives=3)
    check(spark, [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-1.0, 0.1], 1), (3, [0.0, 1.0], 1)], low=100)


def test_lists_outside_the_bounds_are_not_visited(monkeypatch):
    """Four far clusters: a search scores its own list, and nothing of lists below its kth score or above its window."""
    r = np.random.default_rng(4)
    middles = np.array([[4000, 0, 0], [0, 4000, 0], [-4000, 0, 0], [0, 0, 4000]])
    x = (np.repeat(middles, 50, 0) + r.integers(-20, 20, (200, 3))).astype("<i4")
    at = np.repeat(np.arange(4), 50).astype(np.int32)
    import pyarrow as pa

    q = pa.array([v.tobytes() for v in x], pa.binary())
    far = np.sqrt(((x - middles[at]) ** 2).sum(1))
    named = {"id": range(200), "label": [0] * 200, "q": q, "file_hash": [0] * 200, "file_row": range(200), "list": at, "distance": far}
    members = pa.table({k: v if isinstance(v, (pa.Array, np.ndarray)) else pa.array(v, pa.int64()) for k, v in named.items()})
    shard, seen = negatives.Shard(members, middles.astype(float), 5, True, 1024, 1 << 20), []
    monkeypatch.setattr(negatives, "products", lambda a, b, f=negatives.products: seen.append(len(a) * len(b)) or f(a, b))
    asked = members.select(["id", "label", "q", "file_hash", "file_row"]).slice(0, 10)
    zero = pa.array([0] * 10, pa.int64())
    asked = asked.append_column("ask", zero).append_column("lo", pa.array([negatives.LOWEST] * 10)).append_column("hi", pa.array([negatives.HIGHEST] * 10)).append_column("least", pa.array([negatives.LOWEST] * 10))
    found = pa.Table.from_batches(shard.search(asked))
    assert seen == [10 * 50] and found.num_rows == 50
    below = asked.set_column(asked.schema.get_field_index("hi"), "hi", pa.array([1000] * 10)).set_column(asked.schema.get_field_index("lo"), "lo", pa.array([-200000] * 10))
    seen.clear()
    list(shard.search(below))
    assert sum(seen) == 10 * 100  # its own list lies above the window, the one across below it


def test_products_are_exact_in_any_numbers():
    for most in (100, 1 << 14, 1 << 24):
        a = np.random.default_rng(1).integers(-most, most, (5, 64)).astype("<i4")
        want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in a] for u in a]
        assert negatives.products(a, a).astype(np.int64).tolist() == want
    with pytest.raises(OverflowError):
        negatives.products(np.full((1, 64), 1 << 30), np.full((1, 64), 1 << 30))


def test_empty_table_and_wrong_kinds(spark):
    check(spark, [])
    with pytest.raises(TypeError):
        negatives.hard_negatives(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<float>, label int"), F.lit(True))
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int"), F.lit(True), low=0)
