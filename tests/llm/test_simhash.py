import time

import numpy as np
import pytest
import xxhash
from common import frame, rows, words

from gatehouse.llm import simhash


def fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(ids, fps, radius):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    distinct = sorted(set(fps))
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if (x ^ y).bit_count() <= radius:
                root[find(x)] = find(y)
    low = {}
    for k, f in zip(ids, fps, strict=True):
        if k is not None:
            low[find(f)] = min(low.get(find(f), k), k)
    return [low.get(find(f)) for f in fps]


def test_documents_match_brute_force(spark):
    data = rows()
    want = sorted(zip([repr(k) for k, _ in data], [f"{fingerprint(t):016x}" for _, t in data], brute([k for k, _ in data], [fingerprint(t) for _, t in data], 3), strict=True), key=repr)
    got = sorted(((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_dedup(frame(spark)).collect()), key=repr)
    assert got == want


def test_empty(spark):
    assert simhash.near_dedup(frame(spark, [])).collect() == []


def near_fingerprints(n, radius, seed=1):
    r = np.random.default_rng(seed)
    seeds = r.integers(0, 2**64, n // 8, dtype=np.uint64)
    out = set(seeds.tolist())
    for s in r.choice(seeds, n).tolist():
        for b in r.choice(64, r.integers(0, radius + 2), replace=False).tolist():
            s ^= 1 << b
        out.add(s)
    return sorted(out)


def dense_fingerprints(n, radius):
    """All under one prefix of 16 bits, most of them under one of 32."""
    return sorted({f & ((1 << (32 if k % 4 else 48)) - 1) for k, f in enumerate(near_fingerprints(n, radius, 3))})


@pytest.mark.parametrize("dense", [None, 20])
def test_links_have_the_components_of_brute_force(spark, monkeypatch, dense):
    if dense:
        monkeypatch.setattr(simhash, "DENSE_ROWS", dense)
    for radius in (1, 2, 3, 4) if not dense else (2, 3):
        fps = near_fingerprints(240, radius) if not dense else dense_fingerprints(160, radius)
        signed = [f - 2**64 if f >= 2**63 else f for f in fps]
        edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()
        assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() for e in edges)
        root = {f: f for f in signed}

        def find(f, root=root):
            while root[f] != f:
                f = root[f]
            return f

        for e in edges:
            root[find(e.a)] = find(e.b)
        classes = {}
        for f, s in zip(fps, signed, strict=True):
            classes.setdefault(find(s), set()).add(f)
        want = {}
        for f, c in zip(fps, brute(fps, fps, radius), strict=True):
            want.setdefault(c, set()).add(f)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_a_dense_prefix_takes_several_passes(monkeypatch):
    fps = np.array(near_fingerprints(120, 3, 2), np.uint64) & np.uint64((1 << 20) - 1)
    fps = np.unique(fps)
    whole = simhash.forest(*simhash.Balls(3, 16).links(np.zeros(len(fps), np.uint64), fps))
    monkeypatch.setattr(simhash, "MOST_VARIANTS", 5000)
    parts = simhash.forest(*simhash.Balls(3, 16).links(np.zeros(len(fps), np.uint64), fps))
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]
    assert len(whole[0])


def test_time_stays_in_proportion_in_one_prefix():
    """Variants are written out once, however many rows share a prefix: 16 times as many take about 16 times as long."""
    r = np.random.default_rng(0)

    def seconds(n):
        fps = np.unique(r.integers(0, 1 << 48, n, dtype=np.uint64))
        began = time.process_time()
        simhash.Balls(3, 16).links(np.zeros(len(fps), np.uint64), fps)
        return (time.process_time() - began) / n

    seconds(20_000)
    assert seconds(160_000) < 4 * seconds(20_000)


def test_the_first_prefix_grows_with_the_number_of_fingerprints():
    assert [simhash.first_bits(n, 3, simhash.PREFIX_BITS) for n in (10**6, 4 * 10**8, 5 * 10**8, 5 * 10**10, 6 * 10**10)] == [0, 0, 1, 1, 2]


def test_each_level_leaves_its_dense_prefixes_to_the_next(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE_ROWS", 20)
    signed = [f - 2**64 if f >= 2**63 else f for f in dense_fingerprints(160, 3)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    first = simhash.dense_prefixes(df, 3, 16, None)
    second = simhash.dense_prefixes(df, 3, 32, (16, first))
    assert 0 in first and 0 in second and set((second >> np.uint64(16)).tolist()) <= set(first.tolist())
    monkeypatch.setattr(simhash, "DENSE_ROWS", 1 << 16)
    assert not len(simhash.dense_prefixes(df, 3, 16, None))
