import random
from collections import Counter

import pyarrow as pa
import pytest
from common import frame, rows, words

import corpus_pipeline
from gatehouse.llm import jaccard


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    """The smallest place of each text's component, over all pairs."""
    found = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(found):
        for j, y in enumerate(found[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_copies(bases=12, copies=14, size=140, seed=3):
    """(id, text) with edits that put pairs on both sides of the similarity, and a passage that all share."""
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    out = []
    for b in range(bases):
        base = [f"b{b}w{k}" for k in range(size)] + passage
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randint(0, 9)):
                text[r.randrange(len(text))] = f"x{r.random()}"
            out.append(" ".join(text))
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("sample", [None, 4])
def test_all_links_of_brute_force_are_found(spark, monkeypatch, sample):
    if sample:
        monkeypatch.setattr(jaccard, "SAMPLE_ROWS", sample)
        monkeypatch.setattr(jaccard, "PARTS", 3)
    data = near_copies()
    want = brute([t for _, t in data])
    assert len(set(want)) not in (12, len(data))
    got = {r.doc_id: r.component_id for r in jaccard.near_dedup(frame(spark, data).repartition(5)).collect()}
    assert got == dict(enumerate(want))


def test_links_between_texts_of_different_size_classes(spark):
    """Pairs whose sizes lie on both sides of a class, and that share shingles with each other alone."""
    r = random.Random(5)
    data = []
    for pair in range(24):
        base = [f"p{pair}w{k}" for k in range(90)]
        other = [*base, "longer"]
        for k in r.sample(range(5, 80), 1 + pair % 2):
            other[k] = f"p{pair}x{k}"
        data += [" ".join(base), " ".join(other)]
    want = brute(data)
    assert len(set(want)) < len(data)
    got = {x.doc_id: x.component_id for x in jaccard.near_dedup(frame(spark, list(enumerate(data))).repartition(3)).collect()}
    assert got == dict(enumerate(want))


def test_rows_of_shared_shingles_whatever_the_batches():
    r = random.Random(0)
    for _ in range(200):
        full = sorted((r.choice([-1, -1, 0, 1]), r.randrange(6), r.randrange(5), 9, 8) for _ in range(r.randint(0, 25)))
        buckets, got, row = jaccard.Shared(), [], 0
        while row < len(full):
            part = full[row : row + r.randint(1, 4)]
            row += len(part)
            for out in buckets(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], ["part", "shingle", "key", "n", "place"])):
                got += zip(*[c.to_pylist() for c in out.columns], strict=True)
        sets = Counter(x[:2] for x in set(full))
        assert sorted(got) == sorted(x for x in set(full) if x[0] >= 0 or sets[x[:2]] > 1)


def test_odd_rows_match_brute_force(spark):
    data = [r for r in rows() if r[0] is not None]
    ids = [k for k, _ in data]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.near_dedup(frame(spark, data)).collect())
    assert got == sorted((k, ids[c]) for k, c in zip(ids, brute([t for _, t in data]), strict=True))
    assert len(jaccard.near_dedup(frame(spark)).collect()) == len(rows())
    assert jaccard.near_dedup(frame(spark, [])).collect() == []


def test_the_stage_drops_copies_at_similarity_0_8(spark):
    """Such pairs differ in more than three bits of their fingerprints."""
    base = [f"word{k}" for k in range(200)]
    edited = [f"new{k}" if k in (20, 70, 120, 170) else w for k, w in enumerate(base)]
    other = [f"new{k}" if k % 20 == 5 else w for k, w in enumerate(base)]
    data = [(k, " ".join(t), None, None, None) for k, t in enumerate((base, edited, other))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]
