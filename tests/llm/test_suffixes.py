import random

import numpy as np
import pytest
from common import frame, prose, rows

from gatehouse.llm import suffixes


def brute(data, window):
    """For each row: (bytes kept, spans)."""
    first = {}
    raw = [((-(1 << 63) if k is None else k), (t or "").encode()) for k, t in data]
    for key, text in raw:
        for i in range(len(text) - window + 1):
            x = text[i : i + window]
            first[x] = min(first.get(x, key), key)
    out = []
    for key, text in raw:
        gone = bytearray(len(text))
        for i in range(len(text) - window + 1):
            if first[text[i : i + window]] < key:
                gone[i : i + window] = b"\1" * window
        spans, at = [], 0
        while (at := gone.find(1, at)) >= 0:
            end = gone.find(0, at)
            end = len(gone) if end < 0 else end
            spans.append((at, end - at))
            at = end
        out.append((bytes(b for b, g in zip(text, gone, strict=True) if not g), spans))
    return out


def check(spark, data, slices=3, **named):
    got = suffixes.suffix_dedup(frame(spark, data).repartition(slices), **named).collect()
    want = brute(data, named.get("window", 50))
    told = lambda xs: sorted(xs, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    mine = [(r.doc_id, bytes(r.kept_bytes), r.n_bytes, r.n_removed, [tuple(s) for s in r.spans]) for r in got]
    theirs = [(k, kept, len((t or "").encode()), len((t or "").encode()) - len(kept), spans) for (k, t), (kept, spans) in zip(data, want, strict=True)]
    assert told(mine) == told(theirs)


def made(seed=5, n=150):
    r = random.Random(seed)
    pieces = [prose(k, r.randint(3, 60)) for k in range(30)]
    return [(k, " ".join(r.choice(pieces) for _ in range(r.randint(1, 7)))) for k in range(n)]


@pytest.mark.parametrize("window,gram", [(50, 20), (12, 5), (8, 8), (5, 2)])
def test_odd_rows_match_brute_force(spark, window, gram):
    check(spark, rows(), window=window, gram=gram)


def test_shared_pieces_match_brute_force(spark):
    check(spark, made(), slices=7)


def test_large_groups_go_on_to_the_next_pass(spark, monkeypatch):
    """Groups too large for a task, chunks of a few blocks, and texts in many parts."""
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 150)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 400)
    monkeypatch.setattr(suffixes, "PART_BYTES", 97)
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 2000)
    monkeypatch.setattr(suffixes, "materialize", lambda df, tag, f=suffixes.materialize: written.setdefault(tag, f(df, tag)))
    written = {}
    check(spark, made(7, 80), slices=2)
    assert written["suffixes"].where("suffix IS NOT NULL").count() > 1000


def test_common_runs_set_the_digits_and_not_the_result(spark, monkeypatch):
    phrase = prose("phrase", 14)
    data = [(k, f"{prose(k, 20)} {phrase} {prose(k // 2, 30)} {phrase}") for k in range(60)]
    for share in (suffixes.COMMON_SHARE, 1):
        monkeypatch.setattr(suffixes, "COMMON_SHARE", share)
        check(spark, data)
    monkeypatch.setattr(suffixes, "COMMON_SHARE", 128)
    docs = spark.createDataFrame(data, "id long, text string")
    common = suffixes.common_runs(docs, 20)
    assert len(common) > 20 and (np.sort(common) == common).all()


def test_one_letter_and_short_periods(spark):
    data = [(1, "a" * 700), (2, "a" * 49 + "b"), (3, "ab" * 200 + "a" * 60), (4, "ba" * 30), (5, "a" * 50), (6, "é" * 40)]
    check(spark, data)
    check(spark, data + [(7, "é" * 30), (None, "ab" * 40), (None, "a" * 80)])


def test_ids_that_repeat_are_not_held_against_each_other(spark):
    text = prose(1, 60)
    check(spark, [(4, text), (4, text), (4, text + " more"), (None, text[:70]), (None, text), (9, text)])


def test_a_text_that_a_third_of_all_rows_repeat(spark):
    data = made(3, 30)
    check(spark, data + [(1000, data[4][1])] * 200 + [(2000 + k, data[5][1]) for k in range(100)])


def test_windows_of_parts_are_those_of_the_text():
    import pyarrow as pa

    texts = pa.array([None, "x" * 10, "y" * 1000, "", "z" * 100])
    for most in (60, 100, 5000):
        seen = sorted((row + k, base + i) for row, base, _, offsets in suffixes.parts(texts, 50, most) for k in range(len(offsets) - 1) for i in range(offsets[k + 1] - offsets[k] - 49))
        assert seen == [(2, i) for i in range(951)] + [(4, i) for i in range(51)]


def test_empty_table_and_other_ids(spark):
    assert suffixes.suffix_dedup(frame(spark, [])).collect() == []
    with pytest.raises(TypeError):
        suffixes.suffix_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(ValueError):
        suffixes.suffix_dedup(frame(spark), window=4, gram=5)
