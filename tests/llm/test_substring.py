import random

import numpy as np
import pyarrow as pa
import pytest
from common import frame, prose, rows, words

from gatehouse.llm import substring


NONE = np.empty(0, np.uint64)


def brute(data, window):
    """{(id, text): (n_words, kept words)}; rows repeated in full are one document."""
    out, seen = {}, set()
    for key, text in sorted(set(data), key=lambda r: (r[0] is not None, r[0] or 0)):
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone.update(range(i, i + window))
            seen.add(x)
        out[key, text] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return out


def unique_ids():
    """Rows whose ids tell documents apart (the order of others is the operator's own)."""
    return [r for r in rows() if r[0] is not None]


@pytest.mark.parametrize("window,gram", [(20, 6), (8, 3), (5, 5)])
def test_documents_match_brute_force(spark, window, gram):
    data = unique_ids()
    want = brute(data, window)
    got = substring.substring_dedup(frame(spark, data), window=window, gram=gram).collect()
    assert len(got) == len(data)
    for r in got:
        text = next(t for k, t in data if k == r.doc_id)
        n, kept = want[r.doc_id, text]
        assert (r.n_words, r.n_removed, words(r.text)) == (n, n - len(kept), kept), r.doc_id


def test_random_documents_of_shared_pieces(spark):
    r = random.Random(5)
    pieces = [prose(k, r.randint(5, 90)) for k in range(40)]
    data = [(k, " ".join(r.choice(pieces) for _ in range(r.randint(1, 9)))) for k in range(300)]
    r.shuffle(data)
    want = brute(data, 20)
    got = substring.substring_dedup(frame(spark, data).repartition(7)).collect()
    by = dict(data)
    for row in got:
        n, kept = want[row.doc_id, by[row.doc_id]]
        assert (row.n_words, words(row.text)) == (n, kept), row.doc_id
        covered = set()
        for f in row.factors:
            assert f.length >= 20 and (f.ref_id, f.ref_start) < (row.doc_id, f.start)
            mine, theirs = words(by[row.doc_id])[f.start : f.start + f.length], words(by[f.ref_id])[f.ref_start : f.ref_start + f.length]
            assert mine == theirs
            covered.update(range(f.start, f.start + f.length))
        assert len(covered) == row.n_removed


def test_repeated_and_null_ids(spark):
    got = substring.substring_dedup(frame(spark)).collect()
    assert len(got) == len(rows())
    twice = [r for r in got if r.doc_id == 9]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_the_parse_is_greedy_and_covers_what_matches_cover():
    r = random.Random(3)
    for _ in range(300):
        spans = sorted((a := r.randrange(60), a + r.randint(5, 20)) for _ in range(r.randint(0, 12)))
        start, end = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
        chosen = [spans[k] for k in substring.parse(start, end)]
        covered = lambda xs: {p for a, b in xs for p in range(a, b)}
        assert covered(chosen) == covered(spans)
        place = -1
        for a, b in chosen:  # from the place reached, none that begins there or before goes on farther
            here = place if any(x <= place < y for x, y in spans) or any(x == place for x, _ in spans) else min(x for x, _ in spans if x > place)
            assert b == max(y for x, y in spans if x <= here) > place and a <= here
            place = b


def test_common_runs_set_the_anchors_and_not_the_result(spark, monkeypatch):
    """A phrase of eight words in every document, in other words each time, and passages that two share."""
    phrase = " ".join(f"every{k}" for k in range(8))
    data = [(k, f"{prose(k, 40)} {phrase} {prose(k // 2, 60)} {phrase}") for k in range(60)]
    want = brute(data, 20)
    for share in (substring.COMMON_SHARE, 1):
        monkeypatch.setattr(substring, "COMMON_SHARE", share)
        for row in substring.substring_dedup(frame(spark, data).repartition(3)).collect():
            n, kept = want[row.doc_id, dict(data)[row.doc_id]]
            assert (row.n_words, row.n_removed, words(row.text)) == (n, n - len(kept), kept), row.doc_id
    docs = spark.createDataFrame(data, "id long, text string")
    monkeypatch.setattr(substring, "COMMON_SHARE", 256)
    common = substring.common_runs(docs, 6)
    assert len(common) >= 3 and (np.sort(common) == common).all()


def test_spaces_of_kept_words_stay(spark):
    shared = " ".join(f"w{k}" for k in range(30))
    got = substring.substring_dedup(frame(spark, [(1, shared), (2, f"a\tb\n{shared}  \nc  d ")])).collect()
    assert {r.doc_id: r.text for r in got} == {1: shared, 2: "a\tb\nc  d "}


def test_empty(spark):
    assert substring.substring_dedup(frame(spark, [])).collect() == []


def test_a_document_that_a_third_of_all_rows_repeat(spark):
    passage = prose("passage", 45)
    data = [(k, f"{prose(k, 30)} {passage if k % 3 else ''} {prose(-k, 25)}") for k in range(12)]
    data += [data[7]] * 300 + [(50, f"{passage} {passage}")] * 40
    want = brute(data, 20)
    got = substring.substring_dedup(frame(spark, data).repartition(5)).collect()
    assert len(got) == len(data)
    by = dict(data)
    for row in got:
        n, kept = want[row.doc_id, by[row.doc_id]]
        assert (row.n_words, row.n_removed, words(row.text)) == (n, n - len(kept), kept), row.doc_id
    one = substring.block_rows(pa.RecordBatch.from_pydict({"id": pa.array([1]), "sub": pa.array([0], pa.int32()), "text": pa.array([data[7][1]])}), 20, 6, NONE)
    many = substring.block_rows(pa.RecordBatch.from_pydict({"id": pa.array([1] * 9), "sub": pa.array([0] * 9, pa.int32()), "text": pa.array([data[7][1]] * 9)}), 20, 6, NONE)
    assert one.num_rows == many.num_rows


def test_thousands_of_texts_under_one_null_id(spark):
    """Each is its own document: what no other has stays, and of each shared passage one copy."""
    passages = [" ".join(f"p{k}w{j}" for j in range(25)) for k in range(40)]
    own = [" ".join(f"d{k}w{j}" for j in range(22 + k % 9)) for k in range(4000)]
    data = [(None, f"{text} {passages[k % 40]}" if k % 2 else text) for k, text in enumerate(own)]
    got = substring.substring_dedup(frame(spark, data, extra=False).repartition(3)).collect()
    assert len(got) == len(data)
    left = {r.text.split()[0]: r for r in got}
    assert len(left) == len(data)
    for k, text in enumerate(own):
        row = left[f"d{k}w0"]
        assert row.text.strip() in (text, f"{text} {passages[k % 40]}"), k
        assert row.n_words == len(words(data[k][1]))
    assert sum(r.n_removed > 0 for r in got) == 2000 - 20
