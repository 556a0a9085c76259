import hashlib
import random
import re

import pytest
from common import frame, rows
from pyspark.sql import functions as F

from gatehouse.llm import exact


def brute(data):
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in data]
    groups = {}
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    out = []
    for i, n in enumerate(norm):
        best = min(groups[n], key=lambda j: (-len(data[j][1] or ""), data[j][0] is None, data[j][0] or 0))
        out.append((data[i][0], data[best][0], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_documents_match_brute_force(spark):
    got = exact.exact_dedup(frame(spark)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(brute(rows()), key=repr)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.keep_id == r.doc_id for r in got if r.kept)


def test_hot_groups_take_the_broadcast(spark):
    data = [(k, "same text") for k in range(30)] + [(100 + k, f"other {k}") for k in range(5)] + [(200, "other 1 ")]
    got = exact.exact_dedup(frame(spark, data)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(brute(data), key=repr)


def bytes_of(chunks):
    return "".join(chunks).encode("latin-1").decode()


@pytest.mark.parametrize("script", ["latin", "cyrillic", "greek", "cjk", "hangul", "emoji"])
def test_chunks_are_content_defined(spark, script):
    """One character before a text moves its first chunks alone, in any script."""
    first = {"latin": 0x61, "cyrillic": 0x430, "greek": 0x3B1, "cjk": 0x4E00, "hangul": 0xAC00, "emoji": 0x1F400}[script]
    r = random.Random(script)
    size = 26 if first < 0x4E00 else 400
    passage = "".join(chr(first + r.randrange(size)) for _ in range(20000))
    df = spark.createDataFrame([(passage,), ("x" + passage,)], "text string")
    cut = [r[0] for r in df.select(exact.chunked(exact.normalised(df.text))).collect()]
    assert [bytes_of(c) for c in cut] == [passage, "x" + passage]
    a, b = map(set, cut)
    assert len(cut[0]) > 20 and len(a & b) >= 0.9 * len(a)


def test_recipes_decide(spark):
    """Where all chunks get one identifier, the dictionary sees that contents share it, and another kind is taken; where all
    kinds clash, the job fails; and no kind that is verified gives other groups."""
    data = [(k, t) for k, t in rows() if k is not None]
    want = sorted(map(repr, brute(data)))
    asked = []

    def name(chunk, attempt):
        asked.append(attempt)
        return F.lit(1).cast("long") if attempt < 2 else exact.identifier(chunk, attempt)

    got = exact.exact_dedup(frame(spark, data), min_chunk=8, max_chunk=64, name=name).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert max(asked) == 2
    with pytest.raises(RuntimeError):
        exact.exact_dedup(frame(spark, data), name=lambda chunk, attempt: F.pmod(F.xxhash64(chunk), F.lit(2)))


def test_empty(spark):
    assert exact.exact_dedup(frame(spark, [])).collect() == []
