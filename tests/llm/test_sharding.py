import zlib
from collections import Counter

from common import frame, rows

from gatehouse.llm import sharding


def test_columns_slots_and_nulls(spark):
    got = sharding.shard(frame(spark), [1.0] * 5, grown=[1.0] * 6).collect()
    assert len(got) == len(rows())
    want = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_growth_and_shrinking_move_only_what_they_must(spark):
    df = frame(spark, [(k, str(k)) for k in range(4000)])
    got = sharding.shard(df, [1.0] * 24, grown=[1.0] * 25).collect()
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert 80 < sum(r.grown_shard == 24 for r in got) < 260
    less = sharding.shard(df, [1.0] * 24, grown=[1.0] * 23 + [0.0]).collect()
    assert all(r.shard == r.grown_shard for r in less if r.shard != 23)
    assert all(r.grown_shard != 23 for r in less)


def test_weights(spark):
    got = Counter(r.shard for r in sharding.shard(frame(spark, [(k, "") for k in range(6000)]), [1.0, 3.0, 2.0]).collect())
    assert abs(got[1] - 3000) < 200 and abs(got[2] - 2000) < 200


def test_empty(spark):
    assert sharding.shard(frame(spark, []), [1.0] * 3).collect() == []
