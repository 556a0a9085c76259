import base64
import random

import pytest
import tiktoken
from common import frame, rows
from tokenizers import Tokenizer

import public_tokenizers as P
from gatehouse.llm import bpe

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


def odd_texts():
    r = random.Random(3)
    letters = "aaaabbc  \n\t'sdtremvl019!?.-_é漢  \x1c\x85ß😀ABC"
    out = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    out += ["".join(r.choice("etaoin") for _ in range(40)) for _ in range(2000)] + ["a" * k for k in range(100)] + ["e" * 3000]
    points = [chr(c) for c in range(0x20, 0x3000)]
    return out + ["a".join(points[k : k + 50]) for k in range(0, len(points), 50)] + [t or "" for _, t in rows()]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ranks_give_the_ids_of_tiktoken_and_decode_to_the_text(tik, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 2000)
    one, texts = bpe.ByteBPE(RANKS, P.PATTERN), odd_texts()
    for k in range(0, len(texts), 700):
        part = texts[k : k + 700]
        ids, bounds = one.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [tik.encode_ordinary(t) for t in part]
        data, edges = one.decode(ids, bounds)
        assert [data[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [t.encode() for t in part]


def test_json_gives_the_ids_and_offsets_of_the_library():
    one, texts = bpe.ByteBPE(JSON), odd_texts()
    whole = Tokenizer.from_file(JSON)
    whole.encode_special_tokens = True
    ids, bounds = one.encode(texts)
    starts, ends = one.offsets(ids, bounds)
    for k, want in enumerate(whole.encode_batch(texts, add_special_tokens=False)):
        mine = slice(bounds[k], bounds[k + 1])
        assert ids[mine].tolist() == want.ids
        assert list(zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)) == want.offsets


def test_frames_round_trip(spark, tik):
    encoded = bpe.encode(frame(spark), RANKS, P.PATTERN, offsets=True)
    got = encoded.collect()
    assert sorted((r.doc_id is None, r.doc_id, r.ids) for r in got) == sorted((k is None, k, tik.encode_ordinary(t or "")) for k, t in rows())
    back = bpe.decode(encoded, RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((t or "").encode() for _, t in rows())
    assert all(r.text.encode() == bytes(r.data) for r in back)


def test_a_split_character(spark):
    ids = bpe.ByteBPE(JSON).encode(["漢"])[0].tolist()
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(df, JSON).collect()} == {1: "漢", 2: "�", 3: ""}


def test_empty(spark):
    assert bpe.encode(frame(spark, []), JSON).collect() == []
