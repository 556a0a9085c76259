import pytest
from common import frame, prose, rows
from tokenizers import Tokenizer

import public_tokenizers as P
from gatehouse.llm import packing

JSON = P.path("byte_bpe_50k.json")


def check(pieces, data, length, special=False):
    whole = Tokenizer.from_file(JSON)
    whole.encode_special_tokens = not special
    want = sorted(str([*whole.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in data)
    sequences, documents = {}, {}
    for r in pieces:
        assert len(r.ids) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    if len({k for k, _ in data}) == len(data):
        found = []
        for parts in documents.values():
            ids = []
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == len(ids)
                ids += r.ids
            assert all(r.doc_tokens == len(ids) for r in parts)
            found.append(str(ids))
        assert sorted(found) == want
    return sum(r.length for r in pieces) / (length * len(sequences))


@pytest.mark.parametrize("length,windows,parts", [(1024, 64, 1), (64, 4, 6), (16, 1, 9)])
def test_each_id_lies_in_one_piece(spark, length, windows, parts):
    data = [r for r in dict(reversed(rows())).items()]
    check(packing.pack(frame(spark, data).repartition(parts), JSON, length=length, open_windows=windows).collect(), data, length)


def test_leftovers_of_many_tasks_are_merged_with_little_padding(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 3)
    data = [(k, prose(k, 5 + k * 37 % 400)) for k in range(600)]
    df = frame(spark, data).repartition(12).cache()
    assert check(packing.pack(df, JSON, length=512, open_windows=16).collect(), data, 512) > 0.95


def test_repeated_and_null_ids(spark):
    pieces = packing.pack(frame(spark), JSON).collect()
    assert check(pieces, rows(), 1024) > 0.5
    assert sum(r.length for r in pieces if r.doc_id == 9) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 9)


def test_empty(spark):
    assert packing.pack(frame(spark, []), JSON).collect() == []


def test_special_tokens_as_the_library_takes_them(spark):
    data = [(1, "hello <|endoftext|> world"), (2, "<|endoftext|>"), (3, "a<|endoftext|><|endoftext|>  b <|endoftext|"), (4, prose(1, 50))]
    ids = {}
    for special in (False, True):
        got = packing.pack(frame(spark, data), JSON, length=16, special=special).collect()
        check(got, data, 16, special)
        ids[special] = {r.doc_id: r.ids for r in got if r.doc_id == 2}
    assert ids[True] == {2: [50256, 0]} and ids[False] != ids[True]
