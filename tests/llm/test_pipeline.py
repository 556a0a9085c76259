"""The pipeline against its stages' brute-force versions, one after the other."""

import test_exact
import test_jaccard
import test_quality
import test_substring
from common import prose, rows, words
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    passage = prose("shared", 70)
    made = {100 + k: prose(f"doc{k}", 80 + 5 * k) for k in range(30)}
    out = [r for r in rows() if r[0] is not None] + list(made.items())
    out += [(200 + k, made[100 + k]) for k in range(5)] + [(300 + k, made[110 + k].replace(" ", "  ") + "\n") for k in range(5)]
    out += [(400 + k, made[120 + k] + " end") for k in range(5)] + [(500 + k, f"{prose(f'own{k}', 60)}\n{passage}\n{prose(f'more{k}', 60)}") for k in range(6)]
    return [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in out]


def brute(data):
    data = [(k, t) for k, t, *_ in data if test_quality.brute(t)[5]]
    data = [r for r, b in zip(data, test_exact.brute(data), strict=True) if b[0] == b[1]]
    data = list(dict.fromkeys(data))
    data = [r for r, low in zip(data, test_jaccard.brute([t for _, t in data]), strict=True) if r == data[low]]  # by id, and ids are in order
    kept = test_substring.brute(data, 20)
    return {k: w for (k, _), (_, w) in kept.items() if w}


def test_run_matches_brute_force(spark, tmp_path):
    data = documents()
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    parts = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(parts.setdefault(r.doc_id, []))
        parts[r.doc_id] += r.ids
    assert all(ids[-1] == 0 for ids in parts.values())
    got = {k: words(tokenizer.decode(ids[:-1], skip_special_tokens=False)) for k, ids in parts.items()}
    want = brute(data)
    assert len(want) < len({k for k, *_ in data}) - 10
    assert got == want


def test_stages_keep_the_columns_of_documents_and_bear_odd_rows(spark):
    odd = [(k, t, None, None, None) for k, t in rows()]
    for data in (odd, []):
        docs = spark.createDataFrame(data, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.count() <= len(data)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= bool(data)
