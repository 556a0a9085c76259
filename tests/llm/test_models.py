"""Language identification and the quality classifier: held-out accuracy and odd rows."""

import random
import zlib

import numpy as np
from common import frame, rows

from gatehouse.llm import langid, quality_model

PARTS = {"aa": "the tion ing and er of", "bb": "sch ung der ein lich keit", "cc": "ción que los ado mente ñe"}


def written(lang, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(PARTS[lang].split(), k=r.randint(1, 3))) for _ in range(n))


def test_languages_held_out(spark):
    data = [(k, written(lang := "aabbcc"[k % 3 * 2 : k % 3 * 2 + 2], k, 3 + k % 40), lang) for k in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    held = {k for k, _, _ in data if zlib.crc32(str(k).encode()) % 3 == 1}
    model = langid.fit(df.where("crc32(cast(doc_id as string)) % 3 != 1"), per_language=60)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert np.mean([got[k].nearest == lang for k, _, lang in data if k in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.rejected for r in got.values()]) < 0.2


def test_language_of_odd_rows_and_rejection(spark):
    df = spark.createDataFrame([(k, written(lang, k, 30), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 30)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    odd = [*rows(), (500, "12 34 !!"), (501, "漢字だけの文章です"), (502, written("bb", 1, 50))]
    got = langid.identify(frame(spark, odd), model).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert (by[0].nearest, by[0].score, by[500].nearest, by[500].score) == ("und", 0.0, "und", 0.0) or by[0].nearest == "und"
    assert by[501].rejected and by[501].lang == "und" and by[501].nearest in PARTS
    assert not by[502].rejected and by[502].lang == "bb"


def test_language_without_labels_and_without_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.fit(df) is None
    assert [(r.lang, r.score) for r in langid.identify(df, None).collect()] == [("und", 0.0)]
    assert langid.identify(frame(spark, []), None).collect() == []


def test_ngram_counts_match_brute_force():
    texts = ["ab", "", "Ab c", "x", "é9"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for t, got in zip(texts, langid.counts(data, offsets), strict=True):
        b = [int(langid.LETTERS[x]) for x in t.encode()]
        want = np.zeros(langid.DIMENSIONS, int)
        for n in (1, 2, 3):
            for k in range(len(b) - n + 1):
                gram = int.from_bytes(bytes(b[k : k + n]), "big")
                want[((gram + (n << 24)) * 2654435761 % 2**32) >> 20] += 1
        assert got.tolist() == want.tolist()


def test_quality_held_out(spark):
    data, labels = [], []
    for k in range(800):
        good = k % 3 > 0
        text = written("aa", k, 20 + k % 60)
        data.append((k, text if good else text.replace(" ", "*** " if k % 2 else " | ")))
        if k % 5:
            labels.append((k, int(good)))
    df = frame(spark, data)
    marks = spark.createDataFrame([*labels, (None, 1), (10_000, 1), (7, None)], "doc_id long, quality int")
    model = quality_model.fit(df, marks.where("crc32(cast(doc_id as string)) % 4 != 2"))
    got = {r.doc_id: r for r in quality_model.classify(df, model).collect()}
    held = [(k, q) for k, q in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k].predicted == q for k, q in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_quality_of_odd_rows_and_without_labels(spark):
    empty = quality_model.fit(frame(spark), spark.createDataFrame([], "doc_id long, quality int"))
    got = quality_model.classify(frame(spark), empty).collect()
    assert len(got) == len(rows()) and {r.score for r in got} == {0.5}
    same = quality_model.fit(frame(spark), spark.createDataFrame([(k, 1) for k in range(12)], "doc_id long, quality int"))
    assert all(r.score > 0.6 for r in quality_model.classify(frame(spark), same).collect())
    assert quality_model.classify(frame(spark, []), same).collect() == []


def test_flat_trees_fit_a_rule():
    r = np.random.default_rng(0)
    x = r.random((4000, 5))
    y = ((x[:, 1] > 0.6) ^ (x[:, 3] > 0.3)).astype(float)
    model = quality_model.grow(x[:3000], y[:3000])
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.98


def test_languages_of_rows_that_share_one_id(spark):
    data = [(7, written(lang, k, 20), lang) for k, lang in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(df, per_language=2)
    assert model and set(model.languages) == {"aa", "bb"}
    assert langid.identify(df, model).where("nearest NOT IN ('aa', 'bb')").isEmpty()
