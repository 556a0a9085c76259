"""Rows that share an id, or have none, stay or go each by its own verdict."""

from common import prose

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B, C = (prose(k, 80) for k in "ABC")


def left(spark, stage, data):
    docs = spark.createDataFrame([(*r, None, None, None) for r in data], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.text) for r in stage(spark, docs, "").collect()), key=repr)


def test_exact_dedup_keeps_one_of_equal_texts(spark):
    assert left(spark, corpus_pipeline.exact_dedup, [(None, A), (None, B), (5, B)]) == sorted([(None, A), (5, B)], key=repr)
    assert left(spark, corpus_pipeline.exact_dedup, [(7, A), (7, B), (5, B), (7, A)]) == sorted([(7, A), (5, B)], key=repr)


def test_near_dedup_keeps_one_of_near_copies(spark):
    near = f"{B} end"
    assert left(spark, corpus_pipeline.near_dedup, [(None, A), (None, near), (5, B)]) == sorted([(None, A), (5, B)], key=repr)
    assert left(spark, corpus_pipeline.near_dedup, [(7, A), (7, near), (5, B), (7, C), (7, C)]) == sorted([(5, B), (7, A), (7, C)], key=repr)
