"""A corpus pipeline of five operators: quality rules, exact dedup, near-dedup, substring dedup, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame, reads only ``docs``, and all but the last return its columns.
Filters keep whole rows, each by its own verdict: rows are named by their places in the table read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import exact, packing, quality, simhash, substring
from gatehouse.llm._store import materialize, numbered, scratch

VOCABULARY = "byte_bpe_50k.json"
ROW = ("file_hash", "file_row")


def keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``numbered``) that ``verdicts`` keeps."""
    kept = verdicts.where("kept").select(*[F.col(f"carry_{c}").alias(c) for c in ROW])
    return docs.join(kept, list(ROW), "left_semi").drop(*ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep(docs, quality.plan_cascade(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest, then the one of the smallest id."""
    docs = numbered(docs)
    return keep(docs, exact.exact_dedup(docs, carry=ROW))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8) the document of the smallest id."""
    docs = numbered(docs)
    return keep(docs, simhash.near_copies(docs, shingle=5, carry=ROW))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier elsewhere; a document of which no word is left goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring.substring_dedup(docs, carry=tuple(rest)).where("n_removed = 0 OR n_removed < n_words")
    new = {c: F.col(f"carry_{c}").alias(c) for c in rest}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("carry_n_chars")).alias("n_chars")
    return out.select(*[new.get(c, F.col(c)) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), special=True)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: A tokenizer's ids and the order of best-fit placement are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again, and what it has written itself goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark, keep=1):
            docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
