"""Resuming an evaluation: rows that are done and compatible are reused, the rest are evaluated and appended."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def remaining(rows: DataFrame, done: DataFrame, key: str = "sample_id", config: str | None = None, value: str | None = None) -> DataFrame:
    """Rows without a done one; with ``config``, done under another configuration does not count."""
    ours = done if config is None else done.where(F.col(config) == value)
    return rows.join(ours.select(key).distinct(), key, "left_anti")


def reused(rows: DataFrame, done: DataFrame, key: str = "sample_id", config: str | None = None, value: str | None = None) -> DataFrame:
    ours = done if config is None else done.where(F.col(config) == value)
    return ours.join(rows.select(key).distinct(), key, "left_semi")


def fingerprint(config: dict[str, object], keys: tuple[str, ...] | None = None) -> str:
    """What a configuration is kept under: the SHA-256 of its canonical JSON, of ``keys`` only if these are given."""
    told = {k: config.get(k) for k in keys} if keys else config
    return hashlib.sha256(json.dumps(told, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()


def written(spark: SparkSession, output: str) -> DataFrame | None:
    """What attempts have appended so far, if any."""
    try:
        return spark.read.parquet(output)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def latest(done: DataFrame, key: str, config: str) -> DataFrame:
    """One row a key of what was done under a configuration: a complete one if there is any, the last of these."""
    best = F.max_by(F.struct(*done.columns), F.struct("complete", "attempt"))
    return done.where(F.col("config") == config).groupBy(key).agg(best.alias("_b")).select("_b.*")


def resumed(rows: DataFrame, evaluate: Callable[[DataFrame], DataFrame], output: str, config: dict[str, object], key: str = "sample_id", slices: int = 8, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Evaluate ``rows`` slice by slice and return one result a key; what is complete under this configuration is not
    evaluated again, whoever did it.

    ``evaluate`` returns the key and an ``error`` (null if the row is complete).  Each slice is appended as a whole, without
    keys that are complete by then, so after an interruption at most one slice is repeated, and an attempt that is run
    twice changes nothing.  Rows with an error are evaluated again by the next attempt."""
    spark, own = rows.sparkSession, fingerprint(config, keys)
    have = written(spark, output)
    attempt = 0 if have is None else (have.where(F.col("config") == own).agg(F.max("attempt")).first()[0] or 0) + 1
    mine = rows.dropDuplicates([key]).withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)))
    for part in range(slices):
        have = written(spark, output)
        left = mine.where(F.col("_slice") == part).drop("_slice")
        if have is not None:
            left = remaining(left, have.where("complete"), key, "config", own)
        out = evaluate(left).withColumns({"complete": F.col("error").isNull(), "config": F.lit(own), "attempt": F.lit(attempt)})
        out.write.mode("append").parquet(output)
    return latest(written(spark, output), key, own).join(rows.select(key).distinct(), key, "left_semi")


def evaluate_stream(source: DataFrame, evaluate: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, key: str = "sample_id") -> StreamingQuery:
    """Evaluate new rows as they come and append them to Parquet at ``output``.  A batch that is run again after a
    failure leaves out what it has already appended, so each key is there once."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = written(spark, output)
        new = batch.dropDuplicates([key])
        evaluate(new if done is None else remaining(new, done, key)).write.mode("append").parquet(output)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
