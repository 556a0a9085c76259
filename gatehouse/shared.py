"""Cutting lineage through the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    It is set here only where the session has none, which is a single-machine test: a cluster without the
    setting is refused, because a driver-local folder is invisible to its executors.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="gatehouse-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _file(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def folder(spark: SparkSession, name: str) -> str:
    """A new folder there, which goes with the application."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, target = _file(spark, path)
    fs.deleteOnExit(target)
    return path


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside are deleted once it has ended, not when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lost executors only repeat the reading.

    The folder goes when it is released, when the ``scratch`` around it ends, or else with the application; the shuffles
    that led to it go at once."""
    path = folder(df.sparkSession, tag)
    with shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gatehouse_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_gatehouse_path", None)
    if path:
        fs, target = _file(df.sparkSession, path)
        fs.delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: int = 0) -> Iterator[None]:
    """What is materialised inside is deleted at the end, but for the last ``keep`` tables."""
    _scopes.append([])
    try:
        yield
    finally:
        paths = _scopes.pop()
        for path in paths[: len(paths) - keep]:
            fs, target = _file(spark, path)
            fs.delete(target, True)
