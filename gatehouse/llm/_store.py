"""What the operators write on the way, and names for rows."""

from __future__ import annotations

import contextlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialize, release, scratch, shared_dir, shuffles_cleaned

__all__ = ["materialize", "numbered", "partitions", "release", "scratch", "shared_dir", "shuffles_cleaned"]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with two more columns that name each row, file_hash (of the path) and file_row: a table read from Parquet
    has them at hand and is not copied; any other is written first."""
    names = [c for c in ("file_hash", "file_row") if c in df.columns]
    if names:
        raise ValueError(f"the columns {names} are taken")
    with contextlib.suppress(AnalysisException):
        return df.select("*", F.xxhash64("_metadata.file_path").alias("file_hash"), F.col("_metadata.row_index").alias("file_row"))
    return numbered(materialize(df, "numbered"))


def partitions(spark: SparkSession) -> int:
    """How many tasks a stage gets whose work is large against its bytes, so that AQE must not merge them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
