"""Writers.  Spark's commit protocol makes a result whole or absent; reports are small and ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Row-level results: Parquet, JSON lines or ORC, as many files as there are tasks."""
    getattr(df.write.mode("overwrite"), kind)(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A leaderboard as one CSV file with a header, ordered; for reports, which are small."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line): a table as Markdown; numbers with four digits, null as blank, pipes escaped."""
    def cell(name: str, kind: str) -> F.Column:
        c = F.col(name)
        text = F.format_string("%.4f", c.cast("double")) if kind in ("double", "float") else c.cast("string")
        return F.when(c.isNull(), "").otherwise(F.replace(text, F.lit("|"), F.lit("\\|")))

    names = df.columns
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(n, t) for n, t in df.dtypes]), F.lit(" |"))
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("r")).select(F.posexplode("r").alias("i", "x")).select((F.col("i") + 2).alias("line_no"), "x.line")
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(names) + " |"), (1, "|" + "---|" * len(names))], "line_no int, line string")
    return head.unionByName(rows)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a digest of a set of rows that does not depend on their order, summed without gathering them."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat(F.coalesce(F.sum(h), F.lit(0)).cast("string"), F.lit(":"), F.count(F.lit(1)).cast("string")), 256).alias("digest"))
