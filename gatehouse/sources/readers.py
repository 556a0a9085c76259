"""Readers with explicit schemas.  Rows keep their line where order decides (the last of a key wins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_non_blank, non_blank

#: The columns of a manifest; all but the first may be null.
MANIFEST = "sample_id string, source string, task string, split string, language string, audio_path string, text string, transcript string, dataset string, dataset_config string, domain string, intent string, question string, context string, answer string, target_text string, query_style string, tts_dialect string, document_id string, document_text string"
RESULT_ROW = "sample_id string, id string, target string, prediction string, rank long, text_rank long, sample_rank long, omni_rank long, asr_rank long, rrf_rank long, hit_at_1 boolean, text_hit_at_1 boolean, sample_hit_at_1 boolean"


def read_jsonl(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """One row for each line that is not blank; unknown fields are left out."""
    return spark.read.schema(schema).json(path)


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in the order of ``order``: an aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_b"))
    return best.select(key, "_b._row.*")


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_b"))
    return best.select(key, "_b._row.*")


def read_report_rows(spark: SparkSession, path: str, places: tuple[str, ...] = ("$.rows", "$.metrics.test.rows", "$.metrics.omni_audio.rows"), row: str = RESULT_ROW) -> DataFrame:
    """The rows of report documents (one JSON a file), from the first place that has them; an error if none has."""
    fields = ",".join(f"{n}:{t}" for n, t in (x.split() for x in row.split(", ")))
    kind = f"array<struct<{fields}>>"
    parsed = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = F.coalesce(*[F.try_variant_get("v", p, kind) for p in places], F.raise_error(F.lit(f"no rows at {', '.join(places)}")))
    return parsed.select(F.inline(rows)).withColumn("sample_id", F.coalesce("sample_id", "id")).drop("id")


def candidates(spark: SparkSession, named: dict[str, str], baseline: str | None = None) -> DataFrame:
    """Several reports in long form, with candidate and pos (their order)."""
    if baseline is not None and baseline not in named:
        raise ValueError(f"no candidate is named {baseline}")
    parts = [read_report_rows(spark, path).withColumns({"candidate": F.lit(name), "pos": F.lit(i).cast("long")}) for i, (name, path) in enumerate(named.items())]
    return reduce(DataFrame.unionByName, parts)


def spec(text: str, separator: str = "=") -> tuple[str, str]:
    """(name, path) of ``name=path``, split at the first separator."""
    name, found, path = text.partition(separator)
    if not found or not name:
        raise ValueError(f"not name{separator}path: {text}")
    return name, path


def manifest(df: DataFrame, fields: dict[str, list[str]], prefix: str = "") -> DataFrame:
    """A foreign table as a manifest: each column is the first non-blank of its fields; the id gets a prefix, and where
    it is blank the hash of the row stands in."""
    first = lambda names: first_non_blank(*[F.col(c).cast("string") for c in names])
    own = first(fields["sample_id"])
    row = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    out: list[Column] = [F.concat(F.lit(prefix), F.coalesce(non_blank(own), row)).alias("sample_id")]
    return df.select(*out, *[first(f).alias(c) for c, f in fields.items() if c != "sample_id"])


def clips(df: DataFrame, path: str = "path", codes: dict[str, str] | None = None) -> DataFrame:
    """(path, speaker, sentence, emotion) from file names ``speaker_sentence_CODE_level.ext``; unknown codes in lower case."""
    parts = F.split(F.element_at(F.split(F.col(path), "/"), -1), "_")
    code = F.get(parts, F.lit(2))
    table = F.create_map(*[F.lit(x) for kv in (codes or {"ANG": "anger", "DIS": "disgust", "FEA": "fear", "HAP": "happy", "NEU": "neutral", "SAD": "sad"}).items() for x in kv])
    return df.select(path, F.get(parts, F.lit(0)).alias("speaker"), F.get(parts, F.lit(1)).alias("sentence"), F.coalesce(F.element_at(table, code), F.lower(code)).alias("emotion"))


def audio_kind(data: Column | str, path: Column | str) -> Column:
    """The container by its first bytes, else by the path's suffix."""
    head = F.hex(F.substring(data, 1, 4))
    suffix = F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1)
    return F.when(head == "52494646", ".wav").when(F.startswith(head, F.lit("494433")), ".mp3").when(head == "664C6143", ".flac").otherwise(suffix)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): text lines with their number in their file, from 0, however many tasks read a file.

    Spark cuts files into blocks; a line belongs to the block where it begins.  Lines are counted by block, one row a
    block, and what stands before a block in its file returns by broadcast."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(blocks), ["file", "_start"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value")
