"""Files: what is written is read again, and tables of names, keys and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import similarity
from ..shared import folder
from ..sources import readers, sinks
from ..views import table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


@query("""WITH l AS (SELECT doc_id % 97 AS k, max(doc_id) AS doc_id, min(doc_id) AS first FROM documents GROUP BY 1) SELECT CAST(k AS VARCHAR) AS sample_id, lang AS dataset, text, first FROM l JOIN documents d ON d.doc_id = l.doc_id""")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest of JSON lines; of rows with one id the last is read, and the first is told."""
    path = folder(spark, "manifest")
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).cast("string").alias("sample_id"), F.col("lang").alias("dataset"), "text", F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("unknown"))
    sinks.write_rows(d, path, "json")
    rows = readers.read_jsonl(spark, path).select("sample_id", "dataset", "text", F.col("document_id").cast("long").alias("at"))
    first = readers.first_wins(rows, "sample_id", ["at"]).select("sample_id", F.col("at").alias("first"))
    return readers.last_wins(rows, "sample_id", ["at"]).select("sample_id", "dataset", "text").join(first, "sample_id")


@query("""WITH n AS (SELECT item_id, unnest(['base', 'new']) AS candidate FROM benchmark) SELECT candidate, CASE candidate WHEN 'base' THEN 0 ELSE 1 END::BIGINT AS pos, CAST(item_id AS VARCHAR) AS sample_id, CASE candidate WHEN 'base' THEN item_id % 5 + 1 ELSE item_id % 3 + 1 END AS rank FROM n""")
def candidate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports that keep their rows in different places, read as candidates in their order."""
    named = []
    for name, size, key in (("base", 5, "sample_id"), ("new", 3, "id")):
        row = F.struct(F.col("item_id").cast("string").alias(key), (F.col("item_id") % size + 1).alias("rank"))
        rows = table(spark, sf_dir, "benchmark").agg(F.collect_list(row).alias("rows"))  # a benchmark's report is one document
        whole = F.struct("rows") if name == "base" else F.struct(F.struct(F.struct("rows").alias("test")).alias("metrics"))
        path = folder(spark, f"report-{name}")
        rows.select(F.to_json(whole).alias("value")).write.text(path)
        named.append(f"{name}={path}")
    reports = readers.candidates(spark, dict(readers.spec(x) for x in named), "base")
    return reports.select("candidate", "pos", "sample_id", "rank")


BOARD_SQL = "b AS (SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, CASE WHEN lang = 'en' THEN 'a|b' END AS note FROM documents GROUP BY lang)"


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
    return d.withColumn("note", F.when(F.col("lang") == "en", "a|b"))


@query(f"WITH {BOARD_SQL} SELECT lang, n, mean_chars, note FROM b")
def board_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "board")
    sinks.write_csv(board(spark, sf_dir), path, ["lang"])
    return spark.read.schema("lang string, n long, mean_chars double, note string").option("header", True).csv(path)


@query(f"""WITH {BOARD_SQL}, l AS (SELECT row_number() OVER (ORDER BY lang) + 1 AS line_no, '| ' || lang || ' | ' || n || ' | ' || printf('%.4f', mean_chars) || ' | ' || coalesce(replace(note, '|', chr(92) || '|'), '') || ' |' AS line FROM b)
SELECT CAST(line_no AS INT) AS line_no, line FROM l UNION ALL SELECT 0, '| lang | n | mean_chars | note |' UNION ALL SELECT 1, '|---|---|---|---|'""")
def board_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown(board(spark, sf_dir), ["lang"])


@query("""WITH h AS (SELECT CAST('0x' || substr(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}'), 1, 15) AS HUGEINT) AS h FROM documents) SELECT count(*) AS rows, sha256(CAST(sum(h) AS VARCHAR) || ':' || count(*)) AS digest FROM h""")
def table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "lang"])


@query("""SELECT doc_id, CAST(1000 + doc_id % 90 AS VARCHAR) AS speaker, (['IEO', 'TIE'])[doc_id % 2 + 1] AS sentence, (['anger', 'sad', 'xyz'])[doc_id % 3 + 1] AS emotion, (['.wav', '.mp3', '.flac', '.ogg', ''])[doc_id % 5 + 1] AS kind FROM documents""")
def clip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clips' names say, and their kind by their first bytes, else by their name."""
    v = F.col("doc_id")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(v, F.lit(len(xs))) + 1).cast("int"))
    path = F.concat(F.lit("data/x/"), (1000 + v % 90).cast("string"), F.lit("_"), pick("IEO", "TIE"), F.lit("_"), pick("ANG", "SAD", "XYZ"), F.lit("_XX"), F.when(v % 5 == 3, ".OGG").otherwise(""))
    d = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.unhex(pick("5249464600", "4944330400", "664C614300", "00000000", "00")).alias("data"))
    named = readers.clips(d.select("path").distinct())
    return d.join(named, "path").select("doc_id", "speaker", "sentence", "emotion", readers.audio_kind(F.col("data"), F.col("path")).alias("kind"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'x_' || doc_id ELSE 'x_' || sha256('{"key":"","doc_id":' || doc_id || ',"lang":"' || lang || '"}') END AS sample_id, lang AS dataset FROM documents""")
def manifest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with a prefix; where a row has none the hash of the row stands in."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")).otherwise("").alias("key"), "doc_id", "lang")
    made = readers.manifest(d, {"sample_id": ["key"], "dataset": ["lang"], "doc_id": ["doc_id"]}, "x_")
    return made.select(F.col("doc_id").cast("long").alias("doc_id"), "sample_id", "dataset")


@query("""SELECT doc_id, sha256(doc_id || '||say ' || lang) AS key, doc_id % 4 > 0 AS cached FROM documents""")
def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose vectors are kept under their id and instruction, and those that are yet to be encoded."""
    rows = table(spark, sf_dir, "documents").select("doc_id", similarity.cache_key(F.col("doc_id").cast("string"), F.concat(F.lit("say "), F.col("lang"))).alias("key"))
    cache = rows.where("doc_id % 4 > 0").select("key", F.array(F.lit(0.5)).alias("vector"))
    have, lack = similarity.with_cache(rows, cache)
    return have.select("doc_id", "key", F.lit(True).alias("cached")).unionByName(lack.select("doc_id", "key", F.lit(False).alias("cached")))


@query(r"""SELECT doc_id, lower(trim(regexp_replace(text, '[\s\x85\p{Z}]+', ' ', 'g'))) AS plain, CASE WHEN doc_id % 2 = 0 THEN 'from question' ELSE text END AS said, CASE WHEN doc_id % 5 = 0 THEN 0e0 WHEN doc_id % 5 = 1 THEN 1e0 ELSE 0.5e0 END AS overlap FROM documents""")
def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised candidate texts, the first field of a row that is not blank, and how far two texts' words overlap."""
    v = F.col("doc_id")
    other = F.when(v % 5 == 0, "").when(v % 5 == 1, "alpha beta gamma").otherwise("beta delta")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(v % 2 == 0, "from question").otherwise("").alias("question"), other.alias("other"))
    from ..functions.parsing import overlap_coefficient

    return d.select("doc_id", T.normalize_candidate_text("text").alias("plain"), T.first_non_blank("question", "text").alias("said"), F.round(overlap_coefficient(F.lit("alpha beta"), "other"), 6).alias("overlap"))
