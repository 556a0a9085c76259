"""Manifests made from the driver's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifests as M
from ..views import table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


def spelt(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def one_of(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))


@query("""WITH n AS (SELECT doc_id, lang, text, row_number() OVER (ORDER BY doc_id) - 1 AS nth FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 6 < 4)
SELECT 'qa_' || lpad(CAST(nth AS VARCHAR), 6, '0') AS sample_id, doc_id AS dataset_index, lang AS answer, trim(text) AS question, CASE WHEN doc_id % 3 = 0 THEN 'said ' || lang ELSE trim(text) END AS transcript, false AS is_impossible FROM n WHERE nth < 300""")
def speech_qa_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in six shapes, of which two have no text; one question in seven is impossible.  300 rows that pass."""
    lang, v = F.col("lang"), F.col("doc_id")
    shapes = F.array(spelt('" ', lang, ' "'), spelt('["', lang, '", "x"]'), spelt('[{"text": "', lang, '"}]'), spelt('{"text": ["', lang, '"]}'), F.lit("5"), F.lit('{"text": 1}'))
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("question"), F.when(v % 3 == 0, spelt("said ", lang)).otherwise("").alias("transcription"), F.lit("").alias("context"),
        F.parse_json(F.element_at(shapes, (v % 6 + 1).cast("int"))).alias("answer"), (v % 7 == 0).alias("never"),
    )
    made = M.speech_qa(d, "doc_id", "qa", impossible="never", skip_impossible=True, require_answer=True, max_samples=300)
    return made.select("sample_id", "dataset_index", "answer", "question", "transcript", "is_impossible")


@query("""WITH m AS (SELECT doc_id, lang, doc_id % 8 = 1 AS bare FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS sample_id, CASE WHEN bare THEN '' ELSE lang || ' ' || doc_id || '|alt ' || lang END AS aliases, CASE WHEN doc_id % 4 = 0 THEN '' WHEN bare THEN '' ELSE lang || ', ' || doc_id END AS gold_answer,
  CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS asr, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS omni, CASE WHEN doc_id % 2 = 0 THEN 'q' ELSE 't' END || doc_id AS target FROM m""")
def qa_rag_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with its lists of two retrievers, which not every row has, and the aliases that count as answers."""
    v, lang, key = F.col("doc_id"), F.col("lang"), F.col("doc_id").cast("string")
    raw = F.when(v % 8 != 1, spelt('["', F.upper(lang), " ", key, '!", {"text": "alt ', lang, '"}, "", {"other": 1}]'))
    d = table(spark, sf_dir, "documents")
    manifest = d.select(
        key.alias("sample_id"), F.when(v % 2 == 0, spelt("q", key)).otherwise("").alias("question"), spelt("t", key).alias("text"), F.lit(None).cast("string").alias("transcript"),
        F.when((v % 4 == 0) | (v % 8 == 1), "").otherwise(spelt(lang, ", ", key)).alias("answer"), F.try_parse_json(raw).alias("raw_answers"),
    )
    item = lambda x: F.struct(x.alias("sample_id"), F.lit("").alias("document"))
    asr = d.where(v % 3 == 0).select(key.alias("sample_id"), F.array(item(key), item(F.lit("other"))).alias("top_k"))
    omni = d.where(v % 5 == 0).select(key.alias("sample_id"), F.array(item(key)).alias("top_k"))
    out = M.answer_inputs(manifest, asr, omni)
    return out.select("sample_id", F.array_join(F.get("required_terms", F.lit(0)), "|").alias("aliases"), "gold_answer", F.size("asr_top_k").alias("asr"), F.size("omni_top_k").alias("omni"), "target")


TASKS = ("Repeat-zh", "SRT-en", "MLCpro-en", "Summary", "GaokaoEval", "AlpacaEval", "GenStyle-zh", "Other")
TASK_SQL = """b AS (SELECT doc_id, lang AS grp, text, (['Repeat-zh', 'SRT-en', 'MLCpro-en', 'Summary', 'GaokaoEval', 'AlpacaEval', 'GenStyle-zh', 'Other'])[doc_id % 8 + 1] AS task,
   (['asr_semantics', 'speech_translation', 'tool_or_label_semantics', 'speech_summarization', 'speech_qa_reasoning', 'open_ended_agentic', 'paralinguistic_or_speaker', 'unknown'])[doc_id % 8 + 1] AS family FROM documents)"""


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of a benchmark's task files; some lack an id, a language, a target or a clip."""
    v, key = F.col("doc_id"), F.col("doc_id").cast("string")
    raw = F.to_json(
        F.struct(
            F.when(v % 3 > 0, spelt("a/", key)).alias("id"), F.col("text").alias("source_text"), F.when(v % 4 > 0, spelt("t", key)).alias("target_text"), spelt("r", key).alias("reference"),
            F.when(v % 5 == 0, "xx").alias("language"), F.when(v % 2 == 0, spelt("wav/", key, ".wav")).alias("source_wav"),
        )
    )
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("group"), one_of(TASKS, v).alias("dataset_config"), v.alias("dataset_index"), F.parse_json(raw).alias("raw"))
    return M.benchmark_rows(rows, "root")


@query(f"""WITH {TASK_SQL} SELECT 'uro_' || grp || '_' || task || '_' || CASE WHEN doc_id % 3 > 0 THEN 'a_' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS sample_id, family AS task, CASE WHEN doc_id % 5 = 0 THEN 'xx' WHEN doc_id % 8 IN (0, 4, 6) THEN 'zh' WHEN doc_id % 8 IN (1, 2, 5) THEN 'en' ELSE '' END AS language,
  CASE WHEN doc_id % 2 = 0 THEN 'root/' || grp || '/' || task || '/wav/' || doc_id || '.wav' ELSE '' END AS audio_path, text AS source_text, CASE WHEN doc_id % 4 > 0 THEN 't' ELSE 'r' END || doc_id AS target_text, family NOT IN ('open_ended_agentic', 'paralinguistic_or_speaker') AS semantic_mainline FROM b""")
def benchmark_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark(spark, sf_dir).select("sample_id", "task", "language", "audio_path", "source_text", "target_text", "semantic_mainline")


@query(f"""WITH {TASK_SQL} SELECT grp AS dataset_group, task AS dataset_config, family AS task, count(*) AS rows, family NOT IN ('open_ended_agentic', 'paralinguistic_or_speaker') AS semantic_mainline, count(*) FILTER (WHERE doc_id % 2 = 0) AS with_audio FROM b GROUP BY grp, task, family""")
def benchmark_task_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.benchmark_report(benchmark(spark, sf_dir))


def parallel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 23).alias("key"), "doc_id", "lang", F.col("text"), F.lit(None).cast("string").alias("transcript"))
    return M.parallel(d.where("lang = 'en'"), d.where("lang = 'de' AND key < 20"), "key", "doc_id", "en", "de", 100)


PARALLEL_SQL = """tg AS (SELECT doc_id % 23 AS key, arg_max(text, doc_id) AS target FROM documents WHERE lang = 'de' AND doc_id % 23 < 20 GROUP BY 1),
pr AS (SELECT doc_id, doc_id % 23 AS key, text, target, row_number() OVER (ORDER BY doc_id) - 1 AS nth FROM documents JOIN tg ON doc_id % 23 = tg.key WHERE lang = 'en')"""


@query(f"""WITH {PARALLEL_SQL} SELECT 'translation_en_de_' || lpad(CAST(nth AS VARCHAR), 6, '0') AS sample_id, key AS pair_key, doc_id AS dataset_index, text AS source_text, target AS target_text FROM pr WHERE nth < 100""")
def parallel_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents with the last German one of the same key; the limit counts matches."""
    return parallel(spark, sf_dir)[0].select("sample_id", "pair_key", "dataset_index", "source_text", "target_text")


@query(f"""WITH {PARALLEL_SQL} SELECT doc_id % 23 AS pair_key, doc_id AS dataset_index FROM documents WHERE lang = 'en' AND doc_id % 23 NOT IN (SELECT key FROM tg)""")
def parallel_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parallel(spark, sf_dir)[1]


@query("""SELECT 'pair_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS sample_id, doc_id AS dataset_index, trim(regexp_replace(text, '[\\s\\x85\\p{Z}]+', ' ', 'g')) AS source_text, 'to ' || source AS target_text FROM documents WHERE doc_id < 500""")
def translation_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 rows of the source: here the limit is on the source's own index."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sentence"), spelt(" to  ", F.col("source")).alias("translation"))
    return M.translations(d, "doc_id", "pair", "en", "xx", max_samples=500).select("sample_id", "dataset_index", "source_text", "target_text")


@query("""WITH t AS (SELECT doc_id, doc_id % 5 AS k, (['HSK5-zh', 'Own Task', ''])[doc_id % 3 + 1] AS config, (['Chinese language proficiency multiple-choice question', 'Own Task', 'speech QA/reasoning task'])[doc_id % 3 + 1] AS what FROM documents),
a AS (SELECT *, (['B. blue', 'C. green', 'A: other', 'plain words', 'D. black'])[k + 1] AS answer FROM t)
SELECT doc_id, answer AS target_option_expanded, 'Answer: ' || answer AS target_answer_card, 'Task: ' || config || chr(10) || 'Task type: ' || what || chr(10) || 'Answer: ' || answer AS target_task_card,
  'Task: ' || config || chr(10) || 'Task type: ' || what || chr(10) || 'Candidate answer: ' || answer || chr(10) || 'Use this candidate only when the spoken query asks for this exact answer, option, span, or reasoning result.' AS target_boundary_card,
  'Target language: ' || CASE WHEN doc_id % 3 = 0 THEN 'target' ELSE 'German' END || chr(10) || 'Translation candidate: ' || answer AS translation_card,
  'Task: speech translation candidate retrieval' || chr(10) || 'Target language: ' || CASE WHEN doc_id % 3 = 0 THEN 'target' ELSE 'German' END || chr(10) || 'Candidate translation: ' || answer || chr(10) || 'Use this candidate only when it preserves the spoken source meaning, including named entities, numbers, negation, and predicate-argument structure.' AS translation_boundary FROM a""")
def candidate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of answers: a bare letter, a letter with its own option, one with another text, words, a letter with a colon."""
    v = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", one_of(("HSK5-zh", "Own Task", ""), v).alias("config"), one_of(("B", "C. green", "A: other", "plain  words", "D:"), v).alias("target"), F.lit("Which one? A. red B. blue C. green D. black").alias("source"),
        F.when(v % 3 > 0, "German").alias("language"),
    )
    cards = M.answer_cards("config", "target", "source")
    more = M.translation_cards("language", cards["target_option_expanded"])
    return d.select("doc_id", *[c.alias(k) for k, c in cards.items()], more["target_translation_card"].alias("translation_card"), more["target_boundary_card"].alias("translation_boundary"))


@query("SELECT doc_id, (doc_id % 10) / 1e1 AS stress_text_error_rate, 'natural_asr_drift' AS stress_mode FROM documents WHERE doc_id % 10 >= 3")
def natural_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10 / 10).alias("rate"))
    return M.drifted(rows, "rate", 0.3).select("doc_id", "stress_text_error_rate", "stress_mode")
