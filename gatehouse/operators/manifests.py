"""Manifests from foreign tables: speech QA, benchmark folders, parallel text, and the inputs of an answer evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import option_map
from ..functions.text import col, collapse_ws, first_non_blank, non_blank, normalize_question
from ..sources.readers import last_wins
from . import order

# The benchmark's tasks by family, those of Chinese and English names without a suffix, and descriptions.
SEMANTIC_TASKS = (
    "APE-zh", "CodeSwitching-en", "CodeSwitching-zh", "GaokaoEval", "Gsm8kEval", "HSK5-zh", "LCSTS-zh", "MLC", "MLC-zh", "MLCpro-en", "MLCpro-zh",
    "MuChoEval-en", "OpenbookQA-zh", "Repeat", "Repeat-zh", "SQuAD-zh", "SRT-en", "SRT-zh", "StoralEval", "Summary", "TruthfulEval",
)
OPEN_ENDED_TASKS = ("AlpacaEval", "AlpacaEval-zh", "Claude-zh", "CommonEval", "MtBenchEval-en", "Multilingual", "Safety-en", "Safety-zh", "WildchatEval", "Wildchat-zh")
PARALINGUISTIC_TASKS = ("ClothoEval-en", "GenEmotion-en", "GenEmotion-zh", "GenStyle-en", "GenStyle-zh", "SpeakerAware-en", "SpeakerAware-zh", "UnderEmotion-en", "UnderEmotion-zh")
TRANSLATION_TASKS = ("CodeSwitching-en", "CodeSwitching-zh", "SRT-en", "SRT-zh", "APE-zh")
SUMMARY_TASKS = ("LCSTS-zh", "Summary")
CHINESE_TASKS = ("GaokaoEval", "HSK5-zh", "LCSTS-zh")
ENGLISH_TASKS = ("AlpacaEval", "CommonEval", "Gsm8kEval")
TASK_DESCRIPTIONS = {
    "GaokaoEval": "English listening-comprehension multiple-choice exam",
    "Gsm8kEval": "grade-school math reasoning question",
    "HSK5-zh": "Chinese language proficiency multiple-choice question",
    "MuChoEval-en": "music audio understanding multiple-choice question",
    "OpenbookQA-zh": "open-book science multiple-choice question",
    "SQuAD-zh": "Chinese reading-comprehension span question",
    "StoralEval": "story or fable moral understanding question",
    "TruthfulEval": "truthfulness-oriented question answering",
}
SIDE_FAMILIES = ("paralinguistic_or_speaker", "open_ended_agentic")


def answer_text(value: Column) -> Column:
    """The first answer of a variant that is a text, a list of texts or of objects with a text, or an object with such."""
    get = lambda path: F.try_variant_get(value, path, "string")
    kind = F.schema_of_variant(value)
    inside = F.schema_of_variant(F.try_variant_get(value, "$.text", "variant"))
    listed = F.schema_of_variant(F.try_variant_get(value, "$[0]", "variant"))
    found = (
        F.when(kind == "STRING", get("$"))
        .when(F.startswith(kind, F.lit("ARRAY")) & F.startswith(listed, F.lit("OBJECT")), get("$[0].text"))
        .when(F.startswith(kind, F.lit("ARRAY")) & (listed == "STRING"), get("$[0]"))
        .when(F.startswith(kind, F.lit("OBJECT")) & F.startswith(inside, F.lit("ARRAY")), get("$.text[0]"))
        .when(F.startswith(kind, F.lit("OBJECT")) & (inside == "STRING"), get("$.text"))
    )
    return F.coalesce(F.trim(found), F.lit(""))


def answer_aliases(answer: Column | str, raw: Column) -> Column:
    """The answer and the raw answers (a variant: a list of texts or of objects with a text), normalised, each once, in order."""
    items = F.coalesce(F.try_variant_get(raw, "$", "array<variant>"), F.array().cast("array<variant>"))
    spelt = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.when(~F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.try_variant_get(x, "$", "string")))
    all_of = F.concat(F.array(normalize_question(answer)), F.transform(items, lambda x: normalize_question(spelt(x))))
    kept = F.array_distinct(F.filter(all_of, lambda x: x != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("")))


def speech_qa(df: DataFrame, index: str, prefix: str, *, question: str = "question", transcription: str = "transcription", context: str = "context", answer: str = "answer", impossible: str | None = None, skip_impossible: bool = False, require_answer: bool = False, max_samples: int = 0) -> DataFrame:
    """Questions with their answers.  Filters come first, then the limit, then dense ids: a limited manifest is not short
    of rows that were left out.  ``answer`` is a variant, ``index`` the row's number in its source."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    never = F.coalesce(F.col(impossible), F.lit(False)) if impossible else F.lit(False)
    rows = df.select(
        F.col(index).cast("long").alias("dataset_index"), text(question).alias("question"), F.coalesce(non_blank(text(transcription)), text(question)).alias("transcript"), text(context).alias("context"),
        answer_text(F.col(answer)).alias("answer"), F.to_json(F.col(answer)).alias("raw_answers"), never.alias("is_impossible"),
    )
    if skip_impossible:
        rows = rows.where(~F.col("is_impossible"))
    if require_answer:
        rows = rows.where("answer != ''")
    rows = order.dense(rows, "dataset_index")
    if max_samples:
        rows = rows.where(F.col("nth") < max_samples)
    made = F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("nth").cast("string"), 6, "0"))
    return rows.select(made.alias("sample_id"), F.lit("speech_qa").alias("task"), "question", F.col("question").alias("text"), "transcript", "context", "answer", "raw_answers", "is_impossible", "dataset_index")


def translations(df: DataFrame, index: str, prefix: str, source_language: str, target_language: str, sentence: str = "sentence", translation: str = "translation", max_samples: int = 0) -> DataFrame:
    """Pairs of a sentence and its translation; the limit counts rows of the source."""
    rows = df.where(F.col(index) < max_samples) if max_samples else df
    said, told = collapse_ws(sentence), collapse_ws(translation)
    made = F.concat(F.lit(f"{prefix}_"), F.lpad(F.col(index).cast("string"), 6, "0"))
    return rows.select(
        made.alias("sample_id"), F.lit("speech_translation").alias("task"), F.lit(source_language).alias("language"), F.lit(target_language).alias("target_language"),
        said.alias("text"), said.alias("transcript"), said.alias("source_text"), told.alias("target_text"), told.alias("translation"), F.col(index).cast("long").alias("dataset_index"),
    )


def task_family(name: Column | str) -> Column:
    n = col(name)
    semantic = (
        F.when(F.contains(n, F.lit("Repeat")), "asr_semantics").when(n.isin(*TRANSLATION_TASKS), "speech_translation").when(F.contains(n, F.lit("MLC")), "tool_or_label_semantics")
        .when(n.isin(*SUMMARY_TASKS), "speech_summarization").otherwise("speech_qa_reasoning")
    )
    return F.when(n.isin(*SEMANTIC_TASKS), semantic).when(n.isin(*OPEN_ENDED_TASKS), "open_ended_agentic").when(n.isin(*PARALINGUISTIC_TASKS), "paralinguistic_or_speaker").otherwise("unknown")


def language_hint(name: Column | str, language: Column | str) -> Column:
    """The row's own language, else that of the task's name."""
    n = col(name)
    zh, en = F.endswith(n, F.lit("-zh")) | n.isin(*CHINESE_TASKS), F.endswith(n, F.lit("-en")) | n.isin(*ENGLISH_TASKS)
    return F.coalesce(non_blank(language), F.when(zh, "zh").when(en, "en").otherwise(""))


def benchmark_rows(df: DataFrame, root: str = "") -> DataFrame:
    """Rows (group, dataset_config, dataset_index, raw) of a benchmark's tasks, ``raw`` a variant, as a manifest."""
    get = lambda p: F.try_variant_get("raw", f"$.{p}", "string")
    family = task_family("dataset_config")
    original = F.coalesce(get("id"), F.col("dataset_index").cast("string"))
    source, target = F.coalesce(get("source_text"), F.lit("")), first_non_blank(get("target_text"), get("reference"))
    wav = F.when(non_blank(get("source_wav")).isNotNull(), F.concat_ws("/", *([F.lit(root)] if root else []), "group", "dataset_config", get("source_wav"))).otherwise("")
    sample = F.translate(F.concat_ws("_", F.lit("uro"), "group", "dataset_config", original), "/", "_")
    return df.select(
        sample.alias("sample_id"), family.alias("task"), F.lit("test").alias("split"), language_hint("dataset_config", get("language")).alias("language"), wav.alias("audio_path"),
        source.alias("text"), source.alias("transcript"), source.alias("source_text"), target.alias("target_text"), target.alias("answer"), "dataset_config",
        F.col("group").alias("dataset_group"), F.col("dataset_index").cast("long").alias("dataset_index"), original.alias("original_id"), (~family.isin(*SIDE_FAMILIES)).alias("semantic_mainline"),
    )


def read_benchmark(spark: SparkSession, root: str) -> DataFrame:
    """(group, dataset_config, dataset_index, raw) of all ``<root>/<group>/<task>/test.jsonl``; lines are numbered within
    their file, blank ones counted and left out."""
    lines = spark.read.text(f"{root}/*/*/test.jsonl", wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.posexplode(F.split("value", "\n")).alias("dataset_index", "line"))
    parts = F.split("p", "/")
    return lines.where(F.trim("line") != "").select(F.element_at(parts, -3).alias("group"), F.element_at(parts, -2).alias("dataset_config"), "dataset_index", F.parse_json("line").alias("raw"))


def benchmark_report(rows: DataFrame) -> DataFrame:
    """(dataset_group, dataset_config, task, rows, semantic_mainline, with_audio) of each task of a manifest."""
    return rows.groupBy("dataset_group", "dataset_config", "task").agg(F.count(F.lit(1)).alias("rows"), F.max("semantic_mainline").alias("semantic_mainline"), F.count_if(F.col("audio_path") != "").alias("with_audio"))


def parallel(source: DataFrame, target: DataFrame, key: str, index: str, source_language: str, target_language: str, max_samples: int = 0) -> tuple[DataFrame, DataFrame]:
    """(manifest, missing keys): source rows with the target row of their key, the last in the order of ``index`` if there
    are several.  The limit counts matches, and ids number them."""
    told = last_wins(target.select(key, index, first_non_blank("text", "transcript").alias("target_text")), key, [index]).select(F.col(key).alias("pair_key"), "target_text")
    said = source.select(F.col(key).alias("pair_key"), F.col(index).cast("long").alias("dataset_index"), first_non_blank("text", "transcript").alias("source_text"))
    met = order.dense(said.join(told, "pair_key"), "dataset_index")
    if max_samples:
        met = met.where(F.col("nth") < max_samples)
    made = F.concat(F.lit(f"translation_{source_language}_{target_language}_"), F.lpad(F.col("nth").cast("string"), 6, "0"))
    out = met.select(made.alias("sample_id"), F.lit("speech_translation").alias("task"), F.lit(source_language).alias("language"), F.lit(target_language).alias("target_language"), F.col("source_text").alias("text"), "source_text", "target_text", "dataset_index", "pair_key")
    return out, said.join(told, "pair_key", "left_anti").select("pair_key", "dataset_index")


def answer_inputs(manifest: DataFrame, asr: DataFrame, omni: DataFrame) -> DataFrame:
    """Each manifest row with its retrieved lists and its answer key; ``asr`` and ``omni`` have (sample_id, top_k), and a row
    without a list has an empty one.  ``raw_answers`` is a variant."""
    lists = manifest.join(asr.withColumnRenamed("top_k", "asr_top_k"), "sample_id", "left").join(omni.withColumnRenamed("top_k", "omni_top_k"), "sample_id", "left")
    kind = asr.schema["top_k"].dataType
    empty = F.array().cast(kind)
    aliases = answer_aliases("answer", F.col("raw_answers"))
    gold = F.coalesce(F.col("answer"), F.get(aliases, F.lit(0)))
    question = first_non_blank("question", "text")
    return lists.select(
        "sample_id", question.alias("query_text"), F.coalesce("transcript", F.lit("")).alias("asr_text"), question.alias("target"), F.coalesce("asr_top_k", empty).alias("asr_top_k"), F.coalesce("omni_top_k", empty).alias("omni_top_k"),
        gold.alias("gold_answer"), gold.alias("key_decision"), F.array(aliases).alias("required_terms"), F.array().cast("array<string>").alias("forbidden_terms"),
    )


def expanded_answer(target: Column | str, source: Column | str) -> Column:
    """An answer that is an option's letter, with the option's text from the question."""
    said, options = collapse_ws(target), option_map(collapse_ws(source))
    letter = F.regexp_extract(said, r"^([A-D])(?:[.．。;；:：]\s*)?(.*)$", 1)
    rest = collapse_ws(F.regexp_extract(said, r"^([A-D])(?:[.．。;；:：]\s*)?(.*)$", 2))
    option = F.coalesce(F.try_element_at(options, letter), F.lit(""))
    return F.when((letter != "") & (option != "") & ((rest == "") | (rest == option)), F.concat(letter, F.lit(". "), option)).otherwise(said)


def answer_cards(config: Column | str, target: Column | str, source: Column | str) -> dict[str, Column]:
    """The cards of an answer candidate; the sentences are fixed values."""
    table = F.create_map(*[F.lit(x) for kv in TASK_DESCRIPTIONS.items() for x in kv])
    name = collapse_ws(config)
    what = F.coalesce(F.try_element_at(table, name), non_blank(name), F.lit("speech QA/reasoning task"))
    answer = expanded_answer(target, source)
    boundary = "Use this candidate only when the spoken query asks for this exact answer, option, span, or reasoning result."
    return {
        "target_option_expanded": answer,
        "target_answer_card": F.concat(F.lit("Answer: "), answer),
        "target_task_card": F.concat(F.lit("Task: "), name, F.lit("\nTask type: "), what, F.lit("\nAnswer: "), answer),
        "target_boundary_card": F.concat(F.lit("Task: "), name, F.lit("\nTask type: "), what, F.lit("\nCandidate answer: "), answer, F.lit(f"\n{boundary}")),
    }


def translation_cards(language: Column | str, target: Column) -> dict[str, Column]:
    """The cards of a translation candidate; the sentences are fixed values."""
    lang = F.coalesce(non_blank(collapse_ws(language)), F.lit("target"))
    text = collapse_ws(target)
    boundary = "Use this candidate only when it preserves the spoken source meaning, including named entities, numbers, negation, and predicate-argument structure."
    return {
        "target_translation_card": F.concat(F.lit("Target language: "), lang, F.lit("\nTranslation candidate: "), text),
        "target_boundary_card": F.concat(F.lit("Task: speech translation candidate retrieval\nTarget language: "), lang, F.lit("\nCandidate translation: "), text, F.lit(f"\n{boundary}")),
    }


def drifted(df: DataFrame, rate: str, threshold: float) -> DataFrame:
    """Rows whose transcript drifted from the query by ``threshold`` or more token edits a token."""
    return df.where(F.col(rate) >= threshold).withColumns({"stress_mode": F.lit("natural_asr_drift"), "stress_text_error_rate": F.col(rate)})


def full_pool(train: DataFrame, test: DataFrame, path: str) -> DataFrame:
    """Both parts of a data set as one; a path in both fails the job."""
    shared = train.select(path).intersect(test.select(path)).count()
    if shared:
        raise ValueError(f"the two parts share {shared} paths")
    return train.unionByName(test)
