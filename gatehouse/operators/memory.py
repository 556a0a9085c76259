"""Choosing among candidate memories: building them, prompting, local choices, and how a run did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records
from ..functions.ranking import portable_hash
from ..functions.text import col, first_non_blank, label_family, label_words, non_blank, word_count
from . import metrics

#: The letters of options, the optional fields of a memory, and what each policy and protocol says.
LABELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OPTIONAL = ("domain", "intent", "task", "language", "target_language", "context", "answer")
POLICIES = {
    "text_summary_only": "Use only the text summaries of candidate memories. Select the memory that best answers or matches the spoken query.",
    "translation_target_text": "The query is speech in a source language. Use only the candidate text memories as possible target-language translations. Select the candidate whose translation best matches the spoken query meaning.",
    "audio_clip_only": "Use the query audio and the candidate memory audio clips. Select the memory whose spoken content best matches the query.",
    "dual_summary_plus_audio": "Use both candidate text summaries and candidate audio clips. Prefer the memory whose text and audio jointly support the best answer.",
    "conflict_aware_asr_audio": "The text may contain speech recognition or summary errors. Compare text evidence against audio evidence and prefer the memory supported by the audio semantics when they conflict.",
    "task_card_plus_audio": "Use the task card, candidate text summaries, and available audio to choose the executable or answer-supporting memory. Reject nearby candidates with different intent or decision boundaries.",
    "two_stage_audio_verify_then_answer": "First infer the meaning of the query and relevant candidate memory audio. Then select the candidate memory that best supports the final decision.",
}
COMPACT_POLICIES = {
    "text_summary_only": "Listen to the query audio and choose the candidate memory whose text summary best matches it.",
    "translation_target_text": "Listen to the source-language query audio and choose the candidate English translation that best matches it.",
    "audio_clip_only": "Listen to the query audio and choose the candidate memory audio clip that best matches it.",
    "dual_summary_plus_audio": "Listen to the query audio and choose the candidate memory whose text and audio best match it.",
    "conflict_aware_asr_audio": "If text and audio conflict, prefer the candidate supported by audio semantics.",
    "task_card_plus_audio": "Choose the candidate memory that matches the requested task, intent, or decision boundary.",
    "two_stage_audio_verify_then_answer": "First compare the audio meanings, then choose the best supporting memory.",
}
AUDIO_POLICIES = ("audio_clip_only", "dual_summary_plus_audio", "conflict_aware_asr_audio", "task_card_plus_audio", "two_stage_audio_verify_then_answer")
PROTOCOLS = {
    "letter": "Reply with exactly one capital option letter and nothing else.",
    "json": 'Reply with exactly this JSON shape: {"answer":"A"}.',
    "anti_answer": "This is a multiple-choice memory-use benchmark. Do not answer the spoken question directly. Do not translate or explain. Select the candidate memory option that best supports the task. Reply with only one capital letter.",
}
FULL_RULES = ("This is a fixed-candidate memory-use evaluation.", "Do not answer the user directly unless the candidate itself is the answer.")
SUMMARY_MODES = ("raw", "tool_card", "boundary_card")


def letter(i: Column) -> Column:
    return F.substring(F.lit(LABELS), (i + 1).cast("int"), F.lit(1))


def memory(columns: list[str], memory_id: str, summary: str, label: str, audio: str, source_dataset: str, is_gold: Column) -> Column:
    """A manifest row as a memory; id, summary and label must not be blank, optional fields are null where they are."""
    dataset = first_non_blank(*[c for c in ("dataset", "source") if c in columns], F.lit(source_dataset))
    more = [non_blank(F.col(c).cast("string")).alias(c) for c in OPTIONAL if c in columns]
    own = records.required(memory_id, memory_id, F.lit("<unknown>"))
    clip = F.coalesce(F.col(audio), F.lit("")) if audio in columns else F.lit("")
    return F.struct(own.alias("memory_id"), records.required(summary, summary, memory_id).alias("summary"), clip.alias("audio_path"), records.required(label, label, memory_id).alias("label"), dataset.alias("source_dataset"), is_gold.alias("is_gold"), *more)


def label_summary(label: Column | str, mode: str) -> Column:
    """A tool label as a memory's text; the sentences are fixed values."""
    if mode not in SUMMARY_MODES:
        raise ValueError(f"unknown summary mode: {mode}")
    if mode == "raw":
        return col(label)
    words = label_words(label)
    head = F.concat(F.lit("Tool intent: "), col(label), F.lit(". Intent family: "), label_family(label), F.lit(". "))
    if mode == "tool_card":
        return F.concat(head, F.lit("User goal: "), words, F.lit("."))
    return F.concat(head, F.lit("Select this only when the spoken command asks for "), words, F.lit("; do not select nearby tools from another intent family."))


def from_retrieval(retrieved: DataFrame, source: DataFrame, top_k: int, include_audio: bool = False) -> DataFrame:
    """(sample_id, candidate_memories, gold_memory_id, retrieval_hit_at_k, gold_answer): the first ``top_k`` retrieved rows of
    each query, looked up in the source manifest and nested again in their order; gold is the query's own row.

    ``retrieved`` has (sample_id, scores: rank, sample_id, text, score), ``source`` sample_id and manifest fields."""
    have = source.columns
    some = lambda *names: [c for c in names if c in have]
    look = source.select(
        F.col("sample_id").alias("memory_id"), first_non_blank(*some("context", "target_text")).alias("_summary"), first_non_blank(*some("answer", "target_text", "label", "intent")).alias("_label"),
        first_non_blank(*some("dataset", "source")).alias("_dataset"), *[F.col(c).alias(f"_{c}") for c in some("audio_path")], *[F.col(c).alias(f"_o_{c}") for c in some(*OPTIONAL)],
    )
    long = retrieved.select(F.col("sample_id").alias("query_id"), F.posexplode(F.slice("scores", 1, top_k)).alias("at", "x")).select("query_id", "at", F.col("x.sample_id").alias("memory_id"), "x.text", "x.rank", "x.score")
    found = long.join(look, "memory_id", "left")
    summary = first_non_blank("text", "_summary")
    clip = F.coalesce("_audio_path", F.lit("")) if include_audio and "_audio_path" in look.columns else F.lit("")
    one = F.struct(
        "memory_id", summary.alias("summary"), clip.alias("audio_path"), first_non_blank("_label", summary).alias("label"), F.coalesce("_dataset", F.lit("")).alias("source_dataset"),
        (F.col("memory_id") == F.col("query_id")).alias("is_gold"), F.col("rank").alias("retrieval_rank"), F.col("score").alias("retrieval_score"), *[non_blank(F.col(f"_o_{c}").cast("string")).alias(c) for c in some(*OPTIONAL)],
    )
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", one.alias("m")))).alias("l"))
    lists = lists.select(F.col("query_id").alias("sample_id"), F.transform("l", lambda x: x["m"]).alias("candidate_memories"))
    answer = source.select("sample_id", first_non_blank(*some("answer", "target_text", "label")).alias("gold_answer"))
    out = retrieved.select("sample_id").join(lists, "sample_id", "left").join(answer, "sample_id", "left")
    memories = F.coalesce("candidate_memories", F.array().cast(lists.schema["candidate_memories"].dataType))
    return out.select("sample_id", memories.alias("candidate_memories"), F.col("sample_id").alias("gold_memory_id"), F.exists(memories, lambda x: x["is_gold"]).alias("retrieval_hit_at_k"), F.coalesce("gold_answer", F.lit("")).alias("gold_answer"))


def from_labels(retrieved: DataFrame, top_k: int, mode: str) -> DataFrame:
    """The same where the candidates are labels: (sample_id, target, top_labels: rank, label, score); blank labels go."""
    shown = F.filter(F.slice("top_labels", 1, top_k), lambda x: non_blank(x["label"]).isNotNull())
    one = lambda x: F.struct(x["label"].alias("memory_id"), label_summary(x["label"], mode).alias("summary"), F.lit("").alias("audio_path"), x["label"].alias("label"), (x["label"] == F.col("target")).alias("is_gold"), x["rank"].alias("retrieval_rank"), x["score"].alias("retrieval_score"))
    memories = F.transform(shown, one)
    rows = retrieved.select("sample_id", memories.alias("candidate_memories"), F.col("target").alias("gold_memory_id"))
    return rows.select("*", F.exists("candidate_memories", lambda x: x["is_gold"]).alias("retrieval_hit_at_k"), F.col("gold_memory_id").alias("gold_answer"))


def retrieval_report(rows: DataFrame) -> DataFrame:
    """(row_count, retrieval_hit_at_k, mean_candidates) of a memory manifest."""
    return rows.agg(F.count(F.lit(1)).alias("row_count"), metrics.rate(F.col("retrieval_hit_at_k")).alias("retrieval_hit_at_k"), metrics.mean(F.size("candidate_memories").cast("double")).alias("mean_candidates"))


def shuffled(items: Column, seed: int | str, row_id: Column, name: Column | None = None) -> Column:
    """An array in the order of a hash of (seed:row, item's name)."""
    key = lambda x: portable_hash(F.concat(F.lit(f"{seed}:"), row_id.cast("string")), x if name is None else x[name])
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(key(x).alias("h"), x.alias("x")))), lambda p: p["x"])


def lettered_options(gold: Column | str, universe: Column, count: int, seed: int | str, row_id: Column | str) -> tuple[Column, Column]:
    """(options, gold's letter): gold and ``count`` - 1 others of a list of distinct labels, shuffled and lettered.  The
    list is the universe of labels, at most some thousands."""
    others = shuffled(F.filter(universe, lambda x: x != col(gold)), f"{seed}:others", col(row_id))
    mixed = shuffled(F.concat(F.array(col(gold)), F.slice(others, 1, max(0, count - 1))), f"{seed}:order", col(row_id))
    place = F.array_position(mixed, col(gold)) - 1
    return F.transform(mixed, lambda x, i: F.concat(letter(i), F.lit(". "), x)), letter(place)


def candidate_lines(memories: Column | str, policy: str, compact: bool) -> Column:
    """The candidates as lines with letters."""
    blank = lambda c: F.coalesce(c, F.lit(""))

    def line(x: Column, i: Column) -> Column:
        summary, label = blank(x["summary"]), blank(x["label"])
        if compact:
            first, second = (label, summary) if policy == "audio_clip_only" else (summary, label)
            return F.concat(letter(i), F.lit(". "), F.coalesce(non_blank(first), non_blank(second), F.concat(F.lit("candidate memory "), letter(i))))
        parts = [F.concat(letter(i), F.lit(". Memory id: "), x["memory_id"])]
        if policy != "audio_clip_only":
            parts.append(F.when(summary != "", F.concat(F.lit("Summary: "), summary)))
        parts.append(F.when((label != "") & (label != summary), F.concat(F.lit("Label: "), label)))
        if policy in AUDIO_POLICIES:
            parts.append(F.when(blank(x["audio_path"]) != "", F.concat(F.lit("Audio clip reference: "), x["audio_path"])))
        return F.array_join(F.array_compact(F.array(*parts)), ". ")

    return F.transform(col(memories), line)


def prompt(policy: str, protocol: str, memories: Column | str, hint: Column | str, family: Column | str, compact: bool = False, flat: bool = False, show_hint: bool = False, audio_limit: int = -1) -> Column:
    """What a model is asked under a policy: full or compact, in lines or flattened into one."""
    lines = candidate_lines(memories, policy, compact)
    said = F.coalesce(col(hint), F.lit(""))
    text = lambda x: F.array(x if isinstance(x, Column) else F.lit(x))
    if compact:
        parts = [text(COMPACT_POLICIES[policy]), text(PROTOCOLS[protocol])]
        if show_hint:
            parts.append(text(F.concat(F.lit("Query text/ASR hint: "), said)))
        if policy in AUDIO_POLICIES:
            heard = F.filter(F.transform(col(memories), lambda x, i: F.when(non_blank(x["audio_path"]).isNotNull(), letter(i))), lambda x: x.isNotNull())
            heard = heard if audio_limit < 0 else F.slice(heard, 1, audio_limit)
            names = F.coalesce(non_blank(F.array_join(heard, ", ")), F.lit("none"))
            parts.append(text(F.concat(F.lit("Audio attachments are ordered as: query audio first, then candidate memory audio clips "), names, F.lit("."))))
        parts += [text(""), lines]
    else:
        parts = [text(POLICIES[policy]), *[text(x) for x in FULL_RULES], text(PROTOCOLS[protocol]), text(""), text(F.concat(F.lit("Task family: "), F.coalesce(col(family), F.lit("")))), text(F.concat(F.lit("Spoken query text or ASR hint: "), said)), text(""), text("Candidate memories:"), lines]
    whole = F.concat(*parts)
    if not flat:
        return F.array_join(whole, "\n")
    return F.array_join(F.filter(F.transform(F.split(F.array_join(whole, "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")


def local_choice(mode: str, memories: Column | str, gold: Column | str, seed: int | str = 0, row_id: Column | str = "sample_id") -> Column:
    """The memory that a local backend picks: ``oracle``, ``first`` or ``random`` (by a hash)."""
    ids = F.transform(col(memories), lambda x: x["memory_id"])
    if mode == "oracle":
        return col(gold)
    at = {"first": F.lit(0), "random": F.pmod(portable_hash(seed, col(row_id)), F.greatest(F.size(ids), F.lit(1))).cast("int")}.get(mode)
    if at is None:
        raise ValueError(f"unknown local mode: {mode}")
    return F.coalesce(F.get(ids, at), F.lit(""))


def use_rows(df: DataFrame, baseline: DataFrame | None, policy: str, prediction: Column, text: Column, query_audio: str = "query_audio_path", audio_limit: int = -1, use_query: bool = True) -> DataFrame:
    """How a choice among memories did.  ``df`` has sample_id, candidate_memories, gold_memory_id and the query's audio;
    ``baseline`` (sample_id, task_success) tells regressions, without it there are none."""
    rows = df.withColumn("prediction", prediction)
    p, gold = F.col("prediction"), F.col("gold_memory_id")
    chosen = records.memory_of("candidate_memories", "prediction")
    cost = records.audio_seconds(query_audio, "candidate_memories", policy in AUDIO_POLICIES, audio_limit, use_query)
    out = rows.select(
        "sample_id", F.lit(policy).alias("policy_id"), "prediction", "gold_memory_id", (p == gold).alias("task_success"), F.coalesce(chosen["is_gold"], F.lit(False)).alias("grounded_memory_use"),
        ((p != "") & (p != gold)).alias("wrong_memory"), (p == "").alias("invalid_output"), word_count(text).alias("text_cost"), cost.alias("audio_cost"),
    )
    if baseline is None:
        return out.withColumn("regression_vs_text_only", F.lit(False))
    base = baseline.select("sample_id", F.col("task_success").alias("_base"))
    return out.join(base, "sample_id", "left").withColumn("regression_vs_text_only", F.coalesce("_base", F.lit(False)) & ~F.col("task_success")).drop("_base")


def use_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates and mean costs of ``use_rows``."""
    rates = ("task_success", "grounded_memory_use", "wrong_memory", "invalid_output", "regression_vs_text_only")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[metrics.rate(F.col(c)).alias(c) for c in rates], metrics.mean(F.col("text_cost")).alias("mean_text_cost"), metrics.mean(F.col("audio_cost")).alias("mean_audio_cost"), F.count_if("regression_vs_text_only").alias("regression_count"))


def run_summary(rows: DataFrame, by: list[str], success: str) -> DataFrame:
    """A run among others: (n, success by the named field, task_success, invalid_output, wrong_memory, http_error_count,
    regression_count, mean_latency_ms, mean_text_cost, mean_audio_cost); fields that are missing count as false or zero."""
    have = rows.columns
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    cost = lambda c: metrics.mean(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0))
    http = F.col("parse_method") == "http_error" if "parse_method" in have else F.lit(False)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), metrics.rate(flag(success)).alias("success"), metrics.rate(flag("task_success")).alias("task_success"), metrics.rate(flag("invalid_output")).alias("invalid_output"), metrics.rate(flag("wrong_memory")).alias("wrong_memory"),
        F.count_if(http).alias("http_error_count"), F.count_if(flag("regression_vs_text_only")).alias("regression_count"), cost("latency_ms").alias("mean_latency_ms"), cost("text_cost").alias("mean_text_cost"), cost("audio_cost").alias("mean_audio_cost"),
    )


def overflowed(output: Column | str) -> Column:
    """Whether a model's output says that the context was too long."""
    text = F.coalesce(col(output), F.lit(""))
    return F.contains(text, F.lit("exceeds the available context size")) | F.contains(text, F.lit("exceed_context_size"))


def chat_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """(n, valid_rate, parse_rate, accuracy, mean_latency_ms) of chat runs (returncode, error, prediction_letter, correct,
    latency_ms)."""
    valid = (F.col("returncode") == 0) & non_blank("error").isNull()
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), metrics.rate(valid).alias("valid_rate"), metrics.rate(non_blank("prediction_letter").isNotNull()).alias("parse_rate"), metrics.rate(F.col("correct")).alias("accuracy"), metrics.mean(F.col("latency_ms").cast("double")).alias("mean_latency_ms"))
