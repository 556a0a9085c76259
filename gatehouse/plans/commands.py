"""Steps of a plan as command lines, and matrices of cases.  They are written down, never run."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import safe_name

# Each step's script and its flags with the fields that they take; a text in quotes is the value itself.
CACHE = "mainline/cache_audio_memory_embeddings.py"
ENCODERS = (("--audio-encode-method", "audio_encode_method"), ("--text-encode-method", "text_encode_method"))
INSTRUCTION = (("--audio-query-instruction", "audio_instruction"),)
SAMPLE = (("--max-samples", "max_samples"), ("--test-size", "test_size"), ("--seed", "seed"))
SCORED = (("--max-samples", "max_samples"), ("--score-count", "score_count"), ("--seed", "seed"))
COMMANDS = {
    "cache_text": (CACHE, (("--cache-kind", "'text'"), ("--manifest", "manifest"), ("--output", "output"), ("--text-model", "text_model"), ("--query-text-source", "query_text_source"), ("--memory-text-style", "memory_text_style"), *SAMPLE)),
    "cache_omni_audio": (CACHE, (("--cache-kind", "'omni'"), ("--manifest", "manifest"), ("--output", "output"), ("--omni-model", "omni_model"), *ENCODERS, *INSTRUCTION, *SAMPLE)),
    "evaluate_hybrid_from_cache": (
        "mainline/audio_memory_hybrid_from_cache.py",
        (("--manifest", "manifest"), ("--text-cache", "text_cache"), ("--omni-cache", "omni_cache"), ("--output", "output"), ("--memory-text-style", "memory_text_style"), ("--score-count", "score_count"), ("--test-size", "test_size"), ("--seed", "seed")),
    ),
    "evaluate_tool_omni_audio": (
        "mainline/audio_nlp_label_classification.py",
        (("--manifest", "manifest"), ("--output", "output"), ("--task", "task"), ("--routes", "'omni_audio'"), ("--omni-model", "omni_model"), ("--omni-query-cache", "omni_query_cache"), *ENCODERS, *INSTRUCTION,
         ("--label-description-style", "label_description_style"), ("--label-example-count", "label_example_count"), ("--label-boundary-count", "label_boundary_count"), *SCORED),
    ),
    "evaluate_asr_like_omni_selection": (
        "mainline/omni_embed_selection.py",
        (("--manifest", "manifest"), ("--output", "output"), ("--omni-model", "omni_model"), *ENCODERS, *INSTRUCTION, ("--candidate-count", "candidate_count"), ("--same-intent-negatives", "same_intent_negatives"), ("--same-domain-negatives", "same_domain_negatives"), *SCORED, ("--include-rows", "''")),
    ),
    "evaluate_translation_omni_selection": (
        "../../scripts/transcript_candidate_retrieval.py",
        (("--manifest", "manifest"), ("--output", "output"), ("--model", "omni_model"), ("--route", "'direct_omni'"), ("--instruction-arm", "instruction_arm"), *ENCODERS, ("--query-field", "'source_text'"), ("--candidate-field", "candidate_field"), ("--candidate-count", "candidate_count"), *SCORED),
    ),
}
ZERO_COUNTS = ("--max-samples", "--seed")
OWN_FOLDER = "evaluate_translation_omni_selection"
PATHS = ("manifest", "output", "omni_model")


def argument(flag: str, value: object) -> list[str]:
    """A flag and its value: none for null, blank, false and (but for two flags) zero; the flag alone for true."""
    if value is None or value == "" or value is False:
        return []
    if value is True:
        return [flag]
    if isinstance(value, (int, float)) and value == 0 and flag not in ZERO_COUNTS:
        return []
    return [flag, str(value)]


def argv(step: dict, python: str = "python") -> list[str]:
    """The command line of a step."""
    if step.get("step") not in COMMANDS:
        raise ValueError(f"unknown step: {step.get('step')}")
    script, flags = COMMANDS[step["step"]]
    out = [python, script]
    for flag, field in flags:
        if field.startswith("'"):
            value = field.strip("'") or True
        else:
            value = step.get(field)
            if step["step"] == OWN_FOLDER and field in PATHS and value and not posixpath.isabs(str(value)):
                value = posixpath.join("../..", str(value))  # this step runs two folders deeper
        out += argument(flag, value)
    return out


def commands(spark: SparkSession, steps: list[dict], python: str = "python") -> DataFrame:
    """(place, step, command): a plan's steps as lines of a script."""
    return spark.createDataFrame([(k, s["step"], " ".join(argv(s, python))) for k, s in enumerate(steps)], "place int, step string, command string")


def cases(spark: SparkSession, policies: list[str], modes: list[str], prefix: str) -> DataFrame:
    """(policy, prompt_mode, output, backend_log): every policy under every prompt, with the files it would write."""
    both = spark.createDataFrame([(p, m) for p in policies for m in modes], "policy string, prompt_mode string")
    stem = F.concat_ws("_", F.lit(prefix), safe_name("policy"), safe_name("prompt_mode"))
    return both.select("*", F.concat(stem, F.lit(".json")).alias("output"), F.concat(stem, F.lit(".backend.log")).alias("backend_log"))


def case_results(plan: DataFrame, results: DataFrame) -> DataFrame:
    """The plan's cases with the results (output, correct) that there are: n, accuracy and correct of each."""
    got = results.groupBy("output").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.count_if("correct").alias("correct"))
    return plan.join(got, "output", "left")


def script(plan: DataFrame, line: Callable[[DataFrame], F.Column]) -> DataFrame:
    """(place, line): a shell script of a small plan, one line a case."""
    head = plan.sparkSession.createDataFrame([(0, "#!/usr/bin/env bash"), (1, "set -euo pipefail")], "place long, line string")
    rows = plan.withColumn("line", line(plan)).agg(F.array_sort(F.collect_list("line")).alias("l")).select(F.posexplode("l").alias("k", "line"))
    return head.unionByName(rows.select((F.col("k") + 2).cast("long").alias("place"), "line"))
