"""Plans: arms with their steps as nested rows, flattened, checked and counted as tables.  Nothing is run here."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .instructions import task_arms

#: The steps of each task: (step, kind of its output, columns that name its inputs).
STEPS = {
    "rag": (("cache_text", "qwen3_text.pt"), ("cache_omni_audio", "omni.pt"), ("evaluate_hybrid_from_cache", "json")),
    "tool": (("evaluate_tool_omni_audio", "json"),),
    "asr_like": (("evaluate_asr_like_omni_selection", "json"),),
    "translation": (("evaluate_translation_omni_selection", "json"),),
}
SCHEMA = "arm string, audio_instruction string, result_path string, steps array<struct<step:string,manifest:string,output:string,inputs:array<string>>>"


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.strip().lower()).strip("_") or "empty"


def build_plan(spark: SparkSession, task: str, manifest: str, dataset: str = "", arms: tuple[str, ...] = (), folder: str = "outputs") -> DataFrame:
    """One row for each arm, with its steps in order."""
    if task not in STEPS:
        raise ValueError(f"unknown task: {task}")
    name, rows = slug(dataset or task), []
    for arm, said in task_arms(task, arms):
        result = f"{folder}/agentic_cache_taxonomy_{task}_{name}_{slug(arm)}.json"
        text, omni = f"{folder}/cache_agentic_taxonomy_{task}_{name}_qwen3_text.pt", f"{folder}/cache_agentic_taxonomy_{task}_{name}_{slug(arm)}_omni.pt"
        outputs = {"qwen3_text.pt": text, "omni.pt": omni, "json": result}
        steps = [(step, manifest, outputs[kind], [text, omni] if step == "evaluate_hybrid_from_cache" else []) for step, kind in STEPS[task]]
        rows.append((arm, said or "none", result, steps))
    return spark.createDataFrame(rows, SCHEMA)


def flatten(plan: DataFrame) -> DataFrame:
    """(step_index, arm, step, manifest, output, inputs): steps numbered from 1 within their arm."""
    flat = plan.select("arm", F.posexplode("steps").alias("i", "s"))
    return flat.select("arm", (F.col("i") + 1).alias("step_index"), "s.*")


def statuses(flat: DataFrame, existing: DataFrame, execute: bool = False) -> DataFrame:
    """Adds warnings and status (``skipped_existing``, ``blocked``, ``planned``); ``existing`` has the paths there are."""
    have = existing.select(F.col("path").alias("_p")).distinct()
    known = lambda df, c: df.join(have, F.col(c) == F.col("_p"), "left").withColumn(f"has_{c}", F.col("_p").isNotNull()).drop("_p")
    out = known(known(flat, "manifest"), "output")
    inputs = flat.select("arm", "step_index", F.explode("inputs").alias("input")).join(have, F.col("input") == F.col("_p"), "left_anti").groupBy("arm", "step_index").agg(F.array_sort(F.collect_list("input")).alias("lacking"))
    out = out.join(inputs, ["arm", "step_index"], "left")
    warn: Column = F.concat(F.when(~F.col("has_manifest"), F.array(F.concat(F.lit("manifest not found: "), "manifest"))).otherwise(F.array().cast("array<string>")), F.transform(F.coalesce("lacking", F.array().cast("array<string>")), lambda x: F.concat(F.lit("not found before eval: "), x)))
    status = F.when(F.col("has_output"), "skipped_existing").when(F.lit(execute) & (F.size(warn) > 0), "blocked").otherwise("planned")
    return out.select("arm", "step_index", "step", "output", F.array_join(warn, "; ").alias("warnings"), status.alias("status"))
