"""Scoring answers by terms, classifying errors, and taking chains of retrieval and use apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_match_text
from . import metrics


def contains_term(normal: Column, term: Column) -> Column:
    """Substring match of a term in normalised text; a blank term never matches."""
    return F.coalesce((F.coalesce(term, F.lit("")) != "") & F.contains(normal, normalize_match_text(term)), F.lit(False))


def with_score(df: DataFrame, answer: str, required: str, forbidden: str) -> DataFrame:
    """Adds required_terms_recall, forbidden_violation and answer_pass: all of the groups, any term of a group, no
    forbidden term.  Without groups the recall is 1.  What is found is a column of its own, which the three columns
    read, so an answer is normalised and searched once."""

    def judged(normal: Column) -> Column:
        hits = F.transform(F.col(required), lambda group: F.exists(group, lambda t: contains_term(normal, t)))
        return F.struct(hits.alias("hits"), F.exists(F.col(forbidden), lambda t: contains_term(normal, t)).alias("bad"))

    found = df.withColumn("_found", F.get(F.transform(F.array(normalize_match_text(F.col(answer))), judged), F.lit(0)))
    hits, bad = F.col("_found.hits"), F.col("_found.bad")
    recall = F.when(F.size(hits) > 0, F.size(F.filter(hits, lambda x: x)) / F.size(hits)).otherwise(1.0)
    return found.withColumns({"required_terms_recall": F.round(recall, 6), "forbidden_violation": bad, "answer_pass": (recall == 1.0) & ~bad}).drop("_found")


def error_type(passed: Column, used_gold: Column, base_gold: Column, selected_gold: Column, same_cluster: Column, asr_known: Column, asr_cluster: Column) -> Column:
    """The first cause that fits a failed answer."""
    return (
        F.when(passed, "none").when(~used_gold, "retrieval_miss").when(base_gold & ~selected_gold, "over_override")
        .when(~selected_gold & same_cluster, "same_cluster_neighbor").when(asr_known & ~asr_cluster, "asr_semantic_drift").otherwise("generation_miss")
    )


def use_stage(passed: Column, in_context: Column, grounded: Column) -> Column:
    """The first cause that fits a task which the selected memory did not solve."""
    return F.when(passed, "none").when(~in_context, "retrieval_miss").when(~grounded, "wrong_memory_selected").otherwise("answer_parse_or_generation_miss")


def final_use(df: DataFrame, by: list[str]) -> DataFrame:
    """Rates of rows (answer_pass, grounded, in_context, error_type), and how often each error occurs."""
    passed, grounded, seen = F.col("answer_pass"), F.col("grounded"), F.col("in_context")
    kinds = ("none", "retrieval_miss", "wrong_memory_selected", "answer_parse_or_generation_miss")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), metrics.rate(passed).alias("answer_pass"), metrics.rate(grounded).alias("grounded_target_acc"), metrics.rate(seen).alias("context_gold_rate"),
        metrics.rate(seen & ~passed).alias("generation_miss_rate"), metrics.rate(~seen).alias("retrieval_miss_rate"), metrics.rate(~grounded & ~passed).alias("wrong_memory_answer_rate"),
        *[F.count_if(F.col("error_type") == k).alias(f"n_{k}") for k in kinds],
    )


def answer_metrics(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Answer rates over all rows and by each of the grouping sets, in one pass."""
    columns = sorted({c for s in sets for c in s})
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(*[F.grouping(c).cast("int").alias(f"all_{c}") for c in columns], F.count(F.lit(1)).alias("n"), metrics.rate(F.col("answer_pass")).alias("answer_pass"), metrics.mean(F.col("required_terms_recall")).alias("required_terms_recall"), metrics.rate(F.col("forbidden_violation")).alias("forbidden_rate"), metrics.rate(F.col("error_type") == "generation_miss").alias("generation_error_rate"))


def chain(df: DataFrame, by: list[str]) -> DataFrame:
    """Retrieval and use taken apart: rows have hit (gold retrieved) and used (task solved)."""
    hit, used = F.col("hit"), F.col("used")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), metrics.rate(hit).alias("hit_rate"), metrics.rate(used).alias("use_success"), metrics.share(used, hit).alias("use_given_hit"),
        metrics.rate(hit & ~used).alias("hit_but_use_fail"), metrics.rate(~hit & used).alias("miss_but_success"),
    )


def context_audit(rows: DataFrame, documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Whether the key's answer was in the first document, in the selected one, and anywhere in the context, each scored anew.

    ``rows`` has (sample_id, answer_pass, used_candidate_ids, selected_candidate_id, error_type), ``documents`` (sample_id,
    document), ``keys`` (sample_id, required_terms, forbidden_terms).  Candidates are looked up by id; an unknown one has no
    text.  A row without a key is an error."""
    texts = documents.select(F.col("sample_id").alias("_id"), F.coalesce("document", F.lit("")).alias("_text"))
    listed = rows.select("sample_id", F.posexplode_outer("used_candidate_ids").alias("at", "_id")).join(texts, "_id", "left")
    one = F.struct("at", F.coalesce("_text", F.lit("")).alias("text"))
    nested = listed.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), one))).alias("_used"))
    selected = rows.select("sample_id", F.col("selected_candidate_id").alias("_id")).join(texts, "_id", "left").select("sample_id", F.coalesce("_text", F.lit("")).alias("selected"))
    out = rows.join(nested, "sample_id").join(selected, "sample_id").join(keys.withColumn("_key", F.lit(True)), "sample_id", "left")
    out = out.where(F.coalesce(F.col("_key"), F.raise_error(F.concat(F.lit("no answer key for "), F.col("sample_id").cast("string"))).cast("boolean")))
    used = F.transform("_used", lambda x: x["text"])
    out = out.withColumns({"first": F.coalesce(F.get(used, F.lit(0)), F.lit("")), "context": F.array_join(used, "\n\n"), "passed": F.col("answer_pass")})
    found = {"first_doc_has_answer": "first", "selected_doc_has_answer": "selected", "context_has_answer": "context"}
    for name, text in found.items():
        out = with_score(out, text, "required_terms", "forbidden_terms").withColumn(name, F.col("answer_pass"))
    had, first = F.col("context_has_answer"), F.col("first_doc_has_answer")
    return out.select(
        "sample_id", F.col("passed").alias("answer_pass"), *found, (F.col("passed") & had & ~first).alias("context_recovery"), (~F.col("passed") & had).alias("context_pollution_or_generation_miss"), (~had).alias("retrieval_miss_by_answer_key"), "error_type",
    )


def audit_report(audit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, the rate of each of the audit's verdicts, and three counts)."""
    flags = [c for c, t in audit.dtypes if t == "boolean"]
    counted = flags[-3:]
    return audit.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[metrics.rate(F.col(c)).alias(c) for c in flags], *[F.count_if(c).alias(f"{c}_count") for c in counted])
