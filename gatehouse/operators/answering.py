"""Evaluating answers over retrieved documents: prompts, local generators, grounding, rows and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import portable_hash
from ..functions.text import col, first_non_blank, non_blank, normalize_match_text
from . import fusion, metrics, rag

#: What each style of prompt says before the question, how it names the question, and the judge's rules.
STYLES = {
    "default": (
        (
            "You answer a user question using only the provided knowledge documents.",
            "The user question may come from speech and may contain recognition errors.",
            "Prefer the document that directly answers the question.",
            "Do not merge conflicting facts from neighboring documents.",
            "If the documents do not contain enough information, say that the knowledge base does not provide enough information.",
        ),
        "User question: ",
    ),
    "asr_robust": (
        (
            "You answer a user question using only the provided knowledge documents.",
            "The user question is an uncertain speech transcript and may contain severe recognition errors, especially names, dates, and short function words.",
            "Do not refuse only because the transcript contains odd words.",
            "Infer the most plausible intended question from the retrieved documents and answer the supported entity, date, count, or phrase.",
            "Prefer higher-ranked documents, but use lower-ranked documents when they clearly contain the answer.",
            "Do not merge conflicting facts from unrelated documents.",
            "If no provided document supports a plausible answer, say that the knowledge base does not provide enough information.",
        ),
        "Uncertain speech transcript: ",
    ),
    "extractive_short": (
        (
            "You answer a spoken question using only the provided knowledge documents.",
            "Return the shortest exact answer phrase that is supported by one document.",
            "Prefer copying the phrase from the document instead of paraphrasing it.",
            "Do not explain your reasoning. Do not add extra facts.",
            "If none of the documents contains a supported answer, return: NOT ENOUGH INFORMATION",
        ),
        "Spoken question transcript: ",
    ),
    "evidence_then_answer": (
        (
            "You answer a spoken question using only the provided knowledge documents.",
            "The transcript may be noisy, so treat it as a clue rather than an exact string.",
            "First identify one evidence span in the documents that most directly answers the intended question.",
            "Then copy the shortest answer phrase from that evidence span.",
            "Do not merge conflicting facts from different documents.",
            "Return exactly this format:",
            "EVIDENCE: <one copied evidence span>",
            "ANSWER: <short copied answer phrase, or NOT ENOUGH INFORMATION>",
        ),
        "Spoken question transcript: ",
    ),
}
JUDGE_RULES = (
    "You are a strict but rule-bound RAG evaluator.",
    "Judge the system answer only by the provided rule key and selected document.",
    "Do not use outside knowledge. Do not reward fluent but unsupported answers.",
    "Return compact JSON only; no markdown.",
    "",
    "Rules:",
    "1. pass=true only if the answer covers the key_decision.",
    "2. required_terms are OR groups. For each group, a paraphrase is acceptable if it clearly expresses the same condition.",
    "3. If the answer states any forbidden_terms or their clear meaning, forbidden_violation=true and pass=false.",
    "4. If the selected document is the wrong neighboring rule and changes the answer, grounding_error=true and pass=false.",
    "5. If the answer refuses despite enough evidence in the selected document, pass=false.",
    "",
)
JUDGE_SCHEMA = 'Schema: {"pass": true, "required_coverage": 1.0, "forbidden_violation": false, "grounding_error": false, "reason": "short reason"}'
GENERATORS = ("gold", "first_document")
MOST_CANDIDATES = 26


def answer_prompt(question: Column | str, documents: Column | str, style: str = "default") -> Column:
    """The prompt of a question over numbered documents."""
    if style not in STYLES:
        raise ValueError(f"unknown answer prompt style: {style}")
    lines, name = STYLES[style]
    head = F.array(*[F.lit(x) for x in lines], F.lit(""), F.concat(F.lit(name), F.coalesce(col(question), F.lit(""))), F.lit(""), F.lit("Knowledge documents:"))
    shown = F.transform(col(documents), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return F.array_join(F.concat(head, shown, F.array(F.lit(""), F.lit("Final answer:"))), "\n")


def spelt(terms: Column) -> Column:
    """A list of texts as JSON with a space behind each comma."""
    quoted = F.transform(terms, lambda t: F.regexp_extract(F.to_json(F.array(t)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def judge_prompt(question: Column, asr_text: Column, gold: Column, decision: Column, required: Column, forbidden: Column, document: Column, answer: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    groups = F.concat(F.lit("["), F.array_join(F.transform(required, spelt), ", "), F.lit("]"))
    told = {"User question": blank(question), "ASR text": blank(asr_text), "Gold answer": blank(gold), "Key decision": blank(decision), "Required term groups": groups, "Forbidden terms": spelt(forbidden), "Selected document": blank(document), "System answer": blank(answer)}
    lines = [F.lit(x) for x in JUDGE_RULES] + [F.concat(F.lit(f"{k}: "), v) for k, v in told.items()] + [F.lit(""), F.lit(JUDGE_SCHEMA)]
    return F.array_join(F.array(*lines), "\n")


def grounding(sample_id: Column, sample: Column, target: str, fields: list[str]) -> Column:
    """What a sample is grounded in: its document (else its base sample, else itself), or a normalised field; ``sample``
    is a struct, null for an unknown sample."""
    if target == "document_id":
        have = [non_blank(sample[c]) for c in ("document_id", "base_sample_id") if c in fields]
        return F.coalesce(*have, sample_id)
    return F.when(sample.isNotNull(), normalize_match_text(sample[target])).otherwise(sample_id) if target in fields else sample_id


def same_domain_intent(sample: Column, target: Column) -> Column:
    """Whether both have a domain and an intent, and the same."""
    own = non_blank(sample["domain"]).isNotNull() & non_blank(sample["intent"]).isNotNull()
    return F.coalesce(own & (sample["domain"] == target["domain"]) & (sample["intent"] == target["intent"]), F.lit(False))


def document(candidate: Column, sample: Column, fields: list[str]) -> Column:
    """A candidate's own document, else its sample's document, context or text."""
    return F.coalesce(non_blank(candidate["document"]), *[non_blank(sample[c]) for c in ("document_text", "context", "text") if c in fields], F.lit(""))


def local_answer(mode: str, documents: Column, gold: Column, decision: Column) -> Column:
    """The answer of a local generator: the key's, or the first document."""
    if mode not in GENERATORS:
        raise ValueError(f"no local generator: {mode}")
    return first_non_blank(gold, decision) if mode == "gold" else F.coalesce(F.get(documents, F.lit(0)), F.lit(""))


def evaluate(rows: DataFrame, samples: DataFrame, keys: DataFrame, *, generator: str = "first_document", candidates: int = 5, context: int = 3, shuffle_seed: int | None = None, grounding_target: str = "document_id", order: str = "asr") -> DataFrame:
    """One row for each row of ``rows``: the answer of a local generator over the first ``context`` candidates, its score by
    the key's terms, what it is grounded in, and the first cause of a failure.

    ``rows`` has (sample_id, asr_text, asr_top_k, omni_top_k: lists of (sample_id, document)), ``samples`` sample_id and
    manifest fields, ``keys`` (sample_id, gold_answer, key_decision, required_terms, forbidden_terms).  Candidates are the first
    ``candidates`` of one list, then unseen ones of the other; ``order`` names the list that comes first, or ``both`` alternates by
    rank.  Only candidates are looked up: they are exploded, joined to the samples and nested again."""
    fields = [c for c in samples.columns if c != "sample_id"]
    lookup = samples.select(F.col("sample_id").alias("_id"), F.struct(*fields).alias("_sample"))
    first, second = ("omni_top_k", "asr_top_k") if order == "omni" else ("asr_top_k", "omni_top_k")
    ids = lambda c: F.transform(F.col(c), lambda x: x["sample_id"])
    listed = fusion.merged(ids(first), ids(second), candidates)
    given = F.map_from_entries(F.transform(listed, lambda i: F.struct(i, F.coalesce(F.get(F.filter(F.concat(first, second), lambda x: x["sample_id"] == i), F.lit(0))["document"], F.lit("")))))
    asr_top = F.coalesce(F.get(ids("asr_top_k"), F.lit(0)), F.lit(""))
    made = rows.select("sample_id", "asr_text", listed.alias("_listed"), given.alias("_given"), asr_top.alias("_asr_top"))
    made = made.withColumn("baseline_choice_id", F.coalesce(F.get("_listed", F.lit(0)), F.lit("")))
    used = F.slice("_listed", 1, context)
    if shuffle_seed is not None:
        order_of = lambda i: F.struct(portable_hash(F.concat(F.lit(f"{shuffle_seed}:"), F.col("sample_id")), i).alias("h"), i.alias("i"))
        used = F.transform(F.array_sort(F.transform(used, order_of)), lambda p: p["i"])
    made = made.withColumn("used_candidate_ids", used)
    long = made.select("sample_id", F.posexplode("used_candidate_ids").alias("at", "_id"), F.col("_given")).withColumn("document", F.try_element_at("_given", F.col("_id")))
    one = F.struct("at", document(F.struct("document"), F.col("_sample"), fields).alias("d"), grounding(F.col("_id"), F.col("_sample"), grounding_target, fields).alias("g"))
    told = long.join(lookup, "_id", "left").groupBy("sample_id").agg(F.array_sort(F.collect_list(one)).alias("used"))
    told = told.select("sample_id", F.transform("used", lambda x: x["d"]).alias("documents"), F.transform("used", lambda x: x["g"]).alias("_grounds"))
    side = lambda c, name: lookup.select(F.col("_id").alias(c), F.col("_sample").alias(name))
    out = made.join(told, "sample_id", "left").join(keys.withColumn("_key", F.lit(True)), "sample_id", "left")
    # a row without a key is an error, as a lookup that fails
    keyed = F.coalesce(F.col("_key"), F.raise_error(F.concat(F.lit("no answer key for "), F.col("sample_id").cast("string"))).cast("boolean"))
    out = out.where(keyed).join(side("sample_id", "_own"), "sample_id", "left")
    out = out.join(side("baseline_choice_id", "_chosen"), "baseline_choice_id", "left").join(side("_asr_top", "_heard"), "_asr_top", "left")
    texts = F.coalesce("documents", F.array().cast("array<string>"))
    out = out.withColumn("answer_text", local_answer(generator, texts, F.col("gold_answer"), F.col("key_decision")))
    out = rag.with_score(out, "answer_text", "required_terms", "forbidden_terms")
    own, chosen, sid, base = F.col("_own"), F.col("_chosen"), F.col("sample_id"), F.col("baseline_choice_id")
    grounded = (base != "") & (grounding(base, chosen, grounding_target, fields) == grounding(sid, own, grounding_target, fields))
    in_use = F.coalesce(F.exists("_grounds", lambda g: g == grounding(sid, own, grounding_target, fields)), F.lit(False))
    match = lambda other: same_domain_intent(other, own) if {"domain", "intent"} <= set(fields) else F.lit(False)
    domain = (base != "") & match(chosen)
    grounded = F.coalesce(grounded, F.lit(False))
    kind = rag.error_type(F.col("answer_pass"), in_use, grounded, grounded, domain, F.col("_asr_top") != "", match(F.col("_heard")))
    more = {c: F.coalesce(own[c], F.lit("")) if c in fields else F.lit("") for c in ("query_style", "tts_dialect")}
    return out.select(
        "sample_id", grounding(sid, own, "document_id", fields).alias("document_id"), *[v.alias(k) for k, v in more.items()], "asr_text", "gold_answer", "key_decision", "baseline_choice_id", base.alias("selected_candidate_id"), "used_candidate_ids",
        grounded.alias("grounded_target_pass"), (base == sid).alias("grounded_sample_pass"), domain.alias("grounded_domain_intent_pass"), "answer_text", "answer_pass", "required_terms_recall", "forbidden_violation", kind.alias("error_type"),
    )


def report(rows: DataFrame, by: tuple[str, ...] = ("query_style", "tts_dialect")) -> DataFrame:
    """(section, value, n, and the answer's rates): over all rows and by each column; blank values are ``unknown``."""
    parts = F.array(F.struct(F.lit("all").alias("section"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("section"), F.coalesce(non_blank(c), F.lit("unknown")).alias("value")) for c in by])
    long = rows.select("*", F.inline(parts))
    return long.groupBy("section", "value").agg(
        F.count(F.lit(1)).alias("n"), metrics.rate(F.col("answer_pass")).alias("answer_pass"), metrics.mean(F.col("required_terms_recall")).alias("required_terms_recall"), metrics.rate(F.col("forbidden_violation")).alias("forbidden_rate"),
        metrics.rate(F.col("grounded_target_pass")).alias("grounded_target_acc"), metrics.rate(F.col("error_type") == "retrieval_miss").alias("retrieval_miss_rate"),
    )


def bad_cases(rows: DataFrame, count: int) -> DataFrame:
    """The first failed rows by id: the report's examples."""
    return rows.where(~F.col("answer_pass")).orderBy("sample_id").limit(count)
