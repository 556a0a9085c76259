"""Instruction arms: what an encoder is told before it represents audio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The arms, the cards from which four more are built, and each task's default arms.
ARMS = {
    "raw": "",
    "exact_condition_matching": "Represent the spoken audio for exact condition matching. Preserve numbers, negation, exceptions, and constraints.",
    "policy_grounding": "Represent the spoken question for retrieving the business rule that directly grounds the answer.",
    "semantic_qa": "Represent the spoken audio as a semantic question or utterance. Focus on the meaning needed to match an answer, passage, transcript, or knowledge item.",
    "negation_exception_sensitive": "Represent the spoken audio with special attention to negation, exclusion, exceptions, and boundary conditions.",
    "tool_specific_intent": "Represent the spoken command for selecting the most specific tool or intent, not a generic nearby action.",
    "transcript_like": "Represent the spoken audio by what the speaker literally says, preserving transcript-level content.",
    "emotion_or_paralinguistic": "Represent the spoken audio for emotion, tone, speaker intent, and paralinguistic cues.",
    "dialect_robust_semantic": "Represent the user's underlying semantic intent even when accent, dialect, or ASR-like surface forms are noisy.",
    "translation_semantic": "Represent the spoken audio by its cross-lingual meaning for matching an equivalent translation in another language. Preserve named entities, numbers, negation, and core predicate-argument meaning.",
    "v2_asr_literal_boundary": "Represent the spoken audio for transcript-candidate retrieval. Match the candidate that preserves the literal utterance, including function words, numbers, names, negation, and word-level distinctions. Do not choose a candidate that is merely on the same topic.",
    "v2_qa_answer_boundary": "Represent the spoken question for answer-bearing evidence retrieval. Match the passage or rule that entails the answer to the question. Preserve the question focus, entities, quantities, constraints, exceptions, and answer type. Reject same-topic passages that cannot directly answer the question.",
    "v2_tool_action_boundary": "Represent the spoken command for executable tool selection. Match the tool whose domain, requested action, object, and user goal are all correct. Reject nearby tools that share words or domain but would execute a different action.",
    "v2_translation_argument_boundary": "Represent the spoken source sentence for translation matching. Match the target-language sentence with the same proposition: who did what to whom, with the same entities, numbers, polarity, tense, and constraints. Reject translations that only share broad topic or scene.",
}
CARDS = {
    "constructed_asr_transcript": ("transcript-level ASR semantic matching", "the literal transcript candidate", "same spoken content, not merely same topic", "word order, named entities, numbers, negation, and short function words", "names, numbers, negation, literal wording", "do not collapse to a generic semantic topic when transcript details matter"),
    "constructed_rag_grounding": ("spoken question evidence retrieval", "the passage or rule that directly supports the answer", "grounded answer support rather than surface lexical overlap", "entities, constraints, dates, quantities, exceptions, and answer-bearing facts", "entities, constraints, answer-bearing facts, exceptions", "do not prefer a neighboring passage that is on topic but cannot answer the question"),
    "constructed_tool_intent": ("spoken command tool selection", "the most specific executable tool or intent schema", "same user action and operational intent", "tool boundaries, required action, domain, object, and unsafe confusions", "action, domain, object, tool boundary", "do not choose a generic nearby action when a more specific tool is implied"),
    "constructed_translation": ("cross-lingual speech translation matching", "the equivalent target-language translation candidate", "same cross-lingual meaning", "named entities, numbers, negation, tense, and predicate-argument structure", "named entities, numbers, negation, predicate-argument meaning", "do not match only by topic when the target sentence changes who did what"),
}
TASK_ARMS = {
    "rag": ("raw", "exact_condition_matching", "policy_grounding", "v2_qa_answer_boundary", "constructed_rag_grounding", "negation_exception_sensitive", "dialect_robust_semantic"),
    "tool": ("raw", "tool_specific_intent", "v2_tool_action_boundary", "constructed_tool_intent", "exact_condition_matching", "negation_exception_sensitive", "dialect_robust_semantic"),
    "asr_like": ("raw", "transcript_like", "v2_asr_literal_boundary", "constructed_asr_transcript", "semantic_qa", "dialect_robust_semantic", "exact_condition_matching"),
    "dialect": ("raw", "dialect_robust_semantic", "policy_grounding", "transcript_like"),
    "translation": ("raw", "translation_semantic", "v2_translation_argument_boundary", "constructed_translation", "semantic_qa", "transcript_like"),
}


# The sentences of a card, in their order; the last three are left out where the card says nothing.
OPENING = "Represent the spoken audio for {role}. Match it to {target}. Treat candidates as equivalent only when they express {equal}."
BOUNDARY, PRESERVE, WARNING = "Pay special attention to {}.", "Preserve {}.", "{}."


def instruction(role: str, target: str, equal: str, boundary: str = "", preserve: str = "", warning: str = "") -> str:
    """A card as one text; the first three parts are required."""
    if not (role.strip() and target.strip() and equal.strip()):
        raise ValueError("a card needs its role, its target and what counts as equal")
    rest = ((BOUNDARY, boundary), (PRESERVE, preserve), (WARNING, warning[:1].upper() + warning[1:]))
    return " ".join([OPENING.format(role=role, target=target, equal=equal), *[sentence.format(text) for sentence, text in rest if text]])


def all_arms() -> dict[str, str]:
    return ARMS | {name: instruction(*card) for name, card in CARDS.items()}


def task_arms(task: str, requested: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(arm, instruction): those requested, else the task's, else all."""
    known = all_arms()
    names = requested or TASK_ARMS.get(task, tuple(known))
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown arms: {unknown}")
    return [(n, known[n]) for n in names]


def arms_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(all_arms().items()), "arm string, instruction string")
