"""Accessors of result records: hits, candidate lists, memories, names.  Candidate lists are arrays of structs in the
order of their rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .parsing import LETTERS, first_letter, runs
from .ranking import NO_RANK
from .text import col, first_non_blank, non_blank, normalize_match_text

#: The order in which a record's hit fields are asked, behind the field of the mode.
HIT_ORDERS = {
    "selector": ("hit_at_1", "text_hit_at_1", "sample_hit_at_1"),
    "paired": ("hit_at_1", "sample_hit_at_1", "text_hit_at_1"),
}
MODE_FIELDS = {"text": "text_hit_at_1", "sample": "sample_hit_at_1"}
ABSENT_RANK = 999


def hit_value(columns: list[str], mode: str, order: str, rank: Column) -> Column:
    """1.0 or 0.0: the mode's own field, then those of ``HIT_ORDERS``, then whether the rank is 1; null counts as absent."""
    asked = [MODE_FIELDS[mode]] if mode in MODE_FIELDS else []
    have = [F.col(c).cast("double") for c in (*asked, *HIT_ORDERS[order]) if c in columns]
    return F.coalesce(*have, F.coalesce(rank == 1, F.lit(False)).cast("double"))


def top_candidates(columns: list[str], limit: int) -> Column:
    """(rank, candidate, score) of the first ``limit`` of the labels of a record, or of its scored texts."""
    one = lambda name: F.transform(
        F.slice(F.col("top_labels" if name == "label" else "scores"), 1, limit),
        lambda x: F.struct(x["rank"].alias("rank"), x[name].alias("candidate"), x["score"].alias("score")),
    )
    have = [one(name) for name, c in (("label", "top_labels"), ("text", "scores")) if c in columns]
    if not have:
        raise ValueError("a record has top_labels or scores")
    return F.coalesce(*have)


def unique_texts(scores: Column | str, top_k: int) -> Column:
    """How many different normalised texts the first ``top_k`` candidates have."""
    return F.size(F.array_distinct(F.transform(F.slice(col(scores), 1, top_k), lambda x: normalize_match_text(x["text"]))))


def top_ties(scores: Column | str, top_k: int, eps: float = 1e-9) -> Column:
    """How many of the first ``top_k`` candidates have the first one's score."""
    some = F.slice(col(scores), 1, top_k)
    return F.size(F.filter(some, lambda x: F.abs(F.coalesce(x["score"], F.lit(0.0)) - F.coalesce(F.get(some, F.lit(0))["score"], F.lit(0.0))) <= eps))


def rank_in(ids: Column | str, one: Column | str, absent: int = ABSENT_RANK) -> Column:
    """The place of an id in a list, from 1."""
    return F.coalesce(F.nullif(F.array_position(col(ids), col(one)), F.lit(0)), F.lit(absent)).cast("long")


def first_id(ids: Column | str) -> Column:
    return F.coalesce(F.get(col(ids), F.lit(0)), F.lit(""))


def memory_of(memories: Column | str, one: Column | str) -> Column:
    """The first memory of that id, or null."""
    return F.get(F.filter(col(memories), lambda x: x["memory_id"] == col(one)), F.lit(0))


def memory_index(memories: Column | str, one: Column | str) -> Column:
    """The place of a memory in the list, from 0, or null."""
    return F.nullif(F.array_position(F.transform(col(memories), lambda x: x["memory_id"]), col(one)), F.lit(0)) - 1


def candidate_hit(sample_id: Column, target: Column, candidate: Column, mode: str) -> Column:
    """Whether a candidate (sample_id, text) is the target by its text (if there is one) or by its id; ``auto`` takes both."""
    if mode not in ("auto", "text", "sample"):
        raise ValueError(f"unknown hit mode: {mode}")
    wanted = F.trim(F.coalesce(target, F.lit("")))
    same_text = (wanted != "") & (F.trim(F.coalesce(candidate["text"], F.lit(""))) == wanted)
    same_id = F.coalesce(candidate["sample_id"] == sample_id, F.lit(False))
    return {"auto": same_text | same_id, "text": same_text, "sample": same_id}[mode]


def gold_rank(sample_id: Column, target: Column, scores: Column | str, mode: str) -> Column:
    """The place of the first candidate that hits, from 1, or ``NO_RANK``."""
    hits = F.transform(col(scores), lambda x: candidate_hit(sample_id, target, x, mode))
    return F.coalesce(F.nullif(F.array_position(hits, True), F.lit(0)), F.lit(NO_RANK)).cast("long")


def audio_memories(memories: Column | str, limit: int = -1) -> Column:
    """The memories with an audio clip, up to ``limit`` of them; all if it is negative."""
    heard = F.filter(col(memories), lambda x: non_blank(x["audio_path"]).isNotNull())
    return heard if limit < 0 else F.slice(heard, 1, limit) if limit else F.slice(heard, 1, 0)


def audio_seconds(query_audio: Column | str, memories: Column | str, memory_audio: bool, limit: int = -1, use_query: bool = True) -> Column:
    """One for the query's clip and one for each memory's clip that the policy attaches."""
    query = F.when(non_blank(query_audio).isNotNull(), 1.0).otherwise(0.0) if use_query else F.lit(0.0)
    return query + F.size(audio_memories(memories, limit)).cast("double") if memory_audio else query


def rank_fields(rank: Column, hit: Column) -> dict[str, Column]:
    return {"hit": hit.cast("boolean"), "r3": rank <= 3, "r5": rank <= 5, "mrr": F.when(rank > 0, 1.0 / rank).otherwise(0.0)}


def policy_threshold(policy: Column | str) -> Column:
    """What stands behind ``tau=`` in a policy's name, or ``n/a``."""
    return F.coalesce(non_blank(F.regexp_extract(col(policy), r"tau=([0-9.]+)", 1)), F.lit("n/a"))


def safe_name(c: Column | str) -> Column:
    """A file name: all but letters and digits of any script, - and _ becomes _."""
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}_-]", "_")


def safe_error(kind: Column, message: Column, limit: int = 180) -> Column:
    """An error on one line, without bearer tokens, cut to ``limit`` characters."""
    line = F.regexp_replace(F.regexp_replace(message, "\n", " "), r"Bearer\s+[A-Za-z0-9._-]+", "Bearer <redacted>")
    return F.concat(kind, F.lit(":"), F.left(line, F.lit(limit)))


def required(c: Column | str, name: str, row_id: Column | str) -> Column:
    """A value that must not be blank: the job fails at a row where it is."""
    message = F.concat(F.lit("row "), F.coalesce(col(row_id).cast("string"), F.lit("")), F.lit(f" is missing required field {name}"))
    return F.coalesce(non_blank(col(c).cast("string")), F.raise_error(message).cast("string"))


def query_text(route: str, query_field: str, asr_field: str) -> Column:
    """What a route asks with: its own field, else the transcript, else the text."""
    return first_non_blank(asr_field if route == "asr_text" else query_field, "transcript", "text")


def audio_column(schema: StructType, preferred: str) -> str:
    """The column that holds audio: the preferred one, else the first struct with an array or a path."""
    if preferred in schema.names:
        return preferred
    for f in schema.fields:
        if isinstance(f.dataType, StructType) and {"array", "path"} & set(f.dataType.names):
            return f.name
    raise ValueError(f"no audio column; preferred was {preferred}")


def option_bodies(options: Column | str) -> Column:
    """Options without what stands before their first ``. ``."""
    return F.transform(col(options), lambda x: F.when(F.instr(x, ". ") > 0, F.substring(x, F.instr(x, ". ") + 2, F.length(x))).otherwise(x))


def content_choice(text: Column | str, options: Column | str) -> Column:
    """(letter, method, score) of an answer that repeats an option's content: the first option that the text contains,
    else the first of those that share the largest part of their words, if three quarters or more."""
    said = normalize_match_text(text)
    told = F.split(said, " ")

    def judged(x: Column, i: Column) -> Column:
        normal = normalize_match_text(x)
        words = F.array_distinct(F.split(normal, " "))
        share = F.when((normal == "") | (said == ""), 0.0).otherwise(F.size(F.array_intersect(words, told)) / F.size(words))
        inside = (normal != "") & F.contains(said, normal)
        return F.struct(inside.cast("int").alias("exact"), F.when(inside, 1.0).otherwise(share).alias("score"), (-i).alias("at"))

    found = F.transform(col(options), judged)
    exact = F.array_max(F.filter(found, lambda x: x["exact"] == 1))
    near = F.array_max(F.transform(found, lambda x: F.struct(x["score"], x["at"])))
    letter = lambda at: F.substring(F.lit(LETTERS), (-at + 1).cast("int"), F.lit(1))
    score = F.coalesce(near["score"], F.lit(0.0))
    made = lambda a, b, c: F.struct(a.alias("letter"), F.lit(b).alias("method"), c.alias("score"))
    return (
        F.when(said == "", made(F.lit(""), "none", F.lit(0.0)))
        .when(exact.isNotNull(), made(F.coalesce(letter(F.array_max(F.transform(F.filter(found, lambda x: x["exact"] == 1), lambda x: x["at"]))), F.lit("")), "content_exact", F.lit(1.0)))
        .when(score >= 0.75, made(letter(near["at"]), "content_overlap", score))
        .otherwise(made(F.lit(""), "none", score))
    )


#: How answers are labelled; the second form is that of memory runs.
LABELLED = (r'(?i)"answer"\s*:\s*"([A-H])"', r"(?i)\b(?:answer|option|choice)\s*[:：]\s*([A-H])\b")
LABELLED_MEMORY = (LABELLED[0], r"(?i)\b(?:answer|option|choice)\s*[:?]\s*([A-H])\b")
CHANNELS = ("<|channel>final", "<channel|>", "<|channel>thought")


def answered(text: Column | str) -> tuple[Column, Column]:
    """(what follows the last final channel, whether the output stops in its thoughts)."""
    raw = F.coalesce(col(text), F.lit(""))
    final, plain, thought = CHANNELS
    last = lambda mark: F.element_at(F.split(raw, mark.replace("|", r"\|")), -1)
    said = F.when(F.contains(raw, F.lit(final)), last(final)).when(F.contains(raw, F.lit(plain)), last(plain)).otherwise(raw)
    return said, F.contains(raw, F.lit(thought)) & ~F.contains(raw, F.lit(final)) & ~F.contains(raw, F.lit(plain))


def labelled_letter(text: Column, patterns: tuple[str, ...] = LABELLED) -> Column:
    """The letter that an answer names as such, by the first pattern that is met; null without one."""
    return F.coalesce(*[F.nullif(F.upper(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def found(letter: Column, method: str, score: float = 1.0) -> Column:
    return F.struct(letter.alias("letter"), F.lit(method).alias("method"), F.lit(score).alias("score"))


def channel_choice(text: Column | str, options: Column | str) -> Column:
    """(letter, method, score) of a model's output: what follows its last final channel, by the letter that it names as its
    answer, else by the first letter that stands alone, else by content; an output that stops in its thoughts has none."""
    said, silent = answered(text)
    letter = F.coalesce(labelled_letter(said), first_letter(said))
    return F.when(silent, found(F.lit(""), "no_final_channel", 0.0)).when(letter != "", found(letter, "letter")).otherwise(content_choice(said, options))


def memory_choice(text: Column | str, options: Column | str) -> Column:
    """The same among a row's own options: only their letters count, and of those that stand alone the last.  (Letters that
    are found by other forms stand alone, too.)"""
    said, silent = answered(text)
    there = F.substring(F.lit(LETTERS), F.lit(1), F.size(options).cast("int"))
    named = labelled_letter(said, LABELLED_MEMORY)
    alone = F.filter(F.regexp_extract_all(F.upper(said), F.lit(rf"\b([{LETTERS}])\b"), F.lit(1)), lambda x: F.contains(there, x))
    letter = F.coalesce(F.when(F.contains(there, named), named), F.try_element_at(alone, F.lit(-1)))
    return F.when(silent, found(F.lit(""), "no_final_channel", 0.0)).when(letter.isNotNull(), found(letter, "letter")).otherwise(content_choice(said, options))


def chat_choice(text: Column | str, options: Column | str) -> Column:
    """The same for a chat's transcript, which repeats its prompt: the last letter beside which no letter or digit stands,
    else as ``channel_choice``."""
    alone = F.regexp_extract_all(F.upper(F.coalesce(col(text), F.lit(""))), F.lit(rf"(?<![A-Z0-9])([{LETTERS}])(?![A-Z0-9])"), F.lit(1))
    last = F.try_element_at(alone, F.lit(-1))
    return F.when(last.isNotNull(), found(last, "chat_last_letter")).otherwise(channel_choice(text, options))


def run_mask(array: Column, value: Column, which: str = "last") -> Column:
    """True at the places of one run of ``value``: the last or the first."""
    if which not in ("first", "last"):
        raise ValueError(f"unknown run: {which}")
    found = runs(array, value)
    one = F.try_element_at(found, F.lit(-1 if which == "last" else 1))
    return F.transform(array, lambda x, i: F.coalesce((i >= one["start"]) & (i < one["stop"]), F.lit(False)))
