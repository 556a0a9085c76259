"""Reading model outputs and nested documents: JSON, option letters, answer cards, runs in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, collapse_ws, tokens

#: Letters that name options.
LETTERS = "ABCDEFGH"


def nested(document: Column | str, path: str, kind: str = "string", default: object = None) -> Column:
    """A value at ``path`` of a JSON text, or the default."""
    value = F.try_variant_get(F.try_parse_json(col(document)), path, kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def payload(document: Column | str, paths: list[str], kind: str) -> Column:
    """The first of several places that holds rows; an error if none does."""
    parsed = F.try_parse_json(col(document))
    return F.coalesce(*[F.try_variant_get(parsed, p, kind) for p in paths], F.raise_error(F.lit("no rows at " + ", ".join(paths))))


def embedded_json(text: Column | str) -> Column:
    """The JSON of a text, or from its first brace to its last, without a code fence."""
    bare = F.regexp_replace(F.trim(F.coalesce(col(text), F.lit(""))), r"^```(?:json)?\s*|\s*```$", "")
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def judge_fields(text: Column | str) -> tuple[Column, Column, Column]:
    """(passed, score, reason) of a judge's JSON, with defaults."""
    parsed = embedded_json(text)
    get = lambda path, kind, default: F.coalesce(F.try_variant_get(parsed, path, kind), F.lit(default))
    return get("$.pass", "boolean", False), get("$.score", "double", 0.0), get("$.reason", "string", "")


def first_letter(text: Column | str, letters: str = LETTERS) -> Column:
    """The first standalone option letter, or empty."""
    return F.regexp_extract(F.upper(F.coalesce(col(text), F.lit(""))), rf"\b([{letters}])\b", 1)


def last_letter(text: Column | str, letters: str = LETTERS) -> Column:
    """The last standalone option letter, or empty."""
    found = F.regexp_extract_all(F.upper(F.coalesce(col(text), F.lit(""))), F.lit(rf"\b([{letters}])\b"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def option_map(text: Column | str) -> Column:
    """Letter to option text, from ``A. text`` pieces; a letter given twice keeps the last."""
    rule = r"(?s)\b([A-D])[.、:)]\s*(.*?)(?=\s*\b[A-D][.、:)]|$)"
    letters = F.regexp_extract_all(col(text), F.lit(rule), F.lit(1))
    options = F.transform(F.regexp_extract_all(col(text), F.lit(rule), F.lit(2)), collapse_ws)
    pairs = F.arrays_zip(letters.alias("key"), options.alias("value"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def card_answer(text: Column | str) -> Column:
    """The answer line of a card, else the collapsed text."""
    found = F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?is)answer\s*:\s*(.*?)(?:\n|$)", 1)
    return F.coalesce(F.nullif(collapse_ws(found), F.lit("")), collapse_ws(text))


def short_answer(text: Column | str) -> Column:
    """A card's answer ready for comparison: lower case, ASCII punctuation, no quotes around it, then no last
    semicolon (a quote before that semicolon stays)."""
    found = collapse_ws(F.translate(F.lower(card_answer(text)), "；，。", ";,."))
    return F.regexp_replace(F.regexp_replace(found, r"^[\s\"'`]+|[\s\"'`]+$", ""), r"\s*;\s*$", "")


def answers_match(candidate: Column | str, gold: Column | str) -> Column:
    """Equal short answers, or a bare option letter against an answer that opens with it; blank matches nothing."""
    a, b = short_answer(candidate), short_answer(gold)
    opens = lambda bare, full: bare.rlike("^[a-d]$") & full.rlike(r"^[a-d](?:[.):;\s]|$)") & F.startswith(full, bare)
    return (a != "") & (b != "") & ((a == b) | opens(a, b) | opens(b, a))


def overlap_coefficient(a: Column | str, b: Column | str) -> Column:
    """Shared tokens over the smaller set; 0 if one is empty."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def runs(array: Column, value: Column) -> Column:
    """Half-open spans (start, stop) of the runs of ``value`` in an array."""
    n = F.size(array)
    at = lambda i: F.get(array, i).eqNullSafe(value)
    places = F.sequence(F.lit(0), n - 1)
    starts = F.filter(places, lambda i: at(i) & ((i == 0) | ~at(i - 1)))
    stops = F.transform(F.filter(places, lambda i: at(i) & ((i == n - 1) | ~at(i + 1))), lambda i: i + 1)
    return F.when(n > 0, F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
