"""Text normalisers and projections, as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that matching keeps, besides white space.
MATCH_KEEP = r"a-z0-9一-鿿"
CJK = r"㐀-鿿"
FULL_WIDTH = ("，。！？：；", ",.!?:;")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def non_blank(c: Column | str) -> Column:
    """Null for a null or empty string."""
    return F.nullif(col(c), F.lit(""))


def first_non_blank(*columns: Column | str) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[non_blank(c) for c in columns], F.lit(""))


def collapse_ws(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "), r"^ | $", "")


def normalize_match_text(c: Column | str) -> Column:
    """Lower case; all but ASCII letters, digits and CJK becomes one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), f"[^{MATCH_KEEP}]+", " "))


def normalize_question(c: Column | str) -> Column:
    """The key of question joins: ASCII letters and digits."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "))


def normalize_candidate_text(c: Column | str, cjk_spaces: bool = False) -> Column:
    """Trimmed lower case with single spaces; ``cjk_spaces`` also takes out the spaces between CJK characters."""
    out = F.lower(collapse_ws(c))
    return F.regexp_replace(out, f"(?<=[{CJK}])\\s+(?=[{CJK}])", "") if cjk_spaces else out


def tokens(c: Column | str, keep: str = "a-z0-9") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(f"([{keep}]+)"), F.lit(1))


def word_count(c: Column | str) -> Column:
    """Words between white space; none for blank text."""
    clean = collapse_ws(c)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " "))).cast("long")


def slugify(c: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(non_blank(slug), F.lit("empty"))


def label_family(c: Column | str) -> Column:
    return F.split_part(col(c), F.lit("_"), F.lit(1))


def label_words(c: Column | str) -> Column:
    return F.array_join(F.filter(F.split(F.translate(col(c), "-", "_"), "_"), lambda x: x != ""), " ")


def shorten(c: Column | str, limit: int) -> Column:
    """Collapsed white space, cut to ``limit`` characters with an ellipsis."""
    clean = collapse_ws(c)
    return F.when(F.length(clean) > limit, F.concat(F.rtrim(F.left(clean, F.lit(limit - 3))), F.lit("..."))).otherwise(clean)


def sentences(c: Column | str) -> Column:
    """Cut behind . ! ? and white space; blank pieces go."""
    return F.filter(F.split(F.trim(F.coalesce(col(c), F.lit(""))), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def choose_evidence(text: Column | str, answer: Column | str, limit: int) -> Column:
    """The first sentence with the answer, else the first sentence, else the text; cut to ``limit``."""
    cut = F.struct(sentences(text).alias("s"), F.lower(F.coalesce(col(answer), F.lit(""))).alias("wanted"))

    def first(v: Column) -> Column:
        hit = F.filter(v["s"], lambda x: (v["wanted"] != "") & F.contains(F.lower(x), v["wanted"]))
        return F.coalesce(F.get(hit, F.lit(0)), F.get(v["s"], F.lit(0)))

    # bound to a variable: sentences and answer are made once a text, not once for each of its sentences
    found = F.get(F.transform(F.array(cut), first), F.lit(0))
    return F.left(F.coalesce(found, col(text), F.lit("")), F.lit(limit))


def drop_words(c: Column | str) -> Column:
    """Every other word, from the first; texts of up to two words stay."""
    words = F.split(collapse_ws(c), " ")
    return F.when(F.size(words) <= 2, col(c)).otherwise(F.array_join(F.filter(words, lambda x, i: i % 2 == 0), " "))


def remap_prefix(c: Column | str, old: str, new: str) -> Column:
    return F.when(F.startswith(col(c), F.lit(old)), F.concat(F.lit(new), F.substring(col(c), len(old) + 1, 1 << 30))).otherwise(col(c))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays, by rows of the matrix; an array function, so no row leaves the JVM."""
    start = F.sequence(F.lit(0), F.size(b))

    def row(prev: Column, x: Column) -> Column:
        # a cell needs its left neighbour: the fold carries the row built so far
        return F.aggregate(
            F.zip_with(b, F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), lambda y, j: F.struct(y.alias("y"), j.alias("j"))),
            F.array(prev[0] + 1),
            lambda acc, s: F.when(s["j"] > F.size(b), acc).otherwise(F.array_append(acc, F.least(F.element_at(acc, -1) + 1, prev[s["j"]] + 1, prev[s["j"] - 1] + F.when(s["y"].eqNullSafe(x), 0).otherwise(1)))),
        )

    full = F.element_at(F.aggregate(a, start, row), -1)
    return F.when(F.size(b) == 0, F.size(a)).otherwise(full).cast("long")


def token_error_rate(reference: Column | str, hypothesis: Column | str, keep: str = "a-z0-9") -> Column:
    """Token edits per reference token; for an empty reference 0 or 1."""
    r, h = tokens(reference, keep), tokens(hypothesis, keep)
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(edit_distance(r, h) / F.size(r))


def readable_label(label: Column | str) -> Column:
    return F.translate(col(label), "_-", "  ")


def tool_card(label: Column, task: Column, domain: Column, examples: Column, boundaries: Column, style: str) -> Column:
    """A tool's card for routing spoken commands: ``tool_schema_card``, ``example_augmented_tool`` or
    ``contrastive_boundary_tool``.  The sentences are fixed values."""
    shown = F.coalesce(F.nullif(F.translate(domain, "_", " "), F.lit("")), F.lit("unknown"))
    head = F.concat(F.lit("Tool schema card for spoken command routing. Tool name: "), label, F.lit(". Task type: "), task, F.lit(". Domain: "), shown, F.lit(". Use this tool when the user command asks for: "), readable_label(label), F.lit("."))
    if style == "tool_schema_card":
        return head
    example = F.concat(head, F.lit(" "), F.array_join(F.transform(examples, lambda x: F.concat(F.lit("Positive example: "), x, F.lit("."))), " "))
    if style == "example_augmented_tool":
        return F.trim(example)
    if style != "contrastive_boundary_tool":
        raise ValueError(f"unknown card style: {style}")
    near = F.when(F.size(boundaries) > 0, F.array_join(boundaries, ", ")).otherwise("none")
    return F.concat(example, F.lit(" Boundary note: do not choose this tool for nearby tools or intents: "), near, F.lit("."))
