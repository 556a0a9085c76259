"""Quality rules as a short-circuit cascade.

Every rule has a verdict on the whole text.  On a bounded sample (``SAMPLE_ROWS`` rows, chosen by a hash of the id
and the text) the time of each rule, of each statistic that rules share, and the rejections of each rule are measured.
The order is greedy: next comes the rule with the most rejections, among the sample's texts that are still in play, a
second of what it adds, so a shared statistic is charged to the first rule that needs it.  Most documents that go are
rejected by a cheap rule, and only the rest pay for the dear ones.  A document is kept if no rule rejects it, so the
order, and with it the sample, changes the time and never the verdict.  ``failed_rule`` names the first rule in the
order of this cascade; as the order rests on measured time, another cascade may name another rule that rejects.

Rules see a batch of texts through ``Stats``, which computes each statistic once, on first use.  When rejected texts
make up ``COMPACT`` of a batch they are taken out of it, and what has been computed for the others is kept.  Nothing is
shuffled.  Null texts have no words and are rejected by ``min_words``; the empty table gives an empty result; repeated
rows are judged alike; extra columns pass through unread.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LEAD, SPACE, Words, chunks, mix, ngrams

SAMPLE_ROWS = 512
#: The share of a batch's texts that have to be rejected before the batch is made smaller.
COMPACT = 0.125
#: The characters counted as symbols.
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = True
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the bytes flagged lie in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


#: Statistics with one number for each text.
PER_TEXT = {"n_words", "word_chars", "n_symbols", "n_upper", "n_letters", "n_lines", "n_dup_lines", "n_repeat_words"}


class Stats:
    """Statistics of a batch of texts, each computed when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def take(self, good: np.ndarray) -> Stats:
        """Those texts alone, with all that is known of them."""
        size, have = np.diff(self.offsets), self.__dict__
        out = Stats(self.data[np.repeat(good, size)], np.concatenate([[0], np.cumsum(size[good])]))
        number = np.cumsum(good) - 1
        if "words" in have:
            out.words = self.words.take(good, out.data, out.offsets)
        if "hashes" in have:
            out.hashes = self.hashes[good[self.words.doc]]
        if "_lines" in have:
            hashes, text = self._lines
            out._lines = hashes[good[text]], number[text[good[text]]]
        for name in PER_TEXT & have.keys():
            setattr(out, name, have[name][good])
        return out

    @cached_property
    def words(self) -> Words:
        return Words(self.data, self.offsets)

    @cached_property
    def hashes(self) -> np.ndarray:
        return self.words.hashes()

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts

    @cached_property
    def word_chars(self) -> np.ndarray:
        return per_text(LEAD[self.data] & ~SPACE[self.data], self.offsets)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return per_text(SYMBOLS[self.data], self.offsets)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return per_text(UPPER[self.data], self.offsets)

    @cached_property
    def n_letters(self) -> np.ndarray:
        return per_text(LETTER[self.data], self.offsets)

    @cached_property
    def n_lines(self) -> np.ndarray:
        """Lines with a word."""
        return np.bincount(self._lines[1], minlength=self.n)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each line that has a word, and its text's number."""
        if not len(self.data):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        starts = np.concatenate([self.offsets[:-1], np.flatnonzero(self.data == 10) + 1])
        starts = np.unique(starts[starts < len(self.data)])
        ends = np.append(starts[1:], len(self.data))
        ends = ends - ((ends > starts) & (self.data[ends - 1] == 10))
        w = np.searchsorted(self.words.starts, starts)
        has = w < np.searchsorted(self.words.starts, ends)
        starts, ends = starts[has], ends[has]
        view = self.data.tobytes()
        found = [hash(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return np.array(found, np.int64).view(np.uint64), np.searchsorted(self.offsets, starts, side="right") - 1

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        lines, text = self._lines
        with np.errstate(over="ignore"):
            keys = mix(lines) + mix(text.astype(np.uint64) + np.uint64(1))
        first = np.unique(keys, return_index=True)[1]
        again = np.ones(len(keys), bool)
        again[first] = False
        return np.bincount(text[again], minlength=self.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in a window of three words that the text has at least twice."""
        w, out = self.words, np.zeros(self.n, np.int64)
        if len(w.doc) < 3:
            return out
        at = np.flatnonzero(w.doc[2:] == w.doc[:-2])
        with np.errstate(over="ignore"):
            keys = ngrams(self.hashes, 3)[at] + mix(w.doc[at].astype(np.uint64) + np.uint64(1))
        ordered = np.sort(keys)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return out
        place = np.searchsorted(twice, keys)
        at = at[twice[np.minimum(place, len(twice) - 1)] == keys]
        covered = np.zeros(len(w.doc), bool)
        for j in range(3):
            covered[at + j] = True
        return np.bincount(w.doc[covered], minlength=self.n)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives True for each text of a batch that has to go; ``needs`` are statistics that rules share, each
    behind those that it needs itself."""

    name: str
    rejects: Callable[[Stats], np.ndarray]
    needs: tuple[str, ...] = ()


#: The base rules, then the others: shares of symbols, of repeated lines, word length and shouted text.
RULES = (
    Rule("min_words", lambda s: s.n_words < 50, ("words",)),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 50 * s.n_words, ("words", "hashes")),
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words, ("words",)),
    Rule("repeated_lines", lambda s: (s.n_dup_lines >= 3) & (10 * s.n_dup_lines > 3 * s.n_lines), ("words",)),
    Rule("word_length", lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 15 * s.n_words), ("words",)),
    Rule("shouting", lambda s: 10 * s.n_upper > 6 * s.n_letters),
)


@dataclass
class Cascade:
    """Rules in the order in which they run, with what the sample said of each."""

    rules: list[Rule]
    report: list[dict] = field(default_factory=list)

    def rejected(self, stats: Stats, compact: float = COMPACT) -> np.ndarray:
        """For each text the number of the rule (in this order) that rejects it, -1 if none does."""
        out = np.full(stats.n, -1)
        left = np.arange(stats.n)  # the texts of the batch as it is now
        for k, rule in enumerate(self.rules):
            bad = rule.rejects(stats) & (out[left] < 0)
            out[left[bad]] = k
            good = out[left] < 0
            if not good.any():
                break
            if (~good).sum() > compact * len(left):
                left, stats = left[good], stats.take(good)
        return out


def ordered(rules: tuple[Rule, ...], own: list[float], shared: dict[str, float], verdicts: list[int]) -> list[int]:
    """The greedy order of ``rules``: ``own`` is each rule's time without shared statistics, ``shared`` the time of those,
    ``verdicts`` has for each text of the sample the rules that reject it, as bits."""
    left, paid, out = list(verdicts), set(), []

    def rate(k: int) -> tuple[float, int]:
        cost = own[k] + sum(shared.get(x, 0.0) for x in rules[k].needs if x not in paid)
        return sum(v >> k & 1 for v in left) / max(cost, 1e-9), -k

    while len(out) < len(rules):
        k = max((k for k in range(len(rules)) if k not in out), key=rate)
        out.append(k)
        paid.update(rules[k].needs)
        left = [v for v in left if not v >> k & 1]
    return out


def plan_cascade(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> Cascade:
    """Measure ``rules`` on at most ``sample_rows`` rows and order them by rejections per second of what each adds."""
    hashed = df.select(F.col(text_col).alias("text"), F.xxhash64(id_col, F.length(F.col(text_col))).alias("h"))
    most = hashed.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]  # texts wait until the hashes are chosen
    picked = hashed.where(F.col("h") <= F.lit(most)).limit(sample_rows)
    names = list(dict.fromkeys(x for rule in rules for x in rule.needs))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shared, verdicts = [0.0] * len(rules), [0.0] * len(names), []
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                stats, bits = Stats(data, offsets), np.zeros(len(offsets) - 1, np.int64)
                for k, name in enumerate(names):
                    began = time.perf_counter()
                    getattr(stats, name)
                    shared[k] += time.perf_counter() - began
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    bits |= rule.rejects(stats).astype(np.int64) << k
                    own[k] += time.perf_counter() - began
                verdicts += bits.tolist()
        yield pa.RecordBatch.from_pydict({"own": pa.array([own], pa.list_(pa.float64())), "shared": pa.array([shared], pa.list_(pa.float64())), "verdicts": pa.array([verdicts], pa.list_(pa.int64()))})

    told = picked.select("text").mapInArrow(measure, "own array<double>, shared array<double>, verdicts array<long>").collect()
    own = [sum(r["own"][k] for r in told) for k in range(len(rules))]
    shared = {x: sum(r["shared"][k] for r in told) for k, x in enumerate(names)}
    verdicts = [v for r in told for v in r["verdicts"]]
    order = ordered(rules, own, shared, verdicts)
    report = [{"rule": rules[k].name, "seconds": own[k], "rejected": sum(v >> k & 1 for v in verdicts), "sampled": len(verdicts)} for k in order]
    return Cascade([rules[k] for k in order], report)


def judge(df: DataFrame, cascade: Cascade, id_col: str = "doc_id", text_col: str = "text", statistics: bool = False) -> DataFrame:
    """``id_col``, kept, failed_rule (the first of the cascade's order; null if kept); ``statistics`` adds all of
    ``STATISTICS``, which every document then pays for; the cascade takes them over, and computes what else its rules
    need for the texts that are still in play."""
    names = [r.name for r in cascade.rules]
    extra = STATISTICS if statistics else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                stats = Stats(data, offsets)
                for x in extra:  # of all texts, so the rules that look at nothing else cost next to nothing
                    getattr(stats, x)
                rule = cascade.rejected(stats)
                columns = [batch.column("id").slice(a, b - a), pa.array(rule < 0), pa.array([names[k] if k >= 0 else None for k in rule], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(getattr(stats, x).astype(np.int64)) for x in extra], ["id", "kept", "failed_rule", *extra])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([f"id {kind}", "kept boolean", "failed_rule string", *[f"{x} long" for x in extra]]))
    return out.withColumnRenamed("id", id_col)


def keep(df: DataFrame, cascade: Cascade, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that no rule rejects, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(text_col)):
                good = cascade.rejected(Stats(data, offsets)) < 0
                if good.any():
                    yield batch.slice(a, b - a).filter(pa.array(good))

    return df.mapInArrow(run, df.schema)
