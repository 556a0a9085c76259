import re

import numpy as np
import pyarrow as pa
from common import frame, rows, words

from gatehouse.llm import quality
from gatehouse.llm._text import chunks


def brute(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 2000 else None
    lines = [x for x in text.split("\n") if words(x)]
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))
    dup = len(lines) - len(set(lines))
    if twice is None:
        seen = {}
        for i, g in enumerate(grams):
            seen.setdefault(g, []).append(i)
        twice = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    bad = len(w) < 50 or 100 * len(twice) > 50 * len(w) or 10 * symbols > len(w) or (dup >= 3 and 10 * dup > 3 * len(lines)) or chars < 2 * len(w) or chars > 15 * len(w) or 10 * upper > 6 * letters
    return len(w), chars, symbols, dup, len(twice), not bad


CASES = [*rows(), (50, ("a line of text here\n" * 30)), (51, "x" * 3000), (52, "* " * 200), (53, "LOUD WORDS ARE HERE NOW " * 20), (54, "\n\n a\n\n a\nb\n")]


def test_statistics_and_verdict_match_brute_force(spark):
    df = frame(spark, CASES)
    got = quality.judge(df, quality.plan_cascade(df), statistics=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.kept) for r in got), key=repr) == sorted(((k, *brute(t)) for k, t in CASES), key=repr)
    assert all((r.failed_rule is None) == r.kept for r in got)


def test_order_of_rules_changes_no_verdict(spark):
    df = frame(spark, CASES)
    one, two = (sorted(((r.doc_id, r.kept) for r in quality.judge(df, quality.Cascade(list(rules))).collect()), key=repr) for rules in (quality.RULES, quality.RULES[::-1]))
    assert one == two


def test_cascade_puts_cheap_and_rejecting_rules_first(spark):
    """A shared statistic is charged once, and only texts still in play count as rejections."""
    rule = lambda name, *needs: quality.Rule(name, None, needs)
    rules = (rule("a", "words"), rule("b"), rule("c", "words"), rule("d", "words", "hashes"))
    verdicts = [0b0001] * 10 + [0b0101] * 10 + [0b0010] * 4 + [0b1000] * 3 + [0] * 20
    # b: 4 in 1 s; a: 20 in 1 + 5 s; then c rejects nothing that a has left, d 3 in 9 s
    assert quality.ordered(rules, [1, 1, 0.1, 1], {"words": 5, "hashes": 8}, verdicts) == [1, 0, 3, 2]
    assert quality.ordered(rules, [1, 1, 0.1, 1], {"words": 0.5, "hashes": 8}, verdicts) == [2, 0, 1, 3]
    plan = quality.plan_cascade(frame(spark, CASES))
    assert sorted(x["rule"] for x in plan.report) == sorted(r.name for r in quality.RULES)
    assert all(x["sampled"] == len(CASES) for x in plan.report)


def test_statistics_leave_the_short_circuit(spark):
    """Rules see only texts that are still in play, and what is no output is computed for these alone."""
    seen = []

    def late(stats):
        seen.append((stats.n, "n_upper" in stats.__dict__))
        return 10 * stats.n_upper > 6 * stats.n_letters

    data, offsets = next((d, o) for _, _, d, o in chunks(pa.array([t for _, t in CASES])))
    stats = quality.Stats(data, offsets)
    for x in quality.STATISTICS:
        getattr(stats, x)
    cascade = quality.Cascade([*quality.RULES[:5], quality.Rule("late", late)])
    rule = cascade.rejected(stats)
    left = int((rule < 0).sum() + (rule == 5).sum())
    assert 0 < left < len(CASES) and len(seen) == 1 and left <= seen[0][0] < len(CASES) and not seen[0][1]
    assert "n_upper" not in stats.__dict__
    whole = quality.Cascade(list(quality.RULES)).rejected(quality.Stats(data, offsets), 1.0)
    assert ((rule < 0) == (whole < 0)).all()


def test_a_smaller_batch_keeps_what_was_computed():
    data, offsets = next((d, o) for _, _, d, o in chunks(pa.array([t for _, t in CASES])))
    whole = quality.Stats(data, offsets)
    good = np.arange(whole.n) % 3 != 1
    for names in ((), ("hashes", "_lines", "n_words"), (*quality.PER_TEXT,)):
        some = quality.Stats(data, offsets)
        for name in names:
            getattr(some, name)
        part = some.take(good)
        assert all((getattr(part, x) == getattr(whole, x)[good]).all() for x in quality.PER_TEXT)
        assert (part.hashes == whole.hashes[good[whole.words.doc]]).all()
        again = part.take(np.arange(part.n) % 2 == 0)
        assert (again.n_repeat_words == whole.n_repeat_words[good][::2]).all()


def test_empty(spark):
    df = frame(spark, [])
    assert quality.judge(df, quality.plan_cascade(df)).collect() == []
