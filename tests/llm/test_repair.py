import hashlib
import itertools
import random

import numpy as np
import pytest

from gatehouse.llm import repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, alive boolean, conv int, place string, kind int"


def shaped(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or len(rest) > 0 and rest == "ua" * (len(rest) // 2)


def faults(messages):
    seen, out = set(), []
    for role, text in messages:
        said = text.rstrip(SPACE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_way(messages, more=3):
    """Each (cost, audit, repaired) by trying all edits, with up to ``more`` insertions in all."""
    told = faults(messages)
    options = []
    for (role, text), fault in zip(messages, told, strict=True):
        one = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            late = int(fault == "truncated")
            one += [(late, "K", [(role, text)]), (2 + late, "R", [("user", text)]), (2 + late, "R", [("assistant", text)])]
        options.append(one)
    for picks in itertools.product(*options):
        for count in range(more + 1):
            for gaps in itertools.combinations_with_replacement(range(len(messages) + 1), count):
                for names in itertools.product(("user", "assistant"), repeat=count):
                    cost, audit, out = 2 * count, "", []
                    for k in range(len(messages) + 1):
                        for gap, name in zip(gaps, names, strict=True):
                            if gap == k:
                                audit, out = audit + "I", [*out, (name, "")]
                        if k < len(messages):
                            cost, audit, out = cost + picks[k][0], audit + picks[k][1], out + picks[k][2]
                    if shaped("".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r, _ in out)):
                        yield cost, audit, out


def plain(messages):
    """The same by layers with whole audits and texts; single insertions, as many as one likes."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    given = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    layer = {"": (0, "", [])}

    def put(into, state, item):
        if state not in into or item[:2] < into[state][:2]:
            into[state] = item

    def inserted(layer):
        layer = dict(layer)
        for _ in range(4):
            for state, (cost, audit, out) in list(layer.items()):
                put(layer, given[state][0], (cost + 2, audit + "I", [*out, (given[state], "")]))
        return layer

    for (role, text), fault in zip(messages, faults(messages), strict=True):
        after, late = {}, int(fault == "truncated")
        # of one state both an audit and one that goes on with I may count, so all ways of inserting are kept apart
        ways = [(state, item) for state, item in layer.items()]
        for state, (cost, audit, out) in list(ways):
            for _ in range(3):
                cost, audit, out, state = cost + 2, audit + "I", [*out, (given[state], "")], given[state][0]
                ways.append((state, (cost, audit, out)))
        for state, (cost, audit, out) in ways:
            put(after, state, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                put(after, given[state][0], (cost + 2 + late, audit + "R", [*out, (given[state], text)]))
                if (state, role[:1]) in step:
                    put(after, step[state, role[:1]], (cost + late, audit + "K", [*out, (role, text)]))
        layer = after
    ends = [(item, state) for state, item in layer.items()] + [(item, state) for state, item in inserted(layer).items()]
    return min((item[:2] + (item[2],) for item, state in ends if state == "a" or not item[2]), key=lambda x: x[:2])


def expected(rows):
    """{conv: result} of rows (conv, turn, role, text, alive)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, alive in rows if c == conv and alive]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        messages = [r[1:] for r in mine]
        told, turns = faults(messages), [t for t, *_ in mine if t is not None]
        roles = [r[:1] for r, _ in messages]
        cost, audit, done = plain(messages) if messages else (0, "", [])
        text = "\n".join(f"{r}:{x}" for r, x in done)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(told.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def made(seed, convs, longest, roles=("user", "assistant", "system", "tool", "", None)):
    r = random.Random(seed)
    texts = ["yes.", "no!", "what", "", " \t", "so?  \n", None, "é.", "tail \x1f"] + [f"line {k}{e}" for k in range(6) for e in ".?,"]
    out = []
    for c in range(convs):
        for t in range(r.randint(0, longest)):
            role = ("user", "assistant")[t % 2] if r.random() < 0.7 else r.choice(roles)
            out.append((c, None if r.random() < 0.05 else t + r.choice([0, 0, 0, 2]), role, r.choice(texts) if r.random() < 0.5 else f"said {c} {t}.", r.random() < 0.9))
    return out


def result(spark, rows, **named):
    df = spark.createDataFrame([(*r, 7, "x", 9) for r in rows], SCHEMA).repartition(3)
    return {r[0]: tuple(r)[1:] for r in repair.repair(df, alive="alive", **named).collect()}


def test_plain_version_against_every_way():
    r = random.Random(2)
    for _ in range(60):
        messages = [(r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b!", "c", "", "d."])) for _ in range(r.randint(1, 3))]
        cost, audit, out = min(every_way(messages), key=lambda x: x[:2])
        assert plain(messages) == (cost, audit, out), messages


def test_layers_against_the_plain_version():
    r = random.Random(4)
    for _ in range(300):
        messages = [(r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b!", "c", "", f"{r.random()}."])) for _ in range(r.randint(1, 9))]
        kind = repair.CLASS[np.array([["", "blank", "duplicate", "truncated"].index(f) for f in faults(messages)])]
        layers = repair.Layers(np.array([len(messages)]), repair.letters([m for m, _ in messages]), kind, np.array([0]))
        cost, end, more = repair.close(layers.cost[:, 0], layers.rank[:, 0])
        state, code = layers.back(np.array([0]), end)
        turns = [*repair.written(*zip(*messages, strict=True), state.tolist(), code.tolist(), int(end[0]), int(more[0]))]
        assert (int(cost[0]), "".join(e for e, *_ in turns), [t[1:] for t in turns if t[0] != "D"]) == plain(messages), messages


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_conversations_match_the_plain_version(spark, monkeypatch, segment):
    """Whole, and cut in segments of one and of three messages."""
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    monkeypatch.setattr(repair, "TOGETHER_ROWS", 40)
    rows = made(1, 60, 9) + made(2, 1, 120) + [(500, k, "user", "a.", False) for k in range(4)] + [(None, 0, "user", "x.", True), (None, 1, None, "y", True), (None, None, "system", None, True)]
    assert result(spark, rows) == expected(rows)


def test_a_conversation_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_BYTES", 200)
    rows = made(3, 40, 12) + [(1000, t, ("user", "assistant")[t % 2] if t % 11 else "tool", f"text {t % 50}.", t % 9 > 0) for t in range(300)]
    assert result(spark, rows) == expected(rows)


def test_edits_in_order_give_the_audit_and_the_repaired_messages(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 5)
    rows = made(6, 30, 14)
    df = spark.createDataFrame([(*r, 7, "x", 9) for r in rows], SCHEMA)
    want, turns = expected(rows), {}
    for r in sorted(repair.repair(df, alive="alive", turns=True).collect(), key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    for conv, (*_, audit, sha) in want.items():
        mine = turns.get(conv, [])
        assert "".join(e for e, *_ in mine) == audit
        assert hashlib.sha256("\n".join(f"{r}:{x}" for e, r, x in mine if e != "D").encode()).hexdigest() == sha


def test_rows_that_repeat_and_the_empty_table(spark):
    rows = [(1, 0, "user", "a.", True), (1, 0, "user", "a.", True), (1, 0, "user", "a.", True), (1, 1, "assistant", "b.", True)]
    assert result(spark, rows)[1][:7] == (0, 0, 2, 0, 2, 6, "KDDK")
    assert result(spark, []) == {}
