import json

from gatehouse.llm import chat

TOOLS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
    "sum": {"type": "object", "required": ["values"], "properties": {"values": {"type": "array"}, "exact": {"type": "boolean"}, "scale": {"type": "number"}, "o'p": {"type": "object"}}},
    "deep": {
        "type": "object",
        "properties": {
            "mode": {"enum": ["fast", "slow", 3]},
            "share": {"type": "number", "minimum": 0, "maximum": 1},
            "list": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer"}, "y": {"type": "array", "items": {"type": "string"}}}}},
        },
    },
}


def call(*calls, content=None):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments"), c, strict=True)) for c in calls], "content": content})


ROWS = [
    (1, 0, "user", "find é \"x\"\n/ and add"),
    (1, 1, "assistant", call(("a", "search", {"query": "x", "limit": 3}), ("b", "sum", '{"values": [1, 2], "scale": 0.5}'), content="on it")),
    (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [True, None]}})),
    (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "found"})),
    (1, 4, "tool", json.dumps({"tool_call_id": "zzz", "content": "lost"})),
    (2, 0, "tool", json.dumps({"tool_call_id": "late", "content": "early"})),
    (2, 1, "assistant", call(("late", "search", {"query": "y"}))),
    (2, 2, "assistant", call(("late", "search", {"query": "again"}))),
    (3, 0, "assistant", call(("c", "search", {"limit": "many", "more": 1}), ("d", "nothing", {}), ("e", "sum", [1]), ("f", "sum", {"values": 5, "o'p": {}}), ("g", "search", {"query": "q"}))),
    (4, 0, "user", None),
    (4, 1, None, "{not json"),
    (4, 2, "user", '{"tool_calls": 1}'),
    (None, 0, "tool", json.dumps({"tool_call_id": "a", "content": "x"})),
    (5, 0, "assistant", call(("a", "search", {"query": "other conversation"}))),
    (5, None, "assistant", ""),
    (5, 1, "assistant", '{"tool_calls": []}'),
    (5, 2, "assistant", '{"tool_calls": [], "content": "no call"}'),
]


def test_linking(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, kind string, conv int")
    got = chat.link_tool_calls(df, TOOLS).collect()
    by = {(r.conv_id, r.turn, r.kind, r.call_id): r for r in got}
    assert by[1, 1, "message", None].json == '{"content":"on it","role":"assistant"}'
    assert by[1, 1, "call", "a"].json == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","role":"assistant"}'
    assert by[1, 1, "call", "b"].json == '{"arguments":{"scale":0.5,"values":[1,2]},"id":"b","name":"sum","role":"assistant"}'
    assert json.loads(json.loads(by[1, 2, "result", "b"].json)["content"]) == {"a": [True, None], "z": 1}
    assert [by[1, 1, "call", x].status for x in "ab"] == ["ok", "ok"] and by[1, 4, "result", "zzz"].status == "orphan"
    one = sorted((r.at, r.phase, r.nth, r.kind, r.call_id) for r in got if r.conv_id == 1)
    assert [x[3:] for x in one] == [("message", None), ("message", None), ("call", "a"), ("call", "b"), ("result", "b"), ("result", "a"), ("result", "zzz")]
    two = sorted((r.at, r.phase, r.nth, r.kind, r.status) for r in got if r.conv_id == 2)
    assert [x[3:] for x in two] == [("call", "ok"), ("result", "ok"), ("call", "repeated_id")]
    errors = {r.call_id: (r.status, r.errors) for r in got if r.conv_id == 3}
    assert errors["c"] == ("invalid", ["limit: not integer", "query: missing", "more: unknown"])
    assert errors["d"] == ("invalid", ["unknown tool: nothing"])
    assert errors["e"] == ("invalid", ["arguments: not object"])
    assert errors["f"] == ("invalid", ["values: not array"])
    assert errors["g"] == ("unanswered", [])
    assert by[4, 0, "message", None].json == '{"content":null,"role":"user"}'
    assert by[4, 1, "message", None].json == '{"content":"{not json","role":null}'
    assert by[4, 2, "message", None].json == '{"content":"{\\"tool_calls\\": 1}","role":"user"}'
    assert by[None, 0, "result", "a"].status == "orphan" and by[5, 0, "call", "a"].status == "unanswered"
    assert by[1, 0, "message", None].json == json.dumps({"content": ROWS[0][3], "role": "user"}, ensure_ascii=False, separators=(",", ":"))
    for r in got:
        assert r.json == json.dumps(json.loads(r.json), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    assert by[5, 1, "message", None].json == '{"content":null,"role":"assistant"}'
    assert by[5, 2, "message", None].json == '{"content":"no call","role":"assistant"}'
    assert {(r[0], r[1]) for r in ROWS} == {(r.conv_id, r.turn) for r in got}


def test_integers_in_any_spelling(spark):
    spelt = ["1", "1.0", "1e0", "-0.0", "100000000000000000000", "1e25", "12345678901234567890.0", "1.5", "1e-1", "100000000000000000000.5", '"1"', "true", "null"]
    rows = [(1, k, "assistant", '{"tool_calls": [{"id": "%d", "name": "search", "arguments": {"query": "q", "limit": %s}}]}' % (k, x)) for k, x in enumerate(spelt)]
    got = {r.turn: r.errors for r in chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    assert [got[k] for k in range(len(spelt))] == [[]] * 7 + [["limit: not integer"]] * 6


def test_nested_schemas(spark):
    good = {"mode": 3, "share": 0.5, "list": [{"x": 1}, {"x": 2, "y": []}]}
    bad = {"mode": "quick", "share": 1.5, "list": [{"x": "1"}, {"y": ["a", 2], "z": None}, 5, {"x": 1}]}
    rows = [(1, k, "assistant", call((f"i{k}", "deep", a))) for k, a in enumerate([good, bad, {"list": []}, {"share": None, "list": {}}])]
    got = {r.call_id: r.errors for r in chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()}
    assert got["i0"] == []
    assert got["i1"] == ["list: over 3 items", "list[0].x: not integer", "list[1].x: missing", "list[1].y[1]: not string", "list[1].z: unknown", "list[2]: not object", 'mode: not one of "fast", "slow", 3', "share: above 1"]
    assert got["i2"] == ["list: under 1 items"]
    assert got["i3"] == ["list: not array", "share: not number"]


def test_a_second_result_is_told(spark):
    rows = [(1, 0, "assistant", call(("a", "search", {"query": "q"})))] + [(1, t, "tool", json.dumps({"tool_call_id": "a", "content": c})) for t, c in ((3, "late"), (1, "b"), (1, "a"), (1, "a"))]
    got = chat.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS).collect()
    assert sorted((r.turn, json.loads(r.json)["content"], r.status) for r in got if r.kind == "result") == [(1, "a", "ok"), (1, "a", "ok"), (1, "b", "repeated_result"), (3, "late", "repeated_result")]


def test_conversations_in_order(spark):
    df = spark.createDataFrame(ROWS * 3, "conv_id long, turn long, role string, text string").repartition(5)
    got = [(r.conv_id, r.at, r.phase, r.nth) for r in chat.in_order(chat.link_tool_calls(df, TOOLS), tasks=4).collect()]
    first = lambda x: [(y is not None, y or 0) for y in x]
    assert got == sorted(got, key=first) and len({r[0] for r in got}) == 6


def test_empty(spark):
    assert chat.link_tool_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), TOOLS).collect() == []
