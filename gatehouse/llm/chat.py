"""Chat formatting with tool-call linking, in DataFrame functions only.

Messages are rows (conversation, turn, role, text).  A message may carry tool calls, as a JSON object
``{"tool_calls": [{"id": ..., "name": ..., "arguments": {...}}], "content": ...}`` of an assistant, or the result of
one, as ``{"tool_call_id": ..., "content": ...}`` of the role ``tool``.  All other texts are content as they are.

1. Messages become events: a message's content, its calls in order, or a result.
2. Results are hash-joined to calls by conversation and identifier.  An identifier names the first call that has it, and
   the first result answers it; both are found by aggregates, so repeated identifiers combine before the shuffle.
3. Arguments are checked against the tools' schemas, which are JSON schemas of the keywords in ``KEYWORDS``, nested to
   any depth.
4. Events get their topological place (``at``, ``phase``, ``nth``): an event stands at its message's turn, and a
   result not before the call that it answers; within a turn content comes first, then calls, then results.
5. Each event is serialised as canonical JSON: keys sorted, no spaces, one spelling for each value.
6. ``in_order`` puts the events of whole conversations one behind the other, ready to be written as lines.

Conversations are never gathered in one task: ``in_order`` deals ranges of (conversation, place), so one with a third of
all rows is cut like any other, and sorts within a range spill.

``status`` says ``ok``, ``unanswered`` (a call without result), ``repeated_id`` (a call whose identifier an earlier one
has), ``invalid`` (a call with ``errors``), ``orphan`` (a result without call), ``repeated_result`` (a result for a call
that one of an earlier turn, or of smaller content in the same, answers).  Null texts are null content, text that is no
such JSON object is content, an empty list of calls is none (the message has the object's content), arguments that are
no JSON object are invalid.  Null conversations, turns and roles stay
null; they link nothing.  Repeated rows repeat their events.  The empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: JSON types of parameters and how ``schema_of_variant`` begins for them; a whole number in any spelling is an integer.
TYPES = {"string": "STRING", "number": "(BIGINT|DECIMAL|DOUBLE)", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}
KEYWORDS = ("type", "enum", "minimum", "maximum", "items", "minItems", "maxItems", "properties", "required", "additionalProperties", "description")
Tools = dict[str, dict]


def path(name: str) -> str:
    if "'" in name and '"' in name:
        raise ValueError(f"a parameter's name has one kind of quotes at most: {name}")
    return f"$[\"{name}\"]" if "'" in name else f"$['{name}']"


def said(where: Column | None, text: str, whole: str) -> Column:
    """A problem at a place; ``whole`` names the place where there is no other."""
    return F.concat(F.lit(whole) if where is None else where, F.lit(f": {text}"))


def of_type(value: Column, kind: str) -> Column:
    """Whether a variant is of a JSON type."""
    is_a = lambda kind: F.coalesce(F.schema_of_variant(value).rlike(f"^{kind}"), F.lit(False))
    if kind != "integer":
        return is_a(TYPES[kind])
    whole = F.to_json(value).rlike(r"^-?[0-9]+(\.0*)?$")  # a decimal's digits are all there
    return is_a("BIGINT") | (is_a("DECIMAL") & whole) | (is_a("DOUBLE") & F.coalesce(F.try_variant_get(value, "$", "double") % 1 == 0, F.lit(False)))


def problems(value: Column, schema: dict, where: Column | None = None, whole: str = "arguments") -> Column:
    """What of ``schema`` a variant violates, as an array of strings: first its own type and bounds, then its items or
    properties by name, then unknown properties."""
    if unknown := set(schema) - set(KEYWORDS):
        raise ValueError(f"a schema has the keywords {KEYWORDS}, not {sorted(unknown)}")
    none = F.array().cast("array<string>")
    holds = lambda c: F.coalesce(c, F.lit(False))
    of = lambda kind: of_type(value, kind)
    own, parts = [], []
    if "type" in schema:
        own.append(F.when(~of(schema["type"]), said(where, f"not {schema['type']}", whole)))
    if "enum" in schema:
        spelt = [json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in schema["enum"]]
        own.append(F.when(~holds(F.to_json(value).isin(spelt)), said(where, f"not one of {', '.join(spelt)}", whole)))
    number = F.try_variant_get(value, "$", "double")
    if "minimum" in schema:
        own.append(F.when(of("number") & (number < schema["minimum"]), said(where, f"below {schema['minimum']}", whole)))
    if "maximum" in schema:
        own.append(F.when(of("number") & (number > schema["maximum"]), said(where, f"above {schema['maximum']}", whole)))
    items = F.try_variant_get(value, "$", "array<variant>")
    if "minItems" in schema:
        own.append(F.when(of("array") & (F.size(items) < schema["minItems"]), said(where, f"under {schema['minItems']} items", whole)))
    if "maxItems" in schema:
        own.append(F.when(of("array") & (F.size(items) > schema["maxItems"]), said(where, f"over {schema['maxItems']} items", whole)))
    if "items" in schema:
        place = lambda i: F.concat(F.lit("") if where is None else where, F.lit("["), i.cast("string"), F.lit("]"))
        each = F.transform(items, lambda x, i: problems(x, schema["items"], place(i), whole))
        parts.append(F.when(of("array"), F.flatten(each)))
    if "properties" in schema or "required" in schema:
        inside = lambda name: F.lit(name) if where is None else F.concat(where, F.lit(f".{name}"))
        keys = F.coalesce(F.when(of("object"), F.json_object_keys(F.to_json(value))), none)
        properties, required = schema.get("properties", {}), schema.get("required", ())
        for name in sorted({*properties, *required}):
            has = F.array_contains(keys, name)
            if name in required:
                parts.append(F.when(of("object") & ~has, F.array(said(inside(name), "missing", whole))))
            if name in properties:
                parts.append(F.when(has, problems(F.try_variant_get(value, path(name), "variant"), properties[name], inside(name), whole)))
        if schema.get("additionalProperties") is False:
            more = F.array_sort(F.array_except(keys, F.array(*[F.lit(x) for x in sorted(properties)]).cast("array<string>")))
            parts.append(F.transform(more, lambda x: F.concat(x if where is None else F.concat(where, F.lit("."), x), F.lit(": unknown"))))
    return F.concat(F.array_compact(F.array(*own)) if own else none, *[F.coalesce(p, none) for p in parts])


def argument_errors(name: Column, arguments: Column, tools: Tools) -> Column:
    """What is wrong with a call; ``tools`` maps a tool to the schema of its arguments."""
    if not tools:
        return F.array().cast("array<string>")
    errors = F.when(F.lit(False), F.array().cast("array<string>"))
    for tool, schema in sorted(tools.items()):
        errors = errors.when(name == tool, problems(arguments, schema))
    return errors.otherwise(F.array(F.concat(F.lit("unknown tool: "), F.coalesce(name, F.lit("null")))))


def canonical(**fields: Column) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def link_tool_calls(df: DataFrame, tools: Tools | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each event: ``conv_col``, ``turn_col``, at, phase, nth, role, kind (message, call or result),
    call_id, status, errors, json."""
    messages = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    body = F.when(F.col("text").rlike(r"^\s*\{"), F.try_parse_json("text"))
    messages = messages.withColumn("body", body)
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("body", "$.tool_calls", "array<variant>"))
    answers = F.when(F.col("role") == "tool", F.try_variant_get("body", "$.tool_call_id", "string"))
    messages = messages.withColumns({"calls": calls, "answers": answers})
    # the content of a message with calls or a result is the object's own
    held = F.try_variant_get("body", "$.content", "variant")
    inside = F.coalesce(F.try_variant_get("body", "$.content", "string"), F.when(~F.is_variant_null(held), F.to_json(held)))
    messages = messages.withColumn("content", F.when(F.col("calls").isNotNull() | F.col("answers").isNotNull(), inside).otherwise(F.col("text")))
    null = F.lit(None)
    event = lambda kind, nth, call_id, name, arguments, content: F.struct(F.lit(kind).alias("kind"), nth.cast("int").alias("nth"), call_id.cast("string").alias("call_id"), name.cast("string").alias("name"), arguments.alias("arguments"), content.cast("string").alias("content"))
    no_json = F.try_parse_json(null.cast("string"))
    message = F.array(event("message", F.lit(0), null, null, no_json, F.col("content")))
    result = F.array(event("result", F.lit(0), F.col("answers"), null, no_json, F.col("content")))
    given = lambda c: F.coalesce(F.try_parse_json(F.try_variant_get(c, "$.arguments", "string")), F.try_variant_get(c, "$.arguments", "variant"))  # noqa: E731  objects, or objects spelt as strings
    made = F.transform("calls", lambda c, i: event("call", i, F.try_variant_get(c, "$.id", "string"), F.try_variant_get(c, "$.name", "string"), given(c), null))
    events = F.when(F.col("answers").isNotNull(), result).when(F.size("calls") > 0, F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.concat(message, made)).otherwise(made)).otherwise(message)
    events = messages.select("conv", "turn", "role", F.inline(events))

    own = F.struct("turn", "nth").alias("own")
    first = events.where("kind = 'call' AND conv IS NOT NULL AND call_id IS NOT NULL").groupBy("conv", "call_id").agg(F.min(own).alias("first")).select("conv", "call_id", F.col("first.turn").alias("call_turn"), F.col("first.nth").alias("call_nth"))
    answered = events.where("kind = 'result' AND conv IS NOT NULL").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    linked = first.join(answered, ["conv", "call_id"], "left")
    plain = events.where("kind = 'message'").withColumns({"call_turn": null.cast(events.schema["turn"].dataType), "call_nth": null.cast("int"), "answer": null.cast(linked.schema["answer"].dataType)})
    joined = events.where("kind != 'message'").join(linked, ["conv", "call_id"], "left").select(plain.columns).unionByName(plain)

    errors = F.when(F.col("kind") == "call", argument_errors(F.col("name"), F.col("arguments"), tools or {})).otherwise(F.array().cast("array<string>"))
    joined = joined.withColumn("errors", errors)
    status = (
        F.when((F.col("kind") == "result") & F.col("call_turn").isNull(), "orphan")
        .when((F.col("kind") == "result") & ~(F.col("turn").eqNullSafe(F.col("answer.turn")) & F.col("content").eqNullSafe(F.col("answer.content"))), "repeated_result")
        .when(F.col("kind") != "call", "ok")
        .when(F.col("call_turn").isNotNull() & ((F.col("turn") != F.col("call_turn")) | (F.col("nth") != F.col("call_nth"))), "repeated_id")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("answer").isNotNull(), "ok")
        .otherwise("unanswered")
    )
    role, call_id = F.col("role"), F.col("call_id")
    text = (
        F.when(F.col("kind") == "call", canonical(arguments=F.col("arguments"), id=call_id, name=F.col("name"), role=role))
        .when(F.col("kind") == "result", canonical(content=F.col("content"), id=call_id, role=role))
        .otherwise(canonical(content=F.col("content"), role=role))
    )
    phase = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "call", 1).otherwise(2)
    at = F.when(F.col("kind") == "result", F.greatest("turn", "call_turn")).otherwise(F.col("turn"))
    nth = F.when((F.col("kind") == "result"), F.coalesce("call_nth", "nth")).otherwise(F.col("nth"))
    return joined.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), at.alias("at"), phase.alias("phase"), nth.alias("nth"), "role", "kind", "call_id", status.alias("status"), "errors", text.alias("json"))


def in_order(events: DataFrame, conv_col: str = "conv_id", tasks: int | None = None) -> DataFrame:
    """The events of ``link_tool_calls``, each conversation's together in the order of their places."""
    place = [F.col(c) for c in (conv_col, "at", "phase", "nth", "turn", "json") if c in events.columns]
    dealt = events.repartitionByRange(tasks, *place) if tasks else events.repartitionByRange(*place)
    return dealt.sortWithinPartitions(*place)
