"""The queries of this subpackage for ``__spark_entry__``: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact, langid, negatives, packing, quality, quality_model, repair, sharding, simhash, substring, suffixes

#: Production parameters.
SHARDS = 24
TOOLS = {
    "search": {
        "type": "object",
        "required": ["query"],
        "additionalProperties": False,
        "properties": {
            "query": {"type": "string"},
            "limit": {"type": "integer", "minimum": 1, "maximum": 100},
            "filters": {"type": "array", "items": {"type": "object", "required": ["field"], "properties": {"field": {"enum": ["lang", "source"]}}}},
        },
    },
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}},
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rest = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3
    model = langid.fit(docs.where(F.coalesce(rest != 1, F.lit(False))))
    out = langid.identify(docs, model)
    return out.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = quality.judge(docs, quality.plan_cascade(docs), statistics=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *quality.STATISTICS, failed.alias("base_failed"), "kept")


def token_digest(one: bpe.ByteBPE, ids: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256 of each document of a batch."""
    data, edges = one.decode(ids, bounds)
    sha = lambda x, at: pa.array([hashlib.sha256(x[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
    return {"n_tokens": pa.array(np.diff(bounds)), "ids_sha256": sha(ids.astype("<u4"), bounds), "decoded_sha256": sha(data, edges)}


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, digest=(token_digest, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4
    model = quality_model.fit(docs, labels.where(rest != 2))
    return quality_model.classify(docs, model).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir), [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = ("ids_crc32", "long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), special=True, digest=crc)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.substring_dedup(documents(spark, sf_dir))
    spaces = r"[\x20\x09-\x0D]+"
    kept = F.regexp_replace(F.regexp_replace("text", f"^{spaces}|{spaces}$", ""), spaces, " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))


def tool_messages(conversations: DataFrame) -> DataFrame:
    """``conversations`` with calls and results, which these tables lack: every assistant's message gets one or two calls
    by the remainder of 7 conv_id + turn modulo 8, and a third of the others a result that answers none.

    0: the result stands a turn before the call; 1: no query, and two results; 2: a limit of a wrong type and a filter of a
    wrong field; 3: an unknown parameter and a limit out of range; 4: two calls; 5: an unknown tool; 6: the identifier of
    two turns before; 7: no result."""
    v, turn = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(8)), F.col("turn").cast("string")
    own = F.when(v == 6, F.concat(F.lit("c"), (F.col("turn") - 2).cast("string"))).otherwise(F.concat(F.lit("c"), turn))
    spelt = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    arguments = (
        F.when(v == 1, spelt('{"limit": 5}'))
        .when(v == 2, spelt('{"query": "turn ', turn, '", "limit": "many", "filters": [{"field": "lang"}, {"field": "age"}]}'))
        .when(v == 3, spelt('{"query": "turn ', turn, '", "limit": 500, "more": true}'))
        .when(v == 4, spelt('{"expression": "', turn, ' + 1"}'))
        .otherwise(spelt('{"query": "turn ', turn, '", "limit": 3}'))
    )
    call = lambda i, name, a: F.struct(i.alias("id"), name.alias("name"), a.alias("arguments"))
    name = F.when(v == 4, "calculate").when(v == 5, "launch").otherwise("search")
    second = call(F.concat(F.lit("d"), turn), F.lit("search"), spelt('{"query": "again"}'))
    calls = F.when(v == 4, F.array(call(own, name, arguments), second)).otherwise(F.array(call(own, name, arguments)))
    spoken = conversations.withColumn("text", F.when(F.col("role") == "assistant", F.to_json(F.struct(F.col("text").alias("content"), calls.alias("tool_calls")))).otherwise(F.col("text")))
    result = lambda at, i, content: F.struct(at.alias("turn"), F.lit("tool").alias("role"), F.to_json(F.struct(content.alias("content"), i.alias("tool_call_id"))).alias("text"))
    first = result(F.when(v == 0, F.col("turn") - 1).otherwise(F.col("turn")), own, spelt("result ", turn))
    results = F.when(v == 7, F.array()).when(v == 1, F.array(first, result(F.col("turn") + 1, own, spelt("late ", turn)))).when(v == 4, F.array(first, result(F.col("turn"), F.concat(F.lit("d"), turn), spelt("found")))).otherwise(F.array(first))
    lost = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0, F.array(result(F.col("turn"), F.lit("lost"), spelt("nothing")))).otherwise(F.array())
    more = conversations.select("conv_id", F.inline(F.when(F.col("role") == "assistant", results).otherwise(lost)))
    return spoken.select("conv_id", "turn", "role", "text").unionByName(more)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = chat.link_tool_calls(tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)
    return chat.in_order(events.withColumn("errors", F.array_join("errors", "; ")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", own)
    return negatives.hard_negatives(rows, anchor=F.col("id") % 100 == 0)


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by the CRC-32 of ``conv_id:turn`` modulo 20; alive is false for rows that are dropped."""
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(spelt("conv_id"), F.lit(":"), spelt("turn")), "UTF-8")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spelt("text"), "[.!?]", "")).otherwise(spelt("text"))
    role = F.when(fault == 4, "user").otherwise(spelt("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault != 0).alias("alive"), F.explode(F.sequence(F.lit(0), (fault == 3).cast("int"))).alias("copy"))
    return rows.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), alive="alive")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_suffix_array_dedup": op12_suffix_array_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)""",
    "op4_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
        g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
        t AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM g),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM t) WHERE n >= 2),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
        k AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
              FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        s AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                     coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
                     length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
              FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN k ON w.doc_id = k.doc_id)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
               CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines
                    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_upper > 6 * n_letters) AS kept
        FROM s""",
    "op9_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        t AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
        g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM t),
        p AS (SELECT DISTINCT doc_id, i + j AS i FROM g, range(0, 20) AS r(j) WHERE nth > 1),
        x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
        k AS (SELECT x.doc_id, count(*) AS n_words, count(p.i) AS n_removed,
                     sha256(coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE p.i IS NULL), '')) AS kept_sha256
              FROM x LEFT JOIN p ON x.doc_id = p.doc_id AND x.i = p.i GROUP BY x.doc_id)
        SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
        FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    # the calls and results of tool_messages, made and linked as relations
    "op10_chat_formatting": r"""
        WITH m AS (SELECT conv_id, turn, role, text, (conv_id * 7 + turn) % 8 AS v FROM conversations),
        a AS (SELECT * FROM m WHERE role = 'assistant'),
        c AS (SELECT conv_id, turn, 0 AS nth, v, CASE WHEN v = 6 THEN 'c' || (turn - 2) ELSE 'c' || turn END AS id,
                     CASE v WHEN 4 THEN 'calculate' WHEN 5 THEN 'launch' ELSE 'search' END AS name,
                     CASE v WHEN 1 THEN '{"limit":5}' WHEN 2 THEN '{"filters":[{"field":"lang"},{"field":"age"}],"limit":"many","query":"turn ' || turn || '"}'
                            WHEN 3 THEN '{"limit":500,"more":true,"query":"turn ' || turn || '"}' WHEN 4 THEN '{"expression":"' || turn || ' + 1"}'
                            ELSE '{"limit":3,"query":"turn ' || turn || '"}' END AS arguments,
                     CASE v WHEN 1 THEN 'query: missing' WHEN 2 THEN 'filters[1].field: not one of "lang", "source"; limit: not integer'
                            WHEN 3 THEN 'limit: above 100; more: unknown' WHEN 5 THEN 'unknown tool: launch' ELSE '' END AS errors FROM a
              UNION ALL SELECT conv_id, turn, 1, v, 'd' || turn, 'search', '{"query":"again"}', '' FROM a WHERE v = 4),
        r AS (SELECT conv_id, CASE WHEN v = 0 THEN turn - 1 ELSE turn END AS turn, CASE WHEN v = 6 THEN 'c' || (turn - 2) ELSE 'c' || turn END AS id, 'result ' || turn AS content FROM a WHERE v <> 7
              UNION ALL SELECT conv_id, turn + 1, 'c' || turn, 'late ' || turn FROM a WHERE v = 1
              UNION ALL SELECT conv_id, turn, 'd' || turn, 'found' FROM a WHERE v = 4
              UNION ALL SELECT conv_id, turn, 'lost', 'nothing' FROM m WHERE role <> 'assistant' AND (conv_id + turn) % 3 = 0),
        fc AS (SELECT conv_id, id, min(turn * 2 + nth) AS place FROM c GROUP BY conv_id, id),
        fr AS (SELECT conv_id, id, min((turn, content)) AS answer FROM r GROUP BY conv_id, id),
        e AS (SELECT conv_id, turn, turn AS "at", 0 AS phase, 0 AS nth, role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, 'ok' AS status, '' AS errors,
                     '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
              FROM m WHERE role IS DISTINCT FROM 'assistant' OR coalesce(text, '') <> ''
              UNION ALL SELECT c.conv_id, turn, turn, 1, nth, 'assistant', 'call', c.id,
                     CASE WHEN turn * 2 + nth <> place THEN 'repeated_id' WHEN errors <> '' THEN 'invalid' WHEN answer IS NULL THEN 'unanswered' ELSE 'ok' END, errors,
                     '{"arguments":' || arguments || ',"id":"' || c.id || '","name":"' || name || '","role":"assistant"}'
              FROM c JOIN fc ON c.conv_id = fc.conv_id AND c.id = fc.id LEFT JOIN fr ON c.conv_id = fr.conv_id AND c.id = fr.id
              UNION ALL SELECT r.conv_id, turn, greatest(turn, place // 2), 2, coalesce(place % 2, 0), 'tool', 'result', r.id,
                     CASE WHEN place IS NULL THEN 'orphan' WHEN (turn, content) <> answer THEN 'repeated_result' ELSE 'ok' END, '',
                     '{"content":"' || content || '","id":"' || r.id || '","role":"tool"}'
              FROM r LEFT JOIN fc ON r.conv_id = fc.conv_id AND r.id = fc.id JOIN fr ON r.conv_id = fr.conv_id AND r.id = fr.id)
        SELECT conv_id, turn, e."at", CAST(phase AS INT) AS phase, CAST(nth AS INT) AS nth, role, kind, call_id, status, errors, json FROM e""",
    # bytes as pairs of hexadecimal digits; removed windows that touch are one span
    "op12_suffix_array_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        c AS (SELECT r, doc_id, head, substr(x, 2 * head + 1, 498) AS x FROM (SELECT *, unnest(range(0, length(x) // 2 - 49, 200)) AS head FROM d WHERE length(x) >= 100)),
        w AS (SELECT r, doc_id, head + i AS i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(length(x) // 2 - 49)) AS i FROM c)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        e AS (SELECT r, i, CAST(coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 50, true) AS INT) AS fresh FROM w JOIN f ON w.s = f.s WHERE doc_id > first),
        s AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM e),
        p AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY r, span),
        k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS behind FROM p),
        t AS (SELECT k.r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * behind + 1, 2 * (a - behind)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
              FROM k JOIN d ON k.r = d.r GROUP BY k.r)
        SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
        FROM d LEFT JOIN t ON d.r = t.r""",
    "op11_hard_negatives": r"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS other, b.vec_id AS other_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
              FROM v AS a JOIN v AS b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5)
        SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 100 * s.score BETWEEN 80 * p.score AND 100 * p.score
        WINDOW w AS (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other_id, s.other) QUALIFY rank <= 5""",
    # the CRC-32 by its table; then a layer of states for each message, with whole audits and texts
    "op13_conversation_repair": r"""
        WITH RECURSIVE tab AS (SELECT list(e ORDER BY i) AS tab FROM (
            SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e FROM range(256) AS r(i))),
        k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        v AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                     lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS v FROM k, tab),
        d AS (SELECT conv_id, turn, CASE WHEN v = 4 THEN 'user' ELSE role END AS role,
                     CASE v WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM v, range(2) AS r(copy) WHERE v <> 0 AND (copy = 0 OR v = 3)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
                     regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said FROM d),
        f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                             WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                     left(role, 1) AS a, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM o),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                     count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (b IS NOT NULL AND a || b NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
        -- from a state (0 nothing, 1 system, 2 user, 3 assistant last): insertions, the state that they lead to and the next role
        m(state, ins, here, lines, next, name) AS (VALUES
            (0, '', 0, '', 2, 'user'), (0, 'I', 2, chr(10) || 'user:', 3, 'assistant'), (0, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:', 2, 'user'),
            (1, '', 1, '', 2, 'user'), (1, 'I', 2, chr(10) || 'user:', 3, 'assistant'), (1, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:', 2, 'user'),
            (2, '', 2, '', 3, 'assistant'), (2, 'I', 3, chr(10) || 'assistant:', 2, 'user'), (2, 'II', 2, chr(10) || 'assistant:' || chr(10) || 'user:', 3, 'assistant'),
            (3, '', 3, '', 2, 'user'), (3, 'I', 2, chr(10) || 'user:', 3, 'assistant'), (3, 'II', 3, chr(10) || 'user:' || chr(10) || 'assistant:', 2, 'user')),
        e(letter) AS (VALUES ('D'), ('K'), ('R')),
        dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM c
               UNION ALL
               SELECT conv_id, i, state, best.cost, best.audit, best.lines FROM (
                   SELECT dp.conv_id, f.i, CASE letter WHEN 'D' THEN here WHEN 'R' THEN next ELSE CASE a WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
                          min({'cost': dp.cost + 2 * length(ins) + CASE letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END,
                               'audit': dp.audit || ins || letter,
                               'lines': dp.lines || m.lines || CASE letter WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || name || ':' || text ELSE chr(10) || role || ':' || text END}) AS best
                   FROM dp JOIN f ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = dp.i + 1 JOIN m ON dp.state = m.state JOIN e ON true
                   WHERE letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR here = 0 AND a = 's' OR here <> 2 AND a = 'u' OR here = 2 AND a = 'a')
                   GROUP BY 1, 2, 3)),
        z AS (SELECT dp.conv_id, min({'cost': dp.cost + 2 * length(ins), 'audit': dp.audit || ins, 'lines': dp.lines || m.lines}) AS best
              FROM dp JOIN c ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = c.n JOIN m ON dp.state = m.state WHERE here = 3 OR here = 0 GROUP BY dp.conv_id)
        SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.lines, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS k LEFT JOIN c ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON k.conv_id IS NOT DISTINCT FROM z.conv_id""",
}
