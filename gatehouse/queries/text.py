"""Text normalisers, cards, parsers, JSON, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as T
from ..operators import metrics
from ..views import HYBRID_SQL, hybrid, table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()
DOCS_SQL = "d AS (SELECT doc_id, text, lang, source FROM documents)"
NORM_SQL = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'))"
WS_SQL = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{85}}\x{{a0}}\x0b\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("""WITH v AS (SELECT 'lang' AS field, coalesce(nullif(lang, ''), 'unknown') AS value FROM documents UNION ALL SELECT 'source', coalesce(nullif(source, ''), 'unknown') FROM documents),
c AS (SELECT field, value, count(*) AS n FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS nth FROM c) SELECT field, value, n FROM r WHERE nth <= 5""")
def manifest_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.value_counts(docs(spark, sf_dir), ["lang", "source"], 5)


@query("""SELECT count(*) AS n, count(nullif(text, '')) AS text, count(nullif(lang, '')) AS lang, count(nullif(source, '')) AS source, count(l.quality) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def manifest_field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.agg(F.count(F.lit(1)).alias("n"), *[F.count(T.non_blank(c)).alias(c) for c in ("text", "lang", "source")], F.count("quality").alias("quality"))


@query(rf"""WITH w AS (SELECT lang, CASE WHEN {WS_SQL.format('text')} = '' THEN 0 ELSE len(string_split({WS_SQL.format('text')}, ' ')) END AS n FROM documents)
SELECT lang, CAST(min(n) AS BIGINT) AS low, CAST(max(n) AS BIGINT) AS high, round(avg(n), 6) AS mean FROM w GROUP BY lang""")
def manifest_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = docs(spark, sf_dir).select("lang", T.word_count("text").alias("n"))
    return w.groupBy("lang").agg(F.min("n").alias("low"), F.max("n").alias("high"), metrics.mean(F.col("n")).alias("mean"))


@query(rf"SELECT doc_id, md5({NORM_SQL.format('text')}) AS digest, length({NORM_SQL.format('text')}) AS n FROM documents")
def normalize_match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalize_match_text("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).cast("long").alias("n"))


@query(r"""WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents), f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE key <> '' GROUP BY key)
SELECT k.doc_id, f.first_id FROM k LEFT JOIN f ON k.key = f.key""")
def normalize_question_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join on the normalised text with an index that keeps the first of each key; the key travels as a hash."""
    k = docs(spark, sf_dir).select("doc_id", T.normalize_question("text").alias("t")).select("doc_id", F.sha2(F.nullif("t", F.lit("")).cast("binary"), 256).alias("key"))
    index = k.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    return k.join(index, "key", "left").select("doc_id", "first_id")


@query(rf"""SELECT doc_id, coalesce(nullif({WS_SQL.format(r"regexp_extract(card, '(?is)answer\s*:\s*(.*?)(?:\n|$)', 1)")}, ''), {WS_SQL.format('card')}) AS answer FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Card' || chr(10) || 'Answer: ' || replace(text, chr(10), ' ') || chr(10) || 'end' END AS card FROM documents)""")
def extract_card_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Card\nAnswer: "), F.translate("text", "\n", " "), F.lit("\nend")))
    return docs(spark, sf_dir).select("doc_id", card.alias("card")).select("doc_id", P.card_answer("card").alias("answer"))


@query("""SELECT item_id, (['alpha', 'bravo', 'charlie', 'delta'])[item_id % 4 + 1] || ' ' || item_id AS answer FROM benchmark""")
def expand_option_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An option letter looked up in the options of the question's text; a repeated letter has its last text."""
    letter = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("item_id") % 4 + 1).cast("int"))
    options = F.concat(F.lit("Pick. A. old A. alpha "), "item_id", F.lit("  B. bravo "), "item_id", F.lit(" C) charlie "), "item_id", F.lit("\nD: delta "), "item_id")
    b = table(spark, sf_dir, "benchmark").select("item_id", letter.alias("letter"), P.option_map(options).alias("options"))
    return b.select("item_id", F.element_at("options", F.col("letter")).alias("answer"))


@query(f"""WITH {HYBRID_SQL} SELECT DISTINCT target, regexp_replace(regexp_replace(lower(target || ' !Card'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, coalesce(nullif(regexp_replace('!!', '[^a-z0-9]+', '', 'g'), ''), 'empty') AS blank FROM h""")
def slugify_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("target").distinct().select("target", T.slugify(F.concat("target", F.lit(" !Card"))).alias("slug"), T.slugify(F.lit("!!")).alias("blank"))


@query(f"WITH {HYBRID_SQL} SELECT split_part(target, '_', 1) AS family, count(*) AS n, count(DISTINCT target) AS labels FROM h GROUP BY 1")
def label_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).groupBy(T.label_family("target").alias("family")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target").alias("labels"))


CARDS_SQL = r"""c AS (SELECT lang AS domain, source AS label, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1, 2),
m AS (SELECT label, domain FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, domain) AS nth FROM c) WHERE nth = 1),
e AS (SELECT source AS label, string_agg('Positive example: ' || doc_id || '.', ' ' ORDER BY doc_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 2 GROUP BY 1),
o AS (SELECT a.label, string_agg(b.label, ', ' ORDER BY b.label) AS others FROM m a JOIN (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY label) AS nth FROM m) b ON a.domain = b.domain AND a.label <> b.label AND b.nth <= 4 GROUP BY 1)"""


def cards(spark: SparkSession, sf_dir: str, style: str) -> DataFrame:
    """A card for each source as a tool: modal domain, first two examples, up to four tools of the same domain."""
    d = docs(spark, sf_dir).select(F.col("source").alias("label"), F.col("lang").alias("domain"), "doc_id")
    n = d.groupBy("label", "domain").agg(F.count(F.lit(1)).alias("n"))
    modal = n.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), "domain")).alias("m")).select("label", F.col("m.domain").alias("domain"))
    first = d.groupBy("label").agg(F.min("doc_id").alias("a"))
    second = d.join(F.broadcast(first), "label").where("doc_id > a").groupBy("label", "a").agg(F.min("doc_id").alias("b"))
    examples = first.join(second.select("label", "b"), "label", "left").select("label", F.array_compact(F.array(F.col("a").cast("string"), F.col("b").cast("string"))).alias("examples"))
    peers = modal.groupBy("domain").agg(F.slice(F.array_sort(F.collect_list("label")), 1, 4).alias("peers"))  # labels: few
    out = modal.join(examples, "label").join(peers, "domain").withColumn("others", F.array_except("peers", F.array("label")))
    return out.select("label", T.tool_card(F.col("label"), F.lit("intent"), F.col("domain"), F.col("examples"), F.col("others"), style).alias("card"))


@query(f"WITH {CARDS_SQL} SELECT m.label, 'Tool schema card for spoken command routing. Tool name: ' || m.label || '. Task type: intent. Domain: ' || translate(m.domain, '_', ' ') || '. Use this tool when the user command asks for: ' || translate(m.label, '_-', '  ') || '.' AS card FROM m")
def tool_cards_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir, "tool_schema_card")


@query(f"WITH {CARDS_SQL} SELECT m.label, 'Tool schema card for spoken command routing. Tool name: ' || m.label || '. Task type: intent. Domain: ' || translate(m.domain, '_', ' ') || '. Use this tool when the user command asks for: ' || translate(m.label, '_-', '  ') || '.' || ' ' || examples || ' Boundary note: do not choose this tool for nearby tools or intents: ' || coalesce(others, 'none') || '.' AS card FROM m JOIN e ON m.label = e.label LEFT JOIN o ON m.label = o.label")
def tool_cards_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir, "contrastive_boundary_tool")


@query(r"""WITH s AS (SELECT doc_id, trim(text) AS t, lower(regexp_extract(text, '\S+\s*$')) AS wanted FROM documents), p AS (SELECT doc_id, wanted, t, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS parts FROM (SELECT doc_id, t, regexp_replace(wanted, '\s+$', '') AS wanted FROM s))
SELECT doc_id, left(coalesce((list_filter(parts, lambda x: wanted <> '' AND contains(lower(x), wanted)))[1], parts[1], t, ''), 80) AS evidence FROM p""")
def sentence_evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence with the text's last word, cut to 80 characters."""
    last = F.reverse(F.regexp_extract(F.reverse("text"), r"^\s*(\S+)", 1))  # from the end: one step, however long the text
    return docs(spark, sf_dir).select("doc_id", T.choose_evidence("text", last, 80).alias("evidence"))


@query(rf"""WITH w AS (SELECT item_id, text, string_split({WS_SQL.format('text')}, ' ') AS w FROM benchmark) SELECT item_id, CASE WHEN len(w) <= 2 THEN text ELSE array_to_string(w[1:len(w):2], ' ') END AS stressed FROM w""")
def drop_words_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.drop_words("text").alias("stressed"))


@query("""WITH n AS (SELECT item_id, text, lead(text, 1, first_text) OVER (ORDER BY item_id) AS other FROM (SELECT *, first_value(text) OVER (ORDER BY item_id) AS first_text FROM benchmark)) SELECT item_id, md5(other) AS hint, other <> text AS changed FROM n""")
def neighbor_text_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item gets the next one's text as its hint; items are joined by their dense number, not by one ordered task."""
    from ..operators import sampling  # noqa: F401

    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    w = Window.orderBy("item_id")
    n = b.withColumns({"nth": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})
    other = n.select(F.col("nth").alias("at"), F.col("text").alias("other"))
    return n.withColumn("at", F.pmod(F.col("nth") + 1, F.col("n")).cast("int")).join(other, "at").select("item_id", F.md5(F.col("other").cast("binary")).alias("hint"), (F.col("other") != F.col("text")).alias("changed"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1) AS number, coalesce(json_extract_string(props, '$.none'), 'missing') AS none FROM events""")
def events_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", P.nested("props", "$.k").alias("k"), P.nested("props", "$.k", "double", -1.0).alias("number"), P.nested("props", "$.none", "string", "missing").alias("none"))


@query("""SELECT event_id, event_id % 3 = 0 AS passed, CASE WHEN event_id % 4 = 3 THEN 0e0 ELSE (event_id % 10) / 1e1 END AS score, CASE WHEN event_id % 4 = 3 THEN '' ELSE event_type END AS reason FROM (SELECT event_id, event_type FROM events WHERE event_id % 4 < 3)
UNION ALL SELECT event_id, false, 0e0, '' FROM events WHERE event_id % 4 = 3""")
def judge_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's answer plain, in a code fence, inside prose, or no JSON at all."""
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct((F.col("event_id") % 3 == 0).alias("pass"), (F.col("event_id") % 10 / 10).alias("score"), F.col("event_type").alias("reason")))
    kind = F.col("event_id") % 4
    e = e.withColumn("said", F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("I think "), body, F.lit(" is right"))).otherwise("no verdict"))
    passed, score, reason = P.judge_fields("said")
    return e.select("event_id", passed.alias("passed"), score.alias("score"), reason.alias("reason"))


@query("""SELECT event_id, (['A', 'C', 'H', ''])[event_id % 4 + 1] AS first, (['B', 'C', 'A', ''])[event_id % 4 + 1] AS last FROM events""")
def letter_parse_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit("Either A or maybe b."), F.lit("Answer: (c)"), F.lit("H, no: a"), F.lit("none of these")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", P.first_letter(said, "ABCDEFGH").alias("first"), P.last_letter(F.when(F.col("event_id") % 4 == 3, "none").otherwise(said), "ABCDEFGH").alias("last"))


@query("""SELECT CASE WHEN starts_with(url, 'https://') THEN 'mirror://' || substr(url, 9) ELSE url END AS url, page_id, starts_with(url, 'https://') AS changed FROM pages""")
def path_prefix_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.remap_prefix("url", "https://", "mirror://").alias("url"), F.startswith("url", F.lit("https://")).alias("changed"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding) > 0 AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings), i AS (SELECT vec_id, p, p - row_number() OVER (PARTITION BY vec_id ORDER BY p) AS island FROM x WHERE v),
s AS (SELECT vec_id, min(p) AS start, max(p) + 1 AS stop FROM i GROUP BY vec_id, island) SELECT vec_id, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop FROM s""")
def audio_block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal values in an array (here: positive dimensions), as half-open spans."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0).alias("a"))
    return e.select("vec_id", F.inline(P.runs(F.col("a"), F.lit(True))))


@query("""WITH t AS (SELECT a.item_id, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS r, regexp_extract_all(lower(replace(a.text, ' the ', ' a ')), '[a-z0-9]+') AS h FROM benchmark a)
SELECT item_id, round(CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0 ELSE 1 END ELSE CAST(len(list_filter(list_zip(r, h), lambda x: x[1] <> x[2])) AS DOUBLE) / len(r) END, 6) AS error_rate FROM t""")
def token_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token edits of a text in which one word is replaced throughout; in this oracle they are substitutions alone."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.round(T.token_error_rate("text", F.replace("text", F.lit(" the "), F.lit(" a "))), 6).alias("error_rate"))


@query(rf"""SELECT item_id, CASE WHEN length({WS_SQL.format('text')}) > 60 THEN rtrim(left({WS_SQL.format('text')}, 57)) || '...' ELSE {WS_SQL.format('text')} END AS short FROM benchmark""")
def shorten_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.shorten("text", 60).alias("short"))
