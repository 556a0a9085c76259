"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

1. Each text is normalised (the characters ``[\\x20\\x09-\\x0D]`` go) and its UTF-8 bytes are cut where their own
   content says so: a chunk ends behind three code points that are 3, 5 and 1 modulo 8 (one place in a few hundred, in
   any script, as a code point's last byte tells its remainder), at least ``min_chunk`` and at most ``max_chunk`` bytes
   long.  As the least length is well below the usual one, cuts soon depend on nearby text alone, and a copied passage
   is cut alike wherever it stands.  Texts are cut once; chunks and identifiers are written as columns of one table.
2. Chunks are deduplicated by their content: every distinct chunk is shuffled once, behind a map-side aggregate.
   Its identifier is XXH64; the dictionary verifies that each identifier names one content.  If contents share one, all
   take others, from SHA-256; if ``ATTEMPTS`` kinds of identifiers all clash, the job fails.
3. A document's recipe is the ordered list of its identifiers, and equal recipes make a group: nothing else decides.
   The text's SHA-256 is output alone; texts never move again.

A group's statistics are aggregated map-side, so a group with a third of all rows costs one row a task.  They return
to the rows by broadcast for groups above 1/``HOT_SHARE`` of the rows whose recipes have ``HOT_RECIPE`` identifiers at
most (32 MB in all), and by a shuffle join, which compares whole recipes, for all other groups.

Null texts count as empty and form one group with empty and all-space texts.  Of equal texts the longest original
stays, then the smallest id; a null id counts as larger than any.  Repeated rows (same id, same text) all name that
id as keeper; one of them is marked kept.  An empty table gives an empty result.  A text of n bytes takes about 6 n in
its task while it is cut.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

MIN_CHUNK, MAX_CHUNK, ATTEMPTS = 32, 4096, 4
#: A group is hot if it holds more than this share of the rows; there are at most as many hot groups.
HOT_SHARE, HOT_RECIPE = 1000, 4096
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def last_bytes(remainder: int) -> str:
    """A class of the bytes that end code points with this remainder modulo 8: ASCII and continuation bytes."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(remainder, 0xC0, 8)) + "]"


def chunked(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order, each byte of its UTF-8 as one character; their concatenation is the text."""
    if not 3 < min_chunk < max_chunk:
        raise ValueError("3 < min_chunk < max_chunk")
    between = r"(?:[\xc0-\xff][\x80-\xbf]{0,2})?"  # what comes before the last byte of a code point
    mark = between.join(last_bytes(r) for r in (3, 5, 1))
    rule = f"(?s).{{{min_chunk - 3},{max_chunk - 9}}}?{mark}|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(rule), F.lit(0))


def identifier(chunk: Column, attempt: int) -> Column:
    """XXH64 of the chunk, or on later attempts of its SHA-256 and the attempt's number."""
    return F.xxhash64(F.sha2(F.encode(chunk, "UTF-8"), 256), F.lit(attempt)) if attempt else F.xxhash64(chunk)


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chunk: int = MIN_CHUNK,
    max_chunk: int = MAX_CHUNK,
    carry: tuple[str, ...] = (),
    name: Callable[[Column, int], Column] = identifier,
) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, keep_id, group_size, kept, text_sha256, recipe (identifiers), and the
    columns ``carry`` of ``df`` as carry_<name>.  ``name`` gives a chunk's identifier on an attempt."""
    own = [f"carry_{c}" for c in carry]
    norm = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    norm = norm.select("id", *own, F.length(F.coalesce("raw", F.lit(""))).alias("points"), normalised(F.col("raw")).alias("norm"))
    cut = norm.select("id", *own, "points", F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"), chunked(F.col("norm"), min_chunk, max_chunk).alias("chunks"))

    def identifiers(attempt: int) -> Column:
        return F.transform("chunks", lambda c: name(c, attempt))

    cut = materialize(cut.withColumns({"recipe": identifiers(0), "nth": F.monotonically_increasing_id()}), "chunks")

    for attempt in range(ATTEMPTS):
        recipe = identifiers(attempt) if attempt else F.col("recipe")
        pairs = cut.select(F.explode(F.arrays_zip(recipe.alias("identifier"), F.col("chunks"))).alias("p")).select("p.identifier", "p.chunks")
        contents = pairs.distinct().groupBy("identifier").agg(F.count(F.lit(1)).alias("contents"))
        if contents.where("contents > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"{ATTEMPTS} kinds of identifiers all name several chunks")
    rows = cut.select("id", *own, "points", "sha", recipe.alias("recipe"), "nth")

    best = F.min(F.struct((-F.col("points")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "nth"))
    groups = rows.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialize(groups.select("recipe", F.col("best.id").alias("keep_id"), F.col("best.nth").alias("keep_nth"), "group_size"), "groups")
    total = rows.count()
    many = (F.col("group_size") * HOT_SHARE > total) & (F.size("recipe") <= HOT_RECIPE)
    named = lambda g, x: g.select("recipe", *[F.col(c).alias(f"{x}_{c}") for c in ("keep_id", "keep_nth", "group_size")])
    joined = rows.join(F.broadcast(named(groups.where(many), "hot")), "recipe", "left")
    # rows that have found their group spread by number, and meet no cold group
    joined = joined.withColumn("spread", F.when(F.col("hot_group_size").isNotNull(), F.col("nth") + 1).otherwise(0))
    joined = joined.join(named(groups.where(~many), "cold").withColumn("spread", F.lit(0).cast("long")), ["spread", "recipe"], "left")
    size = F.coalesce("hot_group_size", "cold_group_size", F.lit(1)).cast("long")
    nth = F.coalesce("hot_keep_nth", "cold_keep_nth", "nth")
    keeper = F.when(F.col("hot_group_size").isNotNull(), F.col("hot_keep_id")).when(F.col("cold_group_size").isNotNull(), F.col("cold_keep_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), keeper.alias("keep_id"), size.alias("group_size"), (nth == F.col("nth")).alias("kept"), F.col("sha").alias("text_sha256"), "recipe", *own)
