"""Near copies of operator 1 at a stated similarity: documents link at a Jaccard similarity of 0.8 of their word shingles.

*Sets.*  ASCII letters are lower-cased; a document's set has the 64-bit hashes of its runs of ``shingle`` words (with
fewer words, of the whole sequence).  Only distinct sets take part, so copies cost one.

*Ball hashing.*  Each set has a SimHash fingerprint, and fingerprints within ``radius`` bits meet as in ``simhash``.
The pairs that collide are verified over their whole sets, and what passes makes the first components.

*Beyond the ball.*  A pair of similarity 0.8 differs in 10 of 64 bits on the average, so a ball of radius 3 meets one in
a hundred of such pairs, and one of radius 14, which would meet most, has 10**14 variants.  What it misses is
searched for by prefixes: let the shingles have any one order; two sets of similarity t or more share a shingle among
the first n - ceil(t n) + 1 of each, and at the first that they share, as many must follow in both as the similarity
asks for.  So all links are met by those that share a shingle of their prefixes.  The order is a matter of cost only:
shingles that are common in a sample of documents come last, so that a passage of many documents stays out of prefixes.

*Links.*  1. In each bucket (the sets of about one size with one shingle in their prefixes) each set is compared with
the most central one: that whose own prefix lies in the largest buckets.  Of a group of near copies this is the text
that the others were made from, or the nearest to it, and the same in all buckets of the group, so a group costs a pair
or two a member and becomes one component, or nearly so.  The leaders are found by aggregates, so no bucket meets in one
task; those of common shingles are dealt in ``PARTS``.  2. In buckets that still have several components, those outside the
largest are compared with all whose sizes and places allow the similarity.  Pairs within a component say nothing new, so
the components are those of all pairs at 0.8, with none left out.

*Comparisons* are over whole sets, but for pairs that a sketch rules out: it has the parities of the shingles in
2 to 4 cells a shingle, and two sets differ in at least as many shingles as their sketches in cells.

*Cost.*  Buckets whose sets are many and all near, but short of, the similarity make all their pairs.

*Groups.*  A group keeps the row of the smallest id, then of the smallest hash of the text; a null id counts as larger
than any.  Texts without words are one group.  The empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._graph import components
from ._store import materialize, partitions, release
from ._text import LOWER, Words, chunks, mix, ngrams, signed, spans_hash

SHINGLE = 5
#: The similarity as a fraction: exact in integers.
ABOVE, BELOW = 4, 5
#: Documents that tell which shingles are common, and at most so many common ones.
SAMPLE_ROWS, MOST_COMMON = 1 << 14, 1 << 19
#: Parts of the buckets of common shingles, and bits of the filter of the sets that are compared (a power of two).
PARTS, FILTER_BITS = 64, 1 << 24
#: Cells of the smallest sketch; it has twice as many cells as shingles, at least, and a power of two.
CELLS = 512


def sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of a batch of texts, sorted, each once."""
    words = Words(LOWER[data], offsets)
    hashes = words.hashes()
    n = max(0, len(hashes) - shingle + 1)
    inside = np.flatnonzero(words.doc[shingle - 1 :] == words.doc[:n])
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    text, found = words.doc[inside], ngrams(hashes, shingle)[inside]
    if len(short):
        text = np.concatenate([text, short])
        found = np.concatenate([found, spans_hash(hashes, words.first[short], words.first[short + 1])])
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    return text[fresh], found[fresh]


def keys(text: np.ndarray, found: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the set, its size) for each text."""
    size = np.bincount(text, minlength=rows)
    total = np.zeros(len(found) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(found ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
        ends = np.cumsum(size)
        return mix(total[ends] - total[ends - size] + size.astype(np.uint64)), size


def sketches(text: np.ndarray, found: np.ndarray, size: np.ndarray) -> pa.Array:
    """For each text whether the number of its shingles in each cell is odd, as lists of longs."""
    cells = np.maximum(CELLS, 2 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    first = np.cumsum(cells) - cells
    cell = (mix(found ^ np.uint64(0x2545F4914F6CDD1D)) & (cells[text] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(first[text] + cell, minlength=int(cells.sum())) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(np.append(first, cells.sum()).astype(np.int32) // 64, pa.array(np.packbits(odd).view(np.int64)))


def fingerprints(text: np.ndarray, found: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The SimHash of each set; zero for the empty one."""
    out = np.zeros(len(size), np.uint64)
    if len(found):
        out[size > 0] = simhash.majority(mix(found ^ np.uint64(0x9FB21C651E98DF25)), size[size > 0])
    return out


def prefix_length(size: np.ndarray) -> np.ndarray:
    return np.where(size > 0, size - -(-ABOVE * size // BELOW) + 1, 0)


def prefixes(text: np.ndarray, found: np.ndarray, size: np.ndarray, common: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, whether it is common) of the texts' prefixes in their order, text by text; ``common`` is sorted."""
    rank = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, times[at], 0)
    order = np.lexsort((found, rank, text))
    nth = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    inside = nth < np.repeat(prefix_length(size), size)
    return found[order][inside], rank[order][inside] > 0


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, with their number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([signed(sets(data, offsets, shingle)[1])], ["shingle"])

    every = max(1, docs.count() // SAMPLE_ROWS)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    table = counts.orderBy(F.desc("times"), "shingle").limit(MOST_COMMON).toArrow()
    common, times = table.column("shingle").to_numpy().view(np.uint64), table.column("times").to_numpy()
    order = np.argsort(common)
    return common[order], times[order]


class Shared:
    """Goes through rows (part, shingle, key, n, place) sorted by part, shingle, key, and leaves out those whose part and
    shingle no other set has, but for common parts (from 0), which are parts of larger buckets.  Sets that several tasks
    told count once; what a batch leaves open is carried into the next."""

    def __init__(self) -> None:
        self.last: tuple | None = None  # part, shingle and key of the last row
        self.pending: tuple | None = None  # the only row of the last bucket so far

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [x.to_numpy() for x in batch.columns]
        if not len(rows[0]):
            return
        part, shingle, key = rows[:3]
        new, again = np.ones(len(key), bool), np.zeros(len(key), bool)
        new[1:] = (part[1:] != part[:-1]) | (shingle[1:] != shingle[:-1])
        again[1:] = ~new[1:] & (key[1:] == key[:-1])
        if self.last:
            new[0] = (part[0], shingle[0]) != self.last[:2]
            again[0] = not new[0] and key[0] == self.last[2]
        rows, new = [x[~again] for x in rows], new[~again]
        if not len(new):
            return
        keep = ~(new & np.append(new[1:], False) & (rows[0] < 0))
        waits = bool(new[-1] and rows[0][-1] < 0)  # whether it is alone is for the next batch to say
        keep[-1] &= not waits
        told = [x[keep] for x in rows]
        if self.pending and not new[0]:
            told = [np.append(x, y) for x, y in zip(told, self.pending, strict=True)]
        self.last = tuple(x[-1] for x in rows[:3])
        self.pending = tuple(x[-1] for x in rows) if waits else None
        if len(told[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in told], ["part", "shingle", "key", "n", "place"])


def crossing(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of one shingle in different components whose sizes and places in the prefixes allow the
    similarity; ``rows`` has (shingle, root, key, n, place).  One of each pair is outside the bucket's largest component."""
    per = rows.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("sets"))
    most = per.groupBy("shingle").agg(F.max(F.struct("sets", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    here = materialize(rows.join(most.select("shingle", F.col("most.root").alias("major")), "shingle"), "mixed")
    side = lambda df, x: df.select("shingle", *[F.col(c).alias(f"{x}_{c}") for c in ("root", "key", "n", "place", "major")])
    both = side(here.where("root != major"), "a").join(side(here, "b"), "shingle")
    follow = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    able = (BELOW * F.least("a_n", "b_n") >= ABOVE * F.greatest("a_n", "b_n")) & ((ABOVE + BELOW) * follow >= ABOVE * (F.col("a_n") + F.col("b_n")))
    once = (F.col("b_root") == F.col("b_major")) | (F.col("a_key") < F.col("b_key"))
    met = both.where((F.col("a_root") != F.col("b_root")) & once & able)
    return met.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).distinct()


def possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sizes and sketches of ``known`` (key, n, sketch) do not rule out."""
    side = lambda x: known.select(F.col("key").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(BELOW * F.least("a_n", "b_n") >= ABOVE * F.greatest("a_n", "b_n"))
    # sizes within a quarter have as many cells, or the one twice those of the other: folded, its halves together
    fold = lambda x, y: F.expr(f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})")
    both = both.select("a", "b", "a_n", "b_n", fold("a_sketch", "b_sketch").alias("x"), fold("b_sketch", "a_sketch").alias("y"))
    cells = F.expr("aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (s, p) -> s + p)")
    return both.where((ABOVE + BELOW) * cells <= (BELOW - ABOVE) * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def compared(docs: DataFrame, pairs: DataFrame, known: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of sets that have the similarity.  Only sets of some pair that the sketches leave are shuffled; a
    filter tells which."""
    pairs = materialize(possible(pairs, known), "possible")
    members = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    place = F.pmod("key", F.lit(FILTER_BITS))
    bits = members.groupBy(F.shiftright(place, 5).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(key, {FILTER_BITS}) AS INT) & 31)")).alias("bits")).toArrow()
    member = np.zeros(FILTER_BITS // 32, np.uint32)
    member[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                text, found = sets(data, offsets, shingle)
                key, size = keys(text, found, b - a)
                at = key.view(np.int64) % FILTER_BITS
                hit = (member[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
                for k in np.flatnonzero(hit).tolist():
                    hit[k] = (x := int(key[k])) not in told
                    told.add(x)
                wanted = np.flatnonzero(hit)
                bounds = np.concatenate([[0], np.cumsum(size[wanted])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([signed(key[wanted]), pa.ListArray.from_arrays(bounds, signed(found[np.repeat(hit, size)]))], ["key", "shingles"])

    whole = materialize(docs.select("text").mapInArrow(run, "key long, shingles array<long>"), "sets")
    side = lambda x: whole.select(F.col("key").alias(x), F.col("shingles").alias(f"{x}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set")).alias("sum"))
    found = materialize(found.where(F.expr(f"{BELOW} * both >= {ABOVE} * (sum - both)")).select("a", "b").distinct(), "links")
    release(whole)
    return found


def ball_pairs(known: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of sets that meet in ball hashing: stars of fingerprints, each named by its smallest key, and the other
    sets of one fingerprint."""
    named = materialize(known.groupBy("fp").agg(F.min("key").alias("head")), "fingerprints")
    stars = simhash.links(named.select("fp"), radius)
    across = stars.join(named.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    same = known.join(named, "fp").where("key != head").select(F.col("key").alias("x"), F.col("head").alias("y"))
    return across.unionByName(same)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = simhash.RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, text_hash (XXH64 of the text by Spark), set_key, component_id, kept, and
    the columns ``carry`` as carry_<name>.  Kept are the rows whose id, text and carried columns are the smallest of their
    group: with a row's number among those, one row of each group."""
    own = [f"carry_{c}" for c in carry]
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), *[F.col(c).alias(f"carry_{c}") for c in carry], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions(df.sparkSession)
    common, times = common_shingles(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text"), most_rows=4096):
                text, found = sets(data, offsets, shingle)
                key, size = keys(text, found, b - a)
                first = np.ones(b - a, bool)  # a task gives each set's prefix and sketch once
                for k, x in enumerate(key.tolist()):
                    first[k] = x not in told
                    told.add(x)
                first &= size > 0
                mine = np.repeat(first, size)
                number = np.cumsum(first) - 1
                text, found, once = number[text[mine]], found[mine], size[first]
                length = np.where(first, prefix_length(size), 0)
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                prefix, often = prefixes(text, found, once, common, times)
                drawn, rows = sketches(text, found, once), np.cumsum(first) - first
                sketch = drawn.take(pa.array(rows, mask=~first)) if len(drawn) else pa.nulls(b - a, pa.list_(pa.int64()))
                fp = np.zeros(b - a, np.uint64)
                fp[first] = fingerprints(text, found, once)
                kept = [batch.column(c).slice(a, b - a) for c in ("id", "hash", *own)]
                lists = [pa.ListArray.from_arrays(bounds, x) for x in (signed(prefix), pa.array(often))]
                yield pa.RecordBatch.from_arrays([*kept, signed(key), pa.array(size), signed(fp), *lists, pa.array(first), sketch], ["id", "hash", *own, "key", "n", "fp", "prefix", "often", "first", "sketch"])

    schema = ", ".join([f"id {df.schema[id_col].dataType.simpleString()}, hash long", *[f"`carry_{c}` {df.schema[c].dataType.simpleString()}" for c in carry]])
    made = materialize(docs.mapInArrow(run, schema + ", key long, n long, fp long, prefix array<long>, often array<boolean>, first boolean, sketch array<long>"), "prefixes")
    known = materialize(made.where("first").select("key", "n", "fp", "sketch").dropDuplicates(["key"]), "sketches")

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Shared()
        for batch in batches:
            yield from buckets(batch)

    listed = made.where("first").select("key", "n", F.posexplode(F.arrays_zip("prefix", "often")).alias("place", "p"))
    part = F.when(F.col("p.often"), F.pmod("key", F.lit(PARTS))).otherwise(-1).cast("int")
    rows = listed.select(part.alias("part"), F.col("p.prefix").alias("shingle"), "key", "n", F.col("place").cast("long").alias("place"))
    rows = rows.repartition(n, "shingle", "part").sortWithinPartitions("part", "shingle", "key")
    shared = materialize(rows.mapInArrow(several, "part int, shingle long, key long, n long, place long"), "buckets")

    rank = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BELOW / ABOVE))).cast("int")
    ranked = shared.withColumn("rank", rank)
    bucket = ["shingle", "rank"]
    sizes = ranked.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"))
    weight = F.round(F.sum(F.log("size")) / F.max("n"), 6)
    middle = materialize(ranked.join(sizes, bucket).groupBy("key").agg(weight.alias("weight")), "middles")
    led = ranked.join(middle, "key").groupBy(*bucket).agg(F.max(F.struct("weight", "key")).alias("most")).select(*bucket, F.col("most.key").alias("y"))
    met = ranked.select(*bucket, F.col("key").alias("x")).join(led, bucket).select("x", "y").unionByName(ball_pairs(known, radius))
    pairs = materialize(met.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    links = compared(docs, pairs, known, shingle)

    roots = components(links)
    rows = shared.select("shingle", "key", "n", "place").join(roots.withColumnRenamed("node", "key"), "key", "left")
    rows = materialize(rows.withColumn("root", F.coalesce("root", "key")), "rooted")
    more = compared(docs, materialize(crossing(rows), "pairs"), known, shingle)
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))

    roots = components(stars.unionByName(more)).withColumnRenamed("node", "key")
    classes = made.select("id", "hash", *own, "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", *own)).alias("best"))
    out = classes.join(named, "root")
    kept = F.lit(True)
    for c in ("id", "hash", *own):
        kept = kept & F.col(c).eqNullSafe(F.col(f"best.{c}"))
    return out.select(F.col("id").alias(id_col), F.col("hash").alias("text_hash"), F.col("key").alias("set_key"), F.col("best.id").alias("component_id"), kept.alias("kept"), *own)
