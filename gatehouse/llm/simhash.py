"""SimHash near-dedup by meet-in-the-middle ball hashing.

*Fingerprints.*  ASCII letters are lower-cased; a document's shingles are its runs of ``shingle`` words joined by a
space (with fewer words the whole sequence), repeats included; a bit of the fingerprint is set if it is set in over
half of the shingles' XXH64 (seed 42).  Without words the fingerprint is zero.

*Links.*  Two fingerprints link at ``radius`` or fewer differing bits.  Only distinct fingerprints take part, so a
group of copies costs one.  Every fingerprint emits all variants within half the radius; for an odd radius r a pair
at distance r differs in the parity of its set bits, so fingerprints of even parity round the half up and those of
odd parity round it down: for r = 3 each meets the other in at least one variant.  All who meet in a variant within
the lower half are linked to each other by the triangle inequality, and those of the larger shell to them, so a star
around one of them says everything: a bucket never makes all its pairs.

*Shuffle.*  A ball of 2,081 variants is not shuffled row by row.  A row is (prefix of the variant, fingerprint): one
row stands for all variants that share the prefix, which the receiving task writes out, sorts, and compares.  With 16
bits that is 17 or 137 rows instead of 65 or 2,081.  The number of bits grows with the number of fingerprints: it is the
least of ``PREFIX_BITS`` that gives a prefix ``MEAN_ROWS`` rows on the average (16 bits up to 400 million distinct
fingerprints, 24 up to 50 billion).  Rows are then counted by prefix, and the variants of a dense prefix (over
``DENSE_ROWS`` rows) are shuffled by the next longer prefix, and so on up to all 64 bits, where no more than 2,081
fingerprints can meet for radius 3.  So each variant is worked off in one place with all who have it, and no task gets
more than ``DENSE_ROWS`` rows (16 MB) of a prefix.  The list of dense prefixes goes to the driver and to the tasks; by
the two bounds it has less than one in two prefixes: 32,768 of 16 bits, 8 million (64 MB) of 24.  A task works through
its prefixes in order; where those at hand have more variants than ``MOST_VARIANTS`` they are split by their next
``STEP`` bits, again and again, so that each variant is written out once however many rows a prefix has.
Colliding pairs are deduplicated and verified against the fingerprints, and each task sends on a spanning forest of
what it has found, at most one edge for a fingerprint and batch.

*Groups.*  Connected components of the links (``_graph``), named by their smallest document id.

``near_copies`` is the same operator at a stated similarity of the texts, for pipelines.

Null and empty texts have the fingerprint zero.  A null id never names a group unless all its ids are null.  Repeated
rows stay, one result row each.  The empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import materialize, partitions
from ._text import LOWER, SPACE, Words, chunks, signed

SEED, SHINGLE, RADIUS, PREFIX_BITS = 42, 3, 3, (16, 24, 32, 64)
#: Rows of a prefix on the average, at most, and rows above which a prefix is dense.
MEAN_ROWS, DENSE_ROWS = 1 << 19, 1 << 20
#: Variants held at once by a task, and bits by which prefixes with more are split.
MOST_VARIANTS, STEP = 1 << 21, 4


def fingerprint_batch(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of a batch of texts."""
    data = LOWER[data]
    words = Words(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(words.starts):
        return out
    keep = ~SPACE[data]
    tail = words.ends[words.ends < len(data)]
    keep[tail[SPACE[data[tail]]]] = True  # one space behind each word
    clean = data[keep]
    clean[SPACE[clean]] = 0x20
    place = np.cumsum(keep) - 1
    starts, size = place[words.starts], words.ends - words.starts
    counts, first = words.counts, words.first[:-1]
    has = counts > 0
    per = np.where(has, np.maximum(counts - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(per)), per)
    begin = np.cumsum(per) - per
    nth = first[text] + np.arange(len(text)) - begin[text]
    last = np.minimum(nth + shingle - 1, first[text] + counts[text] - 1)
    raw, digest = clean.tobytes(), xxhash.xxh64_intdigest
    found = [digest(raw[a:b], SEED) for a, b in zip(starts[nth].tolist(), (starts[last] + size[last]).tolist(), strict=True)]
    out[has] = majority(np.array(found, np.uint64), per[has])
    return out


def majority(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each run of ``per`` (none empty) of the hashes."""
    # eight counters of a byte each in a number: sums over at most 255 hashes of one run
    lanes = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    pieces = -(-per // 255)
    owner = np.repeat(np.arange(len(per)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sums = np.add.reduceat(lanes, (np.cumsum(per) - per)[owner] + 255 * within, axis=0).view(np.uint8)
    total = np.add.reduceat(sums, np.flatnonzero(within == 0), axis=0, dtype=np.uint32)
    return np.packbits(2 * total > per[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), signed(fingerprint_batch(data, offsets, shingle))], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def masks(bits: int, shift: int, weight: int) -> np.ndarray:
    """All ways to flip ``weight`` of ``bits`` bits that begin at bit ``shift``."""
    return np.array([sum(1 << (shift + i) for i in c) for c in combinations(range(bits), weight)] or [0] * (weight == 0), np.uint64)


def halves(fps: np.ndarray, radius: int) -> np.ndarray:
    """Half the radius, for an odd radius rounded up where the parity is even and down where it is odd."""
    return np.where((np.bitwise_count(fps) & 1) == 0, (radius + 1) // 2, radius // 2)


def emit(fps: np.ndarray, radius: int, prefix_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix of variants, fingerprint) rows of these fingerprints."""
    ours, theirs, reach = [], [], halves(fps, radius)
    for weight in range((radius + 1) // 2 + 1):
        able = fps[reach >= weight]
        for flip in masks(prefix_bits, 64 - prefix_bits, weight):
            ours.append((able ^ flip) >> np.uint64(64 - prefix_bits))
            theirs.append(able)
    return np.concatenate(ours), np.concatenate(theirs)


class Balls:
    """Writes out, for rows (prefix, fingerprint), the variants that have the prefix."""

    def __init__(self, radius: int, prefix_bits: int) -> None:
        self.radius, self.prefix_bits, self.low = radius, prefix_bits, radius // 2
        rest = 64 - prefix_bits
        self.flips = [masks(rest, 0, w) for w in range((radius + 1) // 2 + 1)]
        self.sizes = np.cumsum([len(x) for x in self.flips])

    def spent(self, prefix: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits flipped in the prefix, and how many more may be."""
        used = np.bitwise_count(prefix ^ (fps >> np.uint64(64 - self.prefix_bits))).astype(np.int64)
        return used, halves(fps, self.radius) - used

    def variants(self, prefix: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(variant, row, whether it lies within the lower half)."""
        used, left = self.spent(prefix, fps)
        keep = np.uint64((1 << (64 - self.prefix_bits)) - 1)
        base = (prefix << np.uint64(64 - self.prefix_bits)) | (fps & keep)
        for weight, flips in enumerate(self.flips):
            rows = np.flatnonzero(left >= weight)
            step = max(1, MOST_VARIANTS // 4 // max(1, len(flips)))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                yield (base[part][:, None] ^ flips).ravel(), np.repeat(part, len(flips)), np.repeat(used[part] + weight <= self.low, len(flips))

    def links(self, prefix: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified links (fingerprint, fingerprint) among rows that hold all rows of their prefixes: stars.  Rows with
        too many variants are split by the next bits of these, so that none is written out twice."""
        total = int(self.sizes[np.maximum(self.spent(prefix, fps)[1], 0)].sum())
        if total <= MOST_VARIANTS or self.prefix_bits == 64:
            return self.stars(prefix, fps)
        step = min(STEP, 64 - self.prefix_bits)
        deeper, a, b = balls_of(self.radius, self.prefix_bits + step), [], []
        for tail in range(1 << step):
            longer = (prefix << np.uint64(step)) | np.uint64(tail)
            mine = deeper.spent(longer, fps)[1] >= 0
            if mine.sum() > 1:
                x, y = deeper.links(longer[mine], fps[mine])
                a.append(x)
                b.append(y)
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64),) * 2

    def stars(self, prefix: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of rows whose variants fit in memory."""
        none = (np.empty(0, np.uint64),) * 2
        found = list(self.variants(prefix, fps))
        if not found:
            return none
        variant, row, low = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(variant)
        variant = variant[order]
        same = variant[1:] == variant[:-1]
        met = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if not met.any():
            return none
        variant, row, low = variant[met], row[order[met]], low[order[met]]
        order = np.lexsort((fps[row], ~low, variant))
        variant, row, low = variant[order], row[order], low[order]
        head = np.concatenate([[True], variant[1:] != variant[:-1]])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
        good = ~head & low[lead]
        x, y = fps[row[good]], fps[row[lead[good]]]
        ok = (x != y) & (np.bitwise_count(x ^ y) <= self.radius)
        return x[ok], y[ok]


balls_of = cache(Balls)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node but the roots: as few edges with the same components."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        old = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == old).all():
            break
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def under(fps: np.ndarray, radius: int, bits: int, parents: tuple[int, np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(prefix, fingerprint) rows, in parts; with ``parents`` (bits, dense prefixes) only of variants below those."""
    if parents:
        prefix, own = emit(fps, radius, parents[0])
        fps = np.unique(own[among(prefix, parents[1])])
    step = max(1, (1 << 20) // sum(math.comb(bits, w) for w in range((radius + 1) // 2 + 1)))
    for k in range(0, len(fps), step):
        prefix, own = emit(fps[k : k + step], radius, bits)
        if parents:
            below = among(prefix >> np.uint64(bits - parents[0]), parents[1])
            prefix, own = prefix[below], own[below]
        yield prefix, own


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which entries of ``x`` are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def dense_prefixes(distinct: DataFrame, radius: int, bits: int, parents: tuple[int, np.ndarray] | None) -> np.ndarray:
    """The prefixes with more than ``DENSE_ROWS`` rows, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(fps), 8192):
                for prefix, _ in under(fps[k : k + 8192], radius, bits, parents):
                    which, rows = np.unique(prefix, return_counts=True)
                    yield pa.RecordBatch.from_arrays([signed(which), pa.array(rows)], ["prefix", "rows"])

    counts = distinct.select("fp").mapInArrow(count, "prefix long, rows long").groupBy("prefix").agg(F.sum("rows").alias("rows"))
    found = counts.where(F.col("rows") > DENSE_ROWS).select("prefix").collect()
    return np.sort(np.array([r.prefix for r in found], np.int64).view(np.uint64))


def rows_of(radius: int, bits: int) -> float:
    """Rows (prefix, fingerprint) of a fingerprint on the average."""
    return sum(sum(math.comb(bits, w) for w in range(reach + 1)) for reach in (radius // 2, (radius + 1) // 2)) / 2


def first_bits(count: int, radius: int, prefix_bits: tuple[int, ...]) -> int:
    """Where in ``prefix_bits`` to begin with so many fingerprints."""
    for k, bits in enumerate(prefix_bits):
        if count * rows_of(radius, bits) <= MEAN_ROWS << bits:
            return k
    return len(prefix_bits) - 1


def level(distinct: DataFrame, radius: int, bits: int, parents: tuple[int, np.ndarray] | None, dense: np.ndarray) -> DataFrame:
    """Edges (a, b) found under the prefixes of ``bits`` bits, but for the dense ones."""
    n = partitions(distinct.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(fps), 8192):
                for prefix, own in under(fps[k : k + 8192], radius, bits, parents):
                    if len(dense):
                        light = ~among(prefix, dense)
                        prefix, own = prefix[light], own[light]
                    yield pa.RecordBatch.from_arrays([signed(prefix), signed(own)], ["prefix", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(radius, bits)

        def told(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            """In runs of whole prefixes of about MOST_VARIANTS variants."""
            prefix, fps = (np.concatenate(x).view(np.uint64) for x in zip(*parts, strict=True))
            size = np.cumsum(balls.sizes[np.maximum(balls.spent(prefix, fps)[1], 0)])
            ends = np.append(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, len(prefix))
            row = 0
            while row < len(prefix):
                most = (size[row - 1] if row else 0) + MOST_VARIANTS
                k = max(int(np.searchsorted(size[ends - 1], most, side="right")) - 1, int(np.searchsorted(ends, row, side="right")))
                node, root = forest(*balls.links(prefix[row : ends[k]], fps[row : ends[k]]))
                row = int(ends[k])
                if len(node):
                    yield pa.RecordBatch.from_arrays([signed(node), signed(root)], ["a", "b"])

        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            prefix, fps = batch.column("prefix").to_numpy(), batch.column("fp").to_numpy()  # sorted as signed numbers
            if not len(prefix):
                continue
            cut = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on in the next batch
            if cut or kept and kept[0][0][0] != prefix[0]:
                yield from told([*kept, (prefix[:cut], fps[:cut])])
                kept = []
            kept.append((prefix[cut:], fps[cut:]))
        if kept:
            yield from told(kept)

    rows = distinct.select("fp").repartition(n, "fp").mapInArrow(spread, "prefix long, fp long")
    return rows.repartition(n, "prefix").sortWithinPartitions("prefix").mapInArrow(meet, "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, prefix_bits: tuple[int, ...] = PREFIX_BITS) -> DataFrame:
    """``distinct`` has the distinct fingerprints in its long column fp.  Returns edges (a, b) whose components are
    those of all links; long and signed.  ``prefix_bits`` grow to 64."""
    found, parents = None, None
    for bits in prefix_bits[first_bits(distinct.count(), radius, prefix_bits) :]:
        dense = dense_prefixes(distinct, radius, bits, parents) if bits < prefix_bits[-1] else np.empty(0, np.uint64)
        edges = level(distinct, radius, bits, parents, dense)
        found = edges if found is None else found.unionByName(edges)
        if not len(dense):
            break
        parents = (bits, dense)
    return found.distinct()


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups of documents at a Jaccard similarity of 0.8 of their word shingles, verified: see ``jaccard``."""
    from . import jaccard  # it rests on this module

    return jaccard.near_dedup(df, id_col, text_col, shingle, radius, carry)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, prefix_bits: tuple[int, ...] = PREFIX_BITS) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, fingerprint (16 hex digits), component_id, kept (whether the id
    names its group).  Links are by fingerprint alone; ``near_copies`` verifies them over the texts."""
    fps = materialize(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    roots = components(links(distinct, radius, prefix_bits))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.select("fp", "root").join(named, "root").select("fp", "component_id")
    out = fps.join(classes, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
