"""Hard-negative mining by k-means inverted lists with exact bounds.

Vectors are quantised to integers; a score is an integer inner product, so results are exact.  An index is fitted by
k-means on a bounded sample (``SAMPLE_ROWS`` rows, ``MOST_LISTS`` centroids) and holds every row: each goes to the list
of its nearest centroid, and each list stores its radius, the largest distance of a member.  By Cauchy and Schwarz a score
in a list lies within q.c - |q| r and q.c + |q| r.  A search visits lists by descending upper bound, skips those that lie
above its window of scores, and stops where the bound falls strictly below its kth score (or below its window): ties go
by id, so a list with an equal bound may still hold a better row.  Sample and centroids set the cost, never the result:
recall is 1.

*Shards.*  Lists are laid out one after the other and cut in shards of about ``SHARD_ROWS`` rows, so the list of a vector
that a third of all rows repeat spreads over as many shards as it needs.  A search first visits the shard of the list
with the highest bound, which gives it a kth score, and then all others that the bounds leave.  Searches and shards meet by
shuffle; a task streams over the searches of a shard, and a shard with more than ``SEARCHES`` of them goes to several
tasks.  Within a task the lists of all searches are visited in waves of one, two, four ... lists.

First an anchor's positives are searched, then for each distinct score among them the rows of other labels within the
window.  The first ``k`` are taken by window functions, which keep k rows a group before they shuffle.

Rows with a null label, a null vector, or a null or non-finite component take no part.  Shorter vectors count as padded
by zeros.  Repeated rows are rows of their own, each an anchor if its id says so; a null id is no anchor and comes last
among ties.  Ids and labels are integers.  Scores that do not fit a long raise.  The empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize, numbered, partitions

SCALE = 256
SAMPLE_ROWS, MOST_LISTS, ROUNDS = 1 << 14, 1 << 10, 8
SHARD_ROWS, SEARCHES = 1 << 12, 1 << 14
#: Searches that a task holds against a shard at once, and candidates that it keeps before it cuts them to k.
TOGETHER, CANDIDATES = 1 << 10, 1 << 20
LOWEST, HIGHEST = -(1 << 62), 1 << 62
NO_ID = (1 << 63) - 1

MEMBER = "id long, label long, q binary, file_hash long, file_row long, list int, distance double"
#: Rows that tasks take: members (kind 0), then searches (kind 1; a search is named by its anchor's row and ``ask``).
UNIT = ["shard", "salt", "kind", "id", "label", "q", "file_hash", "file_row", "list", "distance", "ask", "lo", "hi", "least"]
FOUND = "file_hash long, file_row long, ask long, score long, found_id long, found_hash long, found_row long"


def matrix(column: pa.Array) -> np.ndarray:
    """The quantised vectors of a binary column, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), -1) if len(column) else np.zeros((0, 1), "<i4")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in the narrowest numbers that hold them."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if most < 1 << 56:  # a hundred times a score fits a long
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("scores of such vectors do not fit a long")


def quantised(df: DataFrame, vector: Column, label: Column, own: Column) -> DataFrame:
    """(id, label, q) of the rows that take part; q is int32 in little-endian order."""
    rows = df.select(own.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False))
            if len(x) and np.abs(x).max() >= 1 << 31:
                raise OverflowError("components of such size are not quantised")
            sizes = np.diff(v.offsets.to_numpy())
            q = np.zeros((len(v), width), "<i4")
            q[np.arange(width) < sizes[:, None]] = x
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in q], pa.binary())], ["id", "label", "q"])

    return rows.mapInArrow(run, "id long, label long, q binary")


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k centroids of the distinct rows of x, in the order in which these first occur."""
    _, first = np.unique(x, axis=0, return_index=True)
    x = x[np.sort(first)].astype(np.float32)
    c = x[:k].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c.astype(np.float64)


class Shard:
    """Members of a shard, list by list, and the searches that visit them."""

    def __init__(self, members: pa.Table, centroids: np.ndarray, k: int, same: bool, together: int, candidates: int) -> None:
        at = members.column("list").to_numpy()
        order = np.argsort(at, kind="stable")
        self.x = matrix(members.column("q"))[order]
        self.id, self.label, self.hash, self.row = (members.column(c).to_numpy()[order] for c in ("id", "label", "file_hash", "file_row"))
        lists, self.first = np.unique(at[order], return_index=True)
        self.ends = np.append(self.first[1:], len(at))
        self.centroids = centroids[lists]
        self.radius = np.maximum.reduceat(members.column("distance").to_numpy()[order], self.first)
        self.k, self.same, self.together, self.candidates = k, same, together, candidates

    def search(self, batch: pa.Table) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, self.together):
            yield self.visits(batch.slice(a, self.together))

    def visits(self, asked: pa.Table) -> pa.RecordBatch:
        q = matrix(asked.column("q"))
        label, own_hash, own_row, ask, lo, hi, least = (asked.column(c).to_numpy() for c in ("label", "file_hash", "file_row", "ask", "lo", "hi", "least"))
        low, high = bounds(q, self.centroids, self.radius)
        order = np.argsort(-high, axis=1)
        high = np.take_along_axis(high, order, 1)
        skip = np.take_along_axis(low, order, 1) > hi[:, None]
        floor = np.maximum(lo, least)
        held = [np.empty(0, np.int64) for _ in range(3)]  # search, score, member
        begin, wave = 0, 1
        while begin < order.shape[1]:
            goes = (high[:, begin : begin + wave] >= floor[:, None]) & ~skip[:, begin : begin + wave]
            search, nth = np.nonzero(goes)
            visited = order[search, begin + nth]
            by = np.argsort(visited, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(visited[by])) + 1) if len(by) else []:
                rows, of = search[part], visited[part[0]]
                own = slice(self.first[of], self.ends[of])
                score = products(q[rows], self.x[own])
                good = (score >= floor[rows, None]) & (score <= hi[rows, None]) & ((label[rows, None] == self.label[own]) == self.same)
                good &= (own_hash[rows, None] != self.hash[own]) | (own_row[rows, None] != self.row[own])
                i, j = np.nonzero(good)
                held = [np.concatenate(x) for x in zip(held, (rows[i], score[i, j].astype(np.int64), self.first[of] + j), strict=True)]
                if len(held[0]) > self.candidates:
                    held, floor = self.cut(held, floor)
            held, floor = self.cut(held, floor)
            begin, wave = begin + wave, 2 * wave
        search, score, member = held
        arrays = [own_hash[search], own_row[search], ask[search], score, self.id[member], self.hash[member], self.row[member]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [f.split()[0] for f in FOUND.split(", ")])

    def cut(self, held: list[np.ndarray], floor: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The first k of each search, and the scores below which nothing counts any more."""
        search, score, member = held
        order = np.lexsort((self.row[member], self.hash[member], self.id[member], -score, search))
        search, score, member = search[order], score[order], member[order]
        nth = np.arange(len(search)) - np.searchsorted(search, search)
        floor = floor.copy()
        last = nth == self.k - 1
        floor[search[last]] = np.maximum(floor[search[last]], score[last])
        keep = nth < self.k
        return [search[keep], score[keep], member[keep]], floor


def bounds(q: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest score that a list may hold for each row of q, with room for rounding."""
    q = q.astype(np.float64)
    middle, reach = q @ centroids.T, np.sqrt((q * q).sum(1))[:, None] * radius
    reach = reach + 1e-9 * (np.abs(middle) + reach) + 1e-6
    return middle - reach, middle + reach


class Index:
    """``members`` (a table) in lists; ``centroids``, ``radius`` and the place where each list begins."""

    def __init__(self, rows: DataFrame) -> None:
        n = rows.count()
        k = min(MOST_LISTS, int(np.ceil(np.sqrt(n))))
        sample = rows.orderBy(F.xxhash64("id", "q"), "id", "q").limit(SAMPLE_ROWS).select("q").toArrow()
        centroids = kmeans(matrix(sample.column("q")), k) if n else np.zeros((1, 0))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = (centroids * centroids).sum(1) / 2
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("q")).astype(np.float64)
                near = (x @ centroids.T - half).argmax(1).astype(np.int32)
                distance = np.sqrt(((x - centroids[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(distance)], [*batch.schema.names, "list", "distance"])

        self.members = materialize(rows.select("id", "label", "q", "file_hash", "file_row").mapInArrow(assign, MEMBER), "members")
        lists = self.members.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()  # MOST_LISTS rows
        self.centroids, self.sizes, self.radius = centroids, np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
        for r in lists:
            self.sizes[r["list"]], self.radius[r["list"]] = r["n"], r["radius"]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def search(self, searches: DataFrame, k: int, same: bool) -> DataFrame:
        """The first k members for each search (a member's columns, ask, lo, hi), of its own label or of others: ``FOUND``, nth."""
        n = partitions(searches.sparkSession)
        searches = materialize(searches.select("id", "label", "q", "file_hash", "file_row", "ask", "lo", "hi"), "searches")
        salts = -(-searches.count() // SEARCHES) or 1
        home = self.meet(searches.withColumn("least", F.lit(LOWEST)), True, salts, k, same, n)
        home = materialize(home, "home")
        key = ["file_hash", "file_row", "ask"]
        kth = home.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.min("score").alias("least")).where(F.col("times") == k).drop("times")
        rest = searches.join(kth, key, "left").withColumn("least", F.coalesce("least", F.lit(LOWEST)))
        found = home.unionByName(self.meet(rest, False, salts, k, same, n))
        first = Window.partitionBy(*key).orderBy(F.desc("score"), "found_id", "found_hash", "found_row")
        return found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)

    def meet(self, searches: DataFrame, home: bool, salts: int, k: int, same: bool, n: int) -> DataFrame:
        centroids, radius, starts, sizes = self.centroids, self.radius, self.starts, self.sizes
        live = np.flatnonzero(sizes)
        shard_of = [np.arange(starts[c] // SHARD_ROWS, (starts[c] + sizes[c] - 1) // SHARD_ROWS + 1) for c in live]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A member goes to the shard of a place of its list that its hash picks."""
            for batch in batches:
                at, pick = batch.column("list").to_numpy(), batch.column("pick").to_numpy()
                shard = (starts[at] + pick % np.maximum(sizes[at], 1)) // SHARD_ROWS
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *[batch.column(c) for c in UNIT[3:10]]], ["shard", *UNIT[3:10]])

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A search goes to the first shard of the list with the highest bound, or to all others that the bounds leave."""
            for whole in batches:
                for a in range(0, whole.num_rows, TOGETHER):  # none without members
                    batch = whole.slice(a, TOGETHER)
                    low, high = bounds(matrix(batch.column("q")), centroids[live], radius[live])
                    lo, hi, least, pick = (batch.column(c).to_numpy() for c in ("lo", "hi", "least", "pick"))
                    best = high.argmax(1)
                    first = np.array([shard_of[c][p % len(shard_of[c])] for c, p in zip(best, pick, strict=True)], np.int64)
                    if home:
                        row, shard = np.arange(len(best)), first
                    else:
                        goes = (high >= np.maximum(lo, least)[:, None]) & (low <= hi[:, None])
                        seen = [np.unique(np.concatenate([shard_of[c] for c in np.flatnonzero(g)])) if g.any() else np.empty(0, np.int64) for g in goes]
                        row = np.repeat(np.arange(len(best)), [len(s) for s in seen])
                        shard = np.concatenate([*seen, np.empty(0, np.int64)])
                        row, shard = row[shard != first[row]], shard[shard != first[row]]
                    taken = batch.take(pa.array(row))
                    names = [c for c in UNIT if c in taken.schema.names]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *[taken.column(c) for c in names]], ["shard", *names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, shard, held = None, None, []
            for batch in batches:
                units = list(zip(batch.column("shard").to_pylist(), batch.column("salt").to_pylist(), batch.column("kind").to_pylist(), strict=True))
                cuts = [k for k in range(len(units)) if k == 0 or units[k] != units[k - 1]]
                for a, b in zip(cuts, [*cuts[1:], len(units)], strict=True):
                    if units[a][:2] != key:
                        key, shard, held = units[a][:2], None, []
                    rows = batch.slice(a, b - a)
                    if units[a][2] == 0:
                        held.append(rows)
                    elif held:
                        shard = shard or Shard(pa.Table.from_batches(held), centroids, k, same, TOGETHER, CANDIDATES)
                        yield from shard.search(pa.Table.from_batches([rows]))

        pick = F.pmod(F.xxhash64("file_hash", "file_row"), F.lit(1 << 40)).alias("pick")
        types = "id long, label long, q binary, file_hash long, file_row long"
        salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
        members = self.members.select("*", pick).mapInArrow(deal, f"shard int, {types}, list int, distance double").select("*", salted, F.lit(0).alias("kind"))
        asked = searches.select("*", pick).mapInArrow(route, f"shard int, {types}, ask long, lo long, hi long, least long")
        asked = asked.select("*", F.pmod(F.xxhash64("file_row", "file_hash"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"))
        units = members.unionByName(asked, allowMissingColumns=True).select(*UNIT)
        return units.repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(run, FOUND)


def hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """For each row where ``anchor`` (a condition on the column ``id``) holds and each of its first ``positives`` rows of the
    same label: the first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` hundredths of the
    positive's.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    kinds = ("long", "integer", "short", "byte")
    if df.schema[id_col].dataType.typeName() not in kinds or df.schema[label_col].dataType.typeName() not in kinds:
        raise TypeError("ids and labels are integers")
    if not 0 < low <= high:
        raise ValueError("0 < low <= high")
    rows = quantised(df, F.col(vector_col), F.col(label_col), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    index = Index(numbered(materialize(rows, "quantised")))
    name = ["file_hash", "file_row"]
    anchors = index.members.where(F.coalesce(anchor, F.lit(False)) & (F.col("id") != NO_ID)).withColumns({"ask": F.lit(0).cast("long"), "lo": F.lit(LOWEST), "hi": F.lit(HIGHEST)})
    near = index.search(anchors, positives, same=True)
    near = materialize(near.select(*name, F.col("found_id").alias("positive_id"), F.col("score").alias("ask")), "positives")
    windows = near.select(*name, "ask", F.expr(f"(ask * {low} + pmod(-ask * {low}, 100)) div 100 AS lo"), F.expr(f"(ask * {high} - pmod(ask * {high}, 100)) div 100 AS hi"))
    asked = anchors.drop("ask", "lo", "hi").join(windows.where("lo <= hi").distinct(), name)
    found = index.search(asked, negatives, same=False).withColumnRenamed("found_id", "negative_id").withColumnRenamed("score", "negative_score")
    out = near.join(found, [*name, "ask"]).withColumnRenamed("ask", "positive_score").join(anchors.select(*name, F.col("id").alias("anchor_id")), name)
    own = df.schema[id_col].dataType
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(own).alias(c)
    return out.select(real("anchor_id"), real("positive_id"), F.col("nth").alias("rank"), real("negative_id"), "positive_score", "negative_score")
