"""Vector search in blocks: one side is a stated set (a label bank, a query set), the other is all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

#: Added to a variance before its root is taken.
EPSILON = 1e-6
#: Vectors of the stated side that travel with a task at once (at 2,048 doubles each, 64 MB), and of the other side in a
#: cell of the grid.
BLOCK, CELL = 4096, 32768
ROUND = 6


def matrix(column: pa.Array, dims: slice = slice(None)) -> np.ndarray:
    """(rows, dimensions) of a list column without nulls, as doubles."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)[:, dims]


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    norm = np.linalg.norm(x, axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    return x / np.where(norm == 0, 1, norm)


def blocks(df: DataFrame, id_col: str, vector_col: str, n: int) -> Iterator[tuple[list, np.ndarray]]:
    """The stated side, BLOCK rows at a time, in the order of its id."""
    ids, rows = [], []
    for r in df.select(id_col, vector_col).where(F.col(vector_col).isNotNull()).orderBy(id_col).toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == n:
            yield ids, np.array(rows, float)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, float)


def bank(df: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(label, vector): the mean vector of each label, summed on the executors dimension by dimension."""
    long = df.select(F.col(label_col).alias("label"), F.posexplode(vector_col).alias("pos", "v"))
    means = long.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))


def bank_vectors(labels: DataFrame, most_labels: int = BLOCK) -> tuple[list, np.ndarray] | None:
    """The labels in order and their vectors, or nothing if there are more than ``most_labels``."""
    found = list(blocks(labels.limit(most_labels + 1), "label", "vector", most_labels + 1))
    if found and len(found[0][0]) > most_labels:
        return None
    return found[0] if found else ([], np.zeros((0, 1)))


def rank_views(df: DataFrame, labels: DataFrame, keep: list[str], views: dict[str, slice], constant: int = 60, vector_col: str = "embedding", most_labels: int = BLOCK) -> DataFrame:
    """(``keep``, cand, s_<view>, r_<view> for each of ``views``, r_rrf): every row against every label of a bank, by the
    dimensions of each view, with its ranks (ties by label) and the fused rank (ties by the first view's).

    A bank of up to ``most_labels`` travels with the tasks, and a row's labels are ranked where the row is.  A larger one is
    cut into blocks that meet blocks of rows on executors, and a row's labels are ranked by a window."""
    kind = labels.schema["label"].dataType.simpleString()
    kind = "long" if kind in ("int", "bigint") else kind
    rows = df.where(F.col(vector_col).isNotNull()).select(*keep, F.col(vector_col).alias("__v"))
    found = bank_vectors(labels, most_labels)
    if found is None:
        return rank_in_blocks(rows, labels.select(F.col("label").cast(kind).alias("label"), "vector"), keep, views, constant, most_labels)
    names, vectors = found
    sides = {v: normalised(vectors[:, dims]) for v, dims in views.items()}

    def places(order: np.ndarray) -> np.ndarray:
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.broadcast_to(np.arange(1, order.shape[1] + 1), order.shape), axis=1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // max(1, len(names)))
        for whole in batches:
            for first in range(0, whole.num_rows if names else 0, step):
                batch = whole.slice(first, step)
                x = matrix(batch.column("__v"))
                scores = {v: np.round(normalised(x[:, dims]) @ sides[v].T, ROUND) for v, dims in views.items()}
                ranks = {v: places(np.argsort(-s, axis=1, kind="stable")) for v, s in scores.items()}
                fused = np.round(sum(1.0 / (constant + r) for r in ranks.values()), 12)
                rrf = places(np.lexsort((next(iter(ranks.values())), -fused), axis=1))
                at = pa.array(np.repeat(np.arange(batch.num_rows), len(names)))
                columns = [*[batch.column(c).take(at) for c in keep], pa.array(names * batch.num_rows)]
                columns += [pa.array(m[v].ravel()) for v in views for m in (scores, ranks)] + [pa.array(rrf.ravel())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "cand", *[f"{x}_{v}" for v in views for x in "sr"], "r_rrf"])

    schema = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"cand {kind}"]
    schema += [f"s_{v} double, r_{v} long" for v in views] + ["r_rrf long"]
    return rows.mapInArrow(run, ", ".join(schema))


def rank_in_blocks(rows: DataFrame, labels: DataFrame, keep: list[str], views: dict[str, slice], constant: int, most_labels: int) -> DataFrame:
    """``rank_views`` for a bank of any size: a cell has up to ``most_labels`` labels and 2 ** 20 scores."""
    rows = materialize(rows.withColumn("__i", F.monotonically_increasing_id()), "rows")
    high, wide = -(-rows.count() // max(1, (1 << 20) // most_labels)) or 1, -(-labels.count() // most_labels) or 1
    # both sides number their cells by one type: a cogroup deals each side out by its own, and a long hashes unlike an int
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.select("__i", "__v", block("__i", high).alias("row")).withColumn("column", every(wide))
    b = labels.where(F.col("vector").isNotNull()).select("label", "vector", block("label", wide).alias("column")).withColumn("row", every(high))
    names = [f"s_{v}" for v in views]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = (matrix(t.column(c).combine_chunks()) for t, c in ((left, "__v"), (right, "vector")))
        scores = [np.round(normalised(x[:, dims]) @ normalised(y[:, dims]).T, ROUND).ravel() if len(x) and len(y) else np.empty(0) for dims in views.values()]
        many = len(scores[0])
        at, of = (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))) if many else (np.empty(0, np.int64),) * 2
        columns = [left.column("__i").combine_chunks().take(pa.array(at)), right.column("label").combine_chunks().take(pa.array(of)), *map(pa.array, scores)]
        return pa.Table.from_arrays(columns, ["__i", "cand", *names])

    schema = f"__i long, cand {labels.schema['label'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names)
    met = a.groupBy("row", "column").cogroup(b.groupBy("row", "column")).applyInArrow(cell, schema)
    own = Window.partitionBy("__i")
    met = met.withColumns({f"r_{v}": F.row_number().over(own.orderBy(F.desc(f"s_{v}"), "cand")).cast("long") for v in views})
    fused = F.round(sum((1.0 / (constant + F.col(f"r_{v}")) for v in views), F.lit(0.0)), 12)
    met = met.withColumn("__f", fused).withColumn("r_rrf", F.row_number().over(own.orderBy(F.desc("__f"), f"r_{next(iter(views))}")).cast("long"))
    return met.join(rows.select("__i", *keep), "__i").select(*keep, "cand", *[f"{x}_{v}" for v in views for x in "sr"], "r_rrf")


def group_ranks(df: DataFrame, labels: DataFrame, keep: list[str], group: str, target: str, arms: dict[str, slice], vector_col: str = "embedding", most_labels: int = BLOCK) -> DataFrame:
    """(``keep``, ``group``, arm, rank, top, top_score): the place of each row's ``target`` among the labels of its own group, by
    each arm's dimensions, in one pass over the vectors.  ``labels`` has (group, label, vector), ``most_labels`` of them at
    most; a target that its group lacks has a null rank, a row whose group has no labels no result."""
    banks: dict = {}
    listed = labels.select(group, "label", "vector").where(F.col("vector").isNotNull()).orderBy(group, "label").limit(most_labels + 1).collect()
    if len(listed) > most_labels:
        raise ValueError(f"the banks have more than {most_labels} labels; rank each family by rank_views")
    for r in listed:
        banks.setdefault(r[group], []).append((r["label"], r["vector"]))
    sides = {g: ([n for n, _ in rows], {a: normalised(np.array([v for _, v in rows], float)[:, dims]) for a, dims in arms.items()}) for g, rows in banks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, groups, wanted = matrix(batch.column("__v")), batch.column(group).to_pylist(), batch.column("__t").to_pylist()
            found: list[tuple] = []
            for g in dict.fromkeys(groups):
                if g not in sides:
                    continue
                at, (names, vectors) = [k for k, y in enumerate(groups) if y == g], sides[g]
                own = np.array([names.index(wanted[k]) if wanted[k] in names else -1 for k in at])
                for arm, dims in arms.items():
                    score = np.round(normalised(x[at][:, dims]) @ vectors[arm].T, ROUND)
                    order = np.argsort(-score, axis=1, kind="stable")
                    rank = np.argmax(order == own[:, None], axis=1) + 1
                    found += [(k, arm, int(rank[j]) if own[j] >= 0 else None, names[order[j, 0]], float(score[j, order[j, 0]])) for j, k in enumerate(at)]
            if found:
                rows, *columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in (*keep, group)], *[pa.array(c) for c in columns]], [*keep, group, "arm", "rank", "top", "top_score"])

    kind = labels.schema["label"].dataType.simpleString()
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keep, group)) + f", arm string, rank long, top {'long' if kind == 'int' else kind}, top_score double"
    rows = df.where(F.col(vector_col).isNotNull()).select(*keep, group, F.col(target).alias("__t"), F.col(vector_col).alias("__v"))
    return rows.mapInArrow(run, schema)


class Best:
    """The ``k`` best candidates of some queries, from candidates in any order; ties by id."""

    def __init__(self, own: np.ndarray, unit: np.ndarray, k: int, skip_self: bool) -> None:
        self.own, self.unit, self.k, self.skip_self = own, unit, k, skip_self
        self.score, self.names = np.empty((len(own), 0)), np.empty((len(own), 0), np.int64)

    def add(self, cand: np.ndarray, unit: np.ndarray) -> None:
        score = np.round(self.unit @ unit.T, ROUND)
        if self.skip_self:
            score[self.own[:, None] == cand[None, :]] = -np.inf
        score, names = np.hstack([self.score, score]), np.hstack([self.names, np.broadcast_to(cand, (len(self.own), len(cand)))])
        order = np.lexsort((names, -score), axis=1)[:, : self.k]
        self.score, self.names = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)

    def rows(self) -> pa.RecordBatch:
        good = np.isfinite(self.score.ravel())
        query = np.repeat(self.own, self.score.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (query, self.names.ravel(), self.score.ravel())], ["query", "cand", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = True, dims: slice = slice(None)) -> DataFrame:
    """(query, cand, score, rank): the k most similar candidates of each query, by cosine, ties by id."""
    return top_k_views(queries, candidates, k, {"all": dims}, id_col, vector_col, skip_self).drop("view")


def top_k_views(queries: DataFrame, candidates: DataFrame, k: int, views: dict[str, slice], id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = True) -> DataFrame:
    """(view, query, cand, score, rank): the same by the dimensions of each view, in one pass over the candidates.

    Up to ``BLOCK`` queries travel with the tasks of one pass over the candidates.  More are cut into blocks, as are the
    candidates, and every pair of blocks meets in a cell on an executor.  Either way k rows a query and task go on."""
    side = lambda df: df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).alias("v"))
    asked, others, schema, step = side(queries), side(candidates), "view string, query long, cand long, score double", 2048

    def told(best: dict[str, Best]) -> Iterator[pa.RecordBatch]:
        for name, found in best.items():
            rows = found.rows()
            yield pa.RecordBatch.from_arrays([pa.array([name] * rows.num_rows, pa.string()), *rows.columns], ["view", *rows.schema.names])

    count = asked.count()
    if count <= BLOCK:
        found = list(blocks(asked, "i", "v", BLOCK))
        own, vectors = (np.array(found[0][0]), found[0][1]) if found else (np.empty(0, np.int64), np.zeros((0, 1)))
        units = {name: normalised(vectors[:, dims]) for name, dims in views.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {name: Best(own, unit, k, skip_self) for name, unit in units.items()}
            for batch in batches:
                for first in range(0, batch.num_rows if len(own) else 0, step):
                    part = batch.slice(first, step)
                    cand, x = part.column("i").to_numpy(), matrix(part.column("v"))
                    for name, dims in views.items():
                        best[name].add(cand, normalised(x[:, dims]))
            yield from told(best)

        out = others.mapInArrow(run, schema)
    else:
        rows, columns = -(-count // BLOCK), -(-others.count() // CELL)
        block = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
        a = asked.withColumns({"row": block(rows), "column": every(columns)})
        b = others.withColumns({"column": block(max(1, columns)), "row": every(rows)})

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            data = lambda t: (t.column("i").to_numpy(), matrix(t.column("v").combine_chunks()))
            own, x = data(left)
            cand, y = data(right)
            best = {name: Best(own, normalised(x[:, dims]), k, skip_self) for name, dims in views.items()}
            for first in range(0, len(cand) if len(own) else 0, step):
                for name, dims in views.items():
                    best[name].add(cand[first : first + step], normalised(y[first : first + step][:, dims]))
            return pa.Table.from_batches(told(best))

        out = a.groupBy("row", "column").cogroup(b.groupBy("row", "column")).applyInArrow(cell, schema)
    best = Window.partitionBy("view", "query").orderBy(F.desc("score"), "cand")
    return out.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def cache_key(sample_id: F.Column, instruction: F.Column) -> F.Column:
    """What a query's vector is kept under: the query and what the encoder was told."""
    return F.sha2(F.concat_ws("||", sample_id, instruction), 256)


def with_cache(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached vector, rows to be encoded and appended); both have a key, the cache (key, vector)."""
    return rows.join(cache, "key"), rows.join(cache.select("key"), "key", "left_anti")


def knn_vote(neighbours: DataFrame, labels: DataFrame, id_col: str = "vec_id", label_col: str = "label", extra: list[str] | None = None, factor: str | None = None) -> DataFrame:
    """(query, ``extra``, ``factor``, prediction): the label of most neighbours; ties by the sum of scores, then by label.
    ``extra`` are columns of the neighbours that keep votes apart, ``factor`` one of the labels."""
    by = ["query", *(extra or []), *([factor] if factor else [])]
    cast = labels.select(F.col(id_col).alias("cand"), F.col(label_col).alias("vote"), *([factor] if factor else []))
    votes = neighbours.join(cast, "cand").groupBy(*by, "vote").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), ROUND).alias("s"))
    best = votes.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("s")).alias("s"), "vote")).alias("best"))
    return best.select(*by, F.col("best.vote").alias("prediction"))


def masked_mean(frames: F.Column | str, mask: F.Column | str) -> F.Column:
    """The mean of the frames (array of arrays) that the mask keeps, or of all if it keeps none."""
    pairs = F.arrays_zip(F.col(frames).alias("f") if isinstance(frames, str) else frames.alias("f"), F.col(mask).alias("m") if isinstance(mask, str) else mask.alias("m"))
    kept = F.filter(pairs, lambda p: p["m"])
    used = F.when(F.size(kept) > 0, kept).otherwise(pairs)
    total = F.aggregate(F.slice(used, 2, F.size(used)), F.transform(F.get(used, F.lit(0))["f"], lambda v: v.cast("double")), lambda acc, p: F.zip_with(acc, p["f"], lambda a, b: a + b))
    return F.transform(total, lambda v: v / F.size(used))


def pooled(df: DataFrame, keep: list[str], frames: str, mask: str, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """(``keep``, an array for each of ``specs``): the frames of each row (array of arrays) pooled to one vector of length one.

    A spec is (subset, method): ``all`` frames, or the ``audio`` ones that the mask keeps (all, if it keeps none), by their
    ``mean``, ``std``, ``stats`` (both, one behind the other) or ``attn``: mean and deviation weighted by the softmax of each
    frame's product with the mean over the root of the dimension.  Without frames means are zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("__f")
            flat = lists.flatten()
            h = matrix(flat)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            chosen = batch.column("__m").flatten().to_numpy(zero_copy_only=False).astype(bool)
            kept = np.bincount(row[chosen], minlength=batch.num_rows) > 0
            masks = {"all": np.ones(len(row), bool), "audio": chosen | ~kept[row]}
            arrays = []
            for subset, method in specs.values():
                arrays.append(pool(h, row, masks[subset], batch.num_rows, method))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(list(x), pa.list_(pa.float64())) for x in arrays]], [*keep, *specs])

    for _, method in specs.values():
        if method not in ("mean", "std", "stats", "attn"):
            raise ValueError(f"unknown method: {method}")
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], *[f"`{c}` array<double>" for c in specs]])
    empty = F.array().cast("array<array<double>>")
    rows = df.select(*keep, F.coalesce(F.col(frames).cast("array<array<double>>"), empty).alias("__f"), F.transform(F.coalesce(frames, empty.cast(df.schema[frames].dataType)), lambda _, i: F.coalesce(F.get(mask, i), F.lit(False))).alias("__m"))
    return rows.mapInArrow(run, schema)


def pool(h: np.ndarray, row: np.ndarray, mask: np.ndarray, n: int, method: str) -> np.ndarray:
    """[row, dimension]: the frames h that the mask keeps, pooled by their row."""
    h, row = h[mask], row[mask]
    width = h.shape[1]

    def total(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, x.shape[1]))
        np.add.at(out, row, x)
        return out

    weight = 1 / np.maximum(np.bincount(row, minlength=n), 1)[row][:, None]
    mean = total(h * weight)
    if method == "attn":
        score = (h * mean[row]).sum(1) / np.sqrt(max(width, 1))
        top = np.full(n, -np.inf)
        np.maximum.at(top, row, score)
        e = np.exp(score - top[row])[:, None]
        weight = e / total(e)[row]
        mean = total(h * weight)
    std = np.sqrt(total((h - mean[row]) ** 2 * weight) + EPSILON)
    return normalised({"mean": mean, "std": std}.get(method, np.hstack([mean, std])))
