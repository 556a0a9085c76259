"""Packing tokens into sequences of fixed length: bounded-space online packing.

A document's ids and an end id are cut into full windows, which are sequences as they are, and a remainder.  Each task
keeps ``open_windows`` windows open and places a remainder best-fit: into the open window with the least space that
holds it.  If none does and no more may be opened, the fullest goes: the remainder is cut, its first ids fill that
window to the brim, and the rest is placed in turn.  So windows that go are full, and only those that are open at a
task's end are left over.  Leftovers are merged in rounds: a round brings those of ``FAN`` tasks together and
places their pieces anew, the longest first, best-fit into up to FAN x ``open_windows`` windows; it keeps the
``open_windows`` emptiest for the next round, until one task has seen what is left.  A round moves a row of three
numbers for each piece in a leftover window (at most ``open_windows`` windows a task), never ids.  The last join gives
pieces their new windows: while the moved pieces are few it is a broadcast, beyond that it shuffles the pieces, with
their ids if these are asked for.

Sequences that are not full are to be padded to ``length`` or, if they are a power of two long, not at all.  Null texts
count as empty and give the end id alone; repeated rows are packed one by one; a null id stays null; the empty table
gives an empty result.  A lost task is run again on the same rows and gives the same windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize
from .bpe import text_batches, vocabulary

LENGTH, OPEN_WINDOWS, FAN = 1024, 64, 64


class Space:
    """Open windows of a task: (free space, number) in order.  Best fit, and the fullest goes when there are too many."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most, self.free = length, most, []

    def place(self, size: int, number: int) -> tuple[int, int, int | None]:
        """(window, offset in it, window that goes).  ``number`` names the window if one has to be opened."""
        k = bisect_left(self.free, (size, -1))
        if k < len(self.free):
            free, window = self.free.pop(k)
            if free > size:
                insort(self.free, (free - size, window))
                return window, self.length - free, None
            return window, self.length - free, window
        gone = None
        if len(self.free) >= self.most:
            gone = self.free.pop(0)[1]
        insort(self.free, (self.length - size, number))
        return number, 0, gone

    def fill(self, size: int) -> tuple[int, int, int] | None:
        """(window, offset, ids that it takes) where a piece of this size fits nowhere and the fullest has to go."""
        if len(self.free) < self.most or self.free[-1][0] >= size:
            return None
        free, window = self.free.pop(0)
        return window, self.length - free, free


def pack(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, special: bool = False, digest: tuple[str, str, Callable[[np.ndarray], object]] | None = None) -> DataFrame:
    """One row for each piece: ``id_col``, start and length (in the document's ids), ids (array<int>, the piece's),
    doc_tokens, sequence_id, offset.  A ``digest`` (name, type, function of a piece's ids) stands in place of ids.  With
    ``special``, special tokens that a text spells are these tokens."""
    name, kind, value = digest or ("ids", "array<int>", lambda ids: ids.astype(np.int32))
    own = df.schema[id_col].dataType.simpleString()
    schema = f"id {own}, start long, length long, {name} {kind}, doc_tokens long, window long, offset long"
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[kind]
    names = ["id", "start", "length", name, "doc_tokens", "window", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, space = vocabulary(path, pattern, special), Space(length, open_windows)
        number = TaskContext.get().partitionId() << 34
        for batch in batches:
            for a, b, texts in text_batches(batch.column("text")):
                ids, bounds = bpe.encode(texts)
                rows: list[tuple] = []
                for k in range(b - a):
                    tokens = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                    n = len(tokens)
                    for start in range(0, n, length):
                        piece = tokens[start : start + length]
                        if len(piece) == length:
                            rows.append((a + k, start, length, value(piece), n, number, 0))
                            number += 1
                            continue
                        while cut := space.fill(len(piece)):
                            window, offset, size = cut
                            rows.append((a + k, start, size, value(piece[:size]), n, window, offset))
                            start, piece = start + size, piece[size:]
                        window, offset, _ = space.place(len(piece), number)
                        number += window == number
                        rows.append((a + k, start, len(piece), value(piece), n, window, offset))
                at, *columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), arrow, pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)
        left = {window for _, window in space.free}
        if left:  # these may be merged: rows of their own name them
            nulls = [pa.nulls(len(left), t) for t in (batch.schema.field("id").type, pa.int64(), arrow, pa.int64())]
            yield pa.RecordBatch.from_arrays([nulls[0], pa.array([-1] * len(left), pa.int64()), nulls[1], nulls[2], nulls[3], pa.array(sorted(left), pa.int64()), nulls[3]], names)

    def merge(turn: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows (window, offset, length) to rows (window, offset, length, host, base); host is null for pieces
            that go on to the next round."""
            space, first = Space(length, FAN * open_windows), (1 << 62) + (turn << 54) + (TaskContext.get().partitionId() << 32)
            number, told = first, []
            for batch in batches:
                for window, offset, size in zip(*(batch.column(x).to_pylist() for x in ("window", "offset", "length")), strict=True):
                    host, base, _ = space.place(size, number)
                    number += host == number
                    told.append((window, offset, size, host, base))
            on = set() if last else {host for _, host in space.free[-open_windows:]}
            told = [(*x[:3], None, None) if x[3] in on else x for x in told]
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told, strict=True)], ["window", "offset", "length", "host", "base"])

        return run

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    rows = materialize(rows, "pieces")
    pieces = rows.where("start >= 0")
    named = rows.where("start < 0").select("window")
    left = pieces.join(named, "window", "left_semi").select("window", "offset", "length")
    tasks = int(named.agg(F.max(F.shiftright("window", 34))).first()[0] or 0) + 1
    hosts, turn, last = None, 0, False
    while not last:
        tasks, turn = -(-tasks // FAN), turn + 1
        last = tasks == 1
        met = left.repartition(1) if last else left.repartition(tasks, F.shiftright("window", 34) if turn == 1 else F.xxhash64("window"))
        met = met.sortWithinPartitions(F.desc("length"), "window", "offset").mapInArrow(merge(turn, last), "window long, offset long, length long, host long, base long")
        met = materialize(met, "merged")
        moved = met.where("host IS NOT NULL").select("window", "offset", "host", "base")
        hosts = moved if hosts is None else hosts.unionByName(moved)
        left = met.where("host IS NULL").select("window", "offset", "length")
    placed = pieces.join(hosts, ["window", "offset"], "left")
    return placed.select(F.col("id").alias(id_col), "start", "length", name, "doc_tokens", F.coalesce("host", "window").alias("sequence_id"), F.coalesce("base", "offset").alias("offset"))
