"""Substring dedup over bytes by a depth-limited radix sort of suffixes.

The suffixes of all documents are ordered through their first ``window`` bytes only, by passes from the most significant
digit on; a group that cannot hold a repeat goes no further.  What is equal at the end are exactly the repeated windows.
A byte goes if a window over it also starts in a document of a smaller id.

*First digit.*  The digit that suffixes are dealt out by is the smallest hash of ``gram`` bytes within their window (as
k-mer counters deal theirs by minimisers), for equal windows have the same.  Suffixes that follow each other mostly share
it, so one row, a block, goes for about 16 of them: the digit and a hash of all bytes of the block's windows.  A block
whose digit stands alone is unique and ordered.  Blocks of equal content are copies of the one of the smallest id,
suffix by suffix.  Runs of bytes that are common in a sample of documents count as large, so that a frequent passage is
the digit of windows made of such passages alone; the sample sets the digits, and with them the cost, never the result.

*Further digits.*  What is left are blocks of different content under one digit.  Their bytes are fetched and dealt out
by the digit; a task orders the suffixes of each group by eight bytes at a time, and drops after each pass those whose
group lies in one document alone.  A group of over ``GROUP_BYTES`` is too large for one task: its suffixes are dealt
out again, by all their bytes, to as many tasks as there are.

Blocks and suffixes that repeat within ``BATCH_BYTES`` of texts meet there already, so a passage in a third of all
documents costs a row for each eight megabytes.  Texts go through tasks in parts of ``PART_BYTES``, which overlap by a
window, so a very long one needs no more memory for its digits; for the final cut a text takes about ten times its
bytes.  Two blocks are taken for equal by mistake only if two 64-bit hashes agree; later passes compare the bytes
themselves.

Null texts are empty.  A null id counts as smaller than any.  Rows of one id are not held against each other, whatever
their texts; rows that repeat id and text each get the same result.  The id is an integer.  The empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize, partitions
from ._text import chunks, give_back, mix, powers, signed, string_buffers

WINDOW, GRAM = 50, 20
PART_BYTES = 1 << 19
#: Bytes of texts whose blocks are made, and combined, at once.
BATCH_BYTES = 1 << 23
#: Bytes of blocks that a task sorts at once, and the most that a group may have there.
CHUNK_BYTES, GROUP_BYTES = 1 << 21, 1 << 23
#: Documents that tell which runs of bytes are common: those that one in ``COMMON_SHARE`` has, at most so many.
SAMPLE_ROWS, COMMON_SHARE, MOST_COMMON = 1 << 11, 128, 1 << 16
NO_ID = -(1 << 63)
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
#: ``at`` is the byte where the first of ``n`` windows starts; ``sub`` tells apart texts that share an id.
FOUND = "digit long, id long, sub long, at int, n int"
SORTED = "id long, sub long, at int, n int, suffix binary"

CODES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
BASES = [0x9E3779B97F4A7C15 | 1, 0xE7037ED1A0B428DB | 1]


def parts(column: pa.Array, window: int, most: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, first byte, bytes, offsets) of runs of texts; a text of over ``most`` bytes comes alone, in parts that
    overlap so that each window lies in exactly one."""
    data, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        size = int(offsets[row + 1] - offsets[row])
        if size > most:
            for at in range(0, max(1, size - window + 1), most):
                own = data[offsets[row] + at : offsets[row] + min(size, at + most + window - 1)]
                yield row, at, own, np.array([0, len(own)])
            row += 1
            continue
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, 0, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


def sums(data: np.ndarray, k: int) -> np.ndarray:
    """Running sums whose differences, shifted, are a polynomial hash of any run of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(CODES[k][data] * powers(BASES[k], len(data) + 1)[0][:-1], out=out[1:])
    return out


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` consecutive bytes."""
    if len(data) < gram:
        return np.empty(0, np.uint64)
    total, down = sums(data, 0), powers(BASES[0], len(data) + 1)[1]
    with np.errstate(over="ignore"):
        return mix((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])


def known(g: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which entries are in the sorted array ``common``; most are ruled out by 20 of their bits."""
    out = np.zeros(len(g), bool)
    if len(common):
        low = np.zeros(1 << 20, bool)
        low[common & np.uint64(0xFFFFF)] = True
        maybe = np.flatnonzero(low[g & np.uint64(0xFFFFF)])
        out[maybe] = common[np.minimum(np.searchsorted(common, g[maybe]), len(common) - 1)] == g[maybe]
    return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive entries, by doubling."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def blocks(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(digit, content, text, first window, number of windows) of each block of these texts."""
    n = len(data) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    g = grams(data, gram)
    digit = sliding_min((g >> np.uint64(1)) | (known(g, common).astype(np.uint64) << np.uint64(63)), window - gram + 1)
    inside = np.ones(n, bool)
    for cut in offsets[1:-1]:
        inside[max(0, cut - window + 1) : cut] = False
    starts = np.flatnonzero(inside)
    digit = digit[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (digit[1:] != digit[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(fresh)
    first, count = starts[heads], np.diff(np.append(heads, len(starts)))
    total, down = sums(data, 1), powers(BASES[1], len(data) + 1)[1]
    with np.errstate(over="ignore"):
        content = mix((total[first + count - 1 + window] - total[first]) * down[first] + count.astype(np.uint64))
    text = np.searchsorted(offsets, first, side="right") - 1
    return digit[heads], content, text, first - offsets[text], count


def record(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


def block_rows(batch: pa.RecordBatch, window: int, gram: int, common: np.ndarray, most: int = PART_BYTES) -> pa.RecordBatch:
    """The blocks of a batch.  One that repeats a document of smaller id within it is known to be a copy: it has content 0,
    a negative n, and a digit of its own that spreads such rows."""
    found = []
    ids, subs = batch.column("id").to_numpy(), batch.column("sub").to_numpy().astype(np.int64)
    for row, base, data, offsets in parts(batch.column("text"), window, most):
        digit, content, text, at, count = blocks(data, offsets, window, gram, common)
        found.append((digit, content, ids[row + text], subs[row + text], (at + base).astype(np.int32), count.astype(np.int32)))
    empty = [np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32)]
    digit, content, own, sub, at, count = (np.concatenate(x) for x in zip(empty, *found, strict=True))
    once = np.ones(len(own), bool)
    ordered = np.sort(content)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        rows = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, content), len(twice) - 1)] == content)
        rows = rows[np.lexsort((at[rows], sub[rows], own[rows], digit[rows], content[rows]))]
        same = (content[rows[1:]] == content[rows[:-1]]) & (digit[rows[1:]] == digit[rows[:-1]])
        once[rows[1:]] = ~(same & (own[rows[1:]] == own[rows[:-1]]) & (sub[rows[1:]] == sub[rows[:-1]]) & (at[rows[1:]] == at[rows[:-1]]))
        head = np.concatenate([[True], ~same])
        lead = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
        later = rows[own[rows] > own[lead]]
        with np.errstate(over="ignore"):
            digit[later] = mix(own[later].view(np.uint64) + mix(at[later].astype(np.uint64)))
        content[later], count[later] = 0, -count[later]
    return record([signed(digit[once]), signed(content[once]), own[once], sub[once], at[once], count[once]], ["digit", "content", "id", "sub", "at", "n"])


class Settle:
    """Goes through blocks sorted by digit, content and id.  Gives copies (digit null) and, with their digit, blocks that
    lead their content while their digit has other contents; what a batch leaves open is carried into the next."""

    def __init__(self) -> None:
        self.last: tuple | None = None  # digit, content and smallest id of the last block
        self.contents = 0  # of the last digit
        self.waiting: list[list[np.ndarray]] = []  # leads of the last digit, while it has one content

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(x).to_numpy() for x in ("digit", "content", "id", "sub", "at", "n")]
        told = columns[5] < 0
        if told.any():
            yield self.rows([x[told] for x in columns[2:5]] + [-columns[5][told]], None)
        digit, content, own, sub, at, n = (x[~told] for x in columns)
        if not len(digit):
            return
        new_digit, new_content = np.ones(len(digit), bool), np.ones(len(digit), bool)
        new_digit[1:] = digit[1:] != digit[:-1]
        new_content[1:] = new_digit[1:] | (content[1:] != content[:-1])
        if self.last:
            new_digit[0] = digit[0] != self.last[0]
            new_content[0] = new_digit[0] or content[0] != self.last[1]
        head = np.maximum.accumulate(np.where(new_content, np.arange(len(digit)), -1))
        smallest = own[head]
        if self.last:
            smallest[head < 0] = self.last[2]
        copy = own > smallest
        if copy.any():
            yield self.rows([x[copy] for x in (own, sub, at, n)], None)
        group = np.cumsum(new_digit)  # 0: the digit goes on from the last batch
        contents = np.bincount(group, weights=new_content, minlength=group[-1] + 1).astype(np.int64)
        contents[0] += self.contents
        mixed = contents > 1
        lead = ~copy & mixed[group]
        if lead.any():
            yield self.rows([x[lead] for x in (own, sub, at, n)], digit[lead])
        if mixed[0]:
            for columns in self.waiting:
                yield self.rows(columns[:-1], columns[-1])
        if mixed[0] or group[-1] > 0:
            self.waiting = []
        end = group[-1]
        if not mixed[end]:
            mine = ~copy & (group == end)
            self.waiting.append([x[mine] for x in (own, sub, at, n, digit)])
        self.contents = min(2, int(contents[end]))
        self.last = (digit[-1], content[-1], smallest[-1])

    @staticmethod
    def rows(columns: list[np.ndarray], digit: np.ndarray | None) -> pa.RecordBatch:
        own = pa.nulls(len(columns[0]), pa.int64()) if digit is None else pa.array(digit)
        return record([own, *columns[:2], *[x.astype(np.int32) for x in columns[2:]]], ["digit", "id", "sub", "at", "n"])


def listed(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each entry, fields) of a column of lists of structs; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    return pc.list_parent_indices(column).to_numpy(), [flat.field(x).to_numpy() for x in names]


def ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number) of the numbers start[k], start[k] + 1 ... of each k."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]


def slices(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of entries of about ``most`` in sum."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def fragments(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the blocks listed in the column edges."""
    row, (digit, at, n) = listed(batch.column("edges"), ("digit", "at", "n"))
    data, offsets = string_buffers(batch.column("text"))
    ids, subs = batch.column("id").to_numpy(), batch.column("sub").to_numpy().astype(np.int64)
    size = n.astype(np.int64) + window - 1
    for a, b in slices(size, CHUNK_BYTES):
        own = row[a:b]
        _, place = ranges(offsets[own] + at[a:b], size[a:b])
        bounds = np.concatenate([[0], np.cumsum(size[a:b])])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(data[place].tobytes())])
        yield record([digit[a:b], ids[own], subs[own], at[a:b], found.cast(pa.binary())], ["digit", "id", "sub", "at", "bytes"])


def copies(data: np.ndarray, start: np.ndarray, group: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Which of the suffixes data[start:start + window] equal, within their group, one of a smaller id: most significant
    digits first, eight bytes a pass."""
    step = min(8, window)
    word = np.zeros(max(0, len(data) - step + 1), np.uint64)
    for j in range(step):
        word = (word << np.uint64(8)) | data[j : len(word) + j]
    alive = np.arange(len(start))
    out = np.zeros(len(start), bool)
    depths = [*range(0, window - step, step), window - step]
    for depth in depths:
        key, own = word[start[alive] + depth], group[alive]
        order = np.lexsort((key, own))
        alive, key, own = alive[order], key[order], own[order]
        if not len(alive):
            return out
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
        heads = np.flatnonzero(fresh)
        size = np.diff(np.append(heads, len(alive)))
        least, most = np.minimum.reduceat(ids[alive], heads), np.maximum.reduceat(ids[alive], heads)
        keep = np.repeat(least < most, size)
        group[alive] = np.repeat(np.arange(len(heads)), size)
        if depth == depths[-1]:
            out[alive] = ids[alive] > np.repeat(least, size)
        alive = alive[keep]
    return out


class Sorter:
    """Takes fragments sorted by digit; sorts whole groups, about ``chunk`` bytes at a time, and passes on the suffixes of
    groups of over ``most`` bytes."""

    def __init__(self, window: int, chunk: int, most: int) -> None:
        self.window, self.chunk, self.most, self.held, self.size = window, chunk, most, [], 0
        self.digit, self.own, self.large = None, 0, False  # of the group that is being read

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digit = batch.column("digit").to_numpy()
        if not len(digit):
            return
        size = pc.binary_length(batch.column("bytes")).to_numpy().astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1]]))
        groups = zip(heads.tolist(), [*heads[1:].tolist(), len(digit)], np.add.reduceat(size, heads).tolist(), digit[heads].tolist(), strict=True)
        begin = 0  # the first row that is not held yet
        for a, b, bytes_, value in groups:
            if value != self.digit:
                if self.size >= self.chunk:
                    self.held.append(batch.slice(begin, a - begin))
                    begin = a
                    yield from self.flush()
                self.digit, self.own, self.large = value, 0, False
            self.own += bytes_
            self.size += bytes_
            if self.own > self.most and not self.large:
                self.large = True
                self.held.append(batch.slice(begin, a - begin))
                begin = a
                yield from self.take_out(value)
            if self.large:
                yield from self.suffixes(batch.slice(a, b - a))
                begin = b
                self.size -= bytes_
        self.held.append(batch.slice(begin))

    def take_out(self, value: int) -> Iterator[pa.RecordBatch]:
        """The suffixes of what is held of a group that has turned out to be large."""
        rest = []
        for rows in self.held:
            mine = pc.equal(rows.column("digit"), value)
            own = rows.filter(mine)
            self.size -= int(pc.sum(pc.binary_length(own.column("bytes"))).as_py() or 0)
            yield from self.suffixes(own)
            rest.append(rows.filter(pc.invert(mine)))
        self.held = rest

    def windows(self, rows: pa.Table) -> tuple[np.ndarray, ...]:
        """(bytes, start of each suffix, fragment of each)."""
        data, offsets = binary_buffers(rows.column("bytes"))
        owner, start = ranges(offsets[:-1], np.maximum(0, np.diff(offsets) - self.window + 1))
        return data, offsets, start, owner

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows = pa.Table.from_batches(self.held).combine_chunks()
            data, offsets, start, owner = self.windows(rows)
            digit, ids = rows.column("digit").to_numpy(), rows.column("id").to_numpy()
            group = np.cumsum(np.concatenate([[False], digit[1:] != digit[:-1]]))[owner]
            gone = copies(data, start, group, ids[owner], self.window)
            yield self.runs(rows, offsets, start, owner, gone)
        self.held, self.size = [], 0

    def runs(self, rows: pa.Table, offsets: np.ndarray, start: np.ndarray, owner: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        """Copies that follow each other within a fragment, as (at, n)."""
        start, owner = start[gone], owner[gone]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        heads = np.flatnonzero(fresh)
        n, own = np.diff(np.append(heads, len(start))), owner[heads]
        at = rows.column("at").to_numpy()[own] + start[heads] - offsets[own]
        return record([rows.column("id").to_numpy()[own], rows.column("sub").to_numpy()[own], at.astype(np.int32), n.astype(np.int32), pa.nulls(len(own), pa.binary())], ["id", "sub", "at", "n", "suffix"])

    def suffixes(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The suffixes of fragments for the next pass; those that repeat a smaller id here are copies already."""
        size = pc.binary_length(batch.column("bytes")).to_numpy().astype(np.int64)
        for a, b in slices(size, self.chunk):
            some = pa.Table.from_batches([batch.slice(a, b - a)])
            data, offsets, start, owner = self.windows(some)
            ids = some.column("id").to_numpy()
            gone = copies(data, start, np.zeros(len(start), np.int64), ids[owner], self.window)
            yield self.runs(some, offsets, start, owner, gone)
            start, owner = start[~gone], owner[~gone]
            own = np.lib.stride_tricks.sliding_window_view(data, self.window)[start]
            suffix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.window), len(start), [None, pa.py_buffer(own.tobytes())]).cast(pa.binary())
            at = some.column("at").to_numpy()[owner] + start - offsets[owner]
            yield record([ids[owner], some.column("sub").to_numpy()[owner], at.astype(np.int32), np.ones(len(start), np.int32), suffix], ["id", "sub", "at", "n", "suffix"])


def binary_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def equal_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of suffixes sorted by their bytes and id, those that equal one of a smaller id."""
    last: tuple = (None, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        suffix, own = np.array(batch.column("suffix").to_pylist(), object), batch.column("id").to_numpy()
        fresh = np.concatenate([[suffix[0] != last[0]], suffix[1:] != suffix[:-1]])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(own)), -1))
        least = own[head]
        least[head < 0] = last[1]
        last = (suffix[-1], least[-1])
        yield pa.RecordBatch.from_arrays([batch.column(x) for x in ("id", "sub", "at", "n")], ["id", "sub", "at", "n"]).filter(pa.array(own > least))


def cut(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the windows listed in the column pieces, and the spans that go."""
    row, (place, n) = listed(batch.column("pieces"), ("at", "n"))
    order = np.argsort(row, kind="stable")
    row, place, n = row[order], place[order], n[order].astype(np.int64)
    for a, b, data, offsets in chunks(batch.column("text")):
        mine = slice(*np.searchsorted(row, [a, b]))
        begin = offsets[row[mine] - a] + place[mine]
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + n[mine] + window - 1, -1)
        gone = np.cumsum(step[:-1]) > 0
        before = np.zeros(len(data) + 1, np.int64)
        np.cumsum(gone, out=before[1:])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # runs end with their text
        head = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])[: len(gone)]))
        tail = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]])[: len(gone)])) + 1
        text = np.searchsorted(offsets, head, side="right") - 1
        spans = pa.ListArray.from_arrays(
            np.searchsorted(head, offsets).astype(np.int32),
            pa.StructArray.from_arrays([pa.array(head - offsets[text]), pa.array(tail - head)], fields=list(SPAN)),
        )
        bounds = offsets - before[offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[~gone].tobytes())])
        yield record([batch.column("id").slice(a, b - a), kept.cast(pa.binary()), np.diff(offsets), np.diff(before[offsets]), spans], ["id", "kept_bytes", "n_bytes", "n_removed", "spans"])


def common_runs(docs: DataFrame, gram: int) -> np.ndarray:
    """Hashes, sorted, of the runs of ``gram`` bytes that are common in a sample of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                for at in range(0, len(data), PART_BYTES):
                    yield pa.RecordBatch.from_arrays([signed(np.unique(grams(data[at : at + PART_BYTES + gram - 1], gram)))], ["run"])

    rows = docs.count()
    some = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0).select("text")
    times = some.mapInArrow(run, "run long").groupBy("run").agg(F.count(F.lit(1)).alias("times"))
    found = times.where(F.col("times") > max(8, min(rows, SAMPLE_ROWS) // COMMON_SHARE)).orderBy(F.desc("times"), "run").limit(MOST_COMMON).toArrow()
    return np.sort(found.column("run").to_numpy().view(np.uint64))


def names(df: DataFrame, id_col: str, text: Column) -> tuple[Column, Column]:
    """(id, sub) of each row: sub is the XXH64 of the text if any id has several texts, else 0."""
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    sub = F.xxhash64(text)
    several = df.groupBy(own.alias("id")).agg(F.min(sub).alias("a"), F.max(sub).alias("b")).where("a != b").limit(1).count()
    return own.alias("id"), (sub if several else F.lit(0).cast("long")).alias("sub")


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, kept_bytes (binary: what stays), n_bytes, n_removed and spans (array of
    start, length in bytes: what goes)."""
    if not 1 <= gram <= window:
        raise ValueError("1 <= gram <= window")
    if df.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("the id is an integer")
    n = partitions(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(*names(df, id_col, text), text.alias("text"))
    common = common_runs(docs, gram)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
            for a, b in slices(size, BATCH_BYTES):
                yield block_rows(batch.slice(a, b - a), window, gram, common, PART_BYTES)
            give_back()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Settle()
        for batch in batches:
            yield from state(batch)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fragments(batch, window)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sorter(window, CHUNK_BYTES, GROUP_BYTES)
        for batch in batches:
            yield from state(batch)
        yield from state.flush()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(batch, window)

    key = ["id", "sub"]
    found = docs.mapInArrow(index, "digit long, content long, id long, sub long, at int, n int")
    found = found.repartition(n, "digit").sortWithinPartitions("digit", "content", "id", "sub", "at")
    found = materialize(found.mapInArrow(settle, FOUND), "blocks")

    edges = found.where("digit IS NOT NULL").groupBy(*key).agg(F.collect_set(F.struct("digit", "at", "n")).alias("edges"))
    rest = docs.join(edges, key).mapInArrow(fetch, "digit long, id long, sub long, at int, bytes binary")
    rest = rest.repartition(n, "digit").sortWithinPartitions("digit", "id")
    rest = materialize(rest.mapInArrow(sort, SORTED), "suffixes")
    large = rest.where("suffix IS NOT NULL").repartition(n, "suffix").sortWithinPartitions("suffix", "id")

    pieces = found.where("digit IS NULL").select(*key, "at", "n").unionByName(rest.where("suffix IS NULL").drop("suffix"))
    pieces = pieces.unionByName(large.mapInArrow(equal_suffixes, "id long, sub long, at int, n int"))
    pieces = pieces.groupBy(*key).agg(F.collect_set(F.struct("at", "n")).alias("pieces"))
    out = docs.join(pieces, key, "left").mapInArrow(finish, "id long, kept_bytes binary, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>")
    return out.select(F.expr(f"nullif(id, {NO_ID})").cast(df.schema[id_col].dataType).alias(id_col), "kept_bytes", "n_bytes", "n_removed", "spans")
