"""Substring dedup by relative Lempel-Ziv parsing against an index of all documents.

A document is parsed against everything that stands before it (documents of smaller id, and its own beginning).  The
parse is greedy: from the place that it has reached it takes the longest match that any reference block offers and
goes on at its end, looking back from there at matches that begin before the end and reach beyond it.  A match of at
least ``window`` words is a factor, and the words of factors are the duplicates: a word goes exactly if some window
over it starts earlier elsewhere.

*Index.*  Every window has an anchor: its smallest hash of ``gram`` consecutive words.  Windows that follow each other
mostly share it, so the index has a reference block for about one word in eight: the anchor, and a hash of all words of
the windows that it anchors.  Equal windows have equal anchors wherever they stand.  Runs of words that are common in
a sample of documents count as large, so that a frequent phrase anchors only windows made of such phrases alone; the
sample sets the anchors, and with them the cost, but never the result.
1. Blocks are shuffled by anchor.  A block that has occurred earlier makes all its windows copies: a match.
   A block whose anchor occurs once is new.  A block that comes first with its content, while its anchor also stands
   in other blocks, is the boundary of a match: the words agree up to somewhere within it.
2. Boundaries alone are checked window by window: two independent 64-bit hashes of each of their windows, aggregated
   to the earliest place and joined back.
3. The matches of a document are parsed into factors, and its text is cut.

Blocks that repeat within an Arrow batch are combined before the shuffle, so a passage in a third of all documents
costs a row a batch.  The joins of step 2 and 3 split under AQE.  Texts are shuffled by document twice, once in each
of these steps.  Words are hashed twice, independently: anchors rest on the one hash and blocks on the other, windows
on both, so two places are taken for equal by mistake only if 64 bits each of two hashes agree (for a block, of the
second one alone where the places differ outside the anchor).

Null texts have no words.  A null id counts as smaller than any.  Rows that repeat id and text count as one document,
whose blocks and matches combine before each shuffle, and each gets its result; rows that repeat only the id are
documents of their own, in the order of a hash of the text: a document is (id, sub), sub being all 64 bits of the
text's XXH64.  The id is an integer.  The empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, partitions
from ._text import Words, chunks, mix, ngrams, signed, spans_hash

WINDOW, GRAM = 20, 6
#: Documents that tell which runs of words are common: those that one in ``COMMON_SHARE`` has, at most so many.
SAMPLE_ROWS, COMMON_SHARE, MOST_COMMON = 1 << 12, 256, 1 << 16
NO_ID = -(1 << 63)
#: ``sub`` tells apart documents that share an id; ``at`` is the number of a word.
PIECE = "id long, sub long, at long, n int, ref_id long, ref_sub long, ref_at long"
BLOCK = f"anchor long, block long, {PIECE}"
PIECE_NAMES = ["id", "sub", "at", "n", "ref_id", "ref_sub", "ref_at"]


def known(g: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which entries are in the sorted array ``common``; most are ruled out by 16 of their bits."""
    out = np.zeros(len(g), bool)
    if len(common):
        low = np.zeros(1 << 16, bool)
        low[common & np.uint64(0xFFFF)] = True
        maybe = np.flatnonzero(low[g & np.uint64(0xFFFF)])
        out[maybe] = common[np.minimum(np.searchsorted(common, g[maybe]), len(common) - 1)] == g[maybe]
    return out


def blocks(words: Words, window: int, gram: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, block, first window, number of windows) of each block of these texts."""
    hashes = words.hashes()
    n, span = len(hashes) - window + 1, window - gram + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    g = ngrams(hashes, gram)
    ranked = (g >> np.uint64(1)) | (known(g, common).astype(np.uint64) << np.uint64(63))
    low, at = ranked[:n].copy(), np.arange(n)
    place = at.copy()
    for j in range(1, span):
        less = ranked[j : j + n] < low
        np.copyto(low, ranked[j : j + n], where=less)
        np.copyto(place, at + j, where=less)
    starts = np.flatnonzero(words.doc[window - 1 :] == words.doc[:n])
    place = place[starts]
    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
    first, count = starts[heads], np.diff(np.append(heads, len(starts)))
    with np.errstate(over="ignore"):
        block = spans_hash(words.hashes(other=True), first, first + count - 1 + window) + mix((place[heads] - first).astype(np.uint64) + np.uint64(1))
    return g[place[heads]], block, first, count


def record(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)


def block_rows(batch: pa.RecordBatch, window: int, gram: int, common: np.ndarray) -> pa.RecordBatch:
    """The blocks of a batch.  Those that repeat within it point to the earliest (ref_id, ref_sub, ref_at), and get an anchor
    of their own that spreads them."""
    parts = []
    ids, subs = batch.column("id").to_numpy(), batch.column("sub").to_numpy().astype(np.int64)
    for a, b, data, offsets in chunks(batch.column("text")):
        words = Words(data, offsets)
        anchor, block, first, count = blocks(words, window, gram, common)
        doc = words.doc[first]
        parts.append((anchor, block, ids[a:b][doc], subs[a:b][doc], first - words.first[doc], count.astype(np.int32)))
    anchor, block, own, sub, at, count = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3, np.empty(0, np.int32))
    ref_id, ref_sub, ref_at, has = *(np.zeros(len(own), np.int64) for _ in range(3)), np.zeros(len(own), bool)
    again = np.zeros(len(own), bool)  # the same place of a repeated row
    ordered = np.sort(block)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        rows = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, block), len(twice) - 1)] == block)
        rows = rows[np.lexsort((at[rows], sub[rows], own[rows], anchor[rows], block[rows]))]
        head = np.concatenate([[True], (block[rows[1:]] != block[rows[:-1]]) | (anchor[rows[1:]] != anchor[rows[:-1]])])
        lead = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
        again[rows[1:]] = ~head[1:] & (own[rows[1:]] == own[rows[:-1]]) & (sub[rows[1:]] == sub[rows[:-1]]) & (at[rows[1:]] == at[rows[:-1]])
        later = (own[rows] != own[lead]) | (sub[rows] != sub[lead]) | (at[rows] != at[lead])
        rows, lead = rows[later], lead[later]
        has[rows], ref_id[rows], ref_sub[rows], ref_at[rows] = True, own[lead], sub[lead], at[lead]
        with np.errstate(over="ignore"):
            anchor[rows] = mix(own[rows].view(np.uint64) + mix(sub[rows].view(np.uint64) + mix(at[rows].view(np.uint64))))
        block[rows] = 0
    once = np.flatnonzero(~again)
    refs = (pa.array(x[once], mask=~has[once]) for x in (ref_id, ref_sub, ref_at))
    return record([signed(anchor[once]), signed(block[once]), own[once], sub[once], at[once], count[once], *refs], ["anchor", "block", *PIECE_NAMES])


class Settle:
    """Goes through blocks sorted by anchor, block, id, sub, at.  Gives copies with the first place of their block, and
    boundaries (ref null); what a batch leaves open is carried into the next."""

    def __init__(self) -> None:
        self.last: tuple | None = None  # anchor, block, first id, sub and at of the block
        self.pending: tuple | None = None  # the first block of the last anchor, while that has no other

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = batch.column("ref_id").is_valid().to_numpy(zero_copy_only=False)
        out = PIECE_NAMES
        if known.any():
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(known)) for x in out], out)
        anchor, block, own, sub, at, n = (batch.column(x).to_numpy()[~known] for x in ("anchor", "block", "id", "sub", "at", "n"))
        if not len(anchor):
            return
        nth = np.arange(len(anchor))
        new_anchor, new_block = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_block[1:] = new_anchor[1:] | (block[1:] != block[:-1])
        if self.last:
            new_anchor[0] = anchor[0] != self.last[0]
            new_block[0] = new_anchor[0] or block[0] != self.last[1]
        head = np.maximum.accumulate(np.where(new_block, nth, -1))
        first_id, first_sub, first_at = own[head], sub[head], at[head]
        if self.last:
            first_id[head < 0], first_sub[head < 0], first_at[head < 0] = self.last[2:]
        later = ~new_block & ((own != first_id) | (sub != first_sub) | (at != first_at))
        if later.any():
            yield record([x[later] for x in (own, sub, at, n, first_id, first_sub, first_at)], out)
        heads = np.flatnonzero(new_block)
        if len(heads):
            alone = new_anchor[heads]
            followed = np.append(~alone[1:], False)
            edge = heads[~alone | followed]
            rows = [(own[edge], sub[edge], at[edge], n[edge])]
            if not alone[0] and self.pending:
                rows.append(tuple(np.array([x]) for x in self.pending))
            if not alone[0] or alone.any():
                self.pending = None
            if alone[-1]:
                self.pending = (own[heads[-1]], sub[heads[-1]], at[heads[-1]], n[heads[-1]])
            found = [np.concatenate(c) for c in zip(*rows, strict=True)]
            if len(found[0]):
                yield record([*found, *[pa.nulls(len(found[0]), pa.int64())] * 3], out)
        self.last = (anchor[-1], block[-1], first_id[-1], first_sub[-1], first_at[-1])


def listed(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each entry, fields) of a column of lists of structs; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, rows = column.flatten(), column.value_parent_indices() if hasattr(column, "value_parent_indices") else None
    if rows is None:
        import pyarrow.compute as pc

        rows = pc.list_parent_indices(column)
    return rows.to_numpy(), [flat.field(x).to_numpy() for x in names]


def boundary_windows(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, id, sub, at) of each window of the blocks listed in the column edges."""
    row, (place, n) = listed(batch.column("edges"), ("at", "n"))
    ids, subs = batch.column("id").to_numpy(), batch.column("sub").to_numpy().astype(np.int64)
    for a, b, data, offsets in chunks(batch.column("text")):
        mine = (row >= a) & (row < b)
        words = Words(data, offsets)
        doc, count = np.repeat(row[mine] - a, n[mine]), n[mine].astype(np.int64)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(place[mine], count) + within
        at = words.first[doc] + start
        if len(at):
            yield record([signed(ngrams(words.hashes(), window, 1)[at]), signed(ngrams(words.hashes(other=True), window, 2)[at]), ids[a:b][doc], subs[a:b][doc], start], ["h1", "h2", "id", "sub", "at"])


FACTOR = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref_id", pa.int64()), ("ref_start", pa.int64())])


def parse(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The greedy parse: which of these matches, in the order of their starts, become factors.  From the place reached
    the match goes on farthest that begins there or before; without one the parse goes to the next match's start."""
    n = len(start)
    if not n:
        return np.empty(0, np.int64)
    reach = np.maximum.accumulate(end)
    fresh = np.ones(n, bool)
    fresh[1:] = reach[1:] > reach[:-1]
    farthest = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)).tolist()
    starts, ends, reach = start.tolist(), end.tolist(), reach.tolist()
    factors, place, k = [], -1, 0
    while (k := bisect_right(reach, place, k)) < n:
        last = bisect_right(starts, max(place, starts[k]), k) - 1
        factors.append(farthest[last])
        place, k = ends[farthest[last]], last + 1
    return np.array(factors, np.int64)


def cut(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """Factors of each text, and what they leave of it."""
    row, (place, n, ref_id, ref_sub, ref_at) = listed(batch.column("pieces"), ("at", "n", "ref_id", "ref_sub", "ref_at"))
    for a, b, data, offsets in chunks(batch.column("text")):
        words = Words(data, offsets)
        mine = (row >= a) & (row < b)
        doc, start, count = row[mine] - a, place[mine], n[mine].astype(np.int64)
        source, sub, back = ref_id[mine], ref_sub[mine], ref_at[mine] - start
        order = np.lexsort((start, back, sub, source, doc))
        doc, start, count, source, sub, back = (x[order] for x in (doc, start, count, source, sub, back))
        # pieces that go on with the same copy are one match
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (sub[1:] != sub[:-1]) | (back[1:] != back[:-1]) | (start[1:] > start[:-1] + count[:-1])
        heads = np.flatnonzero(fresh)
        end = np.maximum.reduceat(start + count, heads) + window - 1 if len(heads) else np.empty(0, np.int64)
        doc, start, source, back = doc[heads], start[heads], source[heads], back[heads]
        order = np.lexsort((start, doc))
        doc, start, end, source, back = (x[order] for x in (doc, start, end, source, back))
        chosen = parse(words.first[doc] + start, words.first[doc] + end)
        doc, start, end, source, back = (x[chosen] for x in (doc, start, end, source, back))
        step = np.zeros(len(words.doc) + 1, np.int64)
        np.add.at(step, words.first[doc] + start, 1)
        np.add.at(step, words.first[doc] + end, -1)
        gone = np.cumsum(step)[:-1] > 0
        factors = pa.StructArray.from_arrays([pa.array(start), pa.array(end - start), pa.array(source), pa.array(start + back)], fields=list(FACTOR))
        bounds = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
        follow = np.append(words.starts[1:], len(data))
        last = words.first[1:] - 1
        has = words.counts > 0
        follow[last[has]] = offsets[1:][has]
        drop = np.zeros(len(data) + 1, np.int32)
        drop[words.starts[gone]] += 1
        np.add.at(drop, follow[gone], -1)
        keep = np.cumsum(drop[:-1]) == 0
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=sums[1:])
        text = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(np.ascontiguousarray(sums[offsets])), pa.py_buffer(data[keep].tobytes()))
        removed = np.bincount(words.doc[gone], minlength=b - a)
        yield record([batch.column("id").slice(a, b - a), text.cast(pa.string()), words.counts, removed, pa.ListArray.from_arrays(bounds, factors)], ["id", "text", "n_words", "n_removed", "factors"])


def common_runs(docs: DataFrame, gram: int) -> np.ndarray:
    """Hashes, sorted, of the runs of ``gram`` words that are common in a sample of ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets)
                g = ngrams(words.hashes(), gram)
                inside = np.flatnonzero(words.doc[gram - 1 :] == words.doc[: len(g)])
                order = np.lexsort((g[inside], words.doc[inside]))
                doc, g = words.doc[inside][order], g[inside][order]
                once = np.ones(len(g), bool)
                once[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
                yield pa.RecordBatch.from_arrays([signed(g[once])], ["run"])

    rows = docs.count()
    some = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0).select("text")
    times = some.mapInArrow(run, "run long").groupBy("run").agg(F.count(F.lit(1)).alias("times"))
    found = times.where(F.col("times") > max(8, min(rows, SAMPLE_ROWS) // COMMON_SHARE)).orderBy(F.desc("times"), "run").limit(MOST_COMMON).toArrow()
    return np.sort(found.column("run").to_numpy().view(np.uint64))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, text (what stays, with the spaces behind kept words), n_words,
    n_removed, factors (array of start, length in words, ref_id, ref_start: the duplicate spans), and the columns
    ``carry`` of ``df`` as carry_<name>."""
    if not 1 <= gram <= window:
        raise ValueError("1 <= gram <= window")
    if df.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("the id is an integer")
    n = partitions(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs_columns = (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("sub"), text.alias("text"))
    docs = df.select(*docs_columns)
    common = common_runs(docs, gram)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield block_rows(batch, window, gram, common)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Settle()
        for batch in batches:
            yield from state(batch)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from boundary_windows(batch, window)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = pa.Table.from_batches(cut(batch, window)) if batch.num_rows else None
            for name in [f"carry_{c}" for c in carry] if done else []:
                done = done.append_column(name, pa.chunked_array([batch.column(name)]))
            yield from done.to_batches() if done else []

    key = ["id", "sub"]
    place = F.struct("id", "sub", "at")
    found = docs.mapInArrow(index, BLOCK).repartition(n, "anchor").sortWithinPartitions("anchor", "block", "id", "sub", "at")
    found = materialize(found.mapInArrow(settle, PIECE), "blocks")

    edges = found.where("ref_id IS NULL").groupBy(*key).agg(F.collect_set(F.struct("at", "n")).alias("edges"))
    windows = docs.join(edges, key).mapInArrow(check, "h1 long, h2 long, id long, sub long, at long")
    windows = materialize(windows, "boundaries")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    copies = windows.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(place > F.col("first"))
    pieces = found.where("ref_id IS NOT NULL").unionByName(copies.select(*key, "at", F.lit(1).alias("n"), *[F.col(f"first.{c}").alias(f"ref_{c}") for c in ("id", "sub", "at")]))
    pieces = pieces.groupBy(*key).agg(F.collect_set(F.struct("at", "n", "ref_id", "ref_sub", "ref_at")).alias("pieces"))
    full = df.select(*docs_columns, *[F.col(c).alias(f"carry_{c}") for c in carry])
    schema = "id long, text string, n_words long, n_removed long, factors array<struct<start:long,length:long,ref_id:long,ref_start:long>>"
    more = "".join(f", `carry_{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    out = full.join(pieces, key, "left").mapInArrow(finish, schema + more)
    return out.select(F.expr(f"nullif(id, {NO_ID})").cast(df.schema[id_col].dataType).alias(id_col), "text", "n_words", "n_removed", "factors", *[f"carry_{c}" for c in carry])
