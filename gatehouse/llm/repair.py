"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

Messages are kept (K, nothing), given another role (R, 2), deleted (D, 3; blank and repeated ones have to be) or inserted
without text (I, 2), and an undeleted message that breaks off costs 1 more.  The roles that are left begin, if at all, with
one system message and then go user, assistant, user ... assistant.  Of the cheapest edits those count whose initials,
the audit, come first in ASCII.

*Rank-compressed DP.*  A layer for each message has four states: nothing yet, system, user, assistant was last.  A macro
edit is a run of insertions and what happens to the message: "D", "ID", "IID", "IIK" ...  These codes are prefix-free, so
audits of as many macro edits compare as their codes do one by one, and a layer's audits as (rank of the audit before, code).
Hence a state has its cost, the rank of its audit among the layer's, and a pointer to its parent and code; the audit
itself is put together at the end from the pointers.  (More than two insertions in a row come back to a state that was
there before, at a higher cost.)  From a state there is one role to insert or to give, so audit and messages go together.

*Long conversations.*  Messages are sorted by ranges of (conversation, turn), so that a conversation may lie in many
tasks, each of which cuts it in segments of up to ``SEGMENT_ROWS`` messages.  A conversation that lies in one segment is done
there.  For any other, a segment is solved from all four states at once, with ranks common to the sixteen audits; that
again is a macro edit, and a layer of the same DP over segments, four bytes each, chooses the states between them.  Then
each segment is solved between its two states.  Only the SHA-256 of a conversation, which has no parts, is taken
by one task, which reads the repaired messages as a stream.

A null role or text counts as one space, a null conversation is one of its own.  Messages go by turn, nulls first; those
of one turn by role, the first 32 characters and a hash of the text.  Equal messages are interchangeable.  A role counts
by its first letter (s, u, a; any other has to go or change).  Conversations without messages (``alive`` is false for
all) have zeros, an empty audit and the hash of nothing.  The empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, numbered, partitions

SEGMENT_ROWS, SEGMENT_BYTES = 4096, 1 << 22
#: Conversations are solved together once they have so many messages.
TOGETHER_ROWS = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing, system, user, assistant last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or changed message leads to.
GIVEN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEXT = {(START, SYSTEM): SYSTEM, (START, USER): USER, (SYSTEM, USER): USER, (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER}
RUN = 2
CODES = sorted("I" * j + e for j in range(RUN + 1) for e in "DKR")
#: Faults, and the classes of messages that the costs know: fine, breaking off, to be deleted.
FINE, BLANK, REPEATED, BREAKS_OFF = range(4)
CLASS = np.array([0, 2, 2, 1])
NEVER = 1 << 40
#: Pairs of first letters that may stand side by side.
LEGAL = np.zeros((4, 4), bool)
LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True

CLOSED, TURN, ROW, OPEN = range(4)
OUT = "kind int, part int, segment int, nth long, conv long, edit string, role string, text string, fault int, numbers array<long>"
OUT_NAMES = ["kind", "part", "segment", "nth", "conv", "edit", "role", "text", "fault", "numbers"]
OUT_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
EMPTY = hashlib.sha256(b"").hexdigest()


def after(state: int, run: int) -> int:
    for _ in range(run):
        state = GIVEN[state]
    return state


def _macros() -> tuple[np.ndarray, np.ndarray]:
    """[role, class, state, next state] of a message: the least cost of a macro edit, and its code."""
    best = np.full((4, 3, 4, 4), NEVER * len(CODES))
    for role, kind, state, (code, edits) in ((r, k, s, c) for r in range(4) for k in range(3) for s in range(4) for c in enumerate(CODES)):
        here = after(state, len(edits) - 1)
        to, cost = {"D": (here, DELETE), "R": (GIVEN[here], REROLE), "K": (NEXT.get((here, role)), KEEP)}[edits[-1]]
        if to is None or kind == 2 and edits[-1] != "D":
            continue
        cost += INSERT * (len(edits) - 1) + TRUNCATED * (kind == 1 and edits[-1] != "D")
        best[role, kind, state, to] = min(best[role, kind, state, to], cost * len(CODES) + code)
    return best // len(CODES), best % len(CODES)


COST, CODE = _macros()
#: (state, insertions) after the last message that give a whole conversation.
ENDS = [(s, j) for s in range(4) for j in range(RUN + 1) if after(s, j) == ASSISTANT or (s, j) == (START, 0)]


class Layers:
    """Segments solved side by side: ``cost`` and ``rank`` [segment, lane, state] at the end, and pointers by layer.

    A lane is a state that a segment starts from: the one in ``start``, or all four."""

    def __init__(self, sizes: np.ndarray, role: np.ndarray, kind: np.ndarray, start: np.ndarray | None = None) -> None:
        n, lanes = len(sizes), 4 if start is None else 1
        self.order = np.argsort(-sizes, kind="stable")
        self.first = (np.cumsum(sizes) - sizes)[self.order]
        self.sizes = sizes[self.order]
        self.cost, self.rank = np.full((n, lanes, 4), NEVER), np.zeros((n, lanes, 4), np.int64)
        if start is None:
            self.cost[:, range(4), range(4)] = 0
        else:
            self.cost[np.arange(n), 0, start[self.order]] = 0
        self.pointers: list[np.ndarray] = []
        for t in range(int(sizes.max(initial=0))):
            m = int(np.searchsorted(-self.sizes, -t, side="left"))  # segments of more than t messages
            own = self.first[:m] + t
            self.step(m, COST[role[own], kind[own]][:, None], CODE[role[own], kind[own]][:, None])

    def step(self, m: int, cost: np.ndarray, code: np.ndarray) -> None:
        """A layer for the first m segments: macro edits of [segment, 1, state, next] by cost and code."""
        key = ((self.cost[:m, :, :, None] + cost) * 16 + self.rank[:m, :, :, None]) * 16 + code
        parent = key.argmin(2)
        key = np.take_along_axis(key, parent[:, :, None], 2)[:, :, 0]
        self.cost[:m] = np.minimum(key >> 8, NEVER)
        audit = np.where(self.cost[:m] < NEVER, key & 255, 256).reshape(m, -1)
        self.rank[:m] = (audit[:, :, None] > audit[:, None, :]).sum(2).reshape(self.rank[:m].shape) & 15
        self.pointers.append((parent | (key & 15) << 2).astype(np.uint8))

    def back(self, lane: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state before, code) of each message, on the way from a lane to an end state of each segment."""
        now, lane = end[self.order].copy(), lane[self.order]
        state, code = np.zeros(int(self.sizes.sum()), np.int64), np.zeros(int(self.sizes.sum()), np.int64)
        for t in range(len(self.pointers) - 1, -1, -1):
            m = len(self.pointers[t])
            found = self.pointers[t][np.arange(m), lane[:m], now[:m]]
            now[:m] = found & 3
            state[self.first[:m] + t], code[self.first[:m] + t] = found & 3, found >> 2
        return state, code

    def unsorted(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.order] = x
        return out


def close(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, last state, insertions behind it) of the cheapest whole conversation; cost and rank are [segment, state]."""
    key = np.stack([((cost[:, s] + INSERT * j) * 16 + rank[:, s]) * 4 + j for s, j in ENDS], 1)
    pick = key.argmin(1)
    return key[np.arange(len(key)), pick] >> 6, np.array([s for s, _ in ENDS])[pick], np.array([j for _, j in ENDS])[pick]


def edits(state: int, code: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(initial, role, text) of a macro edit."""
    for e in code:
        if e in "IR":
            state = GIVEN[state]
            yield e, NAMES[state], text if e == "R" else ""
        else:
            yield e, role, text


class Digest:
    """The audit of a conversation and the hash of what is left of it, message by message."""

    def __init__(self) -> None:
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.hash.update(f"{chr(10) * self.begun}{role}:{text}".encode())
            self.begun = True


def letters(roles: list[str]) -> np.ndarray:
    return np.array([{"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(r[:1], 0) for r in roles], np.int64)


class Segment:
    def __init__(self, conv: int | None, number: int, opened: bool) -> None:
        self.conv, self.number, self.opened, self.bytes = conv, number, opened, 0
        self.turns: list[int | None] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[int] = []

    def counts(self) -> list[int]:
        """[messages, blank, repeated, breaking off, illegal pairs, distinct turns, first and last turn, first and last letter]."""
        role, fault = letters(self.roles), np.array(self.faults, np.int64)
        turns = [t for t in self.turns if t is not None]
        illegal = int((~LEGAL[role[:-1], role[1:]]).sum())
        distinct = 1 + sum(a != b for a, b in zip(turns, turns[1:], strict=False)) if turns else 0
        edge = [turns[0], turns[-1]] if turns else [0, 0]
        return [len(role), *(int((fault == k).sum()) for k in (BLANK, REPEATED, BREAKS_OFF)), illegal, distinct, *edge, *(role[[0, -1]].tolist() if len(role) else [0, 0])]


def columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(OUT_TYPES), OUT_TYPES, strict=True)], OUT_NAMES)


class Solver:
    """Messages in order to closed conversations, and to the rows and transfers of open segments."""

    def __init__(self, part: int, turns: bool, most_rows: int, most_bytes: int, together: int) -> None:
        self.part, self.turns, self.most_rows, self.most_bytes, self.together = part, turns, most_rows, most_bytes, together
        self.now: Segment | None = None
        self.done: list[Segment] = []
        self.number = self.rows = 0

    def __call__(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for conv, turn, role, text, fault in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "fault")), strict=True):
            now = self.now
            if now is None:
                now = self.begin(conv, True)  # it may go on from the task before
            elif now.conv != conv:
                self.done.append(now)
                now = self.begin(conv, False)
            elif len(now.roles) >= self.most_rows or now.bytes >= self.most_bytes:
                now.opened = True
                self.done.append(now)
                now = self.begin(conv, True)
            if fault >= 0:
                now.turns.append(turn)
                now.roles.append(role)
                now.texts.append(text)
                now.faults.append(fault)
                now.bytes += len(text)
                self.rows += 1
            if len(self.done) > 1 and self.rows >= self.together:
                yield from self.solve()

    def begin(self, conv: int | None, opened: bool) -> Segment:
        self.now = Segment(conv, self.number, opened)
        self.number += 1
        return self.now

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.now:
            self.now.opened = True
            self.done.append(self.now)
            yield from self.solve()

    def solve(self) -> Iterator[pa.RecordBatch]:
        closed, opened = ([s for s in self.done if s.opened == x] for x in (False, True))
        self.done, self.rows = [], len(self.now.roles) if self.now else 0
        if closed:
            yield columns([*self.closed(closed)])
        for s in opened:
            size = np.array([len(s.roles)])
            layers = Layers(size, letters(s.roles), CLASS[np.array(s.faults, np.int64)])
            numbers = [*s.counts(), *layers.cost.ravel().tolist(), *layers.rank.ravel().tolist()]
            rows = [(ROW, self.part, s.number, k, s.conv, None, r, x, f, None) for k, (r, x, f) in enumerate(zip(s.roles, s.texts, s.faults, strict=True))]
            yield columns([*rows, (OPEN, self.part, s.number, None, s.conv, None, None, None, None, numbers)])

    def closed(self, segments: list[Segment]) -> Iterator[tuple]:
        sizes = np.array([len(s.roles) for s in segments])
        role = letters([r for s in segments for r in s.roles])
        kind = CLASS[np.array([f for s in segments for f in s.faults], np.int64)]
        layers = Layers(sizes, role, kind, np.zeros(len(segments), np.int64))
        cost, end, more = (layers.unsorted(x) for x in close(layers.cost[:, 0], layers.rank[:, 0]))
        state, code = (x.tolist() for x in layers.back(np.zeros(len(segments), np.int64), end))
        at = 0
        for k, s in enumerate(segments):
            told = Digest()
            for turn in written(s.roles, s.texts, state[at : at + len(s.roles)], code[at : at + len(s.roles)], int(end[k]), int(more[k])):
                if self.turns:
                    yield TURN, self.part, s.number, len(told.audit), s.conv, *turn, None, None
                told.add(*turn)
            at += len(s.roles)
            _, *faults, illegal, distinct, first, last, _, _ = s.counts()
            numbers = [last - first + 1 - distinct if distinct else 0, *faults, illegal, int(cost[k])]
            yield CLOSED, self.part, s.number, None, s.conv, "".join(told.audit), None, told.hash.hexdigest(), None, numbers


def written(roles: list[str], texts: list[str], state: list[int], code: list[int], end: int, more: int) -> Iterator[tuple[str, str, str]]:
    """(initial, role, text) of all edits of a segment, and of the insertions behind its last message."""
    for r, x, s, c in zip(roles, texts, state, code, strict=True):
        yield from edits(s, CODES[c], r, x)
    yield from edits(end, "I" * more, "", "")


def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open segments of conversations, in order, to the states (before, after) of each; the conversation's counts and the
    insertions behind it stand with its last segment."""
    conv, begun, keys, now, layers = None, False, [], [0] * 10, None
    last_read = 0  # the last segment with messages

    def finish() -> pa.RecordBatch:
        cost, end, more = close(layers.cost[:, 0], layers.rank[:, 0])
        states = [int(end[0])]
        for pointer in reversed(layers.pointers):
            states.append(int(pointer[0, 0, states[-1]]) & 3)
        states = states[::-1]
        _, *faults, illegal, distinct, first, last, _, _ = now
        numbers = [last - first + 1 - distinct if distinct else 0, *faults, illegal, int(cost[0])]
        tail = len(keys) - 1
        rows = [(*key, conv, a, b, int(more[0]) * (k == last_read), numbers if k == tail else None) for k, (key, a, b) in enumerate(zip(keys, states[:-1], states[1:], strict=True))]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "segment", "conv", "before", "behind", "more", "counts"])

    for batch in batches:
        for own, part, segment, numbers in zip(*(batch.column(x).to_pylist() for x in ("conv", "part", "segment", "numbers")), strict=True):
            if not begun or own != conv:
                if begun:
                    yield finish()
                conv, begun, keys, now, last_read = own, True, [], [0] * 10, 0
                layers = Layers(np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64))
            last_read = len(keys) if numbers[0] else last_read
            keys.append((part, segment))
            table = np.array(numbers[10:], np.int64).reshape(2, 1, 1, 4, 4)
            layers.step(1, table[0], table[1])
            now = joined(now, numbers[:10])
    if begun:
        yield finish()


def joined(a: list[int], b: list[int]) -> list[int]:
    """The counts of two segments side by side."""
    out = [x + y for x, y in zip(a[:6], b[:6], strict=True)]
    if a[0] and b[0]:
        out[4] += int(not LEGAL[a[9], b[8]])
    if a[5] and b[5]:
        out[5] -= int(a[7] == b[6])
    out += [(a if a[5] else b)[6], (b if b[5] else a)[7], (a if a[0] else b)[8], (b if b[0] else a)[9]]
    return out


def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of open segments, in order and with their states, to edits."""

    def solve() -> pa.RecordBatch:
        part, segment, conv, before, behind, more = key
        role, kind = letters([r for r, _, _ in held]), CLASS[np.array([f for _, _, f in held], np.int64)]
        layers = Layers(np.array([len(held)]), role, kind, np.array([before]))
        state, code = (x.tolist() for x in layers.back(np.zeros(1, np.int64), np.array([behind])))
        turns = written([r for r, _, _ in held], [x for _, x, _ in held], state, code, behind, more)
        return columns([(TURN, part, segment, k, conv, *turn, None, None) for k, turn in enumerate(turns)])

    key, held = None, []
    for batch in batches:
        for *own, role, text, fault in zip(*(batch.column(x).to_pylist() for x in ("part", "segment", "conv", "before", "behind", "more", "role", "text", "fault")), strict=True):
            if own != key:
                if held:
                    yield solve()
                key, held = own, []
            held.append((role, text, fault))
    if held:
        yield solve()


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order to the audit and hash of each conversation."""
    names = ["conv", "audit", "sha"]

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(now.audit)]), pa.array([now.hash.hexdigest()])], names)

    conv, now = None, None
    for batch in batches:
        for own, *turn in zip(*(batch.column(x).to_pylist() for x in ("conv", "edit", "role", "text")), strict=True):
            if now is None or own != conv:
                if now:
                    yield told()
                conv, now = own, Digest()
            now.add(*turn)
    if now:
        yield told()


def messages(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, alive: str | None) -> DataFrame:
    """(conv, turn, role, text, fault and the order of messages); fault is -1 where ``alive`` is false."""
    blank = F.lit(" \t\n\x0b\f\r")
    spoken = [F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    is_alive = F.col(alive) if alive else F.lit(True)
    # written first: rows that were made from one row of a file would share its place there
    rows = numbered(materialize(df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), *spoken, is_alive.alias("alive")), "messages"))
    rows = rows.withColumn("digest", F.md5("text"))
    place = F.struct("turn", "file_hash", "file_row")
    first = rows.where("alive").groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    first = first.select(*[F.col(c).alias(f"of_{c}") for c in ("conv", "role", "digest")], "first")
    same = F.col("conv").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    rows = rows.join(first, same, "left")
    end = F.right(F.rtrim(F.col("text"), blank), F.lit(1))
    fault = (
        F.when(~F.col("alive"), -1)
        .when(end == "", BLANK)
        .when(place > F.col("first"), REPEATED)
        .when(~end.isin(".", "!", "?"), BREAKS_OFF)
        .otherwise(FINE)
    )
    return rows.select("conv", "turn", "role", "text", fault.alias("fault"), F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("hash"), "file_hash", "file_row")


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", alive: str | None = None, turns: bool = False) -> DataFrame:
    """One row for each conversation: ``conv_col``, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 (of ``role:text``, joined by newlines).

    With ``turns``, instead one row for each edit: ``conv_col``, place (struct, in order), edit, role, text; those but
    D are the repaired messages.  ``alive`` names a boolean column: rows where it is false are no messages, but their
    conversation has a result."""
    n = partitions(df.sparkSession)
    own = df.schema[conv_col].dataType
    order = ["conv", "turn", "role", "head", "hash", "file_hash", "file_row"]
    rows = messages(df, conv_col, turn_col, role_col, text_col, alive)
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Solver(TaskContext.get().partitionId(), turns, SEGMENT_ROWS, SEGMENT_BYTES, TOGETHER_ROWS)
        for batch in batches:
            yield from state(batch)
        yield from state.end()

    found = materialize(rows.mapInArrow(run, OUT), "repaired")
    opened = found.where(F.col("kind") == OPEN).select("conv", "part", "segment", "numbers").repartition(n, "conv").sortWithinPartitions("conv", "part", "segment")
    states = materialize(opened.mapInArrow(compose, "part int, segment int, conv long, before int, behind int, more int, counts array<long>"), "states")
    rest = found.where(F.col("kind") == ROW).select("part", "segment", "nth", "role", "text", "fault").join(states.drop("counts"), ["part", "segment"])
    rest = rest.repartition(n, "part", "segment").sortWithinPartitions("part", "segment", "nth").mapInArrow(between, OUT)
    if turns:
        out = found.where(F.col("kind") == TURN).unionByName(rest)
        return out.select(F.col("conv").cast(own).alias(conv_col), F.struct("part", "segment", "nth").alias("place"), "edit", "role", "text")
    read = rest.repartition(n, "conv").sortWithinPartitions("conv", "part", "segment", "nth").mapInArrow(digests, "conv long, audit string, sha string")
    counted = states.where("counts IS NOT NULL").select(F.col("conv").alias("of"), F.col("counts").alias("numbers"))
    long = counted.join(read, F.col("of").eqNullSafe(F.col("conv")), "left").select(F.col("of").alias("conv"), "numbers", F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(EMPTY)).alias("sha"))
    short = found.where(F.col("kind") == CLOSED).select("conv", "numbers", F.col("edit").alias("audit"), F.col("text").alias("sha"))
    out = short.unionByName(long)
    return out.select(F.col("conv").cast(own).alias(conv_col), *[F.col("numbers")[k].alias(c) for k, c in enumerate(COUNTS)], "audit", F.col("sha").alias("repaired_sha256"))
