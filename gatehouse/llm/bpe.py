"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

Text is encoded piece by piece: a piece ends before a space that follows a character other than white space, where the
pre-tokenizer always cuts, so a piece's ids do not depend on what stands around it.  Pieces recur, so each worker
process remembers the ids of about ``MOST_PIECES`` pieces, then starts anew; the tokenizer sees only new ones, many joined in one
text, and the ids are told apart by their bytes.  Memory is bounded by that table, an Arrow batch and its longest text.

Byte-level BPE writes each byte as a character; ``byte_characters`` has the table.  Decoding reverses it to bytes.
Characters may be split over tokens: text is decoded from a whole document's bytes, offsets count a split character
for each of its tokens, and bytes that are no UTF-8 (ids cut within a character) become U+FFFD.

Nothing is shuffled.  Null texts count as empty and have no ids; the empty table gives an empty result; repeated rows
are encoded alike.  Ids are never dropped, texts are never cut.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LEAD, give_back, string_buffers

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MOST_PIECES, LONG_PIECE = 400_000, 48
#: Characters of text encoded at once; a single longer text makes a batch of its own.
BATCH_CHARS = 2_000_000
_UNSAFE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def byte_characters() -> list[str]:
    """The character that byte-level BPE writes for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def from_ranks(path: str, pattern: str) -> Tokenizer:
    """A tokenizer of a rank file (base64 bytes and rank a line).  Every way to put a token together from two others
    is a merge of that token's rank; a match that is itself a token is taken whole."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    as_text = byte_characters()
    name = {token: "".join(as_text[b] for b in token) for token in ranks}
    merges = [(name[token[:k]], name[token[k:]]) for token in sorted(ranks, key=ranks.__getitem__) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
    out = Tokenizer(models.BPE({name[token]: rank for token, rank in ranks.items()}, merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    out.decoder = decoders.ByteLevel()
    return out


class ByteBPE:
    """One vocabulary in one process.  ``path``: a tokenizer file (.json), or ranks for which ``pattern`` is needed.

    Where a text spells a special token, that is text like any other, or with ``special`` the token, as the library takes
    it by default; such a text is encoded as a whole."""

    def __init__(self, path: str, pattern: str | None = None, special: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path) if pattern is None else from_ranks(path, pattern)
        self.tokenizer.encode_special_tokens = not special
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if special and added else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            tokens[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.inner: dict[str, int] = {}  # pieces behind a space
        self.outer: dict[str, int] = {}  # pieces that begin a text
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.bounds, self.known = np.zeros(1 << 12, np.int64), 0

    def _keep(self, table: dict[str, int], pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Note the ids of pieces; ``ends`` has where each piece's end."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.known + len(pieces) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.empty_like(self.bounds)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.bounds[self.known + 1 : self.known + 1 + len(pieces)] = self.used + ends
        table.update(zip(pieces, range(self.known, self.known + len(pieces)), strict=True))
        self.used += len(ids)
        self.known += len(pieces)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, table: dict[str, int], pieces: list[str], lead: str) -> None:
        """Encode pieces one by one."""
        for k in range(0, len(pieces), 1000):
            found = self._raw([lead + x for x in pieces[k : k + 1000]])
            self._keep(table, pieces[k : k + 1000], np.concatenate(found), np.cumsum([len(x) for x in found]))

    def _joined(self, pieces: list[str]) -> None:
        """Encode pieces that end in no white space, many in one text."""
        for k in range(0, len(pieces), 20_000):
            some = pieces[k : k + 20_000]
            joined = " " + " ".join(some)
            ids = self._raw([joined])[0]
            raw = np.frombuffer(joined.encode(), np.uint8)
            cuts = np.append(np.flatnonzero(raw == 0x20)[1:], len(raw))
            ends = np.cumsum(self.size[ids])
            at = np.searchsorted(ends, cuts) + 1
            if len(cuts) != len(some) or not (ends[at - 1] == cuts).all():
                raise AssertionError("a token crosses the space between two pieces")
            self._keep(self.inner, some, ids, at)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds: one more than texts)."""
        if len(self.inner) + len(self.outer) > MOST_PIECES or self.used > 8 * MOST_PIECES:
            self._forget()
        pieces: list[str] = []
        heads: list[str] = []
        counts = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            if self.special and self.special.search(text):
                parts = [text]
            else:
                parts = _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
            heads.append(parts[0])
            pieces += parts[1:]
            counts[k] = len(parts)
        self._alone(self.outer, list(set(heads).difference(self.outer)), "")
        inner = np.fromiter(map(self.inner.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(inner < 0)
        if len(new):
            unknown = [pieces[k] for k in new.tolist()]
            fresh = list(dict.fromkeys(unknown))
            odd = [x for x in fresh if not x or len(x) > LONG_PIECE or " " in x or x[-1].isspace()]
            self._joined(list(set(fresh).difference(odd)) if odd else fresh)
            self._alone(self.inner, odd, " ")
            inner[new] = np.fromiter(map(self.inner.__getitem__, unknown), np.int64, len(unknown))
        codes = np.empty(len(heads) + len(pieces), np.int64)
        start = np.cumsum(counts) - counts
        first = np.zeros(len(codes), bool)
        first[start] = True
        codes[first] = list(map(self.outer.__getitem__, heads))
        codes[~first] = inner
        low = self.bounds[codes]
        size = self.bounds[codes + 1] - low
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        out = self.ids[np.repeat(low - (ends - size), size) + np.arange(total)]
        return out, np.concatenate([[0], ends])[np.append(start, len(codes))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all documents, bounds)."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.first[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at], np.concatenate([[0], ends])[bounds]

    def offsets(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one behind its last, counted in code points from its text's start."""
        data, edges = self.decode(ids, bounds)
        seen = np.concatenate([[0], np.cumsum(LEAD[data])])
        ends = np.cumsum(self.size[ids])
        starts = ends - self.size[ids]
        base = np.repeat(seen[edges[:-1]], np.diff(bounds))
        return seen[np.minimum(starts + 1, len(data))] - 1 - base, seen[ends] - base


@cache
def vocabulary(path: str, pattern: str | None = None, special: bool = False) -> ByteBPE:
    """The process's own copy."""
    return ByteBPE(path, pattern, special)


def text_batches(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, last row + 1, texts) of about ``BATCH_CHARS`` characters."""
    _, offsets = string_buffers(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BATCH_CHARS, side="right")) - 1)
        yield row, end, column.slice(row, end - row).fill_null("").to_pylist()
        row = end
    give_back()


Digest = Callable[[ByteBPE, np.ndarray, np.ndarray], dict[str, pa.Array]]


def encode(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, digest: tuple[Digest, str] | None = None) -> DataFrame:
    """``id_col``, ids (array<int>), and with ``offsets`` the arrays starts and ends.  A ``digest`` (function, schema)
    takes the ids of a batch in the worker that made them, and its columns stand in place of the arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for a, b, texts in text_batches(batch.column("text")):
                ids, bounds = bpe.encode(texts)
                if digest:
                    more = digest[0](bpe, ids, bounds)
                else:
                    listed = lambda x, at=pa.array(bounds.astype(np.int32)): pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32)))
                    more = {"ids": listed(ids)} | (dict(zip(("starts", "ends"), map(listed, bpe.offsets(ids, bounds)), strict=True)) if offsets else {})
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *more.values()], ["id", *more])

    kind = df.schema[id_col].dataType.simpleString()
    schema = digest[1] if digest else "ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {schema}")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, data (the exact bytes), text (as UTF-8; what is none becomes U+FFFD).  Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            data, bounds = bpe.decode(np.concatenate([np.empty(0, np.int64), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]))
            found = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in found], pa.string())], ["id", "data", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, data binary, text string").withColumnRenamed("id", id_col)
