"""Byte-level BPE encoding and decoding with a rank file.

Within one piece of text, a segment tree over byte positions holds for each live position
the rank of the pair that starts there; its root is the leftmost pair of minimum rank. A
merge kills one position and changes the pairs of two neighbours, so it costs three point
updates of logarithmic length, and a piece of n bytes O(n log n), whatever its content. Nodes
have sixteen children: a word's tree is one node, a text of a million bytes has five levels.
Pieces are encoded once per task and remembered in a bounded table.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces remembered by one Python worker: a full table becomes the older one, in place of the
#: last, and pieces found there come back. Bounds memory only.
REMEMBERED = 150_000
LONGEST_REMEMBERED = 64
#: Children of a segment tree's node: few levels, each renewed by one call.
FAN = 16
#: Rows handed to Arrow at once hold about so many ids at most (a longer text goes alone).
IDS_PER_BATCH = 1_000_000
#: Decoded bytes that are gathered in one go: each takes some twenty bytes of places meanwhile.
BYTES_AT_ONCE = 250_000

# The letters, digits and blanks below U+0250: for texts of these characters alone the
# standard library's matcher takes the splitting pattern, at twice the speed.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼½¾"
_BLANKS = r"\t-\r \x85\xa0"
_BEYOND = re.compile("[^\x00-ɏ]")


@lru_cache(maxsize=2)
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of lowest rank until none is left.

    The lowest level of the tree holds rank * size + place of the pair that starts at each
    byte, so that the least value is the leftmost pair of least rank; every node above holds
    the least of its FAN children.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    size = len(piece)
    rank_of = ranks.get
    none = (len(ranks) + 1 << 1) * size * 4
    keys = [none] * size
    for at in range(size - 1):
        rank = rank_of(piece[at : at + 2])
        if rank is not None:
            keys[at] = rank * size + at
    levels = [keys]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[at : at + FAN]) for at in range(0, len(below), FAN)])
    top, inner = levels[-1], levels[1:]
    after = list(range(1, size + 2))  # next live position
    before = list(range(-1, size))

    while True:
        least = min(top)
        if least >= none:
            break
        at = least % size
        gone = after[at]
        end = after[gone]
        left = before[at]
        after[at] = end
        keys[gone] = none
        if end < size:
            before[end] = at
            rank = rank_of(piece[at : after[end]])
            keys[at] = none if rank is None else rank * size + at
        else:
            keys[at] = none
        if left >= 0:
            rank = rank_of(piece[left:end])
            keys[left] = none if rank is None else rank * size + left
        if inner:  # renew what lies above the three changed places
            below, changed = keys, {gone // FAN, at // FAN, max(left, 0) // FAN}
            for level in inner:
                for node in changed:
                    level[node] = min(below[node * FAN : node * FAN + FAN])
                below, changed = level, {node // FAN for node in changed}
    ids, at = [], 0
    while at < size:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class Encoder:
    """Encodes and decodes texts with one rank file and one splitting pattern."""

    def __init__(self, rank_path: str, pattern: str):
        import regex

        self.ranks = read_ranks(rank_path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces_of = regex.compile(pattern).findall
        self.quick_pieces_of = self.pieces_of
        if regex.compile(pattern).groups == 0 and r"\p" in pattern:
            quick = re.sub(r"(?<!\[)(?<!\[\^\\s)\\p\{L\}", f"[{_LETTERS}]", pattern)
            quick = re.sub(r"(?<!\\p\{L\})\\p\{N\}", f"[{_DIGITS}]", quick)
            quick = quick.replace(r"[^\s\p{L}\p{N}]", f"[^{_BLANKS}{_LETTERS}{_DIGITS}]")
            quick = quick.replace(r"\S", f"[^{_BLANKS}]").replace(r"\s", f"[{_BLANKS}]")
            if r"\p" not in quick:
                self.quick_pieces_of = re.compile(quick).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.whole: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def piece(self, piece: str) -> bytes:
        if len(piece) > LONGEST_REMEMBERED:
            return self._merged(piece)
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        ids = self.known[piece] = self.older.get(piece) or self._merged(piece)
        return ids

    def _merged(self, piece: str) -> bytes:
        return array("i", merged(piece.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers, one after another."""
        find = self.pieces_of if _BEYOND.search(text) else self.quick_pieces_of
        pieces = find(text)
        ids = list(map(self.known.get, pieces))
        if None in ids:
            piece = self.piece
            ids = [i or piece(p) for i, p in zip(ids, pieces, strict=True)]
        return b"".join(ids)

    def decoder(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes one after another, and where each id's begin and how many they are."""
        most = max(self.tokens, default=-1) + 1
        sizes = np.full(most, -1, np.int64)
        for rank, token in self.tokens.items():
            sizes[rank] = len(token)
        starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))[:most]
        joined = b"".join(self.tokens.get(rank, b"") for rank in range(most))
        return np.frombuffer(joined, np.uint8), starts, sizes

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of rows of ids: row r has ``ids[offsets[r]:offsets[r + 1]]``."""
        if self.whole is None:
            self.whole = self.decoder()
        data, starts, sizes = self.whole
        ends = np.zeros(len(ids) + 1, np.int64)
        for at in range(0, len(ids), BYTES_AT_ONCE):
            part = ids[at : at + BYTES_AT_ONCE].astype(np.int64)
            unknown = (part < 0) | (part >= len(sizes))
            if unknown.any() or (sizes[part] < 0).any():
                raise KeyError("an id that the rank file lacks")
            ends[at + 1 : at + 1 + len(part)] = sizes[part]
        ends = np.cumsum(ends)
        flat = np.empty(int(ends[-1]), np.uint8)
        at = 0
        while at < len(ids):  # ids of so many bytes at a time; a longer token goes alone
            till = int(np.searchsorted(ends, ends[at] + BYTES_AT_ONCE, "right")) - 1
            till = max(till, at + 1)
            first, lengths = ends[at:till], np.diff(ends[at : till + 1])
            # every byte's place among all tokens' bytes: its token's start, less where it begins here
            places = np.repeat(starts[ids[at:till].astype(np.int64)] - first, lengths)
            places += np.arange(ends[at], ends[till])
            flat[ends[at] : ends[till]] = data[places]
            at = till
        borders = ends[offsets]
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(borders), pa.py_buffer(flat)]
        )


@lru_cache(maxsize=2)
def encoder(rank_path: str, pattern: str) -> Encoder:
    return Encoder(rank_path, pattern)


def encoded(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    text: str = "text",
    name: str = "ids",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``name``, the ids of ``text`` as an array; null and empty texts have none.

    Each match of ``pattern`` is encoded by itself, without special tokens. ``rank_path``
    is a file that every executor has at the same place. ``keep``: the columns to carry
    (default all); an input column ``name`` is replaced. Rows keep their partitions; an empty
    table gives an empty one.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c != name]
    ids = T.StructField(name, T.ArrayType(T.IntegerType(), False), False)
    schema = T.StructType([*docs.select(*kept).schema.fields, ids])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_path, pattern)
        for batch in batches:
            start, held, offsets, values = 0, 0, [0], []
            for row, value in enumerate(batch.column(text)):
                found = value.as_py()
                if found:
                    values.append(own.encode(found))
                    held += len(values[-1]) // 4
                offsets.append(held)
                if held >= IDS_PER_BATCH or row + 1 == batch.num_rows:
                    flat = pa.Array.from_buffers(
                        pa.int32(), held, [None, pa.py_buffer(b"".join(values))]
                    )
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                    part = batch.slice(start, row + 1 - start)
                    columns = [*(part.column(c) for c in kept), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])
                    start, held, offsets, values = row + 1, 0, [0], []

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(encode, schema)


def decoded(
    tokens: DataFrame,
    rank_path: str,
    ids: str = "ids",
    name: str = "decoded",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``name``, the bytes that an array of ids stands for; null has no bytes.

    An id that the file lacks ends the job with a KeyError. ``keep`` as in ``encoded``; an empty
    table gives an empty one.
    """
    kept = [c for c in (keep if keep is not None else tokens.columns) if c != name]
    schema = T.StructType(
        [*tokens.select(*kept).schema.fields, T.StructField(name, T.BinaryType(), False)]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_path, "")
        for batch in batches:
            lists = batch.column(ids).fill_null([])
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            start = 0
            while start < len(lists):  # rows of so many ids at a time; a longer one goes alone
                end = int(np.searchsorted(offsets, offsets[start] + IDS_PER_BATCH, "right")) - 1
                end = min(max(end, start + 1), len(lists))
                own_ids = flat[offsets[start] : offsets[end]]
                values = own.decode(own_ids, offsets[start : end + 1] - offsets[start])
                part = batch.slice(start, end - start)
                columns = [*(part.column(c) for c in kept), values.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])
                start = end

    return tokens.select(*dict.fromkeys([*kept, ids])).mapInArrow(decode, schema)
