"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A piece (one match of the pattern) is halved down to short leaves, leaves are merged
directly, and neighbours are joined: the window around the seam is encoded anew and grows
on a side until its outer token and the next token outside stay apart when encoded
together.  A token sequence is the encoding of its bytes exactly when every neighbouring
pair of tokens encodes to itself, so such a window proves that nothing outside changes.
Pieces of a text concatenate, which is the same reduction with nothing to repair.

Defined cases: a null text encodes like an empty one (no ids); rows are independent, so
repeated rows, empty tables and very long texts need nothing special; other columns pass.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, blocks, with_fields

LEAF = 16
#: Above every rank.
NONE = 1 << 31
#: Pieces remembered by a worker; beyond, it forgets all and goes on (only speed changes).
#: Tokens of a leaf of the decoding tree.
DECODED = 4_096
REMEMBERED = 120_000


class Ranks:
    """Merge ranks of a ``.tiktoken`` file and the tree reduction over them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        self._apart: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost first, without any tree."""
        if len(data) > 64:
            return self._merge_long(data)
        get, cut = self.ids.get, list(range(len(data) + 1))
        ranks = [get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while ranks and (low := min(ranks)) != NONE:
            at = ranks.index(low)
            del cut[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(data[cut[at] : cut[at + 2]], NONE)
            if at:
                ranks[at - 1] = get(data[cut[at - 1] : cut[at + 1]], NONE)
        return [self.ids[data[i:j]] for i, j in pairwise(cut)]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list of parts."""
        ids, n = self.ids, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is data[i:end[i]]
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ids.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not live[i] or j >= n or end[j] != stop:
                continue
            live[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ids.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = before[i]
            if h >= 0 and (r := ids.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ids[data[i : end[i]]])
            i = end[i]
        return out

    def apart(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens encode to themselves."""
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) > REMEMBERED:
                self._apart.clear()
            known = self._apart[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' bytes together."""
        if not left or not right:
            return left or right
        if self.apart(left[-1], right[0]):
            return left + right
        i, j, step_l, step_r = len(left) - 1, 1, 1, 1
        while True:
            window = self.merge(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            ok_l = i == 0 or self.apart(left[i - 1], window[0])
            ok_r = j == len(right) or self.apart(window[-1], right[j])
            if ok_l and ok_r:
                return left[:i] + window + right[j:]
            if not ok_l:
                i, step_l = max(0, i - step_l), step_l * 2
            if not ok_r:
                j, step_r = min(len(right), j + step_r), step_r * 2

    def encode_piece(self, data: bytes) -> list[int]:
        """One match of the pattern: a known token, a leaf, or the join of its halves."""
        known = self.ids.get(data)
        if known is not None:
            return [known]
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def decode(self, ids: list[int]) -> bytes:
        """Leaves of some tokens, concatenated in pairs up the tree."""
        return concatenated([b"".join(map(self.bytes_of.__getitem__, ids[i : i + DECODED])) for i in range(0, len(ids), DECODED)])


def concatenated(parts: list[bytes]) -> bytes:
    """Neighbours joined in pairs, level by level."""
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else b""


class _Pieces(dict):
    """Piece to the bytes of its ids (int32), filled on demand."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = array("i", self.ranks.encode_piece(piece.encode())).tobytes()
        return out


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add ``ids`` (array<int>), the tokens of the whole ``text`` without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, pieces = regex.compile(pattern).findall, _Pieces(Ranks(ranks_path))
        for batch in blocks(batches, text):
            out, offsets = [], [0]
            for s in batch.column(batch.schema.get_field_index(text)):
                s = s.as_py()
                out.append(b"".join(map(pieces.__getitem__, split(s))) if s else b"")
                offsets.append(offsets[-1] + len(out[-1]) // 4)
                if len(pieces) > REMEMBERED:
                    pieces.clear()
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(out))])
            yield append(batch, {ids: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)})

    return df.mapInArrow(run, with_fields(df, [(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary), the bytes that ``ids`` stand for; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(Ranks(ranks_path).bytes_of, pa.large_binary())
        for batch in blocks(batches, ids):
            col = batch.column(batch.schema.get_field_index(ids))
            col = pc.if_else(col.is_valid(), col, pa.scalar([], col.type)) if col.null_count else col
            # The leaves: taking the ids' bytes in order lays them end to end.
            tokens = vocabulary.take(col.flatten())
            ends = np.cumsum(pc.list_value_length(col).to_numpy())
            place = np.frombuffer(tokens.buffers()[1], np.int64, len(tokens) + 1) if len(tokens) else np.zeros(1, np.int64)
            data = memoryview(tokens.buffers()[2]) if len(tokens) else memoryview(b"")
            texts = []
            for i, j in zip([0, *ends[:-1].tolist()], ends.tolist()):
                cuts = place[[*range(i, j, DECODED), j]].tolist()
                texts.append(concatenated([bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]))
            yield append(batch, {out: pa.array(texts, pa.binary())})

    return df.mapInArrow(run, with_fields(df, [(out, T.BinaryType())]))


def digests(df: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    return df.withColumns(
        {
            "n_tokens": F.size(ids).cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256),
            "decoded_sha256": F.sha2(F.col(decoded), 256),
        }
    )
