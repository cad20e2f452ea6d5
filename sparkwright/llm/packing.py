"""Operator 2: vector bin packing of tokenized examples into training sequences.

Every example is a vector of three demands: its tokens, one segment, and its
loss-bearing tokens (the last ones of the example).  A sequence has a limit on
each.  Sequences are filled one at a time; the next piece is the one whose
demand has the largest dot product with the room that is left, among those
that fit.  When none fits, the one with the largest dot product is cut to fill
the tokens that are left, and its rest goes back to the pool.

Scale: examples are packed inside the task that reads them, through a pool of
at most ``POOL`` pieces, so no row is shuffled and memory is bounded by the
pool and one example.  The rest of a task's rows goes into sequences whose
lengths are powers of two, which need no padding, so many small tasks cost no
more padding than a few large ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkwright.llm.common import prepared
from sparkwright.llm.tokens import tokenizer, tokenizer_path

POOL = 1024                   # pieces that wait at once in a task

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("loss_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("each limit must be at least 1")

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], dtype=np.int64)


@dataclass
class Piece:
    """Ids ``[start, end)`` of one example; the last ``loss`` ids of the example bear loss."""
    doc_id: int | None
    ids: bytes
    n: int
    loss: int
    start: int
    end: int

    def loss_in(self, start: int, end: int) -> int:
        return max(0, end - max(start, self.n - self.loss))

    def demand(self) -> tuple[int, int, int]:
        return self.end - self.start, 1, self.loss_in(self.start, self.end)

    def most(self, room: np.ndarray) -> int:
        """Tokens of the piece's head that fit into ``room``."""
        take = min(self.end - self.start, int(room[0]))
        first_loss = max(self.start, self.n - self.loss)
        return min(take, first_loss - self.start + int(room[2]))


class Packer:
    """Fills sequences from a pool of pieces; ``out`` gets (piece, start, end, sequence, offset)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.pool: list[Piece] = []
        self.demand = np.zeros((POOL, 3), dtype=np.int64)     # of the pool's pieces, one row each
        self.sequences = 0
        self.out: list[tuple[Piece, int, int, int, int]] = []

    def add(self, doc_id, ids: bytes, loss: int | None = None) -> None:
        n = len(ids) // 4
        if not n:
            return
        piece = Piece(doc_id, ids, n, n if loss is None else min(loss, n), 0, n)
        lim = self.limits
        # an example as long as a sequence fills sequences of its own, up to its rest
        while piece.end - piece.start >= lim.tokens and \
                piece.loss_in(piece.start, piece.start + lim.tokens) <= lim.loss_tokens:
            self._put(piece, piece.start + lim.tokens, self._open(), 0)
        if piece.start < piece.end:
            if len(self.pool) == len(self.demand):     # pieces of too few tokens for a sequence wait beyond POOL
                self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
            self.demand[len(self.pool)] = piece.demand()
            self.pool.append(piece)
        if len(self.pool) >= POOL:
            self._fill(self.limits.tokens, POOL // 2)

    def finish(self) -> None:
        """Pack all that waits: full sequences first, then lengths that are powers of two."""
        self._fill(self.limits.tokens, 0)
        while self.pool:
            left = min(self._waiting(), self.limits.tokens)
            self._one(1 << (left.bit_length() - 1))

    def _waiting(self) -> int:
        return int(self.demand[:len(self.pool), 0].sum())

    def _open(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _put(self, piece: Piece, end: int, sequence: int, offset: int) -> int:
        self.out.append((piece, piece.start, end, sequence, offset))
        taken = end - piece.start
        piece.start = end
        return taken

    def _fill(self, tokens: int, keep: int) -> None:
        """Fill sequences of ``tokens`` while more than ``keep`` pieces, and enough tokens, wait."""
        waiting = self._waiting()
        while len(self.pool) > keep and waiting >= tokens:
            waiting -= self._one(tokens)

    def _one(self, tokens: int) -> int:
        """Fill one sequence of ``tokens`` at most; returns the tokens it got."""
        full = self.limits.vector()
        room = full.copy()
        room[0] = tokens
        weight = full.astype(np.float64)
        demand = self.demand[:len(self.pool)]
        scaled = demand / weight
        live = np.ones(len(self.pool), dtype=bool)
        sequence, offset, used = self._open(), 0, []
        while room[0] > 0 and room[1] > 0 and live.any():
            gain = scaled @ (room / weight)
            fits = live & (demand[:, 0] <= room[0]) & (demand[:, 2] <= room[2])      # each piece is one segment
            whole = fits.any()
            i = int(np.where(fits if whole else live, gain, -1.0).argmax())
            piece = self.pool[i]
            take = piece.end - piece.start if whole else piece.most(room)
            live[i] = False
            if take <= 0:          # no room for its loss tokens: look at the others
                continue
            room -= (take, 1, piece.loss_in(piece.start, piece.start + take))
            offset += self._put(piece, piece.start + take, sequence, offset)
            used.append(i)
        if offset < tokens:       # another limit ended it: give back what lies beyond a power of two, which needs no padding
            offset = self._trim(offset, 1 << (offset.bit_length() - 1))
        self._leave(used)
        return offset

    def _leave(self, used: list[int]) -> None:
        """Measure the pieces at ``used`` again and drop those without rest from the pool."""
        gone = []
        for i in used:
            piece = self.pool[i]
            if piece.start < piece.end:
                self.demand[i] = piece.demand()
            else:
                gone.append(i)
        if gone:
            left = np.delete(self.demand[:len(self.pool)], gone, axis=0)
            self.demand[:len(left)] = left
            for i in sorted(gone, reverse=True):
                del self.pool[i]

    def _trim(self, offset: int, target: int) -> int:
        """Give the last sequence's tokens beyond ``target`` back to their pieces."""
        while offset > target:
            piece, start, end, sequence, at = self.out.pop()
            keep = max(0, end - start - (offset - target))
            offset -= end - start - keep
            piece.start = start + keep
            if keep:
                self.out.append((piece, start, start + keep, sequence, at))
        return target


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None,
         tokenizer_file: str | None = None, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Tokenize whole texts, append ``end_id`` and pack all ids into sequences.

    Returns one row per piece: the example's id, the piece's place in its
    example, a checksum of its ids, the example's ids in all, its sequence and
    place there, its loss-bearing tokens and the ids themselves (little-endian
    uint32).  Each id lies in exactly one piece.

    A null or empty text is one ``end_id``.  Repeated rows and null ids are
    packed like any other row; an empty table gives no rows; a very long text
    spans many sequences.  ``loss_col`` names a count of loss-bearing ids at an
    example's end (null or no column: all of them).  Other columns are ignored.
    """
    path = tokenizer_file or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")
    cols = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")]
    if loss_col:
        cols.append(docs[loss_col].cast("long").alias("loss"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_bytes
        base = TaskContext.get().partitionId() << 33
        packer = Packer(limits)

        def flush() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            ids = [p.ids[4 * s:4 * e] for p, s, e, _, _ in out]
            return pa.RecordBatch.from_arrays([
                pa.array([p.doc_id for p, *_ in out], pa.int64()),
                pa.array([s for _, s, _, _, _ in out], pa.int64()),
                pa.array([e - s for _, s, e, _, _ in out], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([p.n for p, *_ in out], pa.int64()),
                pa.array([base + q for _, _, _, q, _ in out], pa.int64()),
                pa.array([o for *_, o in out], pa.int64()),
                pa.array([p.loss_in(s, e) for p, s, e, _, _ in out], pa.int64()),
                pa.array(ids, pa.binary()),
            ], names=SCHEMA.names)

        for batch in batches:
            losses = batch.column(2).to_pylist() if loss_col else [None] * batch.num_rows
            for doc_id, text, loss in zip(batch.column(0).to_pylist(), batch.column(1), losses):
                packer.add(doc_id, encode(text.as_py()) + end, loss)
                if len(packer.out) >= 4096:
                    yield flush()
        packer.finish()
        yield flush()

    return prepared(docs).select(*cols).mapInArrow(rows, SCHEMA)
