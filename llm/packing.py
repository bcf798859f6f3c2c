"""Vector bin packing of token sequences (operator 6).

A sequence has limits on three things at once: tokens, segments and loss-bearing tokens.  One sequence
is open at a time.  Of the waiting pieces that fit, the one with the largest dot product of its demand
and what is left goes in, both as shares of the limits, weighted by the demand still waiting.  When none
fits, the head of the best one is cut off to fill the sequence.

Every task packs what it reads: nothing is shuffled, and ids wait only for the pieces in its window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from llm.common import only
from llm.encoding import encoder, ids
from llm.textbuf import slices_by_bytes

END = 0  # id that closes a document
WINDOW = 4096  # pieces that wait in a task


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("loss_tokens", pa.int64()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


class Packer:
    """Pieces in, placed pieces out."""

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.limits, self.sequence = limits, first_sequence
        self.waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def _put(self, piece: tuple, offset: int) -> None:
        doc_id, start, part, total = piece
        self.rows.append((doc_id, start, len(part), part.tobytes(), self._loss(part, start, total), total, self.sequence, offset))

    @staticmethod
    def _loss(part: np.ndarray, start: int, total: int) -> int:
        """All ids bear loss but the document's first, which nothing predicts."""
        return len(part) - (start == 0)

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        """Full pieces are sequences of their own; the rest waits."""
        step, total, at = min(self.limits.tokens, self.limits.loss), len(tokens), 0
        while total - at >= step:
            self._put((doc_id, at, tokens[at : at + step], total), 0)
            self.sequence += 1
            at += step
        if at < total:
            self.waiting.append((doc_id, at, tokens[at:], total))
        if len(self.waiting) >= 2 * WINDOW:
            self.pack(WINDOW)

    def pack(self, keep: int = 0) -> None:
        """Place pieces until at most ``keep`` wait."""
        pool, lim = list(self.waiting), self.limits
        size = np.array([len(p[2]) for p in pool], dtype=np.int64)
        loss = np.array([self._loss(p[2], p[1], p[3]) for p in pool], dtype=np.int64)
        free = np.ones(len(pool), dtype=bool)
        left = len(pool)
        wait_tokens, wait_loss = int(size.sum()), int(loss.sum())
        while left > keep:
            tokens, segments, bearing, offset = lim.tokens, lim.segments, lim.loss, 0
            while segments and tokens and left:
                # weights: demand still waiting, as a share of the limit
                a, b, c = wait_tokens / lim.tokens, left / lim.segments, wait_loss / lim.loss
                score = (a * tokens / lim.tokens**2) * size + (c * bearing / lim.loss**2) * loss + b * segments / lim.segments**2
                fits = free & (size <= tokens) & (loss <= bearing)
                i = int(np.argmax(np.where(fits, score, -1.0)))
                if fits[i]:
                    self._put(pool[i], offset)
                    free[i] = False
                    left -= 1
                    used, used_loss = int(size[i]), int(loss[i])
                else:  # nothing fits: cut the head of the best one
                    i = int(np.argmax(np.where(free, score, -1.0)))
                    doc_id, start, part, total = pool[i]
                    used = min(tokens, bearing + (start == 0))
                    if not 0 < used < len(part):
                        break
                    head = (doc_id, start, part[:used], total)
                    self._put(head, offset)
                    used_loss = self._loss(head[2], start, total)
                    pool[i] = (doc_id, start + used, part[used:], total)
                    size[i] -= used
                    loss[i] -= used_loss
                offset += used
                tokens, segments, bearing = tokens - used, segments - 1, bearing - used_loss
                wait_tokens, wait_loss = wait_tokens - used, wait_loss - used_loss
            self.sequence += 1
        self.waiting = [p for p, f in zip(pool, free) if f]

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _OUT)], schema=_OUT)
            self.rows = []


def pack(docs: DataFrame, ranks: str, pattern: str, added: str, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per placed piece: doc_id, start, length, ids (little-endian unsigned 32-bit), loss_tokens,
    doc_tokens, sequence_id, offset.

    A document is its ids and the closing id 0; a null or empty text is that id alone.  Each id lies in
    exactly one piece.  Sequences are full but for the last of each task and those whose segments run out.
    Repeated rows are documents of their own; a null id stays null.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, context = encoder(ranks, pattern, added), TaskContext.get()
        packer = Packer(limits, (context.partitionId() if context else 0) << 36)
        for batch in batches:
            for part in slices_by_bytes(batch, "text"):
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    packer.add(i, np.append(ids(enc, t), np.uint32(END)))
                yield from packer.batches(2000)
        packer.pack()
        yield from packer.batches()

    columns = "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"
    return only(docs, doc_id=f"{doc_id} long", text=f"{text} string").mapInArrow(run, columns)
