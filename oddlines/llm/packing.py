"""Sum-of-squares packing of tokenised documents into fixed windows.

A document's ids are cut into full windows and a remainder. Remainders are placed online: among the fill levels that have
room (an empty window included), a remainder goes to the level after which the sum of squared counts of partially filled
windows, kept in a level array, is smallest; ties go to the fuller level. When a task's documents end, its partially
filled windows are drained: the emptiest are cut to fill the fullest, and the last one is cut into sequences of powers of
two, which need no padding. Every task packs what it reads, so nothing is shuffled; memory is that of the open windows.

Defined results: a null or empty text gives its end id alone; repeated rows are documents of their own; an empty table
gives no pieces; columns of other names are ignored. A text of any length is encoded whole and cut into as many windows
as it fills; documents that tie for a level go to it in the order of reading. Sequence ids are unique: the task's number times 2**40, counted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
_WIDTH = 4

Piece = tuple[int, int, int, bytes]  # doc_id, start, ids of the whole document, own ids


class SumOfSquares:
    """Online packing into windows of ``window`` ids. place() and drain() yield closed sequences, lists of pieces."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)  # the level array: open windows by fill
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, whose choice makes the sum of squared counts least."""
        here = self.count[: self.window - size + 1]
        there = self.count[size:].copy()
        there[-1] = -1  # a window that becomes full leaves the array: -2 n + 1 in all
        change = 2 * (there - here) + 2
        change[-1] += 1
        change[0] = 2 * there[0] + 1 if size < self.window else 0
        allowed = here > 0
        allowed[0] = True
        change = np.where(allowed, change, np.iinfo(np.int64).max)
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[list[Piece]]:
        size = len(piece[3]) // _WIDTH
        level = self.level_for(size)
        held = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        held.append(piece)
        if level + size == self.window:
            return [held]
        self.count[level + size] += 1
        self.open[level + size].append(held)
        return []

    def drain(self) -> Iterator[list[Piece]]:
        left = [(level, held) for level in range(self.window) for held in self.open[level]]  # emptiest first
        low, spare = 0, []
        while left and low < len(left):
            level, target = left.pop()
            room = self.window - level
            while room and (spare or low < len(left)):
                if not spare:
                    spare = left[low][1][::-1]
                    low += 1
                doc, start, total, ids = spare.pop()
                if len(ids) > room * _WIDTH:
                    spare.append((doc, start + room, total, ids[room * _WIDTH :]))
                    ids = ids[: room * _WIDTH]
                target.append((doc, start, total, ids))
                room -= len(ids) // _WIDTH
            if room:
                spare = target[::-1]
                break
            yield target
        rest = sum(len(p[3]) for p in spare) // _WIDTH
        for power in reversed(range(self.window.bit_length())):
            if rest & (1 << power):
                room, held = 1 << power, []
                while room:
                    doc, start, total, ids = spare.pop()
                    if len(ids) > room * _WIDTH:
                        spare.append((doc, start + room, total, ids[room * _WIDTH :]))
                        ids = ids[: room * _WIDTH]
                    held.append((doc, start, total, ids))
                    room -= len(ids) // _WIDTH
                yield held


def pack_partition(rows: Iterator[tuple[int, bytes]], window: int) -> Iterator[list[Piece]]:
    """Closed sequences of (doc_id, ids) rows."""
    packer, step = SumOfSquares(window), window * _WIDTH
    for doc, ids in rows:
        total = len(ids) // _WIDTH
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            yield [(doc, at // _WIDTH, total, ids[at : at + step])]
        if whole < len(ids):
            yield from packer.place((doc, whole // _WIDTH, total, ids[whole:]))
    yield from packer.drain()


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", max_pieces: int = 200_000
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).
    max_pieces bounds what a worker keeps of pieces of text that it has met, not what it encodes."""
    end = int(end_id).to_bytes(_WIDTH, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, max_pieces).encode

        def rows() -> Iterator[tuple[int, bytes]]:
            for batch in small_batches(batches, 256):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield doc, encode(text.as_py()) + end

        base, out, held = TaskContext.get().partitionId() << 40, [], 0
        for n, sequence in enumerate(pack_partition(rows(), window)):
            at = 0
            for doc, start, total, ids in sequence:
                length = len(ids) // _WIDTH
                out.append((doc, start, length, total, base + n, at, ids))
                at += length
            held += at
            if held >= 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
