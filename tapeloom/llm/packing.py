"""Operator 5: packing of token sequences as vector bin packing.

Every document becomes pieces in sequences of at most LENGTH tokens, under three limits at once: tokens, segments (pieces)
and loss-bearing tokens of a sequence. Whole stretches of LENGTH tokens fill a sequence each; what is left of a document
waits in its task's pool. A sequence is filled from the pool one piece after the other: the piece whose demands have the
largest dot product with what is left of the limits, among those that fit; if none fits, the one of which most fits is
cut to the room left. The last tokens of a task, and sequences that a limit other than that on tokens leaves open, have
lengths that are powers of two, which need no padding. Each task packs its own partition with a pool of bounded size, so
nothing is shuffled or gathered.

Loss-bearing tokens: a document's first line is its prompt and bears no loss, the lines after it do; a document of one line
has no prompt. Tokens are counted as the characters go. The limit on them is the documents' own share of loss-bearing
text with ROOM on top, so no sequence may be made of answers alone while prompts wait in others.

Null and empty texts are one piece with the end id alone. Repeated rows are packed each for itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import trimmed

LENGTH, SEGMENTS = 2048, 256
POOL, REST = 2048, 512
#: Pieces that leave a task at once: with their ids some megabytes, in the worker and again in its executor.
SENT = 512
END = 1
#: What the limit on loss-bearing tokens leaves above their mean share.
ROOM = 0.02
#: The part of a sequence that may stay empty before it is cut back to a power of two.
TIGHT = 0.01
#: The size of a piece that is no longer in the pool.
PLACED = 1e18
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class Packer:
    """Fills sequences from a pool of pieces; out holds (piece, sequence, offset)."""

    def __init__(self, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None):
        self.limit = np.array([length, segments, loss or length], float)
        self.pool: list[tuple] = []  # (doc, start, ids, doc_tokens, loss share)
        self.sequence = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: bytes, share: float) -> None:
        """share: what part of the document's tokens bear loss."""
        n, step, at = len(ids) // 4, int(self.limit[0]), 0
        while share * step <= self.limit[2] and n - at >= step:
            self._place((doc, at, ids[4 * at : 4 * (at + step)], n, share), 0)
            self.sequence += 1
            at += step
        if at < n or not n:
            self.pool.append((doc, at, ids[4 * at :], n, share))
        if len(self.pool) >= POOL:
            self.fill(REST)

    def _place(self, piece: tuple, offset: int) -> None:
        self.out.append((*piece, self.sequence, offset))

    def fill(self, rest: int, length: int | None = None) -> None:
        """Packs until no more than rest pieces wait, or one sequence of the given length. A sequence that another limit
        leaves far from full is cut back to a power of two; what is cut off waits again."""
        pool, back = self.pool, []
        size = np.array([len(p[2]) // 4 for p in pool], float)
        share = np.array([p[4] for p in pool], float)
        load, n, waiting = size * share, len(pool), float(size.sum())
        scale = self.limit**2
        while n > (0 if length else rest):
            if not length and not rest and waiting < self.limit[0]:
                break
            left, made = self.limit.copy(), []
            left[0] = room = length or left[0]
            while left[1] >= 1 and left[0] >= 1 and n:
                # the dot product of demand and room, less what is the same for all pieces
                demand = size * (left[0] / scale[0]) + load * (left[2] / scale[2])
                demand[(size > left[0]) | (load > left[2])] = -1.0
                k = int(np.argmax(demand))
                if demand[k] >= 0:
                    piece = pool[k]
                    size[k] = load[k] = PLACED
                    n -= 1
                else:
                    fit = np.minimum(size, left[2] / np.maximum(share, 1e-9))
                    fit[size == PLACED] = -1.0
                    k = int(np.argmax(fit))
                    take = int(min(size[k] - 1, left[0], left[2] // share[k] if share[k] else left[0]))
                    if take < 1:
                        break
                    piece, pool[k] = self._cut(pool[k], take)
                    size[k] -= take
                    load[k] = size[k] * share[k]
                made.append(piece)
                got = len(piece[2]) // 4
                waiting -= got
                left -= (got, 1, got * piece[4])
            total = int(room - left[0])
            if left[0] > TIGHT * self.limit[0] and total & (total - 1):
                keep = 1 << (total.bit_length() - 1)
                while total > keep:
                    piece = made.pop()
                    total -= len(piece[2]) // 4
                    if total < keep:
                        piece, after = self._cut(piece, keep - total)
                        made.append(piece), back.append(after)
                        total = keep
                    else:
                        back.append(piece)
            offset = 0
            for piece in made:
                self._place(piece, offset)
                offset += len(piece[2]) // 4
            self.sequence += 1
            if length:
                break
        self.pool = [p for p, x in zip(pool, size.tolist(), strict=True) if x != PLACED] + back

    @staticmethod
    def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, at, ids, total, share = piece
        return (doc, at, ids[: 4 * n], total, share), (doc, at + n, ids[4 * n :], total, share)

    def finish(self) -> None:
        self.fill(0)
        while self.pool:
            waiting = sum(len(p[2]) // 4 for p in self.pool)
            self.fill(0, min(int(self.limit[0]), 1 << (waiting.bit_length() - 1)))


def loss_share(text: Column) -> Column:
    """What part of the text's characters comes after its first line; 1 for a text of one line or none."""
    first = F.instr(text, "\n")
    return F.when(first > 0, 1 - first / F.length(text)).otherwise(F.lit(1.0))


def loss_limit(docs: DataFrame, length: int = LENGTH) -> int:
    """The loss-bearing tokens that a sequence may have, from the share that they have in docs(text)."""
    size = F.length("text") + 1
    bearing, all_ = docs.agg(F.sum(size * loss_share(F.col("text"))), F.sum(size)).first()
    return min(length, int(length * min(1.0, (bearing / all_ if all_ else 1.0) + ROOM)) + 1)


def pack(docs: DataFrame, path: str, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, ids: bool = True, share: Column | None = None, release: bool = False) -> DataFrame:
    """A row for each piece of docs(doc_id, text), with its ids if asked for. share: the part of a document's tokens that
    bear loss (null: all), loss: how many of them a sequence may have. release: workers forget the encoded words when a
    task ends, for jobs whose other stages need their memory."""

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        packer = Packer(length, segments, loss)
        shares = []

        def watched():
            for b in batches:
                shares[:] = [1.0 if s is None else s for s in b.column("share").to_pylist()]
                shares.reverse()
                yield b

        def out():
            rows, packer.out = packer.out, []
            col = lambda f, t=pa.int64(): pa.array([f(r) for r in rows], t)
            return pa.RecordBatch.from_arrays(
                [col(lambda r: r[0]), col(lambda r: r[1]), col(lambda r: len(r[2]) // 4), col(lambda r: zlib.crc32(r[2])), col(lambda r: r[3]), col(lambda r: round(len(r[2]) // 4 * r[4])), col(lambda r: base + r[5]), col(lambda r: r[6]), col(lambda r: r[2] if ids else None, pa.binary())],
                [f.split()[0] for f in SCHEMA.split(", ")],
            )

        for doc, got in tokens.encoded(watched(), path, False, END):
            packer.add(doc, got, shares.pop())
            if len(packer.out) >= SENT:
                yield out()
        packer.finish()
        yield out()
        if release:
            tokens.forget()

    return docs.select("doc_id", "text", (F.lit(None) if share is None else share).cast("double").alias("share")).mapInArrow(trimmed(run), SCHEMA)
