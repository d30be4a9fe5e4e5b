"""Packing: vector bin packing by the dot-product heuristic.

Documents are cut into pieces that fill sequences under three limits at once:
tokens, segments (pieces) and loss-bearing tokens.  A sequence takes, time and
again, the waiting piece that fits and whose size vector has the largest dot
product with what the sequence has left.  When none fits, or one segment is
left, the head of a waiting piece that fills the gap is cut off.

Which tokens bear loss: with a prompt column none of the prompt; else none of a
document's first ``CONTEXT`` tokens, which stand in too little context to be
learned from.  A sequence of one long document's middle would be all loss, so
the limit on loss, like the one on segments, takes part in the choice.

A sequence that no waiting piece can fill ends at the largest power of two that
it reaches, and the rest waits on: nothing is padded.

Each partition of the input packs on its own, in order, with a bounded pool of
waiting pieces: no shuffle, and a lost task is redone from its input split.

Nulls and edge cases: a null text or prompt is empty, and a document without
text has the end id alone; repeated ids are separate documents; a text of any
length is cut, in time that grows with its length; an empty table gives no
pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import OUT_ROWS, rows_of, to_batch
from .tokens import ids


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 16
    loss: int = 2016


#: Tokens at a document's start that bear no loss, where no prompt is given.
CONTEXT = 32
#: A partition packs when this many tokens wait (4 bytes each).
POOL_TOKENS = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True, slots=True)
class Piece:
    """Tokens start..stop of a document; ``data`` is the whole document's, never copied."""

    doc_id: int | None
    data: memoryview
    context: int
    start: int
    stop: int

    @property
    def length(self) -> int:
        return self.stop - self.start

    @property
    def free(self) -> int:
        """Its tokens without loss: they are its first ones."""
        return max(0, min(self.stop, self.context) - self.start)

    def crc(self) -> int:
        return zlib.crc32(self.data[4 * self.start : 4 * self.stop])

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return replace(self, stop=self.start + at), replace(self, start=self.start + at)


class Pool:
    """Waiting pieces: those longer than a sequence in order, the others by class (length, tokens without loss)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.long: deque[Piece] = deque()
        self.kept: list[deque[Piece]] = []
        self.slot: dict[tuple[int, int], int] = {}
        self.sizes = np.zeros((3, 1024), np.int64)  # of a class: length, tokens without loss, pieces
        self.tokens = 0

    def add(self, piece: Piece) -> None:
        self.tokens += piece.length
        if piece.length > self.limits.tokens:
            self.long.append(piece)
            return
        key = (piece.length, piece.free)
        k = self.slot.get(key)
        if k is None:
            if len(self.kept) == self.sizes.shape[1]:
                self._make_room()
            k = self.slot[key] = len(self.kept)
            self.kept.append(deque())
            self.sizes[:, k] = (*key, 0)
        self.kept[k].append(piece)
        self.sizes[2, k] += 1

    def _make_room(self) -> None:
        """Classes without pieces go; the arrays double where few are."""
        used = [k for k, own in enumerate(self.kept) if own]
        old = self.sizes[:, used]
        self.sizes = np.zeros((3, max(1024, 4 * len(used))), np.int64)
        self.sizes[:, : len(used)] = old
        self.kept = [self.kept[k] for k in used]
        self.slot = {(int(n), int(f)): k for k, (n, f) in enumerate(zip(old[0], old[1]))}

    def _take(self, k: int) -> Piece:
        piece = self.kept[k].popleft()
        self.sizes[2, k] -= 1
        self.tokens -= piece.length
        return piece

    def best(self, tokens: int, segments: int, loss: int) -> Piece | None:
        """The fitting piece with the largest dot product of its share of each limit and what is left of it."""
        length, free, count = self.sizes[:, : len(self.kept)]
        own = np.flatnonzero((count > 0) & (length <= tokens) & (length - free <= loss))
        if not own.size:
            return None
        lim, n = self.limits, length[own]
        score = n * (tokens / lim.tokens**2) + segments / lim.segments**2 + (n - free[own]) * (loss / lim.loss**2)
        return self._take(int(own[np.argmax(score)]))

    def cut(self, tokens: int, loss: int) -> Piece | None:
        """The longest head, within ``tokens`` and ``loss``, of a piece that does not fit; its rest waits on."""
        whole = None
        if self.long and min(tokens, loss + self.long[0].free) == tokens:
            whole = self.long.popleft()
            self.tokens -= whole.length
        else:
            length, free, count = self.sizes[:, : len(self.kept)]
            head = np.minimum(tokens, loss + free)
            head[(count == 0) | (length <= head)] = 0
            most = int(head.max(initial=0))
            if self.long and min(tokens, loss + self.long[0].free) > most:
                whole = self.long.popleft()
                self.tokens -= whole.length
            elif most:
                own = np.flatnonzero(head == most)
                whole = self._take(int(own[np.argmax(length[own])]))
        if whole is None:
            return None
        head, rest = whole.cut(min(tokens, loss + whole.free))
        if rest.length > self.limits.tokens:
            self.long.appendleft(rest)
            self.tokens += rest.length
        else:
            self.add(rest)
        return head

    def fill(self, size: int) -> list[Piece]:
        """Pieces for one sequence: ``size`` ids, or a power of two."""
        lim, out = self.limits, []
        tokens, segments, loss = size, lim.segments, lim.loss
        while tokens and segments:
            piece = (self.cut(tokens, loss) if segments == 1 else self.best(tokens, segments, loss)) or self.cut(tokens, loss) or self.best(tokens, segments, loss)
            if piece is None:
                break
            out.append(piece)
            tokens, segments, loss = tokens - piece.length, segments - 1, loss - piece.length + piece.free
        if tokens:
            excess = (size - tokens) - (1 << ((size - tokens).bit_length() - 1))
            while excess:
                last = out.pop()
                if last.length > excess:
                    last, rest = last.cut(last.length - excess)
                    out.append(last)
                else:
                    rest = last
                excess -= rest.length
                self.add(rest)
        return out


def pack_partition(docs: Iterator[tuple[int | None, bytes, int]], limits: Limits, first_sequence: int) -> Iterator[tuple]:
    """Rows of ``PIECES`` for documents given as (id, ids with the end id, tokens at the start without loss)."""
    pool, sequence = Pool(limits), first_sequence

    def rows(pieces: list[Piece]) -> list[tuple]:
        nonlocal sequence
        out, at = [], 0
        for p in pieces:
            out.append((p.doc_id, p.start, p.length, p.crc(), len(p.data) // 4, sequence, at, p.length - p.free))
            at += p.length
        sequence += bool(out)
        return out

    for key, data, context in docs:
        if data:
            pool.add(Piece(key, memoryview(data), context, 0, len(data) // 4))
        if pool.tokens >= POOL_TOKENS:
            while pool.tokens >= POOL_TOKENS // 4:
                yield from rows(pool.fill(limits.tokens))
    while pool.tokens:
        yield from rows(pool.fill(limits.tokens if pool.tokens >= limits.tokens else 1 << (pool.tokens.bit_length() - 1)))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
) -> DataFrame:
    """One row per piece; ``sequence_id`` is unique over the whole result.

    A prompt's ids come before its text's and bear no loss.
    """
    kinds = docs.sparkSession.createDataFrame([], PIECES).schema
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        coder, arrow = ids(tokenizer_path), to_arrow_schema(kinds)
        def given() -> Iterator[tuple[int | None, bytes, int]]:
            for key, text, prompt in rows_of(batches):
                before = coder.bytes_of(prompt)
                yield key, before + coder.bytes_of(text) + end, CONTEXT if prompt is None else len(before) // 4

        rows: list[tuple] = []
        for row in pack_partition(given(), limits, TaskContext.get().partitionId() << 32):
            rows.append(row)
            if len(rows) >= OUT_ROWS:
                yield to_batch(rows, arrow)
                rows = []
        if rows:
            yield to_batch(rows, arrow)

    prompt = F.lit(None).cast("string") if prompt_col is None else F.coalesce(F.col(prompt_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), prompt).mapInArrow(run, PIECES)
