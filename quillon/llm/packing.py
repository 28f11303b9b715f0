"""Packing examples into training sequences by vector bin packing with the dot-product heuristic.

An example is a document's ids and an end id; with `prompt_col` its prompt's ids come first and bear no loss, and with
`prompt_line` the ids of the text's first line, where more lines follow, bear none. A sequence has three limits at once: tokens, segments and loss-bearing tokens. Each task packs its own rows as they
stream by, so packing moves no row between tasks and a source with a third of all rows is dealt like any other:

* As long as a document fills sequences alone, such pieces become sequences at once.
* What is left of it goes into the open sequence with the largest dot product of the piece's demands and what the
  sequence has left, each as a share of the limit. At most `open_sequences` are open; beyond, the fullest one is
  filled up with a first part of the piece and closed.
* Sequences that a limit on segments or loss closes early, and what is open at the end of a task, are cut to lengths
  that need no padding: full, or a power of two.

Each id lies in exactly one piece, pieces of a sequence follow each other without gaps, and all limits hold. The
result depends on how rows are dealt to tasks, which is the same for the same files and settings.

Null text counts as empty and gives the end id alone. Rows repeated with one doc_id are packed each for itself; a null
doc_id is carried along. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tokenize import Bpe, bpe, public_bpe

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_segments long, n_loss long"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    quiet: int  # leading ids that bear no loss

    @property
    def loss(self) -> int:
        return len(self.ids) - self.quiet

    def cut(self, n: int) -> tuple[Piece, Piece]:
        q = min(n, self.quiet)
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens, q), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens, self.quiet - q)


class Sequence:
    def __init__(self) -> None:
        self.pieces: list[Piece] = []
        self.tokens = self.loss = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.tokens += len(piece.ids)
        self.loss += piece.loss


class Packer:
    """Places pieces one after the other; `done` gets each closed sequence as its list of pieces."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, open_sequences: int) -> None:
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([max_tokens, max_segments, max_loss])
        self.tokens, self.segments, self.loss = max_tokens, max_segments, max_loss
        self.most_open = open_sequences
        self.open: list[Sequence] = []
        self.left = np.zeros((open_sequences, 3), np.int64)
        self.done: list[list[Piece]] = []

    def room(self, piece: Piece, tokens: int, loss: int) -> int:
        """The longest first part of `piece` within so many tokens and loss-bearing tokens."""
        return min(len(piece.ids), tokens, piece.quiet + loss)

    def add(self, piece: Piece) -> None:
        while piece.ids.size:
            n = self.room(piece, self.tokens, self.loss)
            first, piece = piece.cut(n)
            if n == self.tokens:
                self.done.append([first])
            else:
                first.ids = first.ids.copy()  # lets the document go
                self.place(first)

    def place(self, piece: Piece) -> None:
        todo = [piece]
        while todo:
            piece = todo.pop()
            need = np.array([len(piece.ids), 1, piece.loss])
            left = self.left[: len(self.open)]
            fits = np.flatnonzero((left >= need).all(axis=1))
            if fits.size:
                at = int(fits[np.argmax((left[fits] / self.limits) @ (need / self.limits))])
            elif len(self.open) < self.most_open:
                at = len(self.open)
                self.open.append(Sequence())
                self.left[at] = self.limits
            else:
                at = int(np.argmin(left[:, 0]))
                n = self.room(piece, int(left[at, 0]), int(left[at, 2]))
                if n:
                    piece, rest = piece.cut(n)
                    todo.append(rest)
                else:
                    todo.append(piece)
                    todo += self.close(at)
                    continue
            self.open[at].add(piece)
            self.left[at] -= [len(piece.ids), 1, piece.loss]
            if self.left[at].min() == 0:
                todo += self.close(at)

    def close(self, at: int) -> list[Piece]:
        """Take a sequence off the open ones; the pieces that would need padding come back."""
        sequence = self.open[at]
        self.open[at], self.left[at] = self.open[-1], self.left[len(self.open) - 1]
        self.open.pop()
        return self.trim(sequence)

    def trim(self, sequence: Sequence) -> list[Piece]:
        keep = self.tokens if sequence.tokens == self.tokens else 1 << (sequence.tokens.bit_length() - 1)
        kept, back, n = [], [], 0
        for piece in sequence.pieces:
            if n + len(piece.ids) <= keep:
                kept.append(piece)
            elif n < keep:
                first, rest = piece.cut(keep - n)
                kept.append(first)
                back.append(rest)
            else:
                back.append(piece)
            n += len(piece.ids)
        self.done.append(kept)
        return back

    def finish(self) -> None:
        """Refill what is open into full sequences, and the rest into powers of two."""
        todo = [p for s in sorted(self.open, key=lambda s: -s.tokens) for p in s.pieces][::-1]
        self.open = []
        while todo:
            sequence = Sequence()
            while todo and len(sequence.pieces) < self.segments:
                n = self.room(todo[-1], self.tokens - sequence.tokens, self.loss - sequence.loss)
                if not n:
                    break
                first, rest = todo.pop().cut(n)
                sequence.add(first)
                if rest.ids.size:
                    todo.append(rest)
            todo += self.trim(sequence)[::-1]


def first_line(text: str, ids: np.ndarray, encode: Bpe) -> int:
    """How many of `ids` are those of the first of several lines, without the white space that ends it."""
    line, _, rest = text.partition("\n")
    quiet = encode.ids(line.rstrip()) if rest.strip() else ids[:0]
    return len(quiet) if np.array_equal(ids[: len(quiet)], quiet) else 0


def pack_rows(batches: Iterator[pa.RecordBatch], tokenizer: tuple, end_id: int, limits: tuple[int, int, int], open_sequences: int, prompt_line: bool = False) -> Iterator[pa.RecordBatch]:
    encode = bpe(*tokenizer)
    packer = Packer(*limits, open_sequences)
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def written() -> pa.RecordBatch:
        nonlocal number
        rows: list[tuple] = []
        for pieces in packer.done:
            offset, loss = 0, sum(p.loss for p in pieces)
            for p in pieces:
                rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, number, offset, len(pieces), loss))
                offset += len(p.ids)
            number += 1
        packer.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    end = np.array([end_id], np.uint32)
    for batch in batches:
        for doc_id, text, prompt in zip(*(batch.column(i) for i in range(3)), strict=True):
            before = encode.ids(prompt.as_py()) if prompt.is_valid else end[:0]
            body = text.as_py() or ""
            own = encode.ids(body)
            quiet = len(before) + (first_line(body, own, encode) if prompt_line else 0)
            ids = np.concatenate([before, own, end])
            packer.add(Piece(doc_id.as_py(), 0, ids, len(ids), quiet))
            if len(packer.done) > 512:
                yield written()
    packer.finish()
    if packer.done:
        yield written()


def pack(
    docs: DataFrame,
    tokenizer: tuple | None = None,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 1024,
    max_loss: int = 2048,
    open_sequences: int = 64,
    prompt_col: str | None = None,
    prompt_line: bool = False,
) -> DataFrame:
    """A row for each piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id,
    offset in the sequence, and the sequence's n_segments and n_loss. `tokenizer`: arguments of `tokenize.bpe`."""
    tokenizer = tokenizer or public_bpe()
    prompt = F.col(prompt_col).cast("string") if prompt_col else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), prompt.alias("prompt"))
    limits = (max_tokens, max_segments, max_loss)
    return rows.mapInArrow(lambda it: pack_rows(it, tokenizer, end_id, limits, open_sequences, prompt_line), SCHEMA)
