"""Texts of an Arrow batch as one array of code points, so that numpy works on a batch at once and not text by text."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LETTER, BLANK = 1, 2  # letters and numbers (\p{L}\p{N}); white space as Java's \s has it
PART = 1 << 21  # code points that are taken together; a longer text is taken alone


@functools.cache
def classes(wide: bool = False) -> np.ndarray:
    """The class of each code point; `wide` takes all that Python holds for white space as such."""
    if wide:
        return np.where([chr(c).isspace() for c in range(0x110000)], np.uint8(BLANK), classes())
    out = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)]).astype(np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    return out


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(the code points of all texts, where each text begins; at last their number)."""
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The rows of a batch that have a `text`, in parts of about `PART` code points, each with its texts."""
    batch = batch.filter(batch.column("text").is_valid())
    texts = batch.column("text").to_pylist()
    ends = np.cumsum([len(t) for t in texts])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART, "right")))
        yield batch.slice(lo, hi - lo), texts[lo:hi]
        lo = hi


def tokens_before(cps: np.ndarray, starts: np.ndarray, wide: bool = False) -> np.ndarray:
    """The number of tokens (`text.TOKEN`) that begin before each place."""
    kind = classes(wide)[cps]
    letter = kind == LETTER
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    inside = starts[:-1][starts[:-1] < len(cps)]
    begins[inside] = letter[inside]
    begins |= kind == 0
    return np.concatenate([[0], np.cumsum(begins, dtype=np.int32)])


def n_tokens(cps: np.ndarray, before: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The number of tokens in each span: those that begin there, and one that began before."""
    cut = s < e
    at = s[cut]
    n = before[e] - before[s]
    n[cut] += (classes()[cps[at]] == LETTER) & (before[at + 1] == before[at])
    return n


def runs(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of `mask` that no text's begin cuts."""
    before = np.concatenate([[False], mask[:-1]])
    before[starts[:-1][starts[:-1] < len(mask)]] = False
    after = np.concatenate([mask[1:], [False]])
    after[starts[1:][starts[1:] > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def terms(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(the text of each, the term): the index tokens (`text.INDEX_TOKEN`) of lower-case texts in order."""
    s, e = runs((classes()[cps] == LETTER) | (cps == ord("_")), starts)
    long = e - s >= 2
    s, e = s[long], e[long]
    held = np.zeros(len(cps) + 1, np.int8)
    held[s], ends = 1, e
    held[ends] -= 1  # runs do not touch within a text; of two texts that touch, one's end is the other's begin
    kept = cps[np.cumsum(held[:-1], dtype=np.int8).astype(bool)]
    size = 1 + (kept >= 0x80).astype(np.int64) + (kept >= 0x800) + (kept >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(e - s)])]
    data = kept.tobytes().decode("utf-32-le").encode()
    return np.searchsorted(starts, s, "right") - 1, pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
