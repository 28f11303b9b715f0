"""Hashes of the words of many texts at once, in numpy over the UTF-8 bytes of an Arrow column.

Words are ``[^\\x20\\x09-\\x0D]+``; only A-Z may be lower-cased, so bytes are enough. All hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P, _Q, _R = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(texts: pa.Array, max_bytes: int = 1 << 19) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of pieces of about `max_bytes`; a longer text is a piece of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + max_bytes, "right")))
        yield row, texts.slice(row, upto - row)
        row = upto


def raw(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins (one offset more than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return _LOWER[b] if lower else b, offsets - offsets[0]


def span_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each of b[start:end]. Blocks of eight bytes go through two chains that mix after every block; up to eight bytes
    with one length always differ, and longer ones meet only where both chains do."""
    eight = np.ndarray((len(b),), "<u8", b.tobytes() + bytes(8), strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        one = mix(size.astype(U) * _R + U(seed))
        two = np.zeros(len(start), U)
        todo, at = np.arange(len(start)), start
        while len(todo):
            left = end[todo] - at
            block = eight[at] & (~U(0) >> (U(8) * (U(8) - np.minimum(left, 8).astype(U))))
            one[todo] = mix((one[todo] ^ block) * _P)
            several = size[todo] > 8
            again = todo[several]
            two[again] = mix(two[again] * _Q + (block[several] ^ U(seed ^ 0x5851F42D4C957F2D)))
            longer = left > 8
            todo, at = todo[longer], at[longer] + 8
        return mix(one ^ two)


BLOCK = 1 << 22  # bytes whose words are hashed at once
RUN = 1 << 20  # numbers that are multiplied at once


def _words(b: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, beginning) of each word of `b`; texts begin at `offsets`."""
    inside = _WORD[b]
    before = np.concatenate([np.zeros(1, bool), inside[:-1]])[: len(b)]
    after = np.concatenate([inside[1:], np.zeros(1, bool)])[: len(b)]
    before[offsets[(offsets >= 0) & (offsets < len(b))]] = False
    after[offsets[(offsets > 0) & (offsets <= len(b))] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return span_hash(b, start, end, seed), start


def words(texts: pa.Array, lower: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, in order; where each text's words begin, one offset more than texts). Long texts are hashed in
    blocks that end between words."""
    b, offsets = raw(texts, lower)
    if len(b) <= BLOCK:
        h, start = _words(b, offsets, seed)
        return h, np.searchsorted(start, offsets)
    hashes, starts, lo = [], [], 0
    while lo < len(b):
        hi = min(lo + BLOCK, len(b))
        if hi < len(b):
            gaps = np.flatnonzero(~_WORD[b[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:  # a word longer than a block: to its end
                while hi < len(b) and not (gaps := np.flatnonzero(~_WORD[b[hi : hi + BLOCK]])).size:
                    hi = min(hi + BLOCK, len(b))
                hi += int(gaps[0]) if gaps.size else 0
        h, start = _words(b[lo:hi], offsets - lo, seed)
        hashes.append(h)
        starts.append(start + lo)
        lo = hi
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def placed_sums(h: np.ndarray, at: np.ndarray, salt: U) -> np.ndarray:
    """The sum of a hash of (word, place) over each text's words, places counted from its first."""
    out = np.zeros(len(at) - 1, U)
    with np.errstate(over="ignore"):
        for lo in range(0, len(h), RUN):
            hi = min(lo + RUN, len(h))
            text = np.searchsorted(at, np.arange(lo, hi), "right") - 1
            sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h[lo:hi] ^ mix((np.arange(lo, hi) - at[text]).astype(U) + salt)))])
            own = np.arange(text[0], text[-1] + 1)
            out[own] += sums[np.clip(at[own + 1], lo, hi) - lo] - sums[np.clip(at[own], lo, hi) - lo]
    return out


def sequence_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's whole sequence of words."""
    n = np.diff(at).astype(U)
    with np.errstate(over="ignore"):
        return mix(placed_sums(h, at, _Q) + n * _P), mix(placed_sums(h, at, _R) + n * _P)


def shingles(h: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes text by text, where each text's begin). Fewer than k words: the whole sequence
    is one; no words: none."""
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    left = at[1:][text] - np.arange(len(h))  # words from here to the text's end
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(h) - k + 1), U)
        for j in range(k):
            full = mix(full * _Q + h[j : len(h) - k + 1 + j])
        ok = left[: len(full)] >= k
        value, owner = [mix(full[ok] + U(k))], [text[: len(full)][ok]]
        for size in range(1, k):
            first = at[:-1][n == size]
            part = np.zeros(len(first), U)
            for j in range(size):
                part = mix(part * _Q + h[first + j])
            value.append(mix(part + U(size)))
            owner.append(np.flatnonzero(n == size))
    if len(n) == 1:  # one text, perhaps a very long one
        value = np.unique(np.concatenate(value))
        return value, np.array([0, len(value)])
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def sketches(value: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A fast similarity sketch (texts x size, 16 bits a coordinate) of each set; rows of empty sets are 0.

    In round i < size each element is placed in one bin by a hash of its own; in round size + j all go to bin j. A bin
    keeps the least (round, hash) that fell into it; the rounds of a set end when all its bins are filled, which the
    second half of the rounds guarantees. Two sets agree in a coordinate with a probability of their Jaccard
    similarity, and the number of agreements concentrates as for independent coordinates.
    """
    texts = len(at) - 1
    text = np.repeat(np.arange(texts), np.diff(at))
    free = U(0xFFFFFFFFFFFFFFFF)
    bins = np.full(texts * size, free, U)
    mask, shift = U(0xFFFFFFFF), U(32)
    for i in range(2 * size):
        if not len(text):
            break
        for lo in range(0, len(value), RUN):
            own, of = value[lo : lo + RUN], text[lo : lo + RUN]
            with np.errstate(over="ignore"):
                x = mix(own + U(i + 1) * _P)
            where = (((x & mask) * U(size)) >> shift).astype(np.int64) if i < size else i - size
            np.minimum.at(bins, of * size + where, (U(i) << shift) | (x >> shift))
        todo = (bins.reshape(texts, size) == free).any(axis=1)[text]
        if not todo.all():
            value, text = value[todo], text[todo]
    bins[bins == free] = U(0)
    return (mix(bins) >> U(48)).astype(np.uint16).reshape(texts, size)
