"""Hashes of words and sets in blocks are those of whole texts."""

import numpy as np
import pyarrow as pa
import pytest
from cases import WORD, lower, prose

from quillon.llm import textvec


@pytest.fixture
def texts():
    rng = np.random.default_rng(7)
    return pa.array([prose(rng, 300), None, "", "A b  a\tB", "x" * 500, prose(rng, 40) + "y" * 200 + " z", " lead", "trail "])


def test_words_in_blocks(texts, monkeypatch):
    whole, at = textvec.words(texts)
    keys, sets = textvec.sequence_keys(whole, at), textvec.shingles(whole, at)
    sketch = textvec.sketches(*sets, 20)
    names = {}
    for text, a, b in zip(texts.to_pylist(), at[:-1], at[1:]):
        found = WORD.findall(lower(text or ""))
        assert len(found) == b - a and all(names.setdefault(w, h) == h for w, h in zip(found, whole[a:b].tolist()))
    assert len(set(names.values())) == len(names)
    for block, run in ((1, 1), (7, 3), (64, 5), (1000, 100)):
        monkeypatch.setattr(textvec, "BLOCK", block)
        monkeypatch.setattr(textvec, "RUN", run)
        h, begin = textvec.words(texts)
        assert np.array_equal(h, whole) and np.array_equal(begin, at)
        assert all(np.array_equal(a, b) for a, b in zip(textvec.sequence_keys(h, begin), keys))
        assert np.array_equal(textvec.sketches(*sets, 20), sketch)
    for i in range(len(texts)):
        own, begin = textvec.shingles(*textvec.words(texts.slice(i, 1)))
        assert np.array_equal(own, sets[0][sets[1][i] : sets[1][i + 1]]) and begin.tolist() == [0, len(own)]


def thue_morse(n, a, b):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out


def test_no_known_collisions():
    """Texts at which polynomials modulo 2**64 agree for every base: as letters of a word, and as words of a text."""
    long = ["".join(thue_morse(1024, *x)) for x in ("ab", "ba")]
    h, _ = textvec.words(pa.array(long))
    assert h[0] != h[1]
    h, at = textvec.words(pa.array([" ".join(thue_morse(4096, *x)) for x in (("one", "two"), ("two", "one"))]))
    assert all(k[0] != k[1] for k in textvec.sequence_keys(h, at))


def test_short_words_differ():
    words = [chr(97 + i % 26) * n + chr(97 + i // 26) for i in range(600) for n in range(9)] + ["a\0", "a\0\0", "\0", "abcdefgh\0", "abcdefgh"]
    h, _ = textvec.words(pa.array(words))
    assert len(set(h.tolist())) == len(set(words))
    assert not np.intersect1d(h, textvec.words(pa.array(words), seed=1)[0]).size
