import zlib

import numpy as np
import pytest
from cases import no_docs, odd_docs, random_docs
from hypothesis import given, settings, strategies as st

from quillon.llm import packing
from quillon.llm.tokenize import Bpe, public_bpe


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), max_size=60), st.integers(1, 100), st.integers(1, 6), st.integers(1, 100), st.integers(1, 5))
def test_packer(items, tokens, segments, loss, open_sequences):
    packer = packing.Packer(tokens, segments, loss, open_sequences)
    for i, (n, quiet) in enumerate(items):
        packer.add(packing.Piece(i, 0, np.arange(n, dtype=np.uint32) + 1000 * i, n, min(quiet, n)))
    packer.finish()
    ids = {i: [] for i in range(len(items))}
    for pieces in packer.done:
        n = sum(len(p.ids) for p in pieces)
        assert 0 < n <= tokens and len(pieces) <= segments and sum(p.loss for p in pieces) <= loss
        assert n == tokens or n & (n - 1) == 0
        for p in pieces:
            assert p.start == p.ids[0] - 1000 * p.doc_id
            ids[p.doc_id] += p.ids.tolist()
    assert all(sorted(v) == [1000 * i + x for x in range(items[i][0])] for i, v in ids.items())


def test_dot_product_choice():
    """Three open sequences could take the piece. First fit and best fit by tokens would choose another than the dot product
    of its demands (many tokens, little loss) with what they have left."""
    packer = packing.Packer(100, 10, 100, 4)
    for i, (n, quiet) in enumerate([(60, 0), (50, 50), (55, 30)]):
        sequence = packing.Sequence()
        sequence.add(packing.Piece(i, 0, np.arange(n, dtype=np.uint32), n, quiet))
        packer.open.append(sequence)
        packer.left[i] = packer.limits - [n, 1, n - quiet]
    piece = packing.Piece(9, 0, np.arange(30, dtype=np.uint32), 30, 20)
    need = np.array([30, 1, 10]) / packer.limits
    scores = [(packer.left[i] / packer.limits) @ need for i in range(3)]
    assert np.argmax(scores) == 1 and min(s.tokens for s in packer.open) == 50
    packer.place(piece)
    assert [len(s.pieces) for s in packer.open] == [1, 2, 1]
    heavy = packing.Packer(100, 10, 40, 4)  # loss is scarce: the piece that bears much goes where loss is left, not tokens
    for i, (n, quiet) in enumerate([(20, 0), (60, 55)]):
        sequence = packing.Sequence()
        sequence.add(packing.Piece(i, 0, np.arange(n, dtype=np.uint32), n, quiet))
        heavy.open.append(sequence)
        heavy.left[i] = heavy.limits - [n, 1, n - quiet]
    heavy.place(packing.Piece(9, 0, np.arange(20, dtype=np.uint32), 20, 0))
    assert [len(s.pieces) for s in heavy.open] == [1, 2]


def test_limits_of_the_query(spark, sf):
    from quillon.llm import queries

    rows = {r["sequence_id"]: r for r in queries.op3_packing(spark, sf).collect()}
    total = sum(r["length"] for r in queries.op3_packing(spark, sf).collect())
    assert max(r["n_segments"] for r in rows.values()) == 6 and all(r["n_loss"] <= 2048 for r in rows.values())
    assert 0.5 * total < sum(r["n_loss"] for r in rows.values()) < total


def test_fast_ids_of_the_whole_table(sf):
    import pyarrow.parquet as pq

    json_file, *fast = public_bpe()
    quick, plain = Bpe(json_file, *fast), Bpe(json_file)
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    assert len(texts) >= 200 and all(np.array_equal(quick.ids(t or ""), plain.ids(t or "")) for t in texts)


def test_first_line_bears_no_loss(spark):
    docs = spark.createDataFrame([(1, "ask this  \nanswer that"), (2, "one line"), (3, "\nempty first"), (4, "only \n  ")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in packing.pack(docs, prompt_line=True, max_segments=1).collect()}
    encode = Bpe(public_bpe()[0])
    for i, quiet in ((1, len(encode.ids("ask this"))), (2, 0), (3, 0), (4, 0)):
        if rows[i]["length"] == rows[i]["doc_tokens"]:
            assert rows[i]["n_loss"] == rows[i]["doc_tokens"] - quiet


@pytest.mark.parametrize("make", [odd_docs, random_docs])
def test_pack(spark, make):
    docs = make(spark)
    rows = packing.pack(docs).collect()
    slow = Bpe(public_bpe()[0])
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(slow.ids(r["text"] or "")) + (1,)) for r in docs.collect())
    by_sequence, pieces = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        n = sum(r["length"] for r in own)
        assert n == 2048 or n & (n - 1) == 0 and n < 2048
    once = {i: ids for i, ids in want if sum(j == i for j, _ in want) == 1}
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in want)
    for i, ids in once.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(i, "answer " * (5 * i + 1), "prompt " * 40) for i in range(30)], "doc_id long, text string, prompt string")
    rows = packing.pack(docs, max_tokens=128, max_segments=3, max_loss=40, prompt_col="prompt").collect()
    assert all(r["n_segments"] <= 3 and r["n_loss"] <= 40 for r in rows)
    assert sum({r["sequence_id"]: r["n_loss"] for r in rows}.values()) < sum(r["length"] for r in rows)


TEXTS = st.text(max_size=80) | st.sampled_from(["<|endoftext|>", "a <|endoftext|>b", "<|endoftext|", "  \n\n x", "don't"])


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_fast_ids_are_those_of_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    json_file, *fast = public_bpe()
    global FAST, SLOW
    FAST, SLOW = globals().get("FAST") or Bpe(json_file, *fast), globals().get("SLOW") or Bpe(json_file)
    assert FAST.ids(text).tolist() == SLOW.ids(text).tolist()


def test_empty(spark):
    assert packing.pack(no_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.Packer(0, 1, 1, 1)
