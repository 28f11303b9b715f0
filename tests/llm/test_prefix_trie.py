import hashlib
import zlib

import numpy as np
import pytest

from quillon.llm import prefix_trie

CONV = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    nodes = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes.setdefault(tuple(paths[c][:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def total(p):
        leaves, saved, todo = 0, 0, [p]
        while todo:
            q = todo.pop()
            leaves += q not in children
            saved += (len(nodes[q]) - 1) * (len(q[-1][1].split()) if q else 0)
            todo += children.get(q, [])
        return leaves, saved

    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(paths[c]) == len(p))
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(children.get(p, [])), *total(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_at_random(seed, n=120, extra=()):
    rng = np.random.default_rng(seed)
    said = ["hello", "hello there", "", None, "a b  c", "ä ö\tü"]
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(0, 6))):
            rows.append((c, t, ["user", "bot", None][int(rng.integers(3))] if t > 1 else "user", said[int(rng.integers(len(said)))] if t > 1 else said[c % 2]))
    return rows + list(extra)


@pytest.mark.parametrize("most", [65_536, 40, 1])
def test_against_brute_force(spark, most):
    odd = [(None, 0, "user", "no id"), (3, None, "user", "first"), (3, 0, "user", "tie"), (3, 0, "bot", "tie"), (3, 0, "bot", "tie"), (2**40, 0, None, None), (200, 0, "u", "x" * 100_000), (205, 0, "user1", ":a"), (206, 0, "user", "1:a")]
    rows = rows_at_random(1, extra=odd + [(300, t, "user", "long") for t in range(7)])
    table = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as pos", "'x' as digest", "2 as h")
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(table), most)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_equal_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(200) for t in range(4)]
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame(rows, CONV)), 3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([], CONV))).collect() == []
