"""Language-model scores from a hidden Markov model over words.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z) text and one end token. Counting, training and
scoring take whole texts; training takes every text that is not held out.

* *Counts.* Tasks count the words of their rows, one shuffle adds the counts up. Words go by a 64-bit hash.
* *Symbols.* The `frequent` most frequent words are symbols of their own (a fixed number, so their table may be sent
  to all executors); other words share `classes` symbols by their hash and, within one, follow their smoothed counts,
  which are joined in by word. The end is a symbol too.
* *Baum-Welch.* Texts are encoded once, into the shared folder. In each round the tasks run scaled forward-backward over
  their whole texts and emit expected counts by symbol; these are added up in a shuffle, and the driver makes the next
  model of states x symbols numbers. Rounds end when the log likelihood of a token gains less than `tolerance`.
  Texts longer than `segment` tokens are cut; what lies before and after a cut reaches it as weights of the states (from
  the product of the cuts' matrices), so the expectations are those of the whole text, moves across cuts included.
* *Score.* The scaled forward recursion gives the exact likelihood of a text. Texts longer than `segment` tokens are cut;
  all cuts run at once, each from every state, and are multiplied together, which is the same sum in another order.

The base score is the smoothed unigram score with the counts of the training texts. Null text is empty and has the end
token alone. Rows without doc_id count as training rows. Rows with one doc_id are scored each for itself. An empty table
gives an empty result; without training rows all counts are zero. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import textvec
from .common import stored

LN10 = float(np.log(10))


@dataclass
class Symbols:
    """0 is the end, 1..len(words) the frequent words by hash, then the classes."""

    words: np.ndarray  # sorted hashes
    counts: np.ndarray  # of each symbol
    distinct: np.ndarray  # words in each symbol
    classes: int

    @property
    def size(self) -> int:
        return 1 + len(self.words) + self.classes

    def encode(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, h).clip(max=max(0, len(self.words) - 1))
        own = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        return np.where(own, 1 + at, 1 + len(self.words) + (h.view(np.uint64) % np.uint64(self.classes)).astype(np.int64)).astype(np.uint16)


@dataclass
class Hmm:
    start: np.ndarray  # state
    move: np.ndarray  # state, state
    emit: np.ndarray  # symbol, state

    @staticmethod
    def first(counts: np.ndarray, states: int, seed: int) -> Hmm:
        """The unigram model in every state, each perturbed in its own way; states are sticky."""
        rng = np.random.default_rng(seed)
        emit = (counts + 0.5)[:, None] * np.exp(rng.normal(0, 0.7, (len(counts), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
        return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def next(start: np.ndarray, move: np.ndarray, emit: np.ndarray, counts: np.ndarray, strength: float = 20.0) -> Hmm:
        """Expected counts, smoothed towards the unigram model, as a model."""
        unigram = (counts + 0.5) / (counts + 0.5).sum()
        emit = emit + strength * unigram[:, None]
        return Hmm((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols by step and part, active parts at each step, order of the parts: longest first)."""
    n = np.array([len(p) for p in parts])
    order = np.argsort(-n, kind="stable")
    ids = np.zeros((n.max(), len(parts)), np.int64)
    for column, i in enumerate(order):
        ids[: n[i], column] = parts[i]
    return ids, np.searchsorted(-n[order], -np.arange(n.max()), "left"), order


def chains(model: Hmm, begin: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward recursion of many parts at once: (last state weights, natural log of the scales).
    `begin`: state weights before each part's first emission."""
    ids, active, order = padded(parts)
    alpha, logs = begin[order].copy(), np.zeros(len(parts))
    for t, n in enumerate(active):
        a = (alpha[:n] @ model.move if t else alpha[:n]) * model.emit[ids[t, :n]]
        c = a.sum(1)
        alpha[:n] = a / c[:, None]
        logs[:n] += np.log(c)
    back = np.empty(len(parts), np.int64)
    back[order] = np.arange(len(parts))
    return alpha[back], logs[back]


def log_likelihood(model: Hmm, texts: list[np.ndarray], segment: int = 2048, at_once: int = 4096) -> np.ndarray:
    """Natural log of each text's probability. The cuts of all long texts run together, `at_once` chains at a time."""
    states = len(model.start)
    first = [t[:segment] for t in texts]
    weights, out = np.zeros((len(texts), states)), np.zeros(len(texts))
    for lo in range(0, len(texts), at_once):
        part = slice(lo, lo + at_once)
        weights[part], out[part] = chains(model, np.tile(model.start, (len(first[part]), 1)), first[part])
    cuts = [(i, texts[i][lo : lo + segment]) for i in range(len(texts)) for lo in range(segment, len(texts[i]), segment)]
    step = max(1, at_once // states)
    for lo in range(0, len(cuts), step):
        some = cuts[lo : lo + step]
        a, logs = chains(model, np.tile(model.move, (len(some), 1)), [c for _, c in some for _ in range(states)])
        for (i, _), m, s in zip(some, a.reshape(-1, states, states), logs.reshape(-1, states), strict=True):
            v = (weights[i] * np.exp(s - s.max())) @ m
            out[i] += float(s.max() + np.log(v.sum()))
            weights[i] = v / v.sum()
    return out


@dataclass
class Cuts:
    """Parts of texts with what the rest of their text says: `before`, the state weights at the end of the part before (zeros
    at a text's beginning), and `after`, the likelihood of what follows by the part's last state, up to a factor."""

    parts: list[np.ndarray]
    before: np.ndarray
    after: np.ndarray


def cut(model: Hmm, texts: list[np.ndarray], segment: int, at_once: int = 8192) -> Cuts:
    """The texts in parts of at most `segment` tokens. Only those of more than one part cost more than their parts; the
    parts of all of them run together."""
    states = len(model.start)
    owner = np.repeat(np.arange(len(texts)), [-(-len(t) // segment) for t in texts])
    parts = [texts[i][lo : lo + segment] for i in range(len(texts)) for lo in range(0, len(texts[i]), segment)]
    before, after = np.zeros((len(parts), states)), np.ones((len(parts), states))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    more = np.diff(np.append(first, len(parts))) > 1
    for lo in range(0, int(more.sum()), at_once):
        some = first[more][lo : lo + at_once]
        before[some + 1], _ = chains(model, np.tile(model.start, (len(some), 1)), [parts[x] for x in some])
    later = np.flatnonzero(np.diff(owner, prepend=-1) == 0)
    through = {}  # of each part but a text's first: from the state before it to its last, up to a factor
    step = max(1, at_once // states)
    for lo in range(0, len(later), step):
        some = later[lo : lo + step]
        a, logs = chains(model, np.tile(model.move, (len(some), 1)), [parts[x] for x in some for _ in range(states)])
        logs = logs.reshape(-1, states, 1)
        through.update(zip(some.tolist(), a.reshape(-1, states, states) * np.exp(logs - logs.max(1, keepdims=True)), strict=True))
    for x in later.tolist():
        if x + 1 < len(parts) and owner[x + 1] == owner[x]:
            v = before[x] @ through[x]
            before[x + 1] = v / v.sum()
    for x in later[::-1].tolist():
        v = through[x] @ after[x]
        after[x - 1] = v / v.max()
    return Cuts(parts, before, after)


def expected(model: Hmm, cuts: Cuts, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over parts: expected starts and moves and the log likelihood; expected emissions are added to `emit`."""
    ids, active, order = padded(cuts.parts)
    before, after = cuts.before[order], cuts.after[order]
    states, new = len(model.start), ~cuts.before[order].any(axis=1)
    alpha = np.zeros((*ids.shape, states))
    scale = np.ones(ids.shape)
    for t, n in enumerate(active):
        a = (alpha[t - 1, :n] @ model.move if t else np.where(new[:, None], model.start, before @ model.move)) * model.emit[ids[t, :n]]
        scale[t, :n] = a.sum(1)
        alpha[t, :n] = a / scale[t, :n, None]
    moves = np.zeros((states, states))
    last = alpha[np.array([len(p) for p in cuts.parts])[order] - 1, np.arange(len(order))]
    beta = after / (last * after).sum(1, keepdims=True)  # so that alpha * beta sums to one at every step
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        w = model.emit[ids[t, :n]] * beta[:n] / scale[t, :n, None]
        alpha[t, :n] *= beta[:n]  # now the state's probability
        moves += (alpha[t - 1, :n] if t else before).T @ w
        if t:
            beta[:n] = w @ model.move.T
    flat = np.concatenate([ids[t, :n] for t, n in enumerate(active)])
    gamma = np.concatenate([alpha[t, :n] for t, n in enumerate(active)])
    for k in range(states):
        emit[:, k] += np.bincount(flat, weights=gamma[:, k], minlength=len(emit))
    return alpha[0][new].sum(0), moves * model.move, float(np.log(scale).sum())


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = [textvec.words(texts)[0] for _, texts in textvec.slices(batch.column("text"), 1 << 20)]
        if pieces:
            h, n = np.unique(np.concatenate(pieces), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, others binary"


def encode_rows(batches: Iterator[pa.RecordBatch], symbols: Symbols) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 36
    rare = 1 + len(symbols.words)
    for batch in batches:
        for lo, texts in textvec.slices(batch.column("text")):
            h, at = textvec.words(texts)
            ids = symbols.encode(h)
            other = ids >= rare
            made = [np.append(ids[a:b], np.uint16(0)).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            rest = [h[a:b][other[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column("doc_id").slice(lo, n), batch.column("held_out").slice(lo, n), pa.array(np.diff(at) + 1), pa.array(made, pa.binary()), pa.array(rest, pa.binary())],
                names=[x.split()[0] for x in ENCODED.split(", ")],
            )
            row += n


def other_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, hashes, counts = [], [], []
        for row, b in zip(batch.column("row").to_pylist(), batch.column("others").to_pylist(), strict=True):
            h, n = np.unique(np.frombuffer(b, np.int64), return_counts=True)
            rows.append(np.full(len(h), row))
            hashes.append(h)
            counts.append(n)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (rows, hashes, counts)], names=["row", "h", "n"])


def expect_rows(batches: Iterator[pa.RecordBatch], model: Hmm, segment: int, at_once: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """A task's expected counts: a row for each symbol seen, and rows for starts (-1), the log likelihood (-2) and moves (-3 - state).
    Texts run together by length, about `at_once` tokens at a time."""
    states = len(model.start)
    emit, start, moves, logs = np.zeros_like(model.emit), np.zeros(states), np.zeros((states, states)), 0.0

    def run(texts: list[np.ndarray]) -> None:
        nonlocal start, moves, logs
        made = cut(model, texts, segment)
        order = np.argsort([len(p) for p in made.parts], kind="stable")
        size = np.array([len(made.parts[i]) for i in order])
        lo = 0
        while lo < len(order):  # parts of like lengths, whose longest fills its steps with about `at_once` tokens
            hi = lo + max(1, int(np.searchsorted(size[lo:] * np.arange(1, len(size) - lo + 1), at_once, "right")))
            own = order[lo:hi]
            s, m, x = expected(model, Cuts([made.parts[i] for i in own], made.before[own], made.after[own]), emit)
            start, moves, logs, lo = start + s, moves + m, logs + x, hi

    for batch in batches:
        column, waiting, tokens = batch.column("symbols"), [], 0
        for b in column:
            waiting.append(np.frombuffer(b.as_py(), np.uint16))
            tokens += len(waiting[-1])
            if tokens > 8 * at_once:
                run(waiting)
                waiting, tokens = [], 0
        if waiting:
            run(waiting)
    seen = np.flatnonzero(emit.sum(1) > 0)
    numbers = np.vstack([emit[seen], start[None], np.full((1, states), logs), moves])
    names = np.concatenate([seen, [-1, -2], -3 - np.arange(states)])
    yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), *(pa.array(numbers[:, k].astype(np.float64)) for k in range(states))], names=["symbol", *(f"s{k}" for k in range(states))])


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, ln double"


def score_rows(batches: Iterator[pa.RecordBatch], model: Hmm, counts: np.ndarray, frequent: int, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
    base[1 + frequent :] = 0.0  # their words' counts are joined in
    known = (counts > 0).astype(np.int64)
    known[1 + frequent :] = 0
    for batch in batches:
        texts = [np.frombuffer(b, np.uint16) for b in batch.column("symbols").to_pylist()]
        ln = log_likelihood(model, texts)
        sums = np.array([base[t].sum() for t in texts])
        hits = np.array([known[t].sum() for t in texts], np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens")), pa.array(hits), pa.array(sums, pa.float64()), pa.array(ln, pa.float64())], names=[x.split()[0] for x in SCORED.split(", ")])


def fold(of: Column, n: int = 5) -> Column:
    return F.pmod(F.crc32(of.cast("string").cast("binary")), F.lit(n))


def train(encoded: DataFrame, symbols: Symbols, states: int, rounds: int, segment: int, seed: int, tolerance: float = 1e-4) -> tuple[Hmm, list[float]]:
    """Baum-Welch over the rows of `encoded` that are not held out, `rounds` at most; the model and the log likelihood before
    each round."""
    spark = encoded.sparkSession
    model, history = Hmm.first(symbols.counts, states, seed), []
    schema = "symbol long, " + ", ".join(f"s{k} double" for k in range(states))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)  # states x symbols numbers
        made = encoded.where("not held_out").select("symbols").mapInArrow(lambda it, sent=sent: expect_rows(it, sent.value, segment), schema)
        got = made.groupBy("symbol").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).toArrow()  # a row for each symbol
        names = got["symbol"].to_numpy()
        numbers = np.column_stack([got[f"s{k}"].to_numpy() for k in range(states)]) if len(names) else np.zeros((0, states))
        emit, moves = np.zeros((symbols.size, states)), np.zeros((states, states))
        emit[names[names >= 0]] = numbers[names >= 0]
        moves[-3 - names[names <= -3]] = numbers[names <= -3]
        start = numbers[names == -1].sum(0)
        history.append(float(numbers[names == -2][:, 0].sum()))
        model = Hmm.next(start, moves, emit, symbols.counts)
        if len(history) > 1 and history[-1] - history[-2] < tolerance * symbols.counts.sum():
            break
    return model, history


def lm_scores(docs: DataFrame, held_out: Column | None = None, states: int = 8, rounds: int = 3, frequent: int = 65_279, classes: int = 256, segment: int = 2048, seed: int = 10, tolerance: float = 1e-4) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`; scores are log10.

    `held_out`: which rows training leaves out; by default those whose crc32(doc_id as text) is 1 modulo 5.
    """
    if frequent + classes + 1 > 1 << 16:
        raise ValueError("symbols have 16 bits")
    spark = docs.sparkSession
    flag = F.coalesce(held_out if held_out is not None else fold(F.col("doc_id")) == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = stored(rows.where("not held_out").select("text").mapInArrow(count_rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "word-counts")
    ends = rows.where("not held_out").count()
    top = counts.orderBy(F.desc("c"), "h").limit(frequent).toArrow()
    is_rest = F.lit(True)
    if len(top) == frequent:
        last_c, last_h = top["c"][-1].as_py(), top["h"][-1].as_py()
        is_rest = (F.col("c") < last_c) | ((F.col("c") == last_c) & (F.col("h") > last_h))
    elif len(top):
        is_rest = F.lit(False)
    # The remainder of the unsigned hash, as Symbols.encode takes it; a row for each class.
    kind = F.pmod(F.pmod("h", F.lit(classes)) + F.when(F.col("h") < 0, F.lit((1 << 64) % classes)).otherwise(0), F.lit(classes)).cast("int")
    groups = counts.where(is_rest).groupBy(kind.alias("kind")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    by_hash = np.argsort(top["h"].to_numpy().view(np.uint64), kind="stable") if len(top) else np.zeros(0, np.int64)
    words = top["h"].to_numpy().view(np.uint64)[by_hash] if len(top) else np.zeros(0, np.uint64)
    number = np.zeros(1 + len(words) + classes)
    distinct = np.ones(len(number))
    number[0], distinct[1 + len(words) :] = ends, 0
    number[1 : 1 + len(words)] = top["c"].to_numpy()[by_hash] if len(top) else 0
    for r in groups:
        number[1 + len(words) + r["kind"]], distinct[1 + len(words) + r["kind"]] = r["c"], r["v"]
    symbols = Symbols(words, number, distinct, classes)
    total, kinds = int(number.sum()), int(len(words) + sum(r["v"] for r in groups) + (ends > 0))

    sent = spark.sparkContext.broadcast(symbols)  # at most 2**16 symbols
    encoded = stored(rows.mapInArrow(lambda it: encode_rows(it, sent.value), ENCODED), "encoded")
    model, _ = train(encoded, symbols, states, rounds, segment, seed, tolerance)
    ready = spark.sparkContext.broadcast(model)
    n_words = len(words)
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "symbols").mapInArrow(lambda it: score_rows(it, ready.value, number, n_words, total, kinds), SCORED)

    per_class = spark.createDataFrame([(i, float(number[1 + n_words + i] + 0.5 * (distinct[1 + n_words + i] + 1))) for i in range(classes)], "kind int, mass double")
    others = encoded.select("row", "others").where("length(others) > 0").mapInArrow(other_rows, "row long, h long, n long")
    met = others.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("kind", kind).join(F.broadcast(per_class), "kind")
    sums = met.groupBy("row").agg(
        F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (kinds + 1)))).alias("more_base"),
        F.sum(F.col("n") * F.ln((F.col("c") + 0.5) / F.col("mass"))).alias("more_ln"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
    )
    zero = F.lit(0.0)
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        ((F.col("ln") + F.coalesce("more_ln", zero)) / LN10).alias("score"),
    )
