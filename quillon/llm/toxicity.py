"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text's bag is the character n-grams of its words (with a word's edges as characters), each hashed to a bucket with an
embedding. The mean embedding of the whole bag, repeats counted, goes into a linear softmax over (clean, toxic);
embeddings and softmax are trained jointly in numpy on the labels of documents. As misspelt and inflected words share
n-grams with their root, unseen forms score like it.

A few thousand documents hold far more n-grams than documents, so training is sparse: the pull of all documents on a
bucket's embedding is divided by its standard deviation under labels drawn at random, and only what exceeds `least` of
these moves the bucket; in round i the whole move has the length rate / (1 + i / 10). A fifth of the rows is left out of it, and a
logistic fit of their logits turns logits into probabilities.

Training uses at most `max_rows` labelled documents, chosen by a hash of doc_id, whose texts have at most `max_chars`
code points together (documented bounds; a longer text alone still counts). Bags are made where the texts are; one
task trains on them, and only the model goes to the driver. Scoring reads every text whole, in blocks of `BLOCK` code
points: an n-gram needs no more than its own characters, so blocks that look a few characters ahead give exactly the
bag of the whole text. As the softmax is linear in the mean, each bucket is reduced to one number first (``2**bits``
floats, sent to executors), and a text costs a gather for each n-gram.

Null and empty texts have an empty bag and score as the prior of the training labels. Labels other than 0 and 1 and null
labels are not used; if no label is left, or of one class only, every score is that class's share (0 without labels).
Labels repeated for one doc_id count once, as toxic if any of them is; of rows repeated with one labelled doc_id one is
trained on. Rows with one doc_id are scored each for itself. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SIZES = (3, 4, 5)
BLOCK = 1 << 18
_LETTER = np.ones(0x3100, dtype=bool)
for _lo, _hi in ((0, 48), (58, 65), (91, 97), (123, 170), (171, 181), (182, 186), (187, 192), (0x2000, 0x2070), (0x3000, 0x3040)):
    _LETTER[_lo:_hi] = False
_LETTER[[215, 247]] = False


def grams(flat: str, bits: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, position) of the n-grams of the words of `flat` that begin before `upto`, in no order. The first and last
    character of an n-gram may be a word's edge, whatever stands there."""
    c = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(c, 0x30FF)]
    symbol = np.where(letter, c, 0).astype(np.uint32)
    h, inner = symbol, letter
    buckets, places = [], []
    for n in range(2, max(SIZES) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + symbol[n - 1 :]
        if n == 3:
            inner = letter[1 : len(c) - 1]
        elif n > 3:
            inner = inner[: len(c) - n + 1] & letter[n - 2 : len(c) - 1]
        if n in SIZES:
            ok = np.flatnonzero(inner[:upto])
            x = h[ok] + np.uint32(n)
            x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
            buckets.append((x >> np.uint32(32 - bits)).astype(np.int32))
            places.append(ok)
    none = np.zeros(0, np.int32)
    return np.concatenate(buckets or [none]), np.concatenate(places or [none])


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, str, int]]:
    """(where each text begins, their characters, how many of them begin an n-gram) in pieces of about `BLOCK`: short
    texts together, set apart by blanks, long ones in several pieces."""
    flat = " " + " ".join(t.lower() for t in texts) + " "
    begin = np.cumsum([0] + [len(t.lower()) + 1 for t in texts])
    for lo in range(0, len(flat), BLOCK):
        yield begin - lo, flat[lo : lo + BLOCK + max(SIZES) - 1], BLOCK


def batches_of(texts: list[str]) -> Iterator[slice]:
    """Rows whose texts have about `BLOCK` code points together; a longer text is alone."""
    lo = size = 0
    for hi, t in enumerate(texts):
        if hi > lo and size + len(t) > BLOCK:
            yield slice(lo, hi)
            lo, size = hi, 0
        size += len(t)
    if lo < len(texts):
        yield slice(lo, len(texts))


@dataclass
class Model:
    weight: np.ndarray  # logit of a bucket: toxic minus clean
    bias: float
    slope: float
    shift: float
    prior: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The softmax's logit of each text's mean embedding, and the size of its bag."""
        bits = len(self.weight).bit_length() - 1
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for begin, flat, upto in blocks(texts):
            bucket, place = grams(flat, bits, upto)
            owner = np.searchsorted(begin, place, "right") - 1
            total += np.bincount(owner, weights=self.weight[bucket], minlength=len(texts))
            count += np.bincount(owner, minlength=len(texts))
        return total / np.maximum(count, 1) + self.bias, count

    def scores(self, texts: list[str]) -> np.ndarray:
        logit, count = self.logits(texts)
        return np.where(count > 0, 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -30, 30))), self.prior)


def bag(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and how often each occurs."""
    found = [np.unique(grams(flat, bits, upto)[0], return_counts=True) for _, flat, upto in blocks([text])]
    if len(found) == 1:
        return found[0]
    n = np.zeros(1 << bits, np.int64)
    for bucket, times in found:
        n[bucket] += times
    return np.flatnonzero(n).astype(np.int32), n[n > 0]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of P(y) = sigmoid(slope * x + shift), by Newton's steps with a little ridge."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum()])
        m = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(m + 1e-9 * np.eye(2), g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def shares(times: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each bucket's share of its text's bag; `size`: buckets of each text."""
    text = np.repeat(np.arange(len(size)), size)
    return (times / np.bincount(text, weights=times, minlength=len(size))[text]).astype(np.float32)


def train(bucket: np.ndarray, times: np.ndarray, size: np.ndarray, labels: np.ndarray, **options) -> Model:
    """`trained` on the bags of all texts, end to end: `size` distinct buckets of each text, each bucket and how often it occurs."""
    return trained([(bucket, shares(times, size), size)] if len(size) else [], labels, **options)


def trained(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = 18, dim: int = 8, steps: int = 25, rate: float = 400.0, least: float = 3.5, seed: int = 9) -> Model:
    """Joint training of embeddings and softmax on `bags`: (buckets, their shares, buckets of each text) of successive texts. They are
    used as they are, without a copy of all."""
    y = np.asarray(labels, np.float64)
    prior, none = float(y.mean()) if len(y) else 0.0, np.zeros(1 << bits, np.float32)
    if not 0 < prior < 1:
        return Model(none, 0.0, 0.0, -30.0 if prior == 0 else 30.0, prior)
    some = np.concatenate([size for _, _, size in bags]) > 0
    tuning = (np.arange(len(y)) % 5 == 4) & some
    if len(set(y[tuning])) < 2 or len(set(y[some & ~tuning])) < 2:
        tuning = np.zeros(len(y), bool)  # too few rows to leave any out
    fitted = some & ~tuning
    q = float(y[fitted].mean()) if fitted.any() else 0.0
    if not 0 < q < 1:
        return Model(none, 0.0, 0.0, 0.0, prior)
    parts, first = [], 0
    for bucket, share, size in bags:
        at = np.concatenate([[0], np.cumsum(size)])
        cuts = np.unique(np.searchsorted(at, np.arange(0, at[-1] + (1 << 20), 1 << 20)).clip(max=len(size)))
        parts += [(first + lo, first + hi, size[lo:hi], bucket[at[lo] : at[hi]], share[at[lo] : at[hi]]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        first += len(size)

    def gathered(of_text: np.ndarray, power: int = 1) -> np.ndarray:
        """For each bucket the sum over texts of `of_text` times its share in the text."""
        out = np.zeros(1 << bits)
        for lo, hi, size, bucket, share in parts:
            out += np.bincount(bucket, weights=share**power * np.repeat(of_text[lo:hi], size), minlength=1 << bits)
        return out

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / dim, (1 << bits, dim)).astype(np.float32)
    soft = rng.normal(0, 1, (2, dim)).astype(np.float32)  # clean, toxic
    soft /= np.linalg.norm(soft[1] - soft[0])
    bias = float(np.log(q / (1 - q)))
    spread = np.sqrt(gathered(fitted.astype(float), 2) * q * (1 - q))

    def logits() -> np.ndarray:
        weight, out = emb @ (soft[1] - soft[0]), np.zeros(len(y))
        for lo, hi, size, bucket, share in parts:
            out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), size), weights=weight[bucket] * share, minlength=hi - lo)
        return out + bias

    for i in range(steps):
        g = np.where(fitted, 1 / (1 + np.exp(-np.clip(logits(), -30, 30))) - y, 0.0)  # of the toxic logit; the clean one's is its negative
        pull = gathered(g)
        z = np.divide(pull, spread, out=np.zeros_like(pull), where=spread > 0)
        move = np.sign(z) * np.maximum(np.abs(z) - least, 0)
        now = rate / (1 + i / 10)
        length, towards = float(np.sqrt((move**2).sum())), soft[1] - soft[0]
        change = (pull[:, None] * emb).sum(0)  # of the softmax, while the embeddings move
        if length:
            emb -= (now / length * move)[:, None].astype(np.float32) * towards
        step = (change / max(1.0, float(np.abs(change).max())) * 0.01).astype(np.float32)
        soft[1] -= step
        soft[0] += step
        bias -= float(g.sum() / fitted.sum())
    tune = tuning if tuning.any() else fitted
    slope, shift = logistic(logits()[tune], y[tune])
    return Model((emb @ (soft[1] - soft[0])).astype(np.float32), bias, slope, shift, prior)


def text_scores(texts: pa.Array, model: Model, rows: int = 512) -> np.ndarray:
    """The score of each text, so many texts at a time as Python strings."""
    out = [np.zeros(0)]
    for lo in range(0, len(texts), rows):
        some = [t or "" for t in texts.slice(lo, rows).to_pylist()]
        out += [model.scores(some[own]) for own in batches_of(some)]
    return np.concatenate(out)


def score_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text_scores(batch.column("text"), model), pa.float64())], names=["doc_id", "score"])


def bag_rows(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            made = [bag(t or "", bits) for t in part.column("text").to_pylist()]
            columns = [pa.array([b.astype(np.int32).tobytes() for b, _ in made], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *columns], names=["doc_id", "toxic", "bucket", "times"])


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary column end to end, and how many each row has; nothing is copied."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.int32) if data is not None else np.zeros(0, np.int32), np.diff(offsets) // 4


def fold(of: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(of.cast("string").cast("binary")), F.lit(n))


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, max_rows: int = 8_000, max_chars: int = 32_000_000, bits: int = 18, seed: int = 9, **options) -> Model:
    """Train on labelled rows of `docs`; `held_out`: a fold of doc_id that training never sees."""
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    if held_out is not None:
        known = known.where(fold(F.col("doc_id")) != held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    draw = F.xxhash64(F.lit(seed), "doc_id")
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(draw, "doc_id").limit(max_rows)
    # At most max_rows ids, so they may be broadcast. One row of each goes on; lengths alone decide which texts fit.
    found = rows.join(F.broadcast(picked), "doc_id")
    sizes = found.groupBy("doc_id").agg(F.max(F.length("text")).cast("long").alias("n"))
    so_far = Window.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # max_rows rows at most
    fitting = sizes.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("n") <= max_chars))
    kept = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in fitting.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic").collect()], "doc_id long, toxic int")
    options |= {"seed": seed, "bits": bits}
    bags = rows.join(F.broadcast(kept), "doc_id").select("doc_id", "toxic", "text").mapInArrow(lambda it: bag_rows(it, bits), "doc_id long, toxic int, bucket binary, times binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, marks, last = [], [np.zeros(0, np.int32)], None
        for batch in batches:
            ids = np.array([last, *batch.column("doc_id").to_pylist()], object)
            batch = batch.filter(pa.array(ids[1:] != ids[:-1], pa.bool_()))
            last = ids[-1]
            bucket, size = joined(batch.column("bucket"))
            if len(size):
                bags.append((bucket, shares(joined(batch.column("times"))[0], size), size))
                marks.append(batch.column("toxic").to_numpy())
        m = trained(bags, np.concatenate(marks), **options)
        yield pa.RecordBatch.from_pydict({"weight": [m.weight.tobytes()], "numbers": [[m.bias, m.slope, m.shift, m.prior]]})

    made = bags.repartition(1).sortWithinPartitions("doc_id", "bucket").mapInArrow(run, "weight binary, numbers array<double>").first()
    if made is None:  # no row has a label
        none = np.zeros(0, np.int32)
        return train(none, none, none, none, **options)
    return Model(np.frombuffer(made["weight"], np.float32), *made["numbers"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats
    scored = rows.mapInArrow(lambda it: score_rows(it, shared.value), "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose score is below one half, with all their columns, whatever their names."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(text_scores(batch.column(at), shared.value) < 0.5))

    return docs.mapInArrow(run, docs.schema)
