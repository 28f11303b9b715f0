"""Chunkers: passages (passage_id, text) -> spans (strategy, passage_id, chunk_index, char_start, char_end, n_tokens).

Spans are 0-based and half-open, in code points of the normalised text. Text is never stored with a chunk; `chunk_text`
derives it. chunk_id is made from passage and index, so it needs no global numbering.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import points
from ..functions import text as tx
from ..functions import vectors
from ..sources.files import written

SLOTS = 1 << 20
PIECE = r"\s*(?:%s)" % tx.TOKEN  # a token and the blank before it


def chunk_id(passage_id: Column, index: Column) -> Column:
    """passage_id * 2**20 + index; an error where that would not fit or run into the next passage's ids."""
    fits = passage_id.between(-(1 << 43), (1 << 43) - 1) & (index < SLOTS)
    return F.when(fits | passage_id.isNull(), passage_id * F.lit(SLOTS) + index).otherwise(F.raise_error(F.lit("no chunk id: passage ids have 44 bits, a passage 2**20 chunks")).cast("long"))


def finished(spans: DataFrame, strategy: str | Column) -> DataFrame:
    """From (passage_id, chunk_index, char_start, char_end, n_tokens) to the common columns."""
    return spans.select(
        chunk_id(F.col("passage_id"), F.col("chunk_index")).alias("chunk_id"),
        (F.lit(strategy) if isinstance(strategy, str) else strategy).alias("strategy"),
        "passage_id",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("char_start").cast("int").alias("char_start"),
        F.col("char_end").cast("int").alias("char_end"),
        F.col("n_tokens").cast("int").alias("n_tokens"),
    )


def whole(passages: DataFrame) -> DataFrame:
    return finished(passages.select("passage_id", F.lit(0).alias("chunk_index"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), tx.n_tokens(F.col("text")).alias("n_tokens")), "passage")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """array<int>: the sum of all lengths before each, by doubling: in as many passes as the number of lengths has bits."""
    strides = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)).cast("double"))).cast("int")), lambda j: F.pow(F.lit(2), j).cast("int"))
    sums = F.aggregate(strides, lengths, lambda acc, stride: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - stride), F.lit(0))))
    return F.zip_with(sums, lengths, lambda total, x: total - x)


BLOCK = 4096  # code points


def bodies(text: Column, spans: Column, s: str = "s", e: str = "e") -> Column:
    """`spans` (array of structs with the fields `s` and `e`), each with its `body`. The text is cut into blocks once, so a span costs its
    own length and a block, wherever it is."""

    def of(blocks: Column) -> Column:
        def one(x: Column) -> Column:
            first = F.floor(x[s] / BLOCK).cast("int")
            held = F.array_join(F.slice(blocks, first + 1, F.floor((x[e] + BLOCK - 1) / BLOCK).cast("int") - first), "")
            return x.withField("body", F.when(x[e] > x[s], F.substr(held, x[s] - first * BLOCK + 1, x[e] - x[s])).otherwise(""))

        return F.transform(spans, one)

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), of)


def windows(passages: DataFrame, unit: str, n: Column, size: int, overlap: int) -> DataFrame:
    """(passage_id, text, each): windows of `size` units (a pattern; units follow each other without a gap), each `size - overlap`
    after the one before; the last ends with the text. `each` is array<struct<s, body>>.

    The text is cut once into strides of `size - overlap` units; a window is a stride and the head of the next ones.
    """
    step = size - overlap
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    ahead = -(-overlap // step)  # strides that hold a window's tail
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    # A generated row, so that the strides are computed once, before they are looked into by place.
    strides = F.explode(F.array(F.regexp_extract_all("text", F.lit(r"(?:%s){1,%d}" % (unit, step)), F.lit(0))))
    rows = passages.select("passage_id", "text", strides.alias("strides"), count.alias("windows"))

    def tail(i: Column) -> Column:
        if not overlap:
            return F.lit("")
        return F.regexp_extract(F.array_join(F.slice("strides", i + 2, F.lit(ahead)), ""), r"^(?:%s){1,%d}" % (unit, overlap), 0)

    at = running(F.transform("strides", lambda x: F.length(x)))
    each = let(at, lambda at: F.transform(F.slice("strides", F.lit(1), F.col("windows")), lambda x, i: F.struct(F.get(at, i).alias("s"), F.concat(x, tail(i)).alias("body"))))
    return rows.select("passage_id", "text", each.alias("each"))


Cut = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def nth(owner: np.ndarray, n: int) -> np.ndarray:
    """The place of each row among those of its owner; owners are in order, below `n`."""
    sizes = np.bincount(owner, minlength=n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def cut_rows(passages: DataFrame, cuts: list[Cut], body: bool = False) -> DataFrame:
    """(passage_id, chunk_index, char_start, char_end, n_tokens, nth), with `body` the text too: the spans that each of `cuts` finds in
    the code points of many texts at once, given where each text begins and the tokens before each place: (text, begin, end), in
    order. The texts are read once for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in points.parts(batch):
                cps, starts = points.points(texts)
                tokens = {wide: points.tokens_before(cps, starts, wide) for wide in {wide_of(c) for c in cuts}}
                for i, cut in enumerate(cuts):
                    before = tokens[wide_of(cut)]
                    owner, s, e = cut(cps, starts, before)
                    a, b = s - starts[owner], e - starts[owner]
                    made = [part.column("passage_id").take(pa.array(owner)), *(pa.array(x.astype(np.int32)) for x in (nth(owner, len(texts)), a, b, points.n_tokens(cps, before, s, e), np.full(len(owner), i)))]
                    if body:
                        made.append(pa.array([texts[t][i:j] for t, i, j in zip(owner.tolist(), a.tolist(), b.tolist(), strict=True)], pa.string()))
                    yield pa.RecordBatch.from_arrays(made, names=SPAN_NAMES[: len(made)])

    return passages.select(F.col("passage_id").cast("long").alias("passage_id"), "text").mapInArrow(run, SPANS + (", text string" if body else ""))


def wide_of(cut: Cut) -> bool:
    """Whether a cut counts tokens between all that Python holds for white space (`points.classes`)."""
    return getattr(cut, "wide", False)


def whole_texts(cps: np.ndarray, starts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.arange(len(starts) - 1), starts[:-1], starts[1:]


SPANS = "passage_id long, chunk_index int, char_start int, char_end int, n_tokens int, nth int"
SPAN_NAMES = ["passage_id", "chunk_index", "char_start", "char_end", "n_tokens", "nth", "text"]


def word_windows(size: int, overlap: int) -> Cut:
    """Windows of `size` words, each `size - overlap` after the one before; the last ends with the text."""
    step = size - overlap
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")

    def cut(cps: np.ndarray, starts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begins, ends = points.runs(cps != 32, starts)
        first = np.searchsorted(begins, starts)  # of each text, the number of its first word
        n = np.diff(first)
        count = np.where(n <= size, np.minimum(n, 1), 1 - (size - n) // step)
        owner = np.repeat(np.arange(len(n)), count)
        at = step * nth(owner, len(n))
        return owner, begins[first[owner] + at], ends[first[owner] + np.minimum(at + size, n[owner]) - 1]

    return cut


def fixed(passages: DataFrame, size: int = 128, overlap: int = 32) -> DataFrame:
    """Windows of `size` words."""
    return finished(cut_rows(passages, [word_windows(size, overlap)]), f"fixed_{size}_{overlap}")


@F.pandas_udf(ArrayType(IntegerType()))
def summed_before(lengths: pd.Series) -> pd.Series:
    """`running` in one pass, for lists as long as a text has tokens."""
    return pd.Series([np.cumsum(x) - x for x in lengths])


def token_offsets(text: Column) -> Column:
    """array<int>: where each token begins, with the blank before it, and the text's length at the end."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.array_append(summed_before(F.transform(pieces, lambda x: F.length(x))), F.length(text))


@F.pandas_udf(ArrayType(StructType([StructField("s", IntegerType()), StructField("e", IntegerType())])))
def widened(starts: pd.Series, ends: pd.Series, words: pd.Series) -> pd.Series:
    """Spans moved out to whole words; `words` has the lengths of all words, which one blank parts."""
    out = []
    for s, e, w in zip(starts, ends, words, strict=True):
        first = np.concatenate([[0], np.cumsum(np.asarray(w) + 1)])[:-1]
        last = first + np.asarray(w)
        s, e = np.asarray(s), np.asarray(e)
        s = np.where(s > last[np.searchsorted(first, s, "right") - 1], s, first[np.searchsorted(first, s, "right") - 1])
        e = last[np.minimum(np.searchsorted(last, e), len(last) - 1)]
        out.append([{"s": int(a), "e": int(b)} for a, b in zip(s, e, strict=True)])
    return pd.Series(out)


def tokens(passages: DataFrame, size: int = 128, overlap: int = 32) -> DataFrame:
    """Windows of `size` tokens, widened to whole words: the start moves left behind white space, the end right to the next,
    so a window may have more than `size`. A text of at most `size` tokens is one window."""
    rows = windows(passages, PIECE, tx.n_tokens(F.col("text")), size, overlap)
    starts, ends = F.transform("each", lambda x: x["s"]), F.transform("each", lambda x: x["s"] + F.length(x["body"]))
    wide = rows.select("passage_id", "text", widened(starts, ends, F.transform(F.split("text", " "), lambda w: F.length(w))).alias("spans"))
    each = wide.select("passage_id", F.posexplode(bodies(F.col("text"), F.col("spans"))).alias("chunk_index", "x")).select("passage_id", "chunk_index", "x.s", "x.body")
    return finished(finalised(each).withColumn("n_tokens", tx.n_tokens(F.col("body"))), f"tokens_{size}_{overlap}")


def finalised(spans: DataFrame) -> DataFrame:
    """Spans (passage_id, chunk_index, s, body), trimmed, without empty ones, numbered anew without gaps: (passage_id, chunk_index,
    char_start, char_end, body)."""
    s, e = tx.trim_span(F.col("body"), F.lit(0), F.length("body"))
    cut = spans.select("passage_id", F.col("chunk_index").alias("was"), "s", "body", s.cast("int").alias("a"), e.cast("int").alias("b")).where("b > a")
    nth = F.row_number().over(Window.partitionBy("passage_id").orderBy("was")) - 1
    return cut.select("passage_id", nth.alias("chunk_index"), (F.col("s") + F.col("a")).alias("char_start"), (F.col("s") + F.col("b")).alias("char_end"), F.substr("body", F.col("a") + 1, F.col("b") - F.col("a")).alias("body"))


def sentence_list(text: Column) -> Column:
    """array<struct<i, sentence, n_tokens, s, e>>: the sentences of a text with their spans, within the row."""
    listed = F.transform(tx.sentences(text), lambda x: F.struct(x.alias("sentence"), tx.n_tokens(x).alias("n_tokens"), F.length(x).alias("len")))

    def spanned(l: Column) -> Column:
        at = running(F.transform(l, lambda x: x["len"] + 1))
        return F.zip_with(
            F.transform(l, lambda x, i: x.withField("i", i)), at, lambda x, s: F.struct(x["i"].alias("i"), x["sentence"].alias("sentence"), x["n_tokens"].alias("n_tokens"), s.alias("s"), (s + x["len"]).alias("e"))
        )

    return let(listed, spanned)


def sentence_rows(passages: DataFrame) -> DataFrame:
    """(passage_id, i, sentence, n_tokens, s, e): each sentence with its span."""
    return passages.select("passage_id", F.explode(sentence_list(F.col("text"))).alias("x")).select("passage_id", "x.*")


ENDS, OPENS = np.array([ord(c) for c in ".!?"], np.uint32), np.array([ord(c) for c in "([ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"], np.uint32)


def sentence_spans(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the sentences of normalised texts, where one blank parts what `text.SENTENCE_BREAK` breaks."""
    blank = np.flatnonzero(cps == 32)
    owner = np.searchsorted(starts, blank, "right") - 1
    inner = (blank > starts[owner]) & (blank + 1 < starts[owner + 1])
    blank, owner = blank[inner], owner[inner]
    breaks = np.isin(cps[blank - 1], ENDS) & np.isin(cps[blank + 1], OPENS)
    blank, owner = blank[breaks], owner[breaks]
    every = np.concatenate([np.arange(len(starts) - 1), owner])
    begin = np.concatenate([starts[:-1], blank + 1])
    order = np.lexsort((begin, every))
    every, begin = every[order], begin[order]
    last = np.concatenate([every[1:] != every[:-1], [True]])
    return every, begin, np.where(last, starts[every + 1], np.concatenate([begin[1:], [0]]) - 1)


def joined_sentences(least: int) -> Cut:
    """One sentence each; one of fewer than `least` tokens joins the chunk before it."""

    def cut(cps: np.ndarray, starts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, s, e = sentence_spans(cps, starts)
        begins = np.flatnonzero((nth(owner, len(starts) - 1) == 0) | (before[e] - before[s] >= least))
        return owner[begins], s[begins], e[np.concatenate([begins[1:], [len(owner)]]) - 1]

    return cut


def sentence(passages: DataFrame, least: int = 6) -> DataFrame:
    """One sentence each; one of fewer than `least` tokens joins the chunk before it."""
    return finished(cut_rows(passages, [joined_sentences(least)]), "sentence")


def sentence_units(passages: DataFrame, least: int = 6) -> DataFrame:
    """`cut_units` of `sentence`."""
    return cut_units(passages, joined_sentences(least))


def distance_list(text: Column) -> Column:
    """`sentence_list` with `dist`, the distance to the sentence before (null for the first): 1 - cosine of their term sets."""
    terms = lambda l: F.transform(l, lambda x: x.withField("terms", F.array_distinct(tx.index_tokens(x["sentence"], []))))

    def with_distance(l: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(l, i - 1)["terms"]
            dist = F.when(i > 0, F.round(1 - vectors.term_cosine(before, x["terms"]), 9))
            return F.struct(*[x[c].alias(c) for c in ("i", "n_tokens", "s", "e")], dist.alias("dist"))

        return F.transform(l, one)

    return F.element_at(F.transform(F.array(terms(sentence_list(text))), with_distance), 1)


def adjacent_distances(passages: DataFrame) -> DataFrame:
    """(passage_id, i, n_tokens, s, e, dist) of each sentence."""
    return passages.select("passage_id", F.explode(distance_list(F.col("text"))).alias("x")).select("passage_id", "x.*")


def every_nth(passages: DataFrame, most: int = 1500) -> DataFrame:
    """Every max(1, n // most)-th of n passages in order of passage_id, `most` at most. Ranks come from parts of the ids
    between quantiles, so no task sorts them all."""
    ids = passages.select("passage_id")
    parts = 4 * ids.sparkSession.sparkContext.defaultParallelism
    cuts = ids.agg(F.percentile_approx("passage_id", [i / parts for i in range(1, parts)], 20 * parts).alias("c")).first()["c"] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(cuts))]).cast("array<long>")  # fewer than parts
    placed = passages.withColumn("__part", F.size(F.filter(bounds, lambda b: b < F.col("passage_id"))))
    counts, before, total = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}, {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    if not total:
        return passages
    first = F.create_map(*[F.lit(x) for p in before for x in (p, before[p])])
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("passage_id")) - 1 + F.element_at(first, F.col("__part"))
    step = max(1, total // most)
    return placed.withColumn("__rank", rank).where((F.col("__rank") % step == 0) & (F.col("__rank") < step * most)).drop("__part", "__rank")


def calibrated(passages: DataFrame, share: float = 0.75, sample: int = 1500) -> float:
    """The percentile of adjacent distances over every n-th passage, at most `sample` of them; `calibrated_whole` is that over all."""
    found = adjacent_distances(every_nth(passages, sample)).agg(F.expr(f"percentile(dist, {share})").alias("p")).first()["p"]
    return 0.5 if found is None else found


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """As `round` does, halves up in the decimal form; only what lies near a half takes that form."""
    scale = 10.0**digits
    up = np.floor(x * scale + 0.5)
    near = np.flatnonzero(np.abs(x * scale + 0.5 - np.rint(x * scale + 0.5)) < 1e-5)
    up[near] = [float(Decimal(repr(v)).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP)) for v in x[near].tolist()]
    return up / scale


def term_distances(texts: list[str]) -> np.ndarray:
    """1 - cosine of the term sets of each lower-case text and the one before; of the first, 1."""
    unit, term = points.terms(*points.points(texts))
    coded = term.dictionary_encode()
    size = len(coded.dictionary)
    key = np.sort(unit * size + coded.indices.to_numpy())  # np.unique would hash them first, which takes longer
    if not len(key):
        return np.ones(len(texts))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    at = np.minimum(np.searchsorted(key, key - size), len(key) - 1)
    both = np.bincount(key[key[at] == key - size] // size, minlength=len(texts))
    n = np.bincount(key // size, minlength=len(texts))
    product = n * np.concatenate([[0], n[:-1]])
    return rounded(1 - np.where(product == 0, 0.0, both / np.sqrt(np.maximum(product, 1).astype(float))))


def distance_counts(passages: DataFrame) -> DataFrame:
    """(v, n): how often each distance of adjacent sentences occurs, in billionths; a row for each batch that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in points.parts(batch):
                cps, starts = points.points(texts)
                owner, s, e = sentence_spans(cps, starts)
                v, n = np.unique(np.rint(sentence_distances(cps, s, e)[nth(owner, len(texts)) > 0] * 1e9).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], names=["v", "n"])

    return passages.select("text").mapInArrow(run, "v long, n long")


def calibrated_whole(passages: DataFrame, share: float = 0.75) -> float:
    """The percentile of adjacent distances over all passages, exact: distances have nine digits, so the two that it lies between are
    found among counts of ranges of them and then in their ranges, both of which have about the root of a billion values."""
    counts, width = written(distance_counts(passages), "distances"), 31_623
    ranges = counts.groupBy(F.floor(F.col("v") / width).alias("at")).agg(F.sum("n").alias("n")).toArrow().sort_by("at")
    at, ends = ranges["at"].to_numpy(), np.cumsum(ranges["n"].to_numpy())
    if not len(at):
        return 0.5
    place = (int(ends[-1]) - 1) * share
    low, high = int(np.floor(place)), int(np.ceil(place))
    held = np.searchsorted(ends, [low, high], "right")
    values = counts.where(F.floor(F.col("v") / width).isin(sorted({int(at[i]) for i in held}))).groupBy("v").agg(F.sum("n").alias("n")).toArrow().sort_by("v")
    before = int(ends[held[0] - 1]) if held[0] else 0  # the ranges that hold the two follow each other
    low_value, high_value = (values["v"].to_numpy()[np.searchsorted(np.cumsum(values["n"].to_numpy()), [low - before, high - before], "right")] / 1e9).tolist()
    return low_value if low_value == high_value else (high - place) * low_value + (place - low) * high_value


def sentence_distances(cps: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """`term_distances` of the sentences with these ends."""
    text = cps.tobytes().decode("utf-32-le")
    return term_distances([text[a:b].lower() for a, b in zip(s.tolist(), e.tolist(), strict=True)])


def grouped_sentences(threshold: float, least: int, most: int) -> Cut:
    """Successive sentences, with a new group where `semantic` says."""

    def cut(cps: np.ndarray, starts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, s, e = sentence_spans(cps, starts)
        far = sentence_distances(cps, s, e) > threshold
        first, begins, held = nth(owner, len(starts) - 1) == 0, [], 0
        for i, (opens, n, breaks) in enumerate(zip(first.tolist(), (before[e] - before[s]).tolist(), far.tolist(), strict=True)):
            if opens or (breaks and held >= least) or held + n > most:
                begins.append(i)
                held = 0
            held += n
        at = np.array(begins, np.int64)
        return owner[at], s[at], e[np.concatenate([at[1:], [len(owner)]]) - 1]

    return cut


def semantic(passages: DataFrame, threshold: float | None = None, least: int = 6, most: int = 256) -> DataFrame:
    """Successive sentences grouped: a new chunk begins where the distance is above `threshold` (by default the calibrated
    one) and the group has `least` tokens, or where the group would get more than `most`."""
    threshold = calibrated(passages) if threshold is None else threshold
    return finished(cut_rows(passages, [grouped_sentences(threshold, least, most)]), "semantic")


#: Where a recursive split looks first.
SEPARATORS = (". ", "? ", "! ", "; ", ", ", " ", "")


def split_spans(text: str, size: int, overlap: int, count: Callable[[str], int]) -> list[tuple[int, int]]:
    """Spans of a recursive split: by the first separator that leaves small enough pieces, coarse ones first, each
    separator staying with what it ends; then greedy runs of pieces up to `size` tokens, which begin anew at most
    `overlap` tokens before the end of the last."""
    return split_at(text, size, overlap, lambda s, e: count(text[s:e]))


def split_at(text: str, size: int, overlap: int, count: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """`split_spans` with the tokens of a span counted by its ends."""

    def pieces(s: int, e: int, level: int) -> Iterator[tuple[int, int]]:
        if count(s, e) <= size or level == len(SEPARATORS):
            yield s, e
        elif not SEPARATORS[level]:
            yield from ((i, i + 1) for i in range(s, e))
        else:
            at = s
            while at < e:
                hit = text.find(SEPARATORS[level], at, e)
                end = e if hit < 0 else hit + len(SEPARATORS[level])
                yield from pieces(at, end, level + 1)
                at = end

    runs: list[tuple[int, int]] = []
    held: list[tuple[int, int, int]] = []
    total = 0
    for s, e in pieces(0, len(text), 0):
        n = count(s, e)
        if held and total + n > size:
            runs.append((held[0][0], held[-1][1]))
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[2]
        held.append((s, e, n))
        total += n
    if held:
        runs.append((held[0][0], held[-1][1]))
    out = []
    for s, e in runs:
        body = text[s:e]
        s, e = s + len(body) - len(body.lstrip()), e - (len(body) - len(body.rstrip()))
        if e > s:
            out.append((s, e))
    return out


def recursive_runs(size: int, overlap: int) -> Cut:
    """`split_at` of each text: recursion does not fit an expression."""

    def cut(cps: np.ndarray, starts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = cps.tobytes().decode("utf-32-le")
        within = np.concatenate([(points.classes()[cps] == points.LETTER) & (before[1:] == before[:-1]), [False]])
        owner, begin, end = [], [], []
        for t, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            spans = split_at(text[lo:hi], size, overlap, lambda s, e: int(before[lo + e] - before[lo + s]) + bool(s < e and within[lo + s]))  # noqa: B023
            owner += [t] * len(spans)
            begin += [lo + s for s, _ in spans]
            end += [lo + e for _, e in spans]
        return np.array(owner, np.int64), np.array(begin, np.int64), np.array(end, np.int64)

    cut.wide = True
    return cut


def recursive(passages: DataFrame, size: int = 128, overlap: int = 32) -> DataFrame:
    """`split_spans` of each passage; tokens are counted once for a text and not anew for each piece."""
    return finished(cut_rows(passages, [recursive_runs(size, overlap)]), f"recursive_{size}_{overlap}")


def chunker(name: str, threshold: float | None = None) -> Callable[[DataFrame], DataFrame]:
    """The chunker of a strategy name: passage, fixed_<size>_<overlap>, tokens_<size>_<overlap>, recursive_<size>_<overlap>,
    sentence, semantic."""
    kind, *numbers = name.split("_")
    sized = {"fixed": fixed, "tokens": tokens, "recursive": recursive}
    if kind in sized and len(numbers) == 2:
        size, overlap = map(int, numbers)
        return lambda p: sized[kind](p, size, overlap)
    if name == "semantic":
        return lambda p: semantic(p, threshold)
    if name in ("passage", "sentence"):
        return {"passage": whole, "sentence": sentence}[name]
    raise ValueError(f"no chunker is named {name}")


def cut_of(name: str, threshold: float | None = None) -> Cut:
    """The cut of a strategy (those of `chunker` but for windows of tokens); of semantic breaks at `threshold`."""
    kind, *numbers = name.split("_")
    if kind in ("fixed", "recursive"):
        return {"fixed": word_windows, "recursive": recursive_runs}[kind](*map(int, numbers))
    return {"passage": lambda: whole_texts, "sentence": lambda: joined_sentences(6), "semantic": lambda: grouped_sentences(threshold, 6, 256)}[kind]()


def cut_units(passages: DataFrame, cut: Cut) -> DataFrame:
    """(chunk_id, passage_id, chunk_index, char_start, char_end, text): the chunks of a cut with their text, which is taken where its
    spans are found, so that spans and texts need not meet again."""
    rows = cut_rows(passages, [cut], body=True)
    return rows.select(chunk_id(F.col("passage_id"), F.col("chunk_index")).alias("chunk_id"), "passage_id", "chunk_index", "char_start", "char_end", "text")


def several(passages: DataFrame, names: list[str]) -> DataFrame:
    """The chunks of several strategies (those of `chunker` but for windows of tokens), found in one pass over the texts. Semantic breaks
    are calibrated over all of them."""
    cuts = [cut_of(name, calibrated_whole(passages) if name == "semantic" else None) for name in names]
    return finished(cut_rows(passages, cuts), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("nth") + 1))


#: The strategies that are built by default.
DEFAULT_STRATEGIES = ["passage", "fixed_128_32", "recursive_128_32", "sentence", "semantic"]


def chunk_text(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """Chunks with their text. The chunks of a passage meet it together, and its text is cut into blocks once."""
    lists = chunks.groupBy("passage_id").agg(F.collect_list(F.struct(*chunks.columns)).alias("__spans"))
    met = lists.join(passages.select("passage_id", "text"), "passage_id")
    each = met.select(F.explode(bodies(F.col("text"), F.col("__spans"), "char_start", "char_end")).alias("x"))
    return each.select(*[F.col(f"x.{c}").alias(c) for c in chunks.columns if c != "text"], F.col("x.body").alias("text"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.round(F.avg("n_tokens"), 6).alias("avg_tokens"), F.round(F.count("*") / F.count_distinct("passage_id"), 6).alias("per_passage"))


def embed_chunks(texts: DataFrame, embed=None, prefix: Column | None = None) -> DataFrame:
    """Chunk texts with `embedding`, of `prefix`, a blank and the text where there is a prefix; one model for all rows, named
    by the caller's table. An embedder is a column function; one that runs in Python gets Arrow blocks."""
    embed = embed or vectors.hashing_embedder()
    text = F.col("text") if prefix is None else F.concat_ws(" ", prefix, F.col("text"))
    return texts.withColumn("embedding", embed(text))
