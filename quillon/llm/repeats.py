"""Suffix-array deduplication over run-length indexes: bytes of long strings that occur earlier go.

A window is a string of `length` bytes within one document. A window is later if the same string also starts earlier: in a
document of smaller doc_id, or earlier in its own. Every byte that a later window covers is removed.

1. *Contexts.* The key of a window is the least hash of its grams of k bytes (k = 32 for windows of 100), so equal windows
   have one key wherever they are. Neighbouring windows whose least gram is at one place are a context: at most
   ``length - k + 1`` of them, one for some 35 bytes of text. A task sends each context's key, a hash of its bytes and its
   place, never the text.
2. *Copies.* Keys that occur once hold no repeated window and go. Contexts of one key and one hash are copies: all but
   the first are later as a whole. Keys whose contexts are all copies are done. Both steps are sums, combined before the
   shuffle, and joins that deal large groups out.
3. *Index.* What is left are keys with contexts that differ: texts that begin or end to be alike. The first of the copies
   of each context is cut from its document, and the contexts of a key meet in a task, which builds an index of some
   megabytes of them: the Burrows-Wheeler transform in runs, with the place of each run's ends (`RunIndex`). Every
   context is streamed through it from its end, one step of the transform for each byte; the matching statistic, capped
   at `length`, is read off the rows' thresholds, so that windows of one string meet in one interval, and all but the first
   are later. Each marked run of windows is located by the sampled run ends and compared byte by byte.
4. *Large keys.* A key with more than `most` contexts that differ (a line that a third of all documents have, each with another
   neighbour) is not held by one task: its windows are grouped one by one, by a hash of the whole window.

Hashes have 64 bits under a seed drawn for each run, so no text can be made to collide; results do not depend on it.
Where texts are compared by hash, one key is shared besides: for a wrong mark two hashes must agree that have nothing in
common but the seed.

Null text counts as empty. Texts below `length` bytes keep all. Ties do not occur between places; rows repeated with one
doc_id are ordered by a hash of their text, as documents of their own, and rows repeated with text and doc_id are one document,
whose result each has. Rows without doc_id come before all others. Very long texts are read in blocks, none is cut. An empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import secrets as random_bits
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import textvec
from .common import discard, meet, parallelism, stored, text_or_empty

U = np.uint64
BLOCK = 1 << 18  # windows that are hashed at once
PLACES = U((1 << 19) - 1)
UNIT = 1 << 21  # bytes that are indexed at once
MOST = 8192  # contexts of a key that one task holds
PLACE = ["doc_id", "row", "start"]


def grams(length: int) -> int:
    """Bytes of a gram: a third of the window at most."""
    if length < 24:
        raise ValueError("windows have 24 bytes at least")
    return 8 << min(2, (length // 24).bit_length() - 1)


def gram_hashes(b: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of the k bytes from each place (k is 8, 16 or 32): eight bytes are mixed with the seed, halves are joined."""
    eight = np.ndarray((len(b) - 7,), "<u8", b.tobytes(), strides=(1,))
    with np.errstate(over="ignore"):
        h = textvec.mix(eight + U(seed))
        size = 8
        while size < k:
            h = textvec.mix((h[:-size] ^ U(seed >> 7)) * U(0x9E3779B97F4A7C15) + h[size:])
            size *= 2
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - width + size], h[width - size :]) if size < width else h


def span_hashes(h: np.ndarray, start: np.ndarray, size: np.ndarray, k: int, longest: int) -> np.ndarray:
    """A hash of `size` bytes from each start (k at least): of all its grams in steps of k, the last ends with it."""
    with np.errstate(over="ignore"):
        out = textvec.mix(size.astype(U))
        for step in range(0, longest, k):
            out = textvec.mix(out * U(0xD1342543DE82EF95) + h[start + np.minimum(step, size - k)])
    return out


def contexts(b: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, windows, key, hash) of the contexts of texts that begin at `offsets` in `b` (one offset more than texts)."""
    k = grams(length)
    width = length - k + 1
    for lo in range(0, len(b) - length + 1, BLOCK):
        n = min(BLOCK, len(b) - length + 1 - lo)
        h = gram_hashes(b[lo : lo + n + length - 1], k, seed)
        # The place is in the low bits, so the first of equal grams is the least: two windows of one string never share their gram.
        least = window_minima(h & ~PLACES | np.arange(len(h), dtype=U), length - k + 1) & PLACES
        at = np.arange(lo, lo + n)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + length <= offsets[text + 1]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        if len(begin):
            windows = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1 - begin
            content = span_hashes(h, begin, windows + length - 1, k, 2 * length - k)
            yield text[begin], begin + lo - offsets[text[begin]], windows, h[least[begin].astype(np.int64)], content


def context_rows(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, texts in textvec.slices(batch.column("text"), 1 << 22):
            b, offsets = textvec.raw(texts, lower=False)
            ids, rows = batch.column("doc_id").slice(row, len(texts)), batch.column("row").slice(row, len(texts))
            for text, start, windows, key, content in contexts(b, offsets, length, seed):
                of = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), ids.take(of), rows.take(of), pa.array(start), pa.array(windows.astype(np.int32))], names=["key", "content", *PLACE, "windows"])


CONTEXT = "key long, content long, doc_id long, row int, start long, windows int"


def cut_rows(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The contexts that each document is asked for, with their bytes; of large keys, each window by its hash."""
    k = grams(length)
    for batch in batches:
        out: list[tuple] = []
        for doc_id, row, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("asked").to_pylist(), strict=True):
            for x in asked:
                start, n = x["start"], x["windows"]
                piece = text[start : start + n + length - 1]
                if x["large"]:
                    h = gram_hashes(np.frombuffer(piece, np.uint8), k, seed)
                    own = span_hashes(h, np.arange(n), np.full(n, length), k, length).view(np.int64).tolist()
                    out += [(x["key"], w, doc_id, row, start + i, 1, None) for i, w in enumerate(own)]
                else:
                    out.append((x["key"], 0, doc_id, row, start, n, piece))
            if len(out) > 10_000:
                yield cut_batch(out)
                out = []
        if out:
            yield cut_batch(out)


def cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "content", *PLACE, "windows", "bytes"])


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of some texts, each closed by an end of its own that sorts first.

    Kept are, for each run of equal symbols, its first row, where the step back from that row leads and the text places of its two end
    rows; the rows at which a text begins; and the thresholds: rows that share fewer than `length` bytes with the one before.
    """

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.length = length
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        ends = self.starts + self.sizes
        symbols[ends] = 0
        self.symbols = symbols
        order, shares = suffix_order(symbols, ends, length)
        bwt = symbols[order - 1]  # before the first text lies the last one's end
        self.run = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        head, size = bwt[self.run], np.diff(np.append(self.run, len(bwt)))
        by_symbol = np.argsort(head, kind="stable")
        self.back = np.empty(len(head), np.int64)  # rows of smaller symbols, and of this one in runs before
        self.back[by_symbol] = np.cumsum(size[by_symbol]) - size[by_symbol]
        self.first, self.last = order[self.run], order[self.run + size - 1]
        self.run_size = size
        self.begins = np.flatnonzero(bwt == 0)
        self.begins_at = order[self.begins]
        self.interval = np.flatnonzero(~shares)

    def runs_of(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.run, rows, "right") - 1

    def step(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that are one byte longer."""
        j = self.runs_of(rows)
        return self.back[j] + rows - self.run[j]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places: steps back to the end of a run or the beginning of a text, whose places are known."""
        at, todo, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            j = self.runs_of(rows)
            b = np.minimum(np.searchsorted(self.begins, rows), len(self.begins) - 1)
            begins, first, last = self.begins[b] == rows, rows == self.run[j], rows == self.run[j] + self.run_size[j] - 1
            known = begins | first | last
            at[todo[known]] = np.where(begins, self.begins_at[b], np.where(first, self.first[j], self.last[j]))[known] + steps
            todo, j = todo[~known], j[~known]
            rows = self.back[j] + rows[~known] - self.run[j]
            steps += 1
        return at

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, interval) of each window, in text order: all texts are streamed from their ends together."""
        rows, active = np.arange(len(self.sizes)), np.argsort(-self.sizes, kind="stable")
        rows = rows[active]  # ends come first, in the order of texts
        sizes = self.sizes[active]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for matched in range(1, int(sizes[0]) + 1 if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -matched, "right"))
            rows = self.step(rows[:n])
            if matched >= self.length:
                found.append((active[:n], sizes[:n] - matched, np.searchsorted(self.interval, rows, "right") - 1))
        text, start, interval = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((start, text))
        return text[order], start[order], interval[order]

    def later(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, windows) of the runs of windows that also start earlier, in the order of texts."""
        text, start, interval = self.windows()
        first = np.full(len(self.interval), len(text), np.int64)
        np.minimum.at(first, interval, np.arange(len(text)))
        again = first[interval] < np.arange(len(text))
        new = again.copy()
        new[1:] &= ~again[:-1] | (text[1:] != text[:-1])
        begin = np.flatnonzero(new)
        stop = np.flatnonzero(again & np.concatenate([new[1:] | ~again[1:], [True]])) + 1 if len(again) else begin
        here = self.starts[text[begin]] + start[begin]
        there = self.locate(self.interval[interval[begin]])
        for i in range(self.length):
            if not np.array_equal(self.symbols[here + i], self.symbols[there + i]):
                raise AssertionError("windows of one interval differ")
        return text[begin], start[begin], stop - begin


def suffix_order(symbols: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, whether each shares `length` bytes with the one before) by prefix doubling from seven symbols of
    nine bits. Nothing is read beyond a text's end; equal suffixes are in the order of their texts."""
    n = len(symbols)
    place = np.arange(n)
    left = ends[np.searchsorted(ends, place)] - place  # symbols up to the end
    key, h = np.zeros(n, np.int64), 7
    padded = np.concatenate([symbols, np.zeros(h, np.int64)])
    for i in range(h):
        key = (key << 9) | np.where(i < left, padded[i : i + n], 0)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    deep = None
    while True:
        if h <= length < 2 * h:
            deep = (h, rank.copy())
        tied = ~new | np.concatenate([~new[1:], [False]])
        where = np.flatnonzero(tied)
        if not len(where) or h > left.max():
            break
        of = order[where]
        second = np.where(left[of] > h, rank[np.minimum(of + h, n - 1)] + 1, 0)
        both = rank[of] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        order[where] = of[by]
        differs = np.concatenate([[True], both[by][1:] != both[by][:-1]])
        new[where] = differs
        rank[order[where]] = np.maximum.accumulate(np.where(differs, where, 0))
        h *= 2
    if deep is None:  # all differ within fewer bytes than a window has
        return order, np.zeros(n, bool)
    h, rank = deep
    window = left[order] >= length
    far = rank[np.minimum(order + length - h, n - 1)]
    near = rank[order]
    shares = np.zeros(n, bool)
    shares[1:] = window[1:] & window[:-1] & (near[1:] == near[:-1]) & (far[1:] == far[:-1])
    return order, shares


MARK = "doc_id long, row int, start long, windows int"


def index_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Later windows among contexts sorted by key and place: units of whole keys are indexed one after the other."""

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        text, start, windows = RunIndex([r[4] for r in rows], length).later()
        of = text.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in of], pa.int64()), pa.array([rows[i][2] for i in of], pa.int32()), pa.array([rows[i][3] + s for i, s in zip(of, start.tolist(), strict=True)], pa.int64()), pa.array(windows, pa.int32())],
            names=[*PLACE, "windows"],
        )

    unit: list[tuple] = []
    size, key = 0, None
    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("key", *PLACE, "bytes")), strict=True):
            if x[0] != key and size >= UNIT:
                yield marks(unit)
                unit, size = [], 0
            key = x[0]
            unit.append(x)
            size += len(x[4])
    if unit:
        yield marks(unit)


def rest_rows(batches: Iterator[pa.RecordBatch], length: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """What is left of each document without the bytes of its marks (start * 2**16 + windows)."""
    for batch in batches:
        out: list[tuple] = []
        for text, marks in zip(batch.column("text").cast(pa.large_binary()), batch.column("marks"), strict=True):
            kept, gone, spans = text.as_py(), 0, []
            if marks.is_valid:
                at = np.sort(np.asarray(marks.values))
                start, end = at >> 16, (at >> 16) + (at & 0xFFFF) + length - 1
                end = np.maximum.accumulate(end)
                new = np.concatenate([[True], start[1:] > end[:-1]])
                start, end = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                spans = list(zip(start.tolist(), end.tolist(), strict=True))
                gone = int((end - start).sum())
                edges = [0, *(x for span in spans for x in span), len(kept)]
                kept = b"".join(kept[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(kept) + gone, gone, len(spans), hashlib.sha256(kept).hexdigest(), *([[{"start": a, "end": b} for a, b in spans], kept] if whole else [])))
        arrays = [pa.array(c) for c in zip(*out, strict=True)] if out else []
        if whole and arrays:
            arrays[4] = pa.array([x[4] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        if arrays:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if whole else [])])


def same_place(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])


def copies(rows: DataFrame, total: int) -> DataFrame:
    """`rows` with `copy`: whether rows of the same key and content have an earlier place."""
    first = rows.groupBy("key", "content").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n"))
    met = meet(rows, first, ["key", "content"], "n", PLACE, total, steady=True)
    return met.withColumn("copy", F.struct(*PLACE) != F.col("first")).drop("first")


def freed(df: DataFrame) -> DataFrame:
    """Lets the driver drop the shuffle files of jobs that are over."""
    df.sparkSession._jvm.System.gc()
    return df


def later_windows(docs: DataFrame, length: int = 100, most: int = MOST) -> DataFrame:
    """(doc_id, row, start, windows): runs of windows of `docs` (doc_id, row, text) that also start earlier."""
    spark, seed = docs.sparkSession, random_bits.randbits(63)
    found = docs.mapInArrow(lambda it: context_rows(it, length, seed), CONTEXT)
    sums = found.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("least"), F.max("content").alias("most")).where("n > 1")
    keys = freed(stored(sums.select("key", "n", (F.col("least") != F.col("most")).alias("differ")), "repeat-keys"))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = freed(stored(found.join(keys.drop("n"), "key"), "repeat-contexts"))  # one row for each key; a large key's contexts may be split
    discard(keys)
    told = copies(again, total).where("copy or differ").select(F.when(~F.col("copy"), F.col("key")).alias("key"), *PLACE, "windows", "copy")
    told = freed(stored(told, "repeat-copies"))
    discard(again)
    marks = told.where("copy").select(*PLACE, "windows")

    left = told.where("not copy").select("key", *PLACE, "windows").dropDuplicates(["key", *PLACE])
    large = left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.lit(True).alias("large"))
    asked = left.join(large, "key", "left").groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "start", "windows", F.coalesce("large", F.lit(False)).alias("large"))).alias("asked"))
    one = asked.withColumnsRenamed({"doc_id": "asked_id", "row": "asked_row"}).hint("shuffle_hash")
    texts = docs.join(one, docs["doc_id"].eqNullSafe(one["asked_id"]) & (docs["row"] == one["asked_row"])).select("doc_id", "row", "text", "asked")
    cut = freed(stored(texts.mapInArrow(lambda it: cut_rows(it, length, seed), CONTEXT + ", bytes binary").dropDuplicates(["key", *PLACE]), "repeat-cuts"))
    dealt = cut.where("bytes is not null").drop("content").repartition(parallelism(spark), "key").sortWithinPartitions("key", *PLACE)
    borders = dealt.mapInArrow(lambda it: index_rows(it, length), MARK)
    single = cut.where("bytes is null").drop("bytes")
    n_single = single.count()
    if n_single:
        borders = borders.unionByName(copies(single, n_single).where("copy").select(*PLACE, "windows"))
    borders = freed(stored(borders, "repeat-borders"))
    discard(cut)
    return marks.unionByName(borders)


def repeats(docs: DataFrame, length: int = 100, most: int = MOST, whole: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs`; with `whole`, spans (start, end) of the removed
    bytes and the bytes that are kept, too. `most`: contexts of a key that one task indexes."""
    text = text_or_empty().cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("row"), text.alias("text"))
    at = F.col("start") * 65536 + F.col("windows")
    marks = later_windows(docs, length, most).groupBy("doc_id", "row").agg(F.collect_set(at).alias("marks")).withColumnsRenamed({"doc_id": "marked_id", "row": "marked_row"})
    met = docs.join(marks.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(marks["marked_id"]) & (docs["row"] == marks["marked_row"]), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start: long, end: long>>, kept binary" if whole else "")
    return met.select("doc_id", "text", "marks").mapInArrow(lambda it: rest_rows(it, length, whole), schema)
