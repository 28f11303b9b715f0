"""Document fingerprints by winnowing (native: DataFrame functions only).

Every k-gram of code points has a rolling hash; of each window of `window` successive k-grams the one with the least
hash is chosen, the rightmost of ties, and a fingerprint is the chosen hashes with their positions. Two texts that share
``window + k - 1`` code points share a fingerprint, and none is shared below k.

* *Hash.* A code point c has a 64-bit number s(c), its xxhash64. A k-gram's hash is the polynomial s(c1) x^(k-1) + ... +
  s(ck) over GF(2), cut at 64 bits: times x is a shift, plus is XOR. It rolls on to the next k-gram as
  ``h << 1 ^ s(first) << k ^ s(next)``. Its upper 43 bits are used; all k code points enter the highest.
* *Windows.* Hash and position are one number (43 bits of hash, then the position within a block, reversed), so that the
  least number is the least hash with the rightmost tie. The `window` windows that begin in one step of as many positions
  need 2 * window hashes; their minima come from the running minima from the right of the first half and from the left of
  the second.
* *Steps.* Texts are cut into blocks of `BLOCK` code points that look ahead by a window, blocks into steps of `window`
  positions, each a row; so hashes and minima of a step are columns, in generated code without a loop over an array. The
  JVM compiles no method above 8000 bytes, so `fence` cuts the generated code. The steps of a text come together again
  within the task that made them, as they are dealt by the same key.

Texts shorter than k code points are one k-gram (with zeros after it); texts with fewer than `window` k-grams are one
window; the empty text has an empty fingerprint. Null text counts as empty. An empty table gives an empty result. Rows
repeated with one doc_id are fingerprinted each for itself and follow each other in the order of their texts' hashes.
Very long texts go block by block; only what is chosen of them comes together. Likeness is Dice's coefficient of the sets
of hashes, and 1 for two empty ones. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import parallelism, text_or_empty

BLOCK = 16384
_PLACES = 20
_LAST = (1 << _PLACES) - 1
_FREE = (1 << 63) - 1
KEY = ["__part", "__row"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fence(df: DataFrame) -> DataFrame:
    """`df` with the end of a stretch of generated code: `p` goes through an expression that is interpreted."""
    return df.select(*[c for c in df.columns if c != "p"], let(F.col("p"), lambda x: x).alias("p"))


def block_of(window: int) -> int:
    """Positions of a block: whole steps."""
    return max(window, BLOCK - BLOCK % window)


def steps(pieces: DataFrame, k: int, window: int) -> DataFrame:
    """Rows (KEY, meta, kind, body, whole) -> rows (KEY, meta, kind, blk, p, chosen): what the windows of a step choose, as
    numbers of hash and position in the block. `whole`: whether `body` is a whole text, so that one without a full window
    still has a fingerprint. `meta` stays on the first step of a body only. A choice that the next step repeats is left
    to it; every body has a step."""
    need, block = k + window - 1, block_of(window)  # `need`: code points of a window
    cut = F.when(F.col("body") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("body", F.lit(r"(?s)(?=(.{1,%d})).{1,%d}" % (block + need, block)), F.lit(1)))
    rows = pieces.select(*KEY, "meta", "kind", "whole", F.posexplode(cut).alias("blk", "body"))
    n = F.length("body")
    rows = rows.select(
        *KEY,
        "meta",
        "kind",
        "blk",
        F.concat(F.transform(F.split("body", ""), lambda c: F.xxhash64(c)), F.array_repeat(F.lit(0).cast("long"), k + 2 * window)).alias("s"),
        F.greatest(n - (k - 1), F.when(F.col("whole") & (F.col("blk") == 0), F.least(n, F.lit(1))).otherwise(0)).alias("grams"),
        F.greatest(n - (need - 1), F.when(F.col("whole") & (F.col("blk") == 0), F.least(n, F.lit(1))).otherwise(0)).alias("windows"),
    )
    own = F.least("windows", F.lit(block))  # windows that begin in this block; one more may only be looked at
    rows = rows.select(*KEY, "meta", "kind", "blk", "s", "grams", "windows", own.alias("own"), F.explode(F.sequence(F.lit(0), F.greatest(own, F.lit(1)) - 1, F.lit(window))).alias("p"))
    first = (F.col("blk") == 0) & (F.col("p") == 0)
    keep = ["kind", "blk", "grams", "windows", "own", "p"]
    rows = rows.select(*KEY, F.when(first, F.col("meta")).alias("meta"), *keep, *[F.col("s")[F.col("p") + j].alias(f"s{j}") for j in range(k + 2 * window - 1)])
    h = F.col("s0")
    for j in range(1, k):
        h = F.shiftleft(h, 1).bitwiseXOR(F.col(f"s{j}"))
    rows = fence(rows.withColumn("h0", h))
    for j in range(1, 2 * window):
        rows = rows.withColumn(f"h{j}", F.shiftleft(f"h{j - 1}", 1).bitwiseXOR(F.shiftleft(f"s{j - 1}", k)).bitwiseXOR(F.col(f"s{j + k - 1}")))
    rows = fence(rows.select(*KEY, "meta", *keep, *[f"h{j}" for j in range(2 * window)]))
    rows = rows.withColumns({"left": F.col("grams") - F.col("p"), "place": F.lit(_LAST) - F.col("p")})
    number = lambda j: F.when(F.col("left") > j, F.shiftleft(F.shiftrightunsigned(f"h{j}", _PLACES + 1), _PLACES) + (F.col("place") - j)).otherwise(F.lit(_FREE))
    rows = fence(rows.select(*KEY, "meta", *keep, *[number(j).alias(f"v{j}") for j in range(2 * window)]))
    for j in range(window - 2, -1, -1):
        rows = rows.withColumn(f"v{j}", F.least(f"v{j}", f"v{j + 1}"))
    for j in range(window + 1, 2 * window):
        rows = rows.withColumn(f"v{j}", F.least(f"v{j}", f"v{j - 1}"))
    rows = fence(rows)
    least = [F.col("v0")] + [F.when(F.col("p") + j < F.col("own"), F.least(f"v{j}", f"v{window + j - 1}")).otherwise(F.col("v0")) for j in range(1, window)]
    after = F.when(F.col("p") + window < F.col("windows"), F.col(f"v{2 * window - 1}")).otherwise(F.lit(_FREE))
    chosen = F.when(F.col("own") > 0, F.array_remove(F.array_distinct(F.array(*least)), after)).otherwise(F.array().cast("array<long>"))
    return rows.select(*KEY, "meta", "kind", "blk", "p", chosen.alias("chosen"))


def gathered(made: DataFrame, kinds: int, window: int) -> DataFrame:
    """Steps by text: (KEY, meta, p0, p1, ...), the prints (hash, position in the body) of each kind in order."""
    lists = made.groupBy(*KEY).agg(F.first("meta", ignorenulls=True).alias("meta"), F.array_sort(F.collect_list(F.struct("kind", "blk", "p", "chosen"))).alias("l"))

    def of(kind: int) -> Column:
        def each(x: Column) -> Column:
            end = x["blk"].cast("long") * block_of(window) + _LAST
            return F.transform(x["chosen"], lambda v: F.struct(F.shiftright(v, _PLACES).alias("hash"), (end - v.bitwiseAND(F.lit(_LAST))).alias("pos")))

        return F.flatten(F.transform(F.filter("l", lambda x: x["kind"] == kind), each))

    return lists.select(*KEY, "meta", *[of(i).alias(f"p{i}") for i in range(kinds)])


def joined(head: Column, tail: Column, own: Column) -> Column:
    """The prints of a text whose windows before `own` gave `head` and whose others gave `tail` (positions from `own`):
    (tail without what `head` ends with, from the text's beginning)."""
    moved = F.transform(tail, lambda x: F.struct(x["hash"].alias("hash"), (x["pos"] + own).alias("pos")))
    again = (F.size(head) > 0) & (F.size(tail) > 0) & F.coalesce(F.try_element_at(head, F.lit(-1))["pos"] == F.try_element_at(tail, F.lit(1))["pos"] + own, F.lit(False))
    return F.slice(moved, F.when(again, 2).otherwise(1), F.greatest(F.size(moved), F.lit(1)))


def fingerprint(docs: DataFrame, k: int = 12, window: int = 12) -> DataFrame:
    """(doc_id, prints) for each row of `docs`: array<struct<hash long, pos long>> in order of position."""
    # The row's number need not stay the same if a task is run again: a text's steps never leave the task.
    rows = docs.select(F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row"), F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("meta"), F.lit(0).alias("kind"), text_or_empty().cast("string").alias("body"), F.lit(True).alias("whole"))
    return gathered(steps(rows, k, window), 1, window).select("meta.doc_id", F.col("p0").alias("prints"))


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays of distinct hashes."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def shown(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.concat(F.hex(x["hash"]), F.lit(":"), x["pos"].cast("string"))), ",")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(__part, __kind, doc_id, text) to be read in windows of `in_part`, in which the next row is the next document.

    Rows are dealt to parts by ranges of doc_id, with quantiles as their bounds. A part also gets a copy of the first row
    of the next part (the last part that of the very first), of `__kind` 1, so that no task needs more than its part.
    Rows without doc_id have no place in the order: they have `__kind` 2 and are spread by their text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    parts = parts or 2 * parallelism(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts).alias("c")).first()["c"] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(cuts))]).cast("array<long>")  # as many as parts
    part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))))
    placed = rows.withColumn("__part", part)
    firsts = sorted((r["__part"], r["m"]) for r in placed.where("doc_id is not null").groupBy("__part").agg(F.min("doc_id").alias("m")).collect())
    home = F.struct(F.col("__part"), F.when(F.col("doc_id").isNull(), 2).otherwise(0).alias("__kind"))
    where = F.array(home)
    if firsts:
        before = F.create_map(*[F.lit(x) for i, (_, m) in enumerate(firsts) for x in (m, firsts[i - 1][0])])
        copy = F.struct(F.try_element_at(before, "doc_id").alias("__part"), F.lit(1).alias("__kind"))
        where = F.when(F.try_element_at(before, F.col("doc_id")).isNull(), where).otherwise(F.array(home, copy))
    return placed.select("doc_id", "text", F.explode(where).alias("w")).select("w.__part", "w.__kind", "doc_id", "text")


def in_part():
    return Window.partitionBy("__part").orderBy("__kind", "doc_id", "__order")


def fingerprints(docs: DataFrame, k: int = 12, window: int = 12) -> DataFrame:
    """For each row of `docs`, its fingerprint and that of its edited text, with likenesses.

    Columns: doc_id, n_chars, edited_sha256, prints_head, prints_tail, edited_tail, near_edited, near_next. A text's prints
    are those of `prints_head` and `prints_tail`, the edited text's those of `prints_head` and `edited_tail`; either is in
    order of position, as an array of (hash, pos). The edited text has its last quarter (rounded down) replaced by as many
    first code points of the next document, in order of doc_id (then of the text's hash, for rows repeated with one
    doc_id); after the last comes the first. Rows without doc_id have no next document, which counts as an empty one.
    """
    rows = with_next(docs).withColumn("__order", F.xxhash64("text"))
    after = F.when(F.col("__kind") == 2, F.lit("")).otherwise(F.coalesce(F.lead("text").over(in_part()), F.lit("")))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumns({"__row": F.row_number().over(in_part()), "n_chars": n, "kept": n - cut, "more": F.left(after, cut)})
    # Windows that start before `own` lie in the kept part; the others are computed for either text.
    own = F.greatest(F.lit(0), F.col("kept") - (k + window - 2))
    kept = F.left("text", F.col("kept"))
    edited = F.concat(kept, F.col("more"))
    rows = rows.withColumns({"own": own, "edited": edited}).withColumn("meta", F.struct("__kind", "doc_id", "n_chars", "own", F.sha2("edited", 256).alias("edited_sha256")))
    piece = lambda kind, body, whole: F.struct(F.lit(kind).alias("kind"), body.alias("body"), whole.alias("whole"))
    from_own = lambda c: F.substr(F.col(c), F.col("own") + 1, F.length(c))
    head = F.when(F.col("own") > 0, F.left("text", F.col("own") + (k + window - 2))).otherwise(F.lit(""))
    whole = F.col("own") == 0
    parts = F.array(piece(0, head, F.lit(False)), piece(1, from_own("text"), whole), piece(2, from_own("edited"), whole))
    pieces = rows.select(*KEY, "meta", F.explode(parts).alias("x")).select(*KEY, F.when(F.col("x.kind") == 0, F.col("meta")).alias("meta"), "x.kind", "x.body", "x.whole")
    made = gathered(steps(pieces, k, window), 3, window).select(*KEY, "meta.*", "p0", "p1", "p2")
    made = made.select(*KEY, "__kind", "doc_id", "n_chars", "edited_sha256", F.col("p0").alias("prints_head"), joined(F.col("p0"), F.col("p1"), F.col("own")).alias("prints_tail"), joined(F.col("p0"), F.col("p2"), F.col("own")).alias("edited_tail"))
    made = made.withColumn("own", hashes(F.concat("prints_head", "prints_tail")))
    none = F.array().cast("array<long>")
    following = F.when(F.col("__kind") == 2, none).otherwise(F.coalesce(F.lead("own").over(Window.partitionBy("__part").orderBy("__row")), none))
    near = made.withColumn("following", following).where("__kind <> 1")
    theirs = hashes(F.concat("prints_head", "edited_tail"))
    return near.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "prints_head", "prints_tail", "edited_tail", likeness(F.col("own"), theirs).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))


def fingerprint_texts(docs: DataFrame, **options) -> DataFrame:
    """`fingerprints` with the prints as text, ``hash:position`` joined by commas: fingerprint, edited_fingerprint."""
    made = fingerprints(docs, **options)
    texts = made.withColumns({c: shown(F.col(c)) for c in ("prints_head", "prints_tail", "edited_tail")})
    both = lambda tail: F.concat_ws(",", *[F.when(F.col(c) != "", F.col(c)) for c in ("prints_head", tail)])
    return texts.select("doc_id", "n_chars", "edited_sha256", both("prints_tail").alias("fingerprint"), both("edited_tail").alias("edited_fingerprint"), "near_edited", "near_next")
