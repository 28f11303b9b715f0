"""Exact deduplication over an extendible-hash index (native: DataFrame functions only).

Two texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``.

1. *Directory.* The 64-bit hash of each normalised text is a key. Rows are counted by the key's leading `max_depth`
   bits (at most ``2**max_depth`` numbers, whatever the corpus holds); from a single bucket the directory doubles,
   and a bucket above `capacity` is split by one more bit, until every bucket fits or is `max_depth` deep.
   A bucket that no bit can split any further (a group of copies may hold a third of all rows) gets overflow pages.
2. *Index.* Rows are dealt to the owner of their (bucket, page), which reduces them to one entry for each distinct
   text: its bytes, number of copies and best row. The entries are written to the shared folder.
3. *Chains.* The entries are read again and the pages of a bucket merged, by the bytes of the texts as in step 2; the
   distinct texts under one key form its chain, in which `exact_groups` gives each its place (`slot`) in the order of
   SHA-256. `exact_dedup` and `exact_dedup_keep` do not need the places and do not compute them.
4. *Lookup.* Each row finds its bucket and page through the directory and meets its entry there by key and SHA-256, so two
   texts of one key and one SHA-256 would not be told apart here; no text moves. The entries of a bucket with overflow
   pages are copied to each of them, so the rows of a large group stay dealt to as many owners.

Null text counts as empty. Rows without doc_id come last among equals. Rows repeated with one doc_id count as
separate copies, of which one stays. Very long texts move whole, once. An empty table gives an empty result. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE, fresh, parallelism, stored, text_or_empty

WIDE = "decimal(38,0)"
IDS = 2**65  # more than there are ids, and none


def directory(counts: dict[int, int], max_depth: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """Grow an extendible-hash directory over `counts` (rows by leading `max_depth` bits of the key).

    Returns (first prefix, prefixes, local depth, pages) for each bucket, in key order. Starts with one bucket of
    depth 0 and splits the overfull ones; the global depth is the largest local depth. Buckets that are overfull at
    `max_depth` get ``ceil(rows / capacity)`` overflow pages.
    """
    sums = [0]
    for p in range(1 << max_depth):
        sums.append(sums[-1] + counts.get(p, 0))
    done, todo = [], [(0, 0)]
    while todo:
        first, depth = todo.pop()
        width = 1 << (max_depth - depth)
        rows = sums[first + width] - sums[first]
        if rows > capacity and depth < max_depth:
            todo += [(first + width // 2, depth + 1), (first, depth + 1)]
        else:
            done.append((first, width, depth, max(1, -(-rows // capacity))))
    return done


def keyed(docs: DataFrame) -> DataFrame:
    norm = F.regexp_replace(text_or_empty(), SPACE, "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_or_empty()).cast("long").alias("n_points"), norm.alias("norm")).withColumn("key", F.xxhash64("norm"))


def wide(number: int) -> Column:
    return F.lit(str(number)).cast(WIDE)


def best(n: str, doc_id: str) -> Column:
    """Most code points first, then the smallest doc_id, none last, as one number, so that partial aggregation stays in place."""
    place = F.when(F.col(doc_id).isNull(), wide(0)).otherwise(wide(2**63) - F.col(doc_id).cast(WIDE))
    return F.max(F.col(n).cast(WIDE) * wide(IDS) + place).alias("best")


def exact_groups(docs: DataFrame, max_depth: int = 14, capacity: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index's entries (bucket, pages, key, slot, text_sha256, n_rows, keep_id, keep_points), the rows as they look up
    (bucket, page, key, text_sha256, doc_id, n_points) and the files of the index. `capacity`: rows of a bucket; by default
    an eighth of a task's share."""
    spark = docs.sparkSession
    prefix = F.shiftrightunsigned("key", 64 - max_depth).cast("int")
    rows = keyed(docs)
    counts = {r["p"]: r["n"] for r in rows.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}
    tasks = parallelism(spark)
    buckets = directory(counts, max_depth, capacity or max(32, sum(counts.values()) // (8 * tasks)))
    # At most 2**max_depth rows, so it may be broadcast.
    places = spark.createDataFrame([(p, i, pages) for i, (first, width, _, pages) in enumerate(buckets) for p in range(first, first + width) if p in counts], "p int, bucket int, pages int")
    placed = rows.join(F.broadcast(places), prefix == F.col("p")).withColumn("page", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("pages")).cast("int"))
    owned = placed.select("bucket", "page", "pages", "key", "norm", "n_points", "doc_id").repartition(tasks, "bucket", "page")
    index = stored(owned.groupBy("bucket", "page", "pages", "key", "norm").agg(F.count("*").alias("n_rows"), best("n_points", "doc_id")), "exact-index")
    again = index.where("pages > 1").groupBy("bucket", "pages", "key", "norm").agg(F.sum("n_rows").alias("n_rows"), F.max("best").alias("best"))
    texts = index.where("pages = 1").select("bucket", "pages", "key", "norm", "n_rows", "best").unionByName(again)
    place = (F.col("best") % wide(IDS)).cast(WIDE)
    chains = texts.select(
        "bucket",
        "pages",
        "key",
        F.sha2("norm", 256).alias("text_sha256"),
        "n_rows",
        ((F.col("best") - place) / wide(IDS)).cast("long").alias("keep_points"),
        F.when(place > 0, (wide(2**63) - place).cast("long")).alias("keep_id"),
    ).withColumn("slot", F.row_number().over(Window.partitionBy("key").orderBy("text_sha256")))
    return chains, placed.select("bucket", "page", "key", F.sha2("norm", 256).alias("text_sha256"), "doc_id", "n_points"), index


def on_pages(chains: DataFrame) -> DataFrame:
    """Entries on every page of their bucket."""
    return chains.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).drop("pages", "slot")


LOOKUP = ["bucket", "page", "key", "text_sha256"]


def exact_dedup(docs: DataFrame, max_depth: int = 14, capacity: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row, dropped ones too.

    Of equal texts the row with the most code points in the original text, then the smallest doc_id (null last) stays.
    """
    chains, rows, _ = exact_groups(docs, max_depth, capacity)
    same = rows.groupBy(*LOOKUP, "doc_id", "n_points").agg(F.count("*").alias("same"))
    met = same.join(on_pages(chains), LOOKUP)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    # Rows without doc_id lie on one page, and so do those repeated with one, so `same` has them all.
    return met.select("doc_id", "keep_id", F.col("n_rows").alias("group_size"), stays.alias("stays"), "text_sha256", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))).alias("copy")).select(
        "doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256"
    )


def exact_dedup_keep(docs: DataFrame, max_depth: int = 14, capacity: int | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows repeated with one doc_id and text, any one stays."""
    chains, _, _ = exact_groups(docs, max_depth, capacity)
    key, sha, ident, points, none = on = fresh(docs, "key", "sha", "id", "points", "none")
    norm = F.regexp_replace(text_or_empty(), SPACE, "")
    kept = chains.select(F.col("key").alias(key), F.col("text_sha256").alias(sha), F.coalesce("keep_id", F.lit(0)).alias(ident), F.col("keep_points").alias(points), F.col("keep_id").isNull().alias(none))
    given = F.col("doc_id").cast("long")
    rows = docs.withColumns({key: F.xxhash64(norm), sha: F.sha2(norm, 256), ident: F.coalesce(given, F.lit(0)), points: F.length(text_or_empty()).cast("long"), none: given.isNull()})
    return rows.join(kept, on, "left_semi").dropDuplicates(on).drop(*on)


SQL = r"""
with rows as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents
), ranked as (
  select doc_id, norm, row_number() over (partition by norm order by n desc, doc_id nulls last) as nth,
         first_value(doc_id) over (partition by norm order by n desc, doc_id nulls last) as keep_id, count(*) over (partition by norm) as group_size
  from rows
)
select doc_id, keep_id, group_size, nth = 1 as kept, sha256(norm) as text_sha256 from ranked
"""
