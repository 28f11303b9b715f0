"""Conversation prefix trie: what conversations share from their first turn on.

A conversation is its sequence of (role, text) turns. `rebuilt` orders turns and gives each conversation the opening of
another one, as the contract of the query wants it; `prefix_trie` builds the trie of any sequences.

1. *Digests.* A turn is the MD5 of its role's length, role and text, and its number of words. Only these go on.
2. *Ends.* Conversations that are equal are one sequence with a count, the smallest id and the SHA-256 of its ids. The
   ids stream through the hash in order, within a sorted partition, and none is held.
3. *Tries.* Sequences are dealt to buckets by the digest of their first turn. A bucket builds a trie of dictionaries
   (turn to child, nodes in arrays) and goes through it from the last node to the first: a child comes after its parent, so this
   is a postorder without recursion.
4. *Oversized subtrees.* Where the sequences under one first turn have more than `most` turns, that turn becomes a node of
   the spine, and its sequences are dealt again by the next turn; so on until every part fits. The nodes of the spine are
   sums over their children, taken level by level from the deepest.

Null role or text is empty. Turns come in order, null first; ties are taken by role, then by text. Rows without conv_id
belong to no conversation and are left out. Rows repeated with one conv_id and turn are turns of their own. Very long texts
count as whole turns; of a long conversation the digests are held, 28 bytes a turn. An empty table has no node, not even the
root. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, parallelism, stored

NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "prefix binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): the turns of each conversation, from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), digest.alias("digest"), F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("words"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<part, pos, digest, words>>) for each conversation c: the first h turns of conversation
    c - c % 20, if there is one, then its own turns after its first h; h = crc32(c as decimal) % 4."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    own = stored(turns(conversations), "turns")
    opening = own.where("pos < 3").withColumnRenamed("conv_id", "base")
    heads = own.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).withColumn("h", h)
    first = heads.join(opening, "base").where("pos < h").select("conv_id", F.struct(F.lit(0).alias("part"), "pos", "digest", "words").alias("turn"))
    rest = own.where(F.col("pos") >= h).select("conv_id", F.struct(F.lit(1).alias("part"), "pos", "digest", "words").alias("turn"))
    none = own.select("conv_id").distinct().select("conv_id", F.lit(None).cast(first.schema["turn"].dataType).alias("turn"))
    rows = first.unionByName(rest).unionByName(none)
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))  # collect_list leaves nulls out


def end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, n, ends_sha256) of each run of rows with one `whole`; rows come sorted by it and by conv_id."""
    at, least, n, ids = None, 0, 0, hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for whole, conv in zip(batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if whole != at:
                if at is not None:
                    out.append((least, n, ids.hexdigest()))
                at, least, n, ids = whole, conv, 0, hashlib.sha256()
            ids.update((b"," if n else b"") + b"%d" % conv)
            n += 1
        yield from made(out)
    if at is not None:
        yield from made([(least, n, ids.hexdigest())])


def made(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["conv_id", "n", "ends_sha256"])


def trie(bucket: pd.DataFrame, depth: int) -> pd.DataFrame:
    """The nodes below `depth` of the sequences of a bucket, whose columns are those of `sequences`. Nodes of `depth` + 1 keep
    their prefix and have no parent yet."""
    bucket = bucket.sort_values("conv_id", kind="stable")
    tops: dict[tuple[bytes, bytes], int] = {}
    children: list[dict[bytes, int]] = []
    prefix, conv, parent, level, words, n, ends = [], [], [], [], [], [], []
    for above, c, k, sha, digests, sizes in zip(bucket["prefix"], bucket["conv_id"], bucket["n"], bucket["ends_sha256"], bucket["digests"], bucket["words"], strict=True):
        node = -1
        for d in range(depth, len(digests)):
            known, key = (tops, (above, digests[d])) if node < 0 else (children[node], digests[d])
            child = known.get(key)
            if child is None:  # ids ascend, so the first to come is the smallest member
                child = known[key] = len(conv)
                children.append({})
                prefix.append(above if node < 0 else None)
                conv.append(c)
                parent.append(node)
                level.append(d + 1)
                words.append(int(sizes[d]))
                n.append(0)
                ends.append(NO_ENDS)
            node = child
            n[node] += k
        ends[node] = sha
    leaves = [0 if c else 1 for c in children]
    saved = [(k - 1) * w for k, w in zip(n, words, strict=True)]
    for i in range(len(conv) - 1, -1, -1):
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    of = pd.array([conv[p] if p >= 0 else None for p in parent], dtype="Int64")
    return pd.DataFrame({"prefix": prefix, "conv_id": conv, "depth": level, "parent_conv_id": of, "n_convs": n, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})


def below(depth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda bucket: trie(bucket, depth)


def sequences(paths: DataFrame) -> DataFrame:
    """(conv_id, n, ends_sha256, digests, words): the distinct sequences of `paths` (conv_id, turns), each with its smallest id."""
    whole = F.unhex(F.md5(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")))
    rows = stored(paths.select("conv_id", whole.alias("whole"), F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words")), "paths")
    ids = rows.select("whole", "conv_id").repartition(parallelism(rows.sparkSession), "whole").sortWithinPartitions("whole", "conv_id")
    return rows.drop("whole").join(ids.mapInArrow(end_rows, "conv_id long, n long, ends_sha256 string"), "conv_id")


def child(depth: int) -> Column:
    return F.unhex(F.md5(F.concat("prefix", F.get("digests", F.lit(depth)))))


def prefix_trie(paths: DataFrame, most: int = 65_536) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie of
    `paths` (conv_id, turns array<struct<.., digest, words>>), the root included. `most`: turns that are built in one piece."""
    rows = stored(sequences(paths).select(F.lit(b"").alias("above"), F.lit(b"").alias("prefix"), "conv_id", "n", "ends_sha256", "digests", "words"), "sequences")
    spine, tries, depth = [], [], 0
    while True:
        here = F.size("digests") == depth
        last = F.max(F.get("words", F.lit(depth - 1))) if depth else F.max(F.lit(0).cast("long"))
        spine.append(rows.groupBy("above", "prefix").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(here, F.col("ends_sha256"))).alias("ends"), last.alias("words")))
        on = rows.where(F.size("digests") > depth).withColumn("next", child(depth))
        sizes = stored(on.groupBy("next").agg(F.sum(F.size("digests") - depth).alias("turns")), "subtrees")
        total, large = sizes.agg(F.sum("turns"), F.sum(F.when(F.col("turns") > most, 1))).first()
        if not total:
            break
        marked = on.join(sizes.where(F.col("turns") > most).select("next", F.lit(True).alias("large")), "next", "left") if large else on.withColumn("large", F.lit(None).cast("boolean"))
        buckets = -(-total // most) + parallelism(rows.sparkSession)
        dealt = marked.where("large is null").withColumn("bucket", F.pmod(F.xxhash64("next"), F.lit(buckets))).select("bucket", "prefix", "conv_id", "n", "ends_sha256", "digests", "words")
        tries.append(stored(dealt.groupBy("bucket").applyInPandas(below(depth), NODES), "tries"))
        if not large:
            break
        rows = stored(marked.where("large").select(F.col("prefix").alias("above"), F.col("next").alias("prefix"), "conv_id", "n", "ends_sha256", "digests", "words"), "sequences")
        depth += 1
    return climbed(spine, tries)


def climbed(spine: list[DataFrame], tries: list[DataFrame]) -> DataFrame:
    """All nodes: the spine's from the deepest level on, each from the sums of its children, and the tries' under them."""
    done: dict[int, DataFrame] = {}
    for depth in range(len(spine) - 1, -1, -1):
        below = [t.where("prefix is not null").select("prefix", "n_leaves", "saved_tokens") for t in tries[depth : depth + 1]]
        below += [done[depth + 1].select(F.col("above").alias("prefix"), "n_leaves", "saved_tokens")] if depth + 1 in done else []
        nodes = spine[depth].withColumns({"n_children": F.lit(0).cast("long"), "leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
        if below:
            rows = below[0] if len(below) == 1 else below[0].unionByName(below[1])
            sums = rows.groupBy("prefix").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            nodes = spine[depth].join(sums, "prefix", "left").na.fill(0, ["n_children", "leaves", "saved"])
        done[depth] = stored(
            nodes.select("above", "prefix", "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")),
            "spine",
        )
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = done[0].withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names)
    for depth, nodes in done.items():
        own = nodes.select("prefix", F.col("conv_id").alias("spine_id"))
        if depth:
            over = done[depth - 1].select(F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
            out = out.unionByName(nodes.join(over, "above").select(*names))
        if depth < len(tries):
            inner = tries[depth].where("prefix is null")
            tops = tries[depth].where("prefix is not null").drop("parent_conv_id").join(own.withColumnRenamed("spine_id", "parent_conv_id"), "prefix")
            out = out.unionByName(inner.select(*names)).unionByName(tops.select(*names))
    return out


#: crc32 is a fold over the bits of the id's digits, with the reflected polynomial 0xEDB88320.
SQL = r"""
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
  from conversations where conv_id is not null
), heads as (
  select conv_id, conv_id - conv_id % 20 as base,
         xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295) % 4 as h
  from (select distinct conv_id from own)
), rows as (
  select h.conv_id, 0 as part, o.pos, o.digest, o.words from heads h join own o on o.conv_id = h.base and o.pos < h.h
  union all
  select h.conv_id, 1, o.pos, o.digest, o.words from heads h join own o on o.conv_id = h.conv_id and o.pos >= h.h
), placed as (
  select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, digest, words from rows
), prefixes as (
  select conv_id, depth, words, string_agg(digest, '') over (partition by conv_id order by depth) as path from placed
  union all
  select conv_id, 0, 0, '' from heads
), lengths as (
  select conv_id, max(depth) as length from prefixes group by conv_id
), nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where length = depth), '')) as ends_sha256
  from prefixes join lengths using (conv_id) group by path, depth
), parents as (
  select n.path, a.conv_id as parent_conv_id, a.path as above from nodes n join prefixes p on p.conv_id = n.conv_id and p.depth = n.depth - 1 join nodes a on a.path = p.path and a.depth = p.depth
), children as (
  select above as path, count(*) as n_children from parents group by above
), sums as (
  select p.path, sum(case when coalesce(c.n_children, 0) = 0 then 1 else 0 end)::bigint as n_leaves, sum((n.n_convs - 1) * n.words)::bigint as saved_tokens
  from nodes n left join children c on c.path = n.path join prefixes p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.path
)
select n.conv_id, n.depth::bigint as depth, p.parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::bigint as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n join sums s using (path) left join parents p on p.path = n.path left join children c on c.path = n.path
"""
