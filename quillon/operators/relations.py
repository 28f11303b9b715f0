"""Table maintenance without a transactional store: upserts, cascades, repairs of id arrays, samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import ranked


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key is not in it."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key `old` does not have."""
    return new.join(old.select(*key), key, "left_anti")


def cascade_delete(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return child.join(gone.select(key).distinct(), key, "left_anti")


def update_from(target: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """`target` with `column` from `changes` where it has the key."""
    new = changes.select(key, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    return target.join(new, key, "left").withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__hit")


def repaired(rows: DataFrame, key: str, ids: str, known: DataFrame) -> DataFrame:
    """`rows` with only those `ids` that are in `known` (id), sorted; [] where none is left."""
    found = rows.select(key, F.explode(ids).alias("id")).join(known.select("id"), "id", "left_semi")
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("__ids"))
    return rows.join(lists, key, "left").withColumn(ids, F.coalesce("__ids", F.array().cast("array<long>"))).drop("__ids")


def drawn(key: Column, seed: str = "42") -> Column:
    """A number in hex that orders rows at random, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified(rows: DataFrame, key: str, stratum: str, size: int, seed: str = "42") -> DataFrame:
    """A sample of about `size` rows with each stratum's share, by half-even rounding; the rows drawn first."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n_stratum"))
    total = rows.agg(F.count("*").alias("n_all"))
    shares = counts.crossJoin(F.broadcast(total)).select(stratum, F.bround(size * F.col("n_stratum") / F.col("n_all")).cast("int").alias("quota"))  # total is one row
    drawn_rows = ranked(rows, [stratum], [drawn(F.col(key), seed), F.col(key)], None, "nth")
    return drawn_rows.join(shares, stratum).where("nth <= quota").drop("nth", "quota")


def smoke_set(sample: DataFrame, key: str, stratum: str, size: int = 5, seed: str = "42") -> DataFrame:
    """The first row of each stratum in drawing order, then others in that order up to `size`. `sample` is an evaluation set."""
    rows = ranked(sample, [stratum], [drawn(F.col(key), seed), F.col(key)], None, "nth").withColumn("draw", drawn(F.col(key), seed))
    return rows.orderBy(F.when(F.col("nth") == 1, 0).otherwise(1), "draw", key).limit(size).drop("nth", "draw")


def subsample(ids: DataFrame, protected: DataFrame, gold: DataFrame, target: int, seed: str = "42") -> DataFrame:
    """(id): `target` ids: all protected ones, other gold ones up to half of the rest, and drawn ones. All ids if there
    are no more than `target`."""
    n = ids.count()
    if n <= target:
        return ids.select("id")
    draw = drawn(F.col("id"), seed)
    safe = protected.select("id").distinct()
    n_safe = safe.count()
    others = gold.select("id").distinct().join(safe, "id", "left_anti")
    half = others.orderBy(draw, "id").limit(max(0, (target - n_safe) // 2))
    chosen = safe.unionByName(half)
    fill = ids.select("id").join(chosen, "id", "left_anti").orderBy(draw, "id").limit(max(0, target - chosen.count()))
    return chosen.unionByName(fill)
