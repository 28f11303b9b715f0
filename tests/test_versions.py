"""Versioned tables: what a change commits, what it leaves alone, and who wins."""

import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from quillon.sources.segments import Conflict
from quillon.sources.versions import Versions

ROWS = "id long, name string, n int"


def table(spark, tmp_path, n=200, buckets=16):
    return Versions.create(spark.createDataFrame([(i, f"name {i}", i % 7) for i in range(n)], ROWS), str(tmp_path), "id", buckets)


def test_changes(spark, tmp_path):
    t = table(spark, tmp_path)
    want = {i: (f"name {i}", i % 7) for i in range(200)}

    def same(v):
        assert rows_of(v.read()) == sorted([(i, n, name) for i, (name, n) in want.items()], key=repr)

    same(t)
    t = t.upsert(spark.createDataFrame([(3, "new", 1), (500, None, None), (3, "newer", 1)], ROWS))
    want |= {3: ("newer", 1), 500: (None, None)}
    same(t)
    t = t.insert_ignore(spark.createDataFrame([(3, "no", 0), (501, "yes", 2)], ROWS))
    want[501] = ("yes", 2)
    same(t)
    t = t.delete(spark.createDataFrame([(7,), (7,), (999,), (None,)], "id long"))
    del want[7]
    same(t)
    t = t.update(spark.createDataFrame([(8, None), (999, "none")], "id long, name string"))
    want[8] = (None, 1)
    same(t)
    t = t.delete_where(F.col("n") == 6)
    want = {i: x for i, x in want.items() if x[1] != 6}
    same(t)
    assert rows_of(t.lookup([3, 6, 501])) == [(3, 1, "newer"), (501, 2, "yes")]
    first = Versions(spark, str(tmp_path), version=1)
    assert first.read().count() == 200 and first.read().where("id = 7").count() == 1
    empty = t.truncate()
    assert empty.read().collect() == [] and empty.read().schema == t.read().schema
    assert empty.upsert(spark.createDataFrame([(1, "a", 1)], ROWS)).read().count() == 1
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(None, "x", 1)], ROWS))


def test_only_touched_partitions_are_written(spark, tmp_path):
    t = table(spark, tmp_path)
    new = t.upsert(spark.createDataFrame([(11, "x", 1)], ROWS))
    assert sum(new.parts[b] != t.parts[b] for b in t.parts) == 1 and len(t.parts) == 16
    same = new.insert_ignore(spark.createDataFrame([(11, "y", 1)], ROWS))
    assert same.parts == new.parts and same.version == 3
    assert t.read().where("id = 11").first()["name"] == "name 11"  # a reader keeps its version
    files = new.lookup([11]).inputFiles()
    assert len(files) < len(new.read().inputFiles())
    gone = same.vacuum()
    assert any(g.startswith("versions/") for g in gone) and rows_of(Versions(spark, str(tmp_path)).read()) == rows_of(same.read())
    assert not os.path.exists(f"{tmp_path}/versions/00000001.json")


def test_of_two_writers_one_wins(spark, tmp_path):
    t = table(spark, tmp_path, 20)
    other = Versions(spark, str(tmp_path))
    t.upsert(spark.createDataFrame([(1, "first", 1)], ROWS))
    with pytest.raises(Conflict):
        other.delete(spark.createDataFrame([(1,)], "id long"))
    assert Versions(spark, str(tmp_path)).read().where("id = 1").first()["name"] == "first"
    with pytest.raises(Conflict):
        table(spark, tmp_path)
    with pytest.raises(FileNotFoundError):
        Versions(spark, f"{tmp_path}/none")
