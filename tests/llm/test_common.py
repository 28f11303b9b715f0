"""Pieces that operators share."""

from types import SimpleNamespace

import pytest
from cases import no_docs

from quillon.llm import common


def test_hot_groups_meet_in_parts(spark):
    rows = spark.range(6000).selectExpr("if(id % 2 = 0, 0, id) as g", "id")
    groups = rows.groupBy("g").count().selectExpr("g", "count as n", "g * 10 as x")
    for total in (6000, 8 * 4 * 100):
        met = common.meet(rows, groups, ["g"], "n", "id", total).collect()
        assert sorted((r["id"], r["g"], r["x"]) for r in met) == sorted((i, i if i % 2 else 0, 10 * i if i % 2 else 0) for i in range(6000))
    left = common.meet(rows, groups.where("g <> 1"), ["g"], "n", "id", 6000, "left")
    assert left.count() == 6000 and left.where("x is null").count() == 1


def test_working_names_do_not_clash(spark):
    df = no_docs(spark).selectExpr("*", "1 as __key", "2 as __KEY1")
    assert common.fresh(df, "key", "id") == ["__key2", "__id"]


def test_shared_folder():
    unset = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(cluster)
