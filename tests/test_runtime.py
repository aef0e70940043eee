"""Shared helpers: joins that bear hot keys, counted writes, the scratch folder."""

import random

import pytest
from pyspark.sql import functions as F

from arbograph import runtime


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_split_join_equals_join(spark, how, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_KEYS", 3)
    r = random.Random(how)
    big = spark.createDataFrame([("hot" if r.random() < 0.4 else r.choice(["a", "b", "c", "d", None, "missing"]), i) for i in range(200)], "k string, n int")
    small = spark.createDataFrame([(k, k * 2) for k in ("hot", "a", "b", "c", "z")], "k string, v string")
    expected = sorted(map(str, big.join(small, "k", how).collect()))
    for limit in (None, 0):
        got = runtime.split_join(big, small, "k", how, limit)
        assert got.columns == big.join(small, "k", how).columns and sorted(map(str, got.collect())) == expected
    assert runtime.split_join(big.limit(0), small, "k", how, 0).count() == 0 and runtime.split_join(big, small.limit(0), "k", how, 0).count() == (200 if how == "left" else 0)


def test_stored_with(spark):
    df, n = runtime.stored_with(spark.range(100).repartition(3), "x", F.col("id") % 3 == 0)
    assert n == 34 and df.count() == 100
    assert runtime.stored_with(spark.range(5).filter("id > 9"), "x", F.lit(True))[1] == 0
    assert runtime.stored_with(spark.createDataFrame([], "a int").join(spark.range(3).selectExpr("int(id) AS a"), "a"), "x", F.lit(True))[1] == 0


def test_scratch_of_a_cluster_is_not_local(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        runtime.scratch_root(Session())


def test_release(spark):
    df = runtime.stored(spark.range(3), "x")
    assert df.count() == 3 and runtime.release(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
    assert runtime.release(spark) == 0 and runtime.stored(spark.range(2), "x").count() == 2
