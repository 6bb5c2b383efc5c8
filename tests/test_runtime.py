import random

import pytest

from waymark import runtime


def test_join_counted_is_a_left_join(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HEAVY", 5)
    r = random.Random(1)
    rows = [(i, None if i % 11 == 0 else "hot" if r.random() < 0.5 else f"k{r.randrange(40)}", i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string, x int").repartition(4)
    side = df.where("k is not null and k <> 'k3'").groupBy("k", "x").count().withColumnRenamed("count", "n").selectExpr("k", "x", "concat(k, x) as found", "n")
    got = sorted(map(tuple, runtime.join_counted(df, side, ["k", "x"]).select("i", "k", "x", "found").collect()))
    assert got == sorted((i, k, x, None if k in (None, "k3") else f"{k}{x}") for i, k, x in rows)
    assert runtime.join_counted(df.limit(0), side, ["k", "x"]).count() == 0 and runtime.join_counted(df, side.limit(0), ["k", "x"]).count() == 600


def test_bounds_are_errors(spark):
    with pytest.raises(ValueError):
        runtime.bounded_rows(spark.range(5), 4, "a list")
    assert runtime.bounded_table(spark.range(5), 5, "a list").count() == 5


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        class sparkContext:  # noqa: N801
            getConf, master = staticmethod(Conf), "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(Session)
    monkeypatch.setattr(Session.sparkContext, "master", "local[4]")
    assert runtime.shared_folder(Session)
