"""Salted aggregation gives what plain aggregation gives, with nulls, ties and one key holding nearly all."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from revora.operators import salted as s


def _rows(spark):
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.8 else rng.choice([2, 3, 4, 5, None]), i, rng.choice([1.0, 2.0, None]), rng.choice("abcde")) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k long, id long, v double, who string")


def test_same_as_plain(spark):
    _, df = _rows(spark)
    got = s.salted_aggregate(df, "k", "id", {"n": F.count(F.lit(1)), "t": F.sum("v"), "m": F.max("v")}, {"n": F.sum("n"), "t": F.sum("t"), "m": F.max("m")}, distinct={"d": "who"})
    plain = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("t"), F.max("v").alias("m"), F.countDistinct("who").alias("d"))
    assert sorted(map(tuple, got.select("k", "n", "t", "m", "d").collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_heavy_and_shares(spark, monkeypatch):
    _, df = _rows(spark)
    assert s.heavy_keys(df, "k", "id", 0.5) == ([1], 3000)
    assert [r["k"] for r in s.keys_above(df, "k", "id", 0.5).collect()] == [1]
    monkeypatch.setattr(s, "SAMPLE_ROWS", 500)
    assert s.heavy_keys(df, "k", "id", 0.5) == ([1], 3000)
    assert [tuple(r) for r in s.keys_above(df, "k", "id", 0.5).collect()] == [(1, df.filter("k = 1").count())]
    empty = df.limit(0)
    assert s.keys_above(empty, "k", "id", 0.03).count() == 0


def test_skew_join(spark):
    _, df = _rows(spark)
    right = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "k long, name string")
    for how in ("inner", "left"):
        a = sorted(map(tuple, s.skew_join(df, right, "k", "id", [1], how).select("id", "k", "name").collect()), key=str)
        assert a == sorted(map(tuple, df.join(right, "k", how).select("id", "k", "name").collect()), key=str)
