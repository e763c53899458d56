"""Search, report numbers, scaling, components and mixtures against plain versions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from revora.operators import presentation as p
from revora.operators import search, vectors


def test_suggestions_against_brute_force(spark, folder):
    names = [(r["id"], r["name"]) for r in spark.read.parquet(f"{folder}/facility.parquet").collect()] + [(900, None), (901, " "), (902, "博物館"), (903, "Ｆｏｓｓｉｌ")]
    queries = [(1, "波江郷灯台"), (2, "fossil centre"), (3, ""), (4, None), (5, "zzzz")]
    q, n = spark.createDataFrame(queries, "query_id long, name string"), spark.createDataFrame(names, "id long, name string")
    got: dict = {}
    for r in search.suggest(q, n).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["ratio"], 6)))
    for qid, text in queries:
        key = search.key_of(text)
        plain = sorted(((i, round(search.ratio(key, search.key_of(x)), 6)) for i, x in names if key and search.key_of(x) and search.key_of(x) != key), key=lambda t: (-t[1], t[0]))
        assert got.get(qid, []) == [t for t in plain if t[1] >= search.LEAST][:5]


def test_report_numbers(spark):
    r = spark.range(1).select(
        p.mark_band(F.lit(4.2)).alias("a"), p.mark_band(F.lit(2.0)).alias("b"), p.mark_band(F.lit(None).cast("double")).alias("c"), p.feeling_band(F.lit(59.9)).alias("d"),
        p.headline(F.lit(" 良い。次も。")).alias("e"), p.quoted(F.lit("a b\nc"), F.lit("b c")).alias("f"), p.quoted(F.lit("abc"), F.lit(" ")).alias("g"), p.year(F.lit("昭和1958年築")).alias("h"),
        p.simple_name(F.lit("海の館（本館）・別館")).alias("i"), p.metres(F.lit(35.0), F.lit(139.0), F.lit(36.0), F.lit(139.0)).alias("j"), p.walk_minutes(F.lit(81.0)).alias("k"),
        p.axis_top(F.lit(37.0)).alias("l"), p.axis_top(F.lit(0.0)).alias("m"), p.model_calls(F.lit(41)).alias("n"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"], r["f"], r["g"], r["h"], r["i"], r["k"], r["l"], r["m"], r["n"]) == (0, 4, None, "even", "良い。", True, False, 1958, "海の館", 2, 40.0, 1.0, 3)
    assert r["j"] == pytest.approx(111_195, abs=5)


def test_group_scaling(spark):
    rows = [(i, float(i), None if i % 2 else 1.0, 7.0) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, a double, b double, c double")
    got = np.array([r["u"] for r in vectors.group_scaled(df, {"x": (["a", "b"], 3.0), "y": (["c"], 1.0)}, "vec_id").orderBy("vec_id").collect()])
    a = np.arange(10.0)
    assert got[:, 0] == pytest.approx((a - a.mean()) / a.std() * (0.75 * 0.75 / 2) ** 0.5)
    assert not got[:, 1].any() and not got[:, 2].any()


def test_components_against_numpy(spark):
    m = np.random.default_rng(3).normal(size=(40, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, u array<double>")
    got = np.array([r["u"] for r in vectors.principal(df, 6, most=3).orderBy("vec_id").collect()])
    x = m - m.mean(0)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    want = x @ vt[:3].T / (s[:3] / np.sqrt(39)) * (0.25 / 3) ** 0.5
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8


def test_mixture_and_matching():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 4, 8)])
    labels = np.repeat([2, 0, 1], 40)
    r = vectors.matched(vectors.mixture(points, 3), labels)
    assert r.sum(1) == pytest.approx(np.ones(120)) and (r.argmax(1) == labels).mean() > 0.98
    g = rng.random((30, 4))
    own = rng.integers(0, 4, 30)
    best = max(itertools.permutations(range(4)), key=lambda o: sum(g[own == a, c].sum() for a, c in enumerate(o)))
    assert (vectors.matched(g, own) == g[:, list(best)]).all()
