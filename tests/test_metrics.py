"""Known values and invariants of the review metrics."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revora.functions import text
from revora.operators import compare, experience, ingest, ratings, reliability, remarks, topic_model, vectors


def _reviews(spark, months):
    rows = [(1, float(r), f"{ym}-15") for ym, rs in months.items() for r in rs]
    return spark.createDataFrame(rows, "facility_id long, rating double, review_date string")


def test_monthly_series_and_change_point(spark):
    m = {f"2024-0{i}": [5, 5, 5] for i in range(1, 6)} | {"2024-06": [2, 2, 2], "2024-07": [1]}
    series = ratings.monthly_sentiment(_reviews(spark, m))
    first = series.filter("ym = '2024-01'").first()
    assert (first["pos"], first["neg"], first["diff"], first["avg_rating"]) == (1.0, 0.0, 1.0, 5.0)
    points = ratings.change_points(ratings.change_candidates(series)).collect()
    assert [(p["ym"], p["delta"], p["direction"]) for p in points] == [("2024-06", -3.0, "down")]


def test_dates(spark):
    from revora.functions.columns import month_of

    df = spark.createDataFrame([("2021-01-31T23:00:00-05:00",), ("2021-01-01T01:00:00+09:00",), ("2021-03-05",), ("2021/02/20 04:00",), ("2021-13-01",), ("",), (None,)], "d string")
    assert [r[0] for r in df.select(month_of(F.col("d"))).collect()] == ["2021-02", "2020-12", "2021-03", None, None, None, None]


def test_wilson_and_t(spark):
    lo, hi = reliability.wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi"), reliability.t_point(F.lit(29)).alias("t29"), reliability.t_point(F.lit(1)).alias("t1"), reliability.t_point(F.lit(11)).alias("t11")).first()
    assert (round(r["lo"], 4), round(r["hi"], 4)) == (0.2366, 0.7634)
    assert r["t29"] == pytest.approx(2.04523, abs=2e-5) and r["t1"] == pytest.approx(12.7062) and r["t11"] == pytest.approx(2.20099, abs=2e-4)


def _sentiment(s):
    from revora.functions import lexicons as L

    p, q = sum(s.count(w) for w in L.POSITIVE), sum(s.count(w) for w in L.NEGATIVE)
    raw = (p - q) / (p + q + 1)
    neu = max(0.1, 1 - abs(raw))
    c = np.array([(1 - neu) * (1 - raw) / 2, neu, (1 - neu) * (raw + 1) / 2])
    c = np.exp(np.log(np.clip(c / c.sum(), 1e-12, 1)) / 0.7)
    d = c[2] / c.sum() - c[0] / c.sum()
    return (np.sign(d) * abs(d) ** 0.7 + 1) / 2


def test_sentence_sentiment(spark):
    texts = ["とても良い、最高でした", "残念で最悪", "普通", "良いが高い", ""]
    got = topic_model.with_sentiment(spark.createDataFrame([(t,) for t in texts], "sentence string")).collect()
    for r in got:
        assert r["v"] == pytest.approx(_sentiment(r["sentence"]))


def test_topic_chances(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.random(22).tolist(),) for _ in range(5)] + [([0.0] * 22,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c array<double>").select(topic_model.chances(F.col("c"))).collect()]
    for (c,), p in zip(rows, got):
        assert sum(p) == pytest.approx(1)
        if c is None or not any(c):
            assert p == pytest.approx([1 / 22] * 22)
            continue
        a = np.array(c)
        sd = a.std()
        z = (a - a.mean()) / (sd + 1e-6) / np.clip(0.3 / (sd + 1e-6), 0.05, 0.7)
        e = np.exp(z - z.max())
        q = e / e.sum()
        q = q + np.maximum(q - 1 / 22, 0) * 0.5
        assert p == pytest.approx((q / q.sum()).tolist())


def test_topic_scores_sum_to_one(spark):
    texts = [(1, i, t) for i, t in enumerate(["料理が美味しい。スタッフが親切。", "駅から近い。駐車場が狭い！", "また来たい。", "", None])]
    df = spark.createDataFrame(texts, "facility_id long, id long, text string").filter("text <> ''")
    scores = topic_model.topic_scores(topic_model.scored_sentences(spark, df)).collect()
    assert len(scores) == 22 and sum(r["salience"] for r in scores) == pytest.approx(1, abs=1e-4)


def test_calibration_guard_and_clip(spark):
    def matrix(n):
        return spark.createDataFrame([(i, "m", 50 + 3.0 * i) for i in range(n)], "facility_id long, metric string, score double")

    assert compare.calibration(matrix(7)).count() == 0 and compare.calibration(matrix(8)).count() == 1
    assert not compare.calibrated(matrix(7)).filter("is_calibrated").count()
    got = compare.calibrated(spark.createDataFrame([(i, "m", 0.0 if i else 100.0) for i in range(40)], "facility_id long, metric string, score double"))
    assert got.agg(F.max("calibrated")).first()[0] == 100.0


def test_negation_and_exclusions(spark):
    import re

    from revora.functions import lexicons as L

    words = L.SEVERITY["混雑"][0]
    plain = lambda s: any(w in s and any(not any(n in s[m.end() : m.end() + 5] for n in L.NEGATORS) for m in re.finditer(re.escape(w), s)) for w in words)
    rng = random.Random(1)
    rows = ["".join(rng.choice(["混雑", "行列", "ない", "ず", "ません", "なかっ", "も", "し", "て", "た", "待ち時間"]) for _ in range(8)) for _ in range(400)]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select("s", F.col("s").rlike(remarks.live(words)).alias("l")).collect()
    assert all(r["l"] == plain(r["s"]) for r in got)


def test_rare_remarks(spark):
    texts = [(1, 1, "展示室のエアコンが故障していて蒸し暑かったので困りました。"), (1, 2, "受付の説明がとても丁寧で良かったです、満足しました。"), (1, 3, "受付の前は混雑もしないし快適に過ごせる場所でした。"), (1, 4, None), (1, 5, "")]
    got = remarks.rare(spark.createDataFrame(texts, "facility_id long, id long, text string").filter("text <> ''")).collect()
    assert [(r["id"], r["category"]) for r in got] == [(1, "設備故障")]


def test_language(spark):
    df = spark.createDataFrame([("良い",), ("Good place",), ("、。！",), ("  ",), (None,), ("abc良い店でした",), ("Very long english text 良",)], "t string")
    assert [r[0] for r in df.select(text.language(F.col("t"))).collect()] == ["ja", "foreign", "symbols", "empty", "empty", "ja", "mixed"]


def test_experience_neutral_and_friction(spark):
    base = dict(sentiment=0.0, intensity=1.0, confidence=1.0, rating=None, memory=0.0, self_relation=0.0, revisit=0.0, recommend=0.0, wait=0.0, congestion=0.0, restriction=0.0, expectation_gap=0.0, cost_burden=0.0, information_gap=0.0)
    schema = "facility_id long, phase string, " + ", ".join(f"{k} double" for k in base)
    df = spark.createDataFrame([(1, "arrival", *base.values()), (2, "arrival", *(base | {"wait": 1.0, "congestion": 1.0}).values())], schema)
    got = {r["facility_id"]: r for r in experience.experience_index(experience.evidence(df), "facility_id").collect()}
    assert got[1]["score"] == 50.0 and got[2]["score"] < 50.0
    assert experience.phases(experience.evidence(df), "facility_id").first()["phase_weight"] == 1.0


def test_intake(spark):
    found = spark.createDataFrame([(1, "f", "", "Good", "2024-01-01", "x"), (2, "f", "", "Good", "2024-01-01", "x"), (3, "f", "", "Good", "2024-01-01", "x"), (4, "f", "A", "t", "", ""), (5, "f", "A", "t", "", "")],
                                  "row_no long, facility_key string, review_id string, text string, review_date string, reviewer_name string")
    ids = [r["review_id"] for r in ingest.with_ids(found).orderBy("row_no").collect()]
    assert ids[1] == ids[0] + "#2" and ids[2] == ids[0] + "#3" and ids[3] == ids[4] == "A" and ids[0].startswith("h:") and len(ids[0]) == 18
    named = ingest.with_ids(found)
    once = ingest.new_rows(named, named.limit(0), ["facility_key", "review_id"], "row_no")
    assert once.count() == 4 and ingest.new_rows(named, once, ["facility_key", "review_id"], "row_no").count() == 0


def test_budget(spark):
    got = ingest.budgeted(spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "dataset long, n long"), 7).orderBy("dataset").collect()
    assert [(r["fetched"], r["truncated"], r["advances"]) for r in got] == [(5, False, True), (2, True, False), (0, False, False)]
    exact = ingest.budgeted(spark.createDataFrame([(1, 7)], "dataset long, n long"), 7).first()
    assert exact["advances"] and not exact["truncated"]


def test_density_clusters():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(0, 0.05, (30, 4)), rng.normal(3, 0.05, (30, 4)), rng.uniform(-20, 20, (4, 4))])
    labels = vectors.density_clusters(points, 5)
    assert len(set(labels[:30])) == 1 and len(set(labels[30:60])) == 1 and labels[0] != labels[30] and (labels[60:] == -1).sum() >= 3
    assert (vectors.density_clusters(points[:1], 5) == -1).all()


def test_density_clusters_hold_no_square_of_points(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(vectors, "MOST_GAPS", 100_000, raising=False)
    points = np.random.default_rng(4).normal(size=(2000, 4))
    tracemalloc.start()
    vectors.density_clusters(points, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2000 * 2000 * 8 / 2


def test_density_clusters_of_a_large_label(spark, tmp_path):
    from revora.plans.ingest import hdbscan_labels

    rng = np.random.default_rng(6)
    far = np.repeat(np.eye(4)[:2], 10_001, axis=0) + rng.normal(0, 0.01, (20_002, 4))
    pd.DataFrame({"vec_id": np.arange(20_002), "embedding": list(far), "label": np.int32(1)}).to_parquet(tmp_path / "embeddings.parquet")
    got = {r["vec_id"]: r["cluster"] for r in hdbscan_labels(spark, str(tmp_path)).collect()}
    assert len(got) == 20_002 and not {got[i] for i in range(10_001)} - {-1} & {got[i] for i in range(10_001, 20_002)} - {-1}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(100, [0.0] * 8), (101, None)], "vec_id long, embedding array<double>")
    u = vectors.units(df)
    got = {(r["query"], r["rank"]): r["neighbour"] for r in vectors.nearest(u.filter("vec_id % 20 = 0"), u, 3).collect()}
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        order = [i for i in np.argsort(-(n @ n[q])) if i != q][:3]
        assert [got[q, k] for k in (1, 2, 3)] == order
    assert math.isclose(sum(1 for _ in got), 9)
