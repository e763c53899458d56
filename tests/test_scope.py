"""Scopes of comparison, checks of ids, candidates, links, hooks: known values and odd inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from revora.functions import hooks, text
from revora.operators import ingest, scope
from revora.plans import ratings

MATRIX = [(1, "a", 80.0, "target"), (2, "a", 60.0, "comparison"), (3, "a", 40.0, "comparison"), (1, "b", 70.0, "target"), (2, "c", 55.0, "comparison")]
SCHEMA = "facility_id long, metric string, score double, ftype string"


def test_market_holds_the_facility_itself_and_competitors_do_not(spark):
    m = spark.createDataFrame(MATRIX, SCHEMA)
    market = {(r["facility_id"], r["metric"]): (r["baseline"], r["label"], r["diff"]) for r in scope.against_market(m).collect()}
    assert market[1, "a"] == (60.0, "market", 20.0) and market[1, "b"] == (70.0, "market", 0.0)
    others = {(r["facility_id"], r["metric"]): (r["baseline"], r["label"]) for r in scope.against_competitors(m, F.col("ftype") == "comparison").collect()}
    assert others[1, "a"] == (50.0, "competitors") and others[2, "a"] == (40.0, "competitors") and others[1, "b"] == (50.0, "neutral") and others[2, "c"] == (50.0, "neutral")
    alone = scope.against_market(m.filter("facility_id = 1")).collect()
    assert {(r["baseline"], r["label"]) for r in alone} == {(50.0, "neutral")}
    assert [(r["metric"], r["diff"]) for r in scope.lowest(scope.against_market(m), 1).filter("facility_id = 1").collect()] == [("b", 0.0)]
    for f in (scope.against_market, scope.place_in_scope, lambda x: scope.against_competitors(x, F.col("ftype") == "comparison")):
        assert f(m.limit(0)).count() == 0


def test_rank_shared_by_equals(spark):
    m = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "a", 4.0)], "facility_id long, metric string, score double")
    assert {r["facility_id"]: (r["rank"], r["facilities"]) for r in scope.place_in_scope(m).collect()} == {1: (1, 3), 2: (1, 3), 3: (3, 3)}


def test_other_matrix_only_where_the_first_is_empty(spark):
    a, b = (spark.createDataFrame([(1, n, 1.0)], "facility_id long, metric string, score double") for n in "xy")
    assert [r["metric"] for r in scope.first_filled_matrix(a, b).collect()] == ["x"]
    assert [r["metric"] for r in scope.first_filled_matrix(a.limit(0), b).collect()] == ["y"]


def test_ids(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    given = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (9, "w"), (None, "n")], "k long, problem string")
    assert {(r["k"], r["problem"]) for r in scope.id_check(asked, given, "k").collect()} == {(2, "repeated"), (3, "missing"), (9, "extra")}
    with pytest.raises(ValueError, match="1 missing, 1 repeated"):
        scope.joined_whole(asked, given, "k")
    assert scope.joined_whole(asked.filter("k = 1"), given.filter("k = 1"), "k").count() == 1


def test_candidates(spark):
    typed = spark.createDataFrame([(x,) for x in ("museum", "Sea", "館", "x", "sea museum")], "name string")
    names = spark.createDataFrame([("Sea Museum",), ("Hill museum",), ("海の館",), (None,), ("Sea Museum",)], "name string")
    got = {r["name"]: list(r["candidates"]) for r in scope.candidates(typed, names).collect()}
    assert got == {"museum": ["Hill museum", "Sea Museum"], "Sea": ["Sea Museum"], "館": ["海の館"], "sea museum": ["Sea Museum"]}


def test_links(spark):
    url = "https://www.google.com/maps/place/Sea+Museum/@35.1,139.2,17z/data=!4m2!1s0x60ab:0x12cd!8m2!3d35.5!4d-139.75!16s%2Fg%2F1x?hl=ja"
    df = spark.createDataFrame([(url,), ("https://maps.app.goo.gl/abc",), ("https://www.google.com/maps/@-1.5,2,3z",), ("?q=place_id:Ab-1_c",), ("",), (None,)], "u string")
    rows = df.select(*(c.alias(n) for n, c in ingest.map_link(F.col("u")).items())).collect()
    assert tuple(rows[0]) == ("Sea+Museum", 35.5, -139.75, "0x60ab:0x12cd", "%2Fg%2F1x", "", False)
    assert rows[1]["short"] and (rows[2]["lat"], rows[2]["lng"]) == (-1.5, 2.0) and rows[3]["place_id"] == "Ab-1_c" and rows[4]["lat"] is None and rows[5]["name"] is None


def test_names_in_links(spark):
    cells = ["https://m.example/?query=%E9%A2%A8%E3%81%AE%E6%B5%B7%E5%B1%B1%E5%8F%A3%E7%9C%8C%E4%B8%8B%E9%96%A2", "https://m.example/?query=Sea%20Museum%20North", "https://m.example/?query=%E5%B1%B1%E5%8F%A3%E7%9C%8C", "", None]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "u string").select(ingest.name_in_url(F.col("u"))).collect()]
    assert got[:4] == ["風の海", "Sea", "山口県", ""]
    inputs = ["{'url': 'https://a.example/?query=x', 'n': None}", '{"days": 1, "url": "https://b.example"}', "[]"]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in inputs], "u string").select(ingest.url_in_input(F.col("u"))).collect()] == ["https://a.example/?query=x", "https://b.example", ""]


def test_tokenizer_in_place_of_the_built_in_one(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    text.use_tokenizer(lambda texts: [t.split() for t in texts])
    try:
        assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [["a", "b"], None, []]
    finally:
        text.use_tokenizer(None)
    assert [r[0] for r in df.select(text.tokens(F.lit("Été ab"))).limit(1).collect()] == [["été", "ab"]]
    assert df.select(hooks.embedded(lambda texts: [[float(len(t))] for t in texts], F.col("t")).alias("e")).first()["e"] == [3.0]
    with pytest.raises(Exception, match="1 results for 2 texts"):
        df.coalesce(1).select(hooks.annotated(lambda texts: ["{}"], F.col("t"))).collect()


def test_clusters(spark):
    v = spark.createDataFrame([(0, "f", 1.0), (0, "g", 5.0), (1, "f", 3.0), (1, "g", 1.0), (1, "g", None)], "label int, feature string, value double")
    got = {(r["label"], r["side"]): (r["feature"], r["difference"]) for r in scope.cluster_profile(v, "label", 1).collect()}
    assert got == {(0, "high"): ("g", 2.0), (0, "low"): ("f", -1.0), (1, "high"): ("f", 1.0), (1, "low"): ("g", -2.0)}


def test_facilities_without_reviews_where_there_are_some(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string").write.parquet(str(tmp_path / "facility.parquet"))
    spark.createDataFrame([(1,), (1,), (None,)], "facility_id long").write.parquet(str(tmp_path / "review.parquet"))
    assert {r["facility_id"] for r in ratings.facilities_without_reviews(spark, str(tmp_path)).collect()} == {2, 3}
