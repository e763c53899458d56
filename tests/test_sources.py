"""Exports in several notations, score sheets of both layouts, paged source and sync."""

from __future__ import annotations

import json

from revora.sources import exports
from revora.sources.paged import PagedReviews
from revora.streaming import sync

HEAD = ["place_name", "review", "review_rating"]
ROWS = [["海の館", 'two\nlines and a "quote"', "5"], ["山の館", "a, b", ""]]


def _write(path, sep, encoding):
    cell = lambda c: '"' + c.replace('"', '""') + '"' if set(c) & set('"\n,\t') else c
    path.write_bytes("\n".join(sep.join(map(cell, r)) for r in [HEAD, *ROWS]).encode(encoding))


def test_notations(spark, tmp_path):
    for name, sep, encoding in (("a", "\t", "utf-8-sig"), ("b", ",", "cp932"), ("c", "\t", "utf-8"), ("d", ",", "utf-8")):
        _write(tmp_path / f"{name}.csv", sep, encoding)
        df = exports.read_export(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == HEAD and sorted(map(list, df.collect())) == sorted(ROWS), name


def test_every_file_in_its_own_notation(spark, tmp_path):
    head = "place_name\treview\treview_rating\n"
    (tmp_path / "a.csv").write_bytes((head + "x\tplain\t5\n" * 9000 + "海の館\tよい\t4\n").encode("cp932"))  # ASCII for more than 64 KB
    (tmp_path / "b.csv").write_bytes("review,place_name\nよい,山の館\n".encode())
    (tmp_path / "c.csv").write_bytes("place_name\tcountry\n川の館\tJP\n".encode("cp932"))
    got = exports.read_export(spark, str(tmp_path))
    assert set(got.columns) == {"place_name", "review", "review_rating", "country"}
    found = {(r["place_name"], r["review"], r["review_rating"], r["country"]) for r in got.filter("place_name <> 'x'").collect()}
    assert found == {("海の館", "よい", "4", ""), ("山の館", "よい", "", ""), ("川の館", "", "", "JP")} and got.count() == 9003


def test_sheets(spark):
    wide = spark.createDataFrame([("海の館", "4.2", "80", ""), ("山の館", "3.8", "n/a", "x")], ["施設名", "清潔感", "食事", "備考"])
    roles = exports.sheet_roles(wide)
    assert roles["layout"] == "wide" and roles["place"] == "施設名" and "清潔感" in roles["metrics"]
    long = spark.createDataFrame([("海の館", "食事", "4.5"), ("海の館", "設備", "?"), ("山の館", "食事", "3")], ["施設名", "項目", "スコア"])
    roles = exports.sheet_roles(long)
    assert roles == {"layout": "long", "place": "施設名", "axis": "項目", "value": "スコア", "scale": 5.0}
    assert sorted(tuple(r) for r in exports.sheet_scores(long, roles).collect()) == [("山の館", "食事", 3.0, 5.0), ("海の館", "食事", 4.5, 5.0)]


def _page(folder, number, records):
    (folder / f"{number:04d}.jsonl").write_text("\n".join(json.dumps(r) for r in records))


def test_sync_is_incremental_and_idempotent(spark, tmp_path):
    spark.dataSource.register(PagedReviews)
    record = lambda i, month: {"dataset_id": "d", "review_id": f"r{i}", "title": "T", "body": f"b{i}", "rating": 4.5, "published_at": f"2024-0{month}-01T00:00:00Z", "place": "p"}
    _page(tmp_path, 1, [record(1, 1), record(2, 1), record(2, 1)])
    assert spark.read.format("paged_reviews").load(str(tmp_path)).count() == 3
    assert spark.read.format("paged_reviews").option("since", "2024-02").load(str(tmp_path)).count() == 0
    held = spark.createDataFrame([("p", "r1")], "facility_key string, review_id string")
    stream = lambda: spark.readStream.format("paged_reviews").load(str(tmp_path))
    loaded, ledger, folder = sync.sync(stream(), held)
    assert [r["review_id"] for r in loaded.collect()] == ["r2"] and loaded.first()["text"] == "T\nb2"
    _page(tmp_path, 2, [record(2, 2), record(3, 2)])
    loaded, ledger, _ = sync.sync(stream(), held, folder)
    assert sorted(r["review_id"] for r in loaded.collect()) == ["r2", "r3"]
    assert {r["month"]: r["n"] for r in ledger.collect()} == {"2024-01": 3, "2024-02": 2}
    _page(tmp_path, 0, [record(4, 3)])  # comes late, with a smaller name
    loaded, ledger, _ = sync.sync(stream(), held, folder)
    assert sorted(r["review_id"] for r in loaded.collect()) == ["r2", "r3", "r4"]
    assert {r["month"]: r["n"] for r in ledger.collect()} == {"2024-01": 3, "2024-02": 2, "2024-03": 1}
    loaded, ledger, _ = sync.sync(stream(), held, folder)
    assert loaded.count() == 3 and sum(r["n"] for r in ledger.collect()) == 6


def test_stream_counts_equal_batch(spark, folder):
    from revora.streaming.events import daily_counts

    got = {(r["day"], r["event_type"]): r["n"] for r in daily_counts(spark, folder).collect()}
    plain = spark.read.parquet(f"{folder}/events.parquet").selectExpr("date_format(ts, 'yyyy-MM-dd') day", "event_type").groupBy("day", "event_type").count()
    assert got == {(r["day"], r["event_type"]): r["count"] for r in plain.collect()}
