"""Survivors and fusion: against brute force, with odd rows."""

from __future__ import annotations

import datetime as dt
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from revora.llm import fusion

SCHEMA = "id long, facility_id long, review_id string, reviewer_name string, review_date string, text string, owner_response string, likes int, fetched_at timestamp_ntz, n string"


def _plain(rows):
    parent = {r[0]: r[0] for r in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((top(a), top(b)))
        parent[b] = a

    real = lambda r: r[2] is not None and r[2].strip() and not r[2].strip().startswith("h:")
    vendor, content, loose = {}, {}, set()
    for r in rows:
        if real(r) and r[1] is not None:
            join(r[0], vendor.setdefault((r[1], r[2].strip()), r[0]))
        day = re.match(r"\s*(\d{4})[-/.](\d\d)[-/.](\d\d)", r[4] or "")
        if r[1] is not None and (r[3] or "").strip() and day and (r[5] or "").strip():
            k = (r[1], r[3], day.groups(), r[5])
            content.setdefault(k, []).append(r[0])
            if not real(r):
                loose.add(k)
    for k in loose:
        for x in content[k]:
            join(x, content[k][0])
    groups: dict = {}
    for r in rows:
        groups.setdefault(top(r[0]), []).append(r)
    out = set()
    when = lambda r: r[8] or dt.datetime.min
    for first, rs in groups.items():
        if len(rs) < 2:
            continue
        for field, ok, key in (
            ("review_id", real, lambda r: (when(r), -r[0])), ("text", lambda r: (r[5] or "").strip(), lambda r: (len(r[5].strip()), when(r), -r[0])),
            ("owner_response", lambda r: (r[6] or "").strip(), lambda r: (when(r), -r[0])), ("likes", lambda r: r[7] is not None, lambda r: (when(r), -r[0])),
        ):
            if fit := [r for r in rs if ok(r)]:
                out.add((first, field, max(fit, key=key)[0]))
    return out


def _rows(n, seed):
    rng = random.Random(seed)
    days = ["2024-01-01T05:00:00Z", "2024/01/01 10:00", "2024-01-01", "2024-01-02", "", None]
    return [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["A", " A", "B\n", "C", "h:1", "h:2", None, ""]), rng.choice(["x", "y", None, " "]), rng.choice(days), rng.choice(["good", "good place", " ", "", None, "  good place "]),
             rng.choice([None, "", "thanks"]), rng.choice([None, 0, 3]), rng.choice([None, dt.datetime(2024, 2, 1), dt.datetime(2024, 3, rng.randint(1, 9))]), "clash") for i in range(1, n)]


def _found(df):
    return {tuple(r) for r in fusion.fused(df, trust=fusion.STATED).select("first_id", "field", "keep_id").collect()}


def test_against_brute_force(spark):
    for seed in range(4):
        rows = _rows(60, seed)
        assert _found(spark.createDataFrame(rows, SCHEMA)) == _plain(rows)


def test_one_group_holds_nearly_all(spark):
    rows = [(i, 1, "A" if i % 3 else None, "x", "2024-01-01", "t", None, i % 5, dt.datetime(2024, 1, 1 + i % 20), "") for i in range(1, 2000)]
    got = _found(spark.createDataFrame(rows, SCHEMA))
    assert got == _plain(rows) and {f for f, _, _ in got} == {1}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert not _found(df) and fusion.with_values(fusion.fused(df), df).count() == 0


def test_fusion_prefers_accurate_sources(spark):
    """Three careful crawls; four careless ones, which err alone elsewhere, share a false value in a few groups and are outvoted although they are more."""
    rows, k = [], 0
    for g in range(120):
        shared = g % 15 == 0
        for month in range(1, 8):
            wrong = month > 3 and (shared or month == 4 + g % 4)
            k += 1
            rows.append((k, 1, f"V{g}", "x", "2024-01-01", (f"false {g}" if shared else f"false {g} {month}") if wrong else f"true {g}", None, 1, dt.datetime(2024, month, 2), ""))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["first_id"]: r["value"] for r in fusion.with_values(fusion.fused(df, trust=0.0), df).filter("field = 'text'").collect()}
    assert len(got) == 120 and all(v.startswith("true") for v in got.values())


def test_fusion_takes_rows_without_time_of_fetching(spark):
    day = dt.datetime(2024, 1, 2)
    rows = [(i, 1, "V1", "x", "2024-01-01", "told", None, 1, None, "") for i in (1, 2)] + [(i, 1, "V2", "x", "2024-01-02", "known", None, 1, at, "") for i, at in ((3, None), (4, day))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["first_id"], r["value"]) for r in fusion.with_values(fusion.fused(df), df).filter("field = 'text'").collect()}
    assert got == {(1, "told"), (3, "known")}


def test_more_months_than_sources_of_their_own(spark):
    rows = [(i, 1, f"V{i // 2}", "x", "2024-01-01", f"t{i}", None, 1, dt.datetime(1800 + i // 24, 1 + i // 2 % 12, 1 + i % 2), "") for i in range(5000)]
    assert _found(spark.createDataFrame(rows, SCHEMA)) == _plain(rows)
    counts = [(1, m) for m in (24000, 24005)] + [(1, -1999 - 10)]
    got = fusion.Sources(counts).of(np.ones(5, int), np.array([24000, 24005, 1999 * 12 + 3, 23000, -1]))
    assert len(set(got.tolist())) == 5


def test_groups_whose_values_take_several_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, 1, f"V{i % 2}", "x", "2024-01-01", rng.choice(["a", "bb", f"t{i}"]), None, i % 50, dt.datetime(2024, 1 + i % 12, 2), "") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {tuple(r) for r in fusion.fused(df).collect()}
    monkeypatch.setattr(fusion, "VALUES", 25)
    assert _found(df) == _plain(rows)
    parts = {tuple(r) for r in fusion.fused(df).collect()}
    assert {r[:3] for r in parts} == {r[:3] for r in whole}
    assert sorted(r[3] for r in parts) == pytest.approx(sorted(r[3] for r in whole), abs=1e-5)


def test_copied_votes_are_discounted():
    """Two sources that copy each other count little more than one."""
    sources = fusion.Sources([(1, m) for m in (100, 101, 102)])
    batch = pa.RecordBatch.from_pydict({"field": pa.array([1], pa.int32()), "preferred": pa.array([-1], pa.int32()), "months": pa.array([[[100, 101], [102]]], pa.list_(pa.list_(pa.int32())))})
    free = fusion.Votes(batch, sources, 0.0).votes
    a, b = sources.of(np.ones(2, int), np.array([100, 101])) - sources.base[1]
    sources.copies[1][a, b] = sources.copies[1][b, a] = 1.0
    bound = fusion.Votes(batch, sources, 0.0).votes
    assert free[0] == pytest.approx(2 * free[1]) and bound[0] == pytest.approx(1.2 * free[1])
