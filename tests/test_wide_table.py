"""Wide tables: notations, versions, compaction, odd inputs; against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from revora.operators import wide_table as w

DEFS = [("staff_care", "スタッフ対応", "Staff care"), ("parking", "駐車場", "Parking"), ("opened_year", "開館年", "Opened year"), ("renovated_on", "改装日", "Renovated on")]
TYPES = {"opened_year": "integer", "parking": "flag", "renovated_on": "date", "staff_care": "decimal"}


def test_names():
    keys = w.attribute_keys(DEFS)
    for name in ("staff_care", "STAFF CARE", "Ｓｔａｆｆ　ｃａｒｅ", "ｽﾀｯﾌ対応", " スタッフ対応", "スタッフ対応（Staff care）", "Staff-care:"):
        assert keys[w.name_key(name)] == "staff_care", name
    assert w.name_key("memo") not in keys and w.name_key(None) is None


def test_values(spark):
    cases = {
        "decimal": {"4.2": "4.20", "3,0": "3.00", "４．０": "4.00", "3.9点": "3.90", "91.4/100": "91.40", " 9.4 ": "9.40", "-": None, "N.A.": None, "": None, "調査中": None},
        "integer": {"176,515": "176515", "２０９５３２": "209532", "1980年": "1980", "1900.0": "1900", "331,580人": "331580", "12.5": None, "不明": None},
        "flag": {"有": "true", "×": "false", "Y": "true", "no": "false", "TRUE": "true", "0": "false", "未測定": None},
        "date": {"2022年4月11日": "2022-04-11", "2013/10/19": "2013-10-19", "20090501": "2009-05-01", "2000.11.03": "2000-11-03", "2002-02-30": None, "済": None},
    }
    for kind, values in cases.items():
        df = spark.createDataFrame([(v,) for v in values], "v string")
        got = {r["v"]: r["c"] for r in df.select("v", w.cell_text(w.typed(F.col("v"), kind), kind).alias("c")).collect()}
        assert got == values, kind


def test_latest_readable_version_wins_in_any_batching(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 6), rng.choice(list(TYPES)), rng.choice(["1", "2020", "yes", "20200102", "??", None]), i) for i in range(1, 400)]
    rows += [(None, "parking", "1", 500), (1, None, "1", 501), (1, "parking", "yes", None), rows[0]]
    df = spark.createDataFrame(rows, "e long, a string, v string, id long")
    read = {"integer": lambda v: v if v in ("1", "2020", "20200102") else None, "flag": lambda v: {"1": "true", "yes": "true"}.get(v), "date": lambda v: "2020-01-02" if v == "20200102" else None,
            "decimal": lambda v: f"{v}.00" if v in ("1", "2020", "20200102") else None}
    want: dict = {}
    for e, a, v, i in rows:
        if e is not None and a is not None and i is not None and (c := read[TYPES[a]](v)) is not None and (e, a) not in want or e is not None and a is not None and i is not None and c is not None and want[e, a][0] < i:
            want[e, a] = (i, c)
    for size in (7, 100, 10_000):
        runs = w.delta(df, "e", "a", "v", "id", TYPES, F.floor(F.col("id") / size).cast("bigint"))
        got = {(r["entity_id"], r["attr"]): r["cell"] for r in w.filled_cells(w.compact(runs, TYPES), TYPES).collect()}
        assert got == {k: c for k, (_, c) in want.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "e long, a string, v string, id long, batch string, entity_id string")
    wide = w.compact(w.delta(df, "e", "a", "v", "id", TYPES), TYPES)
    assert wide.count() == 0 and set(TYPES) < set(wide.columns)


def test_more_definitions_than_ten_thousand(spark, tmp_path):
    from revora.plans import problems

    n = 10_050
    spark.range(n).selectExpr("concat('a', id) as attr", "concat('b', id) as label_ja", "concat('c', id) as label_en", "'score' as held_in", "'text' as value_type").coalesce(1).write.parquet(str(tmp_path / "metric_def.parquet"))
    keys, types = problems._definitions(spark, str(tmp_path), "score")
    assert len(types) == n and set(keys.values()) == set(types)


def test_key_expression_is_the_key(spark):
    names = ["staff_care", "STAFF CARE", "Ｓｔａｆｆ　ｃａｒｅ", "ｽﾀｯﾌ対応", "ｻｰﾋﾞｽ（Service）", "ﾛｹｰｼｮﾝ:", "パｰｸ", "ﾊﾟｰｷﾝｸﾞ", " 客室　", "Trip type", "旅行の種類", "Opened-year:", "", "→％＋", "Âccès été"]
    got = {r["n"]: r["k"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", w.name_key_column(F.col("n")).alias("k")).collect()}
    assert got == {n: w.name_key(n) for n in names}


def test_store_merges_runs_and_reads_only_those(spark, tmp_path):
    rng = random.Random(5)
    store, rows, read = w.LogStore(spark, str(tmp_path / "log"), TYPES), [], []
    plain_read = store._read
    store._read = lambda names: (read.append(list(names)), plain_read(names))[1]
    assert store.wide().count() == 0
    for batch in range(6):
        new = [(rng.randint(1, 9), rng.choice(list(TYPES)), rng.choice(["1", "2020", "yes", "20200102", "??"]), batch * 50 + i) for i in range(50)]
        rows += new
        store.append(w.delta(spark.createDataFrame(new, "e long, a string, v string, id long"), "e", "a", "v", "id", TYPES))
    assert sorted(t for _, t in store.runs()) == [0, 0, 1] and [len(r) for r in read] == [4]  # four runs merged once, the rest not read
    again = w.LogStore(spark, str(tmp_path / "log"), TYPES)
    whole = w.compact(w.delta(spark.createDataFrame(rows, "e long, a string, v string, id long"), "e", "a", "v", "id", TYPES), TYPES)
    cells = lambda wide: sorted(map(tuple, w.filled_cells(wide, TYPES).collect()))
    assert cells(again.wide()) == cells(whole)
