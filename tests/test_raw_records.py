"""Error parse: exact definitions, the edit distance against brute force, and odd inputs."""

from __future__ import annotations

import itertools
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T

from revora.operators import raw_records as rr

N = len(rr.EXPORT_COLUMNS)


def record(**cells: str) -> str:
    return "\t".join(cells.get(c, "") for c in rr.EXPORT_COLUMNS)


def test_reasons_in_order():
    assert rr.judge(record(review="ok", review_rating="4"))[0] is None
    assert rr.judge(record(review='"open', error="x"))[0] == "quoting"
    assert rr.judge(record(review='"a"b'))[0] == "quoting"
    assert rr.judge(record(review="a") + "\t")[0] == "column_count"
    assert rr.judge("a\tb")[0] == "column_count"
    assert rr.judge(record(error_code="500", review_rating="nine"))[0] == "error"
    assert rr.judge(record(review_rating="6"))[:2] == ("value", "review_rating")
    assert rr.judge(record(number_of_likes="1.5"))[1] == "number_of_likes"
    assert rr.judge(record(local_guide="maybe"))[1] == "local_guide"
    assert rr.judge(record(review_date="2023-02-30"))[1] == "review_date"
    assert rr.judge(record(review_date="2023-02-28T10:00:00.123Z"))[0] is None
    assert rr.judge(record(review_details="[{'a'"))[1] == "review_details"
    assert rr.judge(record(review_details="{'title': 'x'}"))[1] == "review_details"


def test_quotes_and_line_breaks():
    _, _, fields = rr.judge(record(review='"two\nlines, a ""quote"" and a\ttab"'))
    assert fields[rr.EXPORT_COLUMNS.index("review")] == 'two\nlines, a "quote" and a\ttab'
    assert rr.judge(record(review='say "hi" there'))[0] is None


def test_null_empty_and_long():
    assert rr.judge(None)[0] == "column_count"
    assert rr.judge("")[0] == "column_count"
    long = "x" * 300_000
    assert rr.judge(record(review=long))[2][16] == long
    assert rr.judge(record(review='"' + long))[0] == "quoting"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='a"\t', max_size=14))
def test_quote_edits_exactly_where_quoting_is_broken(raw):
    qi, qd, di, dd = rr.edit_cost(raw, 3)
    fields = rr.split_exact(raw)
    assert (fields is None) == (qi + qd > 0)
    if fields is not None:
        assert (len(fields) == 3) == (di + dd == 0)


def test_cheapest_repair_against_brute_force():
    """With quoting intact, the delimiter edits are the difference of the field counts."""
    rng = random.Random(5)
    for _ in range(200):
        fields = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 6))]
        _, _, di, dd = rr.edit_cost("\t".join(fields), 3)
        assert (di, dd) == (max(0, 3 - len(fields)), max(0, len(fields) - 3))


def test_single_quote_edit_is_enough():
    for raw in ('"a\tb\tc', 'a\t"b"x\tc', 'a\tb\t"'):
        qi, qd, _, _ = rr.edit_cost(raw, 3)
        assert qi + qd == 1, raw


def test_table(spark):
    schema = T.StructType([T.StructField("rec_no", T.LongType()), T.StructField("raw", T.StringType()), T.StructField("reason", T.StringType())])
    rows = [(1, record(review="a"), "clash"), (2, "x", None), (2, "x", None), (3, None, None)]
    parsed = rr.parse_records(spark.createDataFrame(rows, schema))
    assert sorted(tuple(r) for r in rr.rejected(parsed).select("rec_no", "reason").collect()) == [(2, "column_count"), (2, "column_count"), (3, "column_count")]
    assert [r["review"] for r in rr.loaded(parsed).collect()] == ["a"]
    assert rr.parse_records(spark.createDataFrame([], schema)).count() == 0


def test_every_reason_in_data(spark, folder):
    from revora.plans import problems

    found = {r["reason"] for r in problems.p1_found(spark, folder).collect()}
    assert found <= {"quoting", "column_count", "error", "value"}
    n = spark.read.parquet(f"{folder}/sample_raw.parquet").count()
    assert problems.p1_found(spark, folder).count() + problems.p1_loaded(spark, folder).count() == n


def test_splitting_round_trip():
    for cells in itertools.product(["", "a", 'q"q', "t\tt", "n\nn"], repeat=3):
        raw = "\t".join('"' + c.replace('"', '""') + '"' if set(c) & set('"\t\n') else c for c in cells)
        assert rr.split_exact(raw) == list(cells)


def test_reason_of_a_failed_scrape_is_whole():
    for column in ("error", "error_code"):
        why = "timed out; " * 60 + "end"
        assert rr.judge(record(**{column: why}))[:2] == ("error", why)


def test_many_surplus_delimiters():
    """Surplus delimiters never count as quotes, however many there are."""
    n = 100_000
    reason, detail, _ = rr.judge("a\t" * n + "b", tuple("xyz"))
    assert reason == "column_count" and detail == f"delete delimiter {n - 2}"
    assert rr.edit_cost('"' + "\t" * 70, 80)[:2] in ((1, 0), (0, 1))
    assert rr.edit_cost("x" + "\t" * 3, 300) == (0, 0, 296, 0)  # more fields than a byte counts
