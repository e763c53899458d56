"""Nested records: notations, positions, shared nodes, odd cells."""

from __future__ import annotations

import json

from revora.operators import nested as n


def _found(column, cell):
    return [(c, at, content) for c, at, _, _, content in n.occurrences(column, n.decode(cell))]


def test_levels_and_nulls():
    cell = "[None, {'title': ' Food ', 'value': None, 'notes': [{'text': 'a', 'replies': [{'text': 'b'}, None, {'text': 'c'}]}]}, {'title': 'Rooms', 'value': 4}]"
    assert _found("review_details", cell) == [("detail", (1,), "Food="), ("note", (1, 0), "a"), ("reply", (1, 0, 0), "b"), ("reply", (1, 0, 2), "c"), ("detail", (2,), "Rooms=4")]


def test_single_record_twice_encoded_and_cut_off():
    assert _found("review_details", '{"title": "x", "value": "5"}') == [("detail", (0,), "x=5")]
    twice = json.dumps(json.dumps(["u", {"url": "v", "tags": ["t"]}]))
    assert _found("photos", twice) == [("photo", (0,), "u"), ("photo", (1,), "v"), ("tag", (1, 0), "t")]
    assert _found("input", "{'url': 'x', 'filters': [{'field': 'stars', 'any_of': [5, 'fr']}, {'field': 'lang'}]}") == [
        ("filter", (0,), "stars"), ("choice", (0, 0), "5"), ("choice", (0, 1), "fr"), ("filter", (1,), "lang")]
    for bad in (None, "", "  ", "[{'title': 'x'", "not a list", '"[{"'):
        assert n.decode(bad) is None or not list(n.occurrences("review_details", n.decode(bad))) or bad == "x"


def test_identity_is_of_content_not_notation():
    a, b = n.decode("[{'a': 1, 'b': [None, True]}]"), n.decode('[{"b": [null, true], "a": 1}]')
    assert n.identity(a) == n.identity(b)
    assert n.identity([1]) != n.identity(["1"]) and n.identity([1, 2]) != n.identity([2, 1]) and n.identity([]) != n.identity({})


def test_tables(spark):
    rows = [(i, "[{'title': 'Rooms', 'value': '5'}]", None if i % 2 else "['u%d']" % (i % 4), "", "clash") for i in range(200)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_no long, review_details string, photos string, input string, content string")
    nodes, bridge = n.flatten(df)
    assert bridge.count() == 300 and nodes.count() == 3
    assert {r["content"]: r["occurrences"] for r in nodes.collect()} == {"Rooms=5": 200, "u0": 50, "u2": 50}
    out = n.child_rows(nodes, bridge)
    assert out.count() == 300 and out.filter("content = 'Rooms=5'").count() == 200
    assert n.child_rows(*n.flatten(df.limit(0))).count() == 0
