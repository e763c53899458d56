"""Every llm query runs and gives the columns that are asked for."""

from __future__ import annotations

import pytest

from revora.llm import queries

COLUMNS = {
    "p5_found": ["facility_id", "tab", "rec_id"], "p6_found": ["tab", "rec_id"], "p7_found": ["first_id", "field", "keep_id"],
    "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows})


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(queries.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) [\w.]*llm", p.read_text(), re.M), p


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, folder, name):
    from tests.oracle import connection, difference

    assert difference(queries.QUERIES[name](spark, folder).toPandas(), connection(folder), queries.SQL[name]) is None
