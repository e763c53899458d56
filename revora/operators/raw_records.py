"""Rows that fail to parse: a minimum-cost error parse of delimited records.

A record is read by a four-state automaton (field start, plain field, inside
quotes, after a closing quote).  Dynamic programming finds the cheapest series
of edits, insertion or deletion of a quote or of a delimiter, after which the
record has the wanted number of fields.  Cost zero means a well-formed record.
Quote edits weigh more than delimiter edits, and a delimiter edit joins or
splits fields without changing how their quotes are read, so a record gets a
quote edit exactly when its quoting is broken.  Records of cost zero are then
checked for their types; all others state their reason by the edits.

Defined results: a null record counts as a record of no fields
('column_count'), an empty one as a record of one empty field.  Repeated
records are judged one by one.  Other columns of the input are left out.
"""

from __future__ import annotations

import ast
import datetime as dt
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: The columns of the vendor's export, in its order.
EXPORT_COLUMNS = (
    "scraped_at", "input", "error", "error_code", "url", "place_id", "place_name", "country", "address", "review_id",
    "reviewer_name", "reviews_by_reviewer", "photos_by_reviewer", "reviewer_url", "local_guide", "review_rating", "review", "review_date",
    "number_of_likes", "response_of_owner", "response_date", "photos", "review_details", "profile_pic_url", "place_general_rating",
    "overall_place_riviews", "questions_answers", "fid_location", "category", "cid",
)

_FIELD = re.compile(r'"[^"]*(?:""[^"]*)*"(?=\t|\Z)|[^"\t][^\t]*|(?=\t|\Z)')
_SYMBOL = re.compile(r'\t|"|[^\t"]+')
_NUMBER = re.compile(r"[+-]?\d+(?:\.\d*)?", re.ASCII)
_WHOLE = re.compile(r"\+?\d+", re.ASCII)
_ISO = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ].+)?|\d{8}(?:T.+)?|\d{4}-?W\d{2}(?:-?\d)?(?:T.+)?", re.ASCII)

_START, _PLAIN, _INSIDE, _CLOSED = range(4)


def split_exact(raw: str) -> list[str] | None:
    """The fields of a record that needs no quote edit, else None."""
    fields, at, end = [], 0, len(raw)
    while m := _FIELD.match(raw, at):
        text = m.group()
        fields.append(text[1:-1].replace('""', '"') if text[:1] == '"' else text)
        at = m.end()
        if at == end:
            return fields
        at += 1  # the delimiter
    return None


def edit_cost(raw: str, width: int) -> tuple[int, int, int, int]:
    """(inserted quotes, deleted quotes, inserted delimiters, deleted delimiters) of a cheapest repair to ``width`` fields."""
    # a cost is one integer that orders by quote edits, then delimiter edits, and also carries how many of each were
    # insertions; its fields are as wide as this record's quotes and delimiters ask for
    quotes, delimiters, inserted = (n.bit_length() + 1 for n in (raw.count('"') + 4, raw.count("\t") + width + 4, width + 4))
    _DI, _QI, _D = 1, 1 << inserted, 1 << (inserted + quotes)
    _Q = _D << delimiters
    top = inserted + 2 * quotes + delimiters
    kind, _NEVER = (np.int64, np.int64(1 << 62)) if top < 61 else (object, 1 << (top + 2))
    cost = np.full((4, width), _NEVER, dtype=kind)  # state x delimiters read so far
    cost[_START, 0] = 0

    steps = np.arange(width, dtype=np.int64).astype(kind) * (_D + _DI)

    def insertions() -> None:
        for s, t in ((_CLOSED, _INSIDE), (_INSIDE, _CLOSED), (_START, _INSIDE)):
            np.minimum(cost[t], cost[s] + (_Q + _QI), out=cost[t])
        for s in (_START, _PLAIN):  # a chain of inserted delimiters: a running minimum over the field count
            np.minimum(cost[s], np.minimum.accumulate(cost[s] - steps) + steps, out=cost[s])
        np.minimum(cost, _NEVER, out=cost)

    insertions()
    for m in _SYMBOL.finditer(raw):
        symbol, new = m.group(), np.full((4, width), _NEVER, dtype=kind)
        if symbol == "\t":
            new[_INSIDE] = cost[_INSIDE]  # inside quotes it is text
            ended = cost[[_START, _PLAIN, _CLOSED]].min(axis=0)
            new[_START] = ended + _D  # deleted
            np.minimum(new[_START, 1:], ended[:-1], out=new[_START, 1:])
        elif symbol == '"':
            new[:] = cost + _Q
            new[_PLAIN] = cost[_PLAIN]
            np.minimum(new[_INSIDE], np.minimum(cost[_START], cost[_CLOSED]), out=new[_INSIDE])
            np.minimum(new[_CLOSED], cost[_INSIDE], out=new[_CLOSED])
        else:
            new[_PLAIN] = np.minimum(cost[_START], cost[_PLAIN])
            new[_INSIDE] = cost[_INSIDE]
        cost = np.minimum(new, _NEVER)
        insertions()
    best = int(cost[[_START, _PLAIN, _CLOSED], width - 1].min())
    di, qi = best & (_QI - 1), (best % _D) // _QI
    edits = best % _Q // _D
    return qi, best // _Q - qi, di, edits - di


def readable_list(text: str) -> bool:
    """Whether the text is a list in JSON or Python notation."""
    for read in (json.loads, ast.literal_eval):
        try:
            return isinstance(read(text.strip()), list)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return False


def _existing_date(text: str) -> bool:
    if not _ISO.fullmatch(text):
        return False
    try:
        dt.datetime.fromisoformat(text)
        return True
    except ValueError:
        return False


def _bad_value(cells: dict[str, str]) -> str | None:
    """The first column whose non-empty cell is invalid."""
    x = cells["review_rating"].strip()
    if x and not (_NUMBER.fullmatch(x) and 1 <= float(x) <= 5):
        return "review_rating"
    x = cells["number_of_likes"].strip()
    if x and not _WHOLE.fullmatch(x):
        return "number_of_likes"
    x = cells["local_guide"].strip()
    if x and x.lower() not in ("true", "false"):
        return "local_guide"
    x = cells["review_date"].strip()
    if x and not _existing_date(x):
        return "review_date"
    x = cells["review_details"].strip()
    if x and not readable_list(x):
        return "review_details"
    return None


def judge(raw: str | None, columns: tuple[str, ...] = EXPORT_COLUMNS) -> tuple[str | None, str | None, list[str] | None]:
    """(reason, detail, fields) of one record; reason is None for a record that loads."""
    if raw is None:
        return "column_count", "null record", None
    fields = split_exact(raw)
    if fields is None or len(fields) != len(columns):
        qi, qd, di, dd = edit_cost(raw, len(columns))
        detail = ", ".join(f"{what} {n}" for what, n in (("insert quote", qi), ("delete quote", qd), ("insert delimiter", di), ("delete delimiter", dd)) if n)
        return ("quoting" if qi + qd else "column_count"), detail, None
    cells = dict(zip(columns, fields))
    if cells["error"].strip() or cells["error_code"].strip():
        return "error", cells["error"].strip() or cells["error_code"].strip(), None
    bad = _bad_value(cells)
    return ("value", bad, None) if bad else (None, None, fields)


def parse_records(df: DataFrame, key: str = "rec_no", raw: str = "raw") -> DataFrame:
    """One row per record: the key, the reason and detail where it fails, and its 30 columns where it loads."""
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("reason", T.StringType()), T.StructField("detail", T.StringType())]
        + [T.StructField(c, T.StringType()) for c in EXPORT_COLUMNS]
    )
    names = [f.name for f in schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = [None] * len(EXPORT_COLUMNS)
        for b in batches:
            rows = []
            for k, text in zip(b.iloc[:, 0], b.iloc[:, 1]):
                reason, detail, fields = judge(text)
                rows.append([None if pd.isna(k) else k, reason, detail, *(fields or empty)])
            yield pd.DataFrame(rows, columns=names)

    return df.select(F.col(key), F.col(raw)).mapInPandas(run, schema)


def rejected(parsed: DataFrame, key: str = "rec_no") -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select(key, "reason", "detail")


def loaded(parsed: DataFrame, key: str = "rec_no") -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).select(key, *EXPORT_COLUMNS)
