"""Deeply nested records as related flat tables, with Merkle subtree identities.

Every object of a cell is given an identity bottom-up: a scalar hashes its
type and value, a list the identities of its elements in order, an object its
keys in sorted order with the identities of their values.  Equal subtrees thus
have equal identities wherever they stand, in whichever notation.  The node
table keeps each record once; the bridge table keeps every occurrence: the row
it stands in, its parent's identity, its own identity and its positions.

Defined results: null, blank and unreadable cells give no rows; a cell may be
encoded twice; null elements keep their position and give no row; a single
record in place of a list counts as a list of one; elements of an unexpected
type give no row of their own; repeated rows give repeated occurrences.
"""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .salted import skew_join

#: What becomes a child table: column -> (child, where its own lists are).
LEVELS = {
    "review_details": ("detail", {"notes": ("note", {"replies": ("reply", {})})}),
    "photos": ("photo", {"tags": ("tag", {})}),
    "input": (None, {"filters": ("filter", {"any_of": ("choice", {})})}),
}
_OCCURRENCE = "row_no bigint, child string, pos int, sub_pos int, leaf_pos int, parent_id binary, node_id binary, content string"


class _Unreadable(Exception):
    pass


def _decode_once(text: str) -> Any:
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text.strip())
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    raise _Unreadable


def decode(text: str | None) -> Any:
    """The object written in a cell, in JSON or Python notation, possibly encoded twice; None for an unreadable one."""
    if text is None or not text.strip():
        return None
    try:
        value = _decode_once(text)
        return _decode_once(value) if isinstance(value, str) else value
    except _Unreadable:
        return None


def identity(value: Any, memo: dict | None = None) -> bytes:
    """The Merkle identity of a value."""
    h = hashlib.blake2b(digest_size=16)
    if isinstance(value, dict):
        h.update(b"o")
        for key in sorted(value, key=str):
            h.update(hashlib.blake2b(str(key).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            h.update(identity(value[key]))
    elif isinstance(value, (list, tuple)):
        h.update(b"l")
        for x in value:
            h.update(identity(x))
    else:
        h.update(type(value).__name__.encode() + b":" + _text(value).encode("utf-8", "surrogatepass"))
    return h.digest()


def _text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (dict, list, tuple)) else str(value)


def as_list(value: Any) -> list:
    """A list as it is, null as an empty one, a single record as a list of one."""
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]


def content_of(child: str, node: Any) -> str | None:
    """What a child record says, or None where its type is unexpected."""
    if child == "detail":
        return f"{_text(node.get('title')).strip()}={_text(node.get('value'))}" if isinstance(node, dict) else None
    if child in ("note", "reply"):
        return _text(node.get("text")) if isinstance(node, dict) else _text(node)
    if child == "photo":
        return _text(node.get("url")) if isinstance(node, dict) else _text(node)
    if child == "filter":
        return _text(node.get("field")) if isinstance(node, dict) else None
    return _text(node)


def occurrences(column: str, value: Any) -> Iterator[tuple[str, tuple[int, ...], bytes, bytes, str]]:
    """(child, positions, parent's identity, own identity, content) of every child record of a cell, parents first."""
    child, inner = LEVELS[column]
    root = identity((column, value))
    if child is None:
        if isinstance(value, dict):
            yield from _below(inner, value, (), root)
    else:
        yield from _elements(child, inner, value, (), root)


def _elements(child: str, inner: dict, value: Any, at: tuple[int, ...], parent: bytes) -> Iterator:
    for i, node in enumerate(as_list(value)):
        content = None if node is None else content_of(child, node)
        if content is None:
            continue
        own = identity((child, node))
        yield child, (*at, i), parent, own, content
        if isinstance(node, dict):
            yield from _below(inner, node, (*at, i), own)


def _below(inner: dict, node: dict, at: tuple[int, ...], own: bytes) -> Iterator:
    for field, (child, deeper) in inner.items():
        yield from _elements(child, deeper, node.get(field), at, own)


def flatten(df: DataFrame, key: str = "row_no", columns: tuple[str, ...] = ("review_details", "photos", "input")) -> tuple[DataFrame, DataFrame]:
    """(nodes, bridge): each distinct record once with its number of occurrences, and a row for every occurrence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[bytes] = set()  # contents already sent by this task; forgotten when large
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                for column, cell in zip(columns, row[1:]):
                    value = decode(cell)
                    if value is None:
                        continue
                    for child, at, parent, own, content in occurrences(column, value):
                        first = own not in told
                        if first:
                            told.add(own)
                        rows.append((row[0], child, *at, *([-1] * (3 - len(at))), parent, own, content if first else None))
            if len(told) > 200_000:
                told.clear()
            yield pd.DataFrame(rows, columns=["row_no", "child", "pos", "sub_pos", "leaf_pos", "parent_id", "node_id", "content"])

    found = materialize(df.select(F.col(key).cast("bigint"), *columns).mapInPandas(run, _OCCURRENCE), "nested")
    nodes = found.groupBy("node_id").agg(F.max("content").alias("content"), F.count(F.lit(1)).alias("occurrences"))
    return nodes, found.drop("content")


def child_rows(nodes: DataFrame, bridge: DataFrame, heavy_share: float = 0.01) -> DataFrame:
    """(row_no, child, pos, sub_pos, leaf_pos, content): every occurrence with its node's content."""
    nodes = materialize(nodes, "nested-nodes")
    total = bridge.count()
    heavy = [bytes(r[0]) for r in nodes.filter(F.col("occurrences") > heavy_share * total).select("node_id").collect()]  # at most 1 / heavy_share
    joined = skew_join(bridge.drop("parent_id"), nodes.select("node_id", "content"), "node_id", "row_no", heavy)
    return joined.select("row_no", "child", "pos", "sub_pos", "leaf_pos", "content")
