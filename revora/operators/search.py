"""Suggestions for a typed name: the nearest names by matching blocks, containment first.

The ratio is that of matching blocks (difflib).  It can't exceed the share of
common characters, which is cheap for all names at once; the ratio itself is
made only for names, in order of that bound, that could still enter the list.

Defined results: names are compared apart from width and case; the name itself,
null and blank names are no suggestions; ties go to the smaller id.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

CONTAINED, LEAST, SHOWN, BLOCK, BUCKETS = 0.75, 0.45, 5, 2000, 256


def key_of(name: str | None) -> str:
    return unicodedata.normalize("NFKC", name or "").casefold().strip()


def ratio(a: str, b: str) -> float:
    """Similarity of two keys; at least CONTAINED where one holds the other."""
    r = SequenceMatcher(None, a, b).ratio()
    return max(r, CONTAINED) if a and b and (a in b or b in a) else r


def _counts(keys: list[str]) -> np.ndarray:
    out = np.zeros((len(keys), BUCKETS), dtype=np.int16)
    for i, k in enumerate(keys):
        np.add.at(out[i], [ord(c) % BUCKETS for c in k], 1)
    return out


def nearest_names(query: str, keys: list[str], counts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[float, int]]:
    """(ratio, id) of the n best of a list of names for one query."""
    q = key_of(query)
    if not q:
        return []
    common = np.minimum(counts, _counts([q])[0]).sum(axis=1)
    bound = np.maximum(2 * common / np.maximum(lengths + len(q), 1), np.where((common >= len(q)) | (common >= lengths), CONTAINED, 0.0))
    best: list[tuple[float, int]] = []
    for i in np.argsort(-bound, kind="stable"):
        if bound[i] < LEAST or len(best) == n and bound[i] < best[-1][0]:
            break
        if keys[i] and keys[i] != q and (r := round(ratio(q, keys[i]), 9)) >= LEAST:
            best = sorted([*best, (r, int(ids[i]))], key=lambda x: (-x[0], x[1]))[:n]
    return best


def suggest(queries: DataFrame, names: DataFrame, n: int = SHOWN) -> DataFrame:
    """(query_id, rank, id, ratio) for queries (query_id, name) against all names (id, name), queries taken in blocks."""
    spark, out, block = names.sparkSession, None, []

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                keys, ids = [key_of(x) for x in b["name"]], b["id"].to_numpy()
                counts, lengths = _counts(keys), np.array([len(k) for k in keys])
                rows = [(qid, i, r) for qid, q in shared.value for r, i in nearest_names(q, keys, counts, lengths, ids, n)]
                yield pd.DataFrame(rows, columns=["query_id", "id", "ratio"])

        return names.select("id", "name").mapInPandas(run, "query_id bigint, id bigint, ratio double")

    for row in queries.filter("trim(name) <> ''").select("query_id", "name").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, id bigint, ratio double")
    w = Window.partitionBy("query_id").orderBy(F.desc("ratio"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
