"""A bounded sample of texts to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hash_sample(texts: DataFrame, column: str, size: int, chars: int) -> list[str]:
    """About the ``size`` distinct texts with the smallest hashes, each cut to ``chars`` characters; at most ``size``.

    A share of the hash range that should hold twice the size is kept first, so
    what reaches the driver is bounded however many tasks there are; copies of
    one text count once, null and blank texts not at all.  The number of rows is
    read from the tables' footers, so the texts are read once.
    """
    n = texts.count()
    chosen = texts.filter(F.length(F.trim(column)) > 0).select(F.substring(column, 1, chars).alias("t"), F.xxhash64(column).alias("h"))
    if n > 2 * size:
        steps = 1_000_000
        chosen = chosen.filter(F.pmod(F.shiftright("h", 20), F.lit(steps)) < max(1, round(steps * 2 * size / n)))
    return [r["t"] for r in chosen.distinct().orderBy("h", "t").limit(size).collect()]
