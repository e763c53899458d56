"""Per-key results where a few keys hold most records: two-stage salted aggregation.

Heavy keys are those above a share of the rows of a sample, a share of the hashes
of their ``spread_by`` column, of which there can be at most 1 / share, so their
list is bounded whatever the data; which keys are salted decides only where the
work is done, never a result.  The number of rows comes from the tables'
footers, and SAMPLE_ROWS bound the sample.  Heavy keys' rows get a salt,
partial results are made per (key, salt) and then merged per key.  The salt is
a hash of a row's own column, not a random number drawn anew: a task that is
run again after a lost executor gives the same salts.  Counting distinct values
uses the value itself as the salt's source, so a value falls under one salt and
partial counts add up.

Defined results: null keys form one group of their own; nulls in the measured
columns are left out as SQL does; an empty input gives no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEAVY_SHARE = 0.01
SALTS = 32
#: About how many rows show which keys are heavy.
SAMPLE_ROWS = 1_000_000


def heavy_keys(df: DataFrame, key: str, spread_by: str, share: float = HEAVY_SHARE) -> tuple[list, int]:
    """Keys that hold more than ``share`` of a sample's rows (at most 1/share of them), and the number of all rows."""
    total = df.count()
    chosen = df.select(key, spread_by)
    if total > SAMPLE_ROWS:
        chosen = chosen.filter(F.pmod(F.xxhash64(F.col(spread_by), F.lit(7)), F.lit(1 << 20)) < (1 << 20) * SAMPLE_ROWS / total)
    counts = chosen.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter((F.col("n") > share * min(total, SAMPLE_ROWS)) & F.col(key).isNotNull()).select(key).collect()
    return sorted(r[0] for r in found), total


def salt(key: str, heavy: list, source: Column, salts: int = SALTS) -> Column:
    """0 for light keys, else a stable pseudo-random salt below ``salts``; a null key counts as heavy."""
    hot = F.col(key).isNull() | (F.col(key).isin(*heavy) if heavy else F.lit(False))
    return F.when(hot, F.pmod(F.xxhash64(source), F.lit(salts)).cast("int")).otherwise(0)


def salted_aggregate(
    df: DataFrame,
    key: str,
    spread_by: str,
    partial: dict[str, Column],
    merge: dict[str, Column],
    distinct: dict[str, str] | None = None,
    share: float = HEAVY_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """``partial`` per (key, salt), then ``merge`` per key; ``distinct`` maps result names to columns whose distinct values are counted."""
    heavy, _ = heavy_keys(df, key, spread_by, share)
    return _salted(df, heavy, key, spread_by, partial, merge, distinct, salts)


def _salted(df: DataFrame, heavy: list, key: str, spread_by: str, partial: dict[str, Column], merge: dict[str, Column], distinct: dict[str, str] | None, salts: int) -> DataFrame:
    first = df.withColumn("_salt", salt(key, heavy, F.col(spread_by), salts)).groupBy(key, "_salt").agg(*(c.alias(n) for n, c in partial.items()))
    out = first.groupBy(key).agg(*(c.alias(n) for n, c in merge.items()))
    for name, column in (distinct or {}).items():
        values = df.filter(F.col(column).isNotNull()).select(F.col(key), F.col(column), salt(key, heavy, F.col(column), salts).alias("_salt"))
        counts = values.groupBy(key, "_salt", column).agg(F.lit(1).alias("_one")).groupBy(key, "_salt").agg(F.sum("_one").alias("_n"))
        counts = counts.groupBy(F.col(key).alias("_key")).agg(F.sum("_n").alias(name))
        out = out.join(counts, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint"))
    return out


def keys_above(df: DataFrame, key: str, spread_by: str, share: float) -> DataFrame:
    """Keys that hold more than ``share`` of all rows, from merged salted counts."""
    heavy, total = heavy_keys(df, key, spread_by, min(share, HEAVY_SHARE))
    counts = _salted(df, heavy, key, spread_by, {"n": F.count(F.lit(1))}, {"n": F.sum("n")}, None, SALTS)
    return counts.filter(F.col(key).isNotNull() & (F.col("n") > F.lit(share * total))).select(key, "n")


def skew_join(left: DataFrame, right: DataFrame, on: str, spread_by: str, heavy: list, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``left`` to ``right``, whose ``on`` is unique, where ``heavy`` keys hold much of ``left``.

    The left rows of a heavy key are spread over ``salts`` tasks and its one
    right row is repeated that often; ``heavy`` must come from a share of the
    rows, so the repetition is bounded.
    """
    if not heavy:
        return left.join(right, on, how)
    hot = F.col(on).isin(*heavy)
    a = left.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.withColumn("_salt", F.explode(copies))
    return a.join(b, [on, "_salt"], how).drop("_salt")
