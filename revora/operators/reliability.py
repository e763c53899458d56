"""How far numbers can be trusted: intervals, flags, coverage.

Undefined stays null: an interval needs two values, a rate needs a known
denominator; an unknown number is never read as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import fixed

Z95 = 1.96
SMALL, FOREIGN_SHARE, SHORT_SHARE, WIDE = 30, 0.10, 0.15, 0.5
#: Two-sided 95 % points of Student's t for 1 to 10 degrees of freedom.
T_SMALL = (12.7062, 4.30265, 3.18245, 2.77645, 2.57058, 2.44691, 2.36462, 2.306, 2.26216, 2.22814)
_Z = 1.959963985
#: Coefficients in powers of 1/df of the expansion of t about the normal point.
_EXPANSION = (
    (_Z**3 + _Z) / 4,
    (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96,
    (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384,
    (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160,
)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of a share k / n; (0, 1) for n = 0."""
    nn = F.nullif(n, F.lit(0)).cast("double")
    p, d = k / nn, 1 + z * z / nn
    centre = (p + z * z / (2 * nn)) / d
    half = z / d * F.sqrt(p * (1 - p) / nn + z * z / (4 * nn * nn))
    return F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))


def t_point(df: Column) -> Column:
    """Two-sided 95 % point of Student's t: exact for few degrees of freedom, else by expansion."""
    terms = F.lit(_Z)
    for i, c in enumerate(_EXPANSION, 1):
        terms = terms + F.lit(c) / F.pow(df.cast("double"), F.lit(float(i)))
    return F.when(df <= len(T_SMALL), F.element_at(F.array(*map(F.lit, T_SMALL)), F.least(df, F.lit(len(T_SMALL))).cast("int"))).otherwise(terms)


def mean_interval(rated: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, lo, hi) of every key with two values or more; from sums of squares about the whole mean, in one pass."""
    agg = rated.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    half = t_point(F.col("n") - 1) * F.col("sd") / F.sqrt(F.col("n"))
    return agg.filter("n >= 2").select(key, "n", fixed(F.col("m"), 5).alias("mean"), fixed(F.col("m") - half, 5).alias("lo"), fixed(F.col("m") + half, 5).alias("hi"))


def flags(funnel: DataFrame, interval: DataFrame) -> DataFrame:
    """(facility_id, flag, level) of every reason not to take a facility's numbers at face value."""
    rows = funnel.join(interval.select("facility_id", "lo", "hi"), "facility_id", "left")
    share = lambda c: F.try_divide(F.col(c), F.col("total"))
    found = F.array(
        F.when(F.col("usable") < SMALL, F.struct(F.lit("small_n").alias("flag"), F.lit("warn").alias("level"))),
        F.when(share("foreign_texts") > FOREIGN_SHARE, F.struct(F.lit("foreign").alias("flag"), F.lit("warn").alias("level"))),
        F.when(share("short") > SHORT_SHARE, F.struct(F.lit("short").alias("flag"), F.lit("note").alias("level"))),
        F.when(F.col("hi") - F.col("lo") > WIDE, F.struct(F.lit("wide_interval").alias("flag"), F.lit("note").alias("level"))),
    )
    return rows.select("facility_id", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select("facility_id", "f.flag", "f.level")


def coverage(facility: DataFrame, funnel: DataFrame) -> DataFrame:
    """Per facility: the number known to exist, held and usable, their rates and what is missing."""
    rows = facility.join(funnel.select("facility_id", "total", "usable"), "facility_id", "left").withColumns({"held": F.coalesce("total", F.lit(0)), "fit": F.coalesce("usable", F.lit(0))})
    known = F.nullif("total_reviews", F.lit(0))
    return rows.select(
        "facility_id", "total_reviews", "held", F.col("fit").alias("usable"), fixed(F.col("held") / known, 6).alias("held_rate"), fixed(F.col("fit") / known, 6).alias("usable_rate"),
        F.when(F.col("total_reviews").isNotNull(), F.greatest(F.lit(0), F.col("total_reviews") - F.col("held"))).alias("missing"),
    )
