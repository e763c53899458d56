"""Numbers that reports show: bands, scales, estimates, headlines, checks before a run.

Column expressions without shuffles; unknown stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import fixed

#: Limits of the bands of a mark out of five, and of a sentiment out of 100.
MARK_BANDS, FEELING_BANDS = (4.2, 3.8, 3.4, 3.0), (60.0, 40.0)
EARTH_M, WALK_M_PER_MIN = 6_371_000.0, 80.0
EXPECTED_SHARE, WARN_SHARE, THIN = 0.9, 0.5, 30
CALL_SENTENCES = 20


def mark_band(mark: Column) -> Column:
    """0 for the best band of a mark out of five, 4 for the lowest."""
    out = F.when(mark >= MARK_BANDS[0], 0)
    for i, b in enumerate(MARK_BANDS[1:], 1):
        out = out.when(mark >= b, i)
    return out.when(mark.isNotNull(), len(MARK_BANDS))


def feeling_band(score: Column) -> Column:
    return F.when(score >= FEELING_BANDS[0], "good").when(score >= FEELING_BANDS[1], "even").when(score.isNotNull(), "poor")


def first_sentence(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(text, "^\\s+|\\s+$", ""))
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(bare, "^([^。！？!?]*[。！？!?])", 1), F.lit("")), bare))


def headline(text: Column, most: int = 44) -> Column:
    """The first sentence of a text as it stands, cut to a length."""
    first = first_sentence(text)
    return F.when(F.length(first) <= most, first).otherwise(F.concat(F.rtrim(F.substring(first, 1, most)), F.lit("…")))


def quoted(text: Column, quote: Column) -> Column:
    """Whether a quote stands in a text word for word, white space apart."""
    bare = lambda c: F.regexp_replace(c, "\\s+", "")
    return (bare(quote) != "") & F.contains(bare(text), bare(quote))


def year(text: Column) -> Column:
    """The first year from 1600 to 2099 in a text."""
    return F.nullif(F.regexp_extract(text, "(1[6-9][0-9]{2}|20[0-9]{2})", 1), F.lit("")).cast("int")


def simple_name(name: Column) -> Column:
    """A place's name without what stands in brackets or after a separator."""
    return F.trim(F.regexp_extract(F.regexp_replace(name, "[（(][^）)]*[）)]", ""), "^([^・／/|｜]*)", 1))


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(h))


def walk_minutes(distance: Column) -> Column:
    return F.ceil(distance / WALK_M_PER_MIN).cast("int")


def min_max(rows: DataFrame, value: str, key: str | None = None) -> DataFrame:
    """Adds ``scaled``: the value between its group's least (0) and greatest (1); 0 where all are equal."""
    w = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("scaled", fixed(F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0)), 4))


def axis_top(value: Column) -> Column:
    """The least top of an axis that has two to five steps of 1, 2, 2.5 or 5 times a power of ten and holds the value."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(value, F.lit(1e-9)))) - 1)
    tops = [power * s * 10.0**p * n for p in (0, 1) for s in (1.0, 2.0, 2.5, 5.0) for n in (2, 3, 4, 5)]
    fit = F.array_min(F.filter(F.array(*tops), lambda t: t >= value - 1e-9))
    return F.when(value > 0, fit).when(value.isNotNull(), F.lit(1.0))


def model_calls(sentences: Column) -> Column:
    return F.ceil(sentences / CALL_SENTENCES).cast("int")


def checks(rows: DataFrame) -> DataFrame:
    """Checks before a facility is analysed, as rows (facility_id, check, ok, blocking); rows (facility_id, total, held, usable, remaining).

    A number that is unknown fails no check that would need it.
    """
    expected = F.floor(F.col("total") * EXPECTED_SHARE)
    cells = F.array(
        F.struct(F.lit("has_reviews").alias("check"), (F.col("held") > 0).alias("ok"), F.lit(True).alias("blocking")),
        F.struct(F.lit("enough_usable").alias("check"), (F.col("usable") >= THIN).alias("ok"), F.lit(False).alias("blocking")),
        F.struct(F.lit("collected").alias("check"), F.coalesce(F.col("held") >= F.col("total") * WARN_SHARE, F.lit(True)).alias("ok"), F.lit(False).alias("blocking")),
        F.struct(F.lit("within_quota").alias("check"), F.coalesce(expected - F.col("held") <= F.col("remaining"), F.lit(True)).alias("ok"), F.lit(True).alias("blocking")),
    )
    return rows.select("facility_id", F.explode(cells).alias("c")).select("facility_id", "c.check", "c.ok", "c.blocking")


def fact_hash(*columns: Column) -> Column:
    """A short hash of a row's facts in a canonical order."""
    return F.substring(F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 1, 16)
