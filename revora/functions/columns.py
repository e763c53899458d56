"""Column expressions shared by the metrics, and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def fixed(x: Column, digits: int) -> Column:
    """Rounded half away from zero, by the same arithmetic in every engine."""
    p = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(p) + F.lit(0.5 + 1e-9)) / F.lit(p)


def fixed_sql(x: str, digits: int) -> str:
    p = f"1e{digits}"
    return f"(sign({x}) * floor(abs({x}) * {p} + (0.5 + 1e-9)) / {p})"


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word)))) / F.lit(len(word))


def total_occurrences(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (occurrences(text, w) for w in words))


def total_occurrences_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) / {len(w)}.0" for w in words) + ")"


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def contains_any_sql(text: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({text}, '{'|'.join(words)}')"


def words_present(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text has."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words))


def words_present_sql(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


_ISO_DAY = r"^\d{4}-\d{2}-\d{2}([T ]|$)"
_OFFSET = r"([+-])(\d\d):(\d\d)$"


def utc_time(date: Column) -> Column:
    """An ISO date or date-time text as UTC time without zone; null for other notations."""
    sign = F.when(F.regexp_extract(date, _OFFSET, 1) == "-", -1).otherwise(1)
    part = [F.coalesce(F.nullif(F.regexp_extract(date, _OFFSET, i), F.lit("")).cast("int"), F.lit(0)) * sign for i in (2, 3)]
    base = F.when(date.rlike(_ISO_DAY), F.substring(date, 1, 19)).try_cast("timestamp_ntz")
    return base - F.make_dt_interval(F.lit(0), part[0], part[1], F.lit(0))


def utc_time_sql(date: str) -> str:
    sign = f"(CASE WHEN regexp_extract({date}, '{_OFFSET}', 1) = '-' THEN -1 ELSE 1 END)"
    minutes = " + ".join(f"coalesce(try_cast(regexp_extract({date}, '{_OFFSET}', {i}) AS INT), 0) * {m}" for i, m in ((2, 60), (3, 1)))
    return f"(CASE WHEN regexp_matches({date}, '{_ISO_DAY}') THEN try_cast(left({date}, 19) AS TIMESTAMP) END - to_minutes({sign} * ({minutes})))"


def month_of(date: Column) -> Column:
    return F.date_format(utc_time(date), "yyyy-MM")


def month_sql(date: str) -> str:
    return f"strftime({utc_time_sql(date)}, '%Y-%m')"
