"""Reading review exports and score sheets as they come.

An export may be UTF-8 (with or without a byte order mark) or CP932, separated
by tabs or commas, with line breaks inside quoted fields.  The encoding and the
separator of each file are told from all of its bytes, the columns are all text, and
empty cells are empty strings.  A score sheet is wide (a column for each
metric) or long (entity, metric, value); its roles are inferred from shares of
numeric cells, made in one aggregation.

Defined results: an empty file gives an empty table; unknown bytes become
U+FFFD; columns an export lacks are simply absent.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Headings that name a place, an axis or a value in score sheets.
PLACE_HINTS = ("施設名", "施設", "name", "facility", "place")
AXIS_HINTS = ("指標", "項目", "軸", "axis", "metric", "item")
VALUE_HINTS = ("値", "スコア", "点数", "得点", "value", "score")
SCALES = (5.0, 10.0, 100.0)
NUMERIC_SHARE = 0.6


def sniff(content: bytes) -> tuple[str, str]:
    """(encoding, separator) of a file, from all of its bytes: UTF-8 if they are that throughout, else CP932 if they are, else UTF-8."""
    encoding = "UTF-8"
    if not content.startswith(codecs.BOM_UTF8):
        for name, label in (("utf-8", "UTF-8"), ("cp932", "CP932")):
            try:
                content.decode(name)
                encoding = label
                break
            except UnicodeDecodeError:
                continue
    first = content.split(b"\n", 1)[0].decode("cp932" if encoding != "UTF-8" else "utf-8", "replace").lstrip("﻿")
    return encoding, "\t" if first.count("\t") >= first.count(",") and "\t" in first else ","


def _notations(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(file, encoding, separator) of every file of a path, each told by one task from the whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *sniff(bytes(c))) for p, c in zip(b["path"], b["content"])], columns=["path", "encoding", "separator"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, encoding string, separator string")
    return [tuple(r) for r in found.orderBy("path").collect()]  # a row for each file


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """All files of an export as text columns, each file in its own notation; columns that a file lacks are empty."""
    kinds: dict[tuple[str, str], list[str]] = {}
    for file, encoding, separator in _notations(spark, path):
        kinds.setdefault((encoding, separator), []).append(file)
    parts = []
    for (encoding, separator), files in sorted(kinds.items()):
        if encoding == "UTF-8":
            df = spark.read.option("multiLine", True).option("escape", '"').option("quote", '"').csv(files, sep=separator, header=True, encoding=encoding, inferSchema=False, ignoreLeadingWhiteSpace=False)
            parts.append(df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿").strip()) for c in df.columns)))
        else:
            parts.append(_read_encoded(spark, files, separator))
    if not parts:
        return spark.createDataFrame([], "row string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.na.fill("") if len(parts) > 1 else out


def _read_encoded(spark: SparkSession, files: list[str], separator: str) -> DataFrame:
    """Files in CP932, which the CSV reader doesn't know: one task decodes and parses each file, as such files can't be split anyway."""

    def parsed(content: bytes) -> list[list[str]]:
        return list(csv.reader(io.StringIO(bytes(content).decode("cp932", "replace"), newline=""), delimiter=separator))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(c.strip(),) for content in b["content"] for c in next(iter(parsed(content)), [])], columns=["c"])

    held = spark.read.format("binaryFile").load(files).select("content")
    columns = [r["c"] for r in held.mapInPandas(heads, "c string").distinct().orderBy("c").collect() if r["c"]]
    if not columns:
        return spark.createDataFrame([], "row string")
    schema = ", ".join(f"`{c}` string" for c in columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                head, *rows = parsed(content) or [[]]
                head = [c.strip() for c in head]
                frame = pd.DataFrame([(r + [""] * len(head))[: len(head)] for r in rows if r], columns=head)
                yield frame.reindex(columns=columns, fill_value="")

    return held.mapInPandas(run, schema)


def _number(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.trim(c).try_cast("double"))


def sheet_roles(sheet: DataFrame) -> dict:
    """How a score sheet is laid out: {'layout', 'place', 'metrics' or 'axis' and 'value', 'scale'}.

    A column is numeric if most of its filled cells are numbers.  The sheet is
    long if it has a column of axes, a column of values and no other numbers.
    The scale is the smallest usual one that holds the greatest value.
    """
    cells = []
    for i, c in enumerate(sheet.columns):
        v = F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
        cells += [F.count(v).alias(f"n{i}"), F.count(_number(v)).alias(f"k{i}"), F.max(_number(v)).alias(f"m{i}")]
    found = sheet.agg(*cells).first()
    numeric = [c for i, c in enumerate(sheet.columns) if found[f"n{i}"] and found[f"k{i}"] >= NUMERIC_SHARE * found[f"n{i}"]]
    texts = [c for i, c in enumerate(sheet.columns) if found[f"n{i}"] and c not in numeric]
    hinted = lambda cs, hints: next((c for c in cs for h in hints if h in c.lower()), None)
    place = hinted(texts, PLACE_HINTS) or (texts[0] if texts else None)
    top = max((found[f"m{i}"] for i, c in enumerate(sheet.columns) if c in numeric), default=None)
    scale = None if top is None else next((s for s in SCALES if top <= s), top)
    axis, value = hinted([c for c in texts if c != place], AXIS_HINTS), hinted(numeric, VALUE_HINTS)
    if axis and value and len(numeric) == 1:
        return {"layout": "long", "place": place, "axis": axis, "value": value, "scale": scale}
    return {"layout": "wide", "place": place, "metrics": numeric, "scale": scale}


def sheet_scores(sheet: DataFrame, roles: dict) -> DataFrame:
    """(place, metric, value, scale) of every readable cell of a sheet, however it is laid out."""
    place = F.trim(F.col(f"`{roles['place']}`")).alias("place")
    scale = F.lit(roles["scale"]).cast("double").alias("scale")
    if roles["layout"] == "long":
        rows = sheet.select(place, F.trim(F.col(f"`{roles['axis']}`")).alias("metric"), _number(F.col(f"`{roles['value']}`").cast("string")).alias("value"), scale)
    else:
        cells = F.array(*(F.struct(F.lit(m).alias("metric"), _number(F.col(f"`{m}`").cast("string")).alias("value")) for m in roles["metrics"]))
        rows = sheet.select(place, scale, F.explode(cells).alias("c")).select("place", "c.metric", "c.value", "scale")
    return rows.filter("place <> '' and metric <> '' and value is not null")
