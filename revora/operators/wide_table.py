"""Attribute-value rows into wide tables, as a log-structured store.

Every batch of rows becomes a sparse wide delta: one row per entity with a
(version, value) cell for each attribute the batch speaks of, written as a run
sorted by entity.  Compaction merges runs of one tier into a run of the next
and takes, cell by cell, the latest version; a new batch reads its own rows and
the runs it is merged with, nothing else.  All steps are the same associative
maximum, so a delta is built map-side before the shuffle and an entity that
holds a third of all rows arrives as one row per task, not as its rows.

Defined results: rows without an entity, a known attribute or a readable value
fill no cell; of repeated versions of one cell the largest value counts; an
empty input gives an empty wide table with all columns.
"""

from __future__ import annotations

import json
import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Notations of a flag.
TRUE_WORDS = ("true", "yes", "y", "t", "1", "1.0", "on", "○", "〇", "◯", "有", "有り", "あり")
FALSE_WORDS = ("false", "no", "n", "f", "0", "0.0", "off", "×", "✕", "無", "無し", "なし")
_WIDE = "０１２３４５６７８９．，／－＋　："
_NARROW = "0123456789.,/-+ :"
#: Spark type that holds each value_type.
CELL_TYPES = {"decimal": "decimal(18,2)", "integer": "bigint", "flag": "boolean", "date": "date"}


def name_key(text: str | None) -> str | None:
    """A name apart from case, width, white space and punctuation."""
    if text is None:
        return None
    return "".join(ch for ch in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()) if unicodedata.category(ch)[0] not in "PSZC")


def attribute_keys(defs: list[tuple[str, str | None, str | None]]) -> dict[str, str]:
    """Every accepted name key -> attribute, for (attr, label_ja, label_en)."""
    keys: dict[str, str] = {}
    for attr, ja, en in sorted(defs, key=lambda d: d[0]):
        forms = [attr, ja, en] + ([ja + en, en + ja] if ja and en else [])
        for form in forms:
            if form and (k := name_key(form)):
                keys.setdefault(k, attr)
    return keys


#: Full width forms and their common ones; half width kana, alone and with a mark of voice.
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_COMMON = "".join(map(chr, range(0x21, 0x7F))) + " "
_KANA = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF66, 0xFF9E)}
_VOICED = {k + m: v for k in _KANA for m in "ﾞﾟ" if len(v := unicodedata.normalize("NFKC", k + m)) == 1}
_DROPPED = r"[\s\p{P}\p{S}\p{Z}\p{C}]"


def name_key_column(name: Column) -> Column:
    """:func:`name_key` of a column, for names in full and half width, as one expression."""
    plain = F.lower(F.translate(name, _FULL, _COMMON))
    kana = plain
    for half, full in _VOICED.items():
        kana = F.replace(kana, F.lit(half), F.lit(full))
    kana = F.translate(kana, "".join(_KANA), "".join(_KANA.values()))
    return F.regexp_replace(F.when(plain.rlike("[ｦ-ﾟ]"), kana).otherwise(plain), _DROPPED, "")


def name_key_sql(name: str) -> str:
    plain = f"lower(translate({name}, '{_FULL.replace(chr(39), chr(39) * 2)}', '{_COMMON.replace(chr(39), chr(39) * 2)}'))"
    kana = plain
    for half, full in _VOICED.items():
        kana = f"replace({kana}, '{half}', '{full}')"
    kana = f"translate({kana}, '{''.join(_KANA)}', '{''.join(_KANA.values())}')"
    return f"regexp_replace({kana}, '{_DROPPED}', '', 'g')"


def with_attribute(rows: DataFrame, name: str, keys: dict[str, str]) -> DataFrame:
    """The rows whose ``name`` belongs to an attribute, which comes as ``attr``; the keys are as few as the definitions."""
    known = rows.sparkSession.createDataFrame(sorted(keys.items()), "_key string, attr string")
    return rows.withColumn("_key", name_key_column(F.col(name))).join(known, "_key").drop("_key")


def typed(value: Column, value_type: str) -> Column:
    """A typed text read as ``value_type``; null where it is unreadable."""
    v = F.trim(F.regexp_replace(F.translate(value.cast("string"), _WIDE, _NARROW), r"\s+", " "))
    if value_type == "decimal":
        number = F.regexp_extract(v, r"^([+-]?[0-9]+(?:[.,][0-9]+)?) ?(?:点|pt|pts|points)? ?(?:/ ?[0-9]+(?:[.,][0-9]+)?)? ?(?:点)?$", 1)
        return F.translate(F.nullif(number, F.lit("")), ",", ".").try_cast(CELL_TYPES["decimal"])
    if value_type == "integer":
        number = F.regexp_extract(v, r"^([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+))(?:\.0+)? ?(?:人|名|年|円|件|回|室|people|visitors)?$", 1)
        return F.translate(F.nullif(number, F.lit("")), ",", "").try_cast("bigint")
    if value_type == "flag":
        low = F.lower(v)
        return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
    if value_type == "date":
        pattern = r"^([0-9]{4})(?:[-/.] ?| ?年 ?)([0-9]{1,2})(?:[-/.] ?| ?月 ?)([0-9]{1,2}) ?日?$"
        plain = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
        iso = F.when(v.rlike(pattern), F.concat_ws("-", *(F.lpad(F.regexp_extract(v, pattern, i), 4 if i == 1 else 2, "0") for i in (1, 2, 3))))
        iso = F.coalesce(iso, F.when(v.rlike(plain), F.concat_ws("-", *(F.regexp_extract(v, plain, i) for i in (1, 2, 3)))))
        return iso.try_cast("date")
    raise ValueError(f"unknown value type: {value_type}")


def decimal_sql(value: str) -> str:
    """The SQL twin of ``typed`` for decimals, as a double."""
    v = f"trim(regexp_replace(translate({value}, '{_WIDE}', '{_NARROW}'), '\\s+', ' ', 'g'), ' ')"
    number = f"regexp_extract({v}, '^([+-]?[0-9]+(?:[.,][0-9]+)?) ?(?:点|pt|pts|points)? ?(?:/ ?[0-9]+(?:[.,][0-9]+)?)? ?(?:点)?$', 1)"
    return f"CAST(try_cast(replace(nullif({number}, ''), ',', '.') AS DECIMAL(18, 2)) AS DOUBLE)"


def cell_text(cell: Column, value_type: str) -> Column:
    """The fixed notation of a typed cell."""
    return F.when(cell.isNotNull(), F.date_format(cell, "yyyy-MM-dd") if value_type == "date" else cell.cast("string"))


def delta(rows: DataFrame, entity: str, attr: str, value: str, version: str, types: dict[str, str], batch: Column | None = None) -> DataFrame:
    """Batches of (entity, attribute, value, version) rows as sparse wide deltas: entity, batch, and a (version, value) cell per attribute."""
    prepared = rows.select(
        F.col(entity).alias("entity_id"),
        (batch if batch is not None else F.lit(0).cast("bigint")).alias("batch"),
        F.col(attr).alias("_attr"),
        F.col(version).cast("bigint").alias("_version"),
        F.col(value).alias("_value"),
    ).filter("entity_id is not null and _attr is not null and _version is not null")
    # each value is read once, as the type of its own attribute
    by_type = {t: F.when(F.col("_attr").isin(*[a for a, x in types.items() if x == t]), typed(F.col("_value"), t)) for t in dict.fromkeys(types.values())}
    prepared = prepared.select("entity_id", "batch", "_attr", "_version", *(c.alias(f"_{t}") for t, c in by_type.items()))
    cells = [F.max(F.when((F.col("_attr") == a) & F.col(f"_{t}").isNotNull(), F.struct(F.col("_version").alias("version"), F.col(f"_{t}").alias("value")))).alias(a) for a, t in types.items()]
    return prepared.groupBy("entity_id", "batch").agg(*cells)


def _merged(deltas: DataFrame, types: dict[str, str]) -> DataFrame:
    return deltas.groupBy("entity_id").agg(*(F.max(a).alias(a) for a in types))


def compact(deltas: DataFrame, types: dict[str, str]) -> DataFrame:
    """Merge sorted runs of deltas: per cell the latest version; one row per entity."""
    merged = _merged(deltas, types)
    return merged.select("entity_id", *(F.col(a)["value"].alias(a) for a in types))


def filled_cells(wide: DataFrame, types: dict[str, str]) -> DataFrame:
    """(entity_id, attr, cell) of every filled cell of a wide table."""
    pairs = F.array(*(F.struct(F.lit(a).alias("attr"), cell_text(F.col(a), t).alias("cell")) for a, t in types.items()))
    return wide.select("entity_id", F.explode(pairs).alias("c")).select("entity_id", "c.attr", "c.cell").filter("cell is not null")


class LogStore:
    """Runs of deltas in a folder that all executors share, with a manifest of those that count.

    ``append`` writes a batch as a run of tier 0.  As soon as FAN runs of a tier
    are there they are merged into one of the next tier, so a cell is rewritten
    only as often as there are tiers.  A manifest is written after its runs
    are complete and names all of them, so a job that fails midway leaves the store
    as it was; replaced runs are removed after that.
    """

    FAN = 4

    def __init__(self, spark: SparkSession, folder: str, types: dict[str, str], entity_type: str = "bigint") -> None:
        self.spark, self.folder, self.types = spark, folder.rstrip("/"), types
        cells = ", ".join(f"`{a}` struct<version: bigint, value: {CELL_TYPES[t]}>" for a, t in types.items())
        self.schema = f"entity_id {entity_type}, {cells}" if types else f"entity_id {entity_type}"
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[str, int]]:
        """(name, tier) of the runs that count."""
        path = self._at(f"{self.folder}/_manifests")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []
        if not names:
            return []
        text = self.spark.read.text(f"{self.folder}/_manifests/{names[-1]}", wholetext=True).first()[0]
        return [tuple(r) for r in json.loads(text)]

    def _write_manifest(self, runs: list[tuple[str, int]]) -> None:
        path = self._at(f"{self.folder}/_manifests")
        n = len(self._fs.listStatus(path)) if self._fs.exists(path) else 0
        out = self._fs.create(self._at(f"{self.folder}/_manifests/{n:012d}"), False)  # fails if another writer came first
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()

    def _write(self, cells: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        cells.sortWithinPartitions("entity_id").write.parquet(f"{self.folder}/{name}")
        return name

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{n}" for n in names))

    def append(self, deltas: DataFrame) -> None:
        """Add one batch of :func:`delta`, and merge the tiers that are full."""
        runs = self.runs() + [(self._write(deltas.select("entity_id", *self.types)), 0)]
        gone: list[str] = []
        tier = 0
        while len(full := [r for r in runs if r[1] == tier]) >= self.FAN:
            merged = self._write(_merged(self._read([n for n, _ in full]), self.types))
            gone += [n for n, _ in full]
            runs = [r for r in runs if r[1] != tier] + [(merged, tier + 1)]
            tier += 1
        self._write_manifest(runs)
        for n in gone:
            self._fs.delete(self._at(f"{self.folder}/{n}"), True)

    def wide(self) -> DataFrame:
        """The wide table: all runs merged, one row per entity with the latest value of each cell."""
        names = [n for n, _ in self.runs()]
        if not names:
            return compact(self.spark.createDataFrame([], self.schema), self.types)
        return compact(self._read(names), self.types)
