"""Taking in exports: records, identities, duplicates, upserts, ledgers and budgets.

All steps are set-oriented: what the table holds already is an anti-join,
repeats within a batch are a row number, an upsert writes a new snapshot.
Defined results: empty strings count as missing; of repeated keys the row that
comes first in the file counts; unknown numbers stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import fixed

#: The mark of a substitute id, and the prefectures at which a place's address is cut from its name.
SUBSTITUTE = "h:"
PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県", "東京都", "神奈川県", "新潟県", "富山県",
    "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県", "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県",
    "岡山県", "広島県", "山口県", "徳島県", "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
)


def first_filled(*columns: Column) -> Column:
    """The first of the columns that holds something."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def number(text: Column) -> Column:
    """A typed number, null where it is none."""
    return F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.trim(text).try_cast("double"))


def whole(text: Column) -> Column:
    return F.floor(F.abs(number(text))).cast("bigint") * F.signum(number(text)).cast("bigint")


def name_in_url(url: Column) -> Column:
    """The place a search link asks for, cut at the first prefecture after its beginning, else at its first space."""
    query = F.regexp_replace(F.try_url_decode(F.regexp_extract(url, r"[?&]query=([^&#]*)", 1)), "^[ 　]+|[ 　]+$", "")
    before = F.regexp_extract(query, f"^(.+?)[ 　,、]*(?:{'|'.join(PREFECTURES)})", 1)
    return F.coalesce(F.nullif(before, F.lit("")), F.regexp_extract(query, "^([^ 　]*)", 1))


def url_in_input(cell: Column) -> Column:
    """The link of an ``input`` cell, a record in Python or JSON notation; empty where there is none or the record is cut off."""
    return F.regexp_extract(cell, r"""(?s)^\s*\{.*?['"]url['"]\s*:\s*['"]([^'"]*)['"].*\}\s*$""", 1)


def map_link(cell: Column) -> dict[str, Column]:
    """What a map link tells of its place: name, coordinates, ids; empty or null where it tells nothing."""
    part = lambda p: F.regexp_extract(cell, p, 1)
    some = lambda a, b: F.nullif(F.coalesce(F.nullif(part(a), F.lit("")), part(b)), F.lit("")).try_cast("double")
    n = "-?[0-9]+[.]?[0-9]*"
    return {
        "name": part("/maps/place/([^/@?]+)"), "lat": some(f"!8m2!3d({n})!4d", f"/@({n}),-?[0-9]"), "lng": some(f"!8m2!3d{n}!4d({n})", f"/@{n},({n})"),
        "fid": part("(0x[0-9a-f]+:0x[0-9a-f]+)"), "mid": part("!16s([^!?&]+)"), "place_id": part("place_id:([A-Za-z0-9_-]+)"), "short": cell.rlike("^https?://([a-z.]*[.])?goo[.]gl/"),
    }


def records(export: DataFrame) -> DataFrame:
    """An export's rows as reviews: rows of failed scrapes, and with neither text nor rating, are left out."""
    c = lambda n: F.coalesce(n, F.lit(""))
    name = first_filled(F.col("place_name"), name_in_url(first_filled(url_in_input(c("input")), F.col("url"))))
    key = first_filled(F.col("place_id"), F.col("cid"), name, F.lit("(unknown)"))
    rows = export.filter((c("error") == "") & (c("error_code") == "")).filter((c("review") != "") | (c("review_rating") != ""))
    return rows.select(
        "row_no", key.alias("facility_key"), name.alias("facility_name"), c("review_id").alias("review_id"), number(c("review_rating")).alias("rating"), c("review").alias("text"), c("review_date").alias("review_date"),
        c("reviewer_name").alias("reviewer_name"), F.lower(c("local_guide")).isin("true", "1", "yes").cast("int").alias("local_guide"), whole(c("number_of_likes")).alias("likes"),
        number(c("place_general_rating")).alias("general_rating"), whole(c("overall_place_riviews")).alias("total_reviews"), c("category").alias("category"),
    )


def infer_facilities(found: DataFrame) -> DataFrame:
    """The facilities of an export: the commonest name of each key (of equals the one seen first), reviews, mean rating, and the first known of its facts."""
    names = found.filter("facility_name <> ''").groupBy("facility_key", "facility_name").agg(F.count(F.lit(1)).alias("k"), F.min("row_no").alias("first"))
    best = names.groupBy("facility_key").agg(F.max(F.struct("k", (-F.col("first")).alias("o"), "facility_name"))["facility_name"].alias("name"))
    known = lambda c, ok: F.min_by(c, F.when(ok, F.col("row_no")))
    agg = found.groupBy("facility_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("stars"), F.count("rating").alias("rated"), known("general_rating", F.col("general_rating").isNotNull()).alias("general_rating"),
        known("total_reviews", F.col("total_reviews").isNotNull()).alias("total_reviews"), known("category", F.col("category") != "").alias("category"),
    )
    return agg.join(best, "facility_key", "left").withColumn("name", F.coalesce("name", F.lit("(unknown)")))


def substitute_id(text: Column, date: Column, reviewer: Column) -> Column:
    return F.concat(F.lit(SUBSTITUTE), F.substring(F.sha1(F.concat_ws("|", text, date, reviewer)), 1, 16))


def known_or_substitute() -> Column:
    """A held review's id, or its substitute where it has none."""
    c = lambda n: F.coalesce(n, F.lit(""))
    return F.coalesce(F.nullif("review_id", F.lit("")), substitute_id(c("text"), c("review_date"), c("reviewer_name"))).alias("review_id")


def with_ids(found: DataFrame) -> DataFrame:
    """Reviews without an id get a substitute; the second and later of one substitute in a facility get ``#2`` and so on."""
    made = F.when(F.col("review_id") != "", F.col("review_id")).otherwise(substitute_id(F.col("text"), F.col("review_date"), F.col("reviewer_name")))
    rows = found.withColumn("review_id", made)
    nth = F.row_number().over(Window.partitionBy("facility_key", "review_id").orderBy("row_no"))
    rows = rows.withColumn("_n", nth)
    return rows.withColumn("review_id", F.when((F.col("_n") > 1) & F.col("review_id").startswith(SUBSTITUTE), F.concat("review_id", F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col("review_id"))).drop("_n")


def new_rows(batch: DataFrame, held: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of a batch to insert: the first of each key, unless the table holds it."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return first.join(held.select(*keys).distinct(), keys, "left_anti")


def upsert(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A new snapshot: each column's new value where there is one, else the old."""
    columns = [c for c in held.columns if c != key]
    a, b = held.alias("a"), new.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in columns))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key; of equal versions the greatest."""
    rest = [c for c in rows.columns if c not in keys and c != version]
    return rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_m")).select(*keys, "_m.*")


def without(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """What is left of a child table when parents are deleted."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def newest(rows: DataFrame, key: str, order: Column, most: int, tie: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order.desc_nulls_last(), tie)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def budgeted(available: DataFrame, budget: int) -> DataFrame:
    """What a sync of datasets (dataset, n), in their order, may fetch within a budget.

    The dataset at which the budget runs out is truncated and keeps its
    watermark; later ones are not fetched.  Datasets are few and ordered in one
    task.
    """
    w = Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.sum("n").over(w), F.lit(0)))
    rows = available.withColumn("left", left).withColumn("fetched", F.least("n", "left"))
    return rows.select("dataset", "n", "fetched", ((F.col("fetched") < F.col("n")) & (F.col("left") > 0)).alias("truncated"), (F.col("fetched") == F.col("n")).alias("advances"))


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: filled cells and their share, distinct values, numbers with mean, least and greatest; all in one pass per stage."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))
    cells = rows.select(F.explode(pairs).alias("p")).select("p.column", F.nullif(F.trim("p.v"), F.lit("")).alias("v"))
    counted = cells.groupBy("column", "v").agg(F.count(F.lit(1)).alias("k"))  # repeated values collapse before anything else
    x = number(F.col("v"))
    agg = counted.groupBy("column").agg(
        F.sum("k").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("k"))), F.lit(0)).alias("filled"), F.count("v").alias("n_distinct"),
        F.coalesce(F.sum(F.when(x.isNotNull(), F.col("k"))), F.lit(0)).alias("numbers"), F.sum(x * F.col("k")).alias("total"), F.min(x).alias("least"), F.max(x).alias("greatest"),
    )
    numeric = F.col("numbers") > F.greatest(F.col("rows") * 0.3, F.lit(1.0))
    show = lambda c: F.when(numeric, c)
    return agg.select("column", "filled", fixed(100.0 * F.col("filled") / F.col("rows"), 1).alias("filled_pct"), "n_distinct", numeric.alias("numeric"), show(fixed(F.col("total") / F.col("numbers"), 2)).alias("mean"), show(F.col("least")).alias("least"), show(F.col("greatest")).alias("greatest"))
