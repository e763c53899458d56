"""Queries on what reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.columns import fixed, fixed_sql
from ..operators import presentation as p
from ..operators import search
from ..sources.tables import table
from .comparison import _M, matrix
from .ratings import SQL as _RATING_SQL
from .ratings import facility_rank, monthly_counts, rating_series
from .texts import SQL as _TEXT_SQL
from .texts import _T, _texts, funnel

QUOTA = 50


def heat_bands(spark: SparkSession, folder: str) -> DataFrame:
    m = matrix(spark, folder)
    return m.select("facility_id", "metric", p.mark_band(F.col("score") / 20).alias("band"), p.feeling_band(F.col("score")).alias("feeling"))


def headlines(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, "id").select("id", p.headline(F.col("text")).alias("headline"))


def quote_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each text's first sentence, and the same with a mark added, stand in it word for word."""
    t = _texts(spark, folder, "id").withColumn("q", p.first_sentence(F.col("text")))
    return t.select("id", p.quoted(F.col("text"), F.col("q")).alias("own"), p.quoted(F.col("text"), F.concat("q", F.lit("§"))).alias("changed"))


def years_in_values(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "score").select("id", p.year(F.col("value")).alias("year"))
    return s.filter("year is not null")


def simple_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facility").select("id", p.simple_name(F.col("name")).alias("name"))


def bubble_scales(spark: SparkSession, folder: str) -> DataFrame:
    return p.min_max(matrix(spark, folder).select("facility_id", "metric", "score"), "score", "metric")


def axis_tops(spark: SparkSession, folder: str) -> DataFrame:
    m = monthly_counts(spark, folder).groupBy("facility_id").agg(F.max("n").alias("most"))
    return m.select("facility_id", "most", fixed(p.axis_top(F.col("most").cast("double")), 4).alias("top"))


def preflight(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "facility").select(F.col("id").alias("facility_id"), F.col("total_reviews").alias("total"))
    n = funnel(spark, folder).select("facility_id", F.col("total").alias("held"), "usable")
    rows = f.join(n, "facility_id", "left").select("facility_id", "total", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("usable", F.lit(0)).alias("usable"), F.lit(QUOTA).alias("remaining"))
    return p.checks(rows)


def first_seen_axes(spark: SparkSession, folder: str) -> DataFrame:
    """The first four axes of each facility in the order in which they were seen."""
    r = table(spark, folder, "review").select(F.col("id").alias("review_db_id"), "facility_id")
    s = table(spark, folder, "review_subscore").filter("axis is not null").join(r, "review_db_id").groupBy("facility_id", "axis").agg(F.min("id").alias("first"))
    w = Window.partitionBy("facility_id").orderBy("first")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 4").select("facility_id", "rank", "axis")


def newest_export_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred distinct rows of each place of the export; those of registered targets are all kept."""
    from .ingest import _export

    e = _export(spark, folder).select("row_no", "facility_key", "facility_name", "text", "review_date", "reviewer_name")
    targets = table(spark, folder, "facility").filter("ftype = 'target'").select(F.col("name").alias("facility_name"), F.lit(True).alias("is_target"))
    once = e.groupBy("facility_key", "facility_name", "text", "review_date", "reviewer_name").agg(F.min("row_no").alias("row_no")).join(targets, "facility_name", "left")
    w = Window.partitionBy("facility_key").orderBy("row_no")
    return once.withColumn("k", F.row_number().over(w)).filter("k <= 100 or is_target").select("row_no", "facility_key")


def bundle_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The head of each facility's report: rank, share of positives, reviews, last month's number."""
    from .ratings import positive_rate

    last = monthly_counts(spark, folder).groupBy("facility_id").agg(F.max(F.struct("ym", "n")).alias("l"))
    f = table(spark, folder, "facility").select(F.col("id").alias("facility_id"), "name")
    rows = f.join(facility_rank(spark, folder), "facility_id", "left").join(positive_rate(spark, folder).select("facility_id", "positive_pct"), "facility_id", "left").join(last, "facility_id", "left")
    return rows.select("facility_id", "name", "score", "rank", "top_pct", "positive_pct", F.col("l.ym").alias("last_month"), F.col("l.n").alias("last_n"))


def suggest_names(spark: SparkSession, folder: str) -> DataFrame:
    """The five names nearest to the name of every facility whose id is divisible by 50."""
    f = table(spark, folder, "facility").select("id", "name")
    return search.suggest(f.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "name"), f).select("query_id", "rank", "id", F.round("ratio", 6).alias("ratio"))


QUERIES = {f.__name__: f for f in (
    heat_bands, headlines, quote_checks, years_in_values, simple_names, bubble_scales, axis_tops, preflight, first_seen_axes, newest_export_rows, bundle_summary, suggest_names,
)}

_BARE = "trim(regexp_replace(text, '^[ \\t\\r\\n\\f\\x0B]+|[ \\t\\r\\n\\f\\x0B]+$', '', 'g'), ' ')"
_FIRST = f"trim(coalesce(nullif(regexp_extract({_BARE}, '^([^。！？!?]*[。！？!?])', 1), ''), {_BARE}), ' ')"
_NOSPACE = lambda c: f"regexp_replace({c}, '[ \\t\\r\\n\\f\\x0B]+', '', 'g')"
_TOPS = ", ".join(f"power * {s}::DOUBLE * {10.0**q}::DOUBLE * {n}" for q in (0, 1) for s in (1.0, 2.0, 2.5, 5.0) for n in (2, 3, 4, 5))
from .ingest import _RECORDS  # noqa: E402

SQL = {
    "heat_bands": f"SELECT facility_id, metric, CASE WHEN score / 20 >= 4.2::DOUBLE THEN 0 WHEN score / 20 >= 3.8::DOUBLE THEN 1 WHEN score / 20 >= 3.4::DOUBLE THEN 2 WHEN score / 20 >= 3.0::DOUBLE THEN 3 ELSE 4 END AS band, CASE WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'even' ELSE 'poor' END AS feeling FROM ({_M})",
    "headlines": f"SELECT id, CASE WHEN length(f) <= 44 THEN f ELSE rtrim(left(f, 44), ' ') || '…' END AS headline FROM (SELECT id, {_FIRST} AS f FROM {_T})",
    "quote_checks": f"SELECT id, {_NOSPACE('q')} <> '' AND contains({_NOSPACE('text')}, {_NOSPACE('q')}) AS own, contains({_NOSPACE('text')}, {_NOSPACE('q')} || '§') AS changed FROM (SELECT id, text, {_FIRST} AS q FROM {_T})",
    "years_in_values": "SELECT id, try_cast(nullif(regexp_extract(value, '(1[6-9][0-9]{2}|20[0-9]{2})', 1), '') AS INT) AS year FROM score WHERE regexp_extract(value, '(1[6-9][0-9]{2}|20[0-9]{2})', 1) <> ''",
    "simple_names": "SELECT id, trim(regexp_extract(regexp_replace(name, '[（(][^）)]*[）)]', '', 'g'), '^([^・／/|｜]*)', 1), ' ') AS name FROM facility",
    "bubble_scales": f"SELECT facility_id, metric, score, {fixed_sql('coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0.0::DOUBLE)', 4)} AS scaled FROM ({_M}) WINDOW w AS (PARTITION BY metric)",
    "axis_tops": f"SELECT facility_id, most, {fixed_sql('list_min(list_filter([' + _TOPS + '], lambda t: t >= most - 1e-9))', 4)} AS top FROM (SELECT *, pow(10.0::DOUBLE, floor(log10(most)) - 1) AS power FROM (SELECT facility_id, max(n) AS most FROM ({_RATING_SQL['monthly_counts']}) GROUP BY 1))",
    "preflight": f"""WITH r AS (SELECT f.id AS facility_id, f.total_reviews AS total, coalesce(u.total, 0) AS held, coalesce(u.usable, 0) AS usable FROM facility f LEFT JOIN ({_TEXT_SQL['funnel']}) u ON u.facility_id = f.id)
        SELECT facility_id, 'has_reviews' AS "check", held > 0 AS ok, true AS blocking FROM r UNION ALL SELECT facility_id, 'enough_usable', usable >= 30, false FROM r
        UNION ALL SELECT facility_id, 'collected', coalesce(held >= total * 0.5, true), false FROM r UNION ALL SELECT facility_id, 'within_quota', coalesce(floor(total * 0.9::DOUBLE) - held <= {QUOTA}, true), true FROM r""",
    "first_seen_axes": """SELECT facility_id, CAST(rank AS INT) AS rank, axis FROM (SELECT facility_id, axis, row_number() OVER (PARTITION BY facility_id ORDER BY first) AS rank FROM (
        SELECT r.facility_id, s.axis, min(s.id) AS first FROM review_subscore s JOIN review r ON r.id = s.review_db_id WHERE s.axis IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 4""",
    "newest_export_rows": f"""SELECT row_no, facility_key FROM (SELECT *, row_number() OVER (PARTITION BY facility_key ORDER BY row_no) AS k FROM (
        SELECT facility_key, facility_name, min(row_no) AS row_no FROM {_RECORDS} GROUP BY facility_key, facility_name, text, review_date, reviewer_name)) WHERE k <= 100 OR facility_name IN (SELECT name FROM facility WHERE ftype = 'target')""",
    "bundle_summary": f"""SELECT f.id AS facility_id, f.name, k.score, k.rank, k.top_pct, p.positive_pct, l.last_month, l.last_n FROM facility f LEFT JOIN ({_RATING_SQL['facility_rank']}) k ON k.facility_id = f.id LEFT JOIN ({_RATING_SQL['positive_rate']}) p ON p.facility_id = f.id
        LEFT JOIN (SELECT facility_id, max(ym) AS last_month, arg_max(n, ym) AS last_n FROM ({_RATING_SQL['monthly_counts']}) GROUP BY 1) l ON l.facility_id = f.id""",
}
