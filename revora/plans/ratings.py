"""Queries on ratings and their series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.columns import fixed, fixed_sql, month_of, month_sql
from ..operators import ratings, wide_table
from ..sources.tables import table


def _rv(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "review").select("facility_id", *columns)


def monthly_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return ratings.monthly_sentiment(_rv(spark, folder, "rating", "review_date"))


def facility_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ratings.facility_stats(table(spark, folder, "facility").select("id"), _rv(spark, folder, "rating", "text", "review_date"))


def facility_overview(spark: SparkSession, folder: str) -> DataFrame:
    """Per facility: reviews, and its metric names in the order of their characters."""
    n = _rv(spark, folder).groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"))
    names = table(spark, folder, "score").groupBy("facility_id").agg(F.array_join(F.array_sort(F.collect_set("metric_name")), ", ").alias("metrics"))
    f = table(spark, folder, "facility").select(F.col("id").alias("facility_id"), "name", "ftype")
    return f.join(n, "facility_id", "left").join(names, "facility_id", "left").select("facility_id", "name", "ftype", F.coalesce("n", F.lit(0)).alias("n_reviews"), F.coalesce("metrics", F.lit("")).alias("metrics"))


def rating_series(spark: SparkSession, folder: str) -> DataFrame:
    """Mean rating of each facility on a scale of 100."""
    r = _rv(spark, folder, "rating").filter("rating is not null and facility_id is not null")
    return r.groupBy("facility_id").agg(fixed(F.sum("rating") / F.count("rating") / 5 * 100, 2).alias("score"))


def subscore_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Mean sub-score of each facility and axis on a scale of 100."""
    r = table(spark, folder, "review").select(F.col("id").alias("review_db_id"), "facility_id")
    s = table(spark, folder, "review_subscore").select("review_db_id", "axis", "value").filter("value is not null")
    return s.join(r, "review_db_id").groupBy("facility_id", "axis").agg(F.count(F.lit(1)).alias("n"), fixed(F.sum("value") / F.count("value") / 5 * 100, 2).alias("score"))


def score_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Scores typed into sheets on a scale of 100: the last readable one of each facility and metric name."""
    s = table(spark, folder, "score").filter("source = 'excel'").select("facility_id", "metric_name", "scale", "id", F.col("value").alias("typed"))
    v = wide_table.typed(F.col("typed"), "decimal").cast("double")
    last = s.withColumn("v", v).filter("v is not null").groupBy("facility_id", "metric_name").agg(F.max(F.struct("id", "v", "scale")).alias("m"))
    return last.select("facility_id", "metric_name", fixed(F.col("m.v") / F.coalesce("m.scale", F.lit(5.0)) * 100, 2).alias("score"))


def positive_rate(spark: SparkSession, folder: str) -> DataFrame:
    return ratings.positive_rate(_rv(spark, folder, "rating"))


def monthly_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ratings.monthly_counts(_rv(spark, folder, "rating", "review_date")).select("facility_id", "ym", "n")


def monthly_pos_neg(spark: SparkSession, folder: str) -> DataFrame:
    return ratings.monthly_counts(_rv(spark, folder, "rating", "review_date")).select("facility_id", "ym", "n_pos", "n_neg", "n_rated")


def cumulative_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return ratings.cumulative(monthly_counts(spark, folder))


def change_point_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return ratings.change_candidates(monthly_sentiment(spark, folder))


def change_points(spark: SparkSession, folder: str) -> DataFrame:
    return ratings.change_points(change_point_candidates(spark, folder))


def facility_rank(spark: SparkSession, folder: str) -> DataFrame:
    return ratings.rank(rating_series(spark, folder), "score")


def facilities_without_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facility").select(F.col("id").alias("facility_id"), "name").join(_rv(spark, folder), "facility_id", "left_anti")


def facilities_without_long_reviews(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "facility").select(F.col("id").alias("facility_id"), "name")
    return f.join(_rv(spark, folder, "text").filter("length(text) > 200").select("facility_id"), "facility_id", "left_anti")


def uncached_facilities(spark: SparkSession, folder: str) -> DataFrame:
    """Facilities whose (facility, number of reviews) is not among results kept; the registered totals stand for those."""
    now = _rv(spark, folder).groupBy("facility_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    kept = table(spark, folder, "facility").select(F.col("id").alias("facility_id"), F.col("total_reviews").alias("n_reviews")).filter("n_reviews is not null")
    return now.join(kept, ["facility_id", "n_reviews"], "left_anti").filter("facility_id is not null")


def longest_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The three longest texts of each facility."""
    r = _rv(spark, folder, "id", F.length("text").alias("chars")).filter("chars > 0 and facility_id is not null")
    w = Window.partitionBy("facility_id").orderBy(F.desc("chars"), "id")
    return r.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("facility_id", "rank", "id", "chars")


def period_label(spark: SparkSession, folder: str) -> DataFrame:
    """First and last month of each facility as one label."""
    r = _rv(spark, folder, month_of(F.col("review_date")).alias("ym")).filter("ym is not null and facility_id is not null")
    label = lambda c: F.concat(F.substring(c, 1, 4), F.lit("/"), F.substring(c, 6, 2).cast("int").cast("string"))
    m = r.groupBy("facility_id").agg(F.min("ym").alias("a"), F.max("ym").alias("b"))
    return m.select("facility_id", F.when(F.col("a") == F.col("b"), label("a")).otherwise(F.concat(label("a"), F.lit("〜"), label("b"))).alias("period"))


def monthly_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the cumulative number of reviews is larger at the end of the last 24 months of each series than at their beginning."""
    w = Window.partitionBy("facility_id").orderBy(F.desc("ym"))
    m = cumulative_reviews(spark, folder).withColumn("back", F.row_number().over(w)).filter("back <= 24")
    agg = m.groupBy("facility_id").agg(F.min_by("total", "ym").alias("first_total"), F.max_by("total", "ym").alias("last_total"))
    return agg.select("*", F.when(F.col("last_total") > F.col("first_total"), "increasing").otherwise("not increasing").alias("trend"))


QUERIES = {f.__name__: f for f in (
    monthly_sentiment, facility_stats, facility_overview, rating_series, subscore_matrix, score_matrix, positive_rate, monthly_counts, monthly_pos_neg,
    cumulative_reviews, change_point_candidates, change_points, facility_rank, facilities_without_reviews, facilities_without_long_reviews, uncached_facilities, longest_reviews, period_label, monthly_trend,
)}

_YM = month_sql("review_date")
_SERIES = f"""
    SELECT facility_id, ym, count(*) AS n, {fixed_sql('sum(greatest(c, 0.0::DOUBLE)) / count(*)', 4)} AS pos, {fixed_sql('sum(greatest(-c, 0.0::DOUBLE)) / count(*)', 4)} AS neg,
           {fixed_sql('sum(c) / count(*)', 4)} AS diff, {fixed_sql('sum(rating) / count(*)', 4)} AS avg_rating
    FROM (SELECT facility_id, rating, (rating - 3) / 2 AS c, {_YM} AS ym FROM review)
    WHERE ym IS NOT NULL AND rating IS NOT NULL AND facility_id IS NOT NULL GROUP BY facility_id, ym"""
_COUNTS = f"""
    SELECT facility_id, ym, count(*) AS n, count(*) FILTER (rating >= 4) AS n_pos, count(*) FILTER (rating <= 2) AS n_neg, count(rating) AS n_rated
    FROM (SELECT facility_id, rating, {_YM} AS ym FROM review) WHERE ym IS NOT NULL AND facility_id IS NOT NULL GROUP BY facility_id, ym"""
_CANDIDATES = f"""
    SELECT facility_id, ym, idx, n, {fixed_sql('change', 2)} AS delta FROM (
        SELECT facility_id, ym, n, CAST(row_number() OVER w - 1 AS INT) AS idx, sum(n) OVER b AS n_before, avg_rating - sum(avg_rating) OVER b / 3 AS change FROM ({_SERIES})
        WINDOW w AS (PARTITION BY facility_id ORDER BY ym), b AS (PARTITION BY facility_id ORDER BY ym ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
    WHERE idx >= 3 AND n >= 3 AND n_before >= 3"""
_RATINGS = f"SELECT facility_id, {fixed_sql('sum(rating) / count(rating) / 5 * 100', 2)} AS score FROM review WHERE rating IS NOT NULL AND facility_id IS NOT NULL GROUP BY facility_id"

SQL = {
    "monthly_sentiment": _SERIES,
    "facility_stats": f"""
        SELECT f.id AS facility_id, count(r.id) AS n_reviews, count(*) FILTER (r.text <> '') AS n_texts, {fixed_sql('sum(r.rating) / count(r.rating)', 6)} AS avg_rating,
               min({month_sql('r.review_date')}) AS first_month, max({month_sql('r.review_date')}) AS last_month,
               count(r.id) >= 1 AS can_analyze, count(*) FILTER (r.text <> '') >= 3 AS can_tfidf, count(r.rating) >= 1 AS can_score
        FROM facility f LEFT JOIN review r ON r.facility_id = f.id GROUP BY f.id""",
    "facility_overview": """
        SELECT f.id AS facility_id, f.name, f.ftype, coalesce(n.n, 0) AS n_reviews, coalesce(m.metrics, '') AS metrics FROM facility f
        LEFT JOIN (SELECT facility_id, count(*) AS n FROM review GROUP BY 1) n ON n.facility_id = f.id
        LEFT JOIN (SELECT facility_id, string_agg(metric_name, ', ' ORDER BY metric_name) AS metrics FROM (SELECT DISTINCT facility_id, metric_name FROM score WHERE metric_name IS NOT NULL) GROUP BY 1) m ON m.facility_id = f.id""",
    "rating_series": _RATINGS,
    "subscore_matrix": f"""
        SELECT r.facility_id, s.axis, count(*) AS n, {fixed_sql('sum(s.value) / count(s.value) / 5 * 100', 2)} AS score
        FROM review_subscore s JOIN review r ON r.id = s.review_db_id WHERE s.value IS NOT NULL GROUP BY 1, 2""",
    "score_matrix": f"""
        SELECT facility_id, metric_name, {fixed_sql('v / coalesce(scale, 5.0::DOUBLE) * 100', 2)} AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY facility_id, metric_name ORDER BY id DESC) AS k FROM (
                SELECT facility_id, metric_name, scale, id, {wide_table.decimal_sql('value')} AS v FROM score WHERE source = 'excel')
            WHERE v IS NOT NULL) WHERE k = 1""",
    "positive_rate": f"""
        SELECT facility_id, count(*) FILTER (rating >= 4) AS n_pos, count(rating) AS n_rated, CAST({fixed_sql('100.0::DOUBLE * (count(*) FILTER (rating >= 4)) / count(rating)', 0)} AS INT) AS positive_pct
        FROM review WHERE rating IS NOT NULL AND facility_id IS NOT NULL GROUP BY facility_id""",
    "monthly_counts": f"SELECT facility_id, ym, n FROM ({_COUNTS})",
    "monthly_pos_neg": f"SELECT facility_id, ym, n_pos, n_neg, n_rated FROM ({_COUNTS})",
    "cumulative_reviews": f"SELECT facility_id, ym, n, CAST(sum(n) OVER (PARTITION BY facility_id ORDER BY ym ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM ({_COUNTS})",
    "change_point_candidates": _CANDIDATES,
    "change_points": f"""
        WITH c AS (SELECT * FROM ({_CANDIDATES}) WHERE abs(delta) >= 0.05),
        p1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY abs(delta) DESC, idx) = 1),
        c2 AS (SELECT c.* FROM c JOIN p1 USING (facility_id) WHERE abs(c.idx - p1.idx) >= 2),
        p2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY abs(delta) DESC, idx) = 1),
        c3 AS (SELECT c2.* FROM c2 JOIN p2 USING (facility_id) WHERE abs(c2.idx - p2.idx) >= 2),
        p3 AS (SELECT * FROM c3 QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY abs(delta) DESC, idx) = 1)
        SELECT facility_id, ym, n, delta, CASE WHEN delta >= 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)""",
    "facility_rank": f"""
        SELECT facility_id, score, CAST(row_number() OVER (ORDER BY score DESC, facility_id) AS INT) AS rank, CAST({fixed_sql('100.0::DOUBLE * row_number() OVER (ORDER BY score DESC, facility_id) / count(*) OVER ()', 0)} AS INT) AS top_pct,
               count(*) OVER () AS n_total FROM ({_RATINGS})""",
    "facilities_without_reviews": "SELECT id AS facility_id, name FROM facility f WHERE NOT EXISTS (SELECT 1 FROM review r WHERE r.facility_id = f.id)",
    "facilities_without_long_reviews": "SELECT id AS facility_id, name FROM facility f WHERE NOT EXISTS (SELECT 1 FROM review r WHERE r.facility_id = f.id AND length(r.text) > 200)",
    "uncached_facilities": """
        SELECT n.* FROM (SELECT facility_id, count(*) AS n_reviews FROM review WHERE facility_id IS NOT NULL GROUP BY 1) n
        WHERE NOT EXISTS (SELECT 1 FROM facility f WHERE f.id = n.facility_id AND f.total_reviews = n.n_reviews)""",
    "longest_reviews": """
        SELECT facility_id, CAST(rank AS INT) AS rank, id, CAST(chars AS INT) AS chars FROM (
            SELECT facility_id, id, length(text) AS chars, row_number() OVER (PARTITION BY facility_id ORDER BY length(text) DESC, id) AS rank FROM review WHERE length(text) > 0 AND facility_id IS NOT NULL) WHERE rank <= 3""",
    "period_label": f"""
        SELECT facility_id, CASE WHEN a = b THEN la ELSE la || '〜' || lb END AS period FROM (
            SELECT facility_id, a, b, left(a, 4) || '/' || CAST(CAST(substr(a, 6, 2) AS INT) AS VARCHAR) AS la, left(b, 4) || '/' || CAST(CAST(substr(b, 6, 2) AS INT) AS VARCHAR) AS lb FROM (
                SELECT facility_id, min(ym) AS a, max(ym) AS b FROM (SELECT facility_id, {_YM} AS ym FROM review) WHERE ym IS NOT NULL AND facility_id IS NOT NULL GROUP BY 1))""",
    "monthly_trend": f"""
        SELECT facility_id, arg_min(total, ym) AS first_total, arg_max(total, ym) AS last_total, CASE WHEN arg_max(total, ym) > arg_min(total, ym) THEN 'increasing' ELSE 'not increasing' END AS trend FROM (
            SELECT facility_id, ym, CAST(sum(n) OVER (PARTITION BY facility_id ORDER BY ym ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, row_number() OVER (PARTITION BY facility_id ORDER BY ym DESC) AS back FROM ({_COUNTS}))
        WHERE back <= 24 GROUP BY 1""",
}
