"""Ratings and their series: per-facility statistics, monthly series, change points, ranks.

Nulls are left out of means as SQL does; reviews whose date is in no ISO
notation have no month and appear in no series; ties go to the smaller key.
Facilities are aggregated map-side before the shuffle, so skew costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import fixed, month_of

POSITIVE_FROM, NEGATIVE_TO = 4.0, 2.0
BASELINE_MONTHS, LEAST_REVIEWS, LEAST_DELTA, MOST_POINTS = 3, 3, 0.05, 3


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def facility_stats(facility: DataFrame, review: DataFrame) -> DataFrame:
    """Per facility: reviews, texts, mean rating, first and last month, and what can be analysed."""
    r = review.select("facility_id", "rating", "text", month_of(F.col("review_date")).alias("ym"))
    agg = r.groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(has_text(F.col("text")), 1)).alias("texts"), F.sum("rating").alias("stars"),
        F.count("rating").alias("rated"), F.min("ym").alias("first_month"), F.max("ym").alias("last_month"),
    )
    n, texts = F.coalesce("n", F.lit(0)), F.coalesce("texts", F.lit(0))
    return facility.join(agg, facility["id"] == agg["facility_id"], "left").select(
        facility["id"].alias("facility_id"), n.alias("n_reviews"), texts.alias("n_texts"), fixed(F.try_divide("stars", "rated"), 6).alias("avg_rating"),
        "first_month", "last_month", (n >= 1).alias("can_analyze"), (texts >= 3).alias("can_tfidf"), (F.coalesce("rated", F.lit(0)) >= 1).alias("can_score"),
    )


def monthly_sentiment(review: DataFrame) -> DataFrame:
    """Per facility and month over rated reviews: number, positive and negative strength, their difference, mean rating.

    A rating counts (rating - 3) / 2; its positive and negative parts are
    averaged over all rated reviews of the month.
    """
    c = (F.col("rating") - 3) / 2
    return (
        review.select("facility_id", "rating", month_of(F.col("review_date")).alias("ym"))
        .filter("ym is not null and rating is not null and facility_id is not null")
        .groupBy("facility_id", "ym")
        .agg(
            F.count(F.lit(1)).alias("n"),
            fixed(F.sum(F.greatest(c, F.lit(0.0))) / F.count(F.lit(1)), 4).alias("pos"),
            fixed(F.sum(F.greatest(-c, F.lit(0.0))) / F.count(F.lit(1)), 4).alias("neg"),
            fixed(F.sum(c) / F.count(F.lit(1)), 4).alias("diff"),
            fixed(F.sum("rating") / F.count(F.lit(1)), 4).alias("avg_rating"),
        )
    )


def monthly_counts(review: DataFrame) -> DataFrame:
    """Per facility and month: reviews, positive, negative and rated ones."""
    r = review.select("facility_id", "rating", month_of(F.col("review_date")).alias("ym")).filter("ym is not null and facility_id is not null")
    return r.groupBy("facility_id", "ym").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("rating") >= POSITIVE_FROM, 1)).alias("n_pos"),
        F.count(F.when(F.col("rating") <= NEGATIVE_TO, 1)).alias("n_neg"),
        F.count("rating").alias("n_rated"),
    )


def cumulative(monthly: DataFrame) -> DataFrame:
    """Running number of reviews of each facility, month by month."""
    w = Window.partitionBy("facility_id").orderBy("ym").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select("facility_id", "ym", "n", F.sum("n").over(w).alias("total"))


def change_candidates(series: DataFrame) -> DataFrame:
    """Months with the change of their mean rating against the mean of the three months before in the series."""
    w = Window.partitionBy("facility_id").orderBy("ym")
    before = w.rowsBetween(-BASELINE_MONTHS, -1)
    rows = series.select(
        "facility_id", "ym", "n", (F.row_number().over(w) - 1).alias("idx"), F.sum("n").over(before).alias("n_before"),
        (F.col("avg_rating") - F.sum("avg_rating").over(before) / BASELINE_MONTHS).alias("change"),
    )
    found = rows.filter((F.col("idx") >= BASELINE_MONTHS) & (F.col("n") >= LEAST_REVIEWS) & (F.col("n_before") >= LEAST_REVIEWS))
    return found.select("facility_id", "ym", "idx", "n", fixed(F.col("change"), 2).alias("delta"))


def change_points(candidates: DataFrame) -> DataFrame:
    """The largest changes of each facility, no two in neighbouring months; a facility has a bounded number of months."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.abs("delta")).alias("order"), "idx", "ym", "n", "delta")))
    sound = candidates.filter(F.abs("delta") >= LEAST_DELTA).groupBy("facility_id").agg(ordered.alias("rows"))
    none = F.slice("rows", 1, 0)
    picked = F.aggregate("rows", none, lambda acc, x: F.when((F.size(acc) < MOST_POINTS) & ~F.exists(acc, lambda p: F.abs(p["idx"] - x["idx"]) < 2), F.concat(acc, F.array(x))).otherwise(acc))
    return (
        sound.select("facility_id", F.explode(picked).alias("p"))
        .select("facility_id", "p.ym", "p.n", "p.delta", F.when(F.col("p.delta") >= 0, "up").otherwise("down").alias("direction"))
    )


def positive_rate(review: DataFrame) -> DataFrame:
    """Share of ratings of four or more among rated reviews, in whole percent."""
    return (
        review.filter("rating is not null and facility_id is not null").groupBy("facility_id")
        .agg(F.count(F.when(F.col("rating") >= POSITIVE_FROM, 1)).alias("n_pos"), F.count("rating").alias("n_rated"))
        .withColumn("positive_pct", fixed(100.0 * F.col("n_pos") / F.col("n_rated"), 0).cast("int"))
    )


def rank(scores: DataFrame, value: str, key: str = "facility_id") -> DataFrame:
    """Rank of each row by value, with the share of all ranks in percent; one row per facility is ordered in one task."""
    total = scores.count()
    w = Window.orderBy(F.desc(value), key)
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("top_pct", fixed(100.0 * F.col("rank") / F.lit(float(max(total, 1))), 0).cast("int")).withColumn("n_total", F.lit(total).cast("bigint"))
