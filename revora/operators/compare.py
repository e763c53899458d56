"""Comparison of facilities over a long matrix (facility_id, metric, score).

The market's mean includes a facility itself; the mean of others leaves it
out.  Sums and counts per metric are merged with each row, so no facility is
paired with another.  Ties go to the smaller name.  A facility without others
to compare with has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import fixed

LEAST_FACILITIES, LEAST_SPREAD, CENTRE, POINTS_PER_SPREAD = 8, 1.0, 3.0, 0.5
SHOWN, FINDINGS, BADGE, FULL_IMPACT = 5, 3, 0.15, 0.6


def against_others(matrix: DataFrame, peers: Column | None = None) -> DataFrame:
    """Each score with the mean of the other facilities (of those that are ``peers``) and the difference."""
    p = F.lit(True) if peers is None else peers
    w = Window.partitionBy("metric")
    total, n = F.sum(F.when(p, F.col("score"))).over(w), F.sum(p.cast("int")).over(w)
    own = p.cast("int")
    base = F.try_divide(F.coalesce(total, F.lit(0.0)) - F.when(p, F.col("score")).otherwise(0.0), n - own)
    return matrix.withColumn("baseline", fixed(base, 4)).filter("baseline is not null").withColumn("diff", fixed(F.col("score") - F.col("baseline"), 4))


def strengths(compared: DataFrame, n: int = SHOWN) -> DataFrame:
    """The largest differences of zero or more of each facility."""
    w = Window.partitionBy("facility_id").orderBy(F.desc("diff"), "metric")
    return compared.filter("diff >= 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def weaknesses(compared: DataFrame, n: int = SHOWN) -> DataFrame:
    """The smallest differences below zero of each facility."""
    w = Window.partitionBy("facility_id").orderBy("diff", "metric")
    return compared.filter("diff < 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def calibration(matrix: DataFrame) -> DataFrame:
    """Mean and spread (at least LEAST_SPREAD) of each metric over the whole market; none where facilities are too few."""
    s = fixed(F.col("score"), 1)
    agg = matrix.groupBy("metric").agg(F.countDistinct("facility_id").alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"))
    return agg.filter(F.col("n") >= LEAST_FACILITIES).select("metric", "n", fixed(F.col("mean"), 4).alias("mean"), fixed(F.greatest("sd", F.lit(LEAST_SPREAD)), 4).alias("spread"))


def calibrated(matrix: DataFrame) -> DataFrame:
    """Scores by their place in the market: the mean is 3 of 5 points, a spread half a point, on a scale of 100; unchanged where not calibrated."""
    stats = calibration(matrix).select("metric", "mean", "spread")
    z = (fixed(F.col("score"), 1) - F.col("mean")) / F.col("spread")
    five = F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.lit(CENTRE) + z * POINTS_PER_SPREAD))
    return matrix.join(stats, "metric", "left").select("facility_id", "metric", "score", fixed(F.coalesce(five * 20, F.col("score")), 4).alias("calibrated"), F.col("mean").isNotNull().alias("is_calibrated"))


def market_trend(matrix: DataFrame, n: int = SHOWN) -> DataFrame:
    """The metrics with the highest and lowest market means."""
    means = matrix.groupBy("metric").agg(fixed(F.avg("score"), 4).alias("market_mean"))
    good = means.orderBy(F.desc("market_mean"), "metric").limit(n).withColumn("side", F.lit("good"))
    return good.unionByName(means.orderBy("market_mean", "metric").limit(n).withColumn("side", F.lit("bad")))


def win_lose(compared: DataFrame) -> DataFrame:
    return compared.withColumn("side", F.when(F.col("diff") > 0, "win").otherwise("lose"))


def findings(compared: DataFrame) -> DataFrame:
    """Per facility: how many metrics lie above the baseline, and its strongest and weakest, in points of five."""
    d = fixed(F.col("diff") / 20, 2)
    up, down = Window.partitionBy("facility_id").orderBy(F.desc("diff"), "metric"), Window.partitionBy("facility_id").orderBy("diff", "metric")
    rows = compared.withColumns({"gap": d, "above": F.sum((F.col("diff") > 0).cast("int")).over(Window.partitionBy("facility_id")), "from_top": F.row_number().over(up), "from_bottom": F.row_number().over(down)})
    badge = F.when(F.col("gap") >= BADGE, "strong").when(F.col("gap") <= -BADGE, "weak").otherwise("level")
    return rows.filter((F.col("from_top") <= FINDINGS) | (F.col("from_bottom") <= FINDINGS)).select("facility_id", "metric", "gap", "above", (F.col("from_top") <= FINDINGS).alias("is_top"), badge.alias("badge"))


def issues(compared: DataFrame, n: int = FINDINGS) -> DataFrame:
    """The metrics furthest below the baseline, as points of five, with priority and impact."""
    rows = compared.select("facility_id", "metric", fixed(F.col("score") / 20, 2).alias("score5"), fixed(F.col("baseline") / 20, 2).alias("base5"), fixed((F.col("score") - F.col("baseline")) / 20, 2).alias("gap5"))
    w = Window.partitionBy("facility_id").orderBy("gap5", "metric")
    rows = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return rows.select("*", F.when(F.col("rank") == 1, "high").otherwise("medium").alias("priority"), fixed(F.least(F.lit(1.0), F.abs("gap5") / FULL_IMPACT), 4).alias("impact"))
