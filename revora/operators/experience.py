"""Indices of experience: fit of visitors to a facility's aim, and the phase-weighted experience index.

Unknown is not zero: a feature that is null is left out of means and fits, a
zero vector fits nothing rather than badly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicons
from ..functions.columns import fixed, words_present

FIT_FROM, SATISFIED_FROM, LEAST_DIMENSIONS = 0.70, 0.60, 3


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def element_counts(reviews: DataFrame) -> DataFrame:
    """Adds x0 to x11: how many words of each element of experience a text has."""
    return reviews.withColumns({f"x{i}": words_present(F.col("text"), ws).cast("double") for i, ws in enumerate(lexicons.EXPERIENCE.values())})


def targets(counted: DataFrame) -> DataFrame:
    """Per facility t0 to t11: the mean element counts of highly rated reviews, or of all where there are none; and the means m0 to m11 of all."""
    high = F.col("rating") >= lexicons.HIGH_RATING
    cells = [c for i in range(len(lexicons.EXPERIENCE)) for c in (F.avg(F.when(high, F.col(f"x{i}"))).alias(f"h{i}"), F.avg(f"x{i}").alias(f"m{i}"))]
    agg = counted.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n_reviews"), *cells)
    return agg.select("facility_id", "n_reviews", *(F.coalesce(f"h{i}", f"m{i}").alias(f"t{i}") for i in range(len(lexicons.EXPERIENCE))), *(f"m{i}" for i in range(len(lexicons.EXPERIENCE))))


def fits(counted: DataFrame, aims: DataFrame) -> DataFrame:
    """(facility_id, id, elements, fit, satisfaction) of every review with enough elements."""
    k = range(len(lexicons.EXPERIENCE))
    elements = _sum([(F.col(f"x{i}") > 0).cast("int") for i in k])
    rows = counted.withColumn("elements", elements).join(aims, "facility_id")
    dot, a, b = _sum([F.col(f"x{i}") * F.col(f"t{i}") for i in k]), _sum([F.col(f"x{i}") * F.col(f"x{i}") for i in k]), _sum([F.col(f"t{i}") * F.col(f"t{i}") for i in k])
    fit = F.try_divide(dot, F.sqrt(a) * F.sqrt(b))
    satisfied = F.coalesce((F.col("rating") - 1) / 4, F.lit(0.5))
    return rows.filter(F.col("elements") >= lexicons.FIT_LEAST_ELEMENTS).select("facility_id", "id", "elements", fit.alias("fit"), satisfied.alias("satisfaction")).filter("fit is not null")


def visitor_fit(counted: DataFrame) -> DataFrame:
    """Per facility: matching rate, satisfaction, gap and the index; the verdict is suspended where too few reviews can be judged."""
    aims = targets(counted)
    k = range(len(lexicons.EXPERIENCE))
    agg = fits(counted, aims).groupBy("facility_id").agg(F.count(F.lit(1)).alias("n_scored"), F.avg((F.col("fit") > lexicons.FIT_THRESHOLD).cast("int")).alias("match"), F.avg("satisfaction").alias("sat"))
    off, size = F.sqrt(_sum([(F.col(f"m{i}") - F.col(f"t{i}")) * (F.col(f"m{i}") - F.col(f"t{i}")) for i in k])), F.sqrt(_sum([F.col(f"t{i}") * F.col(f"t{i}") for i in k]))
    rows = agg.join(aims, "facility_id").withColumn("gap", F.least(F.lit(1.0), F.try_divide(off, size)))
    a, b, c = lexicons.FIT_WEIGHTS
    raw = a * F.col("match") + b * F.col("sat") - c * F.col("gap")
    ok = (F.col("n_reviews") >= lexicons.FIT_LEAST_REVIEWS) & (F.col("n_scored") >= lexicons.FIT_LEAST_REVIEWS)
    return rows.filter(ok).select(
        "facility_id", "n_reviews", "n_scored", fixed(F.col("match"), 5).alias("match_rate"), fixed(F.col("sat"), 5).alias("satisfaction"), fixed(F.col("gap"), 5).alias("gap"),
        fixed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 100, 1).alias("score"), (F.col("n_scored") / F.col("n_reviews") >= lexicons.FIT_LEAST_SHARE).alias("reliable"),
    )


def fit_quadrants(found: DataFrame) -> DataFrame:
    """Number and share of reviews by fit and satisfaction; all four quadrants of every facility."""
    fit, sat = F.col("fit") > lexicons.FIT_THRESHOLD, F.col("satisfaction") >= 0.5
    agg = found.groupBy("facility_id").agg(F.count(F.lit(1)).alias("all"), *(F.count(F.when(c, 1)).alias(n) for n, c in {"ideal": fit & sat, "service": fit & ~sat, "surprise": ~fit & sat, "marketing": ~fit & ~sat}.items()))
    cells = F.array(*(F.struct(F.lit(q).alias("quadrant"), F.col(q).alias("n")) for q in ("ideal", "service", "surprise", "marketing")))
    return agg.select("facility_id", "all", F.explode(cells).alias("c")).select("facility_id", "c.quadrant", "c.n", fixed(100.0 * F.col("c.n") / F.col("all"), 1).alias("share"))


def evidence(annotated: DataFrame) -> DataFrame:
    """Adds the sentiment blended with the stars, the weight of evidence, and friction, the mean of the two largest of six signals."""
    star = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("rating") - 3) / 2))
    felt = F.when(F.col("rating").isNotNull(), (1 - lexicons.STAR_BLEND) * F.col("sentiment") + lexicons.STAR_BLEND * star).otherwise(F.col("sentiment"))
    signals = F.array_sort(F.array("wait", "congestion", "restriction", "expectation_gap", "cost_burden", "information_gap"))
    return annotated.withColumns({"felt": felt, "weight": F.greatest(F.lit(0.05), F.col("intensity") * F.col("confidence")), "friction": (F.element_at(signals, -1) + F.element_at(signals, -2)) / 2})


def phases(weighted: DataFrame, key: str) -> DataFrame:
    """Per key and observed phase: effect, its positive and negative part, and the phase's weight among those observed."""
    w = F.create_map(*(x for p, v in lexicons.PHASES.items() for x in (F.lit(p), F.lit(v))))
    agg = weighted.groupBy(key, "phase").agg((F.sum(F.col("felt") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-12))).alias("effect"), F.count(F.lit(1)).alias("n"))
    total = agg.groupBy(key).agg(F.sum(F.element_at(w, F.col("phase"))).alias("all"))
    return agg.join(total, key).select(key, "phase", "n", fixed(F.element_at(w, F.col("phase")) / F.col("all"), 6).alias("phase_weight"), fixed(F.col("effect"), 6).alias("effect"), fixed((F.col("effect") + 1) / 2, 6).alias("positive"), fixed((1 - F.col("effect")) / 2, 6).alias("negative"))


def experience_index(weighted: DataFrame, key: str) -> DataFrame:
    """Per key: the phase-weighted effect, corrected for memory, return and friction, as a score of 100 and a band."""
    base = phases(weighted, key).groupBy(key).agg(F.sum(F.col("phase_weight") * F.col("effect")).alias("base"))
    e = F.greatest(F.sum("weight"), F.lit(1e-12))
    mean = lambda c: F.sum(c * F.col("weight")) / e
    agg = weighted.groupBy(key).agg(mean(F.col("memory") * F.col("self_relation")).alias("memory"), mean(F.greatest("revisit", "recommend")).alias("comeback"), mean(F.col("friction")).alias("friction"))
    rows = agg.join(base, key).withColumn("adjusted", F.col("base") + lexicons.MEMORY_GAIN * F.col("memory") + lexicons.RETURN_GAIN * F.col("comeback") - lexicons.FRICTION_LOSS * F.col("friction"))
    score = 100 / (1 + F.exp(-lexicons.LOGIT_SCALE * F.col("adjusted")))
    rows = rows.withColumn("score", fixed(score, 1))
    band = F.when(F.col("score") >= 85, "moving").when(F.col("score") >= 70, "high").when(F.col("score") >= 55, "fair").when(F.col("score") >= 40, "below expectation").otherwise("disappointing")
    return rows.select(key, *(fixed(F.col(c), 4).alias(c) for c in ("base", "memory", "comeback", "friction")), "score", band.alias("band"))


def weighted_mean(features: DataFrame, key: str, names: list[str], confidence: str) -> DataFrame:
    """Per key and feature: the mean weighted by confidence over known values, and the share of rows that know it."""
    w = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5))))
    long = features.select(key, w.alias("w"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))).alias("f"))
    known = F.col("f.value").isNotNull()
    return long.groupBy(key, F.col("f.feature").alias("feature")).agg(
        fixed(F.try_divide(F.sum(F.when(known, F.col("f.value") * F.col("w"))), F.sum(F.when(known, F.col("w")))), 6).alias("mean"), fixed(F.avg(known.cast("int")), 6).alias("coverage"))


def profile_fit(features: DataFrame, aim: dict[str, float], satisfaction: str) -> DataFrame:
    """Adds fit, of cosine and distance over known features, and the quadrant it gives with satisfaction; null where too few are known."""
    least = max(LEAST_DIMENSIONS, -(-3 * len(aim) // 10))
    known = {n: F.col(n).isNotNull() for n in aim}
    part = lambda f: _sum([F.when(known[n], f(F.col(n).cast("double"), F.lit(t))).otherwise(0.0) for n, t in aim.items()])
    count = _sum([k.cast("int") for k in known.values()])
    cosine = F.coalesce(F.try_divide(part(lambda v, t: v * t), F.sqrt(part(lambda v, t: v * v)) * F.sqrt(part(lambda v, t: t * t))), F.lit(0.0))
    fit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 * cosine + 0.55 * (1 - F.try_divide(part(lambda v, t: F.abs(v - t)), count))))
    rows = features.withColumns({"dimensions": count, "fit": F.when(count >= least, fixed(fit, 6))})
    high, happy = F.col("fit") >= FIT_FROM, F.col(satisfaction) >= SATISFIED_FROM
    quadrant = (
        F.when(F.col("fit").isNull() | F.col(satisfaction).isNull(), "suspended").when(high & happy, "fit and happy").when(high, "fit, unhappy").when(happy, "unfit, happy").otherwise("unfit and unhappy")
    )
    return rows.withColumn("quadrant", quadrant)
