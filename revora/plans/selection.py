"""Queries on reliability, remarks and indices of experience."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicons
from ..functions.columns import contains_any_sql, fixed, fixed_sql, words_present_sql
from ..operators import experience, reliability, remarks
from ..sources.tables import table
from .texts import _T, SQL as _TEXT_SQL, _texts, funnel


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "review").select("facility_id", "rating").filter("rating is not null and facility_id is not null")


def wilson_ci(spark: SparkSession, folder: str) -> DataFrame:
    agg = _rated(spark, folder).groupBy("facility_id").agg(F.count(F.when(F.col("rating") >= 4, 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = reliability.wilson(F.col("k"), F.col("n"))
    return agg.select("facility_id", "k", "n", fixed(lo, 6).alias("lo"), fixed(hi, 6).alias("hi"))


def mean_ci(spark: SparkSession, folder: str) -> DataFrame:
    return reliability.mean_interval(_rated(spark, folder), "facility_id", "rating")


def reliability_flags(spark: SparkSession, folder: str) -> DataFrame:
    return reliability.flags(funnel(spark, folder), mean_ci(spark, folder))


def coverage_summary(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "facility").select(F.col("id").alias("facility_id"), "total_reviews")
    return reliability.coverage(f, funnel(spark, folder))


def coverage_totals(spark: SparkSession, folder: str) -> DataFrame:
    c = coverage_summary(spark, folder)
    known = F.col("total_reviews") > 0
    return c.agg(F.count(F.lit(1)).alias("facilities"), F.count(F.when(known, 1)).alias("with_total"), F.sum(F.when(known, F.col("total_reviews"))).alias("total"), F.sum(F.when(known, F.col("held"))).alias("held"), F.sum(F.when(known, F.col("usable"))).alias("usable"))


def rare_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return remarks.rare(_texts(spark, folder, "id"))


def voices_quadrants(spark: SparkSession, folder: str) -> DataFrame:
    return remarks.voices(_texts(spark, folder, "id", "rating"))


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    return experience.element_counts(_texts(spark, folder, "id", "rating"))


def vffi_keyword(spark: SparkSession, folder: str) -> DataFrame:
    return experience.visitor_fit(_counted(spark, folder))


def vffi_quadrants(spark: SparkSession, folder: str) -> DataFrame:
    c = _counted(spark, folder)
    return experience.fit_quadrants(experience.fits(c, experience.targets(c)))


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences annotated by phase and feeling; the columns of lineitem stand for an annotator's output."""
    q = F.col("l_quantity") / 50
    phase = F.element_at(F.array(*map(F.lit, lexicons.PHASES)), F.col("l_linenumber"))
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("facility_id"), phase.alias("phase"), (F.col("l_discount") * 20 - 1).alias("sentiment"), q.alias("intensity"), (1 - F.col("l_tax")).alias("confidence"),
        F.when(F.col("l_returnflag") != "N", 1 + F.pmod(F.col("l_partkey"), F.lit(5)).cast("double")).alias("rating"), (F.col("l_tax") * 10).alias("memory"), q.alias("self_relation"),
        (F.col("l_discount") * 10).alias("revisit"), (F.col("l_tax") * 5).alias("recommend"), (F.col("l_tax") * 12).alias("wait"), q.alias("congestion"), (F.col("l_discount") * 5).alias("restriction"),
        (1 - q).alias("expectation_gap"), (F.col("l_tax") * 3).alias("cost_burden"), (F.col("l_discount") * 2).alias("information_gap"),
    )


def nmsi_phases(spark: SparkSession, folder: str) -> DataFrame:
    return experience.phases(experience.evidence(annotated(spark, folder)), "facility_id")


def nmsi_score(spark: SparkSession, folder: str) -> DataFrame:
    return experience.experience_index(experience.evidence(annotated(spark, folder)), "facility_id")


#: The aims that the queries on profiles hold visitors against.
AIM = {"sentiment": 0.6, "intensity": 0.5, "memory": 0.4, "revisit": 0.5, "rating5": 0.7}


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    return annotated(spark, folder).withColumn("rating5", F.col("rating") / 5)


def weighted_mean_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return experience.weighted_mean(_profiles(spark, folder), "facility_id", list(AIM), "confidence")


def visitor_vffi(spark: SparkSession, folder: str) -> DataFrame:
    """Per facility: judged profiles, matching rate, mean fit."""
    p = experience.profile_fit(_profiles(spark, folder), AIM, "rating5")
    return p.groupBy("facility_id").agg(F.count("fit").alias("n_judged"), fixed(F.avg((F.col("fit") >= experience.FIT_FROM).cast("int")), 6).alias("match_rate"), fixed(F.avg("fit"), 5).alias("mean_fit"))


def quadrant_summary(spark: SparkSession, folder: str) -> DataFrame:
    p = experience.profile_fit(_profiles(spark, folder), AIM, "rating5")
    return p.groupBy("facility_id", "quadrant").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    wilson_ci, mean_ci, reliability_flags, coverage_summary, coverage_totals, rare_reviews, voices_quadrants, vffi_keyword, vffi_quadrants,
    nmsi_phases, nmsi_score, weighted_mean_coverage, visitor_vffi, quadrant_summary,
)}

_R = "(SELECT facility_id, rating FROM review WHERE rating IS NOT NULL AND facility_id IS NOT NULL)"
_TSMALL = "[" + ", ".join(map(str, reliability.T_SMALL)) + "]"
_TEXP = f"{reliability._Z!r}::DOUBLE + " + " + ".join(f"{c!r}::DOUBLE / pow(n - 1, {i}.0::DOUBLE)" for i, c in enumerate(reliability._EXPANSION, 1))
_MEAN = f"""SELECT facility_id, n, {fixed_sql('m', 5)} AS mean, {fixed_sql('(m - h)', 5)} AS lo, {fixed_sql('(m + h)', 5)} AS hi FROM (
    SELECT *, (CASE WHEN n - 1 <= 10 THEN CAST(({_TSMALL})[least(n - 1, 10)::INT] AS DOUBLE) ELSE {_TEXP} END) * sd / sqrt(n) AS h FROM (
        SELECT facility_id, count(*) AS n, avg(rating) AS m, stddev_samp(rating) AS sd FROM {_R} GROUP BY 1) WHERE n >= 2)"""
_P = "(k / n::DOUBLE)"
_D = "(1 + 1.96::DOUBLE * 1.96::DOUBLE / n)"
_CENTRE = f"(({_P} + 1.96::DOUBLE * 1.96::DOUBLE / (2 * n)) / {_D})"
_HALF = f"(1.96::DOUBLE / {_D} * sqrt({_P} * (1 - {_P}) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4.0::DOUBLE * n * n)))"
_COVERAGE = f"""SELECT f.id AS facility_id, f.total_reviews, coalesce(u.total, 0) AS held, coalesce(u.usable, 0) AS usable, {fixed_sql('(coalesce(u.total, 0)::DOUBLE / nullif(f.total_reviews, 0))', 6)} AS held_rate,
    {fixed_sql('(coalesce(u.usable, 0)::DOUBLE / nullif(f.total_reviews, 0))', 6)} AS usable_rate, CASE WHEN f.total_reviews IS NOT NULL THEN greatest(0, f.total_reviews - coalesce(u.total, 0)) END AS missing
    FROM facility f LEFT JOIN ({_TEXT_SQL['funnel']}) u ON u.facility_id = f.id"""
_K = len(lexicons.EXPERIENCE)
_X = f"(SELECT facility_id, id, rating, " + ", ".join(f"{words_present_sql('text', ws)}::DOUBLE AS x{i}" for i, ws in enumerate(lexicons.EXPERIENCE.values())) + f" FROM {_T})"
_AIMS = "(SELECT facility_id, count(*) AS n_reviews, " + ", ".join(f"coalesce(avg(x{i}) FILTER (rating >= 4), avg(x{i})) AS t{i}, avg(x{i}) AS m{i}" for i in range(_K)) + f" FROM {_X} GROUP BY 1)"
_plus = lambda f: "(" + " + ".join(f(i) for i in range(_K)) + ")"
_FITS = f"""(SELECT * FROM (SELECT facility_id, id, {_plus(lambda i: f'x{i} * t{i}')} / nullif(sqrt({_plus(lambda i: f'x{i} * x{i}')}) * sqrt({_plus(lambda i: f't{i} * t{i}')}), 0) AS fit, coalesce((rating - 1) / 4, 0.5) AS satisfaction
    FROM {_X} JOIN {_AIMS} USING (facility_id) WHERE {_plus(lambda i: f'(x{i} > 0)::INT')} >= 2) WHERE fit IS NOT NULL)"""
_VOICE = f"(SELECT facility_id, text, min(id) AS id, arg_min(rating, id) AS rating FROM (SELECT facility_id, id, rating, trim(text, ' ') AS text FROM {_T}) WHERE text <> '' GROUP BY 1, 2)"
_LONGEST = "QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY length(text) DESC, id) = 1"
_ANNOTATED = "(SELECT l_suppkey AS facility_id, ([" + ", ".join(f"'{p}'" for p in lexicons.PHASES) + """])[l_linenumber] AS phase, l_discount * 20 - 1 AS sentiment, l_quantity / 50 AS intensity, 1 - l_tax AS confidence,
    CASE WHEN l_returnflag <> 'N' THEN 1 + (l_partkey % 5)::DOUBLE END AS rating, l_tax * 10 AS memory, l_quantity / 50 AS self_relation, l_discount * 10 AS revisit, l_tax * 5 AS recommend,
    [l_tax * 12, l_quantity / 50, l_discount * 5, 1 - l_quantity / 50, l_tax * 3, l_discount * 2] AS signals FROM lineitem)"""
_EVIDENCE = f"""(SELECT *, CASE WHEN rating IS NOT NULL THEN 0.85::DOUBLE * sentiment + 0.15::DOUBLE * greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (rating - 3) / 2)) ELSE sentiment END AS felt,
    greatest(0.05::DOUBLE, intensity * confidence) AS weight, (list_reverse_sort(signals)[1] + list_reverse_sort(signals)[2]) / 2 AS friction FROM {_ANNOTATED})"""
_PW = "(VALUES " + ", ".join(f"('{p}', {w!r}::DOUBLE)" for p, w in lexicons.PHASES.items()) + ") p(phase, pw)"
_PHASES = f"""(SELECT facility_id, phase, n, {fixed_sql('(pw / sum(pw) OVER (PARTITION BY facility_id))', 6)} AS phase_weight, {fixed_sql('effect', 6)} AS effect, {fixed_sql('((effect + 1) / 2)', 6)} AS positive, {fixed_sql('((1 - effect) / 2)', 6)} AS negative
    FROM (SELECT facility_id, phase, sum(felt * weight) / greatest(sum(weight), 1e-12) AS effect, count(*) AS n FROM {_EVIDENCE} GROUP BY 1, 2) JOIN {_PW} USING (phase))"""
_PROFILES = f"(SELECT *, rating / 5 AS rating5 FROM {_ANNOTATED})"
_known = lambda f: "(" + " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {f(n, t)} ELSE 0.0::DOUBLE END" for n, t in AIM.items()) + ")"
_DIM = "(" + " + ".join(f"({n} IS NOT NULL)::INT" for n in AIM) + ")"
_COS = f"coalesce({_known(lambda n, t: f'{n} * {t!r}::DOUBLE')} / nullif(sqrt({_known(lambda n, t: f'{n} * {n}')}) * sqrt({_known(lambda n, t: f'{t!r}::DOUBLE * {t!r}::DOUBLE')}), 0), 0.0::DOUBLE)"
_FIT = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.45::DOUBLE * {_COS} + 0.55::DOUBLE * (1 - {_known(lambda n, t: f'abs({n} - {t!r}::DOUBLE)')} / nullif({_DIM}, 0))))"
_PROFILE_FIT = f"(SELECT *, CASE WHEN {_DIM} >= 3 THEN {fixed_sql('fit0', 6)} END AS fit FROM (SELECT *, {_FIT} AS fit0 FROM {_PROFILES}))"

SQL = {
    "wilson_ci": f"SELECT facility_id, k, n, {fixed_sql(f'greatest(0.0::DOUBLE, {_CENTRE} - {_HALF})', 6)} AS lo, {fixed_sql(f'least(1.0::DOUBLE, {_CENTRE} + {_HALF})', 6)} AS hi FROM (SELECT facility_id, count(*) FILTER (rating >= 4) AS k, count(*) AS n FROM {_R} GROUP BY 1)",
    "mean_ci": _MEAN,
    "reliability_flags": f"""WITH u AS ({_TEXT_SQL['funnel']}), m AS ({_MEAN})
        SELECT facility_id, 'small_n' AS flag, 'warn' AS level FROM u WHERE usable < 30 UNION ALL SELECT facility_id, 'foreign', 'warn' FROM u WHERE foreign_texts / total::DOUBLE > 0.10
        UNION ALL SELECT facility_id, 'short', 'note' FROM u WHERE short / total::DOUBLE > 0.15 UNION ALL SELECT u.facility_id, 'wide_interval', 'note' FROM u JOIN m USING (facility_id) WHERE hi - lo > 0.5::DOUBLE""",
    "coverage_summary": _COVERAGE,
    "coverage_totals": f"SELECT count(*) AS facilities, count(*) FILTER (total_reviews > 0) AS with_total, CAST(sum(total_reviews) FILTER (total_reviews > 0) AS BIGINT) AS total, CAST(sum(held) FILTER (total_reviews > 0) AS BIGINT) AS held, CAST(sum(usable) FILTER (total_reviews > 0) AS BIGINT) AS usable FROM ({_COVERAGE})",
    "voices_quadrants": f"""WITH t AS MATERIALIZED (SELECT * FROM {_VOICE}),
        p1 AS (SELECT facility_id, id FROM t QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY coalesce(rating >= 4, false) DESC, length(text) DESC, id) = 1),
        p2 AS (SELECT facility_id, id FROM t WHERE rating <= 3 AND id NOT IN (SELECT id FROM p1) {_LONGEST}),
        p3 AS (SELECT facility_id, id FROM t WHERE {contains_any_sql('text', lexicons.WANTED)} AND id NOT IN (SELECT id FROM p1 UNION ALL SELECT id FROM p2) {_LONGEST}),
        p4 AS (SELECT facility_id, id FROM t WHERE {contains_any_sql('text', lexicons.AHEAD)} AND id NOT IN (SELECT id FROM p1 UNION ALL SELECT id FROM p2 UNION ALL SELECT id FROM p3) {_LONGEST})
        """ + " UNION ALL ".join(f"SELECT facility_id, '{q}' AS quadrant, id FROM p{i}" for i, q in enumerate(lexicons.QUADRANTS, 1)),
    "vffi_keyword": f"""SELECT facility_id, n_reviews, n_scored, {fixed_sql('match', 5)} AS match_rate, {fixed_sql('sat', 5)} AS satisfaction, {fixed_sql('gap', 5)} AS gap,
        {fixed_sql('(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.45::DOUBLE * match + 0.45::DOUBLE * sat - 0.30::DOUBLE * gap)) * 100)', 1)} AS score, n_scored / n_reviews::DOUBLE >= 0.30 AS reliable FROM (
            SELECT *, least(1.0::DOUBLE, sqrt({_plus(lambda i: f'(m{i} - t{i}) * (m{i} - t{i})')}) / nullif(sqrt({_plus(lambda i: f't{i} * t{i}')}), 0)) AS gap
            FROM (SELECT facility_id, count(*) AS n_scored, avg((fit > 0.7::DOUBLE)::INT) AS match, avg(satisfaction) AS sat FROM {_FITS} GROUP BY 1) JOIN {_AIMS} USING (facility_id)) WHERE n_reviews >= 10 AND n_scored >= 10""",
    "vffi_quadrants": f"""WITH f AS MATERIALIZED (SELECT facility_id, CASE WHEN fit > 0.7::DOUBLE AND satisfaction >= 0.5 THEN 'ideal' WHEN fit > 0.7::DOUBLE THEN 'service' WHEN satisfaction >= 0.5 THEN 'surprise' ELSE 'marketing' END AS quadrant FROM {_FITS}),
        a AS (SELECT facility_id, count(*) AS total FROM f GROUP BY 1), c AS (SELECT facility_id, quadrant, count(*) AS n FROM f GROUP BY 1, 2)
        SELECT facility_id, quadrant, coalesce(n, 0) AS n, {fixed_sql('(100.0::DOUBLE * coalesce(n, 0) / total)', 1)} AS share FROM a CROSS JOIN (VALUES ('ideal'), ('service'), ('surprise'), ('marketing')) q(quadrant) LEFT JOIN c USING (facility_id, quadrant)""",
    "nmsi_phases": f"SELECT * FROM {_PHASES}",
    "nmsi_score": f"""SELECT facility_id, {', '.join(f'{fixed_sql(c, 4)} AS {c}' for c in ('base', 'memory', 'comeback', 'friction'))}, score, CASE WHEN score >= 85 THEN 'moving' WHEN score >= 70 THEN 'high' WHEN score >= 55 THEN 'fair' WHEN score >= 40 THEN 'below expectation' ELSE 'disappointing' END AS band FROM (
        SELECT *, {fixed_sql('(100 / (1 + exp(-2.0::DOUBLE * (base + 0.12::DOUBLE * memory + 0.12::DOUBLE * comeback - 0.18::DOUBLE * friction))))', 1)} AS score FROM (
            SELECT facility_id, sum(memory * self_relation * weight) / greatest(sum(weight), 1e-12) AS memory, sum(greatest(revisit, recommend) * weight) / greatest(sum(weight), 1e-12) AS comeback, sum(friction * weight) / greatest(sum(weight), 1e-12) AS friction FROM {_EVIDENCE} GROUP BY 1)
        JOIN (SELECT facility_id, sum(phase_weight * effect) AS base FROM {_PHASES} GROUP BY 1) USING (facility_id))""",
    "weighted_mean_coverage": " UNION ALL ".join(
        f"SELECT facility_id, '{n}' AS feature, {fixed_sql(f'(sum({n} * w) FILTER ({n} IS NOT NULL) / nullif(sum(w) FILTER ({n} IS NOT NULL), 0))', 6)} AS mean, {fixed_sql(f'avg(({n} IS NOT NULL)::INT)', 6)} AS coverage FROM (SELECT *, greatest(0.05::DOUBLE, least(1.0::DOUBLE, coalesce(confidence, 0.5))) AS w FROM {_PROFILES}) GROUP BY 1"
        for n in AIM),
    "visitor_vffi": f"SELECT facility_id, count(fit) AS n_judged, {fixed_sql('avg((fit >= 0.7::DOUBLE)::INT)', 6)} AS match_rate, {fixed_sql('avg(fit)', 5)} AS mean_fit FROM {_PROFILE_FIT} GROUP BY 1",
    "quadrant_summary": f"""SELECT facility_id, CASE WHEN fit IS NULL OR rating5 IS NULL THEN 'suspended' WHEN fit >= 0.7::DOUBLE AND rating5 >= 0.6::DOUBLE THEN 'fit and happy' WHEN fit >= 0.7::DOUBLE THEN 'fit, unhappy' WHEN rating5 >= 0.6::DOUBLE THEN 'unfit, happy' ELSE 'unfit and unhappy' END AS quadrant, count(*) AS n
        FROM {_PROFILE_FIT} GROUP BY 1, 2""",
}
