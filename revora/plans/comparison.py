"""Queries that compare facilities, over the mean sub-scores of the axes of metric_def, however their names are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import fixed, fixed_sql
from ..operators import compare
from ..operators.wide_table import name_key_column, name_key_sql
from ..sources.tables import table


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """(facility_id, metric, score, ftype), scores on a scale of 100."""
    forms = F.array("attr", "label_ja", "label_en", F.concat("label_ja", "label_en"), F.concat("label_en", "label_ja"))
    d = table(spark, folder, "metric_def").filter("held_in = 'review_subscore'").select(F.col("attr").alias("metric"), F.explode(forms).alias("form"))
    d = d.filter("form is not null").groupBy(name_key_column(F.col("form")).alias("key")).agg(F.min("metric").alias("metric"))
    s = table(spark, folder, "review_subscore").filter("value is not null").select("review_db_id", name_key_column(F.col("axis")).alias("key"), "value").join(d, "key")
    r = table(spark, folder, "review").select(F.col("id").alias("review_db_id"), "facility_id")
    f = table(spark, folder, "facility").select(F.col("id").alias("facility_id"), "ftype")
    m = s.join(r, "review_db_id").groupBy("facility_id", "metric").agg(fixed(F.sum("value") / F.count("value") * 20, 4).alias("score"))
    return m.join(f, "facility_id")


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    return compare.against_others(matrix(spark, folder)).drop("ftype")


def compare_all_avg(spark: SparkSession, folder: str) -> DataFrame:
    return _compared(spark, folder)


def compare_peer_avg(spark: SparkSession, folder: str) -> DataFrame:
    """Against the mean of the other comparison facilities."""
    return compare.against_others(matrix(spark, folder), F.col("ftype") == "comparison").drop("ftype")


def compare_specific(spark: SparkSession, folder: str) -> DataFrame:
    """Every facility against facility 1, metric by metric."""
    m = matrix(spark, folder).drop("ftype")
    other = m.filter("facility_id = 1").select("metric", F.col("score").alias("baseline"))
    return m.filter("facility_id <> 1").join(other, "metric").select("facility_id", "metric", "score", "baseline", fixed(F.col("score") - F.col("baseline"), 4).alias("diff"))


def top_strengths(spark: SparkSession, folder: str) -> DataFrame:
    return compare.strengths(_compared(spark, folder)).select("facility_id", "rank", "metric", "diff")


def top_weaknesses(spark: SparkSession, folder: str) -> DataFrame:
    return compare.weaknesses(_compared(spark, folder)).select("facility_id", "rank", "metric", "diff")


def calibration_stats(spark: SparkSession, folder: str) -> DataFrame:
    return compare.calibration(matrix(spark, folder))


def calibrated_scores(spark: SparkSession, folder: str) -> DataFrame:
    return compare.calibrated(matrix(spark, folder))


def market_trend(spark: SparkSession, folder: str) -> DataFrame:
    return compare.market_trend(matrix(spark, folder), 2)


def win_lose(spark: SparkSession, folder: str) -> DataFrame:
    return compare.win_lose(compare_peer_avg(spark, folder)).select("facility_id", "metric", "diff", "side")


def space_findings(spark: SparkSession, folder: str) -> DataFrame:
    return compare.findings(_compared(spark, folder))


def outcome_map(spark: SparkSession, folder: str) -> DataFrame:
    """Market and peer means of each metric."""
    peer = F.when(F.col("ftype") == "comparison", F.col("score"))
    return matrix(spark, folder).groupBy("metric").agg(fixed(F.avg("score"), 3).alias("market"), fixed(F.avg(peer), 3).alias("peers"), F.count(F.lit(1)).alias("n"))


def issues(spark: SparkSession, folder: str) -> DataFrame:
    return compare.issues(_compared(spark, folder))


def peer_display(spark: SparkSession, folder: str) -> DataFrame:
    """Five peers to show beside facility 1: those of its category first, then by name."""
    f = table(spark, folder, "facility").select("id", "name", "category")
    own = f.filter("id = 1").select(F.col("category").alias("own")).first()
    same = F.coalesce(F.col("category").eqNullSafe(F.lit(own[0] if own else None)), F.lit(False))
    return f.filter("id <> 1").select("id", "name", same.alias("same_category")).orderBy(F.desc("same_category"), "name", "id").limit(5)


QUERIES = {f.__name__: f for f in (
    compare_all_avg, compare_peer_avg, compare_specific, top_strengths, top_weaknesses, calibration_stats, calibrated_scores, market_trend,
    win_lose, space_findings, outcome_map, issues, peer_display,
)}

_M = f"""
    SELECT m.facility_id, m.metric, m.score, f.ftype FROM (
        SELECT r.facility_id, d.attr AS metric, {fixed_sql('sum(s.value) / count(s.value) * 20', 4)} AS score
        FROM (SELECT x.review_db_id, x.value, k.key FROM review_subscore x JOIN (SELECT axis, {name_key_sql('axis')} AS key FROM (SELECT DISTINCT axis FROM review_subscore)) k ON k.axis = x.axis) s
        JOIN (SELECT key, min(attr) AS attr FROM (SELECT attr, {name_key_sql('form')} AS key FROM (
            SELECT attr, unnest([attr, label_ja, label_en, label_ja || label_en, label_en || label_ja]) AS form FROM metric_def WHERE held_in = 'review_subscore') WHERE form IS NOT NULL) GROUP BY 1) d ON d.key = s.key
        JOIN review r ON r.id = s.review_db_id WHERE s.value IS NOT NULL GROUP BY 1, 2) m JOIN facility f ON f.id = m.facility_id"""


def _others(peer: str) -> str:
    base = f"(coalesce(sum(CASE WHEN {peer} THEN score END) OVER w, 0) - CASE WHEN {peer} THEN score ELSE 0 END) / nullif(sum(CASE WHEN {peer} THEN 1 ELSE 0 END) OVER w - CASE WHEN {peer} THEN 1 ELSE 0 END, 0)"
    return f"""SELECT facility_id, metric, score, baseline, {fixed_sql('(score - baseline)', 4)} AS diff FROM (
        SELECT facility_id, metric, score, {fixed_sql('b', 4)} AS baseline FROM (SELECT *, {base} AS b FROM ({_M}) WINDOW w AS (PARTITION BY metric))) WHERE baseline IS NOT NULL"""


_ALL = _others("true")
_PEERS = _others("ftype = 'comparison'")
_PEER_MEAN = fixed_sql("avg(score) FILTER (ftype = 'comparison')", 3)
_STATS = f"""SELECT metric, n, {fixed_sql('mean', 4)} AS mean, {fixed_sql('greatest(sd, 1.0::DOUBLE)', 4)} AS spread FROM (
    SELECT metric, count(DISTINCT facility_id) AS n, avg(s) AS mean, stddev_pop(s) AS sd FROM (SELECT *, {fixed_sql('score', 1)} AS s FROM ({_M})) GROUP BY metric) WHERE n >= 8"""

SQL = {
    "compare_all_avg": _ALL,
    "compare_peer_avg": _PEERS,
    "compare_specific": f"SELECT a.facility_id, a.metric, a.score, b.score AS baseline, {fixed_sql('(a.score - b.score)', 4)} AS diff FROM ({_M}) a JOIN ({_M}) b ON a.metric = b.metric AND b.facility_id = 1 WHERE a.facility_id <> 1",
    "top_strengths": f"SELECT * FROM (SELECT facility_id, CAST(row_number() OVER (PARTITION BY facility_id ORDER BY diff DESC, metric) AS INT) AS rank, metric, diff FROM ({_ALL}) WHERE diff >= 0) WHERE rank <= 5",
    "top_weaknesses": f"SELECT * FROM (SELECT facility_id, CAST(row_number() OVER (PARTITION BY facility_id ORDER BY diff, metric) AS INT) AS rank, metric, diff FROM ({_ALL}) WHERE diff < 0) WHERE rank <= 5",
    "calibration_stats": _STATS,
    "calibrated_scores": f"""SELECT facility_id, metric, score, {fixed_sql('coalesce(least(5.0::DOUBLE, greatest(1.0::DOUBLE, 3.0 + z * 0.5)) * 20, score)', 4)} AS calibrated, mean IS NOT NULL AS is_calibrated FROM (
        SELECT m.facility_id, m.metric, m.score, t.mean, ({fixed_sql('m.score', 1)} - t.mean) / t.spread AS z FROM ({_M}) m LEFT JOIN ({_STATS}) t USING (metric))""",
    "market_trend": f"""WITH a AS (SELECT metric, {fixed_sql('avg(score)', 4)} AS market_mean FROM ({_M}) GROUP BY metric)
        (SELECT metric, market_mean, 'good' AS side FROM a ORDER BY market_mean DESC, metric LIMIT 2) UNION ALL (SELECT metric, market_mean, 'bad' AS side FROM a ORDER BY market_mean, metric LIMIT 2)""",
    "win_lose": f"SELECT facility_id, metric, diff, CASE WHEN diff > 0 THEN 'win' ELSE 'lose' END AS side FROM ({_PEERS})",
    "space_findings": f"""SELECT facility_id, metric, gap, above, t <= 3 AS is_top, CASE WHEN gap >= 0.15 THEN 'strong' WHEN gap <= -0.15 THEN 'weak' ELSE 'level' END AS badge FROM (
        SELECT facility_id, metric, {fixed_sql('(diff / 20)', 2)} AS gap, CAST(sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY facility_id) AS BIGINT) AS above,
               row_number() OVER (PARTITION BY facility_id ORDER BY diff DESC, metric) AS t, row_number() OVER (PARTITION BY facility_id ORDER BY diff, metric) AS b FROM ({_ALL})) WHERE t <= 3 OR b <= 3""",
    "outcome_map": f"SELECT metric, {fixed_sql('avg(score)', 3)} AS market, {_PEER_MEAN} AS peers, count(*) AS n FROM ({_M}) GROUP BY metric",
    "issues": f"""SELECT facility_id, metric, score5, base5, gap5, CAST(rank AS INT) AS rank, CASE WHEN rank = 1 THEN 'high' ELSE 'medium' END AS priority, {fixed_sql('least(1.0::DOUBLE, abs(gap5) / 0.6)', 4)} AS impact FROM (
        SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY gap5, metric) AS rank FROM (
            SELECT facility_id, metric, {fixed_sql('(score / 20)', 2)} AS score5, {fixed_sql('(baseline / 20)', 2)} AS base5, {fixed_sql('((score - baseline) / 20)', 2)} AS gap5 FROM ({_ALL}))) WHERE rank <= 3""",
    "peer_display": "SELECT id, name, coalesce(category IS NOT DISTINCT FROM (SELECT category FROM facility WHERE id = 1), false) AS same_category FROM facility WHERE id <> 1 ORDER BY same_category DESC, name, id LIMIT 5",
}
