"""Queries on scopes of comparison, integrity of joins, clusters and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import fixed, fixed_sql
from ..operators import ingest, scope
from ..sources.tables import table
from .comparison import _M, matrix
from .ratings import SQL as _RATING_SQL
from .ratings import score_matrix, subscore_matrix
from .topics import SQL as _TOPIC_SQL
from .topics import topic_scores

#: How many topics a list of priorities has.
LISTED = 8


def market_scope(spark: SparkSession, folder: str) -> DataFrame:
    return scope.against_market(matrix(spark, folder))


def competitor_scope(spark: SparkSession, folder: str) -> DataFrame:
    return scope.against_competitors(matrix(spark, folder), F.col("ftype") == "comparison")


def bottom_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return scope.lowest(market_scope(spark, folder))


def scope_rank(spark: SparkSession, folder: str) -> DataFrame:
    return scope.place_in_scope(matrix(spark, folder))


def chosen_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the sheets; sub-scores of the reviews where no sheet was read."""
    other = subscore_matrix(spark, folder).select("facility_id", F.col("axis").alias("metric_name"), "score")
    return scope.first_filled_matrix(score_matrix(spark, folder), other)


def priority_list(spark: SparkSession, folder: str) -> DataFrame:
    return scope.priorities(topic_scores(spark, folder), LISTED)


def subscore_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """How many reviews with sub-scores are not known, and how many known ones have none, or several of one axis."""
    asked = table(spark, folder, "review").select(F.col("id").alias("review_db_id"))
    given = table(spark, folder, "review_subscore").select("review_db_id", "axis").distinct().select("review_db_id")
    return scope.id_check(asked, given, "review_db_id").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def order_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Line items joined to their orders, each of which must be there once; per status the number and value of lines."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), "l_extendedprice")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    whole = scope.joined_whole(lines, orders, "key")
    return whole.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), fixed(F.sum("l_extendedprice"), 0).alias("value"))


def place_cluster_table(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by place (supplier) and phase (return flag); a discount above five per cent praises, one below blames."""
    m = table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_discount")
    return scope.place_clusters(m, ["l_suppkey", "l_returnflag"], "l_orderkey", F.col("l_discount") - 0.05)


def visitor_cluster_summary(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("first"), F.element_at("embedding", 2).cast("double").alias("second"))
    return scope.cluster_summary(e, "label", "vec_id", {"mean_first": "first", "mean_second": "second"})


def cluster_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The three components in which each label's vectors lie most above and below all vectors."""
    e = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("feature", "v"))
    return scope.cluster_profile(e.select("label", "feature", F.col("v").cast("double").alias("value")), "label", 3)


def map_links(spark: SparkSession, folder: str) -> DataFrame:
    """What the links of the export tell of their place, wherever they stand in a cell."""
    u = table(spark, folder, "sample_reviews").select("row_no", F.concat_ws(" ", "url", "reviewer_url", "fid_location", "place_id").alias("cell"))
    return u.select("row_no", *(c.alias(n) for n, c in ingest.map_link(F.col("cell")).items()))


def onboarding_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What to do with each typed place: ready, empty, ambiguous with candidates, or new; blank names are not found."""
    n = table(spark, folder, "review").groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"))
    f = table(spark, folder, "facility").select(F.col("id").alias("facility_id"), "name").join(n, "facility_id", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    typed = table(spark, folder, "sample_reviews").select(F.coalesce(F.trim("place_name"), F.lit("")).alias("name")).distinct()
    near = scope.candidates(typed.filter("name <> ''"), f)
    rows = typed.join(f, "name", "left").join(near, "name", "left")
    only = rows.withColumn("facility", F.when(F.col("n").isNotNull(), F.col("name")).when(F.col("matches") == 1, F.col("candidates")[0]))
    held = f.select(F.col("name").alias("facility"), F.col("n").alias("held"))
    action = (
        F.when(F.col("name") == "", "not_found").when(F.col("facility").isNotNull() & (F.col("held") > 0), "ready").when(F.col("facility").isNotNull(), "empty")
        .when(F.col("matches") > 1, "ambiguous").otherwise("new")
    )
    return only.join(held, "facility", "left").select("name", action.alias("action"), "facility", F.when(action == "ambiguous", F.array_join("candidates", " / ")).alias("candidates"))


def insert_subscores(spark: SparkSession, folder: str) -> DataFrame:
    """Children by natural key: of the later half of the sub-scores, those whose (review, axis) is not held, per axis."""
    s = table(spark, folder, "review_subscore").select("id", "review_db_id", "axis").filter("review_db_id is not null and axis is not null")
    half = F.col("id") % 2 == 0
    return ingest.new_rows(s.filter(half), s.filter(~half), ["review_db_id", "axis"], "id").groupBy("axis").agg(F.count(F.lit(1)).alias("inserted"))


QUERIES = {f.__name__: f for f in (
    market_scope, competitor_scope, bottom_metrics, scope_rank, chosen_matrix, priority_list, subscore_integrity, order_integrity, place_cluster_table, visitor_cluster_summary, cluster_profile,
    map_links, onboarding_plan, insert_subscores,
)}

_DIFF = lambda inner: f"SELECT facility_id, metric, s AS score, baseline, label, {fixed_sql('(s - baseline)', 2)} AS diff FROM (SELECT *, {fixed_sql('score', 2)} AS s FROM ({inner}))"
_MARKET = _DIFF(f"""SELECT m.*, {fixed_sql('(CASE WHEN k >= 2 THEN mean ELSE 50.0::DOUBLE END)', 2)} AS baseline, CASE WHEN k >= 2 THEN 'market' ELSE 'neutral' END AS label
    FROM (SELECT *, avg(score) OVER (PARTITION BY metric) AS mean FROM ({_M})) m CROSS JOIN (SELECT count(DISTINCT facility_id) AS k FROM ({_M}))""")
_IS = "CASE WHEN ftype = 'comparison' THEN 1 ELSE 0 END"
_PEERS = _DIFF(f"""SELECT *, {fixed_sql('coalesce(mean, 50.0::DOUBLE)', 2)} AS baseline, CASE WHEN mean IS NULL THEN 'neutral' ELSE 'competitors' END AS label FROM (
    SELECT *, (coalesce(sum(CASE WHEN ftype = 'comparison' THEN score END) OVER w, 0) - CASE WHEN ftype = 'comparison' THEN score ELSE 0 END) / nullif(sum({_IS}) OVER w - {_IS}, 0) AS mean FROM ({_M}) WINDOW w AS (PARTITION BY metric))""")
_CELL = "concat_ws(' ', url, reviewer_url, fid_location, place_id)"
_PART = lambda p: f"regexp_extract(cell, '{p}', 1)"

SQL = {
    "market_scope": _MARKET,
    "competitor_scope": _PEERS,
    "bottom_metrics": f"SELECT facility_id, CAST(rank AS INT) AS rank, metric, diff FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY diff, metric) AS rank FROM ({_MARKET})) WHERE rank <= 5",
    "scope_rank": f"""SELECT facility_id, score, CAST(rank() OVER (ORDER BY score DESC) AS BIGINT) AS rank, count(*) OVER () AS facilities, {fixed_sql('(score - avg(score) OVER ())', 3)} AS to_mean
        FROM (SELECT facility_id, {fixed_sql('avg(score)', 4)} AS score FROM ({_M}) GROUP BY 1)""",
    "chosen_matrix": f"""WITH s AS ({_RATING_SQL['score_matrix']}) SELECT * FROM s UNION ALL SELECT facility_id, axis AS metric_name, score FROM ({_RATING_SQL['subscore_matrix']}) WHERE NOT EXISTS (SELECT 1 FROM s)""",
    "priority_list": f"SELECT facility_id, CAST(priority AS INT) AS priority, topic, sentiment, salience FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY sentiment, salience DESC, topic) AS priority FROM ({_TOPIC_SQL['topic_scores']})) WHERE priority <= {LISTED}",
    "subscore_integrity": """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN r = 0 THEN 'missing' WHEN a = 0 THEN 'extra' WHEN r > 1 THEN 'repeated' END AS problem FROM (
        SELECT k, sum(a) AS a, sum(r) AS r FROM (SELECT id AS k, 1 AS a, 0 AS r FROM review UNION ALL SELECT review_db_id, 0, 1 FROM (SELECT DISTINCT review_db_id, axis FROM review_subscore)) WHERE k IS NOT NULL GROUP BY 1)) WHERE problem IS NOT NULL GROUP BY 1""",
    "order_integrity": f"SELECT o_orderstatus, count(*) AS n, {fixed_sql('sum(l_extendedprice)', 0)} AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "place_cluster_table": """SELECT l_suppkey, l_returnflag, count(*) AS mention_count, count(DISTINCT l_orderkey) AS review_count, count(*) FILTER (d > 0) AS positive_mentions, count(*) FILTER (d < 0) AS negative_mentions
        FROM (SELECT *, l_discount - 0.05::DOUBLE AS d FROM lineitem) GROUP BY 1, 2""",
    "visitor_cluster_summary": f"SELECT label, count(DISTINCT vec_id) AS review_count, {fixed_sql('avg(embedding[1]::DOUBLE)', 4)} AS mean_first, {fixed_sql('avg(embedding[2]::DOUBLE)', 4)} AS mean_second, {fixed_sql('(count(DISTINCT vec_id)::DOUBLE / (SELECT count(*) FROM embeddings))', 4)} AS ratio FROM embeddings GROUP BY 1",
    "cluster_profile": f"""WITH v AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings),
        m AS (SELECT *, {fixed_sql('(m - o)', 6)} AS d FROM (SELECT label, feature, {fixed_sql('(s / k)', 6)} AS m, {fixed_sql('(sum(s) OVER w / sum(k) OVER w)', 6)} AS o FROM (SELECT label, feature, sum(value) AS s, count(*) AS k FROM v GROUP BY 1, 2) WINDOW w AS (PARTITION BY feature))),
        r AS (SELECT *, 'high' AS side, row_number() OVER (PARTITION BY label ORDER BY d DESC, feature) AS rank FROM m UNION ALL SELECT *, 'low', row_number() OVER (PARTITION BY label ORDER BY d, feature) FROM m)
        SELECT label, side, CAST(rank AS INT) AS rank, CAST(feature AS INT) AS feature, {fixed_sql('m', 3)} AS cluster_mean, {fixed_sql('o', 3)} AS overall_mean, {fixed_sql('d', 3)} AS difference FROM r WHERE rank <= 3""",
    "map_links": f"""SELECT row_no, {_PART('/maps/place/([^/@?]+)')} AS name, try_cast(nullif(coalesce(nullif({_PART('!8m2!3d(-?[0-9]+[.]?[0-9]*)!4d')}, ''), {_PART('/@(-?[0-9]+[.]?[0-9]*),-?[0-9]')}), '') AS DOUBLE) AS lat,
        try_cast(nullif(coalesce(nullif({_PART('!8m2!3d-?[0-9]+[.]?[0-9]*!4d(-?[0-9]+[.]?[0-9]*)')}, ''), {_PART('/@-?[0-9]+[.]?[0-9]*,(-?[0-9]+[.]?[0-9]*)')}), '') AS DOUBLE) AS lng,
        {_PART('(0x[0-9a-f]+:0x[0-9a-f]+)')} AS fid, {_PART('!16s([^!?&]+)')} AS mid, {_PART('place_id:([A-Za-z0-9_-]+)')} AS place_id, regexp_matches(cell, '^https?://([a-z.]*[.])?goo[.]gl/') AS short FROM (SELECT row_no, {_CELL} AS cell FROM sample_reviews)""",
    "onboarding_plan": """WITH n AS (SELECT facility_id, count(*) AS n FROM review GROUP BY 1), f AS (SELECT name, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM facility LEFT JOIN n ON n.facility_id = id GROUP BY 1),
        t AS (SELECT DISTINCT coalesce(trim(place_name, ' '), '') AS name FROM sample_reviews),
        c AS (SELECT t.name, count(*) AS matches, list_sort(list(f.name)) AS c FROM t JOIN f ON t.name <> '' AND contains(lower(f.name), lower(t.name)) GROUP BY 1),
        x AS (SELECT t.name, CASE WHEN f.name IS NOT NULL THEN t.name WHEN matches = 1 THEN c[1] END AS facility, matches, c FROM t LEFT JOIN f ON f.name = t.name LEFT JOIN c ON c.name = t.name),
        y AS (SELECT x.*, CASE WHEN x.name = '' THEN 'not_found' WHEN facility IS NOT NULL AND f.n > 0 THEN 'ready' WHEN facility IS NOT NULL THEN 'empty' WHEN matches > 1 THEN 'ambiguous' ELSE 'new' END AS action FROM x LEFT JOIN f ON f.name = x.facility)
        SELECT name, action, facility, CASE WHEN action = 'ambiguous' THEN array_to_string(c[1:8], ' / ') END AS candidates FROM y""",
    "insert_subscores": """SELECT axis, count(*) AS inserted FROM (SELECT DISTINCT review_db_id, axis FROM review_subscore s WHERE id % 2 = 0 AND review_db_id IS NOT NULL AND axis IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM review_subscore h WHERE h.id % 2 <> 0 AND h.review_db_id = s.review_db_id AND h.axis = s.axis)) GROUP BY 1""",
}
