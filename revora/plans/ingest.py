"""Queries on intake, vectors and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import fixed, fixed_sql, utc_time, utc_time_sql
from ..operators import ingest, vectors
from ..sources.tables import table
from ..streaming import events as streams

#: Reviews fetched before this day count as held, later ones as a new batch.
CUT = "2025-01-01"
BUDGET, LIMIT = 2000, 20
PROFILED = ["place_name", "review_rating", "review_date", "number_of_likes", "local_guide", "photos_by_reviewer", "place_general_rating", "category"]


def _export(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.records(table(spark, folder, "sample_reviews"))


def review_records(spark: SparkSession, folder: str) -> DataFrame:
    return _export(spark, folder).select("row_no", "facility_key", "rating", "local_guide", "likes", "general_rating", "total_reviews")


def infer_facilities(spark: SparkSession, folder: str) -> DataFrame:
    f = ingest.infer_facilities(_export(spark, folder))
    return f.select("facility_key", "name", "n", fixed(F.try_divide("stars", "rated"), 2).alias("avg_rating"), "general_rating", "total_reviews", "category")


def surrogate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Substitute ids for every review of the export, as if none had an id."""
    bare = _export(spark, folder).withColumn("review_id", F.lit(""))
    return ingest.with_ids(bare).select("row_no", "facility_key", "review_id")


def _batches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, folder, "review").select("id", "facility_id", ingest.known_or_substitute(), "fetched_at")
    early = F.col("fetched_at") < F.lit(CUT).cast("timestamp_ntz")
    return r.filter(early), r.filter(~early)


def dedup_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Per facility: reviews of the new batch inserted and skipped."""
    held, batch = _batches(spark, folder)
    inserted = ingest.new_rows(batch, held, ["facility_id", "review_id"], "id").groupBy("facility_id").agg(F.count(F.lit(1)).alias("inserted"))
    n = batch.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(inserted, "facility_id", "left").select("facility_id", F.coalesce("inserted", F.lit(0)).alias("inserted"), (F.col("n") - F.coalesce("inserted", F.lit(0))).alias("skipped"))


def upsert_facility(spark: SparkSession, folder: str) -> DataFrame:
    held = table(spark, folder, "facility").select("name", "category", "general_rating", "total_reviews")
    new = ingest.infer_facilities(_export(spark, folder)).filter("name <> '(unknown)'").groupBy("name").agg(*(F.max(c).alias(c) for c in ("category", "general_rating", "total_reviews")))
    return ingest.upsert(held, new, "name")


def upsert_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "score").select("facility_id", "metric_name", "source", "id", "value", "scale")
    return ingest.latest(s, ["facility_id", "metric_name", "source"], "id")


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the sub-scores when the target facilities are deleted with their reviews."""
    gone = table(spark, folder, "facility").filter("ftype = 'target'").select(F.col("id").alias("facility_id"))
    r = table(spark, folder, "review").select(F.col("id").alias("review_db_id"), "facility_id")
    reviews = r.join(gone, "facility_id", "left_semi").select("review_db_id")
    return ingest.without(table(spark, folder, "review_subscore").select("id", "review_db_id", "axis"), reviews, "review_db_id").groupBy("axis").agg(F.count(F.lit(1)).alias("n"))


def ledger_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of each kind and month, and the total so far."""
    from pyspark.sql import Window

    e = table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("kind"))
    m = e.groupBy("day", "kind").agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("so_far", F.sum("n").over(Window.partitionBy("kind").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def budgeted_sync(spark: SparkSession, folder: str) -> DataFrame:
    available = table(spark, folder, "review").filter("facility_id is not null").groupBy(F.col("facility_id").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    return ingest.budgeted(available, BUDGET)


def sync_plan(spark: SparkSession, folder: str) -> DataFrame:
    b = budgeted_sync(spark, folder)
    return b.agg(F.sum("n").alias("available"), F.sum("fetched").alias("will_fetch"), (F.sum("n") - F.sum("fetched")).alias("shortfall"), (F.sum("n") > BUDGET).alias("exceeds"), F.sum(F.col("advances").cast("bigint")).alias("complete"))


def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.column_profile(table(spark, folder, "sample_reviews"), PROFILED)


def url_parse(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "sample_reviews").filter("url is not null and url <> ''")
    return u.select("row_no", F.parse_url("url", F.lit("HOST")).alias("host"), ingest.name_in_url(F.col("url")).alias("name"))


def newest_n_per_facility(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "review").select("facility_id", "id", utc_time(F.col("review_date")).alias("at")).filter("facility_id is not null")
    return ingest.newest(r, "facility_id", F.col("at"), LIMIT, "id").select("facility_id", "id")


def onboarding(spark: SparkSession, folder: str) -> DataFrame:
    """What to do with each typed place: ready, registered without reviews, or new."""
    f = table(spark, folder, "facility").select(F.col("id").alias("facility_id"), "name")
    n = table(spark, folder, "review").groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"))
    typed = table(spark, folder, "sample_reviews").select(F.trim("place_name").alias("name")).filter("name <> ''").distinct()
    j = typed.join(f, "name", "left").join(n, "facility_id", "left")
    return j.select("name", F.when(F.col("facility_id").isNull(), "new").when(F.coalesce("n", F.lit(0)) > 0, "ready").otherwise("empty").alias("decision"))


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.units(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors to every vector whose id is divisible by 50."""
    u = _units(spark, folder)
    return vectors.nearest(u.filter("vec_id % 50 = 0"), u, 5).select("query", "rank", "neighbour", F.round("cosine", 5).alias("cosine"))


def cluster_medoids(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.medoids(_units(spark, folder), 64).select("label", "n", "medoid", F.round("mean_cosine", 5).alias("mean_cosine"))


def canonical_labels(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.canonical(vectors.medoids(_units(spark, folder), 64))


def prototype_membership(spark: SparkSession, folder: str) -> DataFrame:
    u = _units(spark, folder)
    return vectors.memberships(u, vectors.centroids(u, 64)).select("vec_id", "label", fixed(F.col("membership"), 4).alias("membership"))


def absorb_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth vector taken as noise and absorbed again."""
    u = _units(spark, folder).withColumn("label", F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("label")))
    return vectors.absorb(u, 64).withColumnRenamed("to", "label")


def hdbscan_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Density-based clusters within each label, of any size; a label is one task, whose time grows with the square of its vectors."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("vec_id")
        least = max(2, min(12, round(0.7 * len(pdf) ** 0.5)))
        return pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "cluster": vectors.density_clusters(np.stack(pdf["u"].to_numpy()), least)})

    return _units(spark, folder).groupBy("label").applyInPandas(run, "vec_id bigint, label int, cluster int")


def principal_components(spark: SparkSession, folder: str) -> DataFrame:
    u = vectors.principal(_units(spark, folder), 64, most=4)
    return u.select("vec_id", F.transform("u", lambda x: F.round(x, 6)).alias("components"))


def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    """Order features of every customer, groups scaled by weight."""
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("vec_id")).agg(F.count(F.lit(1)).alias("orders"), F.avg("o_totalprice").alias("price"), F.max("o_totalprice").alias("top"))
    u = vectors.group_scaled(o, {"amount": (["price", "top"], 3.0), "frequency": (["orders"], 1.0)}, "vec_id")
    return u.select("vec_id", F.transform("u", lambda x: F.round(x, 6)).alias("scaled"))


def kmeans_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Five clusters of review texts by TF-IDF, with their sizes and three commonest terms."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    from ..functions.text import tokens
    from .texts import _texts

    rows = _texts(spark, folder, "id").select("id", tokens(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
    tf = HashingTF(inputCol="terms", outputCol="tf", numFeatures=2048).transform(rows)
    x = Normalizer(inputCol="x0", outputCol="features").transform(IDF(inputCol="tf", outputCol="x0").fit(tf).transform(tf))
    found = KMeans(k=5, seed=42, maxIter=10).fit(x.select("features")).transform(x)
    n = found.groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    terms = found.select(F.col("prediction").alias("cluster"), F.explode("terms").alias("term")).groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("k"))
    from pyspark.sql import Window

    top = terms.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("k"), "term"))).filter("r <= 3").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]), " ").alias("name"))
    return n.join(top, "cluster")


def stream_dedup_counts(spark: SparkSession, folder: str) -> DataFrame:
    return streams.daily_counts(spark, folder)


QUERIES = {f.__name__: f for f in (
    review_records, infer_facilities, surrogate_ids, dedup_reviews, upsert_facility, upsert_scores, cascade_delete, ledger_monthly, budgeted_sync, sync_plan, column_profile, url_parse,
    newest_n_per_facility, onboarding, cosine_topk, cluster_medoids, canonical_labels, prototype_membership, absorb_noise, hdbscan_labels, principal_components, scaled_features, kmeans_topics, stream_dedup_counts,
)}

_num = lambda c: f"(CASE WHEN regexp_matches(trim({c}, ' '), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast(trim({c}, ' ') AS DOUBLE) END)"
_whole = lambda c: f"CAST(trunc({_num(c)}) AS BIGINT)"
_query = lambda u: f"regexp_replace(url_decode(regexp_extract({u}, '[?&]query=([^&#]*)', 1)), '^[ 　]+|[ 　]+$', '', 'g')"
_urlname = lambda u: f"coalesce(nullif(regexp_extract({_query(u)}, '^(.+?)[ 　,、]*(?:{'|'.join(ingest.PREFECTURES)})', 1), ''), regexp_extract({_query(u)}, '^([^ 　]*)', 1))"
_INPUT_URL = """nullif(regexp_extract(coalesce(input, ''), '(?s)^\\s*\\{.*?[''"]url[''"]\\s*:\\s*[''"]([^''"]*)[''"].*\\}\\s*$', 1), '')"""
_RECORDS = f"""(SELECT row_no, coalesce(nullif(place_id, ''), nullif(cid, ''), nullif(fname, ''), '(unknown)') AS facility_key, fname AS facility_name, coalesce(review, '') AS text, coalesce(review_date, '') AS review_date, coalesce(reviewer_name, '') AS reviewer_name,
    {_num("review_rating")} AS rating, CAST(lower(coalesce(local_guide, '')) IN ('true', '1', 'yes') AS INT) AS local_guide, {_whole("number_of_likes")} AS likes, {_num("place_general_rating")} AS general_rating, {_whole("overall_place_riviews")} AS total_reviews, coalesce(category, '') AS category
    FROM (SELECT *, coalesce(nullif(place_name, ''), nullif({_urlname(f"coalesce({_INPUT_URL}, url, '')")}, ''), '') AS fname FROM sample_reviews
        WHERE coalesce(error, '') = '' AND coalesce(error_code, '') = '' AND (coalesce(review, '') <> '' OR coalesce(review_rating, '') <> '')))"""
_FACILITIES = f"""(SELECT a.facility_key, coalesce(b.name, '(unknown)') AS name, n, stars, rated, general_rating, total_reviews, category FROM (
    SELECT facility_key, count(*) AS n, sum(rating) AS stars, count(rating) AS rated, arg_min(general_rating, row_no) FILTER (general_rating IS NOT NULL) AS general_rating,
           arg_min(total_reviews, row_no) FILTER (total_reviews IS NOT NULL) AS total_reviews, arg_min(category, row_no) FILTER (category <> '') AS category FROM {_RECORDS} GROUP BY 1) a
    LEFT JOIN (SELECT facility_key, facility_name AS name FROM (SELECT facility_key, facility_name, count(*) AS k, min(row_no) AS first FROM {_RECORDS} WHERE facility_name <> '' GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY facility_key ORDER BY k DESC, first) = 1) b USING (facility_key))"""
_ID = "coalesce(nullif(review_id, ''), 'h:' || left(sha1(coalesce(text, '') || '|' || coalesce(review_date, '') || '|' || coalesce(reviewer_name, '')), 16))"
_HELD = f"(SELECT facility_id, {_ID} AS review_id FROM review WHERE fetched_at < TIMESTAMP '{CUT}')"
_BATCH = f"(SELECT id, facility_id, {_ID} AS review_id FROM review WHERE fetched_at >= TIMESTAMP '{CUT}')"
_BUDGET = f"""(SELECT dataset, n, CAST(least(n, budget_left) AS BIGINT) AS fetched, least(n, budget_left) < n AND budget_left > 0 AS truncated, least(n, budget_left) = n AS advances FROM (
    SELECT dataset, n, greatest(0, {BUDGET} - coalesce(sum(n) OVER (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS budget_left FROM (SELECT facility_id AS dataset, count(*) AS n FROM review WHERE facility_id IS NOT NULL GROUP BY 1)))"""
_U = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings WHERE list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) > 0)"
_C = f"(SELECT label, count(*) AS n, [{', '.join(f'sum(u[{i}])' for i in range(1, 65))}] AS c FROM {_U} GROUP BY label)"
_MEDOIDS = f"(SELECT label, n, vec_id AS medoid, round(mean, 6) AS mean_cosine FROM (SELECT u.label, n, vec_id, round(list_inner_product(u, c) / n, 9) AS mean FROM {_U} u JOIN {_C} USING (label)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY mean DESC, vec_id) = 1)"

SQL = {
    "review_records": f"SELECT row_no, facility_key, rating, local_guide, likes, general_rating, total_reviews FROM {_RECORDS}",
    "infer_facilities": f"SELECT facility_key, name, n, {fixed_sql('(stars / nullif(rated, 0))', 2)} AS avg_rating, general_rating, total_reviews, category FROM {_FACILITIES}",
    "surrogate_ids": f"""SELECT row_no, facility_key, h || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS review_id FROM (
        SELECT *, row_number() OVER (PARTITION BY facility_key, h ORDER BY row_no) AS k FROM (SELECT row_no, facility_key, 'h:' || left(sha1(text || '|' || review_date || '|' || reviewer_name), 16) AS h FROM {_RECORDS}))""",
    "dedup_reviews": f"""SELECT facility_id, coalesce(inserted, 0) AS inserted, n - coalesce(inserted, 0) AS skipped FROM (SELECT facility_id, count(*) AS n FROM {_BATCH} GROUP BY 1)
        LEFT JOIN (SELECT facility_id, count(DISTINCT review_id) AS inserted FROM {_BATCH} b WHERE NOT EXISTS (SELECT 1 FROM {_HELD} h WHERE h.facility_id = b.facility_id AND h.review_id = b.review_id) GROUP BY 1) USING (facility_id)""",
    "upsert_facility": f"""SELECT coalesce(b.name, a.name) AS name, coalesce(b.category, a.category) AS category, coalesce(b.general_rating, a.general_rating) AS general_rating, coalesce(b.total_reviews, a.total_reviews) AS total_reviews
        FROM facility a FULL JOIN (SELECT name, max(category) AS category, max(general_rating) AS general_rating, max(total_reviews) AS total_reviews FROM {_FACILITIES} WHERE name <> '(unknown)' GROUP BY 1) b ON a.name = b.name""",
    "upsert_scores": "SELECT facility_id, metric_name, source, id, value, scale FROM score QUALIFY row_number() OVER (PARTITION BY facility_id, metric_name, source ORDER BY id DESC) = 1",
    "cascade_delete": """SELECT axis, count(*) AS n FROM review_subscore s WHERE NOT EXISTS (SELECT 1 FROM review r JOIN facility f ON f.id = r.facility_id WHERE f.ftype = 'target' AND r.id = s.review_db_id) GROUP BY axis""",
    "ledger_monthly": """SELECT day, kind, n, CAST(sum(n) OVER (PARTITION BY kind ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2)""",
    "budgeted_sync": f"SELECT * FROM {_BUDGET}",
    "sync_plan": f"SELECT CAST(sum(n) AS BIGINT) AS available, CAST(sum(fetched) AS BIGINT) AS will_fetch, CAST(sum(n) - sum(fetched) AS BIGINT) AS shortfall, sum(n) > {BUDGET} AS exceeds, CAST(sum(advances::INT) AS BIGINT) AS complete FROM {_BUDGET}",
    "column_profile": " UNION ALL ".join(f"""SELECT '{c}' AS "column", filled, {fixed_sql('(100.0::DOUBLE * filled / rows)', 1)} AS filled_pct, n_distinct, numbers > greatest(rows * 0.3, 1) AS numeric,
        CASE WHEN numbers > greatest(rows * 0.3, 1) THEN {fixed_sql('(total / numbers)', 2)} END AS mean, CASE WHEN numbers > greatest(rows * 0.3, 1) THEN least END AS least, CASE WHEN numbers > greatest(rows * 0.3, 1) THEN greatest END AS greatest
        FROM (SELECT count(*) AS rows, count(v) AS filled, count(DISTINCT v) AS n_distinct, count({_num('v')}) AS numbers, sum({_num('v')}) AS total, min({_num('v')}) AS least, max({_num('v')}) AS greatest FROM (SELECT nullif(trim({c}, ' '), '') AS v FROM sample_reviews))""" for c in PROFILED),
    "url_parse": f"SELECT row_no, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, {_urlname('url')} AS name FROM sample_reviews WHERE url IS NOT NULL AND url <> ''",
    "newest_n_per_facility": f"SELECT facility_id, id FROM (SELECT facility_id, id, {utc_time_sql('review_date')} AS day_at FROM review WHERE facility_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY day_at DESC NULLS LAST, id) <= {LIMIT}",
    "onboarding": """SELECT t.name, CASE WHEN f.id IS NULL THEN 'new' WHEN coalesce(n.n, 0) > 0 THEN 'ready' ELSE 'empty' END AS decision FROM (SELECT DISTINCT trim(place_name, ' ') AS name FROM sample_reviews WHERE trim(place_name, ' ') <> '') t
        LEFT JOIN facility f ON f.name = t.name LEFT JOIN (SELECT facility_id, count(*) AS n FROM review GROUP BY 1) n ON n.facility_id = f.id""",
    "cosine_topk": f"""SELECT query, CAST(rank AS INT) AS rank, neighbour, round(cosine, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour) AS rank FROM (
        SELECT q.vec_id AS query, c.vec_id AS neighbour, round(list_inner_product(q.u, c.u), 9) AS cosine FROM {_U} q JOIN {_U} c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= 5""",
    "cluster_medoids": f"SELECT label, n, medoid, round(mean_cosine, 5) AS mean_cosine FROM {_MEDOIDS}",
    "canonical_labels": f"SELECT label, n, medoid, CAST(row_number() OVER (ORDER BY medoid, n DESC) - 1 AS INT) AS canonical FROM {_MEDOIDS}",
    "prototype_membership": f"""SELECT vec_id, label, {fixed_sql('(e / sum(e) OVER (PARTITION BY vec_id))', 4)} AS membership FROM (SELECT vec_id, label, exp((z - max(z) OVER (PARTITION BY vec_id))) AS e FROM (
        SELECT u.vec_id, c.label, list_inner_product(u.u, c.c) / sqrt(list_inner_product(c.c, c.c)) / 0.15 AS z FROM {_U} u CROSS JOIN {_C} c))""",
    "stream_dedup_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
