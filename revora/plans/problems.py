"""Queries on training-data problems 1 to 4."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import nested, raw_records, salted, wide_table
from ..runtime import shared_dir, spread, written
from ..sources.tables import table

#: Fixed value: the share of all reviews above which a facility is reported.
HEAVY_FACILITY = 0.03
#: Batches in which a table is loaded into the log-structured store, by ranges of ids.
BATCHES = 2


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    parsed = raw_records.parse_records(spread(table(spark, folder, "sample_raw").select("rec_no", "raw")))
    return raw_records.rejected(parsed).select("rec_no", "reason")


def p1_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return raw_records.rejected(raw_records.parse_records(spread(table(spark, folder, "sample_raw").select("rec_no", "raw"))))


def p1_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return raw_records.loaded(raw_records.parse_records(spread(table(spark, folder, "sample_raw").select("rec_no", "raw"))))


def _definitions(spark: SparkSession, folder: str, tab: str) -> tuple[dict[str, str], dict[str, str]]:
    """(name key -> attribute, attribute -> value type) of one table; metric_def is a fixed table of a few rows."""
    rows = table(spark, folder, "metric_def").filter(F.col("held_in") == tab).collect()
    keys = wide_table.attribute_keys([(r["attr"], r["label_ja"], r["label_en"]) for r in rows])
    return keys, {r["attr"]: r["value_type"] for r in sorted(rows, key=lambda r: r["attr"])}


def _wide(spark: SparkSession, folder: str, tab: str, entity: str, name: str) -> tuple[DataFrame, dict[str, str]]:
    keys, types = _definitions(spark, folder, tab)
    rows = table(spark, folder, tab).select(entity, name, "value", "id")
    low, high = rows.agg(F.min("id"), F.max("id")).first()  # from the footers
    rows = wide_table.with_attribute(rows, name, keys)
    store = wide_table.LogStore(spark, f"{shared_dir(spark)}/wide-{tab}-{uuid.uuid4().hex}", types)
    step = ((high or 0) - (low or 0)) // BATCHES + 1
    for k in range(BATCHES if high is not None else 0):
        own = rows.filter(F.col("id").between(low + k * step, low + (k + 1) * step - 1))
        store.append(wide_table.delta(own, entity, "attr", "value", "id", types))
    written(spark, store.folder)
    return store.wide(), types


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for tab, entity, name in (("score", "facility_id", "metric_name"), ("review_subscore", "review_db_id", "axis")):
        wide, types = _wide(spark, folder, tab, entity, name)
        parts.append(wide_table.filled_cells(wide, types).select(F.lit(tab).alias("tab"), "entity_id", "attr", "cell"))
    return parts[0].unionByName(parts[1])


def p2_score_wide(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(spark, folder, "score", "facility_id", "metric_name")[0].withColumnRenamed("entity_id", "facility_id")


def p2_subscore_wide(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(spark, folder, "review_subscore", "review_db_id", "axis")[0].withColumnRenamed("entity_id", "review_db_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "review").select("facility_id", "id")
    return salted.keys_above(rows, "facility_id", "id", HEAVY_FACILITY).select("facility_id")


def p3_facility_results(spark: SparkSession, folder: str) -> DataFrame:
    """Per facility: reviews, rated reviews, sum and mean of ratings, reviewers, longest text, latest fetch."""
    rows = table(spark, folder, "review").select("facility_id", "id", "rating", "reviewer_name", "likes", F.length("text").alias("chars"), "fetched_at")
    out = salted.salted_aggregate(
        rows, "facility_id", "id",
        {"n": F.count(F.lit(1)), "rated": F.count("rating"), "stars": F.sum("rating"), "likes": F.sum("likes"), "longest": F.max("chars"), "latest": F.max("fetched_at")},
        {"n_reviews": F.sum("n"), "n_rated": F.sum("rated"), "sum_rating": F.sum("stars"), "sum_likes": F.sum("likes"), "longest_text": F.max("longest"), "latest_fetch": F.max("latest")},
        distinct={"n_reviewers": "reviewer_name"},
    )
    return out.withColumn("avg_rating", F.round(F.try_divide("sum_rating", "n_rated"), 6)).drop("sum_rating")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes, bridge = nested.flatten(spread(table(spark, folder, "sample_reviews").select("row_no", "review_details", "photos", "input")))
    return nested.child_rows(nodes, bridge)


def p4_shared_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct child records with their number of occurrences."""
    nodes, _ = nested.flatten(spread(table(spark, folder, "sample_reviews").select("row_no", "review_details", "photos", "input")))
    return nodes.select(F.lower(F.hex("node_id")).alias("node"), "content", "occurrences")


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_loaded, p2_found, p2_score_wide, p2_subscore_wide, p3_found, p3_facility_results, p4_found, p4_shared_nodes)}

SQL = {
    "p3_found": "SELECT facility_id FROM review WHERE facility_id IS NOT NULL GROUP BY facility_id HAVING count(*) > 0.03 * (SELECT count(*) FROM review)",
    "p3_facility_results": """
        SELECT facility_id, count(*) AS n_reviews, count(rating) AS n_rated, CAST(sum(likes) AS BIGINT) AS sum_likes, CAST(max(length(text)) AS INT) AS longest_text,
               max(fetched_at) AS latest_fetch, count(DISTINCT reviewer_name) AS n_reviewers, round(sum(rating) / nullif(count(rating), 0), 6) AS avg_rating
        FROM review GROUP BY facility_id""",
}
