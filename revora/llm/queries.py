"""Queries on the problems of training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import spread
from ..sources.tables import table
from . import fusion, leak, mojibake, names, stuffing, survivor, tokenize


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    facility = table(spark, folder, "facility").select(F.col("id").alias("facility_id"), "name")
    typed = table(spark, folder, "sample_reviews").select(F.col("row_no").alias("rec_id"), F.col("place_name").alias("name"))
    roots, links = names.linked(facility, typed)
    registered = roots.filter("facility_id <> root").select(F.col("root").alias("facility_id"), F.lit("facility").alias("tab"), F.col("facility_id").alias("rec_id"))
    first = facility.select(F.col("facility_id").alias("root"), F.col("name").alias("first_name"))
    rows = links.join(first, "root").filter(~F.col("name").eqNullSafe(F.col("first_name")))
    return registered.unionByName(rows.select(F.col("root").alias("facility_id"), F.lit("sample_reviews").alias("tab"), "rec_id"))


def _review_texts(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "review").select(F.lit("review").alias("tab"), F.col("id").alias("rec_id"), "text")
    b = table(spark, folder, "sample_reviews").select(F.lit("sample_reviews").alias("tab"), F.col("row_no").alias("rec_id"), F.col("review").alias("text"))
    return a.unionByName(b)


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every damaged text with its encoding chains and what could be restored."""
    texts = _review_texts(spark, folder)
    return mojibake.damaged(spread(texts), mojibake.fit(texts), {"tab": "string", "rec_id": "bigint"})


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_restored(spark, folder).select("tab", "rec_id")


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "review").select("id", "facility_id", "review_id", "reviewer_name", "review_date", "text", "owner_response", "likes", "fetched_at")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion whose prior for the stated preferences exceeds every sum of votes."""
    return fusion.fused(_copies(spark, folder), trust=fusion.STATED).select("first_id", "field", "keep_id")


def p7_fused(spark: SparkSession, folder: str) -> DataFrame:
    """The most probable value of each field, where votes may outweigh the preferences."""
    rows = _copies(spark, folder)
    return fusion.with_values(fusion.fused(rows), rows)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_corpus(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds an item, with the share of the item it holds."""
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return leak.leaked(documents, table(spark, folder, "eval_items").select("item_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_shares(spark, folder).select("doc_id", "item_id")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of words in prose, link lists, tag lists and menus, of every page with words."""
    return stuffing.fitted_shares(table(spark, folder, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.flagged(p10_shares(spark, folder)).select("doc_id")


QUERIES = {f.__name__: f for f in (p5_found, p6_found, p6_restored, p7_found, p7_fused, p8_ids, p9_found, p9_shares, p10_found, p10_shares)}

_SPACES = survivor.SPACE.replace("'", "''")
_strip = lambda c: f"trim({c}, '{_SPACES}')"
_DAY = r"'^\s*([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})($|[^0-9])'"
_day = lambda i: f"lpad(regexp_extract(review_date, {_DAY}, {i}), 2, '0')"

SQL: dict[str, str] = {
    "p7_found": f"""
        WITH RECURSIVE k AS (
            SELECT *, vid IS NOT NULL AND vid <> '' AND NOT starts_with(vid, 'h:') AS real FROM (SELECT id, facility_id, text, owner_response, likes, fetched_at, reviewer_name, {_strip('review_id')} AS vid,
                CASE WHEN regexp_matches(review_date, {_DAY}) THEN regexp_extract(review_date, {_DAY}, 1) || '-' || {_day(2)} || '-' || {_day(3)} END AS day FROM review)),
        p AS (SELECT *, coalesce(v, c) AS part FROM (SELECT *, CASE WHEN real AND facility_id IS NOT NULL THEN 'v' || facility_id || chr(31) || vid END AS v,
            CASE WHEN facility_id IS NOT NULL AND {_strip('reviewer_name')} <> '' AND day IS NOT NULL AND {_strip('text')} <> '' THEN 'c' || concat_ws(chr(31), facility_id::VARCHAR, reviewer_name, day, text) END AS c FROM k)
            WHERE coalesce(v, c) IS NOT NULL),
        one AS (SELECT DISTINCT a.part AS x, b.part AS y FROM p a JOIN p b ON a.v IS NOT NULL AND a.c = b.part),
        edges AS (SELECT x, y FROM one UNION SELECT y, x FROM one),
        reach AS (SELECT x AS part, x AS other FROM edges UNION SELECT e.y, r.other FROM reach r JOIN edges e ON e.x = r.part),
        roots AS (SELECT part, min(other) AS root FROM reach GROUP BY 1),
        g AS (SELECT p.*, min(id) OVER w AS first_id, count(*) OVER w AS n FROM p LEFT JOIN roots USING (part) WINDOW w AS (PARTITION BY coalesce(root, part))),
        f AS (SELECT first_id, 'review_id' AS field, id, 0 AS a, fetched_at FROM g WHERE n >= 2 AND real
            UNION ALL SELECT first_id, 'text', id, length({_strip('text')}), fetched_at FROM g WHERE n >= 2 AND {_strip('text')} <> ''
            UNION ALL SELECT first_id, 'owner_response', id, 0, fetched_at FROM g WHERE n >= 2 AND {_strip('owner_response')} <> ''
            UNION ALL SELECT first_id, 'likes', id, 0, fetched_at FROM g WHERE n >= 2 AND likes IS NOT NULL)
        SELECT first_id, field, id AS keep_id FROM f QUALIFY row_number() OVER (PARTITION BY first_id, field ORDER BY a DESC, fetched_at DESC NULLS LAST, id) = 1""",
}
