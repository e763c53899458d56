"""Queries on the texts of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicons
from ..functions.columns import contains_any_sql, fixed_sql, total_occurrences_sql
from ..functions.text import PLAIN_SPLIT, language, language_sql, ngrams_sql, tokens_sql, topic_sentences, topic_sentences_sql, trimmed, trimmed_sql
from ..operators import text_profile
from ..runtime import spread
from ..sources.tables import table

SHORT_CHARS = 10


def _texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "review").select("facility_id", "text", *columns).filter("text is not null and text <> '' and facility_id is not null"))


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder, "id").select("id", F.posexplode(topic_sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select("id", "pos", "sentence")


def language_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "review").filter("facility_id is not null").select("facility_id", language(F.col("text")).alias("language"))
    return text_profile.language_counts(rows)


def funnel(spark: SparkSession, folder: str) -> DataFrame:
    """From all reviews to those fit for topics, per facility, counted in one pass."""
    r = table(spark, folder, "review").filter("facility_id is not null").select("facility_id", "text", language(F.col("text")).alias("k"), F.length(trimmed(F.col("text"))).alias("chars"))
    ours = F.col("k").isin("ja", "mixed")
    usable = ours & (F.col("chars") >= SHORT_CHARS)
    pieces = F.size(F.filter(F.split("text", PLAIN_SPLIT), lambda s: F.length(trimmed(s)) >= 3))
    count = lambda c: F.count(F.when(c, 1))
    return r.groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("total"), count(F.col("k") != "empty").alias("with_text"), count(F.col("k") == "symbols").alias("symbols"), count(F.col("k") == "foreign").alias("foreign_texts"),
        count(F.col("k") == "mixed").alias("mixed"), count(ours).alias("japanese"), count(ours & (F.col("chars") < SHORT_CHARS)).alias("short"), count(usable).alias("usable"),
        F.coalesce(F.sum(F.when(usable, pieces)), F.lit(0)).alias("sentences"),
    )


def term_freq(spark: SparkSession, folder: str) -> DataFrame:
    return text_profile.term_frequency(_texts(spark, folder))


def tfidf_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return text_profile.keywords(text_profile.tfidf(term_freq(spark, folder)))


def bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return text_profile.phrases(_texts(spark, folder), 2)


def trigrams(spark: SparkSession, folder: str) -> DataFrame:
    return text_profile.phrases(_texts(spark, folder), 3)


def rated_samples(spark: SparkSession, folder: str) -> DataFrame:
    return text_profile.rated_samples(_texts(spark, folder, "id", "rating"))


def symbolic_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return text_profile.symbolic(_texts(spark, folder, "id"), tfidf_keywords(spark, folder))


def axis_scores(spark: SparkSession, folder: str) -> DataFrame:
    return text_profile.axis_scores(_texts(spark, folder, "rating"))


def axis_emphasis(spark: SparkSession, folder: str) -> DataFrame:
    return text_profile.axis_emphasis(_texts(spark, folder))


QUERIES = {f.__name__: f for f in (sentences, language_mix, funnel, term_freq, tfidf_keywords, bigrams, trigrams, rated_samples, symbolic_ranking, axis_scores, axis_emphasis)}

_T = "(SELECT * FROM review WHERE text IS NOT NULL AND text <> '' AND facility_id IS NOT NULL)"
_TF = f"(SELECT facility_id, term, count(*) AS tf FROM (SELECT facility_id, unnest({tokens_sql('text')}) AS term FROM {_T}) GROUP BY 1, 2)"
_KEYWORDS = f"""(SELECT facility_id, CAST(rank AS INT) AS rank, term, score FROM (
    SELECT facility_id, term, score, row_number() OVER (PARTITION BY facility_id ORDER BY score DESC, term) AS rank FROM (
        SELECT facility_id, term, {fixed_sql('(w / sqrt(sum(w * w) OVER (PARTITION BY facility_id)))', 6)} AS score FROM (
            SELECT t.facility_id, t.term, t.tf * (ln((1.0::DOUBLE + (SELECT count(DISTINCT facility_id) FROM {_TF})) / (1 + s.df)) + 1) AS w
            FROM {_TF} t JOIN (SELECT term, sum(tf) AS total, count(*) AS df FROM {_TF} GROUP BY term ORDER BY total DESC, term LIMIT 5000) s USING (term)))) WHERE rank <= 20)"""


def _phrases(n: int) -> str:
    return f"""SELECT facility_id, CAST(rank AS INT) AS rank, phrase, n FROM (
        SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY n DESC, phrase) AS rank FROM (
            SELECT facility_id, phrase, count(*) AS n FROM (SELECT facility_id, unnest({ngrams_sql('t', n)}) AS phrase FROM (SELECT facility_id, {tokens_sql('text')} AS t FROM {_T})) GROUP BY 1, 2))
        WHERE rank <= 20 AND n >= 2"""


_ONE_PER_AXIS = " UNION ALL ".join(f"SELECT facility_id, rating, text, '{a}' AS axis FROM {_T} WHERE {contains_any_sql('text', ws)}" for a, ws in lexicons.AXES.items())
_HITS = " UNION ALL ".join(
    f"SELECT facility_id, '{a}' AS axis, sum(len(list_filter({tokens_sql('text')}, lambda t: t IN ({', '.join(repr(w) for w in ws)})))) AS hits, count(*) FILTER ({contains_any_sql('text', ws)}) AS has FROM {_T} GROUP BY facility_id"
    for a, ws in lexicons.AXES.items()
)

SQL = {
    "sentences": f"SELECT id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS sentence FROM (SELECT id, {topic_sentences_sql('text')} AS s FROM {_T})",
    "language_mix": f"SELECT facility_id, {language_sql('text')} AS language, count(*) AS n FROM review WHERE facility_id IS NOT NULL GROUP BY 1, 2",
    "funnel": f"""SELECT facility_id, count(*) AS total, count(*) FILTER (k <> 'empty') AS with_text, count(*) FILTER (k = 'symbols') AS symbols, count(*) FILTER (k = 'foreign') AS foreign_texts, count(*) FILTER (k = 'mixed') AS mixed,
        count(*) FILTER (ours) AS japanese, count(*) FILTER (ours AND chars < 10) AS short, count(*) FILTER (ours AND chars >= 10) AS usable,
        CAST(coalesce(sum(len(list_filter(regexp_split_to_array(text, '[。！？\\n]+'), lambda s: length({trimmed_sql('s')}) >= 3))) FILTER (ours AND chars >= 10), 0) AS BIGINT) AS sentences
        FROM (SELECT *, k IN ('ja', 'mixed') AS ours FROM (SELECT facility_id, text, {language_sql('text')} AS k, length({trimmed_sql('text')}) AS chars FROM review WHERE facility_id IS NOT NULL)) GROUP BY facility_id""",
    "term_freq": f"SELECT * FROM {_TF}",
    "tfidf_keywords": f"SELECT * FROM {_KEYWORDS}",
    "bigrams": _phrases(2),
    "trigrams": _phrases(3),
    "rated_samples": f"""SELECT facility_id, side, CAST(rank AS INT) AS rank, id, rating FROM (
        SELECT facility_id, 'high' AS side, row_number() OVER (PARTITION BY facility_id ORDER BY rating DESC NULLS LAST, id) AS rank, id, rating FROM {_T}
        UNION ALL SELECT facility_id, 'low', row_number() OVER (PARTITION BY facility_id ORDER BY rating, id DESC), id, rating FROM {_T} WHERE rating < 4) WHERE rank <= 3""",
    "symbolic_ranking": f"""SELECT facility_id, id, score, share, n_keywords, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY score DESC, id) AS rank FROM (
            SELECT h.facility_id, h.id, {fixed_sql('s', 3)} AS score, {fixed_sql('(100 * s / a.total)', 1)} AS share, n_keywords FROM (
                SELECT t.facility_id, t.id, sum(k.score) AS s, count(*) AS n_keywords FROM (SELECT DISTINCT facility_id, id, unnest({tokens_sql('text')}) AS term FROM {_T}) t JOIN {_KEYWORDS} k USING (facility_id, term) GROUP BY 1, 2) h
            JOIN (SELECT facility_id, sum(score) AS total FROM {_KEYWORDS} GROUP BY 1) a USING (facility_id))) WHERE rank <= 5""",
    "axis_scores": f"""SELECT facility_id, axis, n, {fixed_sql('greatest(0.0::DOUBLE, least(100.0::DOUBLE, coalesce(stars / 5 * 100, 50.0::DOUBLE) * 0.7 + (50.0::DOUBLE + coalesce((p - q) / nullif(p + q, 0), 0) * 50) * 0.3))', 1)} AS score FROM (
        SELECT facility_id, axis, count(*) AS n, sum(rating) / count(rating) AS stars, sum({total_occurrences_sql('text', lexicons.AXIS_POSITIVE)})::DOUBLE AS p, sum({total_occurrences_sql('text', lexicons.AXIS_NEGATIVE)})::DOUBLE AS q FROM ({_ONE_PER_AXIS}) GROUP BY 1, 2)
        UNION ALL SELECT facility_id, '総合満足度', count(*), {fixed_sql('sum(rating) / count(rating) / 5 * 100', 1)} FROM {_T} WHERE rating IS NOT NULL GROUP BY 1""",
    "axis_emphasis": f"""SELECT facility_id, axis, {fixed_sql('(coalesce(raw / nullif(max(raw) OVER (PARTITION BY facility_id), 0), 0) * 100)', 1)} AS emphasis FROM (
        SELECT h.facility_id, h.axis, h.hits::DOUBLE / n.tokens * 100 + h.has::DOUBLE / n.n * 20 AS raw FROM ({_HITS}) h
        JOIN (SELECT facility_id, count(*) AS n, sum(len({tokens_sql('text')})) AS tokens FROM {_T} GROUP BY 1) n USING (facility_id) WHERE n.tokens > 0)""",
}
