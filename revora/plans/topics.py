"""Queries on sentiment and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicons
from ..functions.columns import fixed, fixed_sql, total_occurrences_sql
from ..functions.text import tokens_sql, topic_sentences_sql
from ..operators import compare, topic_model
from .texts import _T, _texts


def sentence_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    s = topic_model.sentences(_texts(spark, folder, "id"))
    return topic_model.with_sentiment(s).select("id", "pos", fixed(F.col("v"), 6).alias("v"))


def topic_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """The likeliest topic of every sentence that shares a term with a topic."""
    s = topic_model.scored_sentences(spark, _texts(spark, folder, "id"))
    top = F.array_max("p")
    return s.filter(top > 1.0 / len(lexicons.TOPICS) + 1e-9).select("id", "pos", fixed(top, 5).alias("chance"))


def topic_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _coarse(topic_model.topic_scores(topic_model.scored_sentences(spark, _texts(spark, folder, "id"))))


def _coarse(scores: DataFrame) -> DataFrame:
    return scores.select("facility_id", "topic", "n_reviews", *(fixed(F.col(c), 5).alias(c) for c in ("avg_score", "total_score", "salience", "sentiment")))


def weighted_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return topic_model.weighted_sentiment(topic_scores(spark, folder))


def salience_flags(spark: SparkSession, folder: str) -> DataFrame:
    n = topic_model.sentences(_texts(spark, folder, "id")).groupBy("facility_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    return topic_model.salience_flags(topic_scores(spark, folder), n)


def kpi_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Per facility and indicator: the plain mean of its topics' sentiments on a scale of 100."""
    bridge = F.broadcast(spark.createDataFrame([(t, k) for t, ks in lexicons.TOPIC_KPIS.items() for k in ks], "topic string, kpi string"))  # a fixed table
    s = topic_scores(spark, folder).withColumn("score", fixed(F.col("sentiment") * 100, 1))
    return s.join(bridge, "topic").groupBy("facility_id", "kpi").agg(F.count(F.lit(1)).alias("n_topics"), fixed(F.sum("score") / F.count("score"), 3).alias("score"))


def topic_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    m = topic_scores(spark, folder).select("facility_id", F.col("topic").alias("metric"), fixed(F.col("sentiment") * 100, 1).alias("score"))
    return compare.calibrated(m).select("facility_id", "metric", "score", fixed(F.col("calibrated"), 1).alias("calibrated"), "is_calibrated")


QUERIES = {f.__name__: f for f in (sentence_sentiment, topic_probabilities, topic_scores, weighted_sentiment, salience_flags, kpi_rollup, topic_calibrated)}

_N = len(lexicons.TOPICS)
_S = f"(SELECT facility_id, id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT facility_id, id, {topic_sentences_sql('text')} AS s FROM {_T}))"
_P, _Q = total_occurrences_sql("sentence", lexicons.POSITIVE), total_occurrences_sql("sentence", lexicons.NEGATIVE)
_V = f"""(SELECT facility_id, id, pos, sentence, (sign(net) * pow(abs(net), 0.7::DOUBLE) + 1) / 2 AS v FROM (SELECT *, (c - a) / (a + b + c) AS net FROM (
    SELECT *, pow(greatest((1 - m) * (1 - s) / 2, 1e-12), 1 / 0.7::DOUBLE) AS a, pow(greatest(m, 1e-12), 1 / 0.7::DOUBLE) AS b, pow(greatest((1 - m) * (s + 1) / 2, 1e-12), 1 / 0.7::DOUBLE) AS c FROM (
        SELECT *, greatest(0.1::DOUBLE, 1 - abs(s)) AS m FROM (SELECT *, (p - q) / (p + q + 1) AS s FROM (SELECT *, {_P}::DOUBLE AS p, {_Q}::DOUBLE AS q FROM {_S}))))))"""
_TOPIC_TERMS = "(VALUES " + ", ".join(f"({i}, '{t}', {n})" for i, t, n in topic_model.topic_terms()) + ") x(topic, term, times)"
_TOPIC_NAMES = "(VALUES " + ", ".join(f"({i}, '{t}', {w!r}::DOUBLE)" for i, (t, w) in enumerate(zip(lexicons.TOPICS, topic_model.topic_weights()))) + ") y(topic, name, weight)"
_CHANCES = f"""
    v AS MATERIALIZED (SELECT * FROM {_V}),
    terms AS MATERIALIZED (SELECT facility_id, id, pos, term, count(*) AS tf FROM (SELECT facility_id, id, pos, unnest({tokens_sql('sentence')}) AS term FROM v) GROUP BY ALL),
    n AS (SELECT facility_id, count(*) AS n FROM v GROUP BY 1),
    vocabulary AS MATERIALIZED (SELECT facility_id, term, ln((1.0::DOUBLE + n) / (1 + df)) + 1 AS idf FROM (
        SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY total DESC, term) AS rank FROM (SELECT facility_id, term, sum(tf) AS total, count(*) AS df FROM terms GROUP BY 1, 2)) JOIN n USING (facility_id) WHERE rank <= 1500),
    projected AS MATERIALIZED (SELECT facility_id, topic, term, times * idf AS tw FROM vocabulary JOIN {_TOPIC_TERMS} USING (term)),
    lengths AS (SELECT facility_id, topic, sqrt(sum(tw * tw)) AS t_len FROM projected GROUP BY 1, 2),
    weighted AS MATERIALIZED (SELECT t.*, tf * idf AS sw FROM terms t JOIN vocabulary USING (facility_id, term)),
    own AS (SELECT facility_id, id, pos, sqrt(sum(sw * sw)) AS s_len FROM weighted GROUP BY ALL),
    cosines AS (SELECT facility_id, id, pos, topic, dot / (s_len * t_len) / (1 + 1e-12) AS c FROM (SELECT facility_id, id, pos, topic, sum(sw * tw) AS dot FROM weighted JOIN projected USING (facility_id, term) GROUP BY ALL)
        JOIN own USING (facility_id, id, pos) JOIN lengths USING (facility_id, topic)),
    dense AS (SELECT v.facility_id, v.id, v.pos, v.v, t.topic, coalesce(c, 0.0::DOUBLE) AS c FROM v CROSS JOIN range({_N}) t(topic) LEFT JOIN cosines USING (facility_id, id, pos, topic)),
    logits AS (SELECT *, (c - mean) / (sd + 1e-6) / least(0.7::DOUBLE, greatest(0.05::DOUBLE, 0.3 / (sd + 1e-6))) AS z FROM (SELECT *, avg(c) OVER w AS mean, sqrt(avg(c * c) OVER w - avg(c) OVER w * avg(c) OVER w) AS sd0, stddev_pop(c) OVER w AS sd FROM dense WINDOW w AS (PARTITION BY id, pos))),
    soft AS (SELECT *, e / sum(e) OVER (PARTITION BY id, pos) AS p0 FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY id, pos)) AS e FROM logits)),
    chances AS MATERIALIZED (SELECT facility_id, id, pos, v, topic, b / sum(b) OVER (PARTITION BY id, pos) AS p FROM (SELECT *, p0 + greatest(p0 - 1.0::DOUBLE / {_N}, 0.0::DOUBLE) * 0.5 AS b FROM soft))"""
_CHANCES = _CHANCES.replace("sqrt(avg(c * c) OVER w - avg(c) OVER w * avg(c) OVER w) AS sd0, ", "")
_SCORES = f"""
    per_review AS (SELECT facility_id, id, topic, avg(v * p) AS s, avg(p) AS c FROM chances GROUP BY 1, 2, 3),
    scores AS (SELECT facility_id, name AS topic, weight, n_reviews, {fixed_sql(fixed_sql('s', 6), 5)} AS avg_score, {fixed_sql(fixed_sql('(s * weight)', 6), 5)} AS total_score, {fixed_sql(fixed_sql('c', 6), 5)} AS salience,
        {fixed_sql(fixed_sql('least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN c > 1e-9 THEN s / c ELSE 0.5 END))', 6), 5)} AS sentiment
        FROM (SELECT facility_id, topic, avg(s) AS s, avg(c) AS c, count(*) AS n_reviews FROM per_review GROUP BY 1, 2) JOIN {_TOPIC_NAMES} USING (topic))"""
_KPIS = "(VALUES " + ", ".join(f"('{t}', '{k}')" for t, ks in lexicons.TOPIC_KPIS.items() for k in ks) + ") k(topic, kpi)"
_HUNDRED = fixed_sql("(sentiment * 100)", 1)
_PCT = fixed_sql("(salience * 100)", 1)

SQL = {
    "sentence_sentiment": f"SELECT id, CAST(pos AS INT) AS pos, {fixed_sql('v', 6)} AS v FROM {_V}",
    "topic_probabilities": f"WITH {_CHANCES} SELECT id, CAST(pos AS INT) AS pos, {fixed_sql('max(p)', 5)} AS chance FROM chances GROUP BY id, pos HAVING max(p) > 1.0::DOUBLE / {_N} + 1e-9",
    "topic_scores": f"WITH {_CHANCES}, {_SCORES} SELECT facility_id, topic, n_reviews, avg_score, total_score, salience, sentiment FROM scores",
    "weighted_sentiment": f"WITH {_CHANCES}, {_SCORES} SELECT facility_id, {fixed_sql('(sum(sentiment * weight) * 100)', 1)} AS weighted_sentiment, {fixed_sql('(sum(total_score) * 100)', 1)} AS overall FROM scores GROUP BY 1",
    "salience_flags": f"""WITH {_CHANCES}, {_SCORES} SELECT facility_id, topic, pct AS salience_pct, CAST(round(n * pct / 100) AS INT) AS mentions, pct <= 0 AS unmeasured, pct <= 100.0::DOUBLE / {_N} AS thin
        FROM (SELECT facility_id, topic, {_PCT} AS pct FROM scores) JOIN n USING (facility_id)""",
    "kpi_rollup": f"WITH {_CHANCES}, {_SCORES} SELECT facility_id, kpi, count(*) AS n_topics, {fixed_sql('(sum(h) / count(h))', 3)} AS score FROM (SELECT facility_id, topic, {_HUNDRED} AS h FROM scores) JOIN {_KPIS} USING (topic) GROUP BY 1, 2",
    "topic_calibrated": f"""WITH {_CHANCES}, {_SCORES}, m AS (SELECT facility_id, topic AS metric, {_HUNDRED} AS score FROM scores),
        t AS (SELECT metric, {fixed_sql('avg(score)', 4)} AS mean, {fixed_sql('greatest(stddev_pop(score), 1.0::DOUBLE)', 4)} AS spread FROM m GROUP BY metric HAVING count(DISTINCT facility_id) >= 8)
        SELECT facility_id, metric, score, {fixed_sql('coalesce(least(5.0::DOUBLE, greatest(1.0::DOUBLE, 3.0 + (score - mean) / spread * 0.5)) * 20, score)', 1)} AS calibrated, mean IS NOT NULL AS is_calibrated FROM m LEFT JOIN t USING (metric)""",
}
