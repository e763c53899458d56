"""Sentences scored by sentiment and topic, and their means per review and facility.

Each facility has a TF-IDF space of its own, fitted on its sentences; topics
are projected into it as lists of their words.  Only terms a sentence shares
with a topic are joined, on the term; a sentence that shares none has equal
chances for all topics.  The chances of a sentence are one array, so the
softmax runs inside one row.

Defined results: null and blank texts have no sentences; facilities without
sentences have no rows; ties in the vocabulary go to the smaller term.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import lexicons
from ..functions.columns import fixed, total_occurrences
from ..functions.text import TOKEN, tokens, topic_sentences

VOCABULARY, BOOST, SHARPNESS, BEND = 1500, 0.5, 0.7, 0.7


def with_sentiment(found: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Adds ``v``, the sentiment of a sentence between 0 and 1: word counts to three chances, sharpened, bent; 0.5 is neutral.

    Words are counted in a projection of its own, so that each count is made once.
    """
    text = F.col(sentence)
    counted = found.withColumns({"_p": total_occurrences(text, lexicons.POSITIVE), "_q": total_occurrences(text, lexicons.NEGATIVE)})
    s = counted.withColumn("_s", (F.col("_p") - F.col("_q")) / (F.col("_p") + F.col("_q") + 1)).withColumn("_m", F.greatest(F.lit(0.1), 1 - F.abs("_s")))
    sharp = lambda c: F.pow(F.greatest(c, F.lit(1e-12)), F.lit(1 / SHARPNESS))
    m, n = F.col("_m"), F.col("_s")
    s = s.withColumns({"_a": sharp((1 - m) * (1 - n) / 2), "_b": sharp(m), "_c": sharp((1 - m) * (n + 1) / 2)})
    net = s.withColumn("_net", (F.col("_c") - F.col("_a")) / (F.col("_a") + F.col("_b") + F.col("_c")))
    return net.withColumn("v", (F.signum("_net") * F.pow(F.abs("_net"), F.lit(BEND)) + 1) / 2).drop("_p", "_q", "_s", "_m", "_a", "_b", "_c", "_net")


def topic_terms() -> list[tuple[int, str, int]]:
    """(topic, term, times): every topic's words as the tokenizer sees them, a word without tokens as itself."""
    counts: dict[tuple[int, str], int] = {}
    for i, (words, _) in enumerate(lexicons.TOPICS.values()):
        for w in words:
            for t in re.findall(TOKEN, w.lower()) or [w.lower()]:
                counts[i, t] = counts.get((i, t), 0) + 1
    return [(i, t, n) for (i, t), n in counts.items()]


def topic_weights() -> list[float]:
    total = sum(w for _, w in lexicons.TOPICS.values())
    return [w / total for _, w in lexicons.TOPICS.values()]


def sentences(texts: DataFrame) -> DataFrame:
    """(facility_id, id, pos, sentence) of texts (facility_id, id, text)."""
    return texts.select("facility_id", "id", F.posexplode(topic_sentences(F.col("text"))).alias("pos", "sentence"))


def cosines(spark: SparkSession, found: DataFrame) -> DataFrame:
    """(facility_id, id, pos, cos): the cosine of a sentence to every topic, of sentences that share a term with one.

    The terms of all sentences are joined to the vocabulary once and gathered
    back per sentence; the topics' share of it is a lookup in the lexicon.
    """
    terms = found.select("facility_id", "id", "pos", F.explode(tokens(F.col("sentence"))).alias("term")).groupBy("facility_id", "id", "pos", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = found.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"))
    stats = terms.groupBy("facility_id", "term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("facility_id").orderBy(F.desc("total"), "term")
    vocabulary = stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= VOCABULARY).join(n, "facility_id")
    vocabulary = vocabulary.select("facility_id", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    by_term: dict[str, list[tuple[int, int]]] = {}
    for topic, term, times in topic_terms():
        by_term.setdefault(term, []).append((topic, times))
    topics = F.broadcast(spark.createDataFrame(list(by_term.items()), "term string, topics array<struct<topic:int,times:int>>"))  # the lexicon, a fixed size
    length = vocabulary.join(topics, "term").select("facility_id", "idf", F.explode("topics").alias("t")).groupBy("facility_id", F.col("t.topic").alias("topic"))
    length = length.agg(F.sqrt(F.sum(F.pow(F.col("t.times") * F.col("idf"), F.lit(2.0)))).alias("size")).groupBy("facility_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "size"))).alias("sizes"))
    weighted = terms.join(vocabulary, ["facility_id", "term"]).join(topics, "term", "left").withColumn("w", F.col("tf") * F.col("idf"))
    shared = F.transform("topics", lambda t: F.struct(t["topic"].alias("topic"), (F.col("w") * F.col("idf") * t["times"]).alias("d")))
    gathered = weighted.groupBy("facility_id", "id", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.flatten(F.collect_list(shared)).alias("parts")).filter(F.size("parts") > 0)
    k = F.sequence(F.lit(0), F.lit(len(lexicons.TOPICS) - 1))
    product = lambda i: F.aggregate(F.filter("parts", lambda p: p["topic"] == i), F.lit(0.0), lambda s, p: s + p["d"])
    cos = F.transform(k, lambda i: F.coalesce(F.try_divide(product(i), F.col("size") * F.try_element_at("sizes", i)) / (1 + 1e-12), F.lit(0.0)))
    return gathered.join(length, "facility_id").select("facility_id", "id", "pos", cos.alias("cos"))


def chances(cos: Column) -> Column:
    """The chance of every topic, from the cosines to them; equal chances where they are null."""
    n = len(lexicons.TOPICS)
    cos = F.coalesce(cos, F.array_repeat(F.lit(0.0), n))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return _with(cos, lambda c: _with(add(c) / n, lambda mean: _with(F.sqrt(add(F.transform(c, lambda x: (x - mean) * (x - mean))) / n), lambda sd: _softmax(
        F.transform(c, lambda x: (x - mean) / (sd + 1e-6) / F.least(F.lit(0.7), F.greatest(F.lit(0.05), 0.3 / (sd + 1e-6)))), n))))


def _with(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _softmax(logits: Column, n: int) -> Column:
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return _with(logits, lambda z: _with(_with(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))), lambda e: _with(add(e), lambda t: _with(
        F.transform(e, lambda x: x / t + F.greatest(x / t - 1.0 / n, F.lit(0.0)) * BOOST), lambda b: _with(add(b), lambda u: F.transform(b, lambda x: x / u))))))


def scored_sentences(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(facility_id, id, pos, v, p): sentiment and topic chances of every sentence."""
    found = sentences(texts)
    felt = with_sentiment(found).select("facility_id", "id", "pos", "v")
    return felt.join(cosines(spark, found), ["facility_id", "id", "pos"], "left").select("facility_id", "id", "pos", "v", F.when(F.col("cos").isNull(), F.array_repeat(F.lit(1.0 / len(lexicons.TOPICS)), len(lexicons.TOPICS))).otherwise(chances(F.col("cos"))).alias("p"))


def topic_scores(scored: DataFrame) -> DataFrame:
    """Per facility and topic: score, salience and sentiment; means over sentences per review, then over reviews."""
    k = range(len(lexicons.TOPICS))
    per_review = scored.groupBy("facility_id", "id").agg(*(F.avg(F.col("v") * F.col("p")[i]).alias(f"s{i}") for i in k), *(F.avg(F.col("p")[i]).alias(f"c{i}") for i in k))
    wide = per_review.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n_reviews"), *(F.avg(f"{x}{i}").alias(f"{x}{i}") for x in "sc" for i in k))
    agg = wide.select("facility_id", "n_reviews", F.posexplode(F.array(*(F.struct(F.col(f"s{i}").alias("s"), F.col(f"c{i}").alias("c")) for i in k))).alias("topic", "m")).select("facility_id", "n_reviews", "topic", "m.s", "m.c")
    sentiment = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col("c") > 1e-9, F.col("s") / F.col("c")).otherwise(0.5)))
    names, weights = F.array(*map(F.lit, lexicons.TOPICS)), F.array(*map(F.lit, topic_weights()))
    at = F.col("topic") + 1
    return agg.select(
        "facility_id", F.element_at(names, at).alias("topic"), "n_reviews", fixed(F.col("s"), 6).alias("avg_score"), fixed(F.col("s") * F.element_at(weights, at), 6).alias("total_score"),
        fixed(F.col("c"), 6).alias("salience"), fixed(sentiment, 6).alias("sentiment"),
    )


def weighted_sentiment(scores: DataFrame) -> DataFrame:
    """Per facility: the weighted sum of sentiments on a scale of 100, and the overall score."""
    w = F.create_map(*(x for t, v in zip(lexicons.TOPICS, topic_weights()) for x in (F.lit(t), F.lit(v))))
    return scores.groupBy("facility_id").agg(fixed(F.sum(F.col("sentiment") * F.element_at(w, F.col("topic"))) * 100, 1).alias("weighted_sentiment"), fixed(F.sum("total_score") * 100, 1).alias("overall"))


def salience_flags(scores: DataFrame, n_sentences: DataFrame) -> DataFrame:
    """Estimated mentions of each topic, and whether it is unmeasured or no more than evenly spread."""
    floor = 100.0 / len(lexicons.TOPICS)
    pct = fixed(F.col("salience") * 100, 1)
    rows = scores.join(n_sentences, "facility_id")
    return rows.select("facility_id", "topic", pct.alias("salience_pct"), F.round(F.col("n_sentences") * pct / 100, 0).cast("int").alias("mentions"), (pct <= 0).alias("unmeasured"), (pct <= F.lit(floor)).alias("thin"))
