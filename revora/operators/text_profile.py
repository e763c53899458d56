"""Text profiles: term statistics, TF-IDF, n-grams, samples, axes.

Terms are counted map-side before they are shuffled; the vocabulary is chosen
over the whole corpus.  Ties go to the smaller term or id.  Texts without
tokens give no terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicons
from ..functions.columns import contains_any, fixed, total_occurrences
from ..functions.text import ngrams, tokens

VOCABULARY, SHOWN, LEAST_REPEATS = 5000, 20, 2


def term_frequency(texts: DataFrame) -> DataFrame:
    """(facility_id, term, tf) of texts (facility_id, text)."""
    return texts.select("facility_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("facility_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(tf: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """(facility_id, term, score): smoothed idf, unit length, over the commonest terms of all facilities."""
    n = tf.select("facility_id").distinct().count()
    stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(vocabulary)
    weighted = tf.join(stats.select("term", "df"), "term").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("facility_id")))
    return weighted.select("facility_id", "term", (F.col("w") / norm).alias("score"))


def keywords(scores: DataFrame, n: int = SHOWN) -> DataFrame:
    w = Window.partitionBy("facility_id").orderBy(F.desc(fixed(F.col("score"), 6)), "term")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("facility_id", "rank", "term", fixed(F.col("score"), 6).alias("score"))


def phrases(texts: DataFrame, n: int, shown: int = SHOWN) -> DataFrame:
    """The commonest runs of n tokens of each facility, of those that repeat."""
    made = F.flatten(F.transform(F.array(tokens(F.col("text"))), lambda t: ngrams(t, n)))  # the tokens are made once
    grams = texts.select("facility_id", F.explode(made).alias("phrase")).groupBy("facility_id", "phrase").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("facility_id").orderBy(F.desc("n"), "phrase")
    return grams.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= shown) & (F.col("n") >= LEAST_REPEATS)).select("facility_id", "rank", "phrase", "n")


def rated_samples(reviews: DataFrame) -> DataFrame:
    """Three of the best and three of the worst rated reviews (three stars or less) of each facility."""
    best = Window.partitionBy("facility_id").orderBy(F.desc_nulls_last("rating"), "id")
    worst = Window.partitionBy("facility_id").orderBy(F.asc("rating"), F.desc("id"))
    high = reviews.withColumn("rank", F.row_number().over(best)).filter("rank <= 3").withColumn("side", F.lit("high"))
    low = reviews.filter("rating < 4").withColumn("rank", F.row_number().over(worst)).filter("rank <= 3").withColumn("side", F.lit("low"))
    return high.unionByName(low).select("facility_id", "side", "rank", "id", "rating")


def symbolic(reviews: DataFrame, chosen: DataFrame, n: int = SHOWN // 4) -> DataFrame:
    """The reviews that speak of most of their facility's keywords: sum of the keywords' scores, and its share."""
    terms = reviews.select("facility_id", "id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    total = chosen.groupBy("facility_id").agg(F.sum("score").alias("all"))
    hits = terms.join(chosen.select("facility_id", "term", "score"), ["facility_id", "term"]).groupBy("facility_id", "id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n_keywords"))
    w = Window.partitionBy("facility_id").orderBy(F.desc("score"), "id")
    rows = hits.join(total, "facility_id").select("facility_id", "id", fixed(F.col("s"), 3).alias("score"), fixed(100 * F.col("s") / F.col("all"), 1).alias("share"), "n_keywords")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def mentions(reviews: DataFrame, axes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(facility_id, rating, text, axis): a row for each axis a review has a word of."""
    axes = lexicons.AXES if axes is None else axes
    pairs = F.array(*(F.when(contains_any(F.col("text"), ws), F.lit(a)) for a, ws in axes.items()))
    return reviews.select("facility_id", "rating", "text", F.explode(F.filter(pairs, lambda a: a.isNotNull())).alias("axis"))


def axis_scores(reviews: DataFrame) -> DataFrame:
    """Satisfaction of each facility and axis: seven tenths stars, three tenths net sentiment, of the reviews that speak of it."""
    text = F.col("text")
    rows = mentions(reviews).withColumns({"p": total_occurrences(text, lexicons.AXIS_POSITIVE), "q": total_occurrences(text, lexicons.AXIS_NEGATIVE)})
    agg = rows.groupBy("facility_id", "axis").agg(F.count(F.lit(1)).alias("n"), (F.sum("rating") / F.count("rating")).alias("stars"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    net = F.coalesce(F.try_divide(F.col("p") - F.col("q"), F.col("p") + F.col("q")), F.lit(0.0))
    score = F.coalesce(F.col("stars") / 5 * 100, F.lit(50.0)) * 0.7 + (50.0 + net * 50.0) * 0.3
    own = agg.select("facility_id", "axis", "n", fixed(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("score"))
    whole = reviews.filter("rating is not null").groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"), fixed(F.sum("rating") / F.count("rating") / 5 * 100, 1).alias("score"))
    return own.unionByName(whole.select("facility_id", F.lit("総合満足度").alias("axis"), "n", "score"))


def _is_one_of(words: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda token: token.isin(*words)


def axis_emphasis(reviews: DataFrame) -> DataFrame:
    """How much each facility's reviews speak of each axis, the most spoken of as 100."""
    n = reviews.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(tokens(F.col("text")))).alias("tokens"))

    def cells(t: Column) -> Column:
        return F.array(*(
            F.struct(F.lit(a).alias("axis"), F.size(F.filter(t, _is_one_of(ws))).alias("hits"), contains_any(F.col("text"), ws).cast("int").alias("has")) for a, ws in lexicons.AXES.items()
        ))

    made = F.flatten(F.transform(F.array(tokens(F.col("text"))), cells))
    rows = reviews.select("facility_id", F.explode(made).alias("c")).groupBy("facility_id", F.col("c.axis").alias("axis")).agg(F.sum("c.hits").alias("hits"), F.sum("c.has").alias("has"))
    raw = rows.join(n.filter("tokens > 0"), "facility_id").withColumn("raw", F.col("hits") / F.col("tokens") * 100 + F.col("has") / F.col("n") * 20)
    top = F.max("raw").over(Window.partitionBy("facility_id"))
    return raw.select("facility_id", "axis", fixed(F.coalesce(F.try_divide(F.col("raw"), top), F.lit(0.0)) * 100, 1).alias("emphasis"))


def language_counts(texts: DataFrame, kind: str = "language") -> DataFrame:
    return texts.groupBy("facility_id", kind).agg(F.count(F.lit(1)).alias("n"))
