"""Single remarks worth reading: rare concrete troubles, and four voices of each facility.

Defined results: null and blank texts give nothing; of equal remarks the one
with the smaller review counts; ties go to the smaller id and position.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicons
from ..functions.columns import contains_any, fixed, words_present

LEAST_CHARS, MOST_CHARS = 12, 80
_EDGE = "、， 　"
_CLOSED = r"[\s　、,．.・…！!？?ー～〜（）()「」『』【】\"']+"


def remark_sentences(text: Column) -> Column:
    """Pieces of 12 to 80 characters with Japanese in them; longer sentences are cut at commas."""
    pieces = F.flatten(F.transform(F.split(text, "[。！？\\n]+"), lambda s: F.when(F.length(s) <= MOST_CHARS, F.array(s)).otherwise(F.split(s, "[、，]"))))
    bare = F.transform(pieces, lambda s: F.regexp_replace(s, f"^[{_EDGE}]+|[{_EDGE}]+$", ""))
    return F.filter(bare, lambda s: F.length(s).between(LEAST_CHARS, MOST_CHARS) & s.rlike("[ぁ-んァ-ヶ一-龠]"))


def live(words: tuple[str, ...]) -> str:
    """A pattern for any of the words that no negator follows within the window."""
    by_length: dict[int, list[str]] = {}
    for n in lexicons.NEGATORS:
        by_length.setdefault(len(n), []).append(n)
    negated = "|".join(f".{{0,{lexicons.NEGATION_WINDOW - k}}}(?:{'|'.join(ns)})" for k, ns in sorted(by_length.items()))
    return f"(?:{'|'.join(map(re.escape, words))})(?!{negated})"


def rare(texts: DataFrame) -> DataFrame:
    """The best remarks of each facility: said once, concrete, a trouble, neither praise nor supposition nor private.

    (facility_id, rank, id, pos, sentence, score, category); texts (facility_id, id, text).
    """
    s = texts.select("facility_id", "id", F.posexplode(remark_sentences(F.col("text"))).alias("pos", "sentence"))
    x = F.col("sentence")
    s = s.withColumns({"key": F.regexp_replace(x, _CLOSED, ""), "words": F.array_distinct(F.regexp_extract_all(x, F.lit("[ぁ-んァ-ヶ一-龠]{2,}"), F.lit(0)))})
    n = s.groupBy("facility_id").agg(F.count(F.lit(1)).alias("n"))
    df = s.select("facility_id", F.explode("words").alias("word")).groupBy("facility_id", "word").agg(F.count(F.lit(1)).alias("df"))
    once = s.groupBy("facility_id", "key").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "pos", "sentence", "words")).alias("o")).filter("times = 1").select("facility_id", "o.*")
    # what can be ruled out from the sentence alone is, before the join on words
    weights = sorted(lexicons.SEVERITY.items(), key=lambda kv: -kv[1][1])  # stable: the first of equal weights wins
    category = reduce(lambda c, kv: c.when(x.rlike(live(kv[1][0])), kv[0]), weights[1:], F.when(x.rlike(live(weights[0][1][0])), weights[0][0]))
    once = once.withColumns({"category": category, **{f"e{i}": contains_any(x, ws) for i, ws in enumerate(lexicons.ELEMENTS.values())}})
    elements = reduce(lambda a, b: a + b, (F.col(f"e{i}").cast("int") for i in range(len(lexicons.ELEMENTS))))
    severity = reduce(lambda c, kv: c.when(F.col("category") == kv[0], kv[1][1]), weights[1:], F.when(F.col("category") == weights[0][0], weights[0][1][1])).otherwise(0.0)
    once = once.withColumns({"elements": elements, "severity": severity, "praise": words_present(x, lexicons.PRAISE)})
    praised = (F.col("praise") > 0) & ((F.col("severity") == 0) | (F.col("praise") >= 2))
    once = once.filter((F.col("elements") > 0) & (F.col("e3") | F.col("category").isNotNull()) & ~contains_any(x, lexicons.PERSONAL) & ~praised & ~contains_any(x, lexicons.CONDITIONAL))
    idf = once.select("facility_id", "id", "pos", F.explode_outer("words").alias("word")).join(df, ["facility_id", "word"], "left").join(n, "facility_id")
    top = F.slice(F.array_sort(F.collect_list(-F.log(F.col("n") / F.col("df")))), 1, 3)
    novelty = idf.groupBy("facility_id", "id", "pos").agg(top.alias("t"), F.max("n").alias("n"))
    mean = F.try_divide(-F.aggregate("t", F.lit(0.0), lambda a, b: a + b), F.size("t"))
    novelty = novelty.select("facility_id", "id", "pos", F.coalesce(F.least(F.lit(1.0), mean / F.log(F.greatest("n", F.lit(2)))), F.lit(0.0)).alias("novelty"))
    causal, vague = contains_any(x, lexicons.CAUSAL).cast("int"), contains_any(x, lexicons.VAGUE).cast("int")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    action = unit(F.col("e0").cast("int") * 0.45 + F.col("e3").cast("int") * 0.35 + causal * 0.20 - vague * 0.40)
    belief = unit(0.35 + contains_any(x, lexicons.OBSERVED).cast("int") * 0.25 + causal * 0.20 + F.col("elements") * 0.10 - vague * 0.35)
    a, b, c, d, e = lexicons.RARE_WEIGHTS
    score = a * F.col("novelty") + b * F.least(F.lit(1.0), F.col("elements") / 3) + c * F.col("severity") + d * action + e * belief
    w = Window.partitionBy("facility_id").orderBy(F.desc("score"), "id", "pos")
    rows = once.join(novelty, ["facility_id", "id", "pos"]).withColumn("score", fixed(score, 6)).filter(F.col("score") >= lexicons.RARE_LEAST)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= lexicons.RARE_MOST).select("facility_id", "rank", "id", "pos", "sentence", "score", "category")


def voices(reviews: DataFrame) -> DataFrame:
    """Four voices of each facility, each the longest text not yet taken: liked, disliked, wanting, looking ahead.

    (facility_id, quadrant, id); reviews (facility_id, id, rating, text).  Of
    each kind only the four longest can be needed, so the choice is made on
    sixteen rows of a facility.
    """
    t = reviews.withColumn("text", F.trim("text")).filter("text <> ''").groupBy("facility_id", "text").agg(F.min(F.struct("id", "rating")).alias("o")).select("facility_id", "o.id", "o.rating", "text")
    kinds = {"a": F.col("rating") >= 4, "z": F.lit(True), "b": F.col("rating") <= 3, "c": contains_any(F.col("text"), lexicons.WANTED), "d": contains_any(F.col("text"), lexicons.AHEAD)}
    rows = t.select("facility_id", "id", F.length("text").alias("chars"), F.explode(F.array(*(F.when(F.coalesce(p, F.lit(False)), F.lit(k)) for k, p in kinds.items()))).alias("kind")).filter("kind is not null")
    w = Window.partitionBy("facility_id", "kind").orderBy(F.desc("chars"), "id")
    best = rows.withColumn("k", F.row_number().over(w)).filter("k <= 4").groupBy("facility_id").pivot("kind", list(kinds)).agg(F.array_sort(F.collect_list(F.struct("k", "id"))))
    lists = {k: F.transform(F.coalesce(F.col(k), F.array().cast("array<struct<k:int,id:bigint>>")), lambda x: x["id"]) for k in kinds}
    out = best.select("facility_id", *(v.alias(k) for k, v in lists.items()))
    first = lambda c, used: F.try_element_at(F.filter(c, lambda i: reduce(lambda x, y: x & y, [~i.eqNullSafe(u) for u in used], F.lit(True))), F.lit(1))
    out = out.withColumn("p1", F.coalesce(F.try_element_at("a", F.lit(1)), F.try_element_at("z", F.lit(1))))
    out = out.withColumn("p2", first(F.col("b"), [F.col("p1")]))
    out = out.withColumn("p3", first(F.col("c"), [F.col("p1"), F.col("p2")]))
    out = out.withColumn("p4", first(F.col("d"), [F.col("p1"), F.col("p2"), F.col("p3")]))
    pairs = F.array(*(F.struct(F.lit(q).alias("quadrant"), F.col(f"p{i}").alias("id")) for i, q in enumerate(lexicons.QUADRANTS, 1)))
    return out.select("facility_id", F.explode(pairs).alias("v")).select("facility_id", "v.quadrant", "v.id").filter("id is not null")
