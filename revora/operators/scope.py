"""What a comparison is made against, and whether tables that belong together do.

Scope: in the market a facility is measured against the mean of all, itself
included; among competitors against the mean of the others only.  A metric
without a baseline, or a market of one, is measured against the neutral value.
Integrity: ids that were asked for and ids that came back are compared as sets,
in one aggregation, and every id that is missing, extra or repeated is told.

Defined results: null ids and null names take no part; ties go to the smaller
metric; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import fixed

NEUTRAL = 50.0
SHOWN, CANDIDATES = 5, 8


def against_market(matrix: DataFrame) -> DataFrame:
    """(facility_id, metric, score, baseline, label, diff) over (facility_id, metric, score): the market's mean, or neutral where one facility is all there is."""
    many = matrix.agg((F.count_distinct("facility_id") >= 2).alias("many"))
    means = matrix.groupBy("metric").agg(F.avg("score").alias("mean"))
    rows = matrix.join(means, "metric").join(F.broadcast(many))  # one row
    base = fixed(F.when(F.col("many"), F.col("mean")).otherwise(F.lit(NEUTRAL)), 2)
    return _differences(rows.withColumn("baseline", base).withColumn("label", F.when(F.col("many"), "market").otherwise("neutral")))


def against_competitors(matrix: DataFrame, peers: Column) -> DataFrame:
    """The same against the mean of the other facilities that are ``peers``; neutral for a metric that none of them has."""
    w, own = Window.partitionBy("metric"), peers.cast("int")
    total, n = F.sum(F.when(peers, F.col("score"))).over(w), F.sum(own).over(w)
    mean = F.try_divide(F.coalesce(total, F.lit(0.0)) - F.when(peers, F.col("score")).otherwise(0.0), n - own)
    rows = matrix.withColumn("mean", mean)
    return _differences(rows.withColumn("baseline", fixed(F.coalesce("mean", F.lit(NEUTRAL)), 2)).withColumn("label", F.when(F.col("mean").isNull(), "neutral").otherwise("competitors")))


def _differences(rows: DataFrame) -> DataFrame:
    score = fixed(F.col("score"), 2)
    return rows.select("facility_id", "metric", score.alias("score"), "baseline", "label", fixed(score - F.col("baseline"), 2).alias("diff"))


def lowest(compared: DataFrame, n: int = SHOWN) -> DataFrame:
    """The n smallest differences of each facility, of whatever sign."""
    w = Window.partitionBy("facility_id").orderBy("diff", "metric")
    return compared.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("facility_id", "rank", "metric", "diff")


def place_in_scope(matrix: DataFrame) -> DataFrame:
    """Per facility: its mean score, its rank among all (equals share the better one), and the difference to the mean of all."""
    own = matrix.groupBy("facility_id").agg(fixed(F.avg("score"), 4).alias("score"))
    # how many have a larger score: from sums over distinct scores, which round to few
    steps = own.groupBy("score").agg(F.count(F.lit(1)).alias("k"))
    above = steps.withColumn("above", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = own.agg(F.count(F.lit(1)).alias("facilities"), F.avg("score").alias("mean"))
    out = own.join(above.select("score", "above"), "score").join(F.broadcast(whole))  # one row
    return out.select("facility_id", "score", (F.col("above") + 1).alias("rank"), "facilities", fixed(F.col("score") - F.col("mean"), 3).alias("to_mean"))


def first_filled_matrix(first: DataFrame, other: DataFrame) -> DataFrame:
    """The first matrix, or the other where the first has no rows."""
    some = first.select(F.lit(1).alias("_some")).limit(1)
    return first.unionByName(other.withColumn("_some", F.lit(1)).join(F.broadcast(some), "_some", "left_anti").drop("_some"))


def priorities(scores: DataFrame, n: int) -> DataFrame:
    """The topics to improve first: lowest sentiment, of equals the one spoken of most."""
    w = Window.partitionBy("facility_id").orderBy("sentiment", F.desc("salience"), "topic")
    return scores.withColumn("priority", F.row_number().over(w)).filter(F.col("priority") <= n).select("facility_id", "priority", "topic", "sentiment", "salience")


def id_check(asked: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """(key, problem) of every id that is 'missing', 'extra' or 'repeated' among those returned."""
    both = asked.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_r")).unionByName(returned.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_r"))).filter(F.col(key).isNotNull())
    n = both.groupBy(key).agg(F.sum("_a").alias("a"), F.sum("_r").alias("r"))
    problem = F.when(F.col("r") == 0, "missing").when(F.col("a") == 0, "extra").when(F.col("r") > 1, "repeated")
    return n.select(key, problem.alias("problem")).filter("problem is not null")


def joined_whole(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the facts of their key; raises if a key of ``facts`` is repeated or a row has none (a many-to-one join that is checked)."""
    bad = id_check(rows.select(key).distinct(), facts, key).filter("problem <> 'extra'")
    found = {r["problem"]: r["n"] for r in bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    if found:
        raise ValueError(f"{key}: " + ", ".join(f"{n} {problem}" for problem, n in sorted(found.items())))
    return rows.join(facts, key)


def place_clusters(mentions: DataFrame, keys: list[str], review: str, sentiment: Column) -> DataFrame:
    """Per place and phase: mentions, distinct reviews, and mentions that praise or blame; null keys form groups of their own."""
    return mentions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mention_count"), F.count_distinct(review).alias("review_count"),
        F.count(F.when(sentiment > 0, 1)).alias("positive_mentions"), F.count(F.when(sentiment < 0, 1)).alias("negative_mentions"),
    )


def cluster_summary(assigned: DataFrame, cluster: str, review: str, means: dict[str, str]) -> DataFrame:
    """Per cluster: distinct reviews, their share of all rows, and means of columns."""
    whole = assigned.agg(F.count(F.lit(1)).alias("_all"))
    own = assigned.groupBy(cluster).agg(F.count_distinct(review).alias("review_count"), *(fixed(F.avg(c), 4).alias(n) for n, c in means.items()))
    return own.join(F.broadcast(whole)).withColumn("ratio", fixed(F.col("review_count") / F.col("_all"), 4)).drop("_all")  # one row


def cluster_profile(values: DataFrame, cluster: str, n: int = SHOWN) -> DataFrame:
    """(cluster, side, rank, feature, cluster_mean, overall_mean, difference) over (cluster, feature, value): the features in which a cluster lies most above and below all."""
    sums = values.filter("value is not null").groupBy(cluster, "feature").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("feature")
    means = sums.select(cluster, "feature", fixed(F.col("s") / F.col("k"), 6).alias("m"), fixed(F.sum("s").over(w) / F.sum("k").over(w), 6).alias("o")).withColumn("d", fixed(F.col("m") - F.col("o"), 6))
    up, down = Window.partitionBy(cluster).orderBy(F.desc("d"), "feature"), Window.partitionBy(cluster).orderBy("d", "feature")
    ranked = means.withColumns({"high": F.row_number().over(up), "low": F.row_number().over(down)}).filter((F.col("high") <= n) | (F.col("low") <= n))
    sides = F.filter(F.array(F.struct(F.lit("high").alias("side"), F.col("high").alias("rank")), F.struct(F.lit("low").alias("side"), F.col("low").alias("rank"))), lambda x: x["rank"] <= n)
    rows = ranked.withColumn("x", F.explode(sides))
    return rows.select(cluster, "x.side", "x.rank", "feature", fixed(F.col("m"), 3).alias("cluster_mean"), fixed(F.col("o"), 3).alias("overall_mean"), fixed(F.col("d"), 3).alias("difference"))


def candidates(typed: DataFrame, names: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(name, matches, candidates) for every typed name: the registered names that contain it, apart from case, the first ``most`` in order.

    Names meet by the pair of characters a typed name begins with (its one
    character), never by pairing all with all.
    """
    low = F.lower("name")
    places = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    own = names.filter("name is not null").select(F.col("name").alias("other")).distinct()
    own = own.withColumn("name", F.col("other")).select("other", F.explode(F.array_distinct(F.concat(places(1), places(2)))).alias("gram"))
    asked = typed.select("name").distinct().withColumn("gram", F.substring(low, 1, 2))
    found = asked.join(own, "gram").filter(F.contains(F.lower("other"), low)).groupBy("name").agg(F.count(F.lit(1)).alias("matches"), F.array_sort(F.collect_set("other")).alias("c"))
    return found.select("name", "matches", F.slice("c", 1, most).alias("candidates"))
