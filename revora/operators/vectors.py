"""Operators on embedding vectors: nearest neighbours, medoids, memberships, noise, clusters.

Vectors are arrays; they are scaled to unit length inside one row.  Sums per
cluster are sums of columns, made map-side.  Null and zero vectors are left
out.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialize
from .graph import components

#: Query vectors that a pass over all rows takes at once, and the bound on the number of clusters.
BLOCK, MOST_CLUSTERS = 2000, 5000
#: Distances that density-based clustering holds at once.
MOST_GAPS = 4_000_000


def unit(v: Column) -> Column:
    """A vector of doubles of unit length; null for zero and null vectors."""
    d = F.transform(v, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(d, lambda x: x / size))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def units(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *also: str) -> DataFrame:
    return vectors.select(key, *also, unit(F.col(vector)).alias("u")).filter("u is not null")


def nearest(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(query, rank, neighbour, cosine): the k nearest of all rows of the corpus to each query, itself left out.

    Queries are taken in blocks of a fixed size against every partition of the
    corpus; a partition keeps k rows of each query, so what is shuffled does
    not grow with the corpus' size but with its partitions.
    """
    spark, out = corpus.sparkSession, None

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([b[0] for b in block]), np.array([b[1] for b in block])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best_id, best = np.full((len(ids), k), -1, dtype=np.int64), np.full((len(ids), k), -np.inf)
            for b in batches:
                if not len(b):
                    continue
                own, m = b[key].to_numpy(), np.stack(b["u"].to_numpy())
                sims = np.round(q @ m.T, 9)
                sims[ids[:, None] == own[None, :]] = -np.inf
                every, sim = np.concatenate([best_id, np.broadcast_to(own, sims.shape)], axis=1), np.concatenate([best, sims], axis=1)
                order = np.lexsort((every, -sim), axis=1)[:, :k]
                best_id, best = np.take_along_axis(every, order, axis=1), np.take_along_axis(sim, order, axis=1)
            keep = np.isfinite(best)
            yield pd.DataFrame({"query": np.repeat(ids, k)[keep.ravel()], "neighbour": best_id[keep], "cosine": best[keep]})

        return corpus.select(key, "u").mapInPandas(run, "query bigint, neighbour bigint, cosine double")

    block: list = []
    for row in queries.select(key, "u").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        out = spark.createDataFrame([], "query bigint, neighbour bigint, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centroids(members: DataFrame, size: int, label: str = "label") -> DataFrame:
    """(label, n, c): each cluster's size and the sum of its unit vectors, by sums of columns."""
    agg = members.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("u")[i]).alias(f"_{i}") for i in range(size)))
    return agg.select(label, "n", F.array(*(F.col(f"_{i}") for i in range(size))).alias("c"))


def medoids(members: DataFrame, size: int, key: str = "vec_id", label: str = "label") -> DataFrame:
    """The member of each cluster with the greatest mean cosine to its members, which for unit vectors is the greatest product with their sum."""
    joined = members.join(centroids(members, size, label), label)
    best = F.max(F.struct(F.round(dot(F.col("u"), F.col("c")) / F.col("n"), 9).alias("mean"), (-F.col(key)).alias("o")))
    return joined.groupBy(label).agg(F.first("n").alias("n"), best.alias("b")).select(label, "n", (-F.col("b.o")).alias("medoid"), F.round("b.mean", 6).alias("mean_cosine"))


def _centre_rows(middle: DataFrame, label: str) -> tuple[list, np.ndarray]:
    rows = sorted(middle.select(label, unit(F.col("c")).alias("u")).limit(MOST_CLUSTERS + 1).collect(), key=lambda r: r[0])
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    return [r[0] for r in rows], np.array([r[1] for r in rows])


def memberships(members: DataFrame, middle: DataFrame, temperature: float = 0.15, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, label, membership): softmax of the cosines to all centroids, whose number is bounded."""
    labels, centres = _centre_rows(middle, label)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                z = np.stack(b["u"].to_numpy()) @ centres.T / temperature
                e = np.exp(z - z.max(axis=1, keepdims=True))
                e /= e.sum(axis=1, keepdims=True)
                yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), len(labels)), label: np.tile(labels, len(b)), "membership": e.ravel()})

    return members.select(key, "u").mapInPandas(run, f"{key} bigint, {label} int, membership double")


def absorb(members: DataFrame, size: int, near: float = 0.80, join: float = 0.86, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Noise (label below zero) joins the nearest centroid that is near enough; what remains forms components of close pairs.

    Close pairs of noise are found block by block; a new component is named by
    its smallest id as -2 - id, so that names don't depend on an order of work.
    """
    middle = centroids(members.filter(F.col(label) >= 0), size, label)
    labels, centres = _centre_rows(middle, label)

    def nearest_centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(labels):
                sims = np.stack(b["u"].to_numpy()) @ centres.T
                best = sims.argmax(axis=1)
                hit = sims[np.arange(len(b)), best] >= near
                yield pd.DataFrame({key: b[key].to_numpy()[hit], "to": np.array(labels)[best][hit]})

    noise = materialize(members.filter(F.col(label) < 0).select(key, "u"), "noise")
    taken = noise.mapInPandas(nearest_centre, f"{key} bigint, to int")
    rest = materialize(noise.join(taken, key, "left_anti"), "noise-rest")
    edges = _close_pairs(rest, join, key)
    found = components(edges, "a", "b")
    named = rest.join(found.withColumnRenamed("node", key), key, "left").select(key, (-2 - F.coalesce("root", F.col(key))).cast("int").alias("to"))
    stable = members.filter(F.col(label) >= 0).select(key, F.col(label).alias("to"))
    return stable.unionByName(taken).unionByName(named)


def _close_pairs(rows: DataFrame, least: float, key: str) -> DataFrame:
    """(a, b), a < b, of all pairs with at least this cosine: every block of rows against all rows, pairs below are never made rows."""
    out, block = None, []

    def search(block: list) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((np.array([b[0] for b in block]), np.array([b[1] for b in block])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for b in batches:
                if len(b):
                    i, j = np.nonzero(q @ np.stack(b["u"].to_numpy()).T >= least)
                    own = b[key].to_numpy()[j]
                    keep = ids[i] < own
                    yield pd.DataFrame({"a": ids[i][keep], "b": own[keep]})

        return rows.mapInPandas(run, "a bigint, b bigint")

    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == BLOCK:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    return out if out is not None else rows.sparkSession.createDataFrame([], "a bigint, b bigint")


def canonical(found: DataFrame, label: str = "label") -> DataFrame:
    """New labels from zero, in the order of the clusters' medoids, then of falling size; clusters are few."""
    w = Window.orderBy("medoid", F.desc("n"))
    return found.withColumn("canonical", F.row_number().over(w) - 1).select(label, "n", "medoid", "canonical")


def density_clusters(points: np.ndarray, least: int) -> np.ndarray:
    """Density-based clusters of a set of points: mutual reachability, minimum spanning tree, condensed tree, excess of mass; -1 is noise.

    Distances are made anew in blocks of rows, so memory grows with the points
    and only time with their square.
    """
    n = len(points)
    if n < max(2, least):
        return np.full(n, -1)
    square = (points**2).sum(1)

    def gaps(a: int, b: int) -> np.ndarray:
        return np.sqrt(np.maximum(0, square[a:b, None] + square[None, :] - 2 * points[a:b] @ points.T))

    k, step = min(least, n) - 1, max(1, MOST_GAPS // n)
    core = np.concatenate([np.partition(gaps(a, a + step), k, axis=1)[:, k].copy() for a in range(0, n, step)])
    inside, best, via, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(gaps(at, at + 1)[0], np.maximum(core[at], core))
        closer = ~inside & (reach < best)
        best[closer], via[closer] = reach[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], via[at], at))
    # the merge tree
    parent, size = {i: i for i in range(n)}, {i: 1 for i in range(n)}
    children, height = {}, {}

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    nxt = n
    for d, a, b in sorted(edges):
        ra, rb = top(a), top(b)
        parent[nxt] = parent[ra] = parent[rb] = nxt
        size[nxt], children[nxt], height[nxt] = size[ra] + size[rb], (ra, rb), d
        nxt += 1
    root = nxt - 1
    # walk down: a split is real if both sides hold enough points
    strength, splits, stack = {}, {}, [(root, 0.0)]
    while stack:
        node, born = stack.pop()
        mass, cur = 0.0, node
        while True:
            if cur not in children:
                break
            lam = 1 / max(height[cur], 1e-12)
            x, y = children[cur]
            big = [c for c in (x, y) if size[c] >= least]
            if len(big) == 2:
                mass += (lam - born) * size[cur]
                splits[node] = (x, y)
                stack += [(x, lam), (y, lam)]
                break
            mass += (lam - born) * sum(size[c] for c in (x, y) if c not in big)
            if not big:
                break
            cur = big[0]
        strength[node] = mass
    # from the smallest nodes up, whose numbers are smaller: a node or what is best below it
    worth: dict[int, float] = {}
    chosen: set[int] = set()
    for node in sorted(strength):
        below = sum(worth[c] for c in splits.get(node, ()))
        if node != root and (node not in splits or strength[node] >= below):
            worth[node] = strength[node]
            chosen.add(node)
        else:
            worth[node] = below
    top_chosen, stack = [], [root]
    while stack:
        node = stack.pop()
        if node in chosen:
            top_chosen.append(node)
        else:
            stack += splits.get(node, ())

    def members(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            c = stack.pop()
            if c < n:
                out.append(c)
            else:
                stack += children[c]
        return out

    labels = np.full(n, -1)
    for i, own in enumerate(sorted((members(c) for c in top_chosen or [root]), key=min)):
        labels[own] = i
    return labels


def group_scaled(features: DataFrame, groups: dict[str, tuple[list[str], float]], key: str, share: float = 0.75) -> DataFrame:
    """(key, u): features with nulls at the median, standardised by the population's spread, each group scaled to its weight's share of ``share``.

    Medians (0.5 where nothing is known), means and spreads come from two passes
    over the columns; a feature that doesn't vary is 0.
    """
    names = [n for ns, _ in groups.values() for n in ns]
    middle = features.agg(*(F.median(n).alias(n) for n in names)).first()
    filled = features.select(key, *(F.coalesce(F.col(n).cast("double"), F.lit(float(middle[n]) if middle[n] is not None else 0.5)).alias(n) for n in names))
    stats = filled.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first()
    total = sum(w for _, w in groups.values())
    cells = []
    for ns, w in groups.values():
        scale = (share * w / total / len(ns)) ** 0.5
        cells += [(F.col(n) - float(stats[f"m_{n}"] or 0.0)) / float(stats[f"s_{n}"]) * scale if stats[f"s_{n}"] else F.lit(0.0) for n in ns]
    return filled.select(key, F.array(*cells).alias("u"))


def principal(vectors: DataFrame, size: int, most: int = 12, share: float = 0.25, key: str = "vec_id") -> DataFrame:
    """(key, u): the first principal components of vectors, centred, scaled to ``share``; the covariance is made of sums of products."""
    n = vectors.count()
    if n < 2:
        return vectors.select(key, F.array().cast("array<double>").alias("u"))
    sums = vectors.agg(*(F.sum(F.col("u")[i]).alias(f"_{i}") for i in range(size))).first()
    mean = np.array([sums[i] for i in range(size)]) / n

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for b in batches:
            if len(b):
                x = np.stack(b["u"].to_numpy()) - mean
                total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(size), size), "j": np.tile(np.arange(size), size), "x": total.ravel()})

    rows = vectors.select("u").mapInPandas(products, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # size squared
    cov = np.zeros((size, size))
    for r in rows:
        cov[r["i"], r["j"]] = r["x"] / (n - 1)
    values, axes = np.linalg.eigh(cov)
    k = min(most, size, n - 1)
    axes = axes[:, ::-1][:, :k]
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1, 1)  # a sign that doesn't depend on the solver
    scale = (share / k) ** 0.5 / np.sqrt(np.maximum(values[::-1][:k], 1e-12))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "u": list((np.stack(b["u"].to_numpy()) - mean) @ axes * scale)})

    return vectors.select(key, "u").mapInPandas(project, f"{key} bigint, u array<double>")


def mixture(points: np.ndarray, k: int, rounds: int = 100, floor: float = 1e-4, seed: int = 42) -> np.ndarray:
    """Memberships of a bounded set of points in k diagonal Gaussians, fitted by expectation maximisation from spread-out starts."""
    rng = np.random.default_rng(seed)
    n = len(points)
    centres = [points[rng.integers(n)]]
    while len(centres) < k:
        gap = np.min([((points - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(points[int(gap.argmax())])
    mean, var, weight, last = np.array(centres), np.tile(points.var(0) + floor, (k, 1)), np.full(k, 1 / k), -np.inf
    for _ in range(rounds):
        logs = np.log(weight) - 0.5 * (np.log(2 * np.pi * var).sum(1) + (((points[:, None, :] - mean) ** 2) / var).sum(2))
        top = logs.max(1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
        r = np.exp(logs - total)
        if total.sum() - last < 1e-6 * n:
            break
        last, size = total.sum(), r.sum(0) + 1e-10
        weight, mean = size / n, (r.T @ points) / size[:, None]
        var = (r.T @ points**2) / size[:, None] - mean**2 + floor
        var = np.maximum(var, floor)
    return r


def matched(memberships: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The columns of memberships in the order of labels 0..k-1, by the assignment with the greatest total membership."""
    k = memberships.shape[1]
    gain = np.array([[memberships[labels == a, c].sum() for c in range(k)] for a in range(k)])
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for a in range(k):  # over sets of columns taken; k is small
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for taken, (value, order) in best.items():
            for c in range(k):
                if not taken >> c & 1 and (v := value + gain[a, c]) > step.get(taken | 1 << c, (-np.inf, ()))[0]:
                    step[taken | 1 << c] = (v, (*order, c))
        best = step
    return memberships[:, list(best[(1 << k) - 1][1])]
