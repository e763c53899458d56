"""Bayesian fusion of the copies' field values, with detection of sources that copy.

Sources are crawls, told apart by the month of ``fetched_at``, each field of
theirs for itself.  Each source claims values for a field of a group.  Rounds
estimate in turn: the chance of every value from its prior and the discounted
votes of its sources; the accuracy of every source from the chances of its
claims; and for every two sources the chance that one copies the other, from how
often they share values that seem false (Dong, Berti-Equille and Srivastava,
2009).  A source's vote for a value counts less for each source of higher
accuracy that claims it too and that it may copy.

The prior carries the stated preferences of the fields: the value whose best row
is preferred (vendor's ids; the most complete text; the latest crawl; the
smallest id) starts with log-odds of ``trust`` against the others.  TRUST leaves
the last word to the votes; STATED exceeds every sum of votes, so that the
posterior's greatest value is the preferred one, and accuracies and
dependences are estimated against it.

What moves between tasks are distinct claims of groups of two or more copies:
rows that agree in source and value are one before any shuffle of groups.  They
are gathered once to a row per field of a group (of a large group: per part of
its values), and every round is one pass over these rows that sends only sums
per source and per pair of sources.  Months that hold less than 1/SOURCES of a field's claims are one source
with the like months of their year, and such years one source, so that a field
has at most 2 x SOURCES + 2 sources whatever the data, and the tables of
accuracies and dependences that the tasks are given are bounded.

Defined results: blank texts and null values are no claims; rows without
``fetched_at`` are one source; a field without claims has no row; equal chances
go to the preferred row.  Repeated rows with one id count as copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.graph import components
from ..operators.salted import skew_join
from ..runtime import discard, materialize
from .survivor import is_vendor_id, keys, stripped

FIELDS = ("review_id", "text", "owner_response", "likes")
#: Months (and years) of a field that are sources of their own at most; estimation rounds.
SOURCES, ROUNDS = 128, 3
#: Prior accuracy, number of likely false values, prior chance of copying, share of values a copier copies.
ACCURACY, FALSE_VALUES, COPYING, COPIED = 0.8, 10.0, 0.1, 0.8
#: Bounds of a source's accuracy.
LEAST, MOST = 0.05, 0.99
#: Log-odds of the preferred value: weighed against the votes, and above every sum of votes.
TRUST = 2.0
STATED = (2 * SOURCES + 2) * float(np.log(FALSE_VALUES * MOST / (1 - MOST))) + 10.0
#: Share of all rows from which a part counts as heavy; values of a group that one row holds, in the mean.
HEAVY, VALUES = 0.01, 1000
#: A month that no source of its own stands for; the month of rows without time of fetching.
_REST, _UNKNOWN = -2, -1


def _values() -> dict[str, Column]:
    """What a row claims for each field, null where it claims nothing."""
    return {
        "review_id": F.when(is_vendor_id(F.col("review_id")), stripped(F.col("review_id"))), "text": F.nullif(stripped(F.col("text")), F.lit("")),
        "owner_response": F.nullif(stripped(F.col("owner_response")), F.lit("")), "likes": F.col("likes").cast("string"),
    }


def groups(rows: DataFrame) -> tuple[DataFrame, int]:
    """(part, first_id, n, size) of every part of a group of two or more copies, and the number of rows.

    A part is the rows of one vendor key, or of one content key without a vendor
    id.  It holds n rows, its group ``size``.
    """
    known = rows.select("id", *(c.alias(k) for k, c in keys().items()))
    part = F.coalesce(F.concat(F.lit("v"), "vendor_key"), F.concat(F.lit("c"), "content_key"))
    content = F.when(F.col("vendor_key").isNotNull(), F.col("content_key"))
    each = known.select("id", part.alias("part"), content.alias("content")).filter("part is not null")
    each = materialize(each.groupBy("part", "content").agg(F.min("id").alias("part_id"), F.count(F.lit(1)).alias("n")), "fusion-keys")
    total = each.agg(F.sum("n")).first()[0] or 0
    # a vendor's part is linked to the rows without vendor's id that have the content of one of its rows
    loose = each.filter(F.col("part").startswith("c")).select(F.col("part").alias("y"), F.substring("part", 2, 40).alias("content"))
    roots = components(each.filter("content is not null").join(loose, "content"), "part", "y")
    parts = each.groupBy("part").agg(F.min("part_id").alias("part_id"), F.sum("n").alias("n"))
    parts = parts.join(roots.withColumnRenamed("node", "part"), "part", "left").filter("root is not null or n >= 2")
    parts = materialize(parts.withColumn("root", F.coalesce("root", "part")), "fusion-parts")
    whole = parts.groupBy("root").agg(F.min("part_id").alias("first_id"), F.sum("n").alias("size")).filter("size >= 2")
    found = materialize(parts.join(whole, "root").select("part", "first_id", "n", "size"), "fusion-groups")
    discard(each, parts)
    return found, total


def claims(rows: DataFrame) -> DataFrame:
    """One row per field of a group, or per part of its values where they are many.

    (first_id, field, parts, preferred, months, length, fetched, id): for every
    value, in arrays, the months that claim it, and length, time and id of its
    preferred row; ``preferred`` is the place of the best of all values, -1
    where another part holds it.
    """
    found, total = groups(rows)
    heavy = [r[0] for r in found.filter(F.col("n") > HEAVY * total).select("part").collect()]  # at most 1 / HEAVY
    fetched = F.col("fetched_at").cast("timestamp")
    # values move as hashes of fixed length
    cells = F.array(*(
        F.struct(F.lit(i).alias("field"), F.unhex(F.md5(v)).alias("value"), (F.length(v) if f == "text" else F.lit(0)).alias("length"))
        for i, (f, v) in enumerate(_values().items())
    ))
    part = F.coalesce(F.concat(F.lit("v"), "vendor_key"), F.concat(F.lit("c"), "content_key"))
    keyed = rows.select("id", "fetched_at", cells.alias("cells"), *(c.alias(k) for k, c in keys().items())).withColumn("part", part).filter("part is not null")
    month = F.coalesce(F.year(fetched) * 12 + F.month(fetched) - 1, F.lit(_UNKNOWN))
    keyed = keyed.select("part", "id", "cells", month.alias("month"), F.unix_micros(fetched).alias("fetched"))
    held = skew_join(keyed, found.select("part", "first_id", "size"), "part", "id", heavy)
    each = held.select("first_id", "size", "month", "fetched", "id", F.inline("cells")).filter("value is not null")
    prefer = F.struct("length", "fetched", (-F.col("id")).alias("last"))
    value = each.groupBy("first_id", "size", "field", "value").agg(F.max(prefer).alias("best"), F.collect_set("month").alias("months"))
    # equal values are in one part; a group of no more than VALUES rows has one part only
    number = F.ceil(F.col("size") / VALUES).cast("int")
    value = value.select("first_id", "field", number.alias("parts"), F.pmod(F.xxhash64("value"), number.cast("bigint")).alias("at"), "best", F.sort_array("months").alias("months"))
    gathered = value.groupBy("first_id", "field", "parts", "at").agg(F.sort_array(F.collect_list(F.struct("best", "months")), asc=False).alias("v"))
    top = gathered.filter("parts > 1").groupBy("first_id", "field").agg(F.max(F.col("v")[0]["best"]).alias("top"))
    gathered = gathered.join(top, ["first_id", "field"], "left")
    preferred = F.when(F.col("parts") == 1, 0).otherwise(F.when(F.col("v")[0]["best"] == F.col("top"), 0).otherwise(-1))
    columns = [F.col("v.best")[k].alias(k) for k in ("length", "fetched", "last")]
    table = gathered.select("first_id", "field", "parts", preferred.alias("preferred"), F.col("v.months").alias("months"), *columns)
    return materialize(table.withColumn("id", F.transform("last", lambda x: -x)).drop("last"), "fusion-claims")


class Sources:
    """The sources of all fields: their months, accuracies and dependences."""

    def __init__(self, counts: list[tuple[int, int]]) -> None:
        """``counts``: (field, month or -year) of the sources of their own."""
        self.months = [np.array(sorted(m for f, m in counts if f == i and m >= 0), dtype=np.int64) for i in range(len(FIELDS))]
        self.years = [np.array(sorted(-m - 10 for f, m in counts if f == i and m < _REST), dtype=np.int64) for i in range(len(FIELDS))]
        # per field: unknown, rest, years, months
        self.base = np.cumsum([0, *(2 + len(y) + len(m) for y, m in zip(self.years, self.months))])
        self.accuracy = np.full(self.base[-1], ACCURACY)
        self.copies: list[np.ndarray] = [np.zeros((b - a, b - a)) for a, b in zip(self.base, self.base[1:])]

    def of(self, field: np.ndarray, month: np.ndarray) -> np.ndarray:
        """The source of each claim."""
        out = np.empty(len(month), dtype=np.int64)
        for i in range(len(FIELDS)):
            at = np.flatnonzero(field == i)
            m, source = month[at], np.where(month[at] == _UNKNOWN, 0, 1)
            for known, x, first in ((self.years[i], m // 12, 2), (self.months[i], m, 2 + len(self.years[i]))):
                if len(known):
                    p = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    source = np.where((m >= 0) & (known[p] == x), first + p, source)
            out[at] = self.base[i] + source
        return out

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The chance that either of two sources of one field copies the other."""
        out, field = np.zeros(len(a)), np.searchsorted(self.base, a, side="right") - 1
        for i in range(len(FIELDS)):
            at = np.flatnonzero(field == i)
            out[at] = self.copies[i][a[at] - self.base[i], b[at] - self.base[i]]
        return out


def segment_pairs(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i before j, of all pairs within each segment; ``ends`` starts with 0."""
    size = np.diff(ends)
    for k in np.unique(size[size > 1]):
        starts, (i, j) = ends[:-1][size == k], np.triu_indices(k, 1)
        for c in range(0, len(starts), max(1, 1_000_000 // len(i))):
            s = starts[c : c + max(1, 1_000_000 // len(i)), None]
            yield (s + i).ravel(), (s + j).ravel()


class Votes:
    """The claims of a batch of rows, flat, with the chances of their values."""

    def __init__(self, batch: pa.RecordBatch, sources: Sources, trust: float) -> None:
        months = batch.column("months")
        self.rows = np.asarray(months.offsets, dtype=np.int64)  # values of row i
        months = months.values
        claims = np.asarray(months.offsets, dtype=np.int64)
        first, last = self.rows[0], self.rows[-1]
        self.first = first
        self.ends = claims[first : last + 1] - claims[first]  # claims of value i
        flat = np.asarray(months.values)[claims[first] : claims[last]].astype(np.int64)
        self.rows = self.rows - first
        n = int(self.rows[-1])
        self.row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))  # row of each value
        value = np.repeat(np.arange(n), np.diff(self.ends))
        field = np.asarray(batch.column("field")).astype(np.int64)
        source = sources.of(field[self.row[value]], flat)
        # sources that stand for several months claim a value once; the most accurate first
        accuracy = sources.accuracy[source]
        order = np.lexsort((source, -accuracy, value))
        source, value = source[order], value[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (source[1:] != source[:-1])
        self.source, self.value = source[new], value[new]
        self.ends = np.searchsorted(self.value, np.arange(n + 1))
        a = np.clip(sources.accuracy[self.source], LEAST, MOST)
        free = np.zeros(len(self.source))
        for i, j in segment_pairs(self.ends):
            free += np.bincount(j, np.log1p(-COPIED * sources.pair(self.source[i], self.source[j])), len(free))
        votes = np.bincount(self.value, np.log(FALSE_VALUES * a / (1 - a)) * np.exp(free), n)
        preferred = np.asarray(batch.column("preferred")).astype(np.int64)
        votes[(self.rows[:-1] + preferred)[preferred >= 0]] += trust
        self.votes = votes
        self.top = np.maximum.reduceat(votes, self.rows[:-1])
        self.sum = np.add.reduceat(np.exp(votes - self.top[self.row]), self.rows[:-1])
        if "total" in batch.schema.names:  # of rows that hold a part of a group's values
            own = np.asarray(batch.column("total").fill_null(np.nan)).astype(float)
            total = np.where(np.isnan(own), self.top + np.log(self.sum), own)
        else:
            total = self.top + np.log(self.sum)
        self.total = total
        self.chance = np.exp(votes - total[self.row])


def _run(rows: DataFrame, sources: Sources, trust: float, make, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(sources)  # a bounded number of sources

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield make(b, Votes(b, shared.value, trust))

    return rows.mapInArrow(run, schema)


def _totals(rows: DataFrame, sources: Sources, trust: float) -> DataFrame:
    """The rows with the logarithm of their group's total in ``total``, null where the row holds all values of it."""

    def make(b: pa.RecordBatch, v: Votes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("first_id"), b.column("field"), pa.array(v.top), pa.array(v.sum)], ["first_id", "field", "t", "s"])

    some = materialize(_run(rows.filter("parts > 1"), sources, trust, make, "first_id bigint, field int, t double, s double"), "fusion-sums")
    top = some.groupBy("first_id", "field").agg(F.max("t").alias("m"))
    total = some.join(top, ["first_id", "field"]).groupBy("first_id", "field", "m").agg(F.sum(F.col("s") * F.exp(F.col("t") - F.col("m"))).alias("s"))
    return rows.join(total.select("first_id", "field", (F.col("m") + F.log("s")).alias("total")), ["first_id", "field"], "left")


def _chances(rows: DataFrame, split: bool, sources: Sources, trust: float) -> DataFrame:
    return _totals(rows, sources, trust) if split else rows


def _sources(rows: DataFrame) -> Sources:
    """Months with a share of a field's claims, then years with a share, as sources."""
    months = rows.select("field", F.explode(F.flatten("months")).alias("month")).groupBy("field", "month").agg(F.count(F.lit(1)).alias("n"))
    months = materialize(months, "fusion-months")
    own = F.col("n") * SOURCES >= F.col("all")
    every = months.groupBy("field").agg(F.sum("n").alias("all"))
    told = months.filter("month >= 0").join(every, "field")
    years = told.filter(~own).groupBy("field", F.floor(F.col("month") / 12).alias("year"), "all").agg(F.sum("n").alias("n"))
    # at most SOURCES months and SOURCES years of each field
    found = told.filter(own).select("field", "month").union(years.filter(own).select("field", (-F.col("year") - 10).cast("int"))).collect()
    discard(months)
    return Sources([(r[0], r[1]) for r in found])


def _shared(rows: DataFrame, sources: Sources) -> list[np.ndarray]:
    """For every two sources of a field, the pairs of claims they have on one field of a group."""
    kinds = "field int, a bigint, b bigint, k bigint"

    def within(keys: np.ndarray, source: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        code, number = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in segment_pairs(ends):
            c, at = np.unique(source[i] * len(sources.accuracy) + source[j], return_inverse=True)
            code.append(c)
            number.append(np.bincount(at, n[i] * n[j], len(c)).astype(np.int64))
        code, number = np.concatenate(code), np.concatenate(number)
        a, b = code // len(sources.accuracy), code % len(sources.accuracy)
        return pa.RecordBatch.from_arrays([pa.array((np.searchsorted(sources.base, a, side="right") - 1).astype(np.int32)), pa.array(a), pa.array(b), pa.array(number)], ["field", "a", "b", "k"])

    def one(b: pa.RecordBatch, v: Votes) -> pa.RecordBatch:
        code, n = np.unique(v.row[v.value] * len(sources.accuracy) + v.source, return_counts=True)
        return within(code // len(sources.accuracy), code % len(sources.accuracy), n)

    def numbers(b: pa.RecordBatch, v: Votes) -> pa.RecordBatch:
        code, n = np.unique(v.row[v.value] * len(sources.accuracy) + v.source, return_counts=True)
        at = pa.array(code // len(sources.accuracy))
        return pa.RecordBatch.from_arrays([b.column("first_id").take(at), b.column("field").take(at), pa.array(code % len(sources.accuracy)), pa.array(n)], ["first_id", "field", "source", "n"])

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = b.column("s")
                ends, flat = np.asarray(s.offsets, dtype=np.int64), s.values
                keys = np.repeat(np.arange(b.num_rows), np.diff(ends))
                source, n = (np.asarray(flat.field(k))[ends[0] : ends[-1]] for k in ("source", "n"))
                yield within(keys, source, n)

    small = _run(rows.filter("parts = 1"), sources, 0.0, one, kinds)
    each = _run(rows.filter("parts > 1"), sources, 0.0, numbers, "first_id bigint, field int, source bigint, n bigint").groupBy("first_id", "field", "source").agg(F.sum("n").alias("n"))
    large = each.groupBy("first_id", "field").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s"))  # as many as sources
    return _matrices(small.union(large.mapInArrow(many, kinds)), sources)


def _matrices(pairs: DataFrame, sources: Sources) -> list[np.ndarray]:
    """Sums of k per pair of sources, as one matrix of each field."""
    out = [np.zeros_like(c) for c in sources.copies]
    for f, a, b, k in pairs.groupBy("field", "a", "b").agg(F.sum("k")).collect():  # a bounded number of sources, squared
        i, j = a - sources.base[f], b - sources.base[f]
        out[f][i, j] += k
        if i != j:
            out[f][j, i] += k
    return out


def _learn(rows: DataFrame, sources: Sources, trust: float, shared: list[np.ndarray], copying: bool) -> Sources:
    """Accuracies and dependences from the chances under the present ones."""
    size = len(sources.accuracy)

    def make(b: pa.RecordBatch, v: Votes) -> pa.RecordBatch:
        n, s = np.bincount(v.source, minlength=size), np.bincount(v.source, v.chance[v.value], size)
        seen = np.flatnonzero(n)
        a, c, number, total = [seen], [np.full(len(seen), -1)], [n[seen]], [s[seen]]
        true = v.chance > 0.5
        for i, j in segment_pairs(v.ends):
            x, y = np.minimum(v.source[i], v.source[j]), np.maximum(v.source[i], v.source[j])
            code, at = np.unique(x * size + y, return_inverse=True)
            a.append(code // size)
            c.append(code % size)
            number.append(np.bincount(at, minlength=len(code)))
            total.append(np.bincount(at, true[v.value[i]], len(code)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, c)] + [pa.array(np.concatenate(number)), pa.array(np.concatenate(total).astype(float))], ["a", "b", "n", "s"])

    sums = _run(rows, sources, trust, make, "a bigint, b bigint, n bigint, s double").groupBy("a", "b").agg(F.sum("n"), F.sum("s")).collect()  # a bounded number of sources, squared
    out = Sources.__new__(Sources)
    out.months, out.years, out.base = sources.months, sources.years, sources.base
    out.accuracy, out.copies = sources.accuracy.copy(), [np.zeros_like(c) for c in sources.copies]
    agree, true = [np.zeros_like(c) for c in sources.copies], [np.zeros_like(c) for c in sources.copies]
    for a, b, n, s in sums:
        if b < 0:
            out.accuracy[a] = s / n
            continue
        f = int(np.searchsorted(sources.base, a, side="right")) - 1
        i, j = a - sources.base[f], b - sources.base[f]
        agree[f][i, j] = agree[f][j, i] = n
        true[f][i, j] = true[f][j, i] = s
    if not copying:
        return out
    for f, (first, last) in enumerate(zip(sources.base, sources.base[1:])):
        own = np.clip(out.accuracy[first:last], LEAST, MOST)
        a = (own[:, None] + own) / 2
        t, wrong = a * a, (1 - a) ** 2 / FALSE_VALUES
        differ = np.maximum(1e-9, 1 - t - wrong)
        kf, kd = agree[f] - true[f], np.maximum(0, shared[f] - agree[f])
        # sharing what is true is no sign of copying; sharing what is false is, and differing speaks against it
        alone = kf * np.log(wrong) + kd * np.log(differ)
        copied = kf * np.log((1 - a) * COPIED + wrong * (1 - COPIED)) + kd * np.log(differ * (1 - COPIED))
        odds = np.clip(np.log((1 - COPYING) / COPYING) + alone - copied, -700, 700)
        # sources that never meet say nothing; either may be the copier
        out.copies[f] = np.where(agree[f] > 0, 1 / (1 + np.exp(odds)) / 2, 0.0)
        np.fill_diagonal(out.copies[f], 0.0)
    return out


def fused(rows: DataFrame, trust: float = TRUST, rounds: int = ROUNDS) -> DataFrame:
    """(first_id, field, keep_id, chance): of every field of every group of copies the row that holds the most probable value best."""
    table = claims(rows)
    split = table.filter("parts > 1").limit(1).count() > 0
    sources = _sources(table)
    shared = _shared(table, sources)
    for number in range(rounds):
        # the first round's votes know no accuracies yet, so they can't tell what is false
        sources = _learn(_chances(table, split, sources, trust), sources, trust, shared, number > 0)

    def make(b: pa.RecordBatch, v: Votes) -> pa.RecordBatch:
        # values stand in order of preference, so the first of the greatest is the preferred one
        best = np.array([a + int(np.argmax(v.votes[a:e])) for a, e in zip(v.rows, v.rows[1:])], dtype=np.int64)
        columns = {k: b.column(k).values.take(pa.array(best + v.first)) for k in ("id", "length", "fetched")}
        arrays = [b.column("first_id"), b.column("field"), b.column("parts"), columns["id"], pa.array(v.votes[best]), columns["length"], columns["fetched"], pa.array(v.chance[best])]
        return pa.RecordBatch.from_arrays(arrays, ["first_id", "field", "parts", "keep_id", "votes", "length", "fetched", "chance"])

    kinds = "first_id bigint, field int, parts int, keep_id bigint, votes double, length int, fetched bigint, chance double"
    found = _run(_chances(table, split, sources, trust), sources, trust, make, kinds)
    name = F.element_at(F.array(*(F.lit(f) for f in FIELDS)), F.col("field") + 1).alias("field")
    columns = ("first_id", name, "keep_id", F.round("chance", 6).alias("chance"))
    if not split:
        return found.select(*columns)
    best = F.max(F.struct("votes", "length", "fetched", (-F.col("keep_id")).alias("last"), "chance")).alias("b")
    merged = found.filter("parts > 1").groupBy("first_id", "field").agg(best).select("first_id", "field", (-F.col("b.last")).alias("keep_id"), "b.chance")
    return found.filter("parts = 1").select("first_id", "field", "keep_id", "chance").union(merged).select(*columns)


def with_values(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of :func:`fused` with the value each keeps, as text."""
    told = rows.select(F.col("id").alias("keep_id"), *(v.alias(f"_{f}") for f, v in _values().items()))
    value = F.coalesce(*(F.when(F.col("field") == f, F.col(f"_{f}")) for f in FIELDS))
    return kept.join(told, "keep_id").select("first_id", "field", value.alias("value"), "keep_id", "chance").filter("value is not null").dropDuplicates(["first_id", "field"])
