"""Evaluation texts leaking into training text.

Every window of a document, of the size of a piece of an item, is embedded by
CGK random walks (Chakraborty, Goldenberg and Koucky, 2016): a walk over the
window that advances or stays by random bits of step and character, so that a
small edit distance becomes a small Hamming distance.  Repeated samples of a
walk's positions give LSH keys; windows of items, one at every character, are
kept under the same keys.  A document's windows start every few characters, so
each copied stretch is met at the offset it has.  A hit names a place of an item
and of the document.  From there a stretch is followed to both sides for as long
as matches outweigh edits, so a passage may begin and end inside sentences;
stretches with a small gap between them, such as an edited word, are one.  A
sentence with a hit that stretches don't cover is held if its exact edit
distance to the text about its place is small.

A document holds an item if stretches and sentences make up COVERAGE of its
text: two fifths, less what edits take from the characters that are counted.  A
sentence may differ by up to EDITS of its length, which admits edited words and
characters but not the same pattern with other contents; a stretch has at least
STRETCH windows and fewer edits.  Sentences shorter than a window count where
they stand unchanged in a document that has other hits.

Defined results: texts are compared apart from case, width, white space,
punctuation, markup and invisible characters; null, empty and blank texts and
items hold nothing; repeated documents are reported each, repeated items too.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Window length and stride of documents' windows, for windows that begin with a written (CJK) and with another character.
WINDOW, STRIDE = {True: 15, False: 32}, {True: 3, False: 6}
#: Walks, LSH tables drawn from each walk, sampled positions of each table, and the seed of their random bits.
WALKS, DRAWS, SAMPLED, SEED = 2, 3, 10, 2016
TABLES = WALKS * DRAWS
#: Largest edit distance of a verified sentence, as a share of its length; share of an item that must be verified.
EDITS, COVERAGE = 0.22, 0.38
#: Least length of a stretch, as a multiple of a window, and its largest share of edits; weight of an edit against a match, and the loss at which following ends.
STRETCH, STRETCH_EDITS, EDIT_WEIGHT, DROP = 1.5, 0.16, 3, 8
#: Share of a sentence that stretches may leave out of it at edits near its ends.
ENDS = 0.12
#: Largest gap, in either text, between stretches that are one, such as an edited word.
GAP = 16
#: Least length of a short sentence that counts unchanged, for written (CJK) and for other characters.
SHORT = {True: 7, False: 16}
#: Characters of items whose windows are broadcast at once, about 100 bytes for each; more items take several passes over the documents.
BLOCK_CHARS = 500_000
#: Windows embedded at once.
CHUNK = 400_000

_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>")
_KEEP = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[。！？])|(?<=[.!?])\s+")


def normal(text: str) -> str:
    """A text apart from case, width, white space, punctuation, markup and invisible characters."""
    if "<" in text:
        text = _MARKUP.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _KEEP.sub("", text.casefold())


def codes(text: str) -> np.ndarray:
    """One byte for each character."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def is_written(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return (points >= 0x3040) & (points <= 0x9FFF)


class Walks:
    """CGK walks, and tables of positions sampled from them."""

    def __init__(self) -> None:
        random = np.random.default_rng(SEED)
        self.bits, self.taken = {}, {}
        for kind, width in WINDOW.items():
            steps = 2 * width - 2  # a walk advances every other step
            self.bits[kind] = random.integers(0, 2, size=(WALKS, steps, 256), dtype=np.int32)
            taken = np.stack([np.sort(random.choice(steps - 1, SAMPLED, replace=False)) for _ in range(TABLES)])
            # the last of them lies near the end, so that the whole window is walked
            taken[:, -1] = random.integers(steps - max(2, steps // 8), steps, TABLES)
            self.taken[kind] = taken.reshape(WALKS, DRAWS, SAMPLED)

    def keys(self, flat: np.ndarray, starts: np.ndarray, kind: bool) -> np.ndarray:
        """(tables x windows) LSH keys of the windows at ``starts``; ``flat`` must reach two windows beyond the last."""
        out = np.empty((TABLES, len(starts)), dtype=np.uint64)
        for w in range(WALKS):
            at = starts.astype(np.int64)
            keys = out[w * DRAWS : (w + 1) * DRAWS]
            keys[:] = np.arange(w * DRAWS + 1, (w + 1) * DRAWS + 1, dtype=np.uint64)[:, None]
            taken = self.taken[kind][w]
            for j in range(int(taken.max()) + 1):
                seen = flat.take(at)
                for d in np.flatnonzero((taken == j).any(axis=1)):
                    keys[d] *= np.uint64(1099511628211)
                    keys[d] += seen
                at += self.bits[kind][w, j].take(seen)
            keys *= np.uint64(0x9E3779B97F4A7C15)
        return out


def edit_distance_within(pattern: str, text: str) -> int:
    """The least edit distance of ``pattern`` to any stretch of ``text`` (bit-parallel)."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = ((((eq & up) + up) ^ up) | eq) & full
        ph, mh = (down | ~(xh | up)) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best = score
    return best


def follow(a: str, i: int, b: str, j: int, step: int) -> tuple[int, int, int]:
    """(places of ``a``, edits, places of ``b``) for which ``a`` from i and ``b`` from j agree, forwards or backwards, up to the best score."""
    first, other, score, best, edits, kept = i, j, 0, 0, 0, (0, 0, 0)
    while True:
        run = _agree(a, i, b, j, step, 1 << 30)
        if run:
            score, i, j = score + run, i + step * run, j + step * run
            if score > best:
                best, kept = score, (abs(i - first), edits, abs(j - other))
        score, edits = score - EDIT_WEIGHT, edits + 1
        if best - score > DROP or not (0 <= i < len(a) and 0 <= j < len(b)):
            return kept
        # the edit after which most characters agree: another character, or one more in either text
        ways = [(_agree(a, i + step * dx, b, j + step * dy, step, 8), dx, dy) for dx, dy in ((1, 1), (1, 0), (0, 1))]
        _, dx, dy = max(ways)
        i, j = i + step * dx, j + step * dy


def _agree(a: str, i: int, b: str, j: int, step: int, most: int) -> int:
    """For how many characters, at most ``most``, two texts agree from two places on."""
    n = 0
    if step > 0:
        while n + 16 <= most and (x := a[i + n : i + n + 16]) == b[j + n : j + n + 16] and len(x) == 16:
            n += 16
        most = min(most, len(a) - i, len(b) - j)
        while n < most and a[i + n] == b[j + n]:
            n += 1
    else:
        most = min(most, i + 1, j + 1)
        while n + 16 <= most and a[i - n - 15 : i - n + 1] == b[j - n - 15 : j - n + 1]:
            n += 16
        while n < most and a[i - n] == b[j - n]:
            n += 1
    return n


class Index:
    """The windows of a block of items under their LSH keys."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.ids: list = []
        self.sentences: list[tuple[int, str]] = []  # (item, normal text)
        self.length: list[int] = []
        self.whole: list[str] = []  # normal text of the items
        self.begin: list[int] = []  # of the sentences in it
        self.short: list[list[int]] = []  # sentences of the items that no window fits in
        self.first: list[int] = []  # sentence of each item
        walks = Walks()
        keys, owners, offsets = [], [], []
        for item_id, text in items:
            parts = [n for s in _SENTENCE.split(text or "") if (n := normal(s))]
            if not parts:
                continue
            item = len(self.ids)
            self.ids.append(item_id)
            whole = "".join(parts)
            self.length.append(len(whole))
            self.whole.append(whole)
            # windows run over sentence borders, so that short sentences have some too
            flat = np.concatenate([codes(whole), np.zeros(2 * max(WINDOW.values()), np.uint8)])
            written = is_written(whole)
            border = np.cumsum([0, *map(len, parts)])
            first = len(self.sentences)
            self.first.append(first)
            self.sentences += [(item, p) for p in parts]
            self.begin += border[:-1].tolist()
            kinds = [bool(is_written(p).mean() > 0.5) for p in parts]
            self.short.append([first + i for i, (p, kind) in enumerate(zip(parts, kinds)) if SHORT[kind] <= len(p) < WINDOW[kind] + STRIDE[kind]])
            for kind in (True, False):
                starts = np.flatnonzero(written == kind)
                starts = starts[starts <= max(0, len(whole) - WINDOW[kind])].astype(np.int32)
                if len(starts):
                    keys.append(walks.keys(flat, starts, kind).ravel())
                    owners.append(np.full(TABLES * len(starts), item))
                    offsets.append(np.tile(starts, TABLES))
        self.first.append(len(self.sentences))
        self.letters = [sorted(Counter(p).items()) for _, p in self.sentences]
        if keys:
            key, owner, offset = np.concatenate(keys), np.concatenate(owners), np.concatenate(offsets)
        else:
            key, owner, offset = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.offset = key[order], owner[order].astype(np.int32), offset[order].astype(np.int32)
        self.present = np.zeros(1 << 22, dtype=bool)  # a filter before the exact search
        self.present[(self.key >> np.uint64(42)).astype(np.int64)] = True

    def held(self, texts: list[str | None]) -> Iterator[tuple[int, object, float]]:
        """(text, item id, share of the item) of every item that a text holds."""
        if not len(self.key):
            return
        walks = Walks()
        normals = [normal(t) if t else "" for t in texts]
        pad = np.zeros(2 * max(WINDOW.values()), np.uint8)
        group: list[int] = []
        size = 0
        for i, n in enumerate(normals):
            group.append(i)
            size += len(n)
            if size >= 2_000_000 or i == len(normals) - 1:
                yield from self._held(group, normals, walks, pad)
                group, size = [], 0

    def _held(self, group: list[int], normals: list[str], walks: Walks, pad: np.ndarray) -> Iterator[tuple[int, object, float]]:
        whole = "".join(normals[i] for i in group)
        ends = np.cumsum([len(normals[i]) for i in group])
        begins = ends - [len(normals[i]) for i in group]
        flat, written = np.concatenate([codes(whole), pad]), is_written(whole)
        place = np.arange(len(whole), dtype=np.int32)
        within = place - np.repeat(begins, ends - begins).astype(np.int32)
        seeds: dict[int, set[tuple[int, int, int]]] = defaultdict(set)  # (item, place in it, place in the text)
        for kind in (True, False):
            starts = place[(written == kind) & (within % STRIDE[kind] == 0)]
            for c in range(0, len(starts), CHUNK):
                part = starts[c : c + CHUNK]
                for key in walks.keys(flat, part, kind):
                    maybe = np.flatnonzero(self.present[(key >> np.uint64(42)).astype(np.int64)])
                    if not len(maybe):
                        continue
                    low = np.searchsorted(self.key, key[maybe], side="left")
                    high = np.searchsorted(self.key, key[maybe], side="right")
                    hit = np.flatnonzero(high > low)
                    place_of = part[maybe][hit]
                    docs = np.searchsorted(ends, place_of, side="right")
                    for s, doc, a, b in zip((place_of - begins[docs]).tolist(), docs.tolist(), low[hit].tolist(), high[hit].tolist()):
                        seeds[doc].update(zip(self.item[a:b].tolist(), self.offset[a:b].tolist(), [s] * (b - a)))  # windows of items under one key
        for doc, found in seeds.items():
            text = normals[group[doc]]
            by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for item, p, at in found:
                by_item[item].append((at, p))
            for item, spots in by_item.items():
                held = self._verified(text, item, spots)
                chars = int(held.sum())
                if chars >= COVERAGE * self.length[item]:
                    yield group[doc], self.ids[item], chars / self.length[item]

    def _verified(self, text: str, item: int, spots: list[tuple[int, int]]) -> np.ndarray:
        """Which places of the item a text holds, given hits as (place in the text, place in the item)."""
        whole, held = self.whole[item], np.zeros(self.length[item], dtype=bool)
        runs: list[tuple[int, int, int, int, int]] = []  # (begin, end) in the item and in the text, edits
        reached: dict[int, int] = {}  # how far a diagonal of the alignment is followed
        for at, p in sorted(spots):
            diagonal = (at - p) >> 3
            if any(reached.get(d, -1) > at for d in (diagonal - 1, diagonal, diagonal + 1)):
                continue
            (right, x, ahead), (left, y, back) = follow(whole, p, text, at, 1), follow(whole, p - 1, text, at - 1, -1)
            reached[diagonal] = at + ahead
            reached[(at + ahead - p - right) >> 3] = at + ahead
            if left + right:
                runs.append((p - left, p + right, at - back, at + ahead, x + y))
        self._mark(sorted(set(runs)), whole, held)
        hit = sorted({self.sentence(item, p) for _, p in spots})
        if sum(len(self.sentences[x][1]) for x in hit + self.short[item]) + int(held.sum()) < COVERAGE * len(whole):
            return held  # not even if all of them stand there
        for sentence in hit:
            begin, pattern = self.begin[sentence], self.sentences[sentence][1]
            place = held[begin : begin + len(pattern)]
            if place.all():
                continue
            allowed = int(EDITS * len(pattern))
            # a little that stretches left out of a sentence is edited, more than that, and not more than edits, is missing
            left = len(pattern) - int(place.sum())
            if left <= ENDS * len(pattern) or left > allowed and self._stands(text, sentence, spots, allowed):
                place[:] = True
        for sentence in self.short[item]:
            a, pattern = self.begin[sentence], self.sentences[sentence][1]
            if not held[a : a + len(pattern)].all() and pattern in text:
                held[a : a + len(pattern)] = True
        return held

    def _mark(self, runs: list[tuple[int, int, int, int, int]], whole: str, held: np.ndarray) -> None:
        """Marks what chains of runs hold: runs that follow each other in both texts, with small gaps, are one stretch."""
        chains: list[list[int]] = []  # begin, end in the item, end in the text, characters, edits
        for a, b, s, t, edits in runs:
            for c in reversed(chains):
                if -GAP < a - c[1] <= GAP and -GAP < s - c[2] <= GAP and b > c[1]:
                    gap = max(0, a - c[1], s - c[2])
                    c[1], c[2], c[3], c[4] = b, t, c[3] + min(b - a, b - c[1]), c[4] + edits + gap
                    break
            else:
                chains.append([a, b, t, b - a, edits])
        for a, b, _, _, edits in chains:
            width = WINDOW[bool(is_written(whole[a:b]).mean() > 0.5)]
            if b - a >= STRETCH * width and edits <= STRETCH_EDITS * (b - a):
                held[a:b] = True

    def sentence(self, item: int, place: int) -> int:
        """The sentence of an item that holds a place of its text."""
        first, last = self.first[item], self.first[item + 1]
        return bisect_right(self.begin, place, first, last) - 1

    def _stands(self, text: str, sentence: int, spots: list[tuple[int, int]], allowed: int) -> bool:
        """Whether a sentence stands in the text within an edit distance, about where a hit says."""
        begin, pattern = self.begin[sentence], self.sentences[sentence][1]
        need, last = self.letters[sentence], None
        for start in sorted({(at - p + begin) >> 3 for at, p in spots if begin <= p < begin + len(pattern)}):
            if last is not None and start - last <= 1:
                last = start
                continue  # looked at with the one before, by the slack
            last = start
            part = text[max(0, start * 8 - allowed - 8) : start * 8 + len(pattern) + allowed + 24]
            # every edit makes up for one missing letter at most
            if sum(n - k for c, n in need if (k := part.count(c)) < n) <= allowed and edit_distance_within(pattern, part) <= allowed:
                return True
        return False


def leaked(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, share) of every document that holds an item, and the share it holds."""
    spark = documents.sparkSession
    schema = f"`{doc_key}` {documents.schema[doc_key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}, share double"
    rows = items.filter(F.length(F.trim(text)) > 0).select(item_key, text).orderBy(item_key, text)
    out, block, size = None, [], 0

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index(block))  # bounded by BLOCK_CHARS

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                keys = b.iloc[:, 0].tolist()
                found = [(keys[i], item, share) for i, item, share in shared.value.held(b.iloc[:, 1].tolist())]
                yield pd.DataFrame(found, columns=[doc_key, item_key, "share"])

        return documents.select(F.col(doc_key), F.col(text)).mapInPandas(run, schema)

    for row in rows.toLocalIterator():
        if block and size + len(row[1]) > BLOCK_CHARS:
            out, block, size = search(block) if out is None else out.unionByName(search(block)), [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block or out is None:
        out = search(block) if out is None else out.unionByName(search(block))
    return out
