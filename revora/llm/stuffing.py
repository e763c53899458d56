"""Keyword-stuffed and link-list pages, by a hidden Markov model over lines.

A text is split into lines, long lines at sentence ends and where a sentence
follows a list, so a page without line breaks is judged as finely as one with
them.  Each line shows a few discrete features; its state is prose, link list,
tag list or menu.  Emissions, steps between states and first states are fitted
on all pages by expectation-maximisation (Baum and Welch); the table below is
where it starts and counts as PRIOR_LINES lines of each state for every
PRIOR_PER lines of the pages (or fewer, if there are no more), which keeps the
names of the states however many pages there are.  A page is flagged if lines
other than prose hold the greater part of its words, which weigh as long as they
are; a heading doesn't count.

Texts are parsed once: the features of a line are packed into one number, and
the rounds of the fit and the labelling read those.  A round sums expectations
where the lines lie; only the sums reach the driver.

The lines of many pages are worked on at once: one pass of a regular expression
finds the words of all of them, sums over lines and pages are array operations,
and a step of the chain is made for all pages that are long enough.

Defined results: null, empty and blank texts are not flagged; a text is fitted
and judged whole, however long; copies of one text count once in the fit, and
repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import discard, materialize, spread

STATES = ("prose", "links", "tags", "menu")
#: Weight of the table, in lines of each state, for so many lines of the pages; rounds.
PRIOR_LINES, PRIOR_PER, ROUNDS = 400.0, 24_000, 4
#: Share of words outside prose from which a page is flagged.
FLAGGED_SHARE = 0.45
#: Characters whose lines are parsed at once; lines whose states are worked on at once.
CHUNK, CHUNK_LINES = 2_000_000, 200_000
#: Expectations are added up as whole numbers of this part, so their sum doesn't depend on the order of tasks.
UNIT = 2.0**-20
#: Weight of lines that only state a price or hours.
FACT_WEIGHT = 0.25

#: The commonest function words of the corpus' languages.
FUNCTION_WORDS = frozenset(
    """the a an of to and in is was were are be been it its this that these those for on at by with from as but or if not no we our us i my me you your he she they
    their his her had has have did do would could should will can so than then when while because since also only very there here which who what all some any more
    le la les un une des du de et est était sont a au aux en dans pour par sur avec ce cette ces qui que nous notre vous mais ou pas plus très il elle y se son sa
    el los las una unos y es fue era con para por su sus muy pero no lo al del que se mi nos como más o das der die und ist war ein eine im den dem zu mit für auf
    von nicht aber sie wir es sich als auch noch bis o os as um uma e é são foi não mas na nas dos da ao à""".split()
)
_URL = re.compile(r"(?:https?://|www\.)\S+|<a\s[^>]*>|</a>|\b[\w-]+(?:\.[\w-]+)*\.(?:com|net|org|jp|test|example|invalid|info|biz|io|co)\b(?:/\S*)?", re.I)
_TOKEN = re.compile(r"\n|[぀-ゟ]+|[゠-ヿｦ-ﾟ]+|[一-鿿々〆]+|[^\W\d_぀-ヿｦ-ﾟ一-鿿々〆]+(?:['’][^\W\d_]+)?|\d+")
_SEPARATOR = re.compile(r"[\n|>»/・•·,、，;；\t]| - ")
_CUT = re.compile(r"([。！？])\s*|([.!?])\s+|(,)\s+(?=[A-Z][a-z]*\s[a-z]|[^\s,、]*[ぁ-ん][^\s,]*[。、])")
_WRAP = re.compile(r"(?<=[^\s。！？.!?…」』”\"')）])[ \t]*\r?\n[> ]*(?=[^\W\d_A-Z])(?=[a-zß-öø-ÿ])")
_LOWER = re.compile(r"\n[> ]*[a-zß-öø-ÿ]")  # needed for _WRAP
_QUOTED = re.compile(r"^[> ]+", re.M)
_CODE = re.compile(r"\b[A-Z]{2,}-?\d{3,}\b|\bSKU")
_FACT = re.compile(r"\d{1,2}:\d{2}|(?:…|\.\.\.|:|：|\s)\s*[¥$€£]?\d[\d,.]*\s*(?:円|crowns?|EUR|USD|Kronen|coronas|couronnes|coroas|[¥$€£])?\s*\Z")
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.I)
_ENDS, _AFTER = frozenset("。！？.!?…"), "」』”\"')） \t\u3000"

#: Features and their numbers of values.
FEATURES = {"function": 5, "end": 2, "link": 4, "separator": 4, "repeat": 4, "variety": 4, "hash": 3, "code": 3}
#: Every combination of values, and what a value of each feature counts in the number of its combination.
COMBINATIONS = np.indices(tuple(FEATURES.values())).reshape(len(FEATURES), -1).T
RADIX = len(COMBINATIONS) // np.cumprod(list(FEATURES.values()))
#: Prior emission table: for each state and feature the chances of its values.
PRIOR = {
    "prose": {"function": (0.005, 0.03, 0.10, 0.30, 0.565), "end": (0.12, 0.88), "link": (0.965, 0.02, 0.01, 0.005), "separator": (0.70, 0.27, 0.027, 0.003),
              "repeat": (0.93, 0.055, 0.012, 0.003), "variety": (0.25, 0.69, 0.055, 0.005), "hash": (0.98, 0.015, 0.005), "code": (0.84, 0.01, 0.15)},
    "links": {"function": (0.45, 0.30, 0.15, 0.07, 0.03), "end": (0.90, 0.10), "link": (0.03, 0.12, 0.30, 0.55), "separator": (0.45, 0.25, 0.20, 0.10),
              "repeat": (0.45, 0.20, 0.15, 0.20), "variety": (0.40, 0.40, 0.15, 0.05), "hash": (0.97, 0.02, 0.01), "code": (0.97, 0.025, 0.005)},
    "tags": {"function": (0.40, 0.32, 0.18, 0.07, 0.03), "end": (0.80, 0.20), "link": (0.96, 0.02, 0.01, 0.01), "separator": (0.30, 0.25, 0.25, 0.20),
             "repeat": (0.25, 0.10, 0.15, 0.50), "variety": (0.35, 0.25, 0.15, 0.25), "hash": (0.70, 0.08, 0.22), "code": (0.80, 0.195, 0.005)},
    "menu": {"function": (0.50, 0.28, 0.15, 0.05, 0.02), "end": (0.95, 0.05), "link": (0.90, 0.06, 0.03, 0.01), "separator": (0.08, 0.12, 0.35, 0.45),
             "repeat": (0.60, 0.20, 0.10, 0.10), "variety": (0.35, 0.45, 0.15, 0.05), "hash": (0.98, 0.01, 0.01), "code": (0.985, 0.01, 0.005)},
}
STAY = 0.70
#: Most letters (of a CJK character two) of a first line that is taken for a heading.
HEADING = 80
#: Words of a window in which repeated words are counted.
WINDOW = 30


def lines_of(text: str) -> list[str]:
    """Lines, cut further at sentence ends, without quotation marks and markup that only formats."""
    if "<" in text:
        text = _TAG.sub(lambda m: m.group() if m.group()[:2].lower() == "<a" and "href" in m.group() else " " if m.group()[1:3].lower() == "/a" else "", text)
    if _LOWER.search(text):
        text = _WRAP.sub(" ", text)  # a sentence wrapped over lines
    if ">" in text:
        text = _QUOTED.sub("", text)
    return [s for line in _CUT.sub(r"\1\2\3\n", text).splitlines() if (s := line.strip())]


def _per_line(found: list[str], n: int) -> np.ndarray:
    """How many matches each line has, where '\\n' parts the matches of the lines."""
    ends = np.flatnonzero(np.fromiter((m == "\n" for m in found), bool, len(found)))
    return np.diff(np.concatenate([[-1], ends, [len(found)]]))[:n] - 1


def _steps(x: np.ndarray, *bounds: float) -> np.ndarray:
    return np.searchsorted(np.array(bounds), x, side="right")


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return n / np.maximum(of, 1)


def features(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features, words of each line, first line of each page and the end) of pages of lines."""
    lines = [s for p in pages for s in p]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    n, page = len(lines), np.repeat(np.arange(len(pages)), np.diff(starts))
    links, linked, ended, hashes, code = (np.zeros(n, dtype=t) for t in (np.int64, float, np.int64, np.int64, np.int64))
    bare = list(lines)
    for i, s in enumerate(lines):
        # only a line with a point inside, or with markup, can hold a link
        if ("." in s[:-1] or "<" in s) and (found := _URL.findall(s)):
            links[i], linked[i] = len(found), sum(map(len, found)) / len(s)
            bare[i] = _URL.sub(" ", s)
        ended[i] = s.rstrip(_AFTER)[-1:] in _ENDS and not (links[i] and _URL.search(s.split()[-1]))
        if "#" in s:
            hashes[i] = s.count("#")
    joined = "\n".join(bare)
    tokens = _TOKEN.findall(joined.lower()) + ["\n"]
    codes, words = pd.factorize(np.array(tokens, dtype=object))
    end = codes == list(words).index("\n")
    line, codes = np.cumsum(end)[~end] - 0, codes[~end]
    count = np.bincount(line, minlength=n)
    functional = np.fromiter((w in FUNCTION_WORDS or "\u3040" <= w[0] <= "\u309f" for w in words), bool, len(words))
    digit = np.fromiter((w[0].isdigit() for w in words), bool, len(words))
    weight = np.fromiter((0 if w[0].isdigit() else len(w) * (2 if "\u3040" <= w[0] <= "\u9fff" else 1) for w in words), float, len(words))
    for i in np.flatnonzero(np.bincount(line, digit[codes], n)).tolist() + [i for i, s in enumerate(lines) if "SKU" in s]:
        code[i] = 1 if _CODE.search(lines[i]) else 2 if _FACT.search(lines[i]) else 0
    # threes of words that the page repeats
    repeated = np.zeros(n)
    if len(codes) > 2:
        within = np.flatnonzero(line[2:] == line[:-2])
        a, b, c, of = (x.astype(np.uint64) for x in (codes[within], codes[within + 1], codes[within + 2], page[line[within]]))
        m = np.uint64(0x9E3779B97F4A7C15)
        three = ((((of * m) ^ a) * m ^ b) * m ^ c) * m
        _, at, times = np.unique(three, return_inverse=True, return_counts=True)
        often = np.maximum(4, 0.1 * np.diff(starts))[page[line[within]]]
        repeated = np.bincount(line[within], times[at] >= often, n) / np.maximum(count - 2, 1)
    # share of repeated words, in windows of a fixed length as long lines repeat words anyway
    first = np.concatenate([[0], np.cumsum(count)])
    window = (np.arange(len(codes)) - first[line]) // WINDOW
    kept = (count[line] >= 6) & (window * WINDOW < np.maximum(1, count[line] - WINDOW // 2))
    place = line[kept] * (int(window.max(initial=0)) + 1) + window[kept]
    spots, size = np.unique(place, return_counts=True)
    pairs = np.sort(place * (len(words) + 1) + codes[kept])
    pairs = pairs[np.diff(pairs, prepend=-1) > 0] // (len(words) + 1)
    same = 1 - np.bincount(np.searchsorted(spots, pairs), minlength=len(spots)) / np.maximum(size, 1)
    owner = spots // (int(window.max(initial=0)) + 1)
    variety = np.bincount(owner, same, n) / np.maximum(np.bincount(owner, minlength=n), 1)
    rows = np.stack([
        np.where(count > 0, _steps(_share(np.bincount(line, functional[codes], n), count), 0.06, 0.14, 0.24, 0.34), 0),
        ended, _steps(linked, 0.001, 0.3, 0.6), _steps(_share(_per_line(_SEPARATOR.findall(joined), n), count), 0.001, 0.12, 0.3),
        _steps(repeated, 0.2, 0.5, 0.8), np.where(count < 6, 0, 1 + _steps(variety, 0.4, 0.6)),
        np.where(hashes == 0, 0, _steps(_share(hashes, count), 0.001, 0.15)), code,
    ], axis=1).astype(np.int64)
    # words weigh as long as they are; a link weighs two words of six letters, a number nothing, a line of prices or hours a quarter
    size = np.bincount(line, weight[codes], n) + 12 * links
    return rows, np.where((code == 2) & (links == 0) & (hashes == 0), size * FACT_WEIGHT, size), starts


class Model:
    """Log-probabilities of the states' features, of the first state and of the steps between states."""

    def __init__(self, emission: list[np.ndarray], first: np.ndarray, step: np.ndarray) -> None:
        self.emission, self.first, self.step = emission, first, step

    @classmethod
    def prior(cls) -> Model:
        k = len(STATES)
        step = np.full((k, k), (1 - STAY) / (k - 1))
        np.fill_diagonal(step, STAY)
        emission = [np.log(np.array([PRIOR[s][f] for s in STATES])) for f in FEATURES]
        return cls(emission, np.log(np.array([0.7, 0.1, 0.1, 0.1])), np.log(step))

    def seen(self, rows: np.ndarray) -> np.ndarray:
        """(lines x states) log-probabilities of the lines' features."""
        return sum(e[:, rows[:, i]] for i, e in enumerate(self.emission)).T

    def label(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The likeliest states of the lines of pages (Viterbi); ``starts`` names each page's first line, and the end."""
        return self._likeliest(self.seen(rows), starts)

    def _likeliest(self, seen: np.ndarray, starts: np.ndarray) -> np.ndarray:
        at, cut = _by_place(starts)
        seen, back = seen[at], np.zeros((len(at), len(STATES)), dtype=np.int8)
        best = seen[: cut[1]] + self.first
        for a, b in zip(cut[1:], cut[2:]):
            reach = best[: b - a, :, None] + self.step
            back[a:b] = reach.argmax(axis=1)
            best[: b - a] = reach.max(axis=1) + seen[a:b]
        state, path = best.argmax(axis=1), np.empty(len(at), dtype=np.int64)
        for a, b in zip(cut[-2::-1], cut[:0:-1]):
            path[at[a:b]] = state[: b - a]
            state[: b - a] = back[np.arange(a, b), state[: b - a]]
        return path

    def expected(self, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of the states of each line, of the first states and of the steps, summed (forward-backward)."""
        seen = self.seen(rows)
        at, chance, first, steps = self._expected(np.exp(seen - seen.max(axis=1, keepdims=True)), starts)
        out = np.empty_like(chance)
        out[at] = chance
        return out, first, steps

    def _expected(self, seen: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``expected``, from the lines' chances in each state; the lines come in the order of the first result."""
        at, cut = _by_place(starts)
        seen, step = seen[at], np.exp(self.step)
        chance, reached = np.empty_like(seen), np.empty_like(seen)
        x = np.exp(self.first) * seen[: cut[1]]
        chance[: cut[1]] = x / x.sum(axis=1, keepdims=True)
        for before, a, b in zip(cut, cut[1:], cut[2:]):
            reached[a:b] = x = chance[before : before + b - a] @ step
            x = x * seen[a:b]
            chance[a:b] = x / x.sum(axis=1, keepdims=True)
        steps = np.zeros_like(step)
        for before, a, b in zip(cut[-3::-1], cut[-2::-1], cut[:1:-1]):
            ratio, earlier = chance[a:b] / reached[a:b], chance[before : before + b - a]
            steps += earlier.T @ ratio
            earlier *= ratio @ step.T
        return at, chance, chance[: cut[1]].sum(axis=0), steps * step

    def counts(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums of the expectations over pages, in one array: for each feature states x values, then first states, then steps."""
        seen = self.seen(COMBINATIONS)
        seen = np.exp(seen - seen.max(axis=1, keepdims=True))
        k = len(STATES)
        of, firsts, steps = np.zeros((k, len(COMBINATIONS))), np.zeros(k), np.zeros((k, k))
        for i, j in _chunks(starts):
            some = codes[starts[i] : starts[j]]
            at, chance, first, step = self._expected(seen[some], starts[i : j + 1] - starts[i])
            for s in range(k):
                of[s] += np.bincount(some[at], chance[:, s], len(COMBINATIONS))
            firsts += first
            steps += step
        emission = [np.bincount(COMBINATIONS[:, f], of[s], n) for f, n in enumerate(FEATURES.values()) for s in range(k)]
        return np.concatenate([*emission, firsts, steps.ravel()])

    @classmethod
    def from_counts(cls, counts: np.ndarray, prior_lines: float = PRIOR_LINES) -> Model:
        """The model that explains ``counts`` best, with the prior's table counted as ``prior_lines`` lines of each state for every PRIOR_PER lines."""
        start = cls.prior()
        tables = [*start.emission, start.first[None], start.step]
        found = [c.reshape(t.shape) for t, c in zip(tables, np.split(counts, np.cumsum([t.size for t in tables])[:-1]))]
        weight = prior_lines * max(1.0, found[0].sum() / PRIOR_PER)
        fitted = [c + np.exp(t) * weight for t, c in zip(tables, found)]
        *emission, first, step = (np.log(c / c.sum(axis=1, keepdims=True)) for c in fitted)
        return cls(emission, first[0], step)

    @classmethod
    def train(cls, texts: list[str], prior_lines: float = PRIOR_LINES, rounds: int = ROUNDS) -> Model:
        """Expectation-maximisation on pages held in memory."""
        model = cls.prior()
        if pages := list(packed(texts)):
            for _ in range(rounds):
                model = cls.from_counts(sum(model.counts(codes, starts) for _, codes, _, starts in pages), prior_lines)
        return model

    def line_shares(self, codes: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pages x states) the share of each page's words in each state, and which pages have words."""
        seen, found, whole = self.seen(COMBINATIONS), [], []
        linked = COMBINATIONS[:, [2, 6]].any(axis=1)
        for i, j in _chunks(starts):
            some, weight, begins = codes[starts[i] : starts[j]], words[starts[i] : starts[j]].copy(), starts[i : j + 1] - starts[i]
            path, first, n = self._likeliest(seen[some], begins), begins[:-1], j - i
            heading = (path[first] == STATES.index("menu")) & (weight[first] <= HEADING) & ~linked[some[first]] & (np.diff(begins) > 1)
            whole.append(np.add.reduceat(weight, first) > 0)
            weight[first[heading]] = 0
            page = np.repeat(np.arange(n), np.diff(begins))
            total = np.maximum(np.bincount(page, weight, n), 1)
            found.append(np.stack([np.bincount(page, weight * (path == k), n) / total for k in range(len(STATES))], axis=1))
        return np.concatenate(found), np.concatenate(whole)

    def page_shares(self, texts: list[str | None]) -> list[tuple[float, ...] | None]:
        """The share of each text's words in each state, or None for a text without words."""
        out: list[tuple[float, ...] | None] = [None] * len(texts)
        for places, codes, words, starts in packed(texts):
            shares, whole = self.line_shares(codes, words, starts)
            for i, s, w in zip(places, shares.tolist(), whole.tolist()):
                out[i] = tuple(s) if w else None
        return out

    def shares(self, text: str | None) -> dict[str, float] | None:
        """The share of one text's words in each state."""
        found = self.page_shares([text])[0]
        return None if found is None else dict(zip(STATES, found))


def _by_place(starts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Lines ordered by their place in their page, longest page first, and where each place begins, and the end."""
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    still = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")  # how many pages have a line at each place
    cut = np.concatenate([[0], np.cumsum(still)])
    place = np.repeat(np.arange(len(still)), still)
    return starts[:-1][order][np.arange(cut[-1]) - cut[place]] + place, cut.tolist()


def _chunks(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of whole pages of about CHUNK_LINES lines."""
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_LINES, side="right")) - 1)
        yield i, j
        i = j


def packed(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(places of texts that have lines, packed features of their lines, words of the lines, first lines and the end), some texts at a time."""
    group: list[tuple[int, list[str]]] = []
    size = 0
    for i, t in enumerate(texts):
        if t and (ls := lines_of(t)):
            group.append((i, ls))
            size += len(t)
        if group and (size >= CHUNK or i == len(texts) - 1):
            rows, words, starts = features([p for _, p in group])
            yield [j for j, _ in group], rows @ RADIX, words, starts
            group, size = [], 0


def page_lines(pages: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, text_id, codes, words): the packed features and the words of the lines of every page that has lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, codes, words, starts in packed(b.column(2).to_pylist()):
                codes, words, bounds = codes.astype("<u2").tobytes(), words.astype("<f8").tobytes(), list(zip(starts.tolist(), starts[1:].tolist()))
                kept = pa.array(places)
                lines = [pa.array([x[n * a : n * z] for a, z in bounds], pa.binary()) for x, n in ((codes, 2), (words, 8))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept), *lines], [key, "text_id", "codes", "words"])

    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, text_id binary, codes binary, words binary"
    return pages.select(F.col(key), F.unhex(F.md5(column)).alias("text_id"), F.col(column)).mapInArrow(run, schema)


def _unpacked(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, and where those of each row begin, and the end."""
    rows = column.to_pylist()
    numbers = np.frombuffer(b"".join(rows), dtype)
    return numbers, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64) // numbers.itemsize


def fit_lines(lines: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation on all lines of a table of ``page_lines``, copies of a text once; a round is one pass over the packed features."""
    sc, model = lines.sparkSession.sparkContext, Model.prior()
    once = materialize(lines.select("text_id", "codes").distinct().select("codes"), "page-codes")
    for _ in range(rounds):
        shared = sc.broadcast(model)  # a few tables of fixed size

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts = 0
            for b in batches:
                if b.num_rows:
                    counts = counts + shared.value.counts(*_unpacked(b.column(0), "<u2"))
            if np.ndim(counts):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int32()), pa.array(np.rint(counts / UNIT).astype(np.int64))], ["i", "n"])

        sums = once.mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()  # one row for each cell of the model
        shared.unpersist()
        if not sums:
            break
        model = Model.from_counts(np.array([r["n"] for r in sums]) * UNIT)
    discard(once)
    return model


def fit(pages: DataFrame, column: str = "text") -> Model:
    """Train on all pages."""
    lines = materialize(page_lines(spread(pages.select(F.lit(0).alias("page"), column)), "page", column).select("text_id", "codes"), "page-lines")
    model = fit_lines(lines)
    discard(lines)
    return model


def line_shares(lines: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, prose, links, tags, menu) of a table of ``page_lines``, for every page with words."""
    shared = lines.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, starts = _unpacked(b.column(1), "<u2")
            shares, whole = shared.value.line_shares(codes, _unpacked(b.column(2), "<f8")[0], starts)
            kept = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), *(pa.array(s) for s in shares[kept].T)], [key, *STATES])

    schema = f"`{key}` {lines.schema[key].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATES)
    return lines.select(key, "codes", "words").mapInArrow(run, schema)


def page_shares(pages: DataFrame, model: Model, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, prose, links, tags, menu): the share of words in each state, for every page with words."""
    return line_shares(page_lines(pages, key, column), model, key)


def fitted_shares(pages: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``page_shares`` by the model fitted on the same pages; their texts are parsed once."""
    lines = materialize(page_lines(spread(pages), key, column), "page-lines")
    return line_shares(lines, fit_lines(lines), key)


def flagged(shares: DataFrame, least: float = FLAGGED_SHARE) -> DataFrame:
    """Pages whose words lie for the greater part outside prose."""
    return shares.filter(1 - F.col("prose") > least)
