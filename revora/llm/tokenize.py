"""Encoding of a corpus with a public byte-level BPE tokenizer.

All new words of a batch are laid out as one array of symbols.  A pair
occurrence index maps every mergeable pair, by its rank, to all positions
where it stands.  Ranks are taken from the index in ascending order; each is
applied at all its positions at once, and the neighbouring pairs that this
changes are entered in the index.  A pair made by a merge always has a higher
rank than the merge, so one ascending pass gives exactly the ids of merging
word by word.

Defined results: empty and null texts give an empty list, blank texts are
encoded as they are, and strings that look like special tokens are ordinary
text.  Repeated rows are encoded each; other columns are left out.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: The tokenizer of the project's queries.
DEFAULT = "byte_bpe_50k.json"
#: Characters of new words laid out at once, and words kept between batches.
CHUNK_CHARS, KEPT_WORDS, KEPT_LENGTH = 3_000_000, 200_000, 24
#: Fixed value: how byte-level BPE of this family splits text into words, with white space as Unicode defines it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_names() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself if it is visible, else the next free one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def load_merges(path: str) -> dict[str, np.ndarray]:
    """The vocabulary as arrays: ids of single bytes, and the mergeable pairs sorted by key with their ranks and results."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    width = max(vocab.values()) + 1
    left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
    right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
    keys = left * width + right
    order = np.argsort(keys)
    return {
        "bytes": np.array([vocab[n] for n in byte_names()], dtype=np.int32),
        "width": np.array([width]),
        "keys": keys[order],
        "ranks": order.astype(np.int32),
        "left": left.astype(np.int32),
        "right": right.astype(np.int32),
        "result": np.array([vocab[a + b] for a, b in merges], dtype=np.int32),
    }


class Encoder:
    """Encodes words through a pair occurrence index."""

    def __init__(self, tables: dict[str, np.ndarray]) -> None:
        self.t = tables
        self.width = int(tables["width"][0])
        self.words = regex.compile(WORDS)
        self.kept: dict[str, np.ndarray] = {}

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it can't be merged."""
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.t["keys"], key)
        at[at == len(self.t["keys"])] = 0
        return np.where((self.t["keys"][at] == key) & (a >= 0) & (b >= 0), self.t["ranks"][at], -1)

    def _index(self, index: dict[int, list[np.ndarray]], heap: list[int], at: np.ndarray, rank: np.ndarray) -> None:
        """Enter positions under their ranks."""
        use = rank >= 0
        at, rank = at[use], rank[use]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(at)]
        for r, i, j in zip(rank[bounds[:-1]].tolist(), bounds[:-1], bounds[1:]):
            if r in index:
                index[r].append(at[i:j])
            else:
                index[r] = [at[i:j]]
                heapq.heappush(heap, r)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        data = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        ends = np.cumsum(lengths + 1)
        size = int(ends[-1]) if len(data) else 0
        # words lie behind one another, each followed by a -1 that nothing merges with
        symbols = self.t["bytes"][np.frombuffer(b"\0".join(data) + b"\0", dtype=np.uint8)[:size]].astype(np.int32) if size else np.empty(0, np.int32)
        symbols[ends - 1] = -1
        after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        if size > 1:
            self._index(index, heap, np.arange(size - 1, dtype=np.int32), self._rank_of(symbols[:-1], symbols[1:]))
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            left, right, made = self.t["left"][rank], self.t["right"][rank], self.t["result"][rank]
            at = np.unique(np.concatenate(parts))
            at = at[(symbols[at] == left) & (symbols[after[at]] == right)]
            if left == right and len(at) > 1:  # in a run of equal symbols every second pair merges
                follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbols[at], symbols[gone] = made, -2
            after[at], before[beyond] = beyond, at
            prior = before[at]
            inner = prior >= 0
            spots = np.concatenate([at, prior[inner]])
            first = symbols[spots]
            self._index(index, heap, spots, self._rank_of(first, symbols[after[spots]]))
        ids = symbols[symbols >= 0]
        counts = np.add.reduceat((symbols >= 0).astype(np.int64), np.concatenate([[0], ends[:-1]])) if size else np.empty(0, np.int64)
        return np.split(ids, np.cumsum(counts)[:-1]) if size else []

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.words.findall(t) if t else [] for t in texts]
        known: dict[str, np.ndarray] = {}
        fresh: list[str] = []
        chars = 0
        for w in dict.fromkeys(w for ws in split for w in ws):
            if w in self.kept:
                known[w] = self.kept[w]
            else:
                fresh.append(w)
                chars += len(w)
                if chars >= CHUNK_CHARS:
                    known.update(zip(fresh, self.encode_words(fresh)))
                    fresh, chars = [], 0
        known.update(zip(fresh, self.encode_words(fresh)))
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        self.kept.update((w, ids.copy()) for w, ids in known.items() if len(w) <= KEPT_LENGTH and w not in self.kept)
        none = np.empty(0, np.int32)
        return [np.concatenate([known[w] for w in ws]) if ws else none for ws in split]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about CHUNK_CHARS characters; a longer text is a run of its own."""
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= CHUNK_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids) of every row; ``path`` is the tokenizer's vocabulary file."""
    shared = df.sparkSession.sparkContext.broadcast(load_merges(path or tokenizer_path()))  # one vocabulary, a fixed size
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                ids = encoder.encode(texts[i:j])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), column], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
