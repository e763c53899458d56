"""Garbled text from a wrong character encoding: find it, name the chain, restore it.

A chain is a list of (written as, read as) steps.  A multinomial classifier on
hashed byte bigrams is trained on texts of the corpus that are garbled here
with every chain; it gives each sentence of a text a score for each chain and
for 'clean'.  The chains in order of score are then undone: a sentence counts
as damaged if a chain decodes strictly, in every step, to text that is more
like clean text; or, where the reading lost characters (U+FFFD), if the
classifier is certain and what is left decodes to more likely text.

Only bigrams with a byte beyond ASCII are features, as ASCII is the same in
all chains.  Training uses a bounded sample (``SAMPLE_TEXTS``), the texts with
the smallest hashes; every text of the corpus is judged, whole.

Defined results: null, empty and pure ASCII texts are clean (but for ISO 2022
escapes); a text is restorable if each damaged sentence decoded strictly;
repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .sampling import hash_sample

#: Bound of the training sample, in texts.
SAMPLE_TEXTS = 4000
BUCKETS = 16381
SMOOTHING = 0.02
#: Nats by which a lossy chain must beat 'clean', and gain in nats per bigram that undoing must bring.
LOSSY_MARGIN, GAIN = 6.0, 0.4
#: The same where both encodings are single-byte, so that undoing can't fail and proves nothing.
FREE_MARGIN, FREE_GAIN = 12.0, 1.0

_SINGLE = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp932"), ("utf-8", "euc-jp"), ("utf-8", "mac-roman"), ("utf-8", "cp437"),
    ("utf-8", "cp850"), ("utf-8", "gbk"), ("utf-8", "big5"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"), ("utf-8", "cp1250"), ("utf-8", "cp949"),
    ("cp932", "cp1252"), ("cp932", "latin-1"), ("cp932", "utf-8"), ("cp932", "mac-roman"), ("cp932", "cp437"), ("cp932", "euc-jp"), ("cp932", "gbk"),
    ("euc-jp", "cp1252"), ("euc-jp", "latin-1"), ("euc-jp", "cp932"), ("euc-jp", "utf-8"), ("euc-jp", "gbk"), ("euc-jp", "mac-roman"),
    ("cp1252", "utf-8"), ("cp1252", "cp932"), ("cp1252", "mac-roman"), ("cp1252", "cp437"), ("cp1252", "cp1251"), ("mac-roman", "cp1252"), ("cp437", "cp1252"),
]
_BYTEWISE = {"cp1252", "cp1250", "cp1251", "latin-1", "mac-roman", "cp437", "cp850", "koi8-r"}
#: Encodings whose pairs of high bytes are nearly all readable in one another.
_PAIRWISE = {"euc-jp", "gbk", "big5", "cp949"}
CHAINS: list[tuple[tuple[str, str], ...]] = [(c,) for c in _SINGLE] + [(c, c) for c in _SINGLE[:2]] + [(_SINGLE[0],) * 3]

_ESCAPES = re.compile(r"\x1b\$[@B]|\x1b\([BJ]|\$B(?:[!-~]{2}){2,}\([BJ]")


def _table(name: str) -> tuple[list[str], dict[str, int]]:
    """A single-byte encoding whose unused bytes stand for the control characters of the same number."""
    chars = [bytes([i]).decode(name, "ignore") or chr(i) for i in range(256)]
    return chars, {c: i for i, c in enumerate(chars)}


_TOTAL = {n: _table(n) for n in ("cp1252", "cp1250", "cp1251")}


def read_as(data: bytes, name: str) -> str:
    """Bytes read in an encoding; what can't be read becomes U+FFFD."""
    if name in _TOTAL:
        return "".join(map(_TOTAL[name][0].__getitem__, data))
    return data.decode(name, "replace")


def written_as(text: str, name: str, lossy: bool = False) -> bytes | None:
    """The bytes a text was read from, or None; ``lossy`` puts 0xFF for characters without any."""
    if name in _TOTAL:
        back = _TOTAL[name][1]
        if lossy:
            return bytes(back.get(c, 0xFF) for c in text)
        try:
            return bytes(map(back.__getitem__, text))
        except KeyError:
            return None
    try:
        return text.encode(name)
    except UnicodeEncodeError:
        return b"".join(c.encode(name, "ignore") or b"\xff" for c in text) if lossy else None


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for written, read in chain:
        data = written_as(text, written)
        if data is None:
            return None
        text = read_as(data, read)
    return text


def undo(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, strictly, or None."""
    for written, read in reversed(chain):
        data = written_as(text, read)
        if data is None:
            return None
        try:
            text = data.decode(written)
        except UnicodeDecodeError:
            return None
    return text


def undo_lossy(text: str, chain: tuple[tuple[str, str], ...]) -> str:
    """What can be read of the text before the chain; U+FFFD where nothing can."""
    for written, read in reversed(chain):
        text = written_as(text, read, lossy=True).decode(written, "replace")
    return text


def _ends() -> re.Pattern:
    """Where sentences end: after a mark, as it is or as any chain garbles it."""
    marks = {g for c in CHAINS for m in "。！？" if (g := garble(m, c)) and len(g) > 1 and g.strip("�")}
    # in readings of two bytes a mark's first byte may join the character before it
    marks |= {g[-2:] for c in CHAINS for x in "すたんい館" if (g := garble(x + "。", c)) and "�" in g[-2:] and any("\x80" <= y <= "\x9f" for y in g[-2:])}
    return re.compile("(" + "|".join(map(re.escape, sorted(marks, key=lambda m: (-len(m), m)))) + r"|[。！？\n]|[.!?](?=\s))")


_END = _ends()


def sentences(text: str) -> list[str]:
    out = _END.split(text)
    return [p for i in range(0, len(out), 2) if (p := out[i] + (out[i + 1] if i + 1 < len(out) else ""))]


def _bigrams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, piece) of every bigram with a byte beyond ASCII."""
    data = [p.encode("utf-8", "replace") for p in pieces]
    flat = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    owner = np.repeat(np.arange(len(data)), [len(d) + 1 for d in data])
    a, b = flat[:-1].astype(np.int64), flat[1:].astype(np.int64)
    use = ((a | b) >= 0x80) & (owner[:-1] == owner[1:])
    return ((a[use] * 8191 + b[use] * 127) % BUCKETS), owner[:-1][use]


class Model:
    """Log-probabilities of hashed bigrams under 'clean' (row 0) and every chain."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    @classmethod
    def train(cls, texts: list[str], again: bool = True) -> Model:
        """Fit on texts taken as clean; then once more without those that the first fit finds damaged."""
        if again:
            first = cls.train(texts[::3], again=False)  # enough to find what is plainly damaged
            texts = [t for t, verdict in zip(texts, first.check(texts)) if verdict is None]
        pieces = [p for t in texts for p in sentences(t) if not p.isascii()]
        rows = []
        for chain in [(), *CHAINS]:
            made = [g for p in pieces if (g := garble(p, chain)) is not None and (not chain or g != p)]
            counts = np.full(BUCKETS, SMOOTHING)
            for i in range(0, len(made), 2000):
                counts += np.bincount(_bigrams(made[i : i + 2000])[0], minlength=BUCKETS)
            rows.append(np.log(counts / counts.sum()))
        return cls(np.array(rows, dtype=np.float32))

    def scores(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces x classes) log-likelihoods, and the number of bigrams of each piece."""
        bucket, owner = _bigrams(pieces)
        n = np.bincount(owner, minlength=len(pieces))
        out = np.stack([np.bincount(owner, weights=w[bucket], minlength=len(pieces)) for w in self.weights], axis=1)
        return out, n

    def clean_rate(self, text: str) -> float:
        """Mean log-likelihood of a text's bigrams as clean text; that of a uniform choice where it has none."""
        bucket, _ = _bigrams([text])
        return float(self.weights[0][bucket].mean()) if len(bucket) else -7.0

    def judge(self, piece: str, scores: np.ndarray, n: int) -> tuple[tuple, str, bool] | None:
        """(chain, restored text, strictly) of a damaged sentence, else None."""
        rate, margin = float(scores[0]) / max(n, 1), scores[1:] - scores[0]
        order = np.argsort(-margin)
        undone: list[tuple[float, int, str]] = []
        for k in order:
            if margin[k] <= 0:
                break
            written, read = CHAINS[k][-1]
            if read == "utf-8":
                continue  # such a reading loses what it can't read; see below
            free = (written in _BYTEWISE and read in _BYTEWISE) or (written in _PAIRWISE and read in _PAIRWISE)
            if free and (margin[k] < FREE_MARGIN or sum(not c.isascii() for c in piece) < 2):
                continue
            back = undo(piece, CHAINS[k])
            if back is None or back == piece or "�" in back:
                continue
            # two or more characters in valid UTF-8 don't come by chance
            sure = written == "utf-8" and sum(not c.isascii() for c in back) > 1
            if (now := self.clean_rate(back)) > rate + (FREE_GAIN if free else 0.0 if sure else GAIN):
                undone.append((now, -int(k), back))
        if undone:
            _, k, back = max(undone)
            return CHAINS[-k], back, True
        best = int(order[0])
        chain = CHAINS[best]
        if margin[best] > LOSSY_MARGIN and "�" in piece:
            return chain, piece if chain[-1][1] == "utf-8" else undo_lossy(piece, chain), False
        if margin[best] > FREE_MARGIN and chain[-1][1] != "utf-8" and not (chain[-1][0] in _BYTEWISE and chain[-1][1] in _BYTEWISE):
            back = undo_lossy(piece, chain)
            kept = back.replace("�", "")
            beyond = sum(not c.isascii() for c in kept)
            if beyond >= 3 and back.count("�") <= 0.2 * beyond and self.clean_rate(kept) > rate + FREE_GAIN:
                return chain, back, False
        return None

    def check(self, texts: list[str]) -> list[tuple[list[str], str, bool] | None]:
        """(chains, restored text, restorable) of each text that is damaged, None for each clean one."""
        split = [[] if t is None or t.isascii() else sentences(t) for t in texts]
        own = list(dict.fromkeys(p for ps in split for p in ps if not p.isascii()))
        found: dict[str, tuple] = {}
        for i in range(0, len(own), 2000):
            part = own[i : i + 2000]
            scores, n = self.scores(part)
            for j in np.flatnonzero(scores[:, 1:].max(axis=1) > scores[:, 0]):
                verdict = self.judge(part[j], scores[j], int(n[j]))
                if verdict:
                    found[part[j]] = verdict
        out: list = []
        for text, ps in zip(texts, split):
            hit = [found[p] for p in ps if p in found]
            if hit:
                names = sorted({" > ".join(f"{w}:{r}" for w, r in chain) for chain, _, _ in hit})
                out.append((names, "".join(found[p][1] if p in found else p for p in ps), all(ok for _, _, ok in hit)))
            elif text and _ESCAPES.search(text):
                out.append((["iso2022_jp:ascii"], *_undo_escapes(text)))
            else:
                out.append(None)
        return out


def _undo_escapes(text: str) -> tuple[str, bool]:
    """ISO 2022 text, with its escape characters or with them lost."""
    whole = text
    if "\x1b" not in text:
        whole = re.sub(r"(\$[@B])((?:[!-~]{2})+?)(\([BJ])", "\x1b\\1\\2\x1b\\3", text)
    out = []
    for i, part in enumerate(re.split("([^\x00-\x7f]+)", whole)):
        if i % 2:
            out.append(part)
            continue
        try:
            out.append(part.encode("ascii").decode("iso2022_jp"))
        except UnicodeDecodeError:
            return text, False
    return "".join(out), True


def fit(texts: DataFrame, column: str = "text", sample: int = SAMPLE_TEXTS) -> Model:
    """Train on the ``sample`` texts with the smallest hashes among those beyond ASCII."""
    return Model.train(hash_sample(texts.filter(F.col(column).rlike(r"[^\x00-\x7F]")), column, sample, 2000))


def damaged(texts: DataFrame, model: Model, keys: dict[str, str], column: str = "text") -> DataFrame:
    """(keys..., chains, restored, restorable) of every damaged text; ``keys`` maps key columns to their types."""
    schema = ", ".join(f"`{k}` {t}" for k, t in keys.items()) + ", chains array<string>, restored string, restorable boolean"
    names = [*keys, "chains", "restored", "restorable"]
    weights = texts.sparkSession.sparkContext.broadcast(model.weights)  # buckets x classes, a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Model(weights.value)
        for b in batches:
            rows = []
            for row, verdict in zip(b.itertuples(index=False), judge.check(b[column].tolist())):
                if verdict:
                    rows.append((*row[: len(keys)], *verdict))
            yield pd.DataFrame(rows, columns=names)

    beyond = texts.filter(F.col(column).rlike(r"[^\x00-\x7F]|\x1b|\$[@B]"))
    return beyond.select(*keys, column).mapInPandas(run, schema)
