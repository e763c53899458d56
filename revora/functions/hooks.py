"""Where models that are not part of this library can be put in: tokenizers, embedders, annotators.

Each hook takes a list of texts and returns one result for each, and runs in
Arrow batches on the executors, so it must be importable there.  Without a
hook the built-in expressions are used.

Defined results: null texts are not given to a hook and have a null result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, functions as F


class Tokenizer(Protocol):
    def __call__(self, texts: list[str]) -> list[list[str]]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Annotator(Protocol):
    """Gives a JSON record for each text, such as sentiment, theme and phase."""

    def __call__(self, texts: list[str]) -> list[str]: ...


def applied(hook: Callable[[list[str]], list], text: Column, result: str) -> Column:
    """The hook's results as a column of the type ``result``; raises if it gives another number of results than it was asked for."""

    @F.pandas_udf(result)
    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        asked = texts[known].tolist()
        found = list(hook(asked)) if asked else []
        if len(found) != len(asked):
            raise ValueError(f"the hook gave {len(found)} results for {len(asked)} texts")
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        for i, x in zip(texts.index[known], found):
            out[i] = x
        return out

    return run(text)


def tokenized(tokenizer: Tokenizer, text: Column) -> Column:
    return applied(tokenizer, text, "array<string>")


def embedded(embedder: Embedder, text: Column) -> Column:
    return applied(embedder, text, "array<double>")


def annotated(annotator: Annotator, text: Column) -> Column:
    return applied(annotator, text, "string")
