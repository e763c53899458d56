"""Sentences, tokens and scripts of review texts, as JVM-side expressions.

The three ways to split sentences differ on purpose: topics use every piece,
remarks only pieces of a readable length, experience pieces of three
characters or more.  Tokens are runs of one script (Latin letters with their accents) of two characters or more,
hiragana left out as it carries endings; a morphological tokenizer can take its
place by :func:`use_tokenizer`, as all operators take arrays of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .hooks import Tokenizer, tokenized

TOPIC_SPLIT = "[。！？!?\\n]+"
PLAIN_SPLIT = "[。！？\\n]+"
SPACES = "[ \\t\\r\\n\\f\\x0B　]"
TOKEN = "[ァ-ヶー]{2,}|[一-龥々]{2,}|[a-zß-öø-ɏ]{2,}"
JAPANESE_LETTER = "[ぁ-ゖゝ-ゟァ-ヺー-ヿ一-鿿]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}+|{SPACES}+$", "")


def trimmed_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[ \\t\\r\\n\\f\\x0B　]+|[ \\t\\r\\n\\f\\x0B　]+$', '', 'g')"


def topic_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, TOPIC_SPLIT), trimmed), lambda s: s != "")


def topic_sentences_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, '[。！？!?\\n]+'), lambda s: {trimmed_sql('s')}), lambda s: s <> '')"


_TOKENIZER: list[Tokenizer] = []


def use_tokenizer(tokenizer: Tokenizer | None) -> None:
    """Put a tokenizer in the place of the built-in expression, for all operators; None takes it out again."""
    _TOKENIZER[:] = [tokenizer] if tokenizer else []


def tokens(text: Column) -> Column:
    if _TOKENIZER:
        return tokenized(_TOKENIZER[0], text)
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}', 0)"


def ngrams(array: Column, n: int) -> Column:
    """Runs of n neighbouring tokens, joined by spaces."""
    starts = F.when(F.size(array) >= n, F.sequence(F.lit(1), F.size(array) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(array, i, n), " "))


def ngrams_sql(array: str, n: int) -> str:
    return f"list_transform(range(1, len({array}) - {n - 2}), lambda i: array_to_string({array}[i:i + {n - 1}], ' '))"


def language(text: Column) -> Column:
    """'empty', 'symbols', 'ja' (half of the letters or more), 'mixed' or 'foreign'."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    ours = F.length(F.regexp_replace(text, JAPANESE_LETTER.replace("[", "[^"), ""))
    return (
        F.when(text.isNull() | (trimmed(text) == ""), "empty").when(letters == 0, "symbols")
        .when(ours * 2 >= letters, "ja").when(ours > 0, "mixed").otherwise("foreign")
    )


def language_sql(text: str) -> str:
    letters = f"length(regexp_replace({text}, '[^\\p{{L}}]', '', 'g'))"
    ours = f"length(regexp_replace({text}, '{JAPANESE_LETTER.replace('[', '[^')}', '', 'g'))"
    return f"CASE WHEN {text} IS NULL OR {trimmed_sql(text)} = '' THEN 'empty' WHEN {letters} = 0 THEN 'symbols' WHEN {ours} * 2 >= {letters} THEN 'ja' WHEN {ours} > 0 THEN 'mixed' ELSE 'foreign' END"
