"""Encoding against the tokenizer's own library, on ordinary and odd texts."""

from __future__ import annotations

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")

from revora.llm import tokenize as t  # noqa: E402


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(t.tokenizer_path())
    own.encode_special_tokens = True
    return lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return t.Encoder(t.load_merges(t.tokenizer_path()))


def _odd(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    pool = "".join(map(chr, [*range(0x250), *range(0x2000, 0x2070), *range(0x3000, 0x3100), 0x1F44D, 0x200D, 0x85, 0xFEFF, 0x10400])) + "aaaaaa'''s  "
    return ["".join(rng.choice(pool if rng.random() < 0.5 else "a l\n t") for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_same_ids(encoder, library):
    texts = _odd(800, 1) + ["a" * k for k in (1, 2, 3, 31, 64, 999)] + [" " * 50, "\n\n x", "<|endoftext|>", "あ" * 500, "ab" * 777, "I'll we're O'Neil 3rd"]
    assert [x.tolist() for x in encoder.encode(texts)] == library(texts)


def test_chunks_do_not_matter(encoder, library, monkeypatch):
    texts = _odd(200, 2)
    monkeypatch.setattr(t, "CHUNK_CHARS", 40)
    fresh = t.Encoder(encoder.t)
    assert [x.tolist() for i, j in t._slices(texts) for x in fresh.encode(texts[i:j])] == library(texts)


def test_table(spark, library):
    rows = [(1, None, 5, "x"), (2, "", 6, "x"), (3, "  \n", 7, None), (4, "日本 text", 8, "x"), (4, "日本 text", 8, "x"), (None, "n", 1, "x"), (5, "word " * 40_000, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, offsets string")
    got = sorted((tuple(map(str, (r["doc_id"], list(r["ids"])))) for r in t.encode_corpus(df).collect()))
    want = sorted(tuple(map(str, (k, [] if not x else library([x])[0]))) for k, x, _, _ in rows)
    assert got == want
    assert t.encode_corpus(df.limit(0)).count() == 0


def test_documents(spark, folder, library):
    from revora.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in queries.p8_ids(spark, folder).collect()}
    assert got == {k: [] if not x else library([x])[0] for k, x in texts.items()}
