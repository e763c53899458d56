"""Encoding repair: held-out accuracy on texts garbled here, exact restoration, harmless texts, odd inputs."""

from __future__ import annotations

import random

import pytest

from revora.llm import mojibake as m


@pytest.fixture(scope="module")
def texts(spark, folder):
    rows = [r["text"] for r in spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/review.parquet").select("text").distinct().collect()]
    own = [t for t in rows if t and not t.isascii() and "�" not in t and not any("\x80" <= c <= "\x9f" for c in t)]
    random.Random(4).shuffle(own)
    return own


@pytest.fixture(scope="module")
def model(texts):
    return m.Model.train(texts[: len(texts) // 2][:2000])


@pytest.fixture(scope="module")
def clean(model, texts):
    """Held-out texts, without those that are damaged in the data already."""
    rest = texts[len(texts) // 2 :]
    return [t for t, v in zip(rest, model.check(rest)) if v is None][:600]


@pytest.mark.parametrize("chain", [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp932"),), (("cp932", "cp1252"),), (("euc-jp", "cp932"),), (("cp932", "utf-8"),), (("utf-8", "cp437"),), (("utf-8", "mac-roman"),), (("utf-8", "cp1252"),) * 2])
def test_held_out_accuracy(model, clean, chain):
    made = [(t, g) for t in clean if (g := m.garble(t, chain)) is not None and g != t][:250]
    found = model.check([g for _, g in made])
    assert sum(v is not None for v in found) >= 0.97 * len(made)
    whole = [(t, v) for (t, g), v in zip(made, found) if "�" not in g and v is not None and v[2]]
    if chain[-1][1] in ("cp1252", "latin-1", "cp437", "mac-roman"):
        assert len(whole) >= 0.9 * len(made) and sum(v[1] == t for t, v in whole) >= 0.95 * len(whole)


def test_partly_damaged(model, clean):
    sentence = next(t for t in clean if len(t) > 20 and "館" in t)
    mixed = "きれいな所でした。" + m.garble(sentence, (("utf-8", "cp1252"),)) + "また来ます。"
    verdict = model.check([mixed])[0]
    assert verdict is not None and verdict[1] == "きれいな所でした。" + sentence + "また来ます。"


def test_harmless(model):
    harmless = ["A exposição de MAÇÃS E PÃES artesanais é ótima, não percam.", "縺れた糸の展示が印象的。", "繧繝縁の畳がきれいでした。", "ｽﾀｯﾌさん親切(^^)♪", "Ω≈3 Ohm exhibit, Привет from the guest book!", "Ça va. Â bientôt?", "ÅNGSTRÖM hall, 20 °C inside", "©の表記が小さい…"]
    assert [v for v in model.check(harmless) if v] == []


def test_iso2022(model):
    text = "温泉が良かった。"
    assert model.check([text.encode("iso2022_jp").decode("ascii")])[0][1] == text


def test_odd_inputs(spark, model):
    assert model.check([None, "", " ", "plain ascii"]) == [None] * 4
    long = "とても良い展示でした。" * 20_000
    bad = m.garble(long, (("utf-8", "cp1252"),))
    assert model.check([long, bad])[0] is None and model.check([bad])[0][1] == long
    rows = [(1, None, "x"), (2, "", "x"), (3, m.garble("また来ます。良かった。", (("utf-8", "cp1252"),)), None), (3, m.garble("また来ます。良かった。", (("utf-8", "cp1252"),)), None)]
    df = spark.createDataFrame(rows, "id long, text string, restored string")
    assert [(r["id"], r["restorable"]) for r in m.damaged(df, model, {"id": "bigint"}).collect()] == [(3, True)] * 2
    assert m.damaged(df.limit(0), model, {"id": "bigint"}).count() == 0


def test_every_chain_with_a_positive_margin_is_tried():
    import numpy as np

    from revora.llm import mojibake as mj

    want = "庭の石は夜明けに濡れていた。"
    right = next(k for k, c in enumerate(mj.CHAINS) if len(c) == 1 and c[0][0] == "utf-8" and (g := mj.garble(want, c)) and mj.undo(g, c) == want)
    piece = mj.garble(want, mj.CHAINS[right])
    model = mj.Model(np.zeros((len(mj.CHAINS) + 1, 1)))
    model.clean_rate = lambda text: 0.0 if text == want else -9.0
    scores = np.array([-50.0, *(-40.0 + k / 100 for k in range(len(mj.CHAINS)))])
    scores[right + 1] = -49.0  # the last of all chains
    assert model.judge(piece, scores, 10) == (mj.CHAINS[right], want, True)
