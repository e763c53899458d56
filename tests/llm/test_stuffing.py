"""Keyword-stuffed pages: made pages of every kind, honest pages that look alike, Viterbi against brute force, odd inputs."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from revora.llm import stuffing as s

PROSE = "We came on a wet Tuesday with my parents, and the lobby was quiet. The night porter told us about the flood marks. It was worth the walk from the station, although the signs are hard to read."
JA = "駅から送迎があり、夕方でも待たずに乗れました。館内は広く、展示の説明も丁寧でした。次は家族を連れて行きたいと思います。"
HONEST = {
    "prose": PROSE, "japanese": JA, "reading list": PROSE + "\nFurther reading:\n- https://a.example/1\n- https://b.example/2\n- https://c.example/3",
    "hours": PROSE + "\n" + "\n".join(f"{d}  9:00-17:30" for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")), "menu": JA + "\n蕎麦 … 900円\n地酒 … 700円\nカレー … 1200円",
    "tags": JA + "\n#温泉 #旅行 #展示", "wrapped": "\n".join(PROSE[i : i + 24] for i in range(0, len(PROSE), 24)), "unmarked": PROSE.replace(".", "").replace(",", "").lower(),
    "repeats": JA + "\n本当に、本当に、本当に、本当に、楽しかった。",
}
SPAM = {
    "repeated": "cheap hotel best spa discount pass " * 40, "japanese": "温泉旅館 予約 最安値, 入館料 クーポン, 家族旅行 安い, " * 20, "links": "\n".join(f"https://x{i}.example/abc{i}" for i in range(30)),
    "anchors": "\n".join(f'<a href="https://x{i}.example/a">museum tickets {i}</a>' for i in range(30)), "hashtags": " ".join(f"#tag{i % 9}spa" for i in range(80)), "joined tags": "".join(f"#温泉{i % 7}観光" for i in range(80)),
    "products": "\n".join(f"Folk souvenir | SKU{i:06d} | M | red | gift shop sale" for i in range(25)), "menu": " > ".join(f"Place{i} free parking" for i in range(50)),
    "one line": "海の館 家族旅行 安い ・ " * 60 + "\n海の館", "between sentences": "駅から送迎があり、待たずに乗れました。 格安 宿 人気 ランキング, 予約 最安値 海の館, 入館料 クーポン 格安 宿, 館内は広く、展示の説明も丁寧でした。 駐車場 無料 海の館, 温泉 日帰り 観光 おすすめ, " * 6,
    "fake sentences": "海の館 予約 最安値なら海の館 予約 最安値。海の館 予約 最安値は海の館 予約 最安値で検索。" * 10, "after prose": JA + "\n" + "\n".join("格安 宿 観光 おすすめ 人気 ランキング" for _ in range(30)),
}


@pytest.fixture(scope="module")
def model():
    return s.Model.train([*HONEST.values()] * 20 + [*SPAM.values()] * 2)


@pytest.mark.parametrize("kind", sorted(HONEST))
def test_honest(model, kind):
    assert 1 - model.shares(HONEST[kind])["prose"] <= s.FLAGGED_SHARE


@pytest.mark.parametrize("kind", sorted(SPAM))
def test_spam(model, kind):
    assert 1 - model.shares(SPAM[kind])["prose"] > s.FLAGGED_SHARE


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    model = s.Model.prior()
    for _ in range(20):
        rows = np.stack([rng.integers(0, k, 4) for k in s.FEATURES.values()], axis=1)
        seen = [sum(e[:, r[i]] for i, e in enumerate(model.emission)) for r in rows]
        starts = np.array([0, 4])
        score = lambda p: model.first[p[0]] + seen[0][p[0]] + sum(model.step[a, b] + seen[i + 1][b] for i, (a, b) in enumerate(zip(p, p[1:])))
        best = max(itertools.product(range(4), repeat=4), key=score)
        assert score(tuple(model.label(rows, starts))) == pytest.approx(score(best))


def test_prior_tables_sum_to_one():
    for state, table in s.PRIOR.items():
        for f, k in s.FEATURES.items():
            assert len(table[f]) == k and sum(table[f]) == pytest.approx(1, abs=1e-9), (state, f)


def test_fitting_changes_the_model_and_what_it_finds():
    """Pages of a kind the table doesn't know: after fitting their lines are told from prose more surely."""
    pages = [*HONEST.values()] * 20 + [*SPAM.values()] * 4
    fitted, table = s.Model.train(pages), s.Model.prior()
    assert max(abs(np.exp(a) - np.exp(b)).max() for a, b in zip(fitted.emission, table.emission)) > 0.2
    assert abs(np.exp(fitted.step) - np.exp(table.step)).max() > 0.1

    def likelihood(model):  # of the states that are told, per line
        rows, _, starts = s.features([s.lines_of(t) for t in pages])
        return float(model.seen(rows)[np.arange(len(rows)), model.label(rows, starts)].mean())

    assert likelihood(fitted) > likelihood(table) + 0.2


def test_expected_states_against_brute_force():
    rng = np.random.default_rng(2)
    model = s.Model.prior()
    rows = np.stack([rng.integers(0, k, 7) for k in s.FEATURES.values()], axis=1)
    starts = np.array([0, 3, 7])
    chance, first, steps = model.expected(rows, starts)
    seen = model.seen(rows)
    want, move = np.zeros_like(chance), np.zeros((4, 4))
    for a, b in ((0, 3), (3, 7)):
        paths = list(itertools.product(range(4), repeat=b - a))
        weight = np.exp([model.first[p[0]] + sum(seen[a + i, k] for i, k in enumerate(p)) + sum(model.step[x, y] for x, y in zip(p, p[1:])) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            for i, k in enumerate(p):
                want[a + i, k] += w
            for x, y in zip(p, p[1:]):
                move[x, y] += w
    assert np.allclose(chance, want) and np.allclose(steps, move) and np.allclose(first, want[[0, 3]].sum(axis=0))


def test_pages_together_and_alone(model):
    pages = [*HONEST.values(), *SPAM.values(), "", None]
    for alone, together in zip((model.page_shares([p])[0] for p in pages), model.page_shares(pages)):
        assert (alone is None) == (together is None) and (alone is None or np.allclose(alone, together))


def test_table(spark, model):
    rows = [(1, SPAM["links"], 1.0), (2, None, 1.0), (3, "", 1.0), (4, " \n ", None), (5, PROSE * 3000, 1.0), (1, SPAM["links"], 1.0), (None, SPAM["menu"], 1.0), (6, "123 456", 1.0), (7, "。。。", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prose double")
    got = sorted((str(r["doc_id"]) for r in s.flagged(s.page_shares(df, model)).collect()))
    assert got == ["1", "1", "None"]
    assert s.page_shares(df.limit(0), model).count() == 0


def test_query(spark, folder):
    from revora.llm import queries

    shares = queries.p10_shares(spark, folder)
    assert all(abs(r["prose"] + r["links"] + r["tags"] + r["menu"] - 1) < 1e-9 for r in shares.collect())
    assert queries.p10_found(spark, folder).columns == ["doc_id"]


def _apart(a, b):
    return max(abs(np.exp(x) - np.exp(y)).max() for x, y in zip([*a.emission, a.first, a.step], [*b.emission, b.first, b.step]))


def test_fit_uses_every_page_whole(spark):
    """More pages than a sample would hold, one of them long: the same model as from all of them in memory."""
    texts = [f"{PROSE} Room {i}." if i % 40 else f"Place{i} > free parking > spa {i}" for i in range(2000)] + ["\n".join(f"{JA}{i}" for i in range(1500)), " \n", None]
    fitted = s.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    whole = s.Model.train([t for t in texts if t])
    assert _apart(fitted, whole) < 1e-6 and _apart(s.Model.train(texts[:1500]), whole) > 1e-4


def test_fit_counts_copies_once(spark):
    texts = [PROSE, JA, SPAM["links"], SPAM["menu"]]
    copied = spark.createDataFrame([(t,) for t in texts + [SPAM["menu"]] * 50 + [None, ""]], "text string")
    assert _apart(s.fit(copied), s.Model.train(texts)) < 1e-6
    assert _apart(s.fit(copied.limit(0)), s.Model.prior()) < 1e-12


def test_table_keeps_its_weight_on_more_pages():
    some = [*HONEST.values()] * 1000 + [*SPAM.values()] * 100
    assert sum(len(s.lines_of(t)) for t in some) > 24_000
    assert _apart(s.Model.train(some), s.Model.train(some * 4)) < 1e-6


def test_fitted_shares_are_those_of_the_fitted_model(spark):
    rows = [(i, t) for i, t in enumerate([*HONEST.values(), *SPAM.values(), None, "", "123 456"])] + [(None, SPAM["links"]), (2**60 + 1, PROSE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(s.fitted_shares(df).collect(), key=str)
    want = sorted(s.page_shares(df, s.fit(df)).collect(), key=str)
    assert got == want and 2**60 + 1 in {r["doc_id"] for r in got}
    assert s.fitted_shares(df.limit(0)).collect() == []
