"""Name variants: what is linked, what is not, odd inputs, blocks against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from revora.llm import names as n

SAME = [
    ("Kelpieholm Fossil Centre", "KELPIEHOLM FOSS. CTR"), ("Kelpieholm Fossil Centre", "Centre of Fossil - Kelpieholm"), ("Kelpieholm Fossil Centre", "Fossil Centre, Kelpieholm"), ("Kelpieholm Fossil Centre", "Kelpeiholm Foossil Centre"),
    ("Margaret Hesperford Gallery", "The Maggie Hesperford Gall."), ("Margaret Hesperford Gallery", "M. Hesperford Gallery"), ("Ulvercross Folk Memorial House", "UlvercrossFolkMemorialHouse"), ("Sedgeburn Weather Museum", "The Sedgeburn Weather Museum (Eastvale)"),
    ("Jessamby Lighthouse Institute", "Jessamby's Lighthouse Institute"), ("Tolverburn Toy Collection", "Ｔｏｌｖｅｒｂｕｒｎ　Ｔｏｙ　Ｃｏｌｌｅｃｔｉｏｎ"),
    ("鶴浜峠民芸温泉旅館", "鶴濱峠　民芸 温泉旅舘"), ("鶴浜峠民芸温泉旅館", "鶴浜の民芸温旅"), ("青坂郷ガラスギャラリー", "青坂郷がらすぎゃらりー"), ("弓峰町灯台観光ホテル", "弓峰町灯台観光ﾎﾃﾙ"), ("月原丘ガラス温泉旅館", "ガラス温泉旅館（月原丘）"),
    ("弓台丘郷土ギャラリー", "一般財団法人弓台丘郷土ギャラリー"), ("波江郷灯台ミュージアム", "「波江郷灯台ミュージアム前」"), ("雪里岬製糸記念館", "雪里岬製糸記之館"), ("雪里岬製糸記念館", "雪里岬製糸念記館さん"),
]
OTHER = [
    ("Caldgate Toy Hotel", "Caldgate Tea Hotel"), ("Luskby Glass Lodge", "Ruskby Glass Lodge"), ("Umberdale Silk Hotel", "Umbergate Silk Hotel"), ("Tarndale Brewery Gardens", "Tarndale Brewery Hotel"),
    ("朝谷峠海洋ミュージアム", "朝里峠海洋ミュージアム"), ("鷺津郷茶道温泉旅館", "鷺津荘近代ミュージアム"), ("岩原原和紙博物館", "岩原原和紙記念館"), ("Glass Lodge", "ガラス館"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert n.near(a, b) is not None and n.near(b, a) is not None
    assert set(n.blocks(a)) & set(n.blocks(b))


@pytest.mark.parametrize("a, b", OTHER)
def test_other(a, b):
    assert n.near(a, b) is None and n.near(b, a) is None


def test_measures():
    assert n.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert n.swaps_distance("abcd", "abdc", 2) == 1 and n.swaps_distance("abc", "xyz", 2) == 3
    assert n.soundex("robert") == n.soundex("rupert")


def test_odd_names_do_not_break():
    for x in ("", " ", "・", "()", "（）", "★", "a", "の", "さん", "株式会社", "x" * 5000, "館" * 3000, "​", "👍"):
        n.blocks(x)
        n.near(x, "Kelpieholm Fossil Centre")
        n.near(x, "鶴浜峠民芸温泉旅館")


def test_linked(spark):
    facility = [(3, "Kelpieholm Fossil Centre"), (9, "KELPIEHOLM FOSSIL CENTRE"), (5, "鶴浜峠民芸温泉旅館"), (7, "鶴浜峠民芸温泉旅舘"), (8, "朝里峠海洋博物館"), (10, None), (11, " ")]
    typed = [(1, "Kelpieholm Fosil Centre"), (2, "鶴浜の民芸温旅"), (3, None), (4, ""), (5, "朝谷峠海洋博物館"), (6, "Kelpieholm Fosil Centre"), (7, "Kelpieholm Fossil Centre")] + [(100 + i, "鶴浜峠民芸温泉旅館さん") for i in range(50)]
    f = spark.createDataFrame([(*x, "c") for x in facility], "facility_id long, name string, block string")
    t = spark.createDataFrame([(*x, "c") for x in typed], "rec_id long, name string, root string")
    roots, links = n.linked(f, t)
    assert {r["facility_id"]: r["root"] for r in roots.collect()} == {3: 3, 9: 3, 5: 5, 7: 5, 8: 8}
    got = {r["rec_id"]: r["root"] for r in links.collect()}
    assert got == {1: 3, 6: 3, 7: 3, 2: 5} | {100 + i: 5 for i in range(50)}
    roots, links = n.linked(f.limit(0), t)
    assert roots.count() == 0 and links.count() == 0
    assert n.linked(f, t.limit(0))[1].count() == 0


def test_blocks_lose_nothing_against_all_pairs(spark, folder):
    own = [r["name"] for r in spark.read.parquet(f"{folder}/facility.parquet").collect()]
    typed = [r[0] for r in spark.read.parquet(f"{folder}/sample_reviews.parquet").select("place_name").distinct().collect() if r[0] and r[0].strip()]
    near = [(a, b) for a in typed for b in own if n.near(a, b) is not None]
    kept = [(a, b) for a, b in near if set(n.blocks(a)) & set(n.blocks(b))]
    assert len(near) > 50 and len(kept) >= 0.98 * len(near)


def test_bounds_rule_out_no_accepted_pair(folder, spark):
    rng, names = random.Random(9), [x for pair in SAME + OTHER for x in pair]
    typed = [r[0] for r in spark.read.parquet(f"{folder}/sample_reviews.parquet").select("place_name").distinct().collect() if r[0] and r[0].strip()]
    slipped = []
    for name in names + typed[:60]:
        for _ in range(8):
            x = name
            for _ in range(rng.randint(1, 3)):
                i, how = rng.randrange(max(1, len(x) - 1)), rng.randrange(4)
                x = x[:i] + (x[i + 1 : i + 2] + x[i : i + 1], "", x[i : i + 1] * 2, rng.choice("eaノ"))[how] + x[i + (2 if how == 0 else 1) :]
            slipped.append(x)
    left = [x for x in names + typed + slipped if x.strip()]
    shapes = n.Shapes()
    places = np.array([shapes.add(x) for x in left])
    may = np.stack([shapes.may_be_near(places, np.full(len(left), k)) for k in places[: len(names) + 60]], axis=1)
    accepted = [(i, j) for i in range(len(left)) for j in range(len(names) + 60) if n.near(left[i], left[j]) is not None or n.near(left[i], left[j], {}) is not None]
    assert len(accepted) > 300 and all(may[i, j] for i, j in accepted)
    assert may.mean() < 0.2


def test_pairs_against_all_pairs_with_split_blocks(spark, folder, monkeypatch):
    facility = [(r["id"], r["name"]) for r in spark.read.parquet(f"{folder}/facility.parquet").collect() if r["name"] and r["name"].strip()]
    typed = [r[0] for r in spark.read.parquet(f"{folder}/sample_reviews.parquet").select("place_name").distinct().collect() if r[0] and r[0].strip()]
    registered = spark.createDataFrame(facility, "facility_id long, name string")
    known = n.known_words(registered)
    want = {(a, i) for a in typed for i, b in facility if n.near(a, b, known) is not None}
    monkeypatch.setattr(n, "MOST_REGISTERED", 3)
    monkeypatch.setattr(n, "MOST_NAMES", 7)
    got = {(r["name"], r["facility_id"]) for r in n.close_pairs(spark.createDataFrame([(x,) for x in typed], "name string"), registered).collect()}
    assert {p for p in got if p[0] in set(typed)} <= want and len(want - got) <= 0.01 * len(want)


def test_blocks_hold_slips_in_two_words():
    pairs = [("Biuleby Waermill Centre", "Birleby Watermill Centre"), ("F. InvernessC ollection", "Frederick Inverness Collection"), ("L. Drumdale Gardens", "Drumdale Gadens (Leonard)"), ("Kelpieholm", "Kepielolm"),
             ("一般財団法人人鶴浜峠民芸温泉旅館", "鶴浜峠民芸温泉旅館")]
    for a, b in pairs:
        assert n.near(a, b, {}) is not None and set(n.blocks(a)) & set(n.blocks(b)), (a, b)
    words = [f"{c}verdale" for c in "abcdefgh"]  # more than six tokens, the slips in the first of them
    assert set(n.blocks(" ".join(words))) & set(n.blocks(" ".join(["aevrdale", "bverdle", *words[2:]])))


def test_blocks_hold_random_slips():
    rng, lost, all_near = random.Random(7), [], 0
    for a, b in SAME + OTHER[:-1]:
        for name in (a, b):
            for _ in range(60):
                x = name
                for _ in range(rng.randint(1, 3)):
                    i, how = rng.randrange(len(x) - 1), rng.randrange(4)
                    x = x[:i] + (x[i + 1] + x[i], "", x[i] * 2, rng.choice("eaノ"))[how] + x[i + (2 if how == 0 else 1) :]
                if n.near(x, name) is not None:
                    all_near += 1
                    lost += [(x, name)] if not set(n.blocks(x)) & set(n.blocks(name)) else []
    assert all_near > 1000 and len(lost) <= 0.001 * all_near, lost


def test_words_of_their_own_at_any_size(spark):
    places = [f"{a}{b}" for a in ("Kelp", "Sedge", "Ulver", "Tolver", "Hesper", "Birle") for b in ("holm", "burn", "cross", "dale", "gate", "wick")]
    few = ["Caldgate Toy Hotel", "Sedgeburn Toy Museum", "Luskby Tea Hotel", "Tolverburn Tea Lodge"]
    many = [f"{p} Toy Collection" for p in places] * 2
    slips = ["Kelpholm Toy Colllection", "KELPHOLM TOY COLLLECTION", "Toy Colllection, Kelpholm", "Kelpholm Toy Colllection (Eastvale)", "Kelpholm  Toy Colllection"]
    more = [f"{p} Glass Colllection" for p in places[:2]]

    def known(names):
        return n.known_words(spark.createDataFrame([(i, x) for i, x in enumerate(names)], "facility_id long, name string"))

    assert n.near("Caldgate Toy Hotel", "Caldgate Tea Hotel", known(few)) is None  # in a small table
    for names in (many + slips, many + slips + more):  # a slip typed often, and at several places
        assert n.near("Birlewick Toy Collection", "Birlewick Toy Colllection", known(names)) is not None
    one = known(slips)
    assert n.bucket("colllection") not in one  # notations of one establishment
