"""Leak detection: planted leaks in changed forms, patterns that are none, recall of the index, odd inputs."""

from __future__ import annotations

import random

import pytest

from revora.llm import leak


@pytest.fixture(scope="module")
def items(spark, folder):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/eval_items.parquet").orderBy("item_id").collect()]


@pytest.fixture(scope="module")
def index(items):
    return leak.Index(items)


def _held(index, texts):
    return {(i, item) for i, item, _ in index.held(texts)}


FORMS = {
    "upper": str.upper,
    "wide": lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t),
    "markup": lambda t: "<p>" + t.replace(" ", " <b>x</b> ".replace("x", ""), 3) + "</p>",
    "invisible": lambda t: "​".join(t),
    "wrapped": lambda t: "\n> ".join(t[i : i + 20] for i in range(0, len(t), 20)),
    "bare": lambda t: "".join(" " if not c.isalnum() else c for c in t),
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_forms(index, items, form):
    texts = ["Before it. " + FORMS[form](t) + " After it." for _, t in items[:60]]
    found = _held(index, texts)
    assert all((i, item) in found for i, (item, _) in enumerate(items[:60]))


def test_half_of_an_item_in_two_places_and_edited(index, items):
    rng = random.Random(3)
    texts, want = [], set()
    for item, t in items:
        parts = [s for s in leak._SENTENCE.split(t) if s]
        if len(parts) < 4:
            continue
        picked = rng.sample(parts, (len(parts) + 1) // 2)
        for _ in range(max(1, len("".join(picked)) // 60)):  # an edit of a character in every sixty
            k = rng.randrange(len(picked))
            p = rng.randrange(len(picked[k]))
            picked[k] = picked[k][:p] + rng.choice("xの") + picked[k][p + 1 :]
        want.add((len(texts), item))
        texts.append("\n\nSomething else between them. 別の話です。\n\n".join(picked))
    found = _held(index, texts)
    assert len(want & found) >= 0.98 * len(want)


def test_one_sentence_is_no_leak_and_patterns_are_none(index, items):
    ones = [next(s for s in leak._SENTENCE.split(t) if s) for _, t in items if len([s for s in leak._SENTENCE.split(t) if s]) >= 4]
    assert len(_held(index, ones)) <= 0.05 * len(ones)
    mixed = ["鋳物師の寝床には釘265本と攪乳桶が、監査に備えて置かれた。1873年の競売では煤けた胡椒箱一点が、調律師の受領書つきで53口目に出た。", "Children were paid 1 pence each in May 1700 to guard the attic against a storm. Records of 1701 list 3 visits by one baker."]
    assert not _held(index, mixed)


def test_edit_distance_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        p, t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, d in enumerate(p, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != d)))
            row, best = new, min(best, new[-1])
        assert leak.edit_distance_within(p, t) == best


def test_recall_of_the_walks():
    """Windows with one edit share a key in most cases; equal windows always."""
    import numpy as np

    rng = np.random.default_rng(5)
    walks, hit, n = leak.Walks(), 0, 400
    for _ in range(n):
        a = rng.integers(0, 256, 96, dtype=np.uint8)
        b = a.copy()
        b[rng.integers(0, 32)] = rng.integers(0, 256)
        ka, kb = (walks.keys(x, np.zeros(1, np.int32), False)[:, 0] for x in (a, b))
        assert (ka == walks.keys(a.copy(), np.zeros(1, np.int32), False)[:, 0]).all()
        hit += bool((ka == kb).any())
    assert hit >= 0.6 * n


def test_table_and_blocks(spark, items, monkeypatch):
    docs = spark.createDataFrame([(1, items[0][1], "c"), (1, items[0][1], "c"), (2, None, "c"), (3, "", None), (4, " ", "c"), (5, "x" * 200_000 + items[5][1], "c"), (None, items[7][1], "c")], "doc_id long, text string, share string")
    table = spark.createDataFrame([(*x, 0.5) for x in items[:20]] + [(900, None, 1.0), (901, "", 1.0)], "item_id long, text string, share double")
    want = sorted([(1, items[0][0]), (1, items[0][0]), (5, items[5][0]), (None, items[7][0])], key=str)
    for size in (500_000, 2000):
        monkeypatch.setattr(leak, "BLOCK_CHARS", size)
        assert sorted(((r["doc_id"], r["item_id"]) for r in leak.leaked(docs, table).collect()), key=str) == want
    assert leak.leaked(docs.limit(0), table).count() == 0 and leak.leaked(docs, table.limit(0)).count() == 0


def test_passages_inside_sentences():
    first = "The lantern keeper of the northern harbour wrote every evening into a ledger bound in green canvas"
    second = "while her brother counted herring barrels beside the frozen customs shed"
    third = "and nobody in the parish remembered who had first painted the weathercock blue"
    ja = "北の港の灯台守は毎晩緑の布で綴じた帳面に船の名を書き、弟は凍った税関小屋の脇で鰊の樽を数え、風見鶏を初めて青く塗った者を村の誰も覚えていなかった。"
    index = leak.Index([(1, f"{first}. {second.capitalize()}. {third.capitalize()}."), (2, f"{first} {second} {third}."), (3, ja)])
    clipped = f"{first}. {second.capitalize()}"[len(first) * 35 // 100 : len(first) + 2 + len(second) * 75 // 100]
    one = f"{first} {second}"[60:]
    found = _held(index, ["Some page. " + clipped + " and more of it.", "Some page. " + one[:125] + " zzz.", "別の頁。" + ja[10:45] + "とある。", one[:50], ja[10:30]])
    assert {(0, 1), (1, 2), (2, 3)} <= found and not {i for i, _ in found} & {3, 4}


def test_short_sentences_count_beside_other_hits():
    long = "Nobody in the parish remembered who painted the weathercock blue before the war"
    short = ["Herring was sold twice.", "Canvas cost four marks.", "Her brother went south.", "The shed froze in May."]
    index = leak.Index([(1, " ".join([long + ".", *short, "An unrelated further sentence about the pilots of the estuary follows here, much longer than the others."]))])
    assert _held(index, ["Page. " + long + ". Something else. " + " Something else. ".join(short)]) == {(0, 1)}


@pytest.mark.parametrize("share, edits, least", [(0.45, 0, 0.99), (0.45, 0.05, 0.97), (0.45, 0.1, 0.9), (0.5, 0.05, 0.97), (0.5, 0.1, 0.95), (0.6, 0.1, 0.95), (1.0, 0.15, 0.98)])
def test_recall_of_one_passage_cut_anywhere(index, items, share, edits, least):
    """Passages that begin and end anywhere, with random edits of characters, against what was planted."""
    rng, texts = random.Random(11), []
    for _, t in items:
        n = int(len(t) * share) + 1
        first = rng.randrange(max(1, len(t) - n))
        part = list(t[first : first + n])
        for _ in range(int(edits * n)):
            k = rng.randrange(len(part))
            part[k] = rng.choice(["", "x", "山", part[k] + "e", part[k] + "の"])
        texts.append("An unrelated opening line stands here. 別の話。 " + "".join(part) + " And a closing one. 終わり。")
    found = _held(index, texts)
    planted = {(i, item) for i, (item, _) in enumerate(items)}
    assert len(found & planted) >= least * len(planted) and len(found - planted) <= 0.01 * len(planted)


def test_a_third_of_an_item_is_none(index, items):
    texts = [t[len(t) // 10 : len(t) // 10 + len(t) * 33 // 100] for _, t in items]
    assert len(_held(index, texts)) <= 0.02 * len(texts)
