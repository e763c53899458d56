"""Variant spellings of names: blocking, comparison and clustering.

A name is folded (width, case, kana, old forms of characters, legal forms,
honorifics, decoration) and split into tokens.  Latin tokens lose possessives
and articles, abbreviations and nicknames are put back, and every pair of
tokens is a block by each pair of their codes: phonetic, first and last letters,
so that a slip in each of two words leaves one.  Names of one or two tokens have
blocks of single ones.  Japanese names have no spaces, so their blocks are pairs
of neighbours at the head, and the kind with each character before it.  Names that share a block are compared token by token with
Jaro-Winkler similarity; a Japanese name, whose characters carry words and
where one other character makes another name, must come from the other by
slips only: a character left out, doubled, swapped or replaced by a filler.
Accepted pairs of registered names are clustered by connected components; each
typed name joins the component of its nearest registered name.

Defined results: null, empty and blank names give no rows; a name that is
equally near to two components is left unlinked; repeated rows are linked each.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from ..operators.salted import heavy_keys, skew_join
from ..runtime import materialize

#: Old or variant forms of characters and their common forms.
OLD_FORMS = dict(zip("舘會濱峯澤嶋嶌櫻國廣齋齊斎邊邉澁瀧龍藏學寶圓惠髙﨑眞淺鐵", "館会浜峰沢島島桜国広斉斉斉辺辺渋滝竜蔵学宝円恵高崎真浅鉄"))
#: Legal forms and honorifics around a name.
LEGAL = ("株式会社", "有限会社", "合同会社", "一般財団法人", "公益財団法人", "一般社団法人", "公益社団法人", "財団法人", "社団法人", "(株)", "(有)", "㈱", "㈲")
#: Kinds of establishment, and how they are cut short.
KINDS = ("科学館", "資料館", "博物館", "美術館", "記念館", "文化会館", "観光ホテル", "温泉旅館", "ミュージアム", "ギャラリー")
SHORT_KINDS = {"博": "博物館", "美": "美術館", "資料": "資料館", "記念": "記念館", "科学": "科学館", "博物": "博物館", "美術": "美術館", "文会": "文化会館", "観ホ": "観光ホテル", "温旅": "温泉旅館", "ミュー": "ミュージアム", "ギャラ": "ギャラリー",
               "科館": "科学館", "資館": "資料館", "博館": "博物館", "美館": "美術館", "記館": "記念館", "文化会": "文化会館", "観光ホ": "観光ホテル", "温泉旅": "温泉旅館"}
#: Endings of places that a short form replaces.
LANDFORMS = "浦岬郷町丘原峠荘"
#: Characters typed in place of another by a slip.
FILLERS = frozenset("ノのー之ヶケ々ｰ・一")
#: Abbreviations of kinds in English names.
ABBREVIATIONS = {"ctr": "centre", "center": "centre", "ldg": "lodge", "mus": "museum", "coll": "collection", "gall": "gallery", "gal": "gallery", "inst": "institute", "gdns": "gardens", "gdn": "gardens",
                 "htl": "hotel", "mem": "memorial", "hse": "house", "bldg": "building", "st": "saint", "mt": "mount"}
#: Nicknames and the names they stand for.
NICKNAMES = {"maggie": "margaret", "meg": "margaret", "peggy": "margaret", "fred": "frederick", "freddie": "frederick", "freddy": "frederick", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert",
             "dot": "dorothy", "dolly": "dorothy", "dottie": "dorothy", "tilly": "matilda", "mattie": "matilda", "len": "leonard", "lenny": "leonard", "leo": "leonard", "ted": "theodore", "theo": "theodore", "teddy": "theodore",
             "ned": "edward", "ed": "edward", "eddie": "edward", "nell": "eleanor", "nellie": "eleanor", "ellie": "eleanor", "nora": "eleanor", "liz": "elizabeth", "beth": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth",
             "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "katherine", "kitty": "katherine", "bill": "william", "will": "william", "billy": "william", "willie": "william", "tom": "thomas", "tommy": "thomas", "dick": "richard",
             "rick": "richard", "rich": "richard", "charlie": "charles", "chuck": "charles", "chas": "charles", "jo": "josephine", "josie": "josephine", "jim": "james", "jack": "john", "harry": "henry", "hal": "henry", "molly": "mary", "polly": "mary",
             "sally": "sarah", "sam": "samuel", "alf": "alfred", "al": "albert", "andy": "andrew", "tony": "anthony", "ben": "benjamin", "dan": "daniel", "dave": "david", "joe": "joseph", "mike": "michael", "nick": "nicholas", "pat": "patricia", "steve": "stephen", "sue": "susan"}
#: Length of the stretches of a whole name that are blocks.
WHOLE = 7
#: Establishments that must share a token for it to be a word of its own, the share of a close word's establishments below which it is a slip of that word, and the number of places words are hashed to.
KNOWN_NAMES, KNOWN_SHARE, KNOWN_BUCKETS = 2, 0.1, 1 << 20
_SOUNDEX = {c: d for d, cs in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}
_JA = re.compile(r"[぀-ヿ一-鿿々]")


def _kana(text: str) -> str:
    """Hiragana as katakana."""
    return "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in text)


def soundex(token: str) -> str:
    """First letter and consonant classes of a token's first letters."""
    out = token[:1]
    last = _SOUNDEX.get(token[:1], 0)
    for c in token[1:]:
        d = _SOUNDEX.get(c, 0)
        if d and d != last:
            out += str(d)
        if c not in "hw":
            last = d
    return out


def fold(name: str) -> str:
    text = unicodedata.normalize("NFKC", name).strip()
    text = "".join(OLD_FORMS.get(c, c) for c in text)
    for form in LEGAL:
        text = text.replace(form, " ")
    text = re.sub(r"\((?:株|有)+\)", " ", text)
    return re.sub(r"[「」『』【】★☆◆●○\"“”]", " ", text).strip()


def japanese(name: str) -> str:
    """The one string of a Japanese name: place, subject, kind, in this order."""
    text = fold(name)
    text = re.sub(r"さん\s*$", "", text.strip()).strip()
    text = re.sub(r"(?<=.{5})(?<!\()[^\s()]{2}[県都府道]\)$", "", text) if "(" not in text else text
    inside = re.findall(r"\(([^)]*)\)", text)
    text = re.sub(r"\([^)]*\)?", " ", text).strip()
    text = re.sub(r"(さん|様|御中)\s*$", "", text).strip()
    parts = [p for p in re.split(r"[\s・,、\-]+", text) if p]
    last_place = len(parts) > 1 and 2 < len(parts[-1]) < 5 and parts[-1][-1] in LANDFORMS and parts[0][-1] not in LANDFORMS
    if last_place or (len(parts) > 1 and any(_kana(parts[0]).endswith(k) for k in KINDS) and not any(_kana(parts[-1]).endswith(k) for k in KINDS)):
        parts = parts[-1:] + parts[:-1]  # the place stands last
    parts = [p for p in (x.strip() for x in inside) if p and not re.search(r"[県都府道]$", p)] + parts
    text = "".join(parts)
    text = re.sub(r"(前|さん)$", "", text) if len(text) > 5 else text
    return _kana(re.sub(r"[^\w々]", "", text).casefold())


def full_kinds(text: str) -> str:
    """A Japanese name whose short kind is put back in full."""
    if any(text.endswith(k) for k in KINDS):
        return text
    for short in sorted(SHORT_KINDS, key=len, reverse=True):
        if text.endswith(short) and len(text) > len(short) + 3:
            return text[: -len(short)] + SHORT_KINDS[short]
    return text


def latin(name: str) -> list[tuple[str, bool, bool]]:
    """(token, cut short, may be left out) of a Latin name."""
    text = re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z])", " ", fold(name))
    text = unicodedata.normalize("NFD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    text = re.sub(r"['’]s\b", "", text)
    out = []
    for m in re.finditer(r"[a-z0-9]+", text):
        t, after, before = m.group(), text[m.end() : m.end() + 1], text[: m.start()]
        if t in ("the", "of", "at", "and"):
            continue
        cut = after == "." and len(t) > 1
        if t in ABBREVIATIONS:
            t, cut = ABBREVIATIONS[t], False
        t = NICKNAMES.get(t, t)
        aside = before.count("(") > before.count(")") or bool(re.search(r",[^,]*$", before))
        out.append((t, cut, aside))
    return out


def bucket(token: str) -> int:
    """The place of a token in the set of known words, which has a fixed number of places."""
    return zlib.crc32(token.encode()) % KNOWN_BUCKETS


def is_japanese(name: str) -> bool:
    return _JA.search(unicodedata.normalize("NFKC", name)) is not None


def _japanese_blocks(s: str) -> set[str]:
    """Pairs of neighbours at the head, for slips in the kind; the kind with each character before it, for slips there."""
    t = full_kinds(s)
    kind = max((k for k in map(_kana, KINDS) if t.endswith(k)), key=len, default=t[-3:])
    # a head of five keeps a pair through one slip, so pairs inside the kind aren't needed
    last = len(s) - len(kind) if s.endswith(kind) and len(s) >= len(kind) + 5 else len(s) - 1
    keys = {"b" + s[i : i + 2] for i in range(min(6, last))}
    keys |= {"k" + kind + "|" + c for c in t[: -len(kind)]}
    keys |= {"d" + s[0] + t[-5:], "e" + s[1:2] + t[-5:], "f" + s[0] + t[-2:] + s[3:5]}
    return keys | ({"h" + s[0], "z" + s[-1]} if len(s) < 5 else set())


def _token_keys(t: str) -> set[str]:
    """Keys of which two tokens share one if they are one slip apart, one is the other cut short, or both sound alike."""
    keys = {"^" + t[:2], "$" + t[-2:], "~" + soundex(t[:5])[:2]}
    if len(t) < 5:  # a slip in a short token may touch both ends
        keys |= {"<" + t[0], ">" + t[-1], "#" + "".join(sorted(t))}
    return keys


def _deletions(t: str) -> set[str]:
    """A token without up to two of its letters, from both ends of a long one."""
    halves = _deletions(t[:12]) | {"-" + x for x in _deletions(t[-12:])} if len(t) > 21 else set()
    if len(t) > 24:
        return halves
    return halves | {t[:i] + t[i + 1 : j] + t[j + 1 :] for i, j in combinations(range(len(t)), 2)} | {t[:i] + t[i + 1 :] for i in range(len(t))} | {t}


def blocks(name: str) -> list[str]:
    """The blocks a name falls into."""
    if is_japanese(name):
        s = japanese(name)
        return sorted("j:" + k for k in _japanese_blocks(s)) if s else []
    tokens = latin(name)
    whole = "".join(t for t, _, _ in tokens)
    if not whole:
        return []
    # for names that lost their spaces: both ends, and what stands between wherever it stands
    keys = {"w^" + whole[:5], "w$" + whole[-8:]} | {"w" + whole[i : i + WHOLE] for i in range(len(whole) - WHOLE + 1)}
    words = sorted({t for t, _, _ in tokens})
    parts = [_token_keys(t) for t in words]
    # of three tokens within three slips two are within one slip each
    for i, j in ((i, j) for i in range(len(words)) for j in range(i + 1, len(words) if len(words) <= 12 else min(i + 7, len(words)))):  # of many words those near in order
        keys |= {"p" + "|".join(sorted((x, y))) for x in parts[i] for y in parts[j]}
        for x, y in ((words[i], words[j]), (words[j], words[i])):
            keys |= {"i" + x[0] + "|" + y[:3]}  # an initial with a token as it is or cut short
    # of two tokens only one need be so near
    if len(tokens) < 3 or len(tokens) == 3 and any(aside or len(t) <= 2 for t, _, aside in tokens):
        for part in parts:
            keys |= {"t" + x for x in part}
        keys |= {"i" + t[0] for t in words}
    if len(tokens) == 1:
        keys |= {"x" + x for x in _deletions(whole)}
    return sorted("l:" + k for k in keys)


def swaps_distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    over = most + 1
    before, last = None, [min(j, over) for j in range(len(b) + 1)]
    for i, c in enumerate(a, 1):
        now = [over] * (len(b) + 1)  # places further from the diagonal than ``most`` hold more
        now[0] = min(i, over)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            d = b[j - 1]
            x = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (c != d))
            if before is not None and j > 1 and c == b[j - 2] and a[i - 2] == d:
                x = min(x, before[j - 2] + 1)
            now[j] = min(x, over)
        if min(now) > most:
            return over
        before, last = last, now
    return last[-1]


def slips_distance(a: str, b: str, most: float, letter: float = 1.5) -> float:
    """Like swaps_distance, where another letter in place of one weighs ``letter``."""
    before, last = None, list(map(float, range(len(b) + 1)))
    for i, c in enumerate(a, 1):
        now = [float(i)]
        for j, d in enumerate(b, 1):
            x = min(last[j] + 1, now[-1] + 1, last[j - 1] + (letter if c != d else 0))
            if before is not None and j > 1 and c == b[j - 2] and a[i - 2] == d:
                x = min(x, before[j - 2] + 1)
            now.append(x)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return last[-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [c for c, t in zip(b, taken) if t]
    m, moved = len(first), sum(x != y for x, y in zip(first, second)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def _slips(clean: str, typed: str, short: bool) -> float | None:
    """The number of slips by which ``typed`` comes from ``clean``, or None."""
    extra, missing = Counter(typed), Counter(clean)
    extra, missing = extra - missing, missing - extra
    if any(c not in FILLERS and c not in clean for c in extra) or sum(extra.values()) > 2 or sum(missing.values()) > 2:
        return None
    most = 2 if len(clean) >= 7 else 1
    d = swaps_distance(clean, typed, most)
    return None if d > most else d + 0.25 * short


@lru_cache(maxsize=200_000)
def _characters(text: str) -> tuple[frozenset[str], list[frozenset[str]]]:
    """The characters of a name, and of its forms without fillers."""
    return frozenset(text), [frozenset(f) - FILLERS for f in {text, full_kinds(text)}]


def near_japanese(a: str, b: str) -> float | None:
    if a == b:
        return 0.0
    (own_a, forms_a), (own_b, forms_b) = _characters(a), _characters(b)
    if not any(f <= own_a for f in forms_b) and not any(f <= own_b for f in forms_a):
        return None  # each has a character that no slip explains
    if jaro_winkler(a, b) < 0.6:
        return None
    best = None
    for clean, typed in ((a, b), (b, a)):
        for form in {typed, full_kinds(typed)}:
            x = _slips(clean, form, form != typed)
            if x is not None and (best is None or x < best):
                best = x
    return best


def _own_words(n: int, m: int) -> bool:
    """Whether tokens of n and m establishments are two words; a rare one close to a far more frequent one is a slip."""
    return min(n, m) >= max(KNOWN_NAMES, KNOWN_SHARE * max(n, m))


def _near_token(a: tuple[str, bool, bool], b: tuple[str, bool, bool], known: dict[int, int] | None) -> float | None:
    (x, cut_x, _), (y, cut_y, _) = a, b
    if x == y:
        return 0.0
    if len(x) > len(y):
        (x, cut_x), (y, cut_y) = (y, cut_y), (x, cut_x)
    if len(x) == 1:
        return 0.5 if y[0] == x and len(y) > 3 else None
    if cut_x and len(x) >= 3:
        if y.startswith(x):
            return 0.25
        if len(x) >= 4 and swaps_distance(x, y[: len(x)], 1) <= 1:
            return 1.25
    if known is not None and _own_words(known.get(bucket(x), 0), known.get(bucket(y), 0)):
        return None
    if len(x) < 4 and len(y) <= 4 and len(x) >= 2:  # one slip in a short word; another letter only where that makes no word
        other = len(x) == len(y) and sorted(x) != sorted(y)
        return 1.0 if swaps_distance(x, y, 1) == 1 and not (other and known is None) else None
    if len(x) < 3 or jaro_winkler(x, y) < 0.75:
        return None
    most = 2.5 if len(y) >= 7 else 2.0 if len(y) >= 6 else 1.5
    d = slips_distance(x, y, most)
    if d > most or len(x) == len(y) and x[1:] == y[1:] and (known is None or not (bucket(x) in known or bucket(y) in known)):
        return None  # another first letter makes another word, unless one of the two is no word
    return d


def near_latin(a: list[tuple[str, bool, bool]], b: list[tuple[str, bool, bool]], known: dict[int, int] | None = None, cache: dict | None = None) -> float | None:
    """The number of slips between two token lists, or None; a token aside may be left out. ``cache`` keeps results of tokens."""
    total, left, initials = 0.0, list(b), 0
    unmatched = []
    cache = {} if cache is None else cache
    for t in sorted(a, key=lambda t: -len(t[0])):
        scored = []
        for i, u in enumerate(left):
            if (t, u) not in cache:
                cache[t, u] = _near_token(t, u, known)
            if (s := cache[t, u]) is not None:
                scored.append((s, i))
        if not scored:
            unmatched.append(t)
            if len(unmatched) > 1:
                break  # no more than one may be left over
            continue
        s, i = min(scored)
        initials += s == 0.5
        total += s
        left.pop(i)
    whole = False
    if unmatched or left:
        over = unmatched + left
        if len(over) == 1 and min(len(a), len(b)) >= 2 and (over[0][2] or len(over[0][0]) <= 2 < min(len(a), len(b))):
            total += 0.1 if over[0][2] else 0.5
        else:
            whole = True
    if not whole and total <= 3 and initials <= 1:
        return total
    x, y = "".join(t for t, _, _ in a), "".join(t for t, _, _ in b)
    if len(a) != len(b) and min(len(x), len(y)) >= 12:  # spaces lost or misplaced
        most = 3 if min(len(x), len(y)) >= 20 else 2
        d = swaps_distance(x, y, most)
        return float(d) + 0.25 if d <= most else None
    return None


def near(a: str, b: str, known: dict[int, int] | None = None) -> float | None:
    """How many slips apart two names are; None where they are different names."""
    ja = is_japanese(a)
    if ja != is_japanese(b):
        return None
    return near_japanese(japanese(a), japanese(b)) if ja else near_latin(latin(a), latin(b), known)


#: Registered names, and names, of one block that are compared in one piece; blocks with more are split, and the pieces met with each other.
MOST_REGISTERED, MOST_NAMES = 1000, 20_000
#: Pairs that are tested at once.
PAIRS = 300_000
#: Slips that names may have between them, each of which brings one letter that the other name lacks at most.
MOST_SLIPS = 3


class Shapes:
    """Names made ready for comparison, with arrays by which many pairs are tested at once."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.names: list[str] = []
        self.forms: list[object] = []
        self._room(1024)

    def _room(self, n: int) -> None:
        """Space for n names: letters of the core and of the whole, whether tokens stand for longer ones, characters and those of two forms."""
        old, k = (self._arrays, len(self.names)) if self.names else (None, 0)
        self._arrays = [np.zeros((n, 36), np.int8), np.zeros((n, 36), np.int8), np.zeros(n, bool), np.zeros(n, bool), np.zeros((n, 3), np.int64)]
        if old:
            for new, x in zip(self._arrays, old):
                new[:k] = x[:k]

    def add(self, name: str) -> int:
        if name in self.place:
            return self.place[name]
        i = self.place[name] = len(self.names)
        if i == len(self._arrays[0]):
            self._room(2 * i)
        core, bag, open_, written, masks = self._arrays
        if is_japanese(name):
            form: object = japanese(name)
            mask = lambda cs: sum({1 << (ord(c) % 61) for c in cs})
            written[i] = True
            masks[i] = mask(form), mask(set(form) - FILLERS), mask(set(full_kinds(form)) - FILLERS)
        else:
            form = latin(name)
            whole, kept = np.zeros(36, np.int64), np.zeros(36, np.int64)
            for t, cut, aside in form:
                at = np.bincount([int(c, 36) for c in t], minlength=36)
                whole += at
                if len(t) > 2 and not aside:
                    kept += at
                open_[i] |= cut or len(t) <= 2  # may stand for a longer token
            core[i], bag[i] = np.minimum(kept, 127), np.minimum(whole, 127)
        self.names.append(name)
        self.forms.append(form)
        return i

    def may_be_near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """False where :func:`near` can't accept a pair: each has letters the other lacks, more than slips explain."""
        core, bag, open_, written, masks = self._arrays
        over = lambda a, b: np.maximum(core[a] - bag[b], 0).sum(axis=1)
        out = ~written[i] & ~written[j]
        out[out] &= (over(i[out], j[out]) <= MOST_SLIPS) | open_[j[out]]
        out[out] &= (over(j[out], i[out]) <= MOST_SLIPS) | open_[i[out]]
        both = written[i] & written[j]
        a, b = masks[i[both]], masks[j[both]]
        fits = np.zeros(len(a), dtype=bool)
        for k in (1, 2):
            fits |= ((b[:, k] & ~a[:, 0]) == 0) | ((a[:, k] & ~b[:, 0]) == 0)
        out[both] = fits
        return out


def _with_blocks(names: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def keys(column: pd.Series) -> pd.Series:
        return column.map(lambda n: blocks(n) if n and n.strip() else [])

    return names.withColumn("block", F.explode(keys("name"))).withColumn("block", F.xxhash64("block"))


def _uses(name: str) -> list[tuple[int, int]]:
    """(place of a token, hash of the sounds of the other tokens) of a Latin name: notations of one establishment give the same."""
    if not name or is_japanese(name):
        return []
    tokens, out = latin(name), set()
    for i, (t, _, _) in enumerate(tokens):
        others = [(soundex(u), aside) for j, (u, _, aside) in enumerate(tokens) if j != i and len(u) > 2]
        main = [s for s, aside in others if not aside]
        # what stands aside is an addition if the rest makes a name
        out.add((bucket(t), zlib.crc32(" ".join(sorted(main if len(main) > 1 else [s for s, _ in others])).encode())))
    return sorted(out)


def known_words(registered: DataFrame) -> dict[int, int]:
    """Places of the tokens that at least KNOWN_NAMES establishments share, and how many do; at most KNOWN_BUCKETS numbers."""

    @F.pandas_udf("array<struct<p:int,other:bigint>>")
    def uses(column: pd.Series) -> pd.Series:
        return column.map(lambda n: [{"p": p, "other": o} for p, o in _uses(n)])

    each = registered.select(F.explode(uses("name")).alias("u")).select("u.p", "u.other").distinct()
    found = each.groupBy("p").count().filter(F.col("count") >= KNOWN_NAMES)
    return {r["p"]: r["count"] for r in found.collect()}


def close_pairs(names: DataFrame, registered: DataFrame) -> DataFrame:
    """(name, facility_id, slips) of every accepted pair of one of distinct names and a registered name (facility_id, name).

    The names of a block, registered ones first, lie next to each other in one
    task, so each is sent once and not once for every pair; arrays of letters
    rule out most pairs before two names are compared.  A block with many
    names is split into pieces, and every piece of registered names meets every
    piece of names.
    """
    spark = names.sparkSession
    known = spark.sparkContext.broadcast(known_words(registered))
    own = registered.select("name").distinct().withColumn("registered", F.lit(1))
    every = names.select("name").withColumn("registered", F.lit(0)).union(own).groupBy("name").agg(F.max("registered").alias("registered"))
    every = every.repartition(2 * spark.sparkContext.defaultParallelism)  # names are few bytes but much work
    held = materialize(_with_blocks(every), "name-blocks")
    counts = held.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("registered").alias("m")).filter("m > 0 and n > 1")
    counts = counts.select("block", F.ceil(F.col("n") / MOST_NAMES).cast("int").alias("a"), F.ceil(F.col("m") / MOST_REGISTERED).cast("int").alias("b"))
    met = held.join(counts, "block")
    hashed = lambda k: F.pmod(F.xxhash64("name"), F.col(k).cast("bigint")).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = met.withColumn("at", hashed("a")).withColumn("bt", each("b")).withColumn("side", F.lit(1))
    right = met.filter("registered = 1").withColumn("at", each("a")).withColumn("bt", hashed("b")).withColumn("side", F.lit(0))
    pieces = right.select("block", "at", "bt", "side", "name").union(left.select("block", "at", "bt", "side", "name"))
    pieces = pieces.repartition("block", "at", "bt").sortWithinPartitions("block", "at", "bt", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes, tokens, words = Shapes(), {}, known.value
        done: set[int] = set()

        def compare(pairs: list[tuple[np.ndarray, np.ndarray]], rows: list) -> None:
            code = np.unique(np.concatenate([i << 32 | j for i, j in pairs]))
            i, j = code >> 32, code & 0xFFFFFFFF
            for c in range(0, len(code), PAIRS):
                may = shapes.may_be_near(i[c : c + PAIRS], j[c : c + PAIRS])
                for pair in code[c : c + PAIRS][may].tolist():
                    if pair in done:
                        continue
                    done.add(pair)
                    a, b = pair >> 32, pair & 0xFFFFFFFF
                    x, y = shapes.forms[a], shapes.forms[b]
                    slips = near_japanese(x, y) if isinstance(x, str) else near_latin(x, y, words, tokens)
                    if slips is not None:
                        rows.append((shapes.names[a], shapes.names[b], slips))

        key, right, held = None, np.empty(0, np.int64), []
        for batch in batches:
            rows: list[tuple[str, str, float]] = []
            if len(shapes.names) > 200_000 or len(done) > 2_000_000 or len(tokens) > 500_000:
                held = [shapes.names[k] for k in right.tolist()]
                shapes, tokens, done = Shapes(), {}, set()
                right = np.array([shapes.add(n) for n in held], np.int64)
            keys = batch[["block", "at", "bt", "side"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            places = np.array([shapes.add(n) for n in batch["name"].tolist()], np.int64)
            heads, pairs, size = [tuple(k) for k in keys[cuts[:-1]].tolist()] if len(keys) else [], [], 0
            for head, first, last in zip(heads, cuts, cuts[1:]):
                part = places[first:last]
                if head[3] == 0:
                    right = np.concatenate([right, part]) if head[:3] == key else part
                    key = head[:3]
                elif head[:3] == key:
                    for c in range(0, len(part), max(1, PAIRS // len(right))):
                        some = part[c : c + max(1, PAIRS // len(right))]
                        pairs.append((np.repeat(some, len(right)), np.tile(right, len(some))))
                        size += len(some) * len(right)
                        if size >= PAIRS:
                            compare(pairs, rows)
                            pairs, size = [], 0
            if pairs:
                compare(pairs, rows)
            yield pd.DataFrame(rows, columns=["name", "other", "slips"])

    same = own.select("name", F.col("name").alias("other"), F.lit(0.0).alias("slips"))  # needs no block
    pairs = pieces.mapInPandas(run, "name string, other string, slips double").union(same).groupBy("name", "other").agg(F.min("slips").alias("slips"))
    return pairs.join(registered.select("facility_id", F.col("name").alias("other")), "other").select("name", "facility_id", "slips")


def linked(facility: DataFrame, typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, links): (facility_id, root) of every registered name, and (rec_id, root) of every typed row (rec_id, name) that names one."""
    registered = materialize(facility.filter("facility_id is not null and trim(name) <> ''").select("facility_id", "name"), "registered")
    rows = typed.filter("trim(name) <> ''").select("rec_id", "name")
    every = rows.select("name").union(registered.select("name")).distinct()
    pairs = materialize(close_pairs(every, registered), "name-pairs")
    # edges between registered names
    edges = pairs.join(registered.select(F.col("facility_id").alias("x"), "name"), "name").select("x", F.col("facility_id").alias("y"))
    found = components(edges, "x", "y")
    roots = registered.join(found.withColumnRenamed("node", "facility_id"), "facility_id", "left").select("facility_id", F.coalesce("root", "facility_id").alias("root"))
    roots = materialize(roots, "roots")
    near_roots = pairs.join(roots, "facility_id").groupBy("name", "root").agg(F.min("slips").alias("slips"))
    best = near_roots.groupBy("name").agg(F.min("slips").alias("least"), F.min(F.struct("slips", "root")).alias("b"))
    tied = near_roots.join(best, "name").filter("slips = least").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    chosen = best.join(tied.filter("n = 1"), "name").select("name", F.col("b.root").alias("root"))
    # a name that many rows give is spread over tasks
    heavy, _ = heavy_keys(rows, "name", "rec_id")
    return roots, skew_join(rows, chosen, "name", "rec_id", heavy).select("rec_id", "name", "root")
