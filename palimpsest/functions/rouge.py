"""ROUGE-L over stemmed words, as an Arrow function: it needs a longest common subsequence."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship_active

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(stem: str) -> int:
    """How many times a vowel run is followed by a consonant run."""
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return len(re.findall("v+c+", kinds))


def _vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _short(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


#: Suffix rules of the published stemmer, by step; the first suffix that fits is the one tried.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _replaced(w: str, rules: list[tuple[str, str]]) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + new if _measure(stem) > 0 else w
    return w


@lru_cache(100_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words of three letters or fewer stay."""
    if len(w) <= 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _doubled(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            rest = w[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                w = rest
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _doubled(w) and w.endswith("l") and _measure(w) > 1 else w


def words(t: str | None) -> list[str]:
    return [stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower())]


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    number = {w: i for i, w in enumerate(dict.fromkeys(b))}
    row = np.zeros(len(b) + 1, np.int64)
    right = np.array([number[w] for w in b])
    for x in a:
        if (k := number.get(x)) is not None:  # another word changes nothing
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(right == k, row[:-1] + 1, 0)))
    return int(row[-1])


def f_measure(a: str | None, b: str | None) -> float:
    return _best(words(a), [words(b)])


def _best(x: list[str], lines: list[list[str]]) -> float:
    """The best F of some words with a line; lines whose shared words cannot reach it are not compared."""
    own, best = Counter(x), 0.0
    bounds = sorted(((2.0 * sum((own & Counter(y)).values()) / max(1, len(x) + len(y)), i) for i, y in enumerate(lines)), reverse=True)
    for bound, i in bounds:
        if bound <= best:
            break
        best = max(best, 2.0 * common(x, lines[i]) / (len(x) + len(lines[i])))
    return best


def best_f(fact: Column, lines: Column) -> Column:
    """The best ROUGE-L F of a fact with the lines that share a word with it; 0 without one."""
    ship_active()

    @F.pandas_udf("double")
    def run(facts: pd.Series, contexts: pd.Series) -> pd.Series:
        out = []
        for f, ls in zip(facts, contexts, strict=True):
            own = set((f or "").lower().split())
            near = [words(x) for x in (ls if ls is not None else []) if own & set((x or "").lower().split())]
            out.append(_best(words(f), near))
        return pd.Series(out)

    return run(fact, lines)
