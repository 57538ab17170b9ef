"""Suffix stripping of English words, for the vocabulary of a text index only."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")
# The suffix rules of the published algorithm, in its order, as (suffix, replacement).
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    return "".join("v" if c in "aeiou" or (c == "y" and k and w[k - 1] not in "aeiou") else "c" for k, c in enumerate(w))


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short_end(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _first(w: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            return head + new if _measure(head) > least else w
    return w


def stem(w: str) -> str:
    """Porter's stem of a lower-case ASCII word; other words are their own stem."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(suffix):
            w = w[: -len(suffix)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            head = w.removesuffix(suffix)
            if head != w and "v" in _shape(head):
                w = head
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _first(_first(w, STEP2, 0), STEP3, 0)
    for suffix in sorted(STEP4, key=lambda s: -len(s)):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    return words.map(stem)


@lru_cache(1 << 16)
def stem_once(word: str) -> str:
    return stem(word)
