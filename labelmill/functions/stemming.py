"""The suffix-stripping algorithm of Porter (1980) for one lower-cased word."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffix rules of the published algorithm, in its order.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
]


def _shape(stem: str) -> str:
    """The stem as a string of v (vowel) and c (consonant)."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double_consonant(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"


def _closed(s: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(s).endswith("cvc") and s[-1] not in "wxy"


def _replace(word: str, rules, least: int) -> str:
    """Apply the longest matching suffix rule if the stem before it is long enough."""
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((n for s, n in (("ed", 2), ("ing", 3)) if w.endswith(s)), 0)
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double_consonant(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _closed(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, STEP_2, 0)
    w = _replace(w, STEP_3, 0)
    last = next((s for s in sorted(STEP_4, key=lambda s: -len(s)) if w.endswith(s)), None)
    if last and _measure(w[: -len(last)]) > 1 and (last != "ion" or w[: -len(last)].endswith(("s", "t"))):
        w = w[: -len(last)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _closed(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double_consonant(w) and w.endswith("l"):
        w = w[:-1]
    return w
