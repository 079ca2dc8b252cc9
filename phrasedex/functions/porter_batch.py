"""The stems of ``functions.porter`` for batches of words: the same steps and rule tables, on Python strings.

A word goes through the steps with its consonant/vowel string, as there. Words that
return are looked up, for the words of a text follow few frequent ones.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from phrasedex.functions.porter import STEP2_RULES, STEP3_RULES, STEP4_SUFFIXES, VOWELS

_RUN = re.compile("[a-z]+|[0-9]+")
_STATIC_CV = {r: "".join("v" if c in VOWELS else "c" for c in r) for _, r in [*STEP2_RULES, *STEP3_RULES]}
_LETTERS = str.maketrans({c: "v" if c in VOWELS else "c" for c in "abcdefghijklmnopqrstuvwxyz"})
# Words kept by a worker, about 20 MB.
KNOWN_WORDS = 100_000


def _by_end(rules: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """The rules, in their order, by the last two letters of their suffix: a word meets only those it may end with."""
    return {end: [r for r in rules if r[0][-2:] == end] for end in {s[-2:] for s, _ in rules}}


_STEP2, _STEP3, _STEP4 = _by_end(STEP2_RULES), _by_end(STEP3_RULES), _by_end([(x, "") for x in STEP4_SUFFIXES])


def _cv(word: str) -> str:
    if "y" not in word:
        return word.translate(_LETTERS)
    out, last = [], "v"
    for c in word:
        last = "v" if c in VOWELS or (c == "y" and last == "c") else "c"
        out.append(last)
    return "".join(out)


def _ends_cvc(w: str, cv: str) -> bool:
    return len(w) >= 3 and cv.endswith("cvc") and w[-1] not in "wxy"


def _rule(w: str, cv: str, rules: dict[str, list[tuple[str, str]]], least: int) -> tuple[str, str]:
    for suffix, add in rules.get(w[-2:], ()):
        if w.endswith(suffix) and (suffix != "ion" or (len(w) >= 4 and w[-4] in "st")):
            at = len(w) - len(suffix)
            return (w[:at] + add, cv[:at] + _STATIC_CV.get(add, "")) if cv[:at].count("vc") > least else (w, cv)
    return w, cv


def stem_run(w: str) -> str:
    """Stem of one lower-case letter run."""
    if len(w) <= 2:
        return w
    cv = _cv(w)
    cut = 2 if w.endswith(("sses", "ies")) else 1 if w.endswith("s") and not w.endswith("ss") else 0
    w, cv = w[: len(w) - cut], cv[: len(cv) - cut]
    if w.endswith("eed"):
        if cv[:-3].count("vc") > 0:
            w, cv = w[:-1], cv[:-1]
    else:
        cut = 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0
        if cut and "v" in cv[:-cut]:
            w, cv = w[:-cut], cv[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w, cv = w + "e", cv + "v"
            elif len(w) >= 2 and w[-1] == w[-2] and cv.endswith("c"):
                if w[-1] not in "lsz":
                    w, cv = w[:-1], cv[:-1]
            elif cv.count("vc") == 1 and _ends_cvc(w, cv):
                w, cv = w + "e", cv + "v"
    if w.endswith("y") and "v" in cv[:-1]:
        w, cv = w[:-1] + "i", cv[:-1] + "v"
    w, cv = _rule(w, cv, _STEP2, 0)
    w, cv = _rule(w, cv, _STEP3, 0)
    w, cv = _rule(w, cv, _STEP4, 1)
    m = cv.count("vc")
    if w.endswith("e") and (m > 1 or (m == 1 and not _ends_cvc(w[:-1], cv[:-1]))):
        w, cv = w[:-1], cv[:-1]
    if w.endswith("ll") and cv.count("vc") > 1:
        w = w[:-1]
    return w


@lru_cache(KNOWN_WORDS)
def stem(word: str) -> str:
    """Stem of a normalised word: letter runs stemmed, digit runs kept, glued in order."""
    return stem_run(word) if word.isalpha() else "".join(r if r[0] <= "9" else stem_run(r) for r in _RUN.findall(word))


def _stems(words: pa.Array) -> pa.Array:
    # Each different word of the batch once.
    coded = words.dictionary_encode()
    return pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def stems_of(word: Column) -> Column:
    """``stem_word(word)`` of many words, a batch at a time; null for null. ``session.ship_package`` comes first."""
    return F.arrow_udf(_stems, "string")(word)
