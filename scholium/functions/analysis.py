"""Analysers of keyword search: words as they stand, and stemmed words without the commonest.

The stemmer is Porter's algorithm (M. F. Porter, An algorithm for suffix stripping, Program 14(3), 1980), as
tables of suffix rules with the condition on the measure of what is left.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scholium.functions.text import word_runs

# fixed value: the short list of English words that keyword search leaves out
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
# fixed values: suffix, replacement and least measure of the stem, by step of the algorithm; the longest suffix decides
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c or v for every letter; y is a vowel behind a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    ending = max((s for s in table if word.endswith(s)), key=len, default=None)
    stem = word[: len(word) - len(ending)] if ending else word
    return stem + table[ending] if ending and _measure(stem) >= least else word


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters, or with other letters than a-z, stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    for ending, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            word = word[: len(word) - len(ending)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (m := re.fullmatch("(.*?)(?:ed|ing)", word)) and "v" in _shape(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-1:] == word[-2:-1] and _shape(word)[-2:] == "cc" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2, 1), STEP_3, 1)
    ending = max((s for s in STEP_4 if word.endswith(s)), key=len, default="")
    stem = word[: len(word) - len(ending)]
    if ending and _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stem_all(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [porter(w) for w in ws])


def stems(c: Column) -> Column:
    """Stems of the words of a text that are no stop words; null stays null."""
    return F.pandas_udf(_stem_all, "array<string>")(F.filter(word_runs(c), lambda w: ~w.isin(*STOP)))
