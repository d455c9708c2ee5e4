"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) for the distinct terms of an index.

A rule is a suffix, what takes its place, and how many vowel-consonant sequences
the rest must have.  Only the first rule of a step whose suffix fits is looked at,
so rules stand by falling length where one suffix ends another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published suffixes of steps 2, 3 and 4.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

class _Shapes(dict):
    def __missing__(self, key: int) -> str:
        return "c"


_SHAPES = _Shapes({ord(x): "v" for x in "aeiou"})
_DOUBLE = re.compile(r"([^aeiouylsz])\1$")
_LONGEST = 64


def shape(word: str) -> str:
    """``v`` and ``c`` by letter: a y after a consonant is a vowel, all that is no other vowel is a consonant."""
    if "y" not in word:
        return word.translate(_SHAPES)
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def measure(word: str) -> int:
    """Number of vowel-consonant sequences."""
    return len(re.findall("v+c+", shape(word)))


def _short(word: str) -> bool:
    """Whether a word ends consonant, vowel, consonant, the last one not w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


_STEP4 = sorted(STEP4, key=len, reverse=True)


@cache
def _longest_first(rules: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: -len(r[0]))


@cache
def _suffixes(rules: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    return tuple(s for s, _ in rules)


def _replaced(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    if not word.endswith(_suffixes(rules)):
        return word
    for suffix, by in _longest_first(rules):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + by if measure(stem) >= least else word
    return word


@lru_cache(1 << 20)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of one or two letters, or of more than 64, stay."""
    if not 3 <= len(word) <= _LONGEST:
        return word
    word = _replaced(word, (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")), 0)
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    elif found := re.fullmatch(r"(.*?)(?:ed|ing)", word):
        if "v" in shape(rest := found[1]):
            word = rest
            if rest.endswith(("at", "bl", "iz")):
                word += "e"
            elif _DOUBLE.search(rest):
                word = rest[:-1]
            elif measure(rest) == 1 and _short(rest):
                word += "e"
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP2, 1), STEP3, 1)
    for suffix in _STEP4 if word.endswith(STEP4) else ():
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            if measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def stems(words: DataFrame) -> DataFrame:
    """``(word, term)`` of the distinct words ``(word)``: each is stemmed once, however often texts have it."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(term=batch["word"].map(stem))

    return words.select("word").where(F.col("word").isNotNull()).distinct().mapInPandas(work, "word string, term string")
