"""The Porter stemmer (1980), in the dialect of the full-text index whose results are matched.

Tokens of fewer than three or more than 64 bytes stay as they are. Each step takes the first suffix that the word ends
with; if its condition fails, the step is over.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The published suffix rules, the longer before the shorter. A rule is for words with something before its suffix.
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("tional", "tion"), ("biliti", "ble"),
    ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"),
    ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("alli", "al"), ("ator", "ate"),
    ("bli", "ble"), ("eli", "e"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = [
    ("ement", ""),
    ("ance", ""), ("ence", ""), ("able", ""), ("ible", ""), ("ment", ""),
    ("ant", ""), ("ent", ""), ("ion", ""), ("ism", ""), ("ate", ""), ("iti", ""), ("ous", ""), ("ive", ""), ("ize", ""),
    ("al", ""), ("er", ""), ("ic", ""), ("ou", ""),
]


def _shape(word: str) -> str:
    """A letter for each of the word's: v for a vowel (y after a consonant is one), c for any other."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def measure(word: str) -> int:
    """How many times vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Does it end consonant, vowel, consonant, the last of them not w, x or y?"""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for suffix, new in rules:
        if len(word) > len(suffix) and word.endswith(suffix):
            stem = word[: -len(suffix)]
            if measure(stem) >= least and (suffix != "ion" or stem[-1] in "st"):
                return stem + new
            break
    return word


def stem(token: str) -> str:
    if not 3 <= len(token.encode()) <= 64:
        return token
    w = _replace(token, STEP_1A, 0)
    # Past and present participles.
    if w.endswith("eed") and len(w) > 3:
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        cut = next((n for s, n in (("ed", 2), ("ing", 3)) if w.endswith(s) and len(w) > n), 0)
        if cut and "v" in _shape(w[:-cut]):
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")) and len(w) > 2:
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, STEP_2, 1)
    w = _replace(w, STEP_3, 1)
    w = _replace(w, STEP_4, 2)
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem_column(terms: pd.Series) -> pd.Series:
    return terms.map(stem, na_action="ignore")


def stems_of(vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """(``term``, ``stem``): stems are made once for each distinct term, not for each occurrence."""
    return vocabulary.select(term).distinct().withColumn("stem", stem_column(F.col(term)))


def stem_array(column: Column) -> Column:
    """Stems of an array of terms; for a table that is stemmed as a whole."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def of(t: str) -> str:
            if t not in known:
                if len(known) > 200_000:
                    known.clear()
                known[t] = stem(t)
            return known[t]

        return rows.map(lambda r: [of(t) for t in r], na_action="ignore")

    return run(column)
