"""Porter's stemmer (1980), applied to a vocabulary rather than to every token."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Suffix tables of the published algorithm, by step.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _short_end(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _longest(w: str, ends) -> str | None:
    return max((e for e in ends if w.endswith(e)), key=len, default=None)


@cache
def stem(word: str) -> str:
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        end = _longest(w, ("ed", "ing"))
        if end and "v" in _shape(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        end = _longest(w, table)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = _longest(w, STEP4)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(word: str) -> str:
    """Lower-case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def stem_postings(postings: DataFrame, term: str = "term", tf: str = "tf") -> DataFrame:
    """Postings of folded stems.  Each distinct term is stemmed once, then joined back."""

    @F.pandas_udf(StringType())
    def stems(s: pd.Series) -> pd.Series:
        return s.map(lambda w: stem(fold(w)))

    words = postings.select(term).distinct().withColumn("_stem", stems(term))
    others = [c for c in postings.columns if c not in (term, tf)]
    return postings.join(words, term).groupBy(F.col("_stem").alias(term), *others).agg(F.sum(tf).alias(tf))
