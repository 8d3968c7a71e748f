"""Word stems for recall: the suffix-stripping algorithm of Porter (1980), with diacritics folded."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes and what takes their place, by step of the published algorithm. Within a step the longest suffix counts.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """c or v for each letter; y after a consonant is a vowel."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    return shape(stem).count("vc")


def short_end(word: str) -> bool:
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def past_forms(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    end = longest(word, ("ed", "ing"))
    if end is None or "v" not in shape(word[: -len(end)]):
        return word
    word = word[: -len(end)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c" and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if measure(word) == 1 and short_end(word) else word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of fewer than three or more than 64 letters stay as they are, but for diacritics."""
    word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    if not 3 <= len(word) <= 64:
        return word
    end = longest(word, PLURALS)
    word = word[: -len(end)] + PLURALS[end] if end else word
    word = past_forms(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        end = longest(word, rules)
        if end and measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + rules[end]
    end = longest(word, STEP_4)
    if end:
        # Of -sion and -tion only -ion goes.
        rest = word[:-3] if end in ("sion", "tion") else word[: -len(end)]
        word = rest if measure(rest) > 1 else word
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(words: pd.Series) -> pd.Series:
    """Each word's stem, in place."""
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])
