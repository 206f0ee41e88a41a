"""Text analysis for keyword search.

``simple`` lower-cases and takes runs of a-z and 0-9: expressions only. ``english`` also drops common words
and stems by Porter's algorithm of 1980, in an Arrow-batched UDF; a token joined by hyphens gives its parts and the whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The commonest words of English, which no keyword search looks for.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing "
    "don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me "
    "more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the "
    "their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with you your yours yourself yourselves"
).split()


def simple_lexemes(text: Column) -> Column:
    """All tokens in order, duplicates kept; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def occurrences(lexemes: Column, terms: Column) -> Column:
    """How many lexemes are query terms."""
    return F.size(F.filter(lexemes, lambda x: F.array_contains(terms, x)))


def keyword_score(found: Column, n_lexemes: Column) -> Column:
    """Cover density of a query of alternatives, with a logarithmic length norm: each occurrence is a cover of its own."""
    return F.lit(0.1) * found / F.ln(F.lit(1) + n_lexemes)


_VOWEL = re.compile("[aeiou]")


class Porter:
    """Porter's suffix stripping. A stem's measure is its number of vowel-consonant sequences."""

    RULES_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
    RULES_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    RULES_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    @staticmethod
    def shape(word: str) -> str:
        out = ""
        for i, c in enumerate(word):
            vowel = bool(_VOWEL.match(c)) or (c == "y" and i > 0 and out[-1] == "c")
            out += "v" if vowel else "c"
        return out

    @classmethod
    def measure(cls, stem: str) -> int:
        return len(re.findall("v+c+", cls.shape(stem)))

    @classmethod
    def _short(cls, stem: str) -> bool:
        return cls.shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"

    @classmethod
    def _double(cls, stem: str) -> bool:
        return len(stem) > 1 and stem[-1] == stem[-2] and cls.shape(stem)[-1] == "c"

    @classmethod
    def _replace(cls, word: str, rules, least: int) -> str:
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            if word.endswith(suffix):
                stem = word[: len(word) - len(suffix)]
                return stem + new if cls.measure(stem) > least else word
        return word

    @classmethod
    @functools.lru_cache(100_000)
    def stem(cls, word: str) -> str:
        if len(word) < 3 or not word.isascii() or not word.isalpha():
            return word
        for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if word.endswith(suffix):
                word = word[: len(word) - len(suffix)] + new
                break
        if word.endswith("eed"):
            if cls.measure(word[:-3]) > 0:
                word = word[:-1]
        else:
            cut = next((n for s, n in (("ed", 2), ("ing", 3)) if word.endswith(s) and "v" in cls.shape(word[:-n])), 0)
            if cut:
                word = word[:-cut]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif cls._double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif cls.measure(word) == 1 and cls._short(word):
                    word += "e"
        if word.endswith("y") and "v" in cls.shape(word[:-1]):
            word = word[:-1] + "i"
        word = cls._replace(cls._replace(word, cls.RULES_2, 0), cls.RULES_3, 0)
        for suffix in sorted(cls.RULES_4, key=len, reverse=True):
            if word.endswith(suffix):
                stem = word[: len(word) - len(suffix)]
                if cls.measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                    word = stem
                break
        if word.endswith("e"):
            m = cls.measure(word[:-1])
            if m > 1 or (m == 1 and not cls._short(word[:-1])):
                word = word[:-1]
        if cls.measure(word) > 1 and word.endswith("ll"):
            word = word[:-1]
        return word


_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_STOP = frozenset(STOPWORDS)


def english(text: str | None) -> list[str]:
    """Stems in order, without stop words."""
    out: list[str] = []
    for token in _TOKEN.findall((text or "").lower()):
        parts = token.split("-")
        words = [token, *parts] if len(parts) > 1 else parts
        out += [Porter.stem(w) for w in words if w not in _STOP]
    return out


def simple(text: str | None) -> list[str]:
    return re.findall("[a-z0-9]+", (text or "").lower())


ANALYSERS: dict[str, Callable[[str | None], list[str]]] = {"simple": simple, "english": english}


def lexemes(text: Column, analyser: str = "simple") -> Column:
    """The tokens of ``text`` by analyser."""
    if analyser == "simple":
        return simple_lexemes(text)
    analyse = ANALYSERS[analyser]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(analyse)

    return run(text)
