"""Words of a text for keyword search: lexemes, stems after Porter (1980), and the rank of a text for a query of alternatives."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say too little to be searched for.
STOP_WORDS = """a an and are as at be but by for from had has have he her his i if in into is it its me my no nor not of on or our she so some such than that the their them then there these they this those to too up was we were what when which who will with you your""".split()
# Porter's endings, by step, and what stands for them.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_RULES = [[(a, b) for a, _, b in (x.partition(":") for x in sorted(step.split(), key=len, reverse=True))] for step in (STEP_2, STEP_3, STEP_4)]


def _shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in w:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", _shape(w)))


def _short_end(w: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y at the end."""
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _double_end(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _replace(w: str, rules: list[tuple[str, str]], least: int) -> str:
    """By the longest ending that fits, if what stands before it is long enough."""
    for end, new in rules:
        if w.endswith(end):
            stem = w[: -len(end)]
            fits = _measure(stem) > least and (end != "ion" or stem[-1:] in ("s", "t"))
            return stem + new if fits else w
    return w


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """The stem of a lower-case word."""
    if len(w) < 3:
        return w
    w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        bare = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if bare is not None and "v" in _shape(bare):
            w = bare + "e" if bare.endswith(("at", "bl", "iz")) else bare[:-1] if _double_end(bare) and bare[-1] not in "lsz" else bare + "e" if _measure(bare) == 1 and _short_end(bare) else bare
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules, least in zip(_RULES, (0, 0, 1), strict=True):
        w = _replace(w, rules, least)
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or m == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


#: What parts words.
CUT = r"[^\p{L}0-9]+"


def lexemes(text: Column) -> Column:
    """Words in the order of the text, in lower case."""
    return F.filter(F.split(F.lower(text), CUT), lambda x: x != "")


def parted(text: Column) -> Column:
    """The same words as one text, with a blank where they are cut."""
    return F.regexp_replace(F.lower(text), CUT, " ")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stems of the words that aren't stop words."""
    stop = frozenset(STOP_WORDS)
    return words.map(lambda ws: [stem(w) for w in ws if w not in stop] if ws is not None else [])


def stemmed(text: Column) -> Column:
    return stems(lexemes(text))


#: The weight of a word of plain text, and the sum of all inverse squares, by which a rank is held below it.
WEIGHT, LIMIT = 0.1, 1.64493406685


def rank(words: Column, terms: Column) -> Column:
    """The mean over ``terms`` of WEIGHT / LIMIT times the sum of 1 / k^2 for the k-th time that a term occurs in ``words``."""

    def of(term: Column) -> Column:
        n = F.size(F.filter(words, lambda w: w == term))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, k: s + 1.0 / (k * k))).otherwise(0.0)

    total = F.aggregate(F.transform(terms, of), F.lit(0.0), lambda s, x: s + x)
    return F.round(total * WEIGHT / LIMIT / F.greatest(F.size(terms), F.lit(1)), 6)
