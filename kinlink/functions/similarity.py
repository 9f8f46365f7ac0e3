"""Similarities of strings and sets, as Columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import char_ngrams


def _guarded(a: Column, b: Column, value: Column) -> Column:
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(value)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return _guarded(a, b, F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Of arrays without repeats."""
    common = F.size(F.array_intersect(a, b))
    n = F.size(a) + F.size(b) - common
    return F.when(n == 0, 0.0).otherwise(common / F.greatest(n, F.lit(1)))


def dice_similarity(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / F.greatest(n, F.lit(1)))


def gram_similarity(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """char_ngram_jaccard of texts whose n-grams are made already."""
    return _guarded(a, b, jaccard_similarity(grams_a, grams_b))


def char_ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    return _guarded(a, b, jaccard_similarity(char_ngrams(a, n), char_ngrams(b, n)))


@F.pandas_udf(DoubleType())
def _longest_block(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> float:
        if x == y:
            return 1.0
        if not x or not y:
            return 0.0
        return 2.0 * SequenceMatcher(None, x, y).find_longest_match(0, len(x), 0, len(y)).size / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0.0 if not x or not y else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def lcs_similarity(a: Column, b: Column) -> Column:
    """Longest common substring, doubled, over both lengths."""
    return _longest_block(a, b)


def token_sort_similarity(t1: Column, t2: Column) -> Column:
    """Ratcliff-Obershelp ratio of the sorted tokens; 0 if either is empty. No built-in has it: Arrow batches."""
    return _ratio(F.array_join(F.array_sort(t1), " "), F.array_join(F.array_sort(t2), " "))


def _common_subsequence(x: str, y: str) -> int:
    """Length of the longest common subsequence: a row of the usual table is the bits of one number, a step for each character of y (Hyyro 2004)."""
    if len(x) < len(y):
        x, y = y, x
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    row = every = (1 << len(x)) - 1
    for c in y:
        if hit := row & places.get(c, 0):
            row = (row + hit | row - hit) & every
    return len(x) - row.bit_count()


@F.pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        return 1.0 if x == y else 2.0 * _common_subsequence(x, y) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel_similarity(a: Column, b: Column) -> Column:
    """2 * longest common subsequence / both lengths; equal strings, empty ones too, are 1. Folded by built-ins it copies a row for each cell: Arrow batches."""
    return _indel(a, b)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def f_beta(p: Column, r: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.when((p <= 0) | (r <= 0), 0.0).otherwise((1 + b) * p * r / (b * p + r))
