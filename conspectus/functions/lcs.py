"""Longest common subsequences, bit-parallel in Arrow batches, and similarities from their length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


def lcs_length(a: str, b: str) -> int:
    """One machine operation per character of b for the whole of a (Python integers have any width)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        match = row & places.get(c, 0)
        row = (row + match | row - match) & full
    return (full & ~row).bit_count()


def lcs_string(a: list[str] | str, b: list[str] | str) -> list[str]:
    """The subsequence itself: at ties the step goes back along b unless a's is strictly better."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] > table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@F.pandas_udf(IntegerType())
def lcs_len(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_length(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def overlap_similarity(a: Column, b: Column) -> Column:
    """Length over the shorter text; 1 for equal ones, 0 for an empty one or a length below two."""
    n = lcs_len(a, b)
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0) | (n < 2), 0.0).otherwise(n / F.least(F.length(a), F.length(b)))


def indel_ratio(a: Column, b: Column) -> Column:
    """Twice the length over both texts' lengths."""
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2 * lcs_len(a, b) / (F.length(a) + F.length(b)))


def common_subsequence(sequences: list[list[str]], least: int = 2) -> list[str]:
    """A subsequence of all sequences, folded from left to right; empty once it is too short."""
    if not sequences:
        return []
    out = list(sequences[0])
    for s in sequences[1:]:
        out = lcs_string(out, s)
        if len(out) < least:
            return []
    return out


def token_run(sequences: list[list[str]], domain_terms: frozenset[str] = frozenset(), shortest: int = 2, longest: int = 10) -> list[str]:
    """The run of tokens of the highest score among those that half of the sequences share; of equal scores the first in order."""
    need, homes = max(2, len(sequences) // 2), {}
    for k, s in enumerate(sequences):
        for n in range(shortest, min(longest, len(s)) + 1):
            for i in range(len(s) - n + 1):
                homes.setdefault(tuple(s[i : i + n]), set()).add(k)
    best = [(-round(len(g) * len(h) / len(sequences) * (1 + 0.2 * sum(t in domain_terms for t in g)), 6), g) for g, h in homes.items() if len(h) >= need]
    return list(min(best)[1]) if best else []


def find_mlcs(sequences: list[list[str]], least: int = 2) -> list[str]:
    """What a few sequences have in common: of two a subsequence, of more a subsequence of characters or the best run of words."""
    if len(sequences) < 2:
        return list(sequences[0]) if sequences else []
    if len(sequences) == 2:
        out = lcs_string(*sequences)
        return out if len(out) >= least else []
    if all(len(s) == 0 or len(s[0]) <= 1 for s in sequences):
        return common_subsequence(sequences, least)
    return token_run(sequences)


@F.pandas_udf(ArrayType(StringType()))
def mlcs(sequences: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else find_mlcs([list(s) for s in x]) for x in sequences])


@F.pandas_udf(StringType())
def lcs_text(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else "".join(lcs_string(x, y)) for x, y in zip(a, b, strict=True)])
