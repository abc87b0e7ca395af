"""Distances, n-gram similarity and MinHash sketches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(a, b)


def bounded_edit_distance(a: Column, b: Column, limit: int, transpositions: bool = False) -> Column:
    """The distance, or -1 beyond ``limit``; with transpositions a swap of neighbours counts once (restricted form)."""
    return damerau(a, b, limit) if transpositions else F.levenshtein(a, b, limit)


def damerau_distance(a: str, b: str, limit: int) -> int:
    if abs(len(a) - len(b)) > limit:
        return -1
    two, one = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], two[j - 2] + 1)
        if min(row) > limit:
            return -1
        two, one = one, row
    return one[-1] if one[-1] <= limit else -1


def damerau(a: Column, b: Column, limit: int) -> Column:
    @pandas_udf(IntegerType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else damerau_distance(p, q, limit) for p, q in zip(x, y)], dtype="Int32")

    return run(a, b)


def ngram_score(a: str, b: str, n: int, search: bool) -> float:
    """Longest common subsequence of n-grams (Kondrak).  Symmetric: grams score by positions in common, over the longer side's
    number; search: only equal grams count, over the target's number (``b``)."""
    if not search and len(a) > len(b):
        a, b = b, a
    if not a and not b:
        return 1.0
    if len(a) < n or len(b) < n:
        if search:
            return 1.0 if a == b else 0.0
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        return same / max(len(a), len(b))
    ga, gb = [a[k : k + n] for k in range(len(a) - n + 1)], [b[k : k + n] for k in range(len(b) - n + 1)]
    row = [0.0] * (len(gb) + 1)
    for x in ga:
        corner = 0.0
        for j, y in enumerate(gb, 1):
            gain = float(x == y) if search else sum(p == q for p, q in zip(x, y)) / n
            corner, row[j] = row[j], max(row[j], row[j - 1], corner + gain)
    return row[-1] / len(gb)


def ngram_similarity(a: Column, b: Column, n: int, search: bool = False) -> Column:
    @pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else ngram_score(p, q, n, search) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def minhash(tokens: Column, k: int) -> Column:
    """Bottom-k sketch: the k smallest distinct hashes of the tokens."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))), F.lit(1), F.lit(k))


def minhash_jaccard(a: Column, b: Column) -> Column:
    """Common hashes over all hashes of two sketches; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def minhash_size(error: float) -> int:
    return math.ceil(1 / error**2)


def minhash_error(size: int) -> float:
    return math.inf if size == 0 else 1 / math.sqrt(size)
