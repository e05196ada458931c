"""Jaro-Winkler similarity on code points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro(a: str, b: str) -> float:
    """Jaro similarity (1989): matches within half the longer length, less half the transpositions."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    taken, left = bytearray(m), []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), min(m, i + reach + 1))
        while j >= 0 and taken[j]:
            j = b.find(c, j + 1, min(m, i + reach + 1))
        if j >= 0:
            taken[j] = 1
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    k = len(left)
    crossed = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (k / n + k / m + (k - crossed) / k) / 3.0


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised above 0.7 by a common beginning of up to four characters (Winkler 1990)."""
    sim = jaro(a, b)
    if sim <= 0.7:
        return sim
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return min(1.0, sim + 0.1 * same * (1.0 - sim))


@F.pandas_udf(DoubleType())
def jw(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by row; null with a null."""
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
