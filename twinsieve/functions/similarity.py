"""Similarities as column expressions.  NaN means "not comparable" and never passes a threshold."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Similarity = Callable[[Column, Column], Column]
NAN = float("nan")


def lev_sim(a: Column, b: Column, longest: int = 200, most: int | None = None) -> Column:
    """1 - distance / longer length, both cut to ``longest``; NaN if both are empty, null if one is null.

    With ``most`` the distance is worked out only up to that; a larger one counts as similarity 0.
    """
    a, b = F.substring(a, 1, longest), F.substring(b, 1, longest)
    size = F.greatest(F.length(a), F.length(b))
    if most is None:
        sim = 1 - F.levenshtein(a, b) / F.greatest(size, F.lit(1))
    else:
        distance = F.levenshtein(a, b, most)
        sim = F.when(distance < 0, F.lit(0.0)).otherwise(1 - distance / F.greatest(size, F.lit(1)))
    return F.when(size == 0, F.lit(NAN)).otherwise(sim)


def lev_bound(a: Column, b: Column, longest: int = 200) -> Column:
    """What ``lev_sim`` can't exceed, from the lengths alone (NaN like it)."""
    n, m = F.least(F.length(a), F.lit(longest)), F.least(F.length(b), F.lit(longest))
    size = F.greatest(n, m)
    return F.when(size == 0, F.lit(NAN)).otherwise(1 - F.abs(n - m) / F.greatest(size, F.lit(1)))


def record_sim(pairs: Sequence[tuple[Column, Column]], weights: Sequence[float] | None = None, similarity: Similarity = lev_sim) -> Column:
    """Weighted sum (weights as they are), or the mean over attributes that are present on at least one side.

    Values are compared in lower case.  An attribute absent on one side counts as 0, on both sides it is skipped.
    Terms are added in the order given.
    """
    terms, counts = [], []
    for i, (a, b) in enumerate(pairs):
        value = F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), 0.0).otherwise(similarity(F.lower(a), F.lower(b)))
        terms.append(value if weights is None else value * float(weights[i]))
        counts.append(F.when(a.isNull() & b.isNull(), 0).otherwise(1))
    if not terms:
        return F.lit(NAN)
    total = reduce(lambda x, y: x + y, terms, F.lit(0.0))
    if weights is not None:
        return total
    n = reduce(lambda x, y: x + y, counts)
    return F.when(n == 0, F.lit(NAN)).otherwise(total / F.greatest(n, F.lit(1)))


def at_least(value: Column, threshold: float) -> Column:
    """value >= threshold; never for NaN, which Spark orders above all numbers."""
    return ~F.isnan(value) & (value >= threshold)


def qgrams(value: Column, q: int = 2, padded: bool = False) -> Column:
    """The q-grams in order, with repeats; padded with q - 1 ``$`` on each side if asked for.  Shorter than q: none."""
    if padded:
        value = F.concat(F.lit("$" * (q - 1)), value, F.lit("$" * (q - 1)))
    n = F.length(value)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substring(value, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))


def jaccard_set(a: Column, b: Column) -> Column:
    """|A and B| / |A or B| of two token arrays as sets; null is no tokens; NaN if both are empty."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(NAN)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def jaccard_bag(a: Column, b: Column) -> Column:
    """Sum of the lesser counts over |A| + |B|, at most one half; NaN if both are empty."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    times = lambda x, t: F.size(F.filter(x, lambda q: q == t))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + F.least(times(a, t), times(b, t)))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(NAN)).otherwise(common / F.greatest(both, F.lit(1)))


def jaccard(q: int = 2, bag: bool = False, padded: bool = False) -> Similarity:
    """A similarity of two strings by their q-grams; a null string is the empty one."""
    measure = jaccard_bag if bag else jaccard_set
    return lambda a, b: measure(qgrams(F.coalesce(a, F.lit("")), q, padded), qgrams(F.coalesce(b, F.lit("")), q, padded))


def _jaro_winkler(a: str, b: str, scale: float = 0.1, boost_from: float = 0.7) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    m, moved = len(left), sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * scale * (1 - jaro) if jaro >= boost_from else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity, boosted from 0.7 on; the one similarity that has no built-in function.  Null if one is null."""
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def jaro_winkler_mean(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Mean over the attributes, compared in lower case."""
    return reduce(lambda x, y: x + y, (jaro_winkler(F.lower(a), F.lower(b)) for a, b in pairs)) / len(pairs)
