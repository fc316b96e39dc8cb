"""String similarities (M1): insert-delete ratios over whole, partial and token-wise texts.

Scores run from 0 to 100. The scores of a pair come from one Arrow UDF, which
handles each distinct pair of a batch once; ``native_ratio`` is the plain ratio
without Python, for short names.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("score", "ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "wratio")
_KIND = ", ".join(f"{m} double" for m in METRICS)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _best_window(short: str, long: str) -> float:
    n, best = len(short), 0.0
    letters = set(short)
    for lo in range(1 - n, len(long)):
        window = long[max(0, lo) : lo + n]
        # a window that ends (or, past the end, begins) with a letter foreign to the short text is no better than its neighbour
        if (window[-1] if lo + n <= len(long) else window[0]) not in letters:
            continue
        best = max(best, ratio(short, window))
        if best == 100.0:
            break
    return best


def partial_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) and best < 100.0 else best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_set_ratio(a: str, b: str) -> float:
    both, left, right = _token_parts(a, b)
    if not (both or left) or not (both or right):
        return 0.0
    if both and (not left or not right):
        return 100.0
    gap = 1 if both else 0
    one, two = len(both) + gap + len(left), len(both) + gap + len(right)
    best = 100.0 - 100.0 * (len(left) + len(right) - 2 * common(left, right)) / (one + two)
    if both:
        best = max(best, *(100.0 - 100.0 * (gap + len(rest)) / (2 * len(both) + gap + len(rest)) for rest in (left, right)))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _token_parts(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(left, right))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if spread < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if spread <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


@lru_cache(maxsize=50_000)
def scores(a: str, b: str) -> tuple[float, ...]:
    """The metrics of two normalised texts, rounded to two places; zeros if one is blank."""
    if not a or not b:
        return (0.0,) * len(METRICS)
    plain, part, order, tokens, weighted = (round(f(a, b), 2) for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, wratio))
    return max(part, tokens, weighted), plain, part, order, tokens, weighted


def _scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scores(x or "", y or "") for x, y in zip(a, b)], columns=list(METRICS))


def _weighted(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([wratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def fuzzy_scores(a: Column, b: Column) -> Column:
    """Struct of the metrics of two columns of normalised texts."""
    return F.pandas_udf(_scored, _KIND)(a, b)


def weighted_ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_weighted, "double")(a, b)


def native_ratio(a: Column, b: Column) -> Column:
    """``ratio`` by a fold over the characters, all in the JVM."""
    bs = F.split(b, "")
    zero = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(prev: Column, c: Column) -> Column:
        step = F.transform(bs, lambda d, j: F.greatest(F.get(prev, j + 1), F.when(d == c, F.get(prev, j) + 1).otherwise(0)))
        return F.aggregate(step, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x))))

    lcs = F.element_at(F.aggregate(F.split(a, ""), zero, row), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(200.0 * lcs / total)
