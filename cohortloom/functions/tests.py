"""Tail probabilities as Arrow functions over rows that Spark has already aggregated (one row a test)."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """p of the table [[a, b], [c, d]]: greater, two-sided (all tables no more likely than this one)."""
    n1, n2, m = a + b, c + d, a + c
    low, high = max(0, m - n2), min(n1, m)
    whole = _log_choose(n1 + n2, m)
    logs = [_log_choose(n1, x) + _log_choose(n2, m - x) - whole for x in range(low, high + 1)]
    here = logs[a - low]
    p = lambda it: min(1.0, math.fsum(math.exp(x) for x in it))
    return p(logs[a - low :]), p(x for x in logs if x <= here + 1e-7)


@F.pandas_udf(T.StructType([T.StructField("p_greater", T.DoubleType()), T.StructField("p_two", T.DoubleType())]))
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fisher(*map(int, x)) for x in zip(a, b, c, d, strict=True)], columns=["p_greater", "p_two"])


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_tail(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - s, 1e300, 1 / (x + 1 - s)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - s)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else normal_tail(v)).astype("float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) or k < 1 else gamma_tail(k / 2, v / 2) for v, k in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation over n pairs, by Student's t."""
    return pd.Series([None if pd.isna(v) or k < 3 else 0.0 if abs(v) >= 1 else beta_share((k - 2) / 2, 0.5, 1 - v * v) for v, k in zip(r, n, strict=True)], dtype="float64")


#: Standard deviations to either side of a sum beyond which it has less than 1e-12 of the mass; logarithm of the least product that counts.
REACH, LEAST_TERM = 7.6, -44.0


def signed_tail(ranks: np.ndarray, counts: np.ndarray, w: int) -> float:
    """P(W <= w), w at most half of all ranks' sum: W sums the ranks (whole numbers, each counts[i] times) whose fair coins show heads.

    The coins are tilted until W has mean w, so that even a tiny tail is a sum over the middle of a distribution. That sum is taken over
    the characteristic function at the frequencies of a period that holds the middle; ranks multiply into it one by one,
    and frequencies at which the product has vanished are left out of what follows.
    """
    total = int((ranks * counts).sum())
    if w >= total:
        return 1.0
    if w <= 0:
        return math.exp(-math.log(2) * float(counts.sum())) if w == 0 else 0.0
    r, n = ranks.astype(float), counts.astype(float)
    low, high = -1.0, 0.0
    mean = lambda t: float((n * r / (1 + np.exp(np.minimum(-t * r, 700)))).sum())
    while mean(low) > w:
        low *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < w else (low, mid)
    tilt = high
    scale = math.exp(float((n * (np.logaddexp(0, tilt * r) - math.log(2))).sum()) - tilt * w)
    # half a period or more on either side of w; a power of two, so that products wrap as machine words do
    period = 1 << max(6, (2 * min(total + 1, int(REACH * math.sqrt(float((n * r * r).sum()) / 4)) + 1) - 1).bit_length())
    half = period // 2
    up = 1 / (1 + np.exp(np.minimum(-tilt * r, 700)))
    spread = 4 * up * (1 - up)
    first = np.argsort(-counts * spread)
    sines = squared_sines(period)
    out = 0.0
    for begin in range(0, half + 1, 1 << 15):
        k = np.arange(begin, min(half + 1, begin + (1 << 15)), dtype=np.uint32)
        size = np.zeros(len(k), dtype=np.float32)
        for j, i in enumerate(first):
            place = (k * np.uint32(ranks[i] & 0xFFFFFFFF)) & np.uint32(period - 1)
            shrunk = np.float32(1) - np.float32(spread[i]) * sines[place]
            size += np.float32(counts[i] / 2) * np.log(np.maximum(shrunk, np.float32(1e-30), out=shrunk), out=shrunk)
            if j % 4 == 3:
                k, size = k[size > LEAST_TERM], size[size > LEAST_TERM]
                if not len(k):
                    break
        for some in np.array_split(k.astype(np.int64), len(k) // 1024 + 1) if len(k) else ():
            angle = 2 * np.pi / period
            phi = ((1 - up + up * np.exp(1j * angle * (some[:, None] * ranks % period))) ** counts).prod(axis=1)
            # the geometric sum over w, w - 1, ... of half a period
            whole = np.where(some % 2 == 0, np.expm1(tilt * half), -1 - np.exp(tilt * half))
            step = np.expm1(tilt + 1j * angle * some)
            terms = np.where(step == 0, half, whole / np.where(step == 0, 1, step))
            each = (phi * np.exp(-1j * angle * (some * w % period)) * terms).real
            out += float((each * np.where((some == 0) | (some == half), 1.0, 2.0)).sum())
    return min(1.0, max(0.0, scale * out / period))


@functools.lru_cache(maxsize=4)
def squared_sines(period: int) -> np.ndarray:
    """Of half the angle of each place of the period."""
    return (np.sin(np.pi / period * np.arange(period)) ** 2).astype(np.float32)


@F.pandas_udf(T.DoubleType())
def signed_p(ranks: pd.Series, counts: pd.Series, plus: pd.Series) -> pd.Series:
    """Two-sided p of the exact signed-rank test: of twice the distinct average ranks, how often each occurs, and the sum of the positive ones."""
    found = []
    for r, n, w in zip(ranks, counts, plus, strict=True):
        r, n = np.asarray(r, dtype=np.int64), np.asarray(n, dtype=np.int64)
        found.append(min(1.0, 2 * signed_tail(r, n, min(int(w), int((r * n).sum()) - int(w)))))
    return pd.Series(found, dtype=float)
