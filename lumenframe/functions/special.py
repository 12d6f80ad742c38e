"""Distribution functions in numpy (no scipy): Student t, incomplete beta, digamma."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    z = np.clip(z, 0, 1)
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.where(z == 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(invalid="ignore"):
        return betainc(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of Student's t by bisection, p in (0.5, 1)."""
    lo, hi = 0.0, 1e5
    for _ in range(70):
        mid = (lo + hi) / 2
        if 1 - 0.5 * float(t_two_sided(np.array([mid]), np.array([df]))[0]) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    r = np.zeros_like(x)
    while (x < 6).any():
        small = x < 6
        r[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return r + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def t_pvalue(t: Column, df: Column) -> Column:
    """Column of two-sided p values; null where t or df is null."""

    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & df.notna()
        out = pd.Series(np.nan, index=t.index)
        out[ok] = t_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
        return out.where(ok, None)

    return run(t.cast("double"), df.cast("double"))
