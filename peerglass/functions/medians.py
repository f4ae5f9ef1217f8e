"""The best of many medians of draws with replacement: its distribution and its inverse.

The upper median of n draws from a sorted pool lies at position j or before if more
than half of the draws do, a binomial tail in (j + 1) / pool size. The best of several
independent medians lies there if all of them do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

_TINY = 1e-300


def _log_gamma(x: np.ndarray) -> np.ndarray:
    values, place = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values])[place]


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    d = 1.0 / _away(1.0 - (a + b) * x / (a + 1.0))
    c, out = np.ones_like(x), d.copy()
    todo = np.arange(len(x))
    m = 0
    while len(todo):
        m += 1
        p, q, y = a[todo], b[todo], x[todo]
        for top in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d[todo] = 1.0 / _away(1.0 + top * d[todo])
            c[todo] = _away(1.0 + top / c[todo])
            step = d[todo] * c[todo]
            out[todo] *= step
        todo = todo[np.abs(step - 1.0) > 1e-15 * m]
    return out


def _away(x: np.ndarray) -> np.ndarray:
    """The numbers, kept off zero."""
    return np.where(np.abs(x) < _TINY, _TINY, x)


def log_binomial_tail(n: np.ndarray, least: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Logarithm of the chance of ``least`` or more successes in n trials."""
    n, least, p = (np.asarray(v, dtype=float) for v in (n, least, p))
    out = np.where(((p >= 1.0) & (least <= n)) | (least <= 0), 0.0, -np.inf)
    open_ = (p > 0.0) & (p < 1.0) & (least > 0) & (least <= n)
    n, a, x = n[open_], least[open_], p[open_]
    b = n - a + 1.0
    front = _log_gamma(n + 1.0) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)
    turned = x > (a + 1.0) / (n + 3.0)  # the fraction is fast on one side of the mean only
    part = _fraction(np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1.0 - x, x))
    chance = np.minimum(np.exp(front) * part / np.where(turned, b, a), 1.0)
    with np.errstate(divide="ignore"):
        out[open_] = np.where(turned, np.log1p(-chance), front + np.log(part / a))
    return np.minimum(out, 0.0)


@F.pandas_udf(DoubleType())
def binomial_upper_tail(n: pd.Series, least: pd.Series, p: pd.Series) -> pd.Series:
    """Chance of ``least`` or more successes in n trials."""
    return pd.Series(np.exp(log_binomial_tail(n.to_numpy(), least.to_numpy(), p.to_numpy())))


def chance_best_upto(
    j: np.ndarray, pool: np.ndarray, row: np.ndarray, draws: np.ndarray, members: np.ndarray
) -> np.ndarray:
    """Chance that the best median lies at position j of its row's pool or before.

    ``row``, ``draws``, ``members``: classes of medians with equally many draws.
    """
    tail = log_binomial_tail(draws, draws // 2 + 1, (j[row] + 1) / pool[row])
    total = np.zeros(len(j))
    np.add.at(total, row, members * tail)
    return np.exp(total)


def _flat(draws: pd.Series, members: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(draws)), [len(d) for d in draws])
    flat = lambda s: np.concatenate([np.asarray(v, dtype=np.int64) for v in s] or [np.zeros(0, np.int64)])
    return row, flat(draws), flat(members)


@F.pandas_udf(DoubleType())
def best_median_upto(j: pd.Series, pool: pd.Series, draws: pd.Series, members: pd.Series) -> pd.Series:
    """Chance that the best of the medians lies at position j of the sorted pool or before."""
    return pd.Series(chance_best_upto(j.to_numpy(), pool.to_numpy(), *_flat(draws, members)))


@F.pandas_udf(LongType())
def best_median_at(u: pd.Series, pool: pd.Series, draws: pd.Series, members: pd.Series) -> pd.Series:
    """The least position whose chance (``best_median_upto``) reaches u, by bisection."""
    size, classes = pool.to_numpy(), _flat(draws, members)
    low, high = np.zeros(len(u), dtype=np.int64), size - 1
    while (low < high).any():
        mid = (low + high) // 2
        there = chance_best_upto(mid, size, *classes) >= u.to_numpy()
        high, low = np.where(there, mid, high), np.where(there | (low >= high), low, mid + 1)
    return pd.Series(low)
