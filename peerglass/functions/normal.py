"""Normal distribution helpers; Spark SQL has no error function."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_STD = NormalDist()
_REACH = 9.0
# Values over a grid of z, exact at its points; between them one Taylor step of
# third order is exact to the last digits.
_Z = np.linspace(-_REACH, _REACH, 18_001)
_CDF = np.array([_STD.cdf(z) for z in _Z])


def cdf(z: np.ndarray) -> np.ndarray:
    """Distribution function, by a Taylor step from the nearest grid point."""
    z = np.asarray(z, dtype=float)
    near = np.clip(np.rint((np.nan_to_num(z) + _REACH) * 1000), 0, len(_Z) - 1).astype(int)
    a = _Z[near]
    h = np.clip(z, -_REACH, _REACH) - a
    density = np.exp(-a * a / 2) / np.sqrt(2 * np.pi)
    step = h * (1 - h * a / 2 + h * h * (a * a - 1) / 6 + h**3 * (3 * a - a**3) / 24)
    return _CDF[near] + density * step


def ppf(p: np.ndarray) -> np.ndarray:
    """Inverse of ``cdf``: Newton steps from the grid; NaN outside (0, 1)."""
    p = np.asarray(p, dtype=float)
    ok = (p > 0) & (p < 1)
    low = np.where(ok, np.minimum(p, 1 - p), 0.5)  # the lower tail keeps its digits
    rising = np.maximum.accumulate(_CDF)
    z = np.interp(low, rising[: len(_Z) // 2 + 1], _Z[: len(_Z) // 2 + 1])
    for _ in range(4):
        z = z - (cdf(z) - low) / (np.exp(-z * z / 2) / np.sqrt(2 * np.pi))
    return np.where(ok, np.where(p < 0.5, z, -z), np.nan)


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(cdf(z.to_numpy())).where(z.notna().to_numpy(), None)


@F.pandas_udf(DoubleType())
def normal_ppf(p: pd.Series) -> pd.Series:
    found = ppf(p.to_numpy())
    return pd.Series(found).where(~np.isnan(found), None)
