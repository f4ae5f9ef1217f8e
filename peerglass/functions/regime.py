"""Spread bins and the scarcity flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerglass.params import SpreadBins


def spread_bin(spread: Column, bins: SpreadBins) -> Column:
    """Name of the bin a spread falls in; never null for a non-null spread."""
    first, last = bins.bins[0], bins.bins[-1]
    inside = reduce(
        lambda acc, b: acc.when((spread >= F.lit(b[1])) & (spread < F.lit(b[2])), F.lit(b[0])),
        bins.bins[1:],
        F.when(spread < F.lit(first[2]), F.lit(first[0])),
    )
    named = inside.otherwise(F.lit(last[0]))
    return F.when(spread.isNotNull(), named)


def bin_bound(name: Column, bins: SpreadBins, side: str) -> Column:
    """Lower (``lo``) or upper (``hi``) bound of a named bin."""
    pick = 1 if side == "lo" else 2
    out = F.lit(None).cast("double")
    for b in bins.bins:
        out = F.when(name == F.lit(b[0]), F.lit(float(b[pick]))).otherwise(out)
    return out


def is_scarcity(spot: Column, scarcity: Column) -> Column:
    return spot > scarcity
