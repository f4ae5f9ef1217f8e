"""Division, rounding and order-statistic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def safe_div(num: Column, den: Column) -> Column:
    """``num / den``, 0.0 where the denominator is zero or either side is null."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def dec_round(x: Column, places: int) -> Column:
    """Round through a decimal so that every engine and partitioning agrees.

    Decimals of 30 digits are slow. A value that is clearly off a tie rounds to the same
    number without them: neither its binary error nor the ten places of the decimal can
    move it past the tie, and a whole number over a power of ten is the nearest double
    either way. All else, ties, large values and what is no number, goes the decimal way.
    """
    exact = F.round(x.cast("decimal(30,10)"), places).cast("double")
    if not 0 <= places <= 6:
        return exact
    scaled = x.cast("double") * F.lit(10.0**places)
    whole = F.floor(scaled + F.lit(0.5))
    clear = (F.abs(scaled) < F.lit(1e11)) & (F.abs(scaled - whole) < F.lit(0.499))
    return F.when(clear, whole / F.lit(10.0**places)).otherwise(exact)


def upper_median(column: str, where: str | None = None) -> Column:
    """The upper of the two middle values, exact.

    Holds the distinct values of a group, so it is for groups whose size is
    bounded by construction (one entity's days, one window's days, one set of
    leaders).  ``operators.orderstats`` serves groups that grow with the data.
    """
    tail = f" FILTER (WHERE {where})" if where else ""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC){tail}")


def pct(count: Column, total: Column, places: int = 1) -> Column:
    return dec_round(F.try_divide(count * F.lit(100.0), total), places)


def presence_threshold(n_days: Column, min_pct: float) -> Column:
    """Days an entity must be present; zero when no minimum is asked for."""
    if not min_pct:
        return F.lit(0).cast("long")
    need = F.greatest(
        F.lit(1).cast("long"),
        F.bround((n_days * F.lit(float(min_pct)) / F.lit(100.0)), 0).cast("long"),
    )
    return F.when(n_days > 0, need).otherwise(F.lit(0).cast("long"))


def same_name(a: Column, b: Column) -> Column:
    """Names match after trimming and lower-casing."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def name_key(a: Column) -> Column:
    return F.lower(F.trim(a))
