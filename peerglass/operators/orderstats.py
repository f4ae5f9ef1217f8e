"""Exact medians and percentiles of groups that grow with the data.

A segment, a bin or a cluster may hold a third of all rows, so its values must
not be collected in one task.  The values are first counted per (group, value):
that combines on the map side and spreads a hot group over all tasks, because
the value is part of the shuffle key.  What follows works on the counts only.

* ``coarse=False``: for values on a fixed grid (two-decimal margins between the
  winsorising limits, two-decimal shares), where a group has a bounded number of
  distinct values however many rows it has.
* ``coarse=True``: for free values.  A first pass over order-preserving buckets
  finds the bucket of each wanted rank; only that bucket's counts are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKETS_PER_FOLD = 256.0


def _rank(kind, n: Column) -> Column:
    """Zero-based ascending rank of a wanted statistic among ``n`` values."""
    if kind == "um":
        return F.floor(n / 2).cast("long")
    if kind == "lower":
        return F.floor((n - 1) / 2).cast("long")
    if kind == "min":
        return F.lit(0).cast("long")
    if kind == "max":
        return (n - 1).cast("long")
    if isinstance(kind, tuple) and kind[0] == "nr":
        return F.least(F.bround(F.lit(float(kind[1])) * (n - 1), 0).cast("long"), n - 1)
    raise ValueError(f"unknown order statistic {kind!r}")


def order_bucket(value: Column) -> Column:
    """Non-decreasing in ``value``; buckets are about 0.4 % wide."""
    return F.floor(
        F.signum(value) * F.log1p(F.abs(value)) * F.lit(_BUCKETS_PER_FOLD)
    ).cast("long")


def order_stats(
    df: DataFrame,
    keys: list[str],
    value: str,
    wanted: dict[str, object],
    *,
    mean: str | None = None,
    count: str | None = None,
    coarse: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """One row per group with the wanted order statistics of ``value``.

    ``wanted`` maps output names to ``um`` (upper median), ``med`` (mean of the
    two middle values), ``min``, ``max`` or ``("nr", q)`` (nearest rank).
    ``mean`` adds the mean of two-decimal values, summed exactly.  With ``weight``
    a row stands for that many equal ones.
    """
    plain: dict[str, object] = {}
    for name, kind in wanted.items():
        if kind == "med":
            plain[f"_hi_{name}"] = "um"
            plain[f"_lo_{name}"] = "lower"
        else:
            plain[name] = kind

    v, c = F.col("_v"), F.col("_c")
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    )
    if coarse:
        hist = _only_wanted_buckets(hist, keys, list(plain.values()))
        grouping = keys + ["_b"]
    else:
        hist = hist.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys))).withColumn(
            "_before", F.lit(0).cast("long")
        )
        grouping = keys
    order = Window.partitionBy(*grouping).orderBy("_v")
    upto = F.col("_before") + F.sum("_c").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = hist.withColumn("_upto", upto)

    def pick(kind) -> Column:
        rank = _rank(kind, F.col("_n"))
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - c), v))

    aggs = [pick(kind).alias(name) for name, kind in plain.items()]
    if mean or count or coarse:
        aggs.append(F.max("_n").alias("_total"))
    if mean:
        if coarse:
            raise ValueError("the mean needs the full histogram")
        weighted = v.cast("decimal(20,2)") * c.cast("decimal(17,0)")
        aggs.append(F.sum(weighted).cast("double").alias("_sum"))
    out = ranked.groupBy(*keys).agg(*aggs)

    cols = [F.col(k) for k in keys]
    for name, kind in wanted.items():
        if kind == "med":
            cols.append(((F.col(f"_hi_{name}") + F.col(f"_lo_{name}")) / 2.0).alias(name))
        else:
            cols.append(F.col(name))
    if mean:
        cols.append((F.col("_sum") / F.col("_total")).alias(mean))
    if count:
        cols.append(F.col("_total").alias(count))
    return out.select(*cols)


def _only_wanted_buckets(hist: DataFrame, keys: list[str], kinds: list) -> DataFrame:
    """Keep the counts of buckets that hold a wanted rank, with their offsets."""
    hist = hist.withColumn("_b", order_bucket(F.col("_v")))
    per_bucket = hist.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    by_key = Window.partitionBy(*keys)
    offsets = (
        per_bucket.withColumn("_n", F.sum("_bc").over(by_key))
        .withColumn(
            "_before",
            F.sum("_bc").over(
                by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            - F.col("_bc"),
        )
    )
    hit = F.lit(False)
    for kind in kinds:
        rank = _rank(kind, F.col("_n"))
        hit = hit | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_bc")))
    wanted = offsets.where(hit).select(*keys, "_b", "_n", "_before")
    return hist.join(wanted, keys + ["_b"])


def median_profile(
    df: DataFrame,
    keys: list[str],
    features: list[str],
    kind: str = "med",
    count: str = "n_days",
    weight: str | None = None,
) -> DataFrame:
    """Per-group median of several features in one pass."""
    ids = [*keys, weight] if weight else keys
    long = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        ids, features, "_feature", "_value"
    )
    stats = order_stats(
        long, keys + ["_feature"], "_value", {"_m": kind}, count="_k", coarse=True, weight=weight
    )
    return stats.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_feature") == f, F.col("_m"))).alias(f) for f in features],
        F.max("_k").alias(count),
    )
