"""Sums of all earlier rows, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerglass.sources.tables import durable


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe equality of the named columns, which the result has once."""
    renamed = right.select(
        *(F.col(n).alias(f"_same_{n}") for n in names),
        *(c for c in right.columns if c not in names),
    )
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"_same_{n}"))
    return left.join(renamed, condition, how).drop(*(f"_same_{n}" for n in names))


def running_totals(
    rows: DataFrame, keys: list[str], order: list[str], value: str, label: str
) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over earlier rows of the same keys.

    Rows are dealt into ranges of (keys, order), so a group that holds most rows
    is spread over many ranges. Ranges are stored, since their edges are drawn
    anew each time they are computed. The sums of a group's ranges (one row per
    range) give each range its start. Rows that tie on all of ``order`` are put in
    any order.
    """
    ranges = durable(
        rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), label
    )
    held = ranges.groupBy(*keys, "_range").agg(F.sum(value).alias("_held"))
    earlier = (Window.unboundedPreceding, -1)
    past = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*earlier)
    starts = held.select(
        *keys, "_range", F.coalesce(F.sum("_held").over(past), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*earlier)
    return (
        join_same(ranges, starts, [*keys, "_range"])
        .withColumn("before", F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_range", "_start")
    )
