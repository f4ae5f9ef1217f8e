"""Ordered series: drawdown, distribution and regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerglass.functions.numeric import dec_round, upper_median
from peerglass.functions.regime import is_scarcity, spread_bin
from peerglass.operators.orderstats import order_stats
from peerglass.params import SpreadBins


def with_drawdown(df: DataFrame, keys: list[str], value: str, name: str = "drawdown") -> DataFrame:
    """Fall of the running sum below its running peak; the peak starts at zero."""
    by_day = Window.partitionBy(*keys).orderBy("day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        df.withColumn("_run", F.sum(F.col(value).cast("decimal(18,2)")).over(by_day))
        .withColumn(
            "_peak", F.greatest(F.max("_run").over(by_day), F.lit(0).cast("decimal(28,2)"))
        )
        .withColumn(name, (F.col("_peak") - F.col("_run")).cast("double"))
        .drop("_run", "_peak")
    )


def nearest_rank(column: str, q: float) -> Column:
    """Nearest-rank percentile of a group of bounded size."""
    values = F.sort_array(F.collect_list(column))
    index = F.bround(F.lit(float(q)) * (F.count(column) - 1), 0).cast("int")
    return F.when(F.count(column) > 0, F.try_element_at(values, index + 1))


def distribution(days: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Size, level, tails, loss share and drawdown of one daily series per key."""
    rows = with_drawdown(days.where(F.col(value).isNotNull()), keys, value, "_dd")
    n = F.count(value)
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        dec_round(upper_median(value), 2).alias("median"),
        dec_round(F.sum(F.col(value).cast("decimal(18,2)")).cast("double") / n, 2).alias("mean"),
        dec_round(nearest_rank(value, 0.05), 2).alias("p5"),
        dec_round(nearest_rank(value, 0.95), 2).alias("p95"),
        dec_round(F.count_if(F.col(value) < 0) * 100.0 / n, 1).alias("pct_loss_days"),
        dec_round(F.min(value), 2).alias("worst"),
        dec_round(F.max(value), 2).alias("best"),
        dec_round(F.max("_dd"), 2).alias("drawdown"),
    )


def distributions(days: DataFrame, keys: list[str]) -> DataFrame:
    """Distribution of the follower, the leaders and the segment in one pass."""
    series = F.inline(
        F.array(
            *[
                F.struct(F.lit(s).alias("series"), F.col(f"{s}_margin").alias("value"))
                for s in ("follower", "leaders", "segment")
            ]
        )
    )
    return distribution(days.select(*keys, "day", series), keys + ["series"], "value")


def regime_by_bin(prices: DataFrame, bins: SpreadBins) -> DataFrame:
    """Days and share per configured spread bin, empty bins included."""
    spread = _zero("spot") - _zero("contract")
    counts = [
        F.count_if(spread_bin(spread, bins) == F.lit(name)).alias(name) for name in bins.names
    ]
    wide = prices.agg(F.count(F.lit(1)).alias("_n"), *counts)
    return wide.unpivot(["_n"], bins.names, "bin", "n_days").select(
        "bin", "n_days", dec_round(F.try_divide(F.col("n_days") * 100.0, F.col("_n")), 2).alias("pct")
    )


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0.0))


def _history(prices: DataFrame) -> DataFrame:
    spot, scarcity = _zero("spot"), _zero("scarcity")
    return prices.select(
        F.year("day").alias("year"),
        dec_round(spot - _zero("contract"), 8).alias("spread"),
        ((scarcity > 0) & (spot > scarcity)).alias("scarce"),
    )


def regime_total(prices: DataFrame) -> DataFrame:
    """Scarcity frequency and spread levels over the whole price history."""
    rows = _history(prices)
    counts = rows.agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if("scarce").alias("n_scarcity")
    ).withColumn("_k", F.lit(1))
    levels = order_stats(
        rows.withColumn("_k", F.lit(1)),
        ["_k"],
        "spread",
        {
            "spread_p50": "um",
            "spread_p95": ("nr", 0.95),
            "spread_p99": ("nr", 0.99),
            "spread_max": "max",
        },
    )
    return counts.join(levels, "_k", "left").select(
        "n_days",
        "n_scarcity",
        F.coalesce(
            dec_round(F.try_divide(F.col("n_scarcity") * 100.0, F.col("n_days")), 2), F.lit(0.0)
        ).alias("pct_scarcity"),
        *[
            F.coalesce(dec_round(F.col(c), 1), F.lit(0.0)).alias(c)
            for c in ("spread_p50", "spread_p95", "spread_p99", "spread_max")
        ],
    )


def regime_by_year(prices: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return _history(prices).groupBy("year").agg(
        n.alias("n_days"),
        F.count_if("scarce").alias("n_scarcity"),
        dec_round(F.count_if("scarce") * 100.0 / n, 1).alias("pct_scarcity"),
    )


def day_context(prices: DataFrame, levels: DataFrame, bins: SpreadBins, keys: list[str]) -> DataFrame:
    """Spread, scarcity and reservoir level of each market day."""
    spread = F.col("spot") - F.col("contract")
    return (
        prices.withColumn("spread", dec_round(spread, 1))
        .withColumn("spread_bin", spread_bin(F.col("spread"), bins))
        .withColumn(
            "is_scarce", (F.col("scarcity") > 0) & is_scarcity(F.col("spot"), F.col("scarcity"))
        )
        .join(levels.select("day", F.col("level_pct").alias("reservoir_pct")), "day", "left")
    )


def current_regime(context: DataFrame, keys: list[str]) -> DataFrame:
    """Last spread and its bin, scarcity days, last level and its direction."""
    level = F.when(F.col("reservoir_pct").isNotNull(), F.struct("day", "reservoir_pct"))
    out = context.groupBy(*keys).agg(
        F.max_by("spread", "day").alias("last_spread"),
        F.max_by("spread_bin", "day").alias("last_bin"),
        F.count_if("is_scarce").alias("scarcity_days"),
        F.count(F.lit(1)).alias("n_days"),
        F.count("reservoir_pct").alias("_levels"),
        F.max(level)["reservoir_pct"].alias("_last"),
        F.min(level)["reservoir_pct"].alias("_first"),
    )
    delta = F.col("_last") - F.col("_first")
    return out.select(
        *keys,
        "last_spread",
        "last_bin",
        "scarcity_days",
        "n_days",
        dec_round(F.col("_last"), 1).alias("last_level"),
        F.when(F.col("_levels") < 2, "none")
        .when(delta > 1, "rising")
        .when(delta < -1, "falling")
        .otherwise("flat")
        .alias("level_trend"),
    )
