"""Hour to day to window: the roll-ups of the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerglass.functions.numeric import dec_round
from peerglass.sources.tables import MEASURES


def latest_day(prices: DataFrame) -> DataFrame:
    return prices.agg(F.max("day").alias("latest_day"))


def price_history(prices: DataFrame) -> DataFrame:
    return prices.select("day", "contract", "spot", "scarcity")


def daily_volumes(hourly: DataFrame) -> DataFrame:
    """Entity-hour facts to entity-days; the only shuffle of the raw fact."""
    return hourly.groupBy("agent_id", F.to_date("ts").alias("day")).agg(
        *[F.sum(m).alias(m) for m in MEASURES]
    )


def _active(agents: DataFrame, activities) -> DataFrame:
    return agents.where(F.col("activity").isin(*activities)) if activities else agents


def entity_days(
    daily: DataFrame, agents: DataFrame, prices: DataFrame, activities=None
) -> DataFrame:
    """Entity-days with demand, of the wanted activities, with the day's prices.

    The volumes are summed before either join, so the joins see one row per
    entity and day.  A day without a price row drops out.
    """
    active = _active(agents, activities).select("agent_id")
    priced = price_history(prices).select(
        "day", *[F.coalesce(F.col(p), F.lit(0.0)).alias(p) for p in ("contract", "spot", "scarcity")]
    )
    return (
        daily.where(F.col("demand") > 0)
        .select(
            "agent_id", "day", *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in MEASURES]
        )
        .join(active, "agent_id", "left_semi")
        .join(priced, "day")
    )


def duplicate_keys(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations that occur more than once; empty for a valid panel."""
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def population(
    daily: DataFrame, agents: DataFrame, activities=None, keys: list[str] | None = None
) -> DataFrame:
    """Demand of every entity over each window, in GWh, where there was any.

    Takes daily volumes that already carry the window keys.  All days count,
    also those without a price row.
    """
    keys = keys or ["window_id"]
    totals = (
        daily.groupBy(*keys, "agent_id")
        .agg(
            F.sum("demand").alias("d"),
            F.sum("demand_reg").alias("r"),
            F.sum("demand_unreg").alias("u"),
        )
        .where(F.col("d") > 0)
    )
    return totals.join(_active(agents, activities), "agent_id").select(
        *keys,
        "agent_id",
        "name",
        "activity",
        dec_round(F.col("d") / 1e6, 3).alias("total_gwh"),
        dec_round(F.col("r") / 1e6, 3).alias("reg_gwh"),
        dec_round(F.col("u") / 1e6, 3).alias("unreg_gwh"),
    )


def reservoir_level(reservoirs: DataFrame) -> DataFrame:
    """Ratio of sums per day, null where the capacity is zero."""
    return reservoirs.groupBy("day").agg(
        (F.try_divide(F.sum("useful_volume"), F.nullif(F.sum("useful_capacity"), F.lit(0.0))) * 100.0)
        .alias("level_pct")
    )
