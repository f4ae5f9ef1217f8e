"""Mappings of star-schema and event tables onto the table contract.

``from_events`` builds 30 dense days of entity-hours from an event stream and
its customers.  ``from_orders`` builds several years of sparse entity-days from
order lines, for grids of rolling windows.  Both read whole tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerglass.params import Selection, Settings, SizeRule, SpreadBins


@dataclass(frozen=True)
class Market:
    """The four source tables under contract names."""

    hourly: DataFrame
    agents: DataFrame
    prices: DataFrame
    reservoirs: DataFrame


EVENT_BINS = SpreadBins(
    (
        ("b0_very_cheap", -999999.0, 100.0),
        ("b1_cheap", 100.0, 150.0),
        ("b2_neutral", 150.0, 200.0),
        ("b3_dear", 200.0, 250.0),
        ("b4_scarce", 250.0, 999999.0),
    )
)
EVENT_SIZES = SizeRule(large_min=4.0, medium_min=3.0, per_days=30)
EVENT_WINDOW_ID, EVENT_EVAL_DAYS = "w1", 7  # one window over all days; the last ones are for eval

ORDER_BINS = SpreadBins(
    (
        ("b0_very_cheap", -999999.0, 0.0),
        ("b1_cheap", 0.0, 25.0),
        ("b2_neutral", 25.0, 50.0),
        ("b3_dear", 50.0, 100.0),
        ("b4_scarce", 100.0, 999999.0),
    )
)
ORDER_SIZES = SizeRule(large_min=0.65, medium_min=0.5, per_days=90)
# Order lines are sparse, so an entity plays an archetype on few days of a window.
ORDER_SELECTION = Selection(min_presence_pct=5.0)


def event_settings(**changes) -> Settings:
    return Settings(sizes=EVENT_SIZES, bins=EVENT_BINS, **changes)


def order_settings(**changes) -> Settings:
    changes.setdefault("selection", ORDER_SELECTION)
    return Settings(sizes=ORDER_SIZES, bins=ORDER_BINS, **changes)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def from_events(spark: SparkSession, sf_dir: str) -> Market:
    events = _table(spark, sf_dir, "events")
    kind = F.col("event_type")
    value = F.col("value")

    def part(factor: int, *kinds: str):
        return F.when(kind.isin(*kinds), value * F.lit(float(factor))).otherwise(F.lit(0.0))

    hourly = events.select(
        F.col("user_id").cast("string").alias("agent_id"),
        "ts",
        (value * F.lit(1000.0)).alias("demand"),
        part(1000, "view", "click").alias("demand_reg"),
        part(1000, "purchase", "signup", "error").alias("demand_unreg"),
        part(900, "purchase", "signup", "view").alias("buy_contract"),
        part(500, "purchase").alias("buy_contract_reg"),
        part(100, "click").alias("sell_contract"),
        part(800, "error", "click").alias("buy_spot"),
        part(50, "error").alias("sell_spot"),
        part(300, "purchase").alias("buy_auction"),
    )
    agents = _table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("agent_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("activity"),
    )
    # Means over whole cents, summed exactly, so that the price of a day is one number.
    error_value = F.when(kind == "error", value.cast("decimal(18,2)"))
    prices = (
        events.groupBy(F.to_date("ts").alias("day"))
        .agg(F.sum(error_value).cast("double").alias("s"), F.count(error_value).alias("n"))
        .select(
            "day",
            F.lit(300.0).alias("contract"),
            F.round((F.lit(10.0) * F.try_divide("s", "n")).cast("decimal(30,10)"), 2)
            .cast("double")
            .alias("spot"),
            F.lit(600.0).alias("scarcity"),
        )
    )
    reservoirs = events.select(
        F.to_date("ts").alias("day"),
        F.get_json_object("props", "$.k").cast("double").alias("useful_volume"),
        F.lit(100.0).alias("useful_capacity"),
    )
    return Market(hourly, agents, prices, reservoirs)


def from_orders(spark: SparkSession, sf_dir: str) -> Market:
    lines = _table(spark, sf_dir, "lineitem")
    orders = _table(spark, sf_dir, "orders")
    demand = F.col("l_quantity") * F.lit(1000.0)
    regulated = F.col("l_returnflag") != F.lit("R")
    bought = demand * (F.lit(0.5) + F.lit(5.0) * F.col("l_discount"))
    zero = F.lit(0.0)
    hourly = lines.select(
        F.col("l_suppkey").cast("string").alias("agent_id"),
        F.col("l_shipdate").alias("ts"),
        demand.alias("demand"),
        F.when(regulated, demand).otherwise(zero).alias("demand_reg"),
        F.when(regulated, zero).otherwise(demand).alias("demand_unreg"),
        bought.alias("buy_contract"),
        F.when(regulated, bought).otherwise(zero).alias("buy_contract_reg"),
        zero.alias("sell_contract"),
        (demand * F.lit(10.0) * F.col("l_tax")).alias("buy_spot"),
        zero.alias("sell_spot"),
        F.when(F.col("l_returnflag") == "N", bought * F.lit(0.6)).otherwise(zero).alias("buy_auction"),
    )
    agents = _table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("agent_id"),
        F.col("s_name").alias("name"),
        F.lit("retail").alias("activity"),
    )
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    prices = (
        orders.groupBy(F.to_date("o_orderdate").alias("day"))
        .agg(F.sum(cents).cast("double").alias("s"), F.count(cents).alias("n"))
        .select(
            "day",
            F.lit(220.0).alias("contract"),
            F.round((F.try_divide("s", "n") / F.lit(1000.0)).cast("decimal(30,10)"), 2)
            .cast("double")
            .alias("spot"),
            F.lit(330.0).alias("scarcity"),
        )
    )
    reservoirs = orders.select(
        F.to_date("o_orderdate").alias("day"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("useful_volume"),
        F.lit(1.0).alias("useful_capacity"),
    )
    return Market(hourly, agents, prices, reservoirs)
