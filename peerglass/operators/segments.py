"""Size segments of the population and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerglass.functions.numeric import dec_round, safe_div
from peerglass.operators import WINDOW
from peerglass.operators.orderstats import order_stats
from peerglass.params import SizeRule


def segment_of(total: Column, rule: SizeRule, window_days: Column | None = None) -> Column:
    large, medium = F.lit(float(rule.large_min)), F.lit(float(rule.medium_min))
    if rule.per_days and window_days is not None:
        factor = window_days / F.lit(float(rule.per_days))
        large, medium = large * factor, medium * factor
    names = [F.lit(label) for label in rule.labels]
    return F.when(total >= large, names[0]).when(total >= medium, names[1]).otherwise(names[2])


def segment_population(
    population: DataFrame, rule: SizeRule, window_days: str | None = None
) -> DataFrame:
    """Segment and regulated mix of every entity; thresholds see the unrounded total."""
    total = F.coalesce(F.col("total_gwh"), F.lit(0.0))
    days = F.col(window_days) if window_days else None

    def mix(part: str) -> Column:
        return dec_round(safe_div(F.coalesce(F.col(part), F.lit(0.0)), total) * 100.0, 1)

    return population.select(
        *[k for k in ("window_id", "phase") if k in population.columns],
        "agent_id",
        "name",
        dec_round(total, 1).alias("total_gwh"),
        mix("reg_gwh").alias("pct_reg"),
        mix("unreg_gwh").alias("pct_unreg"),
        segment_of(total, rule, days).alias("segment"),
    )


def segment_summary(segmented: DataFrame, rule: SizeRule, keys: list[str] = WINDOW) -> DataFrame:
    """Count, energy, market share and mix per segment; empty segments are kept."""

    def part(column: str) -> Column:
        return (
            F.sum(
                (F.col("total_gwh").cast("decimal(18,1)") * F.col(column).cast("decimal(6,1)"))
            ).cast("double")
            / 100.0
        )

    sums = segmented.groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("total_gwh").cast("decimal(18,1)")).cast("double").alias("gwh"),
        part("pct_reg").alias("reg_gwh"),
        part("pct_unreg").alias("unreg_gwh"),
    )
    # One row per window holding its segments; the labels are a fixed short list.
    packed = sums.groupBy(*keys).agg(
        F.collect_list(F.struct("segment", "n", "gwh", "reg_gwh", "unreg_gwh")).alias("rows"),
        F.sum(F.col("gwh").cast("decimal(18,1)")).cast("double").alias("total"),
    )
    labels = F.array(*[F.lit(x) for x in rule.labels])
    listed = packed.select(*keys, "total", "rows", F.explode(labels).alias("segment")).withColumn(
        "r", F.try_element_at(F.expr("filter(rows, r -> r.segment = segment)"), F.lit(1))
    )
    zero = F.lit(0.0)
    gwh = F.coalesce(F.col("r.gwh"), zero)
    return listed.select(
        *keys,
        "segment",
        F.coalesce(F.col("r.n"), F.lit(0).cast("long")).alias("n"),
        dec_round(gwh, 1).alias("gwh"),
        dec_round(F.coalesce(F.col("r.reg_gwh"), zero), 1).alias("reg_gwh"),
        dec_round(F.coalesce(F.col("r.unreg_gwh"), zero), 1).alias("unreg_gwh"),
        dec_round(safe_div(gwh, F.col("total")) * 100.0, 1).alias("market_share_pct"),
        dec_round(safe_div(F.col("r.reg_gwh"), gwh) * 100.0, 1).alias("pct_reg"),
        dec_round(safe_div(F.col("r.unreg_gwh"), gwh) * 100.0, 1).alias("pct_unreg"),
    )


def reference_demand(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Median demand per entity-day of a segment; demand is free-valued."""
    keys = keys or WINDOW + ["segment"]
    return order_stats(
        panel.where((F.col("demand") > 0) & F.col("segment").isNotNull()),
        keys,
        "demand",
        {"demand_ref": "med"},
        coarse=True,
    )


def segment_capacity(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Median over days of the segment's summed demand."""
    keys = keys or WINDOW + ["segment"]
    daily = panel.groupBy(*keys, "day").agg(F.sum("demand").alias("d"))
    return daily.groupBy(*keys).agg(F.median("d").alias("segment_demand"))


def capacity_share(df: DataFrame, demand: str, max_pct: float) -> DataFrame:
    """Share of the segment's demand and whether it is over the limit."""
    raw = F.when(
        F.col("segment_demand") > 0, F.col(demand) / F.col("segment_demand") * F.lit(100.0)
    )
    return df.withColumn("capacity_pct", dec_round(raw, 1)).withColumn(
        "over_capacity", F.coalesce(raw > F.lit(float(max_pct)), F.lit(False))
    )
