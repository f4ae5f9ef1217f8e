"""Result tables with their published column layout, and the writers for them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerglass.params import SpreadBins
from peerglass.sources.tables import durable


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header and UTF-8; one file per partition of the result."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def publish(table: DataFrame, path: str, keys: list[str], by: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """Replace the partitions that a result table has rows for, and read the whole table back.

    The rows are stored and checked before anything under ``path`` changes: a
    repeated key, or one without its partition, is an error. Spark stages the new
    partitions and moves them in as the job commits, so a run that fails leaves the
    old ones, a rerun leaves one copy, and partitions of other runs stay. A
    partition that has no rows any more keeps those it had.
    """
    stored = durable(table, "publish")
    unplaced = reduce(or_, (F.col(k).isNull() for k in by))
    bad = stored.groupBy(*dict.fromkeys([*keys, *by])).count().where(unplaced | (F.col("count") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"keys {keys} repeat or lack their partition: {bad[0]}")
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path).select(*table.columns)


def flag(column: str) -> Column:
    return F.col(column).cast("int").alias(f"{column}_1_0")


def metric_rows(df: DataFrame, keys: list[str], metrics: list[str], keep_nulls: bool = True) -> DataFrame:
    """One row per metric of a one-row-per-key table."""
    long = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        keys, metrics, "metric", "value"
    )
    return long if keep_nulls else long.where(F.col("value").isNotNull())


def leaders_table(leaders: DataFrame, keys: list[str]) -> DataFrame:
    return leaders.select(
        *keys,
        "pos",
        "agent_id",
        "name",
        "n_days",
        "median_margin",
        "mean_margin",
        "relative_median",
        "pct_above_segment",
        "pct_loss_days",
        "drawdown",
        "downside_median",
    )


def policy_table(rules: DataFrame, bins: SpreadBins, keys: list[str]) -> DataFrame:
    """Every configured bin of every policy, trained or not, and its fallback row."""
    shares = ["pct_contract", "pct_spot", "pct_unregulated", "pct_auction"]
    frame = rules.select(*keys).distinct()
    configured = F.array(
        *[
            F.struct(F.lit(b).alias("bin"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
            for b, lo, hi in bins.bins
        ]
    )
    grid = frame.select(*keys, F.inline(configured))
    trained = rules.where(F.col("bin").isNotNull()).select(*keys, "bin", "n_days", *shares)
    listed = grid.join(trained, keys + ["bin"], "left").withColumn(
        "n_days", F.coalesce("n_days", F.lit(0).cast("long"))
    )
    fallback = rules.where(F.col("bin").isNull()).select(
        *keys,
        F.lit("FALLBACK").alias("bin"),
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        "n_days",
        *shares,
    )
    return listed.select(*fallback.columns).unionByName(fallback)


def simulated_days_table(days: DataFrame, keys: list[str]) -> DataFrame:
    return days.select(
        *keys,
        "day",
        "bin",
        flag("is_scarcity"),
        flag("in_distribution"),
        "reservoir_pct",
        "pct_contract",
        "pct_spot",
        "pct_unregulated",
        "pct_auction",
        "follower_margin",
        "leaders_margin",
        "segment_margin",
    )


SUMMARY_METRICS = [
    "days",
    "demand_per_day",
    "follower_median",
    "follower_mean",
    "leaders_median",
    "segment_median",
    "pct_beats_leaders",
    "pct_beats_segment",
    "guarantee_median",
    "guarantee_max",
]


def summary_table(summary: DataFrame, keys: list[str]) -> DataFrame:
    return metric_rows(summary, keys, SUMMARY_METRICS)


DISTRIBUTION_METRICS = [
    "n",
    "median",
    "mean",
    "p5",
    "p95",
    "pct_loss_days",
    "worst",
    "best",
    "drawdown",
]


def distribution_table(dist: DataFrame, keys: list[str]) -> DataFrame:
    """Metric rows, one column per series (``segment`` alone would clash with the key)."""
    long = metric_rows(dist, keys + ["series"], DISTRIBUTION_METRICS)
    named = long.withColumn("series", F.concat("series", F.lit("_margin")))
    return (
        named.groupBy(*keys, "metric")
        .pivot("series", ["follower_margin", "leaders_margin", "segment_margin"])
        .agg(F.first("value"))
    )


def stress_table(stress: DataFrame, keys: list[str]) -> DataFrame:
    return stress.select(
        *keys, "scenario", "spot", "contract", "spread", "bin", "margin", "guarantee"
    )


def regime_table(by_bin: DataFrame, total: DataFrame, by_year: DataFrame) -> DataFrame:
    """Four kinds of rows: bin frequency, scarcity total, spread levels, years."""
    parts = [
        by_bin.select(
            F.lit("bin_frequency").alias("kind"), F.col("bin").alias("label"), "n_days", "pct"
        ),
        total.select(
            F.lit("scarcity_days").alias("kind"),
            "n_days",
            F.col("pct_scarcity").alias("pct"),
            "n_scarcity",
        ),
        total.unpivot([], ["spread_p50", "spread_p95", "spread_p99", "spread_max"], "kind", "spread"),
        by_year.select(
            F.lit("year").alias("kind"),
            F.col("year").cast("string").alias("label"),
            "n_days",
            F.col("pct_scarcity").alias("pct"),
            "n_scarcity",
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(
        "kind", "label", "n_scarcity", "n_days", "pct", "spread"
    )


VALIDITY_METRICS = [
    "p_value",
    "boot_best",
    "boot_null_p50",
    "boot_null_p95",
    "boot_units",
    "persistence_pct",
    "persistence_percentile",
    "replication_in",
    "replication_out",
    "replication_ratio",
    "sharpe",
    "skew",
    "kurtosis",
    "n_trials",
    "dsr",
    "dsr_significant",
    "n_effective",
]


def validity_table(assessment: DataFrame, keys: list[str]) -> DataFrame:
    return metric_rows(assessment, keys, VALIDITY_METRICS, keep_nulls=False)


def codes(column: str = "codes") -> Column:
    return F.concat_ws(",", F.col(column)).alias(column)


def sweep_table(sweep: DataFrame, keys: list[str]) -> DataFrame:
    return sweep.select(
        *keys,
        "n_leaders",
        "n_effective",
        codes(),
        "relative_top",
        "follower_median",
        "p_value",
        "replication_ratio",
        "drawdown",
        flag("kill_switch"),
        flag("valid"),
    )


_WINDOW = ["study_start", "study_end", "eval_start", "eval_end"]


def scan_table(scan: DataFrame) -> DataFrame:
    return scan.select(
        *_WINDOW,
        "segment",
        "archetype",
        "n_leaders",
        "n_effective",
        codes(),
        "relative_top",
        "follower_median",
        "p_value",
        "replication_ratio",
        "dsr",
        "pct_beats_segment",
        flag("kill_switch"),
        "drawdown",
        "ev_history",
        "ev_dry_year",
        flag("over_capacity"),
        "capacity_pct",
        "mae_mean",
        flag("candidate"),
        flag("valid_cheap"),
    )


def _judged(scan: DataFrame) -> list:
    return [
        *_WINDOW,
        "segment",
        "archetype",
        "n_leaders",
        "n_effective",
        codes(),
        "p_value",
        "replication_ratio",
        "dsr",
        "persistence",
        "pct_beats_segment",
        flag("kill_switch"),
        "ev_history",
        flag("over_capacity"),
        "mae_mean",
    ]


def archetype_scan_table(scan: DataFrame) -> DataFrame:
    return scan.select(*_judged(scan), flag("candidate"), flag("valid_cheap"))


def confirmed_table(confirmed: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Confirmed rows of either mode with their gates spelled out by name."""
    from peerglass.operators.scorecard import gate_detail

    return confirmed.select(
        *keys, *_judged(confirmed), "n1_full", "n2", flag("valid_final"), gate_detail().alias("gate_detail")
    )


def walk_forward_table(steps: DataFrame) -> DataFrame:
    return steps.select(
        *_WINDOW,
        "n_leaders",
        "follower_median",
        "leaders_median",
        "segment_median",
        "replication_ratio",
        "dsr",
        "kill_switch",
    )


def weekly_table(series: DataFrame, keys: list[str]) -> DataFrame:
    return series.select(
        *keys,
        "day",
        "spread",
        "bin",
        flag("is_scarcity"),
        flag("in_distribution"),
        "reservoir_pct",
        "follower_margin",
        "leaders_margin",
        "segment_margin",
        "drawdown",
    )
