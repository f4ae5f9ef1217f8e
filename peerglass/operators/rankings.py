"""Daily rankings of archetypes and their balance over the period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerglass.functions.numeric import dec_round, presence_threshold, upper_median
from peerglass.operators import WINDOW
from peerglass.operators.orderstats import order_stats


def daily_ranking(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Median, mean, size and rank of every cluster on each day.

    ``by`` adds grouping keys such as the segment.  Ranks follow the rounded
    median, then the rounded mean, then the cluster id.
    """
    keys = WINDOW + list(by or []) + ["day"]
    stats = order_stats(
        labelled, keys + ["cluster_id"], "margin", {"median": "um"}, mean="mean", count="n"
    ).withColumn("mean", dec_round(F.col("mean"), 2))
    order = Window.partitionBy(*keys).orderBy(F.desc("median"), F.desc("mean"), "cluster_id")
    return stats.withColumn("rank", F.row_number().over(order))


def period_balance(ranking: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per cluster: level, first places, top-3 share, mean rank and trend over days."""
    keys = WINDOW + list(by or []) + ["cluster_id"]
    w = Window.partitionBy(*keys)
    half = F.floor(F.col("_n") / 2)
    rows = ranking.withColumn("_i", F.row_number().over(w.orderBy("day"))).withColumn(
        "_n", F.count(F.lit(1)).over(w)
    )
    money = F.col("median").cast("decimal(18,2)")
    n = F.count(F.lit(1))

    def mean_where(cond):
        x = F.when(cond, money)
        return F.try_divide(F.sum(x).cast("double"), F.count(x))

    first, second = mean_where(F.col("_i") <= half), mean_where(F.col("_i") > half)
    return rows.groupBy(*keys).agg(
        n.alias("days"),
        upper_median("median").alias("median_margin"),
        dec_round(F.sum(money).cast("double") / n, 2).alias("mean_margin"),
        F.count_if(F.col("rank") == 1).alias("days_first"),
        dec_round(F.count_if(F.col("rank") <= 3) * 100.0 / n, 1).alias("pct_top3"),
        dec_round(F.sum("rank") / n, 2).alias("mean_rank"),
        dec_round(F.coalesce(second - first, F.lit(0.0)), 2).alias("trend"),
    )


def mark_outliers(balance: DataFrame, study_days: DataFrame, min_days_pct: float) -> DataFrame:
    """Flag clusters that are present on too few of the window's days."""
    if not min_days_pct:
        return balance.withColumn("is_outlier", F.lit(False))
    need = presence_threshold(F.col("n_study_days"), min_days_pct)
    return (
        balance.join(study_days, WINDOW)
        .withColumn("is_outlier", F.col("days") < need)
        .drop("n_study_days")
    )


def archetype_segment_matrix(ranking_by_segment: DataFrame) -> DataFrame:
    """Cluster x segment: level of the daily medians and the days it was present."""
    money = F.col("median").cast("decimal(18,2)")
    n = F.count(F.lit(1))
    return ranking_by_segment.groupBy(*WINDOW, "cluster_id", "segment").agg(
        upper_median("median").alias("median"),
        dec_round(F.sum(money).cast("double") / n, 2).alias("mean"),
        n.alias("days"),
    )


def rank_histogram(ranking: DataFrame, k: int) -> DataFrame:
    """Days at each rank 1..k per cluster, zeros included."""
    return ranking.groupBy(*WINDOW, "cluster_id").agg(
        *[F.count_if(F.col("rank") == r).alias(f"rank_{r}") for r in range(1, k + 1)]
    )
