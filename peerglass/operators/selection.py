"""Leaders of each (segment, archetype), and what depends on their choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerglass.functions.numeric import dec_round, name_key, presence_threshold, upper_median
from peerglass.functions.regime import spread_bin
from peerglass.operators import COMBO, WINDOW
from peerglass.operators.orderstats import order_stats
from peerglass.params import Selection, SpreadBins


def present_enough(stats: DataFrame, days: DataFrame, min_presence_pct: float) -> DataFrame:
    """Entities present on enough of the window's days."""
    if not min_presence_pct:
        return stats
    need = presence_threshold(F.col("n_study_days"), min_presence_pct)
    return stats.join(days, WINDOW).where(F.col("n_days") >= need).drop("n_study_days")


def _selection_order(relative: bool) -> list[Column]:
    score = "relative_median" if relative else "median_margin"
    return [F.desc(score), F.desc("n_days"), F.asc("agent_id")]


def leaders(stats: DataFrame, days: DataFrame, sel: Selection) -> DataFrame:
    """Top entities of every combination at once.

    The rank is filtered right away, so that each map task forwards only its own
    top rows of a combination, however many entities a combination has.
    """
    order = Window.partitionBy(*COMBO).orderBy(*_selection_order(sel.relative))
    picked = (
        present_enough(stats, days, sel.min_presence_pct)
        .withColumn("pos", F.row_number().over(order))
        .where(F.col("pos") <= sel.top)
    )
    if sel.relative:
        return picked
    zero = F.lit(0.0)
    return picked.withColumn("relative_median", zero).withColumn("pct_above_segment", zero)


def combo_ranking(leaders_rel: DataFrame) -> DataFrame:
    """Level of each combination's leaders; leaders are at most ``top`` rows."""
    return leaders_rel.groupBy(*COMBO).agg(
        F.count(F.lit(1)).alias("n_leaders"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "agent_id"))), lambda s: s["agent_id"]
        ).alias("codes"),
        F.max("relative_median").alias("best_relative"),
        upper_median("relative_median").alias("relative_top"),
        upper_median("median_margin").alias("absolute_top"),
    )


def best_alternative(leaders_rel: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """For every target combination the best other one of its window.

    The two best combinations of a window are enough to answer for all targets.
    """
    ranking = combo_ranking(leaders_rel)
    order = Window.partitionBy(*WINDOW).orderBy(
        F.desc("relative_top"), F.desc("n_leaders"), "segment", "archetype"
    )
    top_two = ranking.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    best = top_two.select(
        *WINDOW,
        "_r",
        *[
            F.col(c).alias(f"alt_{c}")
            for c in (
                "segment",
                "archetype",
                "codes",
                "n_leaders",
                "best_relative",
                "relative_top",
                "absolute_top",
            )
        ],
    )
    wanted = (targets if targets is not None else ranking).select(*COMBO)
    itself = (F.col("segment") == F.col("alt_segment")) & (
        name_key(F.col("archetype")) == name_key(F.col("alt_archetype"))
    )
    first = Window.partitionBy(*COMBO).orderBy("_r")
    return (
        wanted.join(best, WINDOW)
        .where(~itself)
        .withColumn("_f", F.row_number().over(first))
        .where("_f = 1")
        .drop("_f", "_r")
    )


def selection_sensitivity(
    stats: DataFrame,
    days: DataFrame,
    tops: tuple[int, ...] = (3, 5, 7),
    presences: tuple[float, ...] = (10.0, 20.0, 30.0),
) -> DataFrame:
    """Entities chosen under each (top, presence), always by the absolute median.

    One rank per presence threshold serves all tops.
    """
    settings = F.array(*[F.lit(float(p)) for p in sorted(set(presences))])
    widest = max(tops)
    need = F.greatest(
        F.lit(1).cast("long"),
        F.bround(F.col("n_study_days") * F.col("min_presence_pct") / 100.0, 0).cast("long"),
    )
    order = Window.partitionBy(*COMBO, "min_presence_pct").orderBy(*_selection_order(False))
    ranked = (
        stats.join(days, WINDOW)
        .withColumn("min_presence_pct", F.explode(settings))
        .where((F.col("min_presence_pct") == 0) | (F.col("n_days") >= need))
        .withColumn("pos", F.row_number().over(order))
        .where(F.col("pos") <= widest)
    )
    wanted = F.explode(F.array(*[F.lit(int(t)) for t in sorted(set(tops))])).alias("top")
    return (
        ranked.select(*COMBO, "min_presence_pct", "pos", "agent_id", wanted)
        .where("pos <= top")
        .groupBy(*COMBO, "top", "min_presence_pct")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("pos", "agent_id"))), lambda s: s["agent_id"]
            ).alias("codes")
        )
    )


def leader_weights(chosen: DataFrame, eta: float = 1.0) -> DataFrame:
    """Exponential weights of the leaders of each combination, summing to one.

    The reference level of the score cancels in the normalisation.
    """
    w = Window.partitionBy(*COMBO)
    spread = F.greatest(
        F.max("median_margin").over(w) - F.min("median_margin").over(w), F.lit(1.0)
    )
    base = F.max("median_margin").over(w)
    score = (F.col("median_margin") - base) / spread + F.lit(0.5) * (
        F.col("n_days") / F.max("n_days").over(w)
    )
    return (
        chosen.withColumn("_e", F.exp(F.lit(float(eta)) * score))
        .withColumn("weight", F.col("_e") / F.sum("_e").over(w))
        .drop("_e")
    )


def level_counts(labelled_rel: DataFrame, bins: SpreadBins, value: str = "rel") -> DataFrame:
    """How often each value occurs per cluster and spread bin of a segment.

    Values have two decimals, so the table stays short however many entity-days there
    are; winners, units and pool of the archetypes are all read from it.
    """
    return labelled_rel.groupBy(
        *WINDOW,
        "segment",
        "cluster_id",
        "archetype",
        spread_bin(F.col("spot") - F.col("contract"), bins).alias("bin"),
        value,
    ).agg(F.count(F.lit(1)).alias("n"))


_BIN_CLUSTER = WINDOW + ["segment", "bin", "cluster_id"]


def _each_bin() -> Column:
    """The own bin, and the star that stands for all of them."""
    return F.explode(F.array(F.col("bin"), F.lit("*"))).alias("bin")


def bin_medians(counts: DataFrame, clipped: bool = False) -> DataFrame:
    """Level of every cluster in each spread bin, and over all of them, from ``level_counts``.

    ``clipped`` margins make for a bounded number of distinct values of a cluster.
    """
    rows = counts.select(*WINDOW, "segment", "cluster_id", "archetype", "rel", "n", _each_bin())
    names = rows.groupBy(*_BIN_CLUSTER).agg(F.max("archetype").alias("archetype"))
    medians = order_stats(
        rows, _BIN_CLUSTER, "rel", {"relative_median": "um"}, coarse=not clipped, weight="n"
    )
    return medians.join(names, _BIN_CLUSTER)


def winners_by_bin(
    labelled: DataFrame, bins: SpreadBins, medians: DataFrame | None = None
) -> DataFrame:
    """Winning cluster per spread bin of each segment, and the overall winner.

    The overall winner has a null bin.  Ties go to the cluster seen first in
    (entity, day) order, which is looked up for tied clusters only.  With
    ``medians`` (``bin_medians``) the panel serves for ties alone.
    """
    medians = bin_medians(level_counts(labelled, bins)) if medians is None else medians
    group = Window.partitionBy(*WINDOW, "segment", "bin")
    best = (
        medians.withColumn("_r", F.rank().over(group.orderBy(F.desc("relative_median"))))
        .where("_r = 1")
        .withColumn("_tied", F.count(F.lit(1)).over(group))
    )
    seen = labelled.select(
        *WINDOW,
        "segment",
        "cluster_id",
        F.concat_ws("|", F.col("agent_id"), F.col("day").cast("string")).alias("_key"),
        spread_bin(F.col("spot") - F.col("contract"), bins).alias("bin"),
    ).select(*WINDOW, "segment", "cluster_id", "_key", _each_bin())
    first_seen = (
        seen.join(best.where("_tied > 1").select(*_BIN_CLUSTER), _BIN_CLUSTER, "left_semi")
        .groupBy(*_BIN_CLUSTER)
        .agg(F.min("_key").alias("_key"))
    )
    return (
        best.join(first_seen, _BIN_CLUSTER, "left")
        .withColumn("_r", F.row_number().over(group.orderBy("_key")))
        .where("_r = 1")
        .select(
            *WINDOW,
            "segment",
            F.when(F.col("bin") != "*", F.col("bin")).alias("bin"),
            "cluster_id",
            "archetype",
            "relative_median",
        )
    )


def realised_profile(panel: DataFrame, chosen: DataFrame, keys: list[str] = COMBO) -> DataFrame:
    """Upper median shares of a combination's leaders over a window."""
    rows = panel.drop("segment", "archetype", "name").join(
        chosen.select(*keys, "agent_id"), WINDOW + ["agent_id"]
    )
    shares = ("pct_contract", "pct_spot", "pct_unregulated", "pct_auction")
    return rows.groupBy(*keys).agg(
        *[dec_round(upper_median(s), 1).alias(s) for s in shares],
        F.count(F.lit(1)).alias("n_days"),
    )
