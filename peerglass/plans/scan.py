"""Scans: every combination of every window in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerglass.operators import COMBO, WINDOW
from peerglass.operators import panel as PN
from peerglass.operators import policy as PO
from peerglass.operators import scorecard as SC
from peerglass.operators import selection as SE
from peerglass.operators import validity as VA
from peerglass.params import Settings
from peerglass.plans import replay as RP
from peerglass.plans import study as ST
from peerglass.plans.replay import SEGMENT
from peerglass.plans.study import Daily, Study
from peerglass.sources.proxies import Market
from peerglass.sources.tables import durable


def scan_study(
    d: Daily, market: Market, settings: Settings, windows: DataFrame, labels: str = "rule"
) -> tuple[Study, DataFrame]:
    """Labelled studies and eval panels of all windows, written once for both scans."""
    s = ST.study(d, market, settings, ST.spans_of(windows, "study"), labels, store=True)
    return s, ST.evaluation_panel(d, ST.spans_of(windows, "eval"), s.segmented, store=True)


def leader_bootstrap(s: Study, stats: DataFrame, settings: Settings, n_boot: int) -> DataFrame:
    sel = settings.selection
    eligible = SE.present_enough(stats, s.days, sel.min_presence_pct)
    return VA.bootstrap_best_median(
        VA.bootstrap_units(eligible, sel.relative),
        VA.bootstrap_pool(s.labelled, eligible),
        value=sel.value,
        n_boot=n_boot,
        seed=sel.seed,
        draws=sel.draws,
    )


def effective_leaders(chosen: DataFrame, panel: DataFrame, settings: Settings) -> DataFrame:
    pairs = VA.pair_correlation(chosen, panel)
    return VA.duplicate_groups(chosen, pairs, settings.selection.duplicate_corr)


def scan_leaders(
    s: Study,
    evaluation: DataFrame,
    settings: Settings,
    windows: DataFrame,
    regime: DataFrame,
    levels: DataFrame | None = None,
    n_boot: int | None = None,
) -> DataFrame:
    """One row per window, segment and archetype, judged by its top entities."""
    n_boot = n_boot or settings.scan.boot_coarse
    stats = durable(PN.entity_stats(s.labelled, settings.selection.value), "stats")
    chosen = durable(
        SE.leaders(stats.drop(f"{settings.selection.value}s"), s.days, settings.selection), "leaders"
    )
    led = durable(RP.leader_panel(s, chosen), "led")
    rules = durable(PO.fit_median(PO.leader_days(led, chosen), settings.bins), "rules")
    r = RP.replay(
        s, evaluation, rules, settings, chosen=chosen, keys=COMBO, levels=levels, store=True, led=led
    )
    boot = durable(leader_bootstrap(s, stats, settings, n_boot), "boot")
    trials = boot.select(*COMBO, F.col("n_units").alias("n_trials"))
    judged = RP.judge(r, s, settings, regime, trials, COMBO)
    effective = effective_leaders(chosen, led, settings).select(*COMBO, "n_effective")
    return (
        judged.join(RP.combo_codes(chosen), COMBO)
        .join(boot.drop("n_units", "n_pool", "n_boot"), COMBO, "left")
        .join(effective, COMBO, "left")
        .join(windows.drop("step"), WINDOW)
        .withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))
        .withColumn("mode", F.lit("leaders"))
        .withColumn("persistence", F.lit(None).cast("double"))
    )


@dataclass(frozen=True)
class ArchetypeScan:
    """What a scan by archetypes rests on, whatever its number of replicates."""

    winners: DataFrame
    units: DataFrame
    pool: DataFrame
    replay: RP.Replay


def archetype_scan(
    s: Study, evaluation: DataFrame, settings: Settings, levels: DataFrame | None = None
) -> ArchetypeScan:
    """Winners, replayed policies and bootstrap units of every window and segment.

    The panel is passed over once for the counts of its values; ties alone ask for
    its entities again.
    """
    sel = settings.selection
    counts = durable(SE.level_counts(s.labelled, settings.bins), "counts")
    clipped = bool(settings.model.margin_clip)
    medians = durable(SE.bin_medians(counts, clipped), "medians")
    winners = durable(SE.winners_by_bin(s.rows, settings.bins, medians), "winners")
    rules = PO.fit_archetype(s.rows, winners, settings.bins)
    r = RP.replay(
        s, evaluation, rules, settings, chosen=None, keys=SEGMENT, levels=levels, store=True
    )
    value = sel.value
    if value != "rel":
        counts = durable(SE.level_counts(s.rows, settings.bins, value), "counts")
    units_levels = durable(VA.archetype_levels(counts, value, "n", clipped), "levels")
    units = durable(
        SE.present_enough(
            VA.archetype_units(s.rows, value, units_levels).withColumnRenamed("draws", "n_days"),
            s.days,
            sel.min_presence_pct,
        ).withColumnRenamed("n_days", "draws"),
        "units",
    )
    pool = counts.join(
        units.select(*SEGMENT, F.col("unit").alias("archetype")), SEGMENT + ["archetype"], "left_semi"
    )
    return ArchetypeScan(winners, units, pool, r)


def scan_archetypes(
    s: Study,
    evaluation: DataFrame,
    settings: Settings,
    windows: DataFrame,
    regime: DataFrame,
    levels: DataFrame | None = None,
    n_boot: int | None = None,
    found: ArchetypeScan | None = None,
) -> DataFrame:
    """One row per window and segment, judged by the winning archetype of each bin.

    ``found`` may give what ``archetype_scan`` found for these windows, or more.
    """
    n_boot = n_boot or settings.scan.boot_coarse
    sel = settings.selection
    found = found or archetype_scan(s, evaluation, settings, levels)
    winners, r = found.winners, found.replay
    units = found.units.join(windows.select(*WINDOW), WINDOW, "left_semi")
    boot = durable(
        VA.bootstrap_best_median(
            units,
            found.pool,
            keys=SEGMENT,
            value=sel.value,
            n_boot=n_boot,
            seed=sel.seed,
            draws=sel.draws,
            weight="n",
        ),
        "boot",
    )
    trials = boot.select(*SEGMENT, F.col("n_units").alias("n_trials"))
    judged = RP.judge(r, s, settings, regime, trials, SEGMENT)
    by_bin = winners.where(F.col("bin").isNotNull()).groupBy(*SEGMENT).agg(
        F.array_sort(F.collect_list("archetype")).alias("codes"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("bin", "archetype")))).alias("winners"),
    )
    overall = winners.where(F.col("bin").isNull()).select(
        *SEGMENT, F.col("archetype").alias("overall_winner")
    )
    return (
        judged.join(boot.drop("n_pool", "n_boot"), SEGMENT, "left")
        .join(VA.best_archetype(units), SEGMENT, "left")
        .join(by_bin, SEGMENT, "left")
        .join(overall, SEGMENT, "left")
        .join(windows.drop("step"), WINDOW)
        .withColumn("archetype", F.coalesce("archetype", F.lit("archetype")))
        .withColumn("n_leaders", F.coalesce("n_units", F.lit(0).cast("long")))
        .withColumn("n_effective", F.col("n_leaders"))
        .withColumn("relative_top", F.lit(0.0))
        .withColumn("p_value", F.coalesce("p_value", F.lit(1.0)))
        .withColumn("mode", F.lit("archetype"))
        .withColumn("persistence", F.lit(None).cast("double"))
    )


def with_candidates(rows: DataFrame, settings: Settings) -> DataFrame:
    return SC.evaluate_gates(rows, settings.gates).withColumn("candidate", F.col("valid_cheap"))


def sweep(rows: DataFrame, settings: Settings) -> DataFrame:
    """Combinations of a scan: the valid ones first, then by their leaders' lead."""
    g = settings.gates
    valid = (
        (F.col("p_value") <= g.alpha)
        & F.coalesce(F.col("replication_ratio") >= g.min_replication, F.lit(False))
        & (F.coalesce(F.col("n_effective"), F.lit(0)) >= g.min_n_effective)
    )
    order = Window.partitionBy(*WINDOW).orderBy(
        F.desc("valid"), F.desc("relative_top"), "segment", "archetype"
    )
    return (
        rows.withColumn("valid", valid)
        .withColumn("pos", F.row_number().over(order))
        .where(F.col("pos") <= settings.scan.sweep_limit)
    )
