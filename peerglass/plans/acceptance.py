"""Acceptance grid, power study and weekly recommendation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerglass.operators import COMBO, WINDOW
from peerglass.operators import panel as PN
from peerglass.operators import scorecard as SC
from peerglass.operators import selection as SE
from peerglass.operators import series as SR
from peerglass.operators import validity as VA
from peerglass.params import Settings
from peerglass.plans import assess as AS
from peerglass.plans import scan as SN
from peerglass.plans import study as ST
from peerglass.plans.replay import SEGMENT
from peerglass.plans.study import Daily, Study
from peerglass.sources.proxies import Market
from peerglass.sources.sinks import metric_rows
from peerglass.sources.tables import durable

_KEPT = [
    "mode",
    "window_id",
    "study_start",
    "study_end",
    "eval_start",
    "eval_end",
    "segment",
    "archetype",
    "n_leaders",
    "n_effective",
    "codes",
    "relative_top",
    "follower_median",
    "p_value",
    "replication_ratio",
    "dsr",
    "persistence",
    "pct_beats_segment",
    "kill_switch",
    "drawdown",
    "ev_history",
    "ev_dry_year",
    "over_capacity",
    "capacity_pct",
    "mae_mean",
]


def _score(rows: DataFrame) -> DataFrame:
    return rows.select(*_KEPT)


def coarse_scan(
    d: Daily,
    market: Market,
    settings: Settings,
    windows: DataFrame,
    regime: DataFrame,
    levels: DataFrame | None = None,
    labels: str = "rule",
) -> DataFrame:
    """Both modes over the whole grid with few replicates; studies are shared."""
    return _coarse(d, market, settings, windows, regime, levels, labels)[0]


def _coarse(
    d, market, settings: Settings, windows: DataFrame, regime, levels, labels
) -> tuple[DataFrame, Study, SN.ArchetypeScan]:
    s, ev = SN.scan_study(d, market, settings, windows, labels)
    found = SN.archetype_scan(s, ev, settings, levels)
    both = _score(SN.scan_leaders(s, ev, settings, windows, regime, levels)).unionByName(
        _score(SN.scan_archetypes(s, ev, settings, windows, regime, levels, found=found))
    )
    return durable(SN.with_candidates(both, settings), "scan"), s, found


def _confirm_leaders(
    d, market, settings: Settings, wanted: DataFrame, windows: DataFrame, regime, levels, labels, studies
) -> DataFrame:
    mine = windows.join(wanted.select(*WINDOW).distinct(), WINDOW, "left_semi")
    fine = replace(settings, policy=replace(settings.policy, weighted=True))
    a = AS.assess(
        d, market, fine, durable(mine, "windows"), regime, wanted, levels, labels, studies=studies
    )
    return _score(a.summary)


def _confirm_archetypes(
    s: Study, found: SN.ArchetypeScan, settings: Settings, wanted: DataFrame, windows: DataFrame, regime, studies
) -> DataFrame:
    """The coarse scan's winners and policies with more replicates, and their holdout."""
    mine = windows.join(wanted.select(*WINDOW).distinct(), WINDOW, "left_semi")
    rows = SN.scan_archetypes(
        s, None, settings, durable(mine, "windows"), regime, n_boot=settings.scan.boot_fine, found=found
    ).join(wanted, SEGMENT, "left_semi")
    held = archetype_persistence(*studies, settings)
    return _score(rows.drop("persistence").join(held, SEGMENT, "left"))


def archetype_holdout(
    d: Daily, market: Market, settings: Settings, windows: DataFrame, labels: str = "rule"
) -> DataFrame:
    """Does the overall winner of the study without its last days hold up on them?"""
    return archetype_persistence(*_select_and_holdout(d, market, settings, windows, labels), settings)


def _select_and_holdout(d, market, settings: Settings, windows: DataFrame, labels) -> tuple[Study, Study]:
    days = settings.scan.holdout_days
    select, holdout = (
        ST.study(d, market, settings, ST.spans_of(windows, phase, days), labels, store=True)
        for phase in ("select", "holdout")
    )
    return select, holdout


def archetype_persistence(s: Study, h: Study, settings: Settings) -> DataFrame:
    counts = SE.level_counts(s.labelled, settings.bins)
    medians = durable(SE.bin_medians(counts, bool(settings.model.margin_clip)), "medians")
    winners = SE.winners_by_bin(s.rows, settings.bins, medians).where(F.col("bin").isNull())
    held = VA.archetype_persistence(
        winners, h.labelled, h.days, settings.selection.min_presence_pct
    )
    return held.select(*SEGMENT, F.col("persistence_pct").alias("persistence"))


def acceptance(
    d: Daily,
    market: Market,
    settings: Settings,
    windows: DataFrame,
    regime: DataFrame,
    levels: DataFrame | None = None,
    labels: str = "rule",
) -> dict[str, DataFrame]:
    """Coarse search over the grid, fine confirmation of the best, final gates.

    Both modes are confirmed on the same studies of the picked windows; what a scan by
    archetypes found does not depend on its replicates and is not found anew.
    """
    scan, s, found = _coarse(d, market, settings, windows, regime, levels, labels)
    picked = durable(
        SC.to_confirm(scan, settings.scan.max_confirm, settings.scan.near_confirm), "picked"
    )
    mine = durable(windows.join(picked.select(*WINDOW), WINDOW, "left_semi"), "windows")
    studies = _select_and_holdout(d, market, settings, mine, labels)
    led = picked.where(F.col("mode") == "leaders").select(*COMBO)
    won = picked.where(F.col("mode") == "archetype").select(*SEGMENT).distinct()
    confirmed = _confirm_leaders(
        d, market, settings, led, mine, regime, levels, labels, studies
    ).unionByName(_confirm_archetypes(s, found, settings, won, mine, regime, studies))
    final = SC.evaluate_gates(confirmed, settings.gates).withColumn(
        "candidate", F.col("valid_cheap")
    )
    return {"scan": scan, "picked": picked, "confirmed": durable(final, "confirmed")}


def confirmed_order(confirmed: DataFrame) -> DataFrame:
    return confirmed.orderBy(
        "mode", F.desc("valid_final"), "p_value", "window_id", "segment", "archetype"
    )


def power_study(
    d: Daily,
    market: Market,
    settings: Settings,
    cases: DataFrame,
    labels: str = "rule",
    n_boot: int = 2000,
    n_boot_cross: int = 1000,
    long_days: int = 365,
) -> DataFrame:
    """Do the p-values hold with more replicates and with a pool across segments?

    ``cases`` has one row per (window_id, start_day, end_day, segment, archetype);
    those without an entity leave. Cases of ``long_days`` or more get fewer
    replicates and no pool across segments.
    """
    spans = cases.select(*WINDOW, F.lit("study").alias("phase"), "start_day", "end_day").distinct()
    s = ST.study(d, market, settings, spans, labels, store=True)
    is_long = F.datediff("end_day", "start_day") + 1 >= long_days
    stats = durable(PN.entity_stats(s.labelled, settings.selection.value), "stats")

    def boot(some: DataFrame, b: int) -> DataFrame:
        found = SN.leader_bootstrap(s, AS._targets(stats, some.select(*COMBO)), settings, b)
        return found.select(*COMBO, "n_units", F.col("p_value").alias("p_fine"))

    short = cases.where(~is_long)
    fine = boot(short, n_boot).unionByName(boot(cases.where(is_long), n_boot_cross))
    cross = VA.bootstrap_best_median(
        VA.bootstrap_units(AS._targets(stats, short.select(*COMBO)), settings.selection.relative),
        s.labelled,
        pool_keys=WINDOW + ["archetype"],
        value=settings.selection.value,
        n_boot=n_boot_cross,
        seed=settings.selection.seed,
        draws=settings.selection.draws,
    )
    return cases.join(fine, COMBO).join(
        cross.select(*COMBO, F.col("p_value").alias("p_cross")), COMBO, "left"
    )


_KPIS = ["follower_median", "pct_beats_segment", "dsr", "p_value", "n_effective", "drawdown", "ev_history"]


@dataclass(frozen=True)
class Weekly(Mapping):
    """Recommendation tables of one window, each made when it is first asked for."""

    daily: Daily
    market: Market
    settings: Settings
    windows: DataFrame
    regime_total: DataFrame
    segment: str
    archetype: str
    levels: DataFrame
    labels: str = "rule"

    TABLES = (
        "verdict",
        "gates",
        "kpis",
        "series",
        "profile",
        "realised",
        "regime",
        "leaders",
        "archetype_winners",
        "alternative",
    )

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.TABLES:
            raise KeyError(name)
        return getattr(self, name)

    def __iter__(self):
        return iter(self.TABLES)

    def __len__(self) -> int:
        return len(self.TABLES)

    @cached_property
    def assessment(self) -> AS.Assessment:
        targets = self.windows.select(
            *WINDOW, F.lit(self.segment).alias("segment"), F.lit(self.archetype).alias("archetype")
        )
        fine = replace(self.settings, policy=replace(self.settings.policy, weighted=True))
        return AS.assess(
            self.daily, self.market, fine, self.windows, self.regime_total, targets, self.levels, self.labels
        )

    @cached_property
    def control(self) -> DataFrame:
        """The asked segment's row by archetypes if it has one, else the best row of the window."""
        s, ev = SN.scan_study(self.daily, self.market, self.settings, self.windows, self.labels)
        rows = SN.scan_archetypes(s, ev, self.settings, self.windows, self.regime_total, self.levels)
        order = [
            F.when(F.col("segment") == self.segment, 0).otherwise(1),
            F.asc("p_value"),
            F.desc("follower_median"),
            F.asc("segment"),
        ]
        return (
            durable(rows, "control")
            .withColumn("_r", F.row_number().over(Window.partitionBy(*WINDOW).orderBy(*order)))
            .where("_r = 1")
        )

    @cached_property
    def gates(self) -> DataFrame:
        both = _score(self.assessment.summary).unionByName(_score(self.control))
        return durable(SC.evaluate_gates(both, self.settings.gates), "gates")

    @property
    def verdict(self) -> DataFrame:
        """Operate only when one mode passes every gate."""
        return self.gates.groupBy(*WINDOW).agg(
            F.bool_or("valid_final").alias("operate"),
            F.coalesce(F.bool_or(F.when(F.col("mode") == "leaders", F.col("valid_final"))), F.lit(False)).alias("by_leaders"),
            F.coalesce(F.bool_or(F.when(F.col("mode") == "archetype", F.col("valid_final"))), F.lit(False)).alias("by_archetype"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(SC.failed_gates())))).alias("failed"),
        ).withColumn("failed", F.when(~F.col("operate"), F.col("failed")))

    @property
    def _context(self) -> DataFrame:
        keys = WINDOW + ["phase"]
        market = PN.market_days(self.assessment.evaluation, keys)
        return SR.day_context(market, self.levels, self.settings.bins, keys)

    @property
    def regime(self) -> DataFrame:
        return SR.current_regime(self._context, WINDOW)

    @property
    def _sims(self) -> DataFrame:
        return self.assessment.replay.days.where(F.col("phase") == "eval")

    @property
    def series(self) -> DataFrame:
        curve = SR.with_drawdown(
            self._sims.select(*WINDOW, "day", "bin", "is_scarcity", "in_distribution", "follower_margin", "leaders_margin", "segment_margin"),
            WINDOW,
            "follower_margin",
        )
        return self._context.select(*WINDOW, "day", "spread", "reservoir_pct").join(
            curve, WINDOW + ["day"], "left"
        )

    @property
    def kpis(self) -> DataFrame:
        # Without leaders of the asked combination the control row speaks.
        by_mode = Window.partitionBy(*WINDOW).orderBy(F.desc("mode"))
        source = self.gates.withColumn("_m", F.row_number().over(by_mode)).where("_m = 1")
        metrics = metric_rows(source, WINDOW, _KPIS).unionByName(
            self.regime.select(
                *WINDOW, F.lit("reservoir_level").alias("metric"), F.col("last_level").alias("value")
            )
        )
        return SC.kpi_states(metrics, self.settings.policy.kill_drawdown)

    @property
    def profile(self) -> DataFrame:
        last = self._sims.groupBy(*WINDOW).agg(
            F.max_by(
                F.struct("in_distribution", "pct_contract", "pct_spot", "pct_unregulated", "pct_auction", "has_auction"),
                "day",
            ).alias("p")
        ).select(*WINDOW, (~F.col("p.in_distribution")).alias("is_defensive"), "p.*")
        return last.drop("in_distribution")

    @property
    def realised(self) -> DataFrame:
        return SE.realised_profile(self.assessment.evaluation, self.leaders)

    @property
    def leaders(self) -> DataFrame:
        return self.assessment.leaders

    @property
    def archetype_winners(self) -> DataFrame:
        return self.control.select(*SEGMENT, "winners")

    @cached_property
    def alternative(self) -> DataFrame:
        return AS.alternatives(self.assessment, self.settings, self.levels)


weekly = Weekly
