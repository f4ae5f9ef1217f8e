"""Full assessment of combinations: selection, validity, policy, backtest, decision."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerglass.functions.numeric import name_key
from peerglass.operators import COMBO, WINDOW
from peerglass.operators import backtest as BT
from peerglass.operators import panel as PN
from peerglass.operators import policy as PO
from peerglass.operators import segments as SG
from peerglass.operators import selection as SE
from peerglass.operators import series as SR
from peerglass.operators import validity as VA
from peerglass.params import Settings
from peerglass.plans import replay as RP
from peerglass.plans import scan as SN
from peerglass.plans import study as ST
from peerglass.plans.study import Daily, Study
from peerglass.sources.proxies import Market
from peerglass.sources.tables import durable


@dataclass(frozen=True)
class Assessment:
    """Tables of an assessment; every one is keyed by window and combination.

    A table is made, and stored, when it is first asked for, so that a caller of the
    replayed days does not wait for bootstrap, holdout or duplicates.
    """

    daily: Daily
    market: Market
    settings: Settings
    windows: DataFrame
    regime: DataFrame
    targets: DataFrame | None
    levels: DataFrame | None
    labels: str
    n_boot: int
    holdout_days: int
    demand_per_day: float | None
    studies: tuple[Study, Study] | None

    @property
    def phase(self) -> str:
        return "select" if self.holdout_days else "study"

    def _study(self, phase: str) -> Study:
        spans = ST.spans_of(self.windows, phase, self.holdout_days)
        return ST.study(self.daily, self.market, self.settings, spans, self.labels, store=True)

    @cached_property
    def study(self) -> Study:
        return self.studies[0] if self.studies else self._study(self.phase)

    @cached_property
    def holdout(self) -> Study:
        return self.studies[1] if self.studies else self._study("holdout")

    @cached_property
    def evaluation(self) -> DataFrame:
        spans = ST.spans_of(self.windows, "eval", self.holdout_days)
        return ST.evaluation_panel(self.daily, spans, self.study.segmented, store=True)

    @cached_property
    def listed(self) -> DataFrame:
        """Statistics of entities, with their values for the bootstrap."""
        stats = PN.entity_stats(self.study.labelled, self.settings.selection.value)
        return _targets(durable(stats, "stats"), self.targets)

    @property
    def stats(self) -> DataFrame:
        return self.listed.drop(f"{self.settings.selection.value}s")

    @cached_property
    def leaders(self) -> DataFrame:
        return durable(SE.leaders(self.stats, self.study.days, self.settings.selection), "leaders")

    @cached_property
    def led(self) -> DataFrame:
        return durable(RP.leader_panel(self.study, self.leaders), "led")

    @cached_property
    def rules(self) -> DataFrame:
        settings, training = self.settings, PO.leader_days(self.led, self.leaders)
        if settings.policy.weighted:
            weights = SE.leader_weights(self.leaders, settings.policy.weight_eta)
            rules = PO.fit_weighted(training, weights, settings.bins)
        else:
            rules = PO.fit_median(training, settings.bins)
        return durable(rules, "rules")

    @cached_property
    def replay(self) -> RP.Replay:
        demand = SG.reference_demand(self.study.rows)
        if self.demand_per_day:
            demand = demand.withColumn("demand_ref", F.lit(float(self.demand_per_day)))
        return RP.replay(
            self.study,
            self.evaluation,
            self.rules,
            self.settings,
            chosen=self.leaders,
            keys=COMBO,
            levels=self.levels,
            study_phase=self.phase,
            demand=demand,
            store=True,
            led=self.led,
        )

    @cached_property
    def boot(self) -> DataFrame:
        return durable(SN.leader_bootstrap(self.study, self.listed, self.settings, self.n_boot), "boot")

    @cached_property
    def duplicates(self) -> DataFrame:
        return durable(SN.effective_leaders(self.leaders, self.led, self.settings), "duplicates")

    @cached_property
    def summary(self) -> DataFrame:
        chosen, boot, settings = self.leaders, self.boot, self.settings
        trials = boot.select(*COMBO, F.col("n_units").alias("n_trials"))
        judged = RP.judge(self.replay, self.study, settings, self.regime, trials, COMBO, self.phase)
        summary = (
            judged.join(RP.combo_codes(chosen), COMBO)
            .join(boot.withColumnRenamed("n_units", "boot_units").drop("n_pool", "n_boot"), COMBO, "left")
            .join(self.duplicates.select(*COMBO, "n_effective"), COMBO, "left")
            .join(self.windows, WINDOW)
        )
        if self.holdout_days:
            h = self.holdout
            held = VA.holdout_persistence(
                chosen, h.labelled, h.days, settings.selection.min_presence_pct
            )
            summary = summary.join(held, COMBO, "left")
        else:
            summary = summary.withColumns(
                {
                    c: F.lit(None).cast("double")
                    for c in ("persistence_pct", "persistence_percentile")
                }
            )
        g = settings.gates
        held_ok = (
            F.coalesce(F.col("persistence_pct") >= g.min_persistence, F.lit(False))
            if self.holdout_days
            else F.lit(True)
        )
        # The verdict of a single assessment: a holdout that says nothing fails.
        valid = (
            F.coalesce(F.col("p_value") <= g.alpha, F.lit(False))
            & held_ok
            & F.coalesce(F.col("replication_ratio") >= g.min_replication, F.lit(False))
            & (F.coalesce(F.col("n_effective"), F.lit(0)) >= g.min_n_effective)
        )
        summary = (
            summary.withColumn("target_valid", valid)
            .withColumn("persistence", F.col("persistence_pct"))
            .withColumn("mode", F.lit("leaders"))
            .withColumn("relative_top", F.col("relative_mean"))
        )
        return durable(summary, "assessment")

    @property
    def distributions(self) -> DataFrame:
        return SR.distributions(self.replay.days.where(F.col("phase") == "eval"), COMBO)

    @property
    def stress(self) -> DataFrame:
        r, settings = self.replay, self.settings
        return BT.stress_scenarios(r.study_market, r.policies, settings.model, settings.bins)

    @property
    def sensitivity(self) -> DataFrame:
        sel = self.settings.selection
        return SE.selection_sensitivity(
            self.stats,
            self.study.days,
            (max(1, sel.top - 2), sel.top, sel.top + 2),
            (10.0, sel.min_presence_pct, 30.0),
        )


def _targets(df: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Rows of the wanted combinations, matched by trimmed lower-case name."""
    if targets is None:
        return df
    wanted = targets.select(*WINDOW, "segment", name_key(F.col("archetype")).alias("_a")).distinct()
    return (
        df.withColumn("_a", name_key(F.col("archetype")))
        .join(wanted, WINDOW + ["segment", "_a"], "left_semi")
        .drop("_a")
    )


def assess(
    d: Daily,
    market: Market,
    settings: Settings,
    windows: DataFrame,
    regime: DataFrame,
    targets: DataFrame | None = None,
    levels: DataFrame | None = None,
    labels: str = "rule",
    n_boot: int | None = None,
    holdout_days: int | None = None,
    demand_per_day: float | None = None,
    studies: tuple[Study, Study] | None = None,
) -> Assessment:
    """Assess all combinations, or the wanted ones, of all windows.

    The last days of each study are a holdout with its own segments and labels;
    the rest selects the leaders and trains the policy.  ``studies`` may give both,
    of these windows or more, if wanted combinations are named.
    """
    return Assessment(
        d,
        market,
        settings,
        windows,
        regime,
        targets,
        levels,
        labels,
        n_boot or settings.scan.boot_fine,
        settings.scan.holdout_days if holdout_days is None else holdout_days,
        demand_per_day,
        studies,
    )


TARGET = ["target_segment", "target_archetype"]


def alternatives(
    a: Assessment, settings: Settings, levels: DataFrame | None = None, phase: str = "select"
) -> DataFrame:
    """Best other combination of each target that is not valid, with its own backtest.

    The alternative keeps the target's demand and uses an unweighted policy.
    """
    sel = settings.selection
    top = max(3, min(sel.top, 5))
    stats = PN.entity_stats(a.study.labelled)
    chosen = durable(
        SE.leaders(stats, a.study.days, replace(sel, top=top, relative=True)), "alternatives"
    )
    failed = a.summary.where(~F.col("target_valid"))
    best = durable(SE.best_alternative(chosen, failed), "best")
    mapping = best.select(
        *WINDOW,
        F.col("segment").alias("target_segment"),
        F.col("archetype").alias("target_archetype"),
        F.col("alt_segment").alias("segment"),
        F.col("alt_archetype").alias("archetype"),
        F.col("alt_codes").alias("codes"),
        F.col("alt_relative_top").alias("relative_top"),
        F.col("alt_absolute_top").alias("absolute_top"),
    )
    keys = COMBO + TARGET
    rules = PO.fit_median(PO.leader_days(a.study.rows, chosen), settings.bins).join(
        mapping.select(*keys), COMBO
    )
    demand = failed.select(
        *WINDOW,
        F.col("segment").alias("target_segment"),
        F.col("archetype").alias("target_archetype"),
        "demand_ref",
    )
    r = RP.replay(
        a.study,
        a.evaluation,
        rules,
        settings,
        chosen=chosen,
        keys=keys,
        levels=levels,
        study_phase=phase,
        demand=demand,
        store=True,
    )
    summary = BT.eval_summary(r.days.where(F.col("phase") == "eval"), keys)
    ratio = VA.replication_ratio(r.days, keys, phase)
    return mapping.join(summary, keys).join(ratio, keys, "left")


def walk_forward(
    d: Daily,
    market: Market,
    settings: Settings,
    windows: DataFrame,
    regime: DataFrame,
    targets: DataFrame | None = None,
    levels: DataFrame | None = None,
    labels: str = "rule",
) -> DataFrame:
    """Assessment of contiguous windows going back in time, until a step has no result."""
    steps = windows.select(*WINDOW, "step")
    a = assess(
        d, market, settings, windows.drop("step"), regime, targets, levels, labels
    )
    combo = ["segment", "archetype"]
    order = Window.partitionBy(*combo).orderBy("step")
    return (
        a.summary.join(steps, WINDOW)
        .withColumn("_i", F.row_number().over(order) - 1)
        .where(F.col("_i") == F.col("step"))
        .drop("_i")
    )


def walk_forward_levels(steps: DataFrame) -> DataFrame:
    """Steps, and the upper median of ratio and deflated Sharpe, per combination."""
    um = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {0} DESC) FILTER (WHERE {0} IS NOT NULL)"
    return steps.groupBy("segment", "archetype").agg(
        F.count(F.lit(1)).alias("steps"),
        F.expr(um.format("replication_ratio")).alias("ratio_median"),
        F.expr(um.format("dsr")).alias("dsr_median"),
    )
