"""The study: population, segments, panel, labels, rankings of one or many windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerglass.operators import WINDOW
from peerglass.operators import clusters as CL
from peerglass.operators import panel as PN
from peerglass.operators import rankings as RK
from peerglass.operators import rollups as RU
from peerglass.operators import segments as SG
from peerglass.operators import windows as WN
from peerglass.params import Settings
from peerglass.sources.proxies import Market
from peerglass.sources.tables import MEASURES, durable, within


# Volumes that no step after the margin and the shares asks for.
_DAILY_ONLY = [m for m in MEASURES if m != "demand"]


@dataclass(frozen=True)
class Daily:
    """Entity-days of the whole history, computed once for all windows."""

    volumes: DataFrame
    panel: DataFrame


@dataclass(frozen=True)
class Study:
    """One phase of every window, labelled."""

    segmented: DataFrame
    labelled: DataFrame
    benchmark: DataFrame
    days: DataFrame
    profiles: DataFrame | None = None
    members: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """The labelled panel, for those that do not ask for the benchmark."""
        return self.labelled if self.members is None else self.members


def daily(
    market: Market, settings: Settings, store: bool = False, windows: DataFrame | None = None
) -> Daily:
    """Roll the fact up to days and derive features and margin, once.

    With ``store`` the two tables are written to the shared folder; everything
    after that reads days, never hours. With ``windows`` (a short table of start
    and end days) only hours of days that one of them covers are rolled up, not those
    between windows.
    """
    hourly = market.hourly
    if windows is not None:
        days = [c for c in windows.columns if c.endswith(("_start", "_end", "_day"))]
        spans = windows.select(
            F.least(*days).alias("first"), F.date_add(F.greatest(*days), 1).alias("end")
        ).where(F.col("first").isNotNull()).distinct().collect()
        if spans:
            hourly = within(hourly, [(s["first"], s["end"]) for s in spans])
    volumes = RU.daily_volumes(hourly)
    if store:
        volumes = durable(volumes, "volumes")
    panel = RU.entity_days(volumes, market.agents, market.prices, settings.activities)
    panel = PN.with_performance(PN.with_features(panel, settings.model), settings.model)
    return Daily(volumes, durable(panel, "panel") if store else panel)


def spans_of(windows: DataFrame, phase: str, holdout_days: int = 0) -> DataFrame:
    return WN.phase_spans(windows, holdout_days).where(F.col("phase") == phase)


def population_of(d: Daily, market: Market, settings: Settings, spans: DataFrame) -> DataFrame:
    """Segmented population of each window of one phase."""
    volumes = WN.by_window(d.volumes, WN.phase_days(spans).drop("phase"))
    found = RU.population(volumes, market.agents, settings.activities)
    if settings.sizes.per_days:
        length = spans.select(
            *WINDOW, (F.date_diff("end_day", "start_day") + 1).alias("window_days")
        )
        return SG.segment_population(found.join(length, WINDOW), settings.sizes, "window_days")
    return SG.segment_population(found, settings.sizes)


def study(
    d: Daily,
    market: Market,
    settings: Settings,
    spans: DataFrame,
    labels: str = "rule",
    store: bool = False,
    k: int | None = 5,
    starts: int = 10,
) -> Study:
    """Label the entity-days of one phase of every window.

    ``labels="rule"`` names each entity-day by its own shares; ``"kmeans"``
    clusters each window's entity-days and names the clusters by their means;
    without ``k`` every window gets its best number of clusters.
    """
    keep = durable if store else (lambda df, label: df)
    segmented = keep(population_of(d, market, settings, spans), "segments")
    # Names by rule need the day's own shares only: they are found before days repeat in windows.
    panel = PN.label_by_rule(d.panel) if labels == "rule" else d.panel
    rows = PN.in_windows(
        panel.drop(*_DAILY_ONLY), WN.phase_days(spans).drop("phase"), segmented, keep_unknown=False
    )
    rows = keep(rows, "members")
    profiles = None
    if labels == "kmeans":
        assigned = CL.grouped_kmeans(CL.cluster_inputs(rows), k, starts)
        # Written once: the distances to the centres are not to be taken again by each reader.
        rows = keep(rows.join(assigned, WINDOW + ["agent_id", "day"]), "clustered")
        profiles = keep(CL.cluster_profiles(rows), "profiles")
        rows = CL.attach_archetypes(rows, profiles)
    elif labels != "rule":
        raise ValueError(f"unknown labels {labels!r}")
    benchmark = keep(
        PN.segment_day_benchmark(rows, clipped=bool(settings.model.margin_clip)), "benchmark"
    )
    # The benchmark is short; its join is cheaper to repeat than the panel is to write again.
    labelled = PN.with_relative(rows, benchmark)
    return Study(segmented, labelled, benchmark, PN.study_days(benchmark), profiles, rows if store else None)


def evaluation_panel(
    d: Daily, spans: DataFrame, segmented: DataFrame, store: bool = False
) -> DataFrame:
    """Eval days with the study's segments; entities the study did not know have none."""
    out = PN.in_windows(d.panel.drop(*_DAILY_ONLY), WN.phase_days(spans), segmented)
    return durable(out, "evaluation") if store else out


def study_tables(s: Study, settings: Settings, min_days_pct: float = 20.0, k: int = 8) -> dict[str, DataFrame]:
    """Every result table of a study."""
    ranking = RK.daily_ranking(s.labelled)
    by_segment = RK.daily_ranking(s.labelled, ["segment"])
    balance = RK.mark_outliers(RK.period_balance(ranking), s.days, min_days_pct)
    return {
        "segments": s.segmented,
        "segment_summary": SG.segment_summary(s.segmented, settings.sizes),
        "labelled": s.labelled,
        "profiles": s.profiles if s.profiles is not None else CL.cluster_profiles(s.labelled),
        "ranking": ranking,
        "balance": balance.where(~F.col("is_outlier")),
        "outliers": balance.where("is_outlier"),
        "ranking_by_segment": by_segment,
        "balance_by_segment": RK.mark_outliers(
            RK.period_balance(by_segment, ["segment"]), s.days, min_days_pct
        ),
        "archetype_by_segment": RK.archetype_segment_matrix(by_segment),
        "rank_histogram": RK.rank_histogram(ranking, k),
        "benchmark": s.benchmark,
    }
