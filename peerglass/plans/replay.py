"""From labelled studies to judged policies: the part that all scans share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerglass.operators import COMBO, WINDOW
from peerglass.operators import backtest as BT
from peerglass.operators import panel as PN
from peerglass.operators import policy as PO
from peerglass.operators import segments as SG
from peerglass.operators import series as SR
from peerglass.operators import validity as VA
from peerglass.params import Settings
from peerglass.plans.study import Study
from peerglass.sources.tables import durable

SEGMENT = WINDOW + ["segment"]


@dataclass(frozen=True)
class Replay:
    """Policies with the days they were replayed on."""

    rules: DataFrame
    policies: DataFrame
    days: DataFrame
    realised: DataFrame | None
    study_market: DataFrame
    segment_days: DataFrame


def leader_panel(s: Study, chosen: DataFrame) -> DataFrame:
    """All study days of the chosen entities, in whatever archetype."""
    return s.rows.join(chosen.select(*WINDOW, "agent_id").distinct(), WINDOW + ["agent_id"], "left_semi")


def replay(
    s: Study,
    evaluation: DataFrame,
    rules: DataFrame,
    settings: Settings,
    *,
    chosen: DataFrame | None,
    keys: list[str],
    levels: DataFrame | None = None,
    study_phase: str = "study",
    demand: DataFrame | None = None,
    store: bool = False,
    led: DataFrame | None = None,
) -> Replay:
    """Replay fitted policies over their study and eval days.

    ``led`` may give the study days of the chosen entities (``leader_panel``).
    """
    keep = durable if store else (lambda df, label: df)
    # Every policy is tried with the median demand of its segment, unless told otherwise.
    demand = SG.reference_demand(s.rows) if demand is None else demand
    on = [c for c in demand.columns if c in keys]
    policies = keep(
        PO.pack_policies(rules, keys).join(demand, on).where("demand_ref > 0"), "policies"
    )
    by_day = keep(PN.segment_days(s.rows), "segment_days").withColumn("phase", F.lit(study_phase))
    study_market = PN.market_days(by_day, BT.PHASE)
    eval_market = PN.market_days(evaluation, BT.PHASE)
    context = PO.decision_context(
        study_market.unionByName(eval_market),
        settings.bins,
        BT.PHASE,
        settings.policy.use_previous_spot,
    )
    segment_days = (
        s.benchmark.withColumnRenamed("bench", "segment_margin")
        .withColumn("phase", F.lit(study_phase))
        .unionByName(BT.segment_by_day(evaluation, bool(settings.model.margin_clip)))
    )
    on_day = realised = None
    if chosen is not None:
        columns = [*BT.PHASE, "day", "agent_id", "margin", *BT.SHARES]
        study_rows = (s.rows if led is None else led).withColumn("phase", F.lit(study_phase))
        both = study_rows.select(*columns).unionByName(evaluation.select(*columns))
        realised = keep(BT.leaders_by_day(both, chosen, features=True), "realised")
        on_day = realised
    days = BT.backtest(
        context,
        policies,
        segment_days,
        model=settings.model,
        rules=settings.policy,
        bins=settings.bins,
        leader_days=on_day,
        levels=levels,
        keys=keys,
    )
    return Replay(rules, policies, keep(days, "days"), realised, study_market, by_day)


def judge(
    r: Replay,
    s: Study,
    settings: Settings,
    regime: DataFrame,
    trials: DataFrame,
    keys: list[str],
    study_phase: str = "study",
) -> DataFrame:
    """One row per policy: summary, replication, risk, stress, decision, fidelity.

    ``trials`` carries ``n_trials`` per policy; ``regime`` is the one-row history.
    """
    evaluated = r.days.where(F.col("phase") == "eval")
    summary = BT.eval_summary(evaluated, keys)
    risk = (
        SR.distribution(evaluated, keys, "follower_margin")
        .select(*keys, "p5", "p95", "worst", "best", "drawdown")
    )
    ratio = VA.replication_ratio(r.days, keys, study_phase)
    moments = VA.sharpe_moments(evaluated, keys).join(trials, keys)
    dsr = VA.deflated_sharpe(moments).select(
        *keys, "sharpe", "skew", "kurtosis", "n_trials", "dsr", "dsr_significant"
    )
    stress = BT.stress_margins(
        BT.stress_scenarios(r.study_market, r.policies, settings.model, settings.bins, keys), keys
    )
    capacity = SG.segment_capacity(r.segment_days)
    out = (
        summary.join(r.policies.select(*keys, "demand_ref", "spread_min", "spread_max"), keys)
        .join(risk, keys, "left")
        .join(ratio, keys, "left")
        .join(dsr, keys, "left")
        .join(stress, keys, "left")
        .join(capacity, SEGMENT, "left")
    )
    if r.realised is not None:
        fidelity = BT.clone_fidelity(
            evaluated, r.realised.where(F.col("phase") == "eval"), keys
        )
        out = out.join(fidelity, keys, "left")
    else:
        for s_ in BT.SHARES:
            out = out.withColumn(f"mae_{s_}", F.lit(None).cast("double"))
        out = out.withColumn("mae_mean", F.lit(None).cast("double"))
    # The history is a single row, read once as a scalar.
    out = out.withColumn("pct_scarcity", regime.select("pct_scarcity").scalar())
    out = SG.capacity_share(out, "demand_ref", settings.policy.capacity_max_pct)
    return BT.decision(out, settings.policy)


def combo_codes(chosen: DataFrame) -> DataFrame:
    """Leader codes and their relative level, by median and by mean."""
    return chosen.groupBy(*COMBO).agg(
        F.count(F.lit(1)).alias("n_leaders"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "agent_id"))), lambda x: x["agent_id"]
        ).alias("codes"),
        F.round(F.median("relative_median").cast("decimal(30,10)"), 2)
        .cast("double")
        .alias("relative_top"),
        F.round(
            (F.sum(F.col("relative_median").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)))
            .cast("decimal(30,10)"),
            2,
        )
        .cast("double")
        .alias("relative_mean"),
    )
