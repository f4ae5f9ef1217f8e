"""Replay a policy on later days and judge the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerglass.functions.finance import model_columns
from peerglass.functions.numeric import dec_round, upper_median
from peerglass.functions.regime import is_scarcity, spread_bin
from peerglass.functions.shares import PROFILE, SHARES
from peerglass.operators import COMBO, WINDOW
from peerglass.operators.panel import segment_day_benchmark
from peerglass.operators.policy import defensive, in_distribution, recommended
from peerglass.params import MarginModel, PolicyRules, SpreadBins

PHASE = WINDOW + ["phase"]


def follower_volumes(demand: Column, profile: dict[str, Column]) -> dict[str, Column]:
    """Entity-day of a follower: a demand split by a profile, nothing sold."""
    unregulated = profile["pct_unregulated"] / 100.0
    reg = demand * (1.0 - unregulated)
    contract = demand * (profile["pct_contract"] / 100.0)
    contract_reg = contract * F.coalesce(F.try_divide(reg, demand), F.lit(0.0))
    zero = F.lit(0.0)
    return {
        "demand": demand,
        "demand_reg": reg,
        "demand_unreg": demand * unregulated,
        "buy_contract": contract,
        "buy_contract_reg": contract_reg,
        "sell_contract": zero,
        "buy_spot": demand * (profile["pct_spot"] / 100.0),
        "sell_spot": zero,
        "buy_auction": contract_reg * (profile["pct_auction"] / 100.0),
    }


def follower_result(
    demand: Column, profile: dict[str, Column], contract: Column, spot: Column, model: MarginModel
) -> dict[str, Column]:
    """Financial result of the follower; its margin is not winsorised."""
    v = follower_volumes(demand, profile)
    cost = v["buy_contract"] * contract + v["buy_spot"] * spot
    return model_columns(
        demand=demand,
        purchases=v["buy_contract"] + v["buy_spot"],
        energy_cost=cost,
        net_exposure=cost,
        model=model,
    )


def leaders_by_day(panel: DataFrame, chosen: DataFrame, features: bool = False) -> DataFrame:
    """Upper median of the leaders' margin (and shares) per combination and day.

    A group has at most ``top`` rows.
    """
    rows = panel.select(*PHASE, "day", "agent_id", "margin", *(SHARES if features else ())).join(
        chosen.select(*COMBO, "agent_id"), WINDOW + ["agent_id"]
    )
    aggs = [upper_median("margin").alias("leaders_margin")]
    if features:
        aggs += [upper_median(s).alias(f"realised_{s}") for s in SHARES]
    return rows.groupBy(*COMBO, "phase", "day").agg(*aggs)


def segment_by_day(panel: DataFrame, clipped: bool = True) -> DataFrame:
    return segment_day_benchmark(
        panel.where(F.col("segment").isNotNull()), PHASE + ["segment", "day"], clipped
    ).withColumnRenamed("bench", "segment_margin")


def backtest(
    context: DataFrame,
    policies: DataFrame,
    segment_days: DataFrame,
    *,
    model: MarginModel,
    rules: PolicyRules,
    bins: SpreadBins,
    leader_days: DataFrame | None = None,
    levels: DataFrame | None = None,
    keys: list[str] = COMBO,
) -> DataFrame:
    """One row per policy, phase and day.

    ``context`` comes from ``decision_context``; ``policies`` carries the packed
    rules and ``demand_ref``.  Both have one row per window day and per policy,
    so their join has the size of the result.
    """
    spread = F.col("context_spread")
    replay = (
        context.join(policies.select(*keys, "demand_ref", "rules", "fallback", "spread_min", "spread_max"), WINDOW)
        .withColumn("_p", recommended(spread, F.col("bin")))
        .withColumn("in_distribution", in_distribution(spread))
    )
    used = defensive(F.col("_p"), ~F.col("in_distribution"), rules.outside_exposure_factor)
    replay = replay.withColumns(used)
    result = follower_result(
        F.col("demand_ref"),
        {f: F.col(f) for f in PROFILE},
        F.col("contract"),
        F.col("spot"),
        model,
    )
    sim = replay.select(
        *keys,
        "phase",
        "day",
        "contract",
        "spot",
        "scarcity",
        "context_spread",
        "bin",
        is_scarcity(F.col("spot"), F.col("scarcity")).alias("is_scarcity"),
        "in_distribution",
        *PROFILE,
        "demand_ref",
        result["margin"].alias("follower_margin"),
        result["guarantee"].alias("guarantee"),
        *[F.col("_p")[s].alias(f"recommended_{s}") for s in SHARES],
    )
    sim = sim.join(segment_days, PHASE + ["segment", "day"], "left")
    if leader_days is not None:
        own = leader_days.select(*COMBO, "phase", "day", "leaders_margin")
        sim = sim.join(own, COMBO + ["phase", "day"], "left")
    else:
        sim = sim.withColumn("leaders_margin", F.lit(None).cast("double"))
    if levels is not None:
        sim = sim.join(
            levels.select("day", dec_round(F.col("level_pct"), 1).alias("reservoir_pct")), "day", "left"
        )
    else:
        sim = sim.withColumn("reservoir_pct", F.lit(None).cast("double"))
    return sim


def eval_summary(days: DataFrame, keys: list[str]) -> DataFrame:
    """Follower against leaders and segment over the days of a window."""
    f, seg, lead = F.col("follower_margin"), F.col("segment_margin"), F.col("leaders_margin")

    def beats(other: Column) -> Column:
        return dec_round(
            F.try_divide(F.count_if(f > other) * 100.0, F.count(other).cast("double")), 1
        )

    return days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        dec_round(F.max("demand_ref"), 0).alias("demand_per_day"),
        dec_round(F.median(f), 2).alias("follower_median"),
        dec_round(F.sum(f.cast("decimal(18,2)")).cast("double") / F.count(f), 2).alias("follower_mean"),
        dec_round(F.median(lead), 2).alias("leaders_median"),
        dec_round(F.median(seg), 2).alias("segment_median"),
        beats(seg).alias("pct_beats_segment"),
        beats(lead).alias("pct_beats_leaders"),
        dec_round(F.median("guarantee"), 0).alias("guarantee_median"),
        dec_round(F.max("guarantee"), 0).alias("guarantee_max"),
    )


def stress_scenarios(
    study_days: DataFrame, policies: DataFrame, model: MarginModel, bins: SpreadBins, keys: list[str] = COMBO
) -> DataFrame:
    """Spot at, and 25 % above, the highest scarcity price of the study."""
    at = F.max_by(
        F.struct("contract", "scarcity"), F.struct("scarcity", -F.unix_date("day"))
    ).alias("d")
    reference = study_days.groupBy(*WINDOW).agg(at).select(*WINDOW, "d.contract", "d.scarcity")
    levels = F.array(
        F.struct(F.lit("at_scarcity").alias("scenario"), F.lit(1.0).alias("factor")),
        F.struct(F.lit("beyond_scarcity").alias("scenario"), F.lit(1.25).alias("factor")),
    )
    rows = (
        policies.join(reference, WINDOW)
        .select("*", F.inline(levels))
        .withColumn("spot", F.col("scarcity") * F.col("factor"))
        .withColumn("spread", F.col("spot") - F.col("contract"))
        .withColumn("bin", spread_bin(F.col("spread"), bins))
        .withColumn("_p", recommended(F.col("spread"), F.col("bin")))
    )
    result = follower_result(
        F.col("demand_ref"),
        {f: F.col("_p")[f] for f in PROFILE},
        F.col("contract"),
        F.col("spot"),
        model,
    )
    return rows.select(
        *keys,
        "scenario",
        dec_round(F.col("spot"), 1).alias("spot"),
        dec_round(F.col("contract"), 1).alias("contract"),
        dec_round(F.col("spread"), 1).alias("spread"),
        "bin",
        result["margin"].alias("margin"),
        result["guarantee"].alias("guarantee"),
    )


def stress_margins(stress: DataFrame, keys: list[str]) -> DataFrame:
    def of(name: str) -> Column:
        return F.max(F.when(F.col("scenario") == name, F.col("margin")))

    return stress.groupBy(*keys).agg(
        of("at_scarcity").alias("stress_margin"), of("beyond_scarcity").alias("extreme_margin")
    )


def decision(df: DataFrame, rules: PolicyRules, scarcity_pct: str = "pct_scarcity") -> DataFrame:
    """Expected margins, losses and a verdict code.

    Needs ``demand_ref, follower_median, stress_margin, extreme_margin, drawdown,
    over_capacity`` and the historical scarcity share.  A kill threshold of zero
    switches the kill switch off.
    """
    stress = F.coalesce(F.col("stress_margin"), F.lit(0.0))
    extreme = F.coalesce(F.col("extreme_margin"), F.lit(0.0))
    calm = F.coalesce(F.col("follower_median"), F.lit(0.0))

    def expected(p: Column) -> Column:
        return dec_round((1.0 - p) * calm + p * stress, 2)

    history = expected(F.col(scarcity_pct) / 100.0)
    dry = expected(F.lit(rules.dry_year_pct / 100.0))
    kill = (F.col("drawdown") > F.lit(float(rules.kill_drawdown))) if rules.kill_drawdown else F.lit(False)
    verdict = (
        F.when(kill, "kill_switch")
        .when(F.coalesce(F.col("over_capacity"), F.lit(False)), "over_capacity")
        .when(stress >= 0, "no_scarcity_loss")
        .when(dry < 0, "dry_year_loss")
        .when(history < 0, "history_loss")
        .otherwise("positive_with_tail")
    )
    return df.withColumns(
        {
            "loss_scarcity_day": dec_round(stress * F.col("demand_ref"), 0),
            "loss_extreme_day": dec_round(extreme * F.col("demand_ref"), 0),
            "ev_history": history,
            "ev_dry_year": dry,
            "kill_switch": kill,
            "verdict": verdict,
        }
    )


def clone_fidelity(days: DataFrame, realised: DataFrame, keys: list[str] = COMBO) -> DataFrame:
    """Mean absolute error of the recommended against the leaders' realised shares.

    Days without a leader do not count; null when there are none.
    """
    joined = days.drop("leaders_margin").join(realised, COMBO + ["phase", "day"])
    mae = {
        s: dec_round(F.avg(F.abs(F.col(f"recommended_{s}") - F.col(f"realised_{s}"))), 2)
        for s in SHARES
    }
    out = joined.groupBy(*keys).agg(*[c.alias(f"mae_{s}") for s, c in mae.items()])
    total = sum((F.col(f"mae_{s}") for s in SHARES[1:]), F.col(f"mae_{SHARES[0]}"))
    return out.withColumn("mae_mean", dec_round(total / float(len(SHARES)), 2))
