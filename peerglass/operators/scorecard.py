"""Gates, candidates and their order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerglass.functions.numeric import dec_round
from peerglass.params import Gates

@dataclass(frozen=True)
class Gate:
    """One pass/fail test: a metric against a threshold, and what a null counts as."""

    name: str
    metric: str
    test: str  # "<=", ">=" or "not" (a flag that must be down)
    threshold: str | None  # field of Gates
    null_passes: bool
    needed_for: str  # the verdict it counts towards: cheap, full or economic


# The tests, their thresholds (see params.Gates) and their null rules.
GATE_TABLE = (
    Gate("E1_beats_segment", "pct_beats_segment", ">=", "min_pct_beats_segment", False, "economic"),
    Gate("E2_no_kill_switch", "kill_switch", "not", None, True, "economic"),
    Gate("E3_expected_value", "ev_history", ">=", "min_expected_value", False, "economic"),
    Gate("E4_capacity", "over_capacity", "not", None, False, "economic"),
    Gate("V1_bootstrap", "p_value", "<=", "alpha", False, "cheap"),
    Gate("V2_n_effective", "n_effective", ">=", "min_n_effective", False, "cheap"),
    Gate("V3_holdout", "persistence", ">=", "min_persistence", True, "full"),
    Gate("V4_replication", "replication_ratio", ">=", "min_replication", False, "cheap"),
    Gate("V5_dsr", "dsr", ">=", "min_dsr", False, "cheap"),
)
GATES = tuple(g.name for g in GATE_TABLE)


def _passed(gate: Gate, limits: Gates) -> Column:
    value = F.col(gate.metric)
    if gate.test == "not":
        met = ~value
    else:
        limit = F.lit(getattr(limits, gate.threshold))
        met = value <= limit if gate.test == "<=" else value >= limit
    return F.coalesce(met, F.lit(gate.null_passes))


def evaluate_gates(rows: DataFrame, g: Gates) -> DataFrame:
    """A column per gate of the table, and the verdicts that all gates of a kind make."""

    def every(*kinds: str) -> Column:
        return reduce(and_, (F.col(x.name) for x in GATE_TABLE if x.needed_for in kinds))

    return rows.withColumns({x.name: _passed(x, g) for x in GATE_TABLE}).withColumns(
        {
            "n1_cheap": every("cheap"),
            "n1_full": every("cheap", "full"),
            "n2": every("economic"),
            "valid_cheap": every("cheap", "economic"),
            "valid_final": every("cheap", "full", "economic"),
        }
    )


def gate_detail() -> Column:
    return F.concat(*[F.concat(F.lit(f"{g}="), F.col(g).cast("int").cast("string"), F.lit(";")) for g in GATES])


def failed_gates() -> Column:
    """Sorted names of the gates a row does not pass."""
    return F.array_compact(F.array(*[F.when(~F.col(g), F.lit(g)) for g in sorted(GATES)]))


def gate_pass_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per mode and gate: how many rows pass, and the level of p."""
    n = F.count(F.lit(1))
    wide = rows.groupBy(*keys).agg(
        n.alias("n_rows"),
        F.count_if("valid_cheap").alias("n_candidates"),
        F.min("p_value").alias("p_min"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p_value DESC)").alias("p_median"),
        *[F.count_if(F.col(g)).alias(g) for g in GATES],
    )
    ids = [*keys, "n_rows", "n_candidates", "p_min", "p_median"]
    return wide.unpivot(ids, list(GATES), "gate", "n_passed").withColumn(
        "pct_passed", dec_round(F.col("n_passed") * 100.0 / F.col("n_rows"), 1)
    )


def top_combinations(rows: DataFrame, limit: int = 20, score: str = "relative_top") -> DataFrame:
    return rows.orderBy("p_value", F.desc(score), "window_id", "segment", "archetype").limit(limit)


def to_confirm(rows: DataFrame, max_confirm: int, near: int) -> DataFrame:
    """Best candidates, and the best of those that just missed, per mode.

    Both cuts are top-k filters on a rank, so they are cut on the map side.
    """
    tail = ["study_start", "segment", "archetype"]
    order = [F.asc("p_value"), F.desc("follower_median"), *[F.asc(t) for t in tail]]
    w = Window.partitionBy("mode", "candidate").orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(w))
    best = ranked.where(F.col("candidate") & (F.col("_r") <= max_confirm))
    close = ranked.where(~F.col("candidate") & (F.col("_r") <= near))
    return (
        best.unionByName(close)
        .drop("_r")
        .dropDuplicates(["mode", "study_start", "study_end", "segment", "archetype"])
    )


# Fixed values.
KPI_LEVELS = {
    # metric: (ok threshold, warn threshold, higher is better)
    "follower_median": (0.0, None, True),
    "pct_beats_segment": (60.0, 50.0, True),
    "dsr": (0.95, 0.8, True),
    "p_value": (0.05, 0.1, False),
    "n_effective": (3.0, 2.0, True),
    "ev_history": (0.0, None, True),
    "reservoir_level": (70.0, 30.0, True),
}


def kpi_states(metrics: DataFrame, kill_drawdown: float) -> DataFrame:
    """Traffic light of each (metric, value) row; a missing value warns."""
    v, m = F.col("value"), F.col("metric")
    state = F.when(
        m == "drawdown",
        F.when(v <= 0, "ok").when(v >= F.lit(float(kill_drawdown)), "bad").otherwise("warn"),
    )
    for name, (ok, warn, higher) in KPI_LEVELS.items():
        if higher:
            good = v > ok if name == "follower_median" else v >= ok
            fair = (v >= warn) if warn is not None else F.lit(False)
        else:
            good, fair = v <= ok, v <= warn
        state = state.when(m == name, F.when(good, "ok").when(fair, "warn").otherwise("bad"))
    return metrics.withColumn("state", F.when(v.isNull(), "warn").otherwise(state))
