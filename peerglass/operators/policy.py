"""Policies: spread bin -> median supply profile, and their application to a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerglass.functions.numeric import dec_round
from peerglass.functions.regime import bin_bound, spread_bin
from peerglass.functions.shares import PROFILE
from peerglass.operators import COMBO, WINDOW
from peerglass.operators.orderstats import median_profile
from peerglass.params import SpreadBins

_PLACES = {"has_auction": 2}


def _rounded(column: str | Column, feature: str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return dec_round(c, _PLACES.get(feature, 1)).alias(feature)


def with_spread(df: DataFrame, bins: SpreadBins) -> DataFrame:
    """Same-day spread and its bin, as used for fitting."""
    spread = F.col("spot") - F.col("contract")
    return df.withColumn("spread", spread).withColumn("bin", spread_bin(F.col("spread"), bins))


def leader_days(labelled: DataFrame, chosen: DataFrame) -> DataFrame:
    """Days on which a leader played the archetype it was chosen for."""
    return labelled.join(chosen.select(*COMBO, "agent_id"), COMBO + ["agent_id"], "left_semi")


def _with_bounds(rules: DataFrame, bins: SpreadBins) -> DataFrame:
    return rules.withColumn("lo", bin_bound(F.col("bin"), bins, "lo")).withColumn(
        "hi", bin_bound(F.col("bin"), bins, "hi")
    )


def fit_median(training: DataFrame, bins: SpreadBins, keys: list[str] = COMBO) -> DataFrame:
    """Median profile per bin and, with a null bin, over all bins.

    Training rows are the days of at most ``top`` leaders per combination.  Both
    levels come out of one pass.
    """
    rows = with_spread(training, bins)
    columns = [F.col(k) for k in keys] + [F.col("bin")]
    medians = [_rounded(F.median(f), f) for f in PROFILE]
    out = rows.groupingSets([columns, columns[:-1]], *columns).agg(
        *medians,
        F.count(F.lit(1)).alias("n_days"),
        F.min("spread").alias("spread_min"),
        F.max("spread").alias("spread_max"),
    )
    return _with_bounds(out, bins)


def fit_weighted(
    training: DataFrame, weights: DataFrame, bins: SpreadBins, keys: list[str] = COMBO
) -> DataFrame:
    """Weighted mean of each leader's median profile per bin.

    Weights are renormalised over the leaders present in a bin.
    """
    rows = with_spread(training, bins)
    columns = [F.col(k) for k in keys] + [F.col("bin"), F.col("agent_id")]
    per_leader = rows.groupingSets(
        [columns, [*columns[:-2], columns[-1]]], *columns
    ).agg(
        *[_rounded(F.median(f), f) for f in PROFILE],
        F.count(F.lit(1)).alias("n_days"),
        F.min("spread").alias("spread_min"),
        F.max("spread").alias("spread_max"),
    )
    total = F.sum("weight")
    out = (
        per_leader.join(weights.select(*keys, "agent_id", "weight"), keys + ["agent_id"])
        .groupBy(*keys, "bin")
        .agg(
            *[_rounded(F.sum(F.col("weight") * F.col(f)) / total, f) for f in PROFILE],
            F.sum("n_days").alias("n_days"),
            F.min("spread_min").alias("spread_min"),
            F.max("spread_max").alias("spread_max"),
        )
    )
    return _with_bounds(out, bins)


def fit_archetype(
    labelled: DataFrame, winners: DataFrame, bins: SpreadBins, keys: list[str] | None = None
) -> DataFrame:
    """Median profile of everyone who plays the winning cluster of each bin.

    These groups grow with the data, so the medians come from value counts.  Days of
    one profile are counted before they repeat per level and feature.
    """
    keys = keys or WINDOW + ["segment"]
    best = winners.groupBy(*keys).agg(
        F.map_from_entries(
            F.filter(
                F.collect_list(F.struct(F.coalesce("bin", F.lit("*")), "cluster_id")),
                lambda e: e["cluster_id"].isNotNull(),
            )
        ).alias("best")
    )
    rows = with_spread(labelled, bins).join(best, keys)
    span = rows.groupBy(*keys).agg(
        F.min("spread").alias("spread_min"), F.max("spread").alias("spread_max")
    )
    mine = F.col("cluster_id")
    levels = F.filter(
        F.array(
            F.when(mine == F.try_element_at("best", F.col("bin")), F.col("bin")),
            F.when(mine == F.try_element_at("best", F.lit("*")), F.lit("*")),
        ),
        lambda b: b.isNotNull(),
    )
    alike = (
        rows.select(*keys, *PROFILE, levels.alias("_levels"))
        .where(F.size("_levels") > 0)
        .groupBy(*keys, "_levels", *PROFILE)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    training = alike.select(*keys, *PROFILE, "_n", F.explode("_levels").alias("bin"))
    fitted = median_profile(training, keys + ["bin"], list(PROFILE), weight="_n")
    out = fitted.join(span, keys).select(
        *keys,
        F.when(F.col("bin") != "*", F.col("bin")).alias("bin"),
        *[_rounded(f, f) for f in PROFILE],
        "n_days",
        "spread_min",
        "spread_max",
    )
    return _with_bounds(out, bins)


def pack_policies(rules: DataFrame, keys: list[str] = COMBO) -> DataFrame:
    """One row per policy: its rules (at most one per bin), fallback and spread range."""
    profile = F.struct(*PROFILE)
    rule = F.struct("bin", "lo", "hi", *PROFILE, "n_days")
    trained = F.col("bin").isNotNull()
    return rules.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(trained, rule))).alias("rules"),
        F.max(F.when(~trained, profile)).alias("fallback"),
        dec_round(F.min("spread_min"), 2).alias("spread_min"),
        dec_round(F.max("spread_max"), 2).alias("spread_max"),
    )


def decision_context(
    days: DataFrame, bins: SpreadBins, keys: list[str], use_previous: bool = True
) -> DataFrame:
    """Spread known when the day is decided: yesterday's spot, today's contract.

    The first day of a window has no earlier day and uses its own spot.
    """
    from pyspark.sql import Window

    spot = F.col("spot")
    if use_previous:
        order = Window.partitionBy(*keys).orderBy("day")
        spot = F.coalesce(F.lag("spot").over(order), spot)
    return days.withColumn("context_spread", spot - F.col("contract")).withColumn(
        "bin", spread_bin(F.col("context_spread"), bins)
    )


def recommended(spread: Column, own_bin: Column) -> Column:
    """Profile of the own bin's rule, else of the nearest trained bin, else the fallback.

    Works on the policy's packed rules, so no day is paired with every rule.
    """

    def candidate(r: Column) -> Column:
        inside = (spread >= r["lo"]) & (spread <= r["hi"])
        gap = F.least(F.abs(spread - r["lo"]), F.abs(spread - r["hi"]))
        return F.struct(
            F.when(r["bin"] == own_bin, 0).otherwise(1).alias("other"),
            F.when(inside, 0.0).otherwise(gap).alias("gap"),
            r["bin"].alias("bin"),
            *[r[f].alias(f) for f in PROFILE],
        )

    best = F.array_min(F.transform("rules", candidate))
    return F.when(best.isNotNull(), F.struct(*[best[f].alias(f) for f in PROFILE])).otherwise(
        F.coalesce(
            F.col("fallback"),
            F.raise_error(F.lit("empty policy: neither rules nor fallback")).cast(
                "struct<" + ",".join(f"{f}:double" for f in PROFILE) + ">"
            ),
        )
    )


def in_distribution(spread: Column) -> Column:
    """Inside the spread range seen in training; true when there is no range."""
    return F.coalesce(spread.between(F.col("spread_min"), F.col("spread_max")), F.lit(True))


def defensive(profile: Column, outside: Column, factor: float) -> dict[str, Column]:
    """Outside the training range part of the spot share moves to contracts."""
    cols = {f: profile[f] for f in PROFILE}
    if factor >= 1.0:
        return cols
    less = dec_round(cols["pct_spot"] * F.lit(float(factor)), 1)
    more = dec_round(cols["pct_contract"] + (cols["pct_spot"] - less), 1)
    return {
        **cols,
        "pct_contract": F.when(outside, more).otherwise(cols["pct_contract"]),
        "pct_spot": F.when(outside, less).otherwise(cols["pct_spot"]),
    }
