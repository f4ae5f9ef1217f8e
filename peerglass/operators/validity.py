"""Is a lead luck?  Bootstrap, holdout, duplicates, deflated Sharpe, replication."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from peerglass.functions.medians import best_median_at, best_median_upto, binomial_upper_tail
from peerglass.functions.normal import normal_cdf, normal_ppf
from peerglass.functions.numeric import dec_round, upper_median
from peerglass.operators import COMBO, WINDOW
from peerglass.operators.orderstats import order_stats
from peerglass.params import EULER_GAMMA

_BLOCK = 25


# --------------------------------------------------------------- bootstrap
def bootstrap_units(eligible: DataFrame, relative: bool = True) -> DataFrame:
    """Units of the test from the statistics of entities present often enough."""
    level = "relative_median" if relative else "median_margin"
    return eligible.select(
        *COMBO, F.col("agent_id").alias("unit"), F.col("n_days").alias("draws"), F.col(level).alias("level")
    )


def bootstrap_pool(labelled_rel: DataFrame, eligible: DataFrame) -> DataFrame:
    """Entity-days of the units of each combination.

    Statistics that list their values (``entity_stats`` with ``values``) are enough.
    """
    for value in ("rel", "margin"):
        if f"{value}s" in eligible.columns:
            return eligible.select(*COMBO, F.explode(f"{value}s").alias(value))
    return labelled_rel.join(
        eligible.select(*COMBO, "agent_id"), COMBO + ["agent_id"], "left_semi"
    )


_ARCHETYPE = WINDOW + ["segment", "archetype"]


def archetype_levels(
    rows: DataFrame, value: str = "rel", weight: str | None = None, clipped: bool = False
) -> DataFrame:
    """Level and days of each archetype, from entity-days or from counts of their values."""
    return order_stats(
        rows, _ARCHETYPE, value, {"level": "um"}, count="draws", coarse=not clipped, weight=weight
    )


def archetype_units(
    labelled: DataFrame, value: str = "rel", levels: DataFrame | None = None
) -> DataFrame:
    """Archetypes of each segment as units; their groups grow with the data.

    ``first_key`` orders units of one level, so it is looked up for those only, and
    null for others.  With ``levels`` (``archetype_levels``) the panel serves for
    that alone.
    """
    levels = archetype_levels(labelled, value) if levels is None else levels
    alike = Window.partitionBy(*WINDOW, "segment", "level")
    tied = levels.withColumn("_n", F.count(F.lit(1)).over(alike)).where("_n > 1")
    first = (
        labelled.join(tied.select(*_ARCHETYPE), _ARCHETYPE, "left_semi")
        .groupBy(*_ARCHETYPE)
        .agg(F.min(F.concat_ws("|", "agent_id", F.col("day").cast("string"))).alias("first_key"))
    )
    return levels.join(first, _ARCHETYPE, "left").withColumnRenamed("archetype", "unit")


def _hash_fraction(keys: list[str], seed: int, draws: str) -> Column:
    """Upper median of ``draws`` uniform draws, each a function of its counter only.

    ``xxhash64`` is the fast way.  ``md5`` gives draws that any SQL engine can
    repeat: a digest yields four draws of eight hex digits, which sort like the
    numbers they stand for, so only the chosen one is converted.
    """
    middle = "cast(draws div 2 as int) + 1"
    if draws == "xxhash64":
        unit = ", ".join([f"{int(seed)}L", *keys, "unit"])
        h = "shiftrightunsigned(xxhash64(k, rep, i), 11)"
        return F.expr(
            f"element_at(transform(array(xxhash64({unit})), k -> element_at(array_sort("
            f"transform(sequence(1L, draws), i -> {h})), {middle})), 1) / 9007199254740992.0D"
        )
    if draws != "md5":
        raise ValueError(f"unknown draws {draws!r}")
    key = F.concat_ws("|", F.lit(str(int(seed))), *[F.col(k).cast("string") for k in keys], F.col("unit"))
    return _digest_median(key, F.col("rep").cast("long"), F.col("draws").cast("long"))


@F.pandas_udf(DoubleType())
def _digest_median(key: pd.Series, rep: pd.Series, draws: pd.Series) -> pd.Series:
    """The upper median of the draws of ``md5(key|rep|b)``, four of 32 bits for each b, as fractions.

    Rows with equally many draws are sorted together, as whole numbers.
    """
    n = draws.to_numpy()
    out = np.zeros(len(n))
    start: dict[str, object] = {}
    for size in np.unique(n):
        rows = np.flatnonzero(n == size)
        blocks = [b"|%d" % b for b in range((int(size) + 3) // 4)]
        step = max(1, 500_000 // len(blocks))
        for first in range(0, len(rows), step):
            some = rows[first : first + step]
            data = bytearray()
            for k, r in zip(key.iloc[some], rep.iloc[some], strict=True):
                if (known := start.get(k)) is None:
                    known = start[k] = hashlib.md5(k.encode(), usedforsecurity=False)
                at = known.copy()
                at.update(b"|%d" % r)
                for b in blocks:
                    digest = at.copy()
                    digest.update(b)
                    data += digest.digest()
            drawn = np.frombuffer(bytes(data), dtype=">u4").reshape(len(some), -1)[:, :size]
            out[some] = np.partition(drawn.astype(np.uint32), int(size) // 2, axis=1)[:, int(size) // 2]
    return pd.Series(out / 4294967296.0)


def _null_maxima(
    units: DataFrame, keys: list[str], n_boot: int, seed: int, draws: str
) -> DataFrame:
    """Per replicate, the best unit's median as a fraction of the sorted pool.

    Every value of every unit is drawn. Units stream through and are reduced on the map
    side: what is shuffled is one number per combination, replicate and map task.
    """
    # The table is small but the draws are the whole work, so it is dealt out in
    # blocks of replicates before anything is drawn.
    blocks = F.explode(F.sequence(F.lit(1), F.lit(int(n_boot)), F.lit(_BLOCK))).alias("_first")
    last = F.least(F.col("_first") + F.lit(_BLOCK - 1), F.lit(int(n_boot)))
    reps = (
        units.select(*keys, "unit", "draws", blocks)
        .repartition(*keys, "unit", "_first")
        .withColumn("rep", F.explode(F.sequence("_first", last)))
    )
    u = _hash_fraction(keys, seed, draws)
    return reps.select(*keys, "rep", u.alias("u")).groupBy(*keys, "rep").agg(F.max("u").alias("u"))


def _tested_by_draws(
    units: DataFrame, placed: DataFrame, keys: list[str], n_boot: int, seed: int, draws: str, ranks: dict[str, int]
) -> DataFrame:
    nulls = (
        _null_maxima(units, keys, n_boot, seed, draws)
        .join(placed.select(*keys, "n_pool", "n_below", "n_upto"), keys)
        .withColumn("_i", F.floor(F.col("u") * F.col("n_pool")).cast("long"))
    )
    ordered = F.sort_array(F.collect_list("_i"))
    return nulls.groupBy(*keys).agg(
        F.count_if(F.col("_i") >= F.col("n_below")).alias("n_as_good"),
        F.count_if(F.col("_i") < F.col("n_upto")).alias("n_not_better"),
        *[F.element_at(ordered, r + 1).alias(name) for name, r in ranks.items()],
    )


def _tested_by_class(
    units: DataFrame, placed: DataFrame, keys: list[str], n_boot: int, seed: int, ranks: dict[str, int]
) -> DataFrame:
    """Replicates from the best median's own distribution, one uniform number each.

    Units with equally many draws are one class. A replicate is the least position
    whose chance reaches its number. Positions grow with the numbers, so replicates
    are counted against the chance at the real value's place, and only those of the
    wanted ranks are turned into positions. The cost is in the number of combinations
    and replicates, whatever the units, their draws and the pool.
    """
    classes = (
        units.groupBy(*keys, "draws")
        .agg(F.count(F.lit(1)).alias("members"))
        .groupBy(*keys)  # at most as many classes as a unit can have days
        .agg(F.sort_array(F.collect_list(F.struct("draws", "members"))).alias("classes"))
    )
    arrays = (F.col("classes.draws"), F.col("classes.members"))
    names = ", ".join(f"cast({k} as string)" for k in keys)
    number = f"conv(substr(md5(concat_ws('|', '{int(seed)}', {names}, cast(rep as string))), 1, 13), 16, 10)"
    uniform = F.expr(
        f"array_sort(transform(sequence(1, {int(n_boot)}), rep -> "
        f"(cast({number} as bigint) + 0.5D) / 4503599627370496.0D))"
    )
    based = placed.select(*keys, "n_pool", "n_below", "n_upto").join(classes, keys)
    chances = based.select(
        *keys, "n_pool", "classes", uniform.alias("u"),
        best_median_upto(F.col("n_below") - 1, "n_pool", *arrays).alias("below"),
        best_median_upto(F.col("n_upto") - 1, "n_pool", *arrays).alias("upto"),
    )
    return chances.select(
        *keys,
        F.size(F.filter("u", lambda x: x > F.col("below"))).cast("long").alias("n_as_good"),
        F.size(F.filter("u", lambda x: x <= F.col("upto"))).cast("long").alias("n_not_better"),
        *[
            best_median_at(F.element_at("u", r + 1), "n_pool", *arrays).alias(name)
            for name, r in ranks.items()
        ],
    )


def bootstrap_best_median(
    units: DataFrame,
    pool: DataFrame,
    *,
    keys: list[str] = COMBO,
    pool_keys: list[str] | None = None,
    value: str = "rel",
    n_boot: int = 200,
    seed: int = 42,
    draws: str = "class",
    weight: str | None = None,
) -> DataFrame:
    """Could the best unit's median come from luck?

    Null: all values of the pool are exchangeable.  Each unit redraws its number
    of values with replacement and the best unit's upper median is kept.  A draw
    is a position in the sorted pool, and medians and maxima of positions are
    positions too, so no draw is ever joined to the pool: only the positions of
    the real value and of the null's quantiles are looked up.

    ``draws``: ``class`` draws each replicate from the distribution of its result;
    ``md5`` and ``xxhash64`` draw every value of every unit.

    ``pool`` holds the pool rows, or with ``weight`` counts of them; ``pool_keys`` may be
    coarser than ``keys``.
    """
    pool_keys = pool_keys or keys
    real = units.groupBy(*keys).agg(
        F.max("level").alias("best"), F.count(F.lit(1)).alias("n_units")
    )
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    hist = pool.groupBy(*pool_keys, F.col(value).alias("_v")).agg(rows.alias("_c"))
    placed = (
        real.join(hist, pool_keys)
        .groupBy(*keys)
        .agg(
            F.max("best").alias("best"),
            F.max("n_units").alias("n_units"),
            F.sum("_c").alias("n_pool"),
            F.sum(F.when(F.col("_v") < F.col("best"), F.col("_c")).otherwise(0)).alias("n_below"),
            F.sum(F.when(F.col("_v") <= F.col("best"), F.col("_c")).otherwise(0)).alias("n_upto"),
        )
    )
    b = int(n_boot)
    mid, hi = 0.5 * (b - 1), 0.95 * (b - 1)
    ranks = {"m0": math.floor(mid), "m1": math.ceil(mid), "h0": math.floor(hi), "h1": math.ceil(hi)}
    if draws == "class":
        tested = _tested_by_class(units, placed, keys, b, seed, ranks)
    else:
        tested = _tested_by_draws(units, placed, keys, b, seed, draws, ranks)
    upto = F.sum("_c").over(
        Window.partitionBy(*pool_keys)
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ladder = hist.withColumn("_upto", upto)

    def at(name: str) -> Column:
        hit = (F.col(name) < F.col("_upto")) & (F.col(name) >= F.col("_upto") - F.col("_c"))
        return F.max(F.when(hit, F.col("_v"))).alias(f"v_{name}")

    looked_up = (
        tested.join(ladder, pool_keys).groupBy(*keys).agg(*[at(name) for name in ranks])
    )

    def between(lo: str, up: str, pos: float) -> Column:
        part = pos - math.floor(pos)
        return F.col(f"v_{lo}") + (F.col(f"v_{up}") - F.col(f"v_{lo}")) * F.lit(part)

    return (
        placed.join(tested, keys)
        .join(looked_up, keys)
        .select(
            *keys,
            F.col("n_units"),
            F.col("n_pool"),
            F.lit(b).cast("long").alias("n_boot"),
            dec_round(F.col("best"), 2).alias("boot_best"),
            dec_round(between("m0", "m1", mid), 2).alias("boot_null_p50"),
            dec_round(between("h0", "h1", hi), 2).alias("boot_null_p95"),
            dec_round((F.col("n_as_good") + 1) / F.lit(b + 1.0), 4).alias("p_value"),
            dec_round(F.col("n_not_better") * 100.0 / F.lit(float(b)), 1).alias("boot_percentile"),
        )
    )


def exact_p(units: DataFrame, pool: DataFrame, *, keys: list[str], value: str = "rel") -> DataFrame:
    """What the bootstrap's p-value tends to with the number of replicates.

    A unit's redrawn upper median lies below the best real one if more than half of
    its draws do, a binomial tail in the pool's share below; units are independent.
    """
    best = units.groupBy(*keys).agg(F.max("level").alias("best"))
    below = (
        pool.join(best, keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_pool"),
            F.max("best").alias("best"),
            F.avg(F.when(F.col(value) < F.col("best"), 1.0).otherwise(0.0)).alias("x"),
        )
    )
    log_miss = F.log(binomial_upper_tail(F.col("draws"), F.floor(F.col("draws") / 2) + 1, F.col("x")))
    return (
        units.join(below, keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_units"),
            F.max("n_pool").alias("n_pool"),
            dec_round(F.max("best"), 2).alias("boot_best"),
            # Zero when some unit cannot lie below: the logarithm is then null.
            F.when(F.count_if(log_miss.isNull()) > 0, 0.0).otherwise(F.exp(F.sum(log_miss))).alias("miss"),
        )
        .withColumn("p_exact", dec_round(1 - F.col("miss"), 3))
        .drop("miss")
    )


def best_archetype(units: DataFrame) -> DataFrame:
    """Best unit of each segment; ties go to the one seen first."""
    order = Window.partitionBy(*WINDOW, "segment").orderBy(F.desc("level"), "first_key")
    return (
        units.withColumn("_r", F.row_number().over(order))
        .where("_r = 1")
        .select(*WINDOW, "segment", F.col("unit").alias("archetype"))
    )


# ----------------------------------------------------------------- holdout
def holdout_persistence(
    chosen: DataFrame, holdout: DataFrame, holdout_days: DataFrame, min_presence_pct: float
) -> DataFrame:
    """Share of the leaders that stay in the upper half of the holdout's ranking.

    A leader's position is the number of entities that beat it, which is counted
    with partial sums; the entities of a combination are never ranked in one task.
    """
    from peerglass.operators.selection import present_enough

    key = F.concat_ws("|", F.col("agent_id"), F.col("day").cast("string"))
    ranked = present_enough(
        holdout.groupBy(*COMBO, "agent_id").agg(
            F.count(F.lit(1)).alias("n_days"),
            upper_median("margin").alias("level"),
            F.min(key).alias("first_key"),
        ),
        holdout_days,
        min_presence_pct,
    ).select(*COMBO, "agent_id", "level", "first_key")
    sizes = ranked.groupBy(*COMBO).agg(F.count(F.lit(1)).alias("n_holdout"))
    led = chosen.select(*COMBO, "agent_id").join(ranked, COMBO + ["agent_id"], "left")
    # At most ``top`` leaders per combination.
    marks = (
        led.where(F.col("level").isNotNull())
        .groupBy(*COMBO)
        .agg(F.collect_list(F.struct("agent_id", "level", "first_key")).alias("marks"))
    )
    beaten = F.transform(
        "marks",
        lambda m: F.struct(
            m["agent_id"].alias("leader"),
            F.when(
                (F.col("level") > m["level"])
                | ((F.col("level") == m["level"]) & (F.col("first_key") < m["first_key"])),
                1,
            )
            .otherwise(0)
            .alias("beats"),
        ),
    )
    positions = (
        ranked.join(marks, COMBO)
        .select(*COMBO, F.inline(beaten))
        .groupBy(*COMBO, "leader")
        .agg(F.sum("beats").alias("position"))
    )
    return (
        chosen.select(*COMBO, F.col("agent_id").alias("leader"))
        .join(positions, COMBO + ["leader"], "left")
        .join(sizes, COMBO, "left")
        .groupBy(*COMBO)
        .agg(
            F.coalesce(F.max("n_holdout"), F.lit(0).cast("long")).alias("n_holdout"),
            F.count("position").alias("n_ranked_leaders"),
            F.when(
                F.max("n_holdout").isNotNull(),
                dec_round(
                    F.count_if(F.col("position") < F.col("n_holdout") / 2) * 100.0
                    / F.count(F.lit(1)),
                    1,
                ),
            ).alias("persistence_pct"),
            dec_round(
                F.median(F.col("position") / F.greatest(F.col("n_holdout") - 1, F.lit(1)))
                * 100.0,
                1,
            ).alias("persistence_percentile"),
        )
    )


def archetype_persistence(
    winners: DataFrame, holdout_rel: DataFrame, holdout_days: DataFrame, min_presence_pct: float
) -> DataFrame:
    """Does the study's winning archetype stay in the upper half of the holdout?

    ``winners`` has one row (window, segment, archetype).
    """
    from peerglass.operators.selection import present_enough

    units = present_enough(
        archetype_units(holdout_rel).withColumnRenamed("draws", "n_days"),
        holdout_days,
        min_presence_pct,
    )
    keys = WINDOW + ["segment"]
    ranked = units.withColumn(
        "position",
        F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("level"), "first_key")) - 1,
    ).withColumn("n_archetypes", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    per_segment = ranked.groupBy(*keys).agg(
        F.max("n_archetypes").alias("n_archetypes"),
        F.map_from_entries(F.collect_list(F.struct("unit", "position"))).alias("places"),
    )
    place = F.try_element_at("places", F.col("archetype"))
    n = F.col("n_archetypes")
    return (
        winners.select(*keys, "archetype")
        .join(per_segment, keys, "left")
        .select(
            *keys,
            "archetype",
            F.coalesce(n, F.lit(0).cast("long")).alias("n_archetypes"),
            F.when(place.isNull(), None)
            .when(place < n / 2, 100.0)
            .otherwise(0.0)
            .alias("persistence_pct"),
            dec_round(place * 100.0 / F.greatest(n - 1, F.lit(1)), 1).alias(
                "persistence_percentile"
            ),
        )
    )


# -------------------------------------------------------------- duplicates
def pair_correlation(chosen: DataFrame, panel: DataFrame) -> DataFrame:
    """Correlation of the daily margins of each pair of a combination's leaders.

    All days of a leader count, in whatever archetype.  A combination has at most
    ``top`` leaders, so its pairs are few.  Null under three common days or
    without variance.
    """
    daily = panel.select(*WINDOW, "agent_id", "day", "margin").join(
        chosen.select(*COMBO, "agent_id", "pos"), WINDOW + ["agent_id"]
    )
    # One row per combination and day; its pairs are formed inside the row.
    per_day = daily.groupBy(*COMBO, "day").agg(
        F.sort_array(F.collect_list(F.struct("pos", "agent_id", "margin"))).alias("r")
    )
    pairs = per_day.select(
        *COMBO,
        F.inline(
            F.expr(
                "flatten(transform(r, (x, i) -> transform(slice(r, i + 2, size(r)), y -> "
                "struct(x.pos as pos_a, y.pos as pos_b, x.agent_id as agent_a, "
                "y.agent_id as agent_b, x.margin as a, y.margin as b))))"
            )
        ),
    )
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    return pairs.groupBy(*COMBO, "pos_a", "pos_b", "agent_a", "agent_b").agg(
        F.count(F.lit(1)).alias("common_days"),
        F.when(
            (F.count(F.lit(1)) >= 3) & (F.min("a") < F.max("a")) & (F.min("b") < F.max("b")),
            F.try_divide(F.covar_pop("a", "b"), spread),
        ).alias("corr"),
    )


def duplicate_groups(chosen: DataFrame, pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Groups of leaders that behave alike, and the effective number of leaders.

    Leaders with equal (median, mean) form groups; then pairs in rank order whose
    correlation passes the threshold join the first group that holds either.
    Groups may overlap.  Runs on one array of at most ``top`` leaders per row.
    """
    same = (
        chosen.groupBy(*COMBO, "median_margin", "mean_margin")
        .agg(
            F.min("pos").alias("first_pos"),
            F.transform(
                F.sort_array(F.collect_list(F.struct("pos", "agent_id"))), lambda s: s["agent_id"]
            ).alias("members"),
        )
        .groupBy(*COMBO)
        .agg(
            F.sort_array(F.collect_list(F.struct("first_pos", "members"))).alias("g"),
            F.sum(F.size("members")).alias("n_leaders"),
        )
    )
    linked = (
        pairs.where(F.col("corr") > F.lit(float(threshold)))
        .groupBy(*COMBO)
        .agg(
            F.sort_array(F.collect_list(F.struct("pos_a", "pos_b", "agent_a", "agent_b"))).alias("p")
        )
    )
    start = "transform(filter(g, x -> size(x.members) > 1), x -> x.members)"
    where = (
        "array_position(transform(acc, m -> array_contains(m, e.agent_a) "
        "or array_contains(m, e.agent_b)), true)"
    )
    merged = (
        f"aggregate(coalesce(p, cast(array() as array<struct<pos_a:int,pos_b:int,"
        f"agent_a:string,agent_b:string>>)), {start}, (acc, e) -> "
        f"case when {where} > 0 then transform(acc, (m, i) -> case when i + 1 = {where} "
        "then array_union(m, array(e.agent_a, e.agent_b)) else m end) "
        "else concat(acc, array(array(e.agent_a, e.agent_b))) end)"
    )
    grouped = same.join(linked, COMBO, "left").withColumn("groups", F.expr(merged))
    redundant = F.expr("aggregate(groups, 0L, (acc, m) -> acc + size(m) - 1)")
    return grouped.select(
        *COMBO,
        F.col("n_leaders"),
        F.transform("groups", lambda m: F.array_sort(m)).alias("groups"),
        F.greatest(F.lit(1).cast("long"), F.col("n_leaders") - redundant).alias("n_effective"),
    )


# ---------------------------------------------------- sharpe and replication
def sharpe_moments(days: DataFrame, keys: list[str], value: str = "follower_margin") -> DataFrame:
    """Daily Sharpe ratio, biased skewness and Pearson kurtosis of a short series."""
    v = F.col(value)
    m = days.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("avg"),
        F.stddev_samp(v).alias("std"),
        F.skewness(v).alias("skew"),
        (F.kurtosis(v) + 3.0).alias("kurtosis"),
    )
    return m.where((F.col("n") >= 3) & (F.col("std") > 0)).select(
        *keys, "n", (F.col("avg") / F.col("std")).alias("sharpe"), "skew", "kurtosis"
    )


def deflated_sharpe(moments: DataFrame, trials: str = "n_trials", level: float = 0.95) -> DataFrame:
    """Sharpe ratio deflated by the number of trials; one trial deflates nothing."""
    sr, n, t = F.col("sharpe"), F.col("n"), F.col(trials).cast("double")
    tiny = F.lit(1e-12)
    shape = 1.0 - F.col("skew") * sr + (F.col("kurtosis") - 1.0) / 4.0 * sr * sr
    g = F.lit(EULER_GAMMA)
    expected = F.sqrt(F.greatest(shape / (n - 1), tiny)) * (
        (1.0 - g) * normal_ppf(1.0 - 1.0 / t) + g * normal_ppf(1.0 - 1.0 / (t * F.lit(math.e)))
    )
    z = (sr - expected) * F.sqrt(n - F.lit(1.0)) / F.sqrt(F.greatest(shape, tiny))
    raw = F.when(t == 1, F.lit(1.0)).otherwise(normal_cdf(z))
    return (
        moments.where(t >= 1)
        .withColumn("_dsr", raw)
        .withColumn("dsr", dec_round(F.col("_dsr"), 3))
        .withColumn("dsr_significant", F.col("_dsr") >= F.lit(level))
        .withColumn("sharpe", dec_round(sr, 3))
        .withColumn("skew", dec_round(F.col("skew"), 2))
        .withColumn("kurtosis", dec_round(F.col("kurtosis"), 2))
        .drop("_dsr")
    )


def replication_ratio(days: DataFrame, keys: list[str], study_phase: str = "study") -> DataFrame:
    """Eval median over study median of the follower's margin; signs are ignored."""
    m = days.where(F.col("follower_margin").isNotNull())

    def level(cond) -> Column:
        return dec_round(F.median(F.when(cond, F.col("follower_margin"))), 2)

    return (
        m.groupBy(*keys)
        .agg(
            level(F.col("phase") == study_phase).alias("replication_in"),
            level(F.col("phase") == "eval").alias("replication_out"),
        )
        .withColumn(
            "replication_ratio",
            dec_round(
                F.try_divide("replication_out", F.nullif(F.col("replication_in"), F.lit(0.0))), 3
            ),
        )
    )
