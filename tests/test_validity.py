"""Bootstrap, holdout, duplicates, Sharpe, replication."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from helpers import day, labelled, one
from pyspark.sql import functions as F

from peerglass.functions.medians import best_median_at, log_binomial_tail
from peerglass.operators import COMBO, WINDOW
from peerglass.operators import panel as PN
from peerglass.operators import validity as VA

SEG = WINDOW + ["segment"]


def rel_of(spark, rows):
    lab = labelled(spark, rows).drop("rel")
    bench = PN.segment_day_benchmark(lab)
    return PN.with_relative(lab, bench), PN.study_days(bench)


def boot(spark, rows, value="margin", **kw):
    rel, _ = rel_of(spark, rows)
    stats = PN.entity_stats(rel)
    return VA.bootstrap_best_median(
        VA.bootstrap_units(stats, value == "rel"), rel, value=value, **kw
    )


@pytest.mark.parametrize("draws", ["class", "xxhash64", "md5"])
def test_bootstrap_without_skill(spark, draws):
    rows = [(a, d, "S", "t", 5) for a in "ABC" for d in range(4)]
    r = one(boot(spark, rows, n_boot=100, draws=draws))
    assert r["p_value"] == 1.0 and r["boot_best"] == 5.0 and r["n_units"] == 3
    assert r["boot_null_p50"] == 5.0 and r["boot_percentile"] == 100.0


def test_bootstrap_statistic_is_the_best_median(spark):
    rows = [(a, d, "S", "t", m) for a, m in (("A", 1), ("B", 2), ("C", 100)) for d in range(5)]
    r = one(boot(spark, rows, n_boot=200))
    assert r["boot_best"] == 100.0 and r["n_pool"] == 15


def closed_form(units, pool, best):
    """Chance that the best redrawn upper median reaches ``best``."""
    below = sum(v < best for v in pool) / len(pool)
    miss = 1.0
    for c in units:
        need = c // 2 + 1
        miss *= sum(math.comb(c, k) * below**k * (1 - below) ** (c - k) for k in range(need, c + 1))
    return 1.0 - miss


@pytest.mark.parametrize("draws", ["class", "xxhash64", "md5"])
def test_bootstrap_agrees_with_the_closed_form(spark, draws):
    rng = random.Random(11)
    counts = {"A": 9, "B": 14, "C": 5, "D": 21}
    rows = [
        (a, d, "S", "t", round(rng.gauss(3.0 if a == "B" else 0.0, 5.0), 1))
        for a, c in counts.items()
        for d in range(c)
    ]
    n = 4000
    r = one(boot(spark, rows, n_boot=n, draws=draws))
    pool = [float(x[4]) for x in rows]
    best = max(sorted(float(x[4]) for x in rows if x[0] == a)[c // 2] for a, c in counts.items())
    want = closed_form(counts.values(), pool, best)
    assert r["boot_best"] == round(best, 2)
    assert abs(r["p_value"] - want) < 4 * math.sqrt(want * (1 - want) / n) + 1 / n


def exact_tail(n, least, p):
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


def test_binomial_tails_against_the_sum():
    cases = [(n, k, p) for n in (1, 2, 3, 10, 91, 400) for k in {0, 1, n // 2, n // 2 + 1, n, n + 1}
             for p in (Fraction(0), Fraction(1, 1000), Fraction(1, 3), Fraction(1, 2), Fraction(999, 1000), Fraction(1))]
    n, k, p = (np.array([float(c[i]) for c in cases]) for i in range(3))
    got = np.exp(log_binomial_tail(n, k, p))
    want = [float(exact_tail(*c)) for c in cases]
    assert np.allclose(got, want, rtol=1e-9, atol=1e-280)
    # Large numbers of draws: both sides of the mean add up.
    for size in (10**4, 10**6):
        for x in (0.49, 0.5, 0.501):
            r = size // 2 + 1
            up, down = np.exp(log_binomial_tail([size, size], [r, size - r + 1], [x, 1 - x]))
            assert abs(up + down - 1) < 1e-8


def test_replicates_are_the_least_positions_that_reach_their_number(spark):
    rng = random.Random(8)
    rows = [(rng.random(), n, [rng.choice((1, 2, 9, 40)) for _ in range(3)], [rng.choice((1, 30)) for _ in range(3)])
            for n in (1, 2, 7, 50, 900) for _ in range(6)]
    df = spark.createDataFrame(rows, "u double, n long, d array<long>, m array<long>")
    for r in df.select("*", best_median_at("u", "n", "d", "m").alias("j")).collect():

        def chance(j, r=r):
            tails = [float(exact_tail(d, d // 2 + 1, Fraction(j + 1, r.n))) ** m for d, m in zip(r.d, r.m, strict=True)]
            return math.prod(tails)

        assert chance(r.j) >= r.u - 1e-9 and (r.j == 0 or chance(r.j - 1) < r.u + 1e-9)


def test_bootstrap_does_not_depend_on_partitioning(spark):
    rng = random.Random(5)
    rows = [(f"a{i}", d, "S", "t", rng.randrange(100)) for i in range(9) for d in range(6)]
    rel, _ = rel_of(spark, rows)
    out = []
    for n in (1, 6):
        part = rel.repartition(n)
        units = VA.bootstrap_units(PN.entity_stats(part))
        out.append(tuple(one(VA.bootstrap_best_median(units, part, n_boot=150))))
    assert out[0] == out[1]


def test_bootstrap_by_archetype_names_the_best(spark):
    rows = [(a, d, "S", "best", m) for a, m in (("A", 100), ("B", 90)) for d in range(3)]
    rows += [(a, d, "S", "rest", 0) for a in "CDEF" for d in range(3)]
    rel, _ = rel_of(spark, rows)
    units = VA.archetype_units(rel)
    r = one(VA.bootstrap_best_median(units, rel, keys=SEG, n_boot=200))
    assert r["n_units"] == 2 and r["p_value"] < 1.0
    assert one(VA.best_archetype(units))["archetype"] == "best"


def leaders_frame(spark, rows):
    """Rows (agent, median, mean)."""
    data = [("w", "S", "t", a, i + 1, float(md), float(mn), 3) for i, (a, md, mn) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "window_id string, segment string, archetype string, agent_id string, pos int, "
        "median_margin double, mean_margin double, n_days long",
    )


def test_holdout_persistence(spark):
    rows = [("A", d, "S", "t", 50) for d in range(3)] + [("B", d, "S", "t", -50) for d in range(3)]
    rel, days = rel_of(spark, rows)
    both = one(VA.holdout_persistence(leaders_frame(spark, [("A", 1, 1), ("B", 1, 1)]), rel, days, 0.0))
    assert both["persistence_pct"] == 50.0 and both["n_holdout"] == 2 and both["persistence_percentile"] == 50.0
    worst = one(VA.holdout_persistence(leaders_frame(spark, [("B", 1, 1)]), rel, days, 0.0))
    assert worst["persistence_pct"] == 0.0 and worst["persistence_percentile"] == 100.0
    absent = one(VA.holdout_persistence(leaders_frame(spark, [("Z", 1, 1)]), rel, days, 0.0))
    assert absent["persistence_pct"] == 0.0 and absent["persistence_percentile"] is None
    nobody = one(VA.holdout_persistence(leaders_frame(spark, [("A", 1, 1)]), rel.where("false"), days, 0.0))
    assert nobody["n_holdout"] == 0 and nobody["persistence_pct"] is None


def test_holdout_positions_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"a{i:03d}", d, "S", "t", rng.randrange(6)) for i in range(60) for d in range(3)]
    rel, days = rel_of(spark, rows)
    led = ["a003", "a017", "a040"]
    r = one(VA.holdout_persistence(leaders_frame(spark, [(a, 1, 1) for a in led]), rel, days, 0.0))
    level = {}
    for a, _, _, _, m in rows:
        level.setdefault(a, []).append(m)
    order = sorted(level, key=lambda a: (-sorted(level[a])[1], a))
    pos = [order.index(a) for a in led]
    assert r["persistence_pct"] == round(100 * sum(p < 30 for p in pos) / 3, 1)
    assert r["persistence_percentile"] == round(100 * sorted(pos)[1] / 59, 1)


def test_archetype_persistence(spark):
    rows = [("A", d, "S", "good", 50) for d in range(3)] + [("B", d, "S", "bad", -50) for d in range(3)]
    rel, days = rel_of(spark, rows)
    w = spark.createDataFrame([("w", "S", "good")], "window_id string, segment string, archetype string")
    r = one(VA.archetype_persistence(w, rel, days, 0.0))
    assert (r["n_archetypes"], r["persistence_pct"], r["persistence_percentile"]) == (2, 100.0, 0.0)
    bad = one(VA.archetype_persistence(w.withColumn("archetype", F.lit("bad")), rel, days, 0.0))
    assert (bad["persistence_pct"], bad["persistence_percentile"]) == (0.0, 100.0)
    none = one(VA.archetype_persistence(w.withColumn("archetype", F.lit("x")), rel, days, 0.0))
    assert none["persistence_pct"] is None


def test_duplicates(spark):
    series = {"A": [1, 2, 3, 4], "B": [2, 3, 4, 5], "C": [9, 4, 3, 1]}
    rel = labelled(spark, [(a, d, "S", "t", m) for a, v in series.items() for d, m in enumerate(v)])
    top = leaders_frame(spark, [("A", 3, 2.5), ("B", 4, 3.5), ("C", 4, 4.25)])
    pairs = VA.pair_correlation(top, rel)
    corr = {(r["agent_a"], r["agent_b"]): r["corr"] for r in pairs.collect()}
    assert corr[("A", "B")] == pytest.approx(1.0) and corr[("A", "C")] < 0
    r = one(VA.duplicate_groups(top, pairs))
    assert r["groups"] == [["A", "B"]] and r["n_effective"] == 2


def test_duplicates_equal_levels_and_overlap(spark):
    flat = labelled(spark, [(a, d, "S", "t", 5) for a in "ABC" for d in range(4)])
    top = leaders_frame(spark, [("A", 5, 5), ("B", 5, 5), ("C", 5, 5)])
    pairs = VA.pair_correlation(top, flat)
    assert all(r["corr"] is None for r in pairs.collect())
    r = one(VA.duplicate_groups(top, pairs))
    assert r["groups"] == [["A", "B", "C"]] and r["n_effective"] == 1
    links = spark.createDataFrame(
        [("w", "S", "t", 1, 3, "A", "C", 4, 0.95), ("w", "S", "t", 3, 4, "C", "D", 4, 0.95), ("w", "S", "t", 2, 4, "B", "D", 4, 0.95)],
        "window_id string, segment string, archetype string, pos_a int, pos_b int, agent_a string, agent_b string, common_days long, corr double",
    )
    four = leaders_frame(spark, [("A", 1, 1), ("B", 2, 2), ("C", 3, 3), ("D", 4, 4)])
    r = one(VA.duplicate_groups(four, links))
    assert r["groups"] == [["A", "C", "D"], ["B", "D"]] and r["n_effective"] == 1


def sims(spark, values, phase="eval"):
    data = [("w", "S", "t", phase, day(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(
        data, "window_id string, segment string, archetype string, phase string, day date, follower_margin double"
    )


def test_replication_ratio(spark):
    df = sims(spark, [-100, -100], "study").unionByName(sims(spark, [-50, -50]))
    assert one(VA.replication_ratio(df, COMBO))["replication_ratio"] == 0.5
    zero = sims(spark, [0, 0], "study").unionByName(sims(spark, [-50]))
    assert one(VA.replication_ratio(zero, COMBO))["replication_ratio"] is None


def test_deflated_sharpe(spark):
    rng = random.Random(1)
    values = [round(rng.gauss(0.3, 1.0), 2) for _ in range(60)]
    m = VA.sharpe_moments(sims(spark, values), COMBO)
    got = {t: one(VA.deflated_sharpe(m.withColumn("n_trials", F.lit(t)))) for t in (1, 2, 50)}
    n = len(values)
    mean = sum(values) / n
    m2 = sum((v - mean) ** 2 for v in values) / n
    sr = mean / math.sqrt(m2 * n / (n - 1))
    skew = sum((v - mean) ** 3 for v in values) / n / m2**1.5
    kurt = sum((v - mean) ** 4 for v in values) / n / m2**2
    assert got[2]["sharpe"] == round(sr, 3) and got[2]["skew"] == round(skew, 2)
    assert got[2]["kurtosis"] == round(kurt, 2)
    assert got[1]["dsr"] == 1.0 and got[50]["dsr"] < got[2]["dsr"] < 1.0


def test_sharpe_needs_three_values_and_variance(spark):
    assert VA.sharpe_moments(sims(spark, [1, 2]), COMBO).count() == 0
    assert VA.sharpe_moments(sims(spark, [1, 1, 1]), COMBO).count() == 0
