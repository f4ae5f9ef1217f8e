"""Rankings, order statistics and selection."""

from __future__ import annotations

import random

import pytest
from helpers import day, labelled, one, panel, upper_median
from pyspark.sql import functions as F

from peerglass.operators import orderstats as OS
from peerglass.operators import panel as PN
from peerglass.operators import rankings as RK
from peerglass.operators import selection as SE
from peerglass.params import MarginModel, Selection


def toy(spark):
    rows = []
    for i in range(3):
        price = dict(contract=300.0, spot=300.0 + 50 * i, scarcity=600.0, day=day(i))
        rows.append(dict(agent_id="REG", demand=1e6, demand_reg=1e6, buy_contract=1e6, buy_contract_reg=1e6, **price))
        rows.append(dict(agent_id="EXP", demand=1e6, demand_unreg=1e6, buy_spot=1.2e6, **price))
    p = PN.with_performance(PN.with_features(panel(spark, rows), MarginModel()), MarginModel())
    cid = F.when(F.col("agent_id") == "REG", 0).otherwise(1)
    return p.withColumns(
        {
            "window_id": F.lit("w"),
            "cluster_id": cid,
            "segment": F.when(F.col("agent_id") == "REG", "LARGE").otherwise("SMALL"),
        }
    )


def test_daily_ranking_and_balance(spark):
    ranking = RK.daily_ranking(toy(spark))
    got = {(r["day"], r["cluster_id"]): r["rank"] for r in ranking.collect()}
    assert all(got[(day(i), 0)] == 1 and got[(day(i), 1)] == 2 for i in range(3))
    bal = {r["cluster_id"]: r for r in RK.period_balance(ranking).collect()}
    assert bal[0]["days_first"] == 3 and bal[1]["days_first"] == 0
    assert bal[0]["pct_top3"] == 100.0 and bal[0]["mean_rank"] == 1.0 and bal[1]["trend"] < 0


def test_ranking_by_segment_and_matrix(spark):
    ranking = RK.daily_ranking(toy(spark), ["segment"])
    assert {r["rank"] for r in ranking.collect()} == {1}
    matrix = RK.archetype_segment_matrix(ranking).collect()
    assert {(r["cluster_id"], r["segment"], r["days"]) for r in matrix} == {(0, "LARGE", 3), (1, "SMALL", 3)}


def test_rank_histogram(spark):
    rows = [("w", day(d), c, r) for d in range(2) for c, r in ((0, 1), (1, 2))]
    df = spark.createDataFrame(rows, "window_id string, day date, cluster_id int, rank int")
    got = {r["cluster_id"]: (r["rank_1"], r["rank_2"]) for r in RK.rank_histogram(df, 2).collect()}
    assert got == {0: (2, 0), 1: (0, 2)}


def test_outliers(spark):
    bal = spark.createDataFrame([("w", 0, 200), ("w", 1, 2)], "window_id string, cluster_id int, days long")
    days = spark.createDataFrame([("w", 212)], "window_id string, n_study_days long")
    got = {r["cluster_id"]: r["is_outlier"] for r in RK.mark_outliers(bal, days, 20.0).collect()}
    assert got == {0: False, 1: True}
    assert not any(r["is_outlier"] for r in RK.mark_outliers(bal, days, 0.0).collect())


@pytest.mark.parametrize("coarse", [False, True])
@pytest.mark.parametrize("skew", [False, True])
def test_order_stats_match_brute_force(spark, coarse, skew):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        k = "hot" if skew and rng.random() < 0.8 else f"k{rng.randrange(7)}"
        v = rng.choice([-500.0, 0.0, 500.0]) if rng.random() < 0.4 else round(rng.gauss(0, 90), 2)
        rows.append((k, v))
    df = spark.createDataFrame(rows, "k string, v double").repartition(11)
    wanted = {"um": "um", "med": "med", "p5": ("nr", 0.05), "p95": ("nr", 0.95), "lo": "min", "hi": "max"}
    got = {r["k"]: r for r in OS.order_stats(df, ["k"], "v", wanted, coarse=coarse).collect()}
    groups: dict = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, vals in groups.items():
        s, n = sorted(vals), len(vals)
        r = got[k]
        assert r["um"] == s[n // 2] and r["med"] == (s[n // 2] + s[(n - 1) // 2]) / 2
        assert r["p5"] == s[round(0.05 * (n - 1))] and r["p95"] == s[round(0.95 * (n - 1))]
        assert r["lo"] == s[0] and r["hi"] == s[-1]


def test_order_stats_mean_and_count(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", None)], "k string, v double")
    r = one(OS.order_stats(df, ["k"], "v", {"um": "um"}, mean="m", count="n"))
    assert (r["um"], r["n"]) == (0.2, 3) and abs(r["m"] - 0.2) < 1e-12


def study(spark, rows, **kw):
    lab = labelled(spark, rows).drop("rel")
    bench = PN.segment_day_benchmark(lab)
    rel = PN.with_relative(lab, bench)
    return rel, SE.leaders(PN.entity_stats(rel), PN.study_days(bench), Selection(**kw))


ABS = [("long", d, "S", "t", m) for d, m in enumerate((3, 9, 4, 8))] + [("short", d, "S", "t", 2) for d in range(2)]


def test_leaders_absolute(spark):
    _, top = study(spark, ABS, top=1, min_presence_pct=0.0, relative=False)
    r = one(top)
    assert (r["agent_id"], r["median_margin"], r["n_days"], r["relative_median"]) == ("long", 8.0, 4, 0.0)
    _, all_ = study(spark, ABS, top=5, min_presence_pct=75.0, relative=False)
    assert [r["agent_id"] for r in all_.collect()] == ["long"]


def test_leaders_relative_beats_absolute(spark):
    """One entity was there on a day that was good for all, the other beats its days."""
    rows = [("lucky", 0, "S", "t", 640), ("able", 1, "S", "t", 45), ("able", 2, "S", "t", 45)]
    rows += [(a, 0, "S", "o", 640) for a in ("p", "q")]
    rows += [(a, d, "S", "o", 20) for a in ("p", "q") for d in (1, 2)]
    _, absolute = study(spark, rows, top=1, min_presence_pct=0.0, relative=False)
    assert [r["agent_id"] for r in absolute.where("archetype = 't'").collect()] == ["lucky"]
    _, relative = study(spark, rows, top=1, min_presence_pct=0.0)
    r = one(relative.where("archetype = 't'"))
    assert (r["agent_id"], r["relative_median"], r["pct_above_segment"]) == ("able", 25.0, 100.0)


def test_leaders_do_not_depend_on_partitioning(spark):
    rng = random.Random(3)
    rows = [
        (f"a{a:02d}", d, rng.choice("SL"), rng.choice("xyz"), rng.randrange(-50, 50))
        for a in range(40)
        for d in range(12)
    ]
    lab = labelled(spark, rows).drop("rel")
    out = []
    for n in (1, 5):
        part = lab.repartition(n)
        bench = PN.segment_day_benchmark(part)
        top = SE.leaders(PN.entity_stats(PN.with_relative(part, bench)), PN.study_days(bench), Selection(top=4))
        out.append(sorted(tuple(r) for r in top.collect()))
    assert out[0] == out[1]
    bench = {(r["segment"], r["day"]): r["bench"] for r in PN.segment_day_benchmark(lab).collect()}
    for (s, d), b in bench.items():
        assert b == upper_median([float(m) for a, i, g, t, m in rows if g == s and day(i) == d])


def test_rank_cut_runs_before_the_shuffle(spark):
    rel, _ = study(spark, ABS)
    bench = PN.segment_day_benchmark(rel)
    plan = SE.leaders(PN.entity_stats(rel), PN.study_days(bench), Selection(top=2))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def test_best_alternative_is_not_the_target(spark):
    rows = [("A", d, "S", "one", 10) for d in range(3)] + [("B", d, "S", "two", 50) for d in range(3)]
    rows += [("C", d, "S", "three", 1) for d in range(3)]
    _, top = study(spark, rows, min_presence_pct=0.0)
    got = {r["archetype"]: r["alt_archetype"] for r in SE.best_alternative(top).collect()}
    assert got == {"one": "two", "two": "one", "three": "two"}


def test_selection_sensitivity(spark):
    rel, _ = study(spark, ABS)
    bench = PN.segment_day_benchmark(rel)
    got = SE.selection_sensitivity(PN.entity_stats(rel), PN.study_days(bench), (1, 3), (10.0, 100.0))
    by = {(r["top"], r["min_presence_pct"]): r["codes"] for r in got.collect()}
    assert by == {(1, 10.0): ["long"], (3, 10.0): ["long", "short"], (1, 100.0): ["long"], (3, 100.0): ["long"]}


def test_leader_weights(spark):
    _, top = study(spark, ABS, min_presence_pct=0.0)
    w = {r["agent_id"]: r["weight"] for r in SE.leader_weights(top).collect()}
    assert abs(sum(w.values()) - 1) < 1e-12 and w["long"] > w["short"]


def test_entity_stats_match_brute_force(spark, monkeypatch):
    """Groups cut by batches, losses, ties and drawdowns, and the values of each group."""
    rng = random.Random(11)
    rows = [
        (f"a{a}", d, rng.choice(("LARGE", "SMALL")), rng.choice("xy"), rng.choice((-500.0, 12.5, round(rng.gauss(0, 90), 2))))
        for a in range(40)
        for d in range(rng.randrange(1, 60))
    ]
    df = labelled(spark, rows).withColumn("rel", F.round(-F.col("rel") / 2, 2))
    sorted_rows = df.orderBy("agent_id", "segment", "archetype", "day").drop("day").toArrow()
    keys = ["window_id", "segment", "archetype", "agent_id"]
    monkeypatch.setattr(PN, "_AT_ONCE", 64)
    small = [b for b in PN._groups_of_entities(iter(sorted_rows.to_batches(max_chunksize=7)), keys, "rel")]
    assert len(small) > 5
    cut = {tuple(r[k] for k in keys): r for b in small for r in b.to_pylist()}
    groups: dict = {}
    for a, d, s, t, m in rows:
        groups.setdefault(("w", s, t, a), []).append((d, m))
    got = {tuple(r[k] for k in keys): r for r in PN.entity_stats(df, "rel").collect()}
    assert got.keys() == groups.keys() == cut.keys()
    for key, days in groups.items():
        margins = [m for _, m in sorted(days)]
        rels = {r["rel"] for r in df.where(F.col("agent_id") == key[3]).take(1)}
        run = peak = depth = 0
        for m in margins:
            run += round(m * 100)
            peak = max(peak, run)
            depth = max(depth, peak - run)
        losses = [m for m in margins if m < 0]
        r = got[key]
        assert rels and r["name"] == key[3] and r["n_days"] == len(margins) == len(r["rels"]) == cut[key]["n_days"]
        assert r["median_margin"] == upper_median(margins) and r["drawdown"] == depth / 100 == cut[key]["depth"] / 100
        assert r["downside_median"] == (upper_median(losses) if losses else 0.0)
        assert r["relative_median"] == r["rels"][len(margins) // 2] == cut[key]["rels"][len(margins) // 2]
        assert r["pct_loss_days"] == pytest.approx(len(losses) * 100 / len(margins), abs=0.0501)


def test_rounding_is_that_of_decimals(spark):
    """Ties, near ties, large values and nulls, at every number of places."""
    from peerglass.functions.numeric import dec_round

    rng = random.Random(3)
    values = [None, 0.0, -0.0, 2.675, -2.675, 1.005, 0.125, 99999999999.995, -1e15 + 0.5, 123456.7850000001, 12345678.785]
    values += [rng.choice((-1, 1)) * rng.randrange(10**7) / rng.choice((8, 1000, 2000, 3, 7)) for _ in range(4000)]
    values += [v / 10 + e for v in range(-50, 50) for e in (0.05, 0.05 + 4e-11, 0.05 - 4e-11, 0.05 + 6e-11, 0.05 - 6e-11, 1e-16)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2, 4, 8):
        exact = F.round(F.col("v").cast("decimal(30,10)"), places).cast("double")
        assert df.where(~exact.eqNullSafe(dec_round(F.col("v"), places))).count() == 0


def test_a_panel_is_shuffled_before_it_repeats_in_windows(spark):
    """Rows that cross the network are entity-days, however many windows they fall in."""
    from datetime import timedelta

    from peerglass.operators import windows as WN

    frame = spark.createDataFrame([(a, day(d), float(d)) for a in ("a", "b", "z") for d in range(20)], "agent_id string, day date, v double")
    windows = [(f"w{i}", day(i), day(i) + timedelta(days=9)) for i in range(8)]
    spans = spark.createDataFrame([(w, "study", s, e) for w, s, e in windows], "window_id string, phase string, start_day date, end_day date")
    sides = spark.createDataFrame(
        [(w, a, a.upper(), "LARGE" if (i + (a == "a")) % 2 else "SMALL") for i, (w, _, _) in enumerate(windows) for a in ("a", "b") if (i, a) != (3, "b")],
        "window_id string, agent_id string, name string, segment string",
    )
    days = WN.phase_days(spans).drop("phase")
    want = PN.attach_segments(WN.by_window(frame, days), sides, keep_unknown=False)
    got = PN.in_windows(frame, days, sides, keep_unknown=False)
    cols = ["window_id", "agent_id", "day", "v", "segment", "name"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    all_rows = PN.in_windows(frame, days, sides)
    assert all_rows.count() == 8 * 10 * 3 and all_rows.where("segment is null").count() == 8 * 10 + 10
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    # The outer join is that of days, the inner one that of entities.
    assert joined.index("(day#") < joined.index("(agent_id#")
