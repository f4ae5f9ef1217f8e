"""Row-wise derivations and segments."""

from __future__ import annotations

import math

from helpers import day, one, panel
from pyspark.sql import functions as F

from peerglass.functions.finance import clip_margin
from peerglass.functions.naming import archetype_name
from peerglass.functions.numeric import same_name
from peerglass.functions.regime import is_scarcity, spread_bin
from peerglass.operators import panel as PN
from peerglass.operators import segments as SG
from peerglass.params import ARCHETYPES, MarginModel, SizeRule, SpreadBins

M = MarginModel()


def test_segment_thresholds(spark):
    totals = [31000.0, 2000.0, 1999.99, 412.5, 100.0, 99.99, 3.2]
    df = spark.createDataFrame([(t,) for t in totals], "t double")
    got = [r[0] for r in df.select(SG.segment_of(F.col("t"), SizeRule())).collect()]
    assert got == ["LARGE"] * 2 + ["MEDIUM"] * 3 + ["SMALL"] * 2


def test_segment_thresholds_scale_with_the_window(spark):
    rule = SizeRule(large_min=30.0, medium_min=15.0, per_days=30)
    df = spark.createDataFrame([(3.0,), (2.0,), (1.0,)], "t double")
    got = [r[0] for r in df.select(SG.segment_of(F.col("t"), rule, F.lit(3))).collect()]
    assert got == ["LARGE", "MEDIUM", "SMALL"]


def test_population_and_summary(spark):
    pop = spark.createDataFrame(
        [
            ("w", "north", "N", 2400.0, 600.0, 1800.0),
            ("w", "east", "E", 540.0, 540.0, 0.0),
            ("w", "west", "W", 60.0, None, 60.0),
        ],
        "window_id string, agent_id string, name string, total_gwh double, reg_gwh double, unreg_gwh double",
    )
    seg = SG.segment_population(pop, SizeRule())
    by = {r["agent_id"]: r for r in seg.collect()}
    assert [by[a]["segment"] for a in ("north", "east", "west")] == ["LARGE", "MEDIUM", "SMALL"]
    assert by["north"]["pct_unreg"] == 75.0 and by["west"]["pct_reg"] == 0.0
    summary = {r["segment"]: r for r in SG.segment_summary(seg, SizeRule()).collect()}
    assert summary["LARGE"]["market_share_pct"] == 80.0
    assert summary["SMALL"]["market_share_pct"] == 2.0
    assert summary["LARGE"]["unreg_gwh"] == 1800.0


def test_summary_keeps_empty_segments(spark):
    seg = spark.createDataFrame(
        [("w", "A", 5000.0, 60.0, 40.0, "LARGE")],
        "window_id string, agent_id string, total_gwh double, pct_reg double, pct_unreg double, segment string",
    )
    got = {r["segment"]: r["n"] for r in SG.segment_summary(seg, SizeRule()).collect()}
    assert got == {"LARGE": 1, "MEDIUM": 0, "SMALL": 0}


def test_features(spark):
    rows = [
        dict(agent_id="A", day=day(0), demand=8e5, demand_reg=2e5, demand_unreg=6e5, buy_contract=4e5,
             buy_contract_reg=1.6e5, buy_spot=2e5, buy_auction=4e4),
        dict(agent_id="B", day=day(0), demand=70.0, demand_unreg=70.0, buy_spot=70.0),
        dict(agent_id="C", day=day(0), demand=50.0, demand_reg=50.0, buy_contract_reg=8.0, buy_auction=90.0),
    ]
    got = {r["agent_id"]: r for r in PN.with_features(panel(spark, rows), M).collect()}
    a = got["A"]
    assert (a["pct_unregulated"], a["pct_contract"], a["pct_spot"], a["pct_auction"]) == (75.0, 50.0, 25.0, 25.0)
    assert a["has_auction"] == 1.0 and a["log_demand"] == round(math.log1p(0.8), 4)
    assert (got["B"]["pct_auction"], got["B"]["has_auction"], got["B"]["pct_unregulated"]) == (0.0, 0.0, 100.0)
    assert got["C"]["pct_auction"] == 100.0


def test_financial_model_by_hand(spark):
    row = dict(agent_id="A", day=day(0), demand=1000.0, buy_contract=1000.0, contract=300.0, spot=350.0)
    got = one(PN.with_performance(panel(spark, [row]), MarginModel(margin_clip=None), full=True))
    income, cost = 1000 * 350.0, 1000 * 300.0
    gross = income - cost - 1000 * 76.1
    guarantee = cost * 0.25
    net = gross - max(0.0, gross * 0.33) - guarantee * 0.02 / 12 - income * 0.02
    assert got["margin"] == round(net / 1000, 2)
    assert got["unit_cost"] == 300.0
    assert got["guarantee"] == round(guarantee) and got["net_profit"] == round(net)


def test_margin_of_zero_demand_is_zero(spark):
    row = dict(agent_id="A", day=day(0), contract=300.0, spot=350.0)
    got = one(PN.with_performance(panel(spark, [row]), M))
    assert got["margin"] == 0.0 and got["unit_cost"] == 0.0


def test_margin_clip(spark):
    df = spark.createDataFrame([(900.0,), (-900.0,), (3.0,)], "m double")
    clip = lambda limit: [r[0] for r in df.select(clip_margin(F.col("m"), limit)).collect()]
    assert clip(500.0) == [500.0, -500.0, 3.0]
    assert clip(None) == [900.0, -900.0, 3.0]


def test_archetype_rules_in_order(spark):
    cases = [
        (90.0, 0.0, 90.0, 0.0, 0.0),
        (50.0, 130.0, 0.0, 0.0, 0.0),
        (50.0, 10.0, 70.0, 0.0, 0.0),
        (10.0, 90.0, 5.0, 60.0, 0.0),
        (10.0, 90.0, 20.0, 60.0, 0.0),
        (50.0, 90.0, 20.0, 60.0, 6.0),
        (50.0, 90.0, 20.0, 60.0, 0.0),
        (50.0, 90.0, 20.0, 10.0, 0.0),
    ]
    df = spark.createDataFrame(cases, "u double, c double, s double, a double, l double")
    got = df.select(archetype_name(*[F.col(x) for x in "ucsal"]))
    assert [r[0] for r in got.collect()] == list(ARCHETYPES)


def test_spread_bins(spark):
    bins = SpreadBins((("low", -999999, 0), ("b1", 0, 200), ("b2", 200, 400), ("top", 400, 999999)))
    values = [-10.0, 0.0, 199.0, 250.0, 500.0, -1e7, 1e7]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = [r[0] for r in df.select(spread_bin(F.col("s"), bins)).collect()]
    assert got == ["low", "b1", "b1", "b2", "top", "low", "top"]


def test_scarcity_and_names(spark):
    df = spark.createDataFrame([(10.0, 5.0, " Abc ", "aBC")], "spot double, lim double, a string, b string")
    got = one(df.select(is_scarcity(F.col("spot"), F.col("lim")).alias("x"), same_name(F.col("a"), F.col("b")).alias("y")))
    assert got["x"] and got["y"]
