"""Sources, sinks, composed plans, and queries against their SQL twins."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import spark_queries as Q
from peerglass.operators import COMBO, WINDOW
from peerglass.operators import rollups as RU
from peerglass.operators import windows as WN
from peerglass.params import SpreadBins
from peerglass.plans import acceptance as AC
from peerglass.plans import assess as AS
from peerglass.plans import scan as SN
from peerglass.plans import study as ST
from peerglass.sources import proxies as PX
from peerglass.sources import sinks as SK
from peerglass.sources import tables as TB
from peerglass.sources.tables import durable, stored_tables
from tools.check import TABLES, rows_of


# ------------------------------------------------------------------ sources
def test_time_filter_reaches_the_scan(spark, sf_dir):
    df = TB.between(spark.read.parquet(f"{sf_dir}/events.parquet"), "2024-01-05", "2024-01-08")
    days = {r[0] for r in df.select(F.to_date("ts")).distinct().collect()}
    assert {str(d) for d in days} == {"2024-01-05", "2024-01-06", "2024-01-07"}
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in df._jdf.queryExecution().toString()


def test_rollup_leaves_out_days_between_windows(spark, sf_dir):
    windows = spark.sql(
        "select * from values (date'2024-01-03', date'2024-01-05'), (date'2024-01-05', date'2024-01-06'), (date'2024-01-12', date'2024-01-13') t(start_day, end_day)"
    )
    market, settings = PX.from_events(spark, sf_dir), PX.event_settings()
    some, every = ST.daily(market, settings, windows=windows).volumes, ST.daily(market, settings).volumes
    wanted = "day between '2024-01-03' and '2024-01-06' or day between '2024-01-12' and '2024-01-13'"
    rows = sorted(map(str, every.where(wanted).collect()))
    assert sorted(map(str, some.collect())) == rows and rows


def test_rollup_reads_only_what_it_needs(spark, sf_dir):
    volumes = ST.daily(PX.from_events(spark, sf_dir), PX.event_settings()).volumes
    plan = volumes.select("agent_id", "day", "demand")
    text = plan._jdf.queryExecution().toString()
    assert "ReadSchema: struct<ts:timestamp" in text and "props" not in text.split("== Physical Plan ==")[1]


def test_named_parameters(spark):
    spark.range(5).createOrReplaceTempView("t5")
    assert TB.run_query(spark, "SELECT * FROM t5 WHERE id >= :lo AND id < :hi", lo=1, hi=3).count() == 2


def test_durable_roundtrip(spark):
    df = TB.durable(spark.range(10).withColumn("x", F.lit("a")), "t")
    assert df.count() == 10 and df.columns == ["id", "x"]
    path = df.inputFiles()[0]
    assert os.path.exists(path.removeprefix("file://"))
    assert TB.workspace(spark) == spark.conf.get("spark.checkpoint.dir")


def test_entity_days_rules(spark):
    hourly = spark.createDataFrame(
        [("A", "2024-01-01 01:00:00", 5.0), ("A", "2024-01-01 23:00:00", 6.0), ("A", "2024-01-02 00:00:00", 1.0),
         ("B", "2024-01-01 05:00:00", 0.0), ("C", "2024-01-01 05:00:00", 9.0)],
        "agent_id string, ts string, demand double",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for m in TB.MEASURES[1:]:
        hourly = hourly.withColumn(m, F.lit(None).cast("double"))
    agents = spark.createDataFrame([("A", "a", "x"), ("B", "b", "x"), ("C", "c", "y")], "agent_id string, name string, activity string")
    prices = spark.createDataFrame([("2024-01-01", 1.0, None, 3.0)], "day string, contract double, spot double, scarcity double").withColumn("day", F.col("day").cast("date"))
    daily = RU.daily_volumes(hourly)
    rows = RU.entity_days(daily, agents, prices, ("x",)).collect()
    # B has no demand, C another activity, 2 January no price row; nulls become zero.
    assert [(r["agent_id"], str(r["day"]), r["demand"], r["demand_reg"], r["spot"]) for r in rows] == [("A", "2024-01-01", 11.0, 0.0, 0.0)]
    assert RU.duplicate_keys(daily, ["agent_id", "day"]).count() == 0
    pop = RU.population(daily.withColumn("window_id", F.lit("w")), agents, ("x",)).collect()
    assert [(r["agent_id"], r["total_gwh"]) for r in pop] == [("A", 0.0)]
    level = spark.createDataFrame([(1, 10.0, 0.0)], "day int, useful_volume double, useful_capacity double")
    assert RU.reservoir_level(level).first()["level_pct"] is None


def test_bins_are_checked():
    with pytest.raises(ValueError):
        SpreadBins(())
    with pytest.raises(ValueError):
        SpreadBins((("a", 1.0, 1.0),))


# ------------------------------------------------------- plans on small data
@pytest.fixture(scope="module")
def assessed(spark, sf_dir):
    return Q.event_assessment(spark, sf_dir)


def test_assessment_invariants(assessed):
    e, a, levels = assessed
    n = a.summary.count()
    assert n == a.summary.select(*COMBO).distinct().count() == a.leaders.select(*COMBO).distinct().count()
    for r in a.summary.collect():
        assert 0 < r["p_value"] <= 1 and r["drawdown"] >= 0 and 1 <= r["n_effective"] <= r["n_leaders"]
    bins = set(e.settings.bins.names)
    assert {r["bin"] for r in a.rules.where("bin is not null").collect()} <= bins
    assert a.leaders.agg(F.max("pos")).first()[0] <= e.settings.selection.top
    alt = AS.alternatives(a, e.settings, levels)
    assert alt.where("segment = target_segment and archetype = target_archetype").count() == 0


def test_result_tables(assessed, tmp_path):
    e, a, _ = assessed
    n = a.summary.count()
    policy = SK.policy_table(a.rules, e.settings.bins, COMBO)
    assert policy.count() == n * (len(e.settings.bins.names) + 1)
    assert policy.where("bin = 'FALLBACK'").count() == n
    assert SK.summary_table(a.summary, COMBO).count() == 10 * n
    dist = SK.distribution_table(a.distributions, COMBO)
    assert set(dist.columns) == {*COMBO, "metric", "follower_margin", "leaders_margin", "segment_margin"} and dist.count() == 9 * n
    assert len(dist.columns) == len(set(dist.columns))
    assert SK.stress_table(a.stress, COMBO).count() == 2 * n
    days = SK.simulated_days_table(a.replay.days.where("phase = 'eval'"), COMBO)
    assert {r[0] for r in days.select("is_scarcity_1_0").distinct().collect()} <= {0, 1}
    assert SK.leaders_table(a.leaders, COMBO).columns[3] == "pos"
    validity = SK.validity_table(a.summary.withColumn("boot_units", F.col("n_trials")).withColumn("dsr_significant", F.col("dsr_significant").cast("int")), COMBO)
    assert validity.where("value is null").count() == 0
    SK.write_csv(policy, str(tmp_path / "policy"))
    files = [f for f in os.listdir(tmp_path / "policy") if f.endswith(".csv")]
    head = open(tmp_path / "policy" / files[0], encoding="utf-8").readline().strip().split(",")
    assert head == policy.columns
    SK.write_parquet(policy, str(tmp_path / "parquet"), by=["segment"])
    assert e.market.prices.sparkSession.read.parquet(str(tmp_path / "parquet")).count() == policy.count()


def test_a_rerun_leaves_one_copy(spark, tmp_path):
    path, schema = str(tmp_path / "published"), "window_id string, day string, n long"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    rows = lambda df: sorted(map(tuple, df.collect()))
    first = make(("2020-01-01", "a", 1), ("2020-01-01", "b", 2), ("w1", "a", 3))
    for _ in range(2):
        got = SK.publish(first, path, ["window_id", "day"])
        assert got.columns == first.columns and got.schema["window_id"].dataType.simpleString() == "string"
        assert rows(got) == rows(first)
    # A window that is computed again is replaced, late rows and fewer rows alike; others stay.
    again = SK.publish(make(("2020-01-01", "a", 7)), path, ["window_id", "day"])
    assert rows(again) == [("2020-01-01", "a", 7), ("w1", "a", 3)]
    for bad in (make(("w1", "a", 1), ("w1", "a", 2)), make((None, "a", 1))):
        with pytest.raises(ValueError):
            SK.publish(bad, path, ["window_id", "day"])
    assert rows(spark.read.schema(schema).parquet(path).select("window_id", "day", "n")) == rows(again)
    assert rows(SK.publish(make(), path, ["window_id", "day"])) == rows(again)
    assert SK.publish(make(), str(tmp_path / "none"), ["day"]).count() == 0


def test_regime_table(spark, sf_dir):
    e = Q.events(spark, sf_dir)
    from peerglass.operators import series as SR

    p = e.market.prices
    t = SK.regime_table(SR.regime_by_bin(p, e.settings.bins), SR.regime_total(p), SR.regime_by_year(p))
    kinds = {r["kind"] for r in t.collect()}
    assert kinds == {"bin_frequency", "scarcity_days", "spread_p50", "spread_p95", "spread_p99", "spread_max", "year"}


def test_weekly_tables(spark, sf_dir, assessed):
    e = Q.events(spark, sf_dir)
    target = assessed[1].summary.orderBy("segment", "archetype").first()
    out = AC.weekly(
        ST.daily(e.market, e.settings, store=True), e.market, e.settings, e.windows,
        Q.SR.regime_total(e.market.prices), target["segment"], f"  {target['archetype'].upper()} ", RU.reservoir_level(e.market.reservoirs),
    )
    v = out["verdict"].first()
    assert v["operate"] == (v["by_leaders"] or v["by_archetype"])
    assert out["kpis"].count() == 8 and {r["state"] for r in out["kpis"].collect()} <= {"ok", "warn", "bad"}
    series = SK.weekly_table(out["series"], WINDOW)
    assert series.count() == 7 and series.where("follower_margin is null").count() == 0
    assert out["profile"].count() == 1 and out["realised"].count() == 1 and out["regime"].first()["n_days"] == 7
    assert out["archetype_winners"].count() == 1


def test_series_wait_for_no_verdict(spark, sf_dir, monkeypatch):
    def asked(*_, **__):
        raise AssertionError("not needed for the series")

    for module, name in ((SN, "leader_bootstrap"), (SN, "effective_leaders"), (SN, "scan_archetypes"), (AS, "alternatives")):
        monkeypatch.setattr(module, name, asked)
    assert entry.queries()["weekly_series"](spark, sf_dir).count() == 7
    assert entry.queries()["table_simulated_days"](spark, sf_dir).count() > 0


def test_study_tables(spark, sf_dir):
    e = Q.events(spark, sf_dir)
    tables = ST.study_tables(Q.stored_study(e), e.settings)
    ranks = tables["ranking"].groupBy("day").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(list(r["r"]) == list(range(1, len(r["r"]) + 1)) for r in ranks)
    for name in ("segments", "segment_summary", "profiles", "balance", "ranking_by_segment", "balance_by_segment", "archetype_by_segment", "rank_histogram"):
        assert tables[name].count() > 0, name


def test_acceptance_confirms_what_it_picked(spark, sf_dir):
    o = Q.orders(spark, sf_dir, study=90, evald=7, step=700)
    out = AC.acceptance(o.daily(), o.market, o.settings, o.windows, o.regime, o.levels)
    key = ["mode", "window_id", "segment"]
    assert out["scan"].where("persistence is not null").count() == 0
    assert out["confirmed"].join(out["picked"], key, "left_anti").count() == 0
    assert SK.scan_table(out["scan"].where("mode = 'leaders'")).count() > 0
    assert SK.archetype_scan_table(out["scan"].where("mode = 'archetype'")).count() > 0
    order = AC.confirmed_order(SK.confirmed_table(out["confirmed"]).withColumns({"mode": F.lit("x"), "valid_final": F.col("valid_final_1_0"), "window_id": F.lit("")}))
    assert order.count() == out["confirmed"].count()
    # Studies of different windows are independent of each other.
    first = o.windows.orderBy("window_id").limit(1)
    single = AC.coarse_scan(o.daily(), o.market, o.settings, TB.durable(first, "first"), o.regime, o.levels)
    both = out["scan"].join(first.select("window_id"), "window_id", "left_semi").select(single.columns)
    a = sorted(map(str, single.collect()))
    assert a == sorted(map(str, both.collect())) and a


def test_acceptance_builds_each_study_once(spark, sf_dir, monkeypatch):
    o = Q.orders(spark, sf_dir, study=90, evald=7, step=1200)
    built, build = [], ST.study
    monkeypatch.setattr(ST, "study", lambda d, m, s, spans, *a, **k: built.append(spans) or build(d, m, s, spans, *a, **k))
    AC.acceptance(o.daily(), o.market, o.settings, o.windows, o.regime, o.levels)
    assert len(built) == 3  # the grid's, and the picked windows' without and with their last days only


# --------------------------------------------------------------- SQL twins
LIGHT = [
    "population_rollup", "agent_day_rollup", "segment_summary", "financial_model", "period_balance_by_segment",
    "leaders_relative", "best_alternative", "policy_fit_archetype", "backtest_days", "bootstrap_best_median",
    "holdout_persistence", "duplicates_n_effective", "window_join", "walk_forward_grid",
]


@pytest.fixture(scope="module")
def twin(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", LIGHT)
def test_query_matches_its_sql_twin(spark, sf_dir, twin, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = twin.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_daily_reads_the_hours_of_the_windows_only(spark, sf_dir):
    market = PX.from_orders(spark, sf_dir)
    grid = WN.window_grid(WN.data_edges(market.prices), 90, 7, 365).limit(1)
    d = ST.daily(market, PX.order_settings(), windows=grid)
    plan = d.volumes._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed
    w = grid.first()
    days = d.volumes.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    assert w["study_start"] <= days["a"] and days["b"] <= w["eval_end"]


def test_stored_tables_go_with_their_run(spark):
    outer = durable(spark.range(3), "kept")
    with stored_tables(spark) as paths:
        inner = durable(spark.range(4), "gone")
        assert inner.count() == 4 and len(paths) == 1
    assert outer.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(paths[0]).count()
