"""The result tables and the weekly tables as queries: each is published, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import oracle_sql as O
import spark_queries as Q
from peerglass import params as P
from peerglass.functions.shares import SHARES
from peerglass.operators import COMBO, WINDOW
from peerglass.operators import series as SR
from peerglass.operators.scorecard import KPI_LEVELS
from peerglass.plans import acceptance as AC
from peerglass.sources import proxies as PX
from peerglass.sources import sinks as SK
from peerglass.sources.tables import workspace

BIG, DAY, query = Q.BIG, Q.DAY, Q.query
B = lambda x: f"CAST({x} AS BIGINT)"


def published(table: DataFrame, keys: list[str]) -> DataFrame:
    """The table by way of a folder of its own in the shared one."""
    path = f"{workspace(table.sparkSession).rstrip('/')}/peerglass/published-{uuid.uuid4().hex}"
    return SK.publish(table, path, keys)


# ------------------------------------------------- tables of a full assessment
_PERCENTILE = f"""
heldp AS (SELECT l.window_id, l.segment, l.archetype, {O.R('median(position / greatest(n_holdout - 1, 1)) * 100.0', 1)} AS persistence_percentile
 FROM leaders l LEFT JOIN (SELECT {O.CMB}, agent_id, position FROM hs) h USING ({O.CMB}, agent_id) LEFT JOIN hn USING ({O.CMB}) GROUP BY l.window_id, l.segment, l.archetype),
"""
_ALL = (
    Q._ASSESS_CH + Q._PERSIST + _PERCENTILE
    + O.scan_sql(1000, "persistence_pct", f"LEFT JOIN held USING ({O.CMB}) LEFT JOIN heldp USING ({O.CMB})").replace(
        "AS persistence\n", "AS persistence, persistence_pct, persistence_percentile\n"
    )
)


def long(metrics: dict[str, str], table: str, keys: str, keep_nulls: bool = True) -> str:
    """A row per metric: the named expressions of ``table``, one below the other."""
    rows = " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS metric, CAST({x} AS DOUBLE) AS value FROM {table}" for name, x in metrics.items()
    )
    return rows if keep_nulls else f"SELECT * FROM ({rows}) WHERE value IS NOT NULL"


@query("table_leaders", Q.sel(Q._LEAD, "leaders", ch=Q._ASSESS_CH))
def table_leaders(spark, sf):
    return published(SK.leaders_table(Q.event_assessment(spark, sf)[1].leaders, COMBO), [*COMBO, "pos"])


_BINS = ", ".join(f"('{n}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for n, lo, hi in PX.EVENT_BINS.bins)
_SH = ", ".join(SHARES)


@query(
    "table_policy",
    Q.sel(
        f"{O.CMB}, bin, lo, hi, CAST(coalesce(n_days, 0) AS BIGINT) AS n_days, {_SH}",
        f"(SELECT DISTINCT {O.CMB} FROM fit) CROSS JOIN (VALUES {_BINS}) v(bin, lo, hi) LEFT JOIN (SELECT {O.CMB}, bin, n_days, {_SH} FROM fit) USING ({O.CMB}, bin)",
        f"UNION ALL SELECT {O.CMB}, 'FALLBACK', NULL, NULL, CAST(n_days AS BIGINT), {_SH} FROM fit WHERE bin IS NULL",
        ch=Q._ASSESS_CH,
    ),
)
def table_policy(spark, sf):
    e, a, _ = Q.event_assessment(spark, sf)
    return published(SK.policy_table(a.rules, e.settings.bins, COMBO), [*COMBO, "bin"])


@query(
    "table_simulated_days",
    Q.sel(
        f"{O.CMB}, {DAY}, bin, {B('is_scarcity')} AS is_scarcity_1_0, {B('in_distribution')} AS in_distribution_1_0, reservoir_pct, {_SH}, "
        "follower_margin, leaders_margin, segment_margin",
        "sim", "WHERE phase = 'eval'", ch=Q._ASSESS_CH,
    ),
)
def table_simulated_days(spark, sf):
    days = Q.event_assessment(spark, sf)[1].replay.days.where(F.col("phase") == "eval")
    return published(SK.simulated_days_table(days, COMBO), [*COMBO, "day"])


@query(
    "table_summary",
    Q._ASSESS_CH.rstrip().rstrip(",") + "\n" + long({m: m for m in SK.SUMMARY_METRICS}, "summary", O.CMB),
)
def table_summary(spark, sf):
    return published(SK.summary_table(Q.event_assessment(spark, sf)[1].summary, COMBO), [*COMBO, "metric"])


_EACH = "\nUNION ALL ".join(Q._dist_sql(s) for s in ("follower", "leaders", "segment"))


@query(
    "table_distribution",
    Q._ASSESS_CH + f"dists AS ({_EACH}),\nlongs AS (" + long({m: m for m in SK.DISTRIBUTION_METRICS}, "dists", f"{O.CMB}, series") + ")\n"
    + f"SELECT {O.CMB}, metric, " + ", ".join(f"max(value) FILTER (WHERE series = '{s}') AS {s}_margin" for s in ("follower", "leaders", "segment"))
    + f" FROM longs GROUP BY {O.CMB}, metric",
)
def table_distribution(spark, sf):
    a = Q.event_assessment(spark, sf)[1]
    return published(SK.distribution_table(a.distributions, COMBO), [*COMBO, "metric"])


@query(
    "table_stress",
    Q.sel(
        f"{O.CMB}, scenario, {O.R('spot', 1)} AS spot, {O.R('contract', 1)} AS contract, {O.R('spread', 1)} AS spread, bin, margin, guarantee",
        "stress", ch=Q._ASSESS_CH,
    ),
)
def table_stress(spark, sf):
    return published(SK.stress_table(Q.event_assessment(spark, sf)[1].stress, COMBO), [*COMBO, "scenario"])


# The flag rests on the ratio before it is rounded: on three places alone 0.95 may be either.
_VALID_AS = {m: m for m in SK.VALIDITY_METRICS} | {"boot_units": "n_units", "dsr_significant": "dsr_raw >= 0.95"}


@query(
    "table_validity",
    _ALL.replace("AS kurtosis,\n", "AS kurtosis, CASE WHEN n_trials = 1 THEN 1.0 ELSE " + O.PHI("z") + " END AS dsr_raw,\n")
    .replace("d.n_trials, d.dsr,", "d.n_trials, d.dsr, d.dsr_raw,")
    + long(_VALID_AS, "gated", O.CMB, keep_nulls=False),
)
def table_validity(spark, sf):
    return published(SK.validity_table(Q.event_assessment(spark, sf)[1].summary, COMBO), [*COMBO, "metric"])


_NONE = "CAST(NULL AS BIGINT) AS n_scarcity"


@query(
    "table_regime",
    O.order_chain()
    + f"""bins AS (SELECT b.bin, coalesce(c, 0) AS c FROM (VALUES {', '.join(f"('{n}')" for n in PX.ORDER_BINS.names)}) b(bin)
 LEFT JOIN (SELECT bin, count(*) AS c FROM history GROUP BY 1) h USING (bin))
SELECT 'bin_frequency' AS kind, bin AS label, {_NONE}, CAST(c AS BIGINT) AS n_days, {O.R('c * 100.0 / (SELECT count(*) FROM history)')} AS pct, CAST(NULL AS DOUBLE) AS spread FROM bins
UNION ALL SELECT 'scarcity_days', NULL, {B('n_scarcity')}, {B('n_days')}, pct_scarcity, NULL FROM regime
"""
    + "".join(f"UNION ALL SELECT '{c}', NULL, NULL, NULL, NULL, {c} FROM regime\n" for c in ("spread_p50", "spread_p95", "spread_p99", "spread_max"))
    + f"""UNION ALL SELECT 'year', CAST(year AS VARCHAR), CAST(count(*) FILTER (WHERE scarce) AS BIGINT), CAST(count(*) AS BIGINT),
 {O.R('count(*) FILTER (WHERE scarce) * 100.0 / count(*)', 1)}, NULL FROM history GROUP BY year""",
)
def table_regime(spark, sf):
    prices = PX.from_orders(spark, sf).prices
    return SK.regime_table(SR.regime_by_bin(prices, PX.ORDER_BINS), SR.regime_total(prices), SR.regime_by_year(prices))


_DAYS = ", ".join(f"CAST(w.{c} AS VARCHAR) AS {c}" for c in SK._WINDOW)
_FLAGS = {f"{c}_1_0": c for c in ("kill_switch", "over_capacity", "candidate", "valid_cheap")}


@query(
    "table_scan",
    Q.OC + O.scan_sql(200)
    + f"SELECT {_DAYS}, segment, archetype, {BIG('n_leaders')}, {BIG('n_effective')}, codes, relative_top, follower_median, p_value, replication_ratio, dsr, "
    "pct_beats_segment, drawdown, ev_history, ev_dry_year, capacity_pct, mae_mean, "
    + ", ".join(f"{B('valid_cheap' if c == 'candidate' else c)} AS {n}" for n, c in _FLAGS.items())
    + " FROM gated JOIN windows w USING (window_id)",
)
def table_scan(spark, sf):
    table = SK.scan_table(Q.order_scan(spark, sf)[1])
    return SK.publish(
        table, f"{workspace(spark).rstrip('/')}/peerglass/published-{uuid.uuid4().hex}",
        ["study_start", "segment", "archetype"], ("study_start",),
    )


@query(
    "table_walk_forward",
    Q.ORACLES["walk_forward"].rpartition("SELECT segment, archetype, CAST(step")[0]
    + f"""SELECT {_DAYS.replace('w.', 'k.')}, {B('n_leaders')} AS n_leaders, follower_median, leaders_median, segment_median, replication_ratio, dsr,
 {B('kill_switch')} AS kill_switch FROM walked w JOIN windows k USING (window_id) WHERE i = w.step""",
)
def table_walk_forward(spark, sf):
    return SK.walk_forward_table(Q.walk_forward_steps(spark, sf))


# ------------------------------------------------------------------- weekly run
WEEKLY = ("SMALL", P.MIXED)
_MINE = f"segment = '{WEEKLY[0]}' AND archetype = '{WEEKLY[1]}'"
_WEEK = Q._ASSESS_CH + f"""
wctx AS (SELECT m.*, {O.R('spot - contract', 1)} AS wspread, scarcity > 0 AND spot > scarcity AS scarce, v.level_pct
 FROM mdays m LEFT JOIN levels v USING (day) WHERE phase = 'eval'),
wnow AS (SELECT window_id, arg_max(wspread, day) AS last_spread, arg_max({O.BIN('wspread', PX.EVENT_BINS)}, day) AS last_bin,
 count(*) FILTER (WHERE scarce) AS scarcity_days, count(*) AS n_days, {O.R('arg_max(level_pct, day) FILTER (WHERE level_pct IS NOT NULL)', 1)} AS last_level,
 CASE WHEN count(level_pct) < 2 THEN 'none' WHEN arg_max(level_pct, day) - arg_min(level_pct, day) > 1 THEN 'rising'
  WHEN arg_max(level_pct, day) - arg_min(level_pct, day) < -1 THEN 'falling' ELSE 'flat' END AS level_trend FROM wctx GROUP BY window_id)
"""


def weekly_tables(spark, sf):
    e = Q.events(spark, sf)
    return AC.weekly(
        e.daily, e.market, e.settings, e.windows, SR.regime_total(e.market.prices), *WEEKLY, Q.RU.reservoir_level(e.market.reservoirs)
    )


@query(
    "weekly_series",
    _WEEK + f"""SELECT c.window_id, CAST(c.day AS VARCHAR) AS day, c.wspread AS spread, s.bin, {B('is_scarcity')} AS is_scarcity_1_0, {B('in_distribution')} AS in_distribution_1_0,
 c.level_pct AS reservoir_pct, follower_margin, leaders_margin, segment_margin, CAST(peak - run AS DOUBLE) AS drawdown
 FROM wctx c LEFT JOIN (SELECT * FROM simpeak WHERE phase = 'eval' AND {_MINE}) s ON s.window_id = c.window_id AND s.day = c.day""",
)
def weekly_series(spark, sf):
    """Daily margins of the eval with their drawdown."""
    return published(SK.weekly_table(weekly_tables(spark, sf)["series"], WINDOW), [*WINDOW, "day"])


@query("weekly_regime", _WEEK + f"SELECT * REPLACE ({B('scarcity_days')} AS scarcity_days, {B('n_days')} AS n_days) FROM wnow")
def weekly_regime(spark, sf):
    return published(weekly_tables(spark, sf)["regime"], WINDOW)


@query(
    "weekly_profile",
    _WEEK + f"""SELECT window_id, CAST(NOT in_distribution AS BIGINT) AS is_defensive, {_SH}, has_auction FROM
 (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY day DESC) AS r FROM sim WHERE phase = 'eval' AND {_MINE}) WHERE r = 1""",
)
def weekly_profile(spark, sf):
    return published(weekly_tables(spark, sf)["profile"], WINDOW)


# The two modes are judged by statements of their own, so each keeps its table names.
_LED = (
    Q._ASSESS_CH + Q._PERSIST + O.scan_sql(1000, "persistence_pct", f"LEFT JOIN held USING ({O.CMB})")
    + f"SELECT *, 'leaders' AS mode FROM gated WHERE {_MINE}"
)
_PEER_CH = O.event_chain(main="study", archetypes=True)
_PEER = (
    Q.archetype_gated_sql(_PEER_CH, P.Selection().min_presence_pct)
    + f"""SELECT *, 'archetype' AS mode, valid_cheap AS valid_final FROM agated
 QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY CASE WHEN segment = '{WEEKLY[0]}' THEN 0 ELSE 1 END, p_value NULLS FIRST, follower_median DESC NULLS LAST, segment) = 1"""
)
_CELLS = "window_id, mode, valid_final, follower_median, pct_beats_segment, dsr, p_value, n_effective, drawdown, ev_history, " + ", ".join(O.GATE_SQL)
_BOTH = f"SELECT {_CELLS} FROM ({_LED}) UNION ALL SELECT {_CELLS} FROM ({_PEER})"
_FAILED = ", ".join(f"CASE WHEN bool_or(NOT {g}) THEN '{g}' END" for g in sorted(O.GATE_SQL))


@query(
    "weekly",
    f"""SELECT window_id, {B('bool_or(valid_final)')} AS operate, CAST(coalesce(bool_or(valid_final) FILTER (WHERE mode = 'leaders'), false) AS BIGINT) AS by_leaders,
 CAST(coalesce(bool_or(valid_final) FILTER (WHERE mode = 'archetype'), false) AS BIGINT) AS by_archetype,
 CASE WHEN bool_or(valid_final) THEN '' ELSE concat_ws(',', {_FAILED}) END AS failed FROM ({_BOTH}) GROUP BY window_id""",
)
def weekly(spark, sf):
    return published(weekly_tables(spark, sf)["verdict"], WINDOW)


def _state(metric: str) -> str:
    if metric == "drawdown":
        return f"CASE WHEN value <= 0 THEN 'ok' WHEN value >= {P.PolicyRules().kill_drawdown} THEN 'bad' ELSE 'warn' END"
    ok, warn, higher = KPI_LEVELS[metric]
    side = ">=" if higher else "<="
    good = f"value {'>' if metric == 'follower_median' else side} {ok}"
    fair = "" if warn is None else f" WHEN value {side} {warn} THEN 'warn'"
    return f"CASE WHEN {good} THEN 'ok'{fair} ELSE 'bad' END"


@query(
    "weekly_kpis",
    f"WITH source AS (SELECT * FROM ({_BOTH}) QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY mode DESC) = 1),\nlongs AS ("
    + long({m: m for m in AC._KPIS}, "source", "window_id")
    + f" UNION ALL SELECT window_id, 'reservoir_level', last_level FROM ({_WEEK} SELECT * FROM wnow))\n"
    + "SELECT *, CASE WHEN value IS NULL THEN 'warn' ELSE CASE metric "
    + " ".join(f"WHEN '{m}' THEN {_state(m)}" for m in [*AC._KPIS, "reservoir_level"])
    + " END END AS state FROM longs",
)
def weekly_kpis(spark, sf):
    """Traffic lights."""
    return published(weekly_tables(spark, sf)["kpis"], [*WINDOW, "metric"])
