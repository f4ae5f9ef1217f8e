"""Queries over the driver's tables, one per operator family, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import oracle_sql as O
from peerglass.functions.numeric import dec_round
from peerglass.functions.shares import PROFILE, SHARES
from peerglass.operators import COMBO, WINDOW
from peerglass.operators import backtest as BT
from peerglass.operators import clusters as CL
from peerglass.operators import panel as PN
from peerglass.operators import policy as PO
from peerglass.operators import rankings as RK
from peerglass.operators import rollups as RU
from peerglass.operators import scorecard as SC
from peerglass.operators import segments as SG
from peerglass.operators import selection as SE
from peerglass.operators import series as SR
from peerglass.operators import validity as VA
from peerglass.operators import windows as WN
from peerglass.params import ARCHETYPES, Selection
from peerglass.plans import acceptance as AC
from peerglass.plans import assess as AS
from peerglass.plans import replay as RP
from peerglass.plans import scan as SN
from peerglass.plans import study as ST
from peerglass.sources import proxies as PX
from peerglass.sources import sinks as SK
from peerglass.sources.tables import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Types every engine shares: text, 64-bit integers, doubles."""
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f.name), f.dataType
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(t, T.BooleanType):
            c = c.cast("int").cast("bigint")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, T.ArrayType):
            c = F.concat_ws(",", c)
        elif isinstance(t, T.MapType):
            c = F.concat_ws(
                ",",
                F.transform(
                    F.array_sort(F.map_entries(c)),
                    lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")),
                ),
            )
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------ fixtures
@dataclass
class Events:
    """The events fixture. The fact is rolled up once, by the first query part that asks for days."""

    market: PX.Market
    settings: object
    windows: DataFrame
    spans: DataFrame

    @cached_property
    def daily(self) -> ST.Daily:
        return ST.daily(self.market, self.settings, store=True)

    def span(self, phase):
        return self.spans.where(F.col("phase") == phase)

    def study(self, phase="select"):
        return ST.study(self.daily, self.market, self.settings, self.span(phase))

    def evaluation(self, s):
        return ST.evaluation_panel(self.daily, self.span("eval"), s.segmented)


def events(spark, sf_dir, **changes) -> Events:
    market = PX.from_events(spark, sf_dir)
    settings = PX.event_settings(**changes)
    edges = WN.data_edges(market.prices)
    windows = durable(
        WN.window_at_end(edges, None, PX.EVENT_EVAL_DAYS, PX.EVENT_WINDOW_ID), "windows"
    )
    return Events(market, settings, windows, WN.phase_spans(windows, 2))


def with_leaders(e: Events, store: bool = False):
    s = stored_study(e) if store else e.study()
    stats = PN.entity_stats(s.labelled)
    return s, stats, SE.leaders(stats, s.days, e.settings.selection)


def stored_study(e: Events, phase: str = "select"):
    """A study whose labelled panel is written once and read by everything after it."""
    s = e.study(phase)
    labelled = durable(s.labelled, "labelled")
    benchmark = PN.segment_day_benchmark(labelled)
    return replace(s, labelled=labelled, benchmark=benchmark, days=PN.study_days(benchmark))


def event_replay(e: Events, weighted=False):
    s = stored_study(e)
    stats = PN.entity_stats(s.labelled)
    chosen = durable(SE.leaders(stats, s.days, e.settings.selection), "leaders")
    training = PO.leader_days(s.labelled, chosen)
    rules = (
        PO.fit_weighted(training, SE.leader_weights(chosen), e.settings.bins)
        if weighted
        else PO.fit_median(training, e.settings.bins)
    )
    r = RP.replay(
        s,
        durable(e.evaluation(s), "evaluation"),
        rules,
        e.settings,
        chosen=chosen,
        keys=COMBO,
        levels=RU.reservoir_level(e.market.reservoirs),
        study_phase="select",
    )
    return s, stats, chosen, r


CH = O.event_chain()
DAY = "CAST(day AS VARCHAR) AS day"
BIG = lambda x: f"CAST({x} AS BIGINT) AS {x}"


def sel(cols: str, table: str, tail: str = "", ch: str = CH) -> str:
    return ch.rstrip().rstrip(",") + f"\nSELECT {cols} FROM {table} {tail}"


# ------------------------------------------------------------------ roll-ups
@query(
    "latest_day",
    sel("CAST(max(day) AS VARCHAR) AS latest_day", "prices"),
)
def latest_day(spark, sf):
    return RU.latest_day(PX.from_events(spark, sf).prices)


@query("price_history", sel(f"{DAY}, contract, spot, scarcity", "prices"))
def price_history(spark, sf):
    return RU.price_history(PX.from_events(spark, sf).prices)


@query(
    "population_rollup",
    sel("window_id, phase, agent_id, name, activity, total_gwh, reg_gwh, unreg_gwh", "pop",
        "WHERE phase <> 'study'"),
)
def population_rollup(spark, sf):
    e = events(spark, sf)
    volumes = WN.by_window(e.daily.volumes, WN.phase_days(e.spans))
    return RU.population(volumes, e.market.agents, e.settings.activities, ["window_id", "phase"])


_VOL = ", ".join(O.R(m, 4) + f" AS {m}" for m in O.MEASURES)


@query("agent_day_rollup", sel(f"agent_id, {DAY}, {_VOL}, contract, spot, scarcity", "panel"))
def agent_day_rollup(spark, sf):
    p = events(spark, sf).daily.panel
    return p.select(
        "agent_id",
        "day",
        *[dec_round(F.col(m), 4).alias(m) for m in O.MEASURES],
        "contract",
        "spot",
        "scarcity",
    )


@query("ratio_of_sums_daily", sel(f"{DAY}, {O.R('level_pct', 6)} AS level_pct", "levels"))
def ratio_of_sums_daily(spark, sf):
    lv = RU.reservoir_level(PX.from_events(spark, sf).reservoirs)
    return lv.select("day", dec_round(F.col("level_pct"), 6).alias("level_pct"))


@query(
    "segments",
    sel("window_id, agent_id, name, total_gwh, pct_reg, pct_unreg, segment", "seg", "WHERE phase = 'select'"),
)
def segments(spark, sf):
    return events(spark, sf).study().segmented


_SEGSUM = """
seglist AS (SELECT DISTINCT window_id, l.segment FROM seg, (VALUES ('LARGE'), ('MEDIUM'), ('SMALL')) l(segment) WHERE phase = 'select'),
segagg AS (SELECT window_id, segment, count(*) AS n, CAST(sum(CAST(total_gwh AS DECIMAL(18,1))) AS DOUBLE) AS gwh,
 CAST(sum(CAST(total_gwh AS DECIMAL(18,1)) * CAST(pct_reg AS DECIMAL(6,1))) AS DOUBLE) / 100.0 AS reg_gwh,
 CAST(sum(CAST(total_gwh AS DECIMAL(18,1)) * CAST(pct_unreg AS DECIMAL(6,1))) AS DOUBLE) / 100.0 AS unreg_gwh
 FROM seg WHERE phase = 'select' GROUP BY ALL)
"""


@query(
    "segment_summary",
    CH + _SEGSUM + f"""SELECT window_id, segment, CAST(coalesce(n, 0) AS BIGINT) AS n, {O.R('coalesce(gwh, 0)', 1)} AS gwh,
 {O.R('coalesce(reg_gwh, 0)', 1)} AS reg_gwh, {O.R('coalesce(unreg_gwh, 0)', 1)} AS unreg_gwh,
 {O.R(O.SAFE('coalesce(gwh, 0)', '(sum(gwh) OVER ())') + ' * 100.0', 1)} AS market_share_pct,
 {O.R(O.SAFE('reg_gwh', 'coalesce(gwh, 0)') + ' * 100.0', 1)} AS pct_reg,
 {O.R(O.SAFE('unreg_gwh', 'coalesce(gwh, 0)') + ' * 100.0', 1)} AS pct_unreg
 FROM seglist LEFT JOIN segagg USING (window_id, segment)""",
)
def segment_summary(spark, sf):
    e = events(spark, sf)
    return SG.segment_summary(e.study().segmented, e.settings.sizes)


@query(
    "agent_day_features",
    sel(f"agent_id, {DAY}, demand_gwh, log_demand, pct_unregulated, pct_contract, pct_spot, pct_auction, has_auction", "panel"),
)
def agent_day_features(spark, sf):
    return events(spark, sf).daily.panel.select(
        "agent_id", "day", "demand_gwh", "log_demand", *PROFILE
    )


_FIN = ", ".join(
    f"{v} AS {k}" for k, v in O.ROW_FINANCE.items() if k != "margin"
)


@query("financial_model", sel(f"agent_id, {DAY}, {_FIN}, {O.CLIPPED} AS margin", "panel0"))
def financial_model(spark, sf):
    e = events(spark, sf)
    base = RU.entity_days(e.daily.volumes, e.market.agents, e.market.prices, e.settings.activities)
    return PN.with_performance(base, e.settings.model, full=True).select(
        "agent_id", "day", *PN.FINANCE
    )


_LAB = f"window_id, agent_id, name, {DAY}, segment, {BIG('cluster_id')}, archetype, margin, unit_cost, bench, rel"


@query("archetype_by_rule", sel(_LAB, "lab"))
def archetype_by_rule(spark, sf):
    return events(spark, sf).study().labelled.select(
        *WINDOW, "agent_id", "name", "day", "segment", "cluster_id", "archetype", "margin", "unit_cost", "bench", "rel"
    )


@query("segment_day_benchmark", sel(f"window_id, segment, {DAY}, bench", "bench", "WHERE phase = 'select'"))
def segment_day_benchmark(spark, sf):
    return events(spark, sf).study().benchmark


# ------------------------------------------------------------------ rankings
def _ranking_sql(by: str) -> str:
    k = f"window_id, {by}day" if by else "window_id, day"
    return f"""
rk0 AS (SELECT {k}, cluster_id, {O.UM('margin')} AS median, {O.R(O.SUM2('margin') + ' / count(*)')} AS mean, count(*) AS n FROM lab GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY median DESC, mean DESC, cluster_id) AS rank FROM rk0)
"""


def _balance_sql(by: str) -> str:
    k = f"window_id, {by}cluster_id"
    return _ranking_sql(by).rstrip() + f""",
hv AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY day) AS i, count(*) OVER (PARTITION BY {k}) AS c FROM rk),
bal AS (SELECT {k}, count(*) AS days, {O.UM('median')} AS median_margin, {O.R(O.SUM2('median') + ' / count(*)')} AS mean_margin,
 count(*) FILTER (WHERE rank = 1) AS days_first, {O.R('count(*) FILTER (WHERE rank <= 3) * 100.0 / count(*)', 1)} AS pct_top3,
 {O.R('sum(rank) / count(*)')} AS mean_rank,
 {O.R('coalesce(' + O.SUM2('median', 'i > c // 2') + ' / nullif(count(*) FILTER (WHERE i > c // 2), 0) - ' + O.SUM2('median', 'i <= c // 2') + ' / nullif(count(*) FILTER (WHERE i <= c // 2), 0), 0)')} AS trend
 FROM hv GROUP BY ALL)
"""


_RK = f"{BIG('cluster_id')}, median, mean, {BIG('n')}, {BIG('rank')}"
_BAL = (
    f"{BIG('cluster_id')}, {BIG('days')}, median_margin, mean_margin, {BIG('days_first')}, pct_top3, mean_rank, trend, "
    f"CAST(days < {O.NEED('n_study_days', 20)} AS BIGINT) AS is_outlier"
)


@query("daily_ranking", CH + _ranking_sql("") + f"SELECT window_id, {DAY}, {_RK} FROM rk")
def daily_ranking(spark, sf):
    return RK.daily_ranking(events(spark, sf).study().labelled)


@query(
    "daily_ranking_by_segment",
    CH + _ranking_sql("segment, ") + f"SELECT window_id, segment, {DAY}, {_RK} FROM rk",
)
def daily_ranking_by_segment(spark, sf):
    return RK.daily_ranking(events(spark, sf).study().labelled, ["segment"])


_ND = "JOIN (SELECT window_id, n_study_days FROM ndays WHERE phase = 'select') USING (window_id)"


@query("period_balance", CH + _balance_sql("") + f"SELECT window_id, {_BAL} FROM bal {_ND}")
def period_balance(spark, sf):
    s = stored_study(events(spark, sf))
    return RK.mark_outliers(RK.period_balance(RK.daily_ranking(s.labelled)), s.days, 20.0)


@query(
    "period_balance_by_segment",
    CH + _balance_sql("segment, ") + f"SELECT window_id, segment, {_BAL} FROM bal {_ND}",
)
def period_balance_by_segment(spark, sf):
    s = events(spark, sf).study()
    r = RK.daily_ranking(s.labelled, ["segment"])
    return RK.mark_outliers(RK.period_balance(r, ["segment"]), s.days, 20.0)


@query(
    "archetype_segment_matrix",
    CH + _balance_sql("segment, ")
    + f"SELECT window_id, {BIG('cluster_id')}, segment, median_margin AS median, mean_margin AS mean, {BIG('days')} FROM bal",
)
def archetype_segment_matrix(spark, sf):
    return RK.archetype_segment_matrix(RK.daily_ranking(events(spark, sf).study().labelled, ["segment"]))


@query(
    "rank_histogram",
    CH + _ranking_sql("")
    + "SELECT window_id, " + BIG("cluster_id") + ", "
    + ", ".join(f"CAST(count(*) FILTER (WHERE rank = {r}) AS BIGINT) AS rank_{r}" for r in range(1, 9))
    + " FROM rk GROUP BY ALL",
)
def rank_histogram(spark, sf):
    return RK.rank_histogram(RK.daily_ranking(events(spark, sf).study().labelled), 8)


_PROFILE = (
    f"window_id, {BIG('cluster_id')}, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT agent_id) AS BIGINT) AS n_agents, "
        + ", ".join(
            O.R(f"CAST(sum(CAST({f} AS DECIMAL(18,4))) AS DOUBLE) / count(*)") + f" AS {f}"
            for f in ("log_demand", *PROFILE)
        )
        + ", list_aggregate(list_sort([x FOR x IN ["
        + ", ".join(
            f"CASE WHEN count(*) FILTER (WHERE segment = '{s}') > 0 THEN '{s}=' || count(*) FILTER (WHERE segment = '{s}') END"
            for s in ("LARGE", "MEDIUM", "SMALL")
        )
        + "] IF x IS NOT NULL]), 'string_agg', ',') AS by_segment"
)


@query("cluster_profiles", sel(_PROFILE, "lab", "GROUP BY window_id, cluster_id"))
def cluster_profiles(spark, sf):
    return CL.cluster_profiles(events(spark, sf).study().labelled).drop("archetype")


# ------------------------------------------------------------------- regime
@query(
    "regime_by_bin",
    sel(
        f"b.bin, CAST(coalesce(c, 0) AS BIGINT) AS n_days, {O.R('coalesce(c, 0) * 100.0 / (SELECT count(*) FROM history)')} AS pct",
        "(VALUES " + ", ".join(f"('{n}')" for n in PX.EVENT_BINS.names) + ") b(bin)",
        "LEFT JOIN (SELECT bin, count(*) AS c FROM history GROUP BY 1) h USING (bin)",
    ),
)
def regime_by_bin(spark, sf):
    e = events(spark, sf)
    return SR.regime_by_bin(e.market.prices, e.settings.bins)


@query(
    "regime_history",
    sel(
        f"{BIG('n_days')}, {BIG('n_scarcity')}, pct_scarcity, spread_p50, spread_p95, spread_p99, spread_max", "regime",
        ch=O.order_chain(),
    ),
)
def regime_history(spark, sf):
    return SR.regime_total(PX.from_orders(spark, sf).prices)


@query(
    "regime_by_year",
    sel(
        f"{BIG('year')}, CAST(count(*) AS BIGINT) AS n_days, CAST(count(*) FILTER (WHERE scarce) AS BIGINT) AS n_scarcity, "
        f"{O.R('count(*) FILTER (WHERE scarce) * 100.0 / count(*)', 1)} AS pct_scarcity",
        "history", "GROUP BY year", ch=O.order_chain(),
    ),
)
def regime_by_year(spark, sf):
    return SR.regime_by_year(PX.from_orders(spark, sf).prices)


# ---------------------------------------------------------------- selection
_LEAD = (
    f"{O.CMB}, agent_id, name, {BIG('n_days')}, median_margin, mean_margin, pct_loss_days, drawdown, downside_median, "
    f"relative_median, pct_above_segment, {BIG('pos')}"
)


@query("leaders_relative", sel(_LEAD, "leaders"))
def leaders_relative(spark, sf):
    return with_leaders(events(spark, sf))[2]


@query(
    "leaders_absolute",
    sel(
        _LEAD.replace("relative_median, pct_above_segment", "0.0::DOUBLE AS relative_median, 0.0::DOUBLE AS pct_above_segment"),
        "leaders",
        ch=O.event_chain(sel=Selection(relative=False)),
    ),
)
def leaders_absolute(spark, sf):
    e = events(spark, sf, selection=Selection(relative=False))
    return with_leaders(e)[2]


_ALT = f"""
combos AS (SELECT {O.CMB}, count(*) AS n_leaders, string_agg(agent_id, ',' ORDER BY pos) AS codes, max(relative_median) AS best_relative,
 {O.UM('relative_median')} AS relative_top, {O.UM('median_margin')} AS absolute_top FROM leaders GROUP BY ALL),
alts AS (SELECT c.window_id, c.segment, c.archetype, a.segment AS alt_segment, a.archetype AS alt_archetype, a.codes AS alt_codes,
 a.n_leaders AS alt_n_leaders, a.best_relative AS alt_best_relative, a.relative_top AS alt_relative_top, a.absolute_top AS alt_absolute_top,
 row_number() OVER (PARTITION BY c.window_id, c.segment, c.archetype ORDER BY a.relative_top DESC, a.n_leaders DESC, a.segment, a.archetype) AS r
 FROM combos c JOIN combos a ON a.window_id = c.window_id AND (a.segment <> c.segment OR a.archetype <> c.archetype))
"""


@query(
    "best_alternative",
    CH + _ALT + f"SELECT {O.CMB}, alt_segment, alt_archetype, alt_codes, {BIG('alt_n_leaders')}, alt_best_relative, alt_relative_top, alt_absolute_top FROM alts WHERE r = 1",
)
def best_alternative(spark, sf):
    return SE.best_alternative(with_leaders(events(spark, sf))[2])


_SENS = f"""
grid2 AS (SELECT t.top, p.min_presence_pct FROM (VALUES (3), (5), (7)) t(top), (VALUES (10.0), (20.0), (30.0)) p(min_presence_pct)),
sens AS (SELECT s.*, g.top, g.min_presence_pct, row_number() OVER (PARTITION BY {O.CMB}, g.top, g.min_presence_pct
 ORDER BY median_margin DESC, n_days DESC, agent_id) AS pos FROM stats s JOIN (SELECT window_id, n_study_days FROM ndays WHERE phase = 'select') USING (window_id), grid2 g
 WHERE n_days >= greatest(1, CAST(round_even(n_study_days * g.min_presence_pct / 100.0, 0) AS BIGINT)))
"""


@query(
    "selection_sensitivity",
    CH + _SENS + f"SELECT {O.CMB}, {BIG('top')}, CAST(min_presence_pct AS DOUBLE) AS min_presence_pct, string_agg(agent_id, ',' ORDER BY pos) AS codes FROM sens WHERE pos <= top GROUP BY ALL",
)
def selection_sensitivity(spark, sf):
    s = stored_study(events(spark, sf))
    return SE.selection_sensitivity(PN.entity_stats(s.labelled), s.days)


_W = f"""
wts AS (SELECT *, e / sum(e) OVER (PARTITION BY {O.CMB}) AS weight FROM (SELECT *, exp((median_margin - max(median_margin) OVER w) / greatest(max(median_margin) OVER w - min(median_margin) OVER w, 1.0)
 + 0.5 * (n_days / max(n_days) OVER w)) AS e FROM leaders WINDOW w AS (PARTITION BY {O.CMB})))
"""


@query("leader_weights", CH + _W + f"SELECT {O.CMB}, agent_id, {BIG('pos')}, {O.R('weight', 8)} AS weight FROM wts")
def leader_weights(spark, sf):
    w = SE.leader_weights(with_leaders(events(spark, sf))[2])
    return w.select(*COMBO, "agent_id", "pos", dec_round(F.col("weight"), 8).alias("weight"))


@query(
    "realised_profile",
    sel(
        "r.window_id, k.segment, k.archetype, "
        + ", ".join(f"{O.R(O.UM('r.' + x), 1)} AS {x}" for x in SHARES)
        + ", CAST(count(*) AS BIGINT) AS n_days",
        "evalp r JOIN leaders k ON r.window_id = k.window_id AND r.agent_id = k.agent_id",
        "GROUP BY ALL",
    ),
)
def realised_profile(spark, sf):
    e = events(spark, sf)
    s, _, chosen = with_leaders(e)
    return SE.realised_profile(e.evaluation(s), chosen)


# ------------------------------------------------------------------ policies
_RULE = "bin, lo, hi, " + ", ".join(PROFILE) + f", {BIG('n_days')}, {O.R('spread_min')} AS spread_min, {O.R('spread_max')} AS spread_max"


def _rule_sql(table, keys=O.CMB):
    b = PX.EVENT_BINS
    return (
        f"SELECT {keys}, {_RULE.replace('lo, hi', O.BOUND('bin', b, 1) + ' AS lo, ' + O.BOUND('bin', b, 2) + ' AS hi', 1)} FROM {table}"
    )


def _rules(df, keys):
    return df.select(
        *keys,
        "bin",
        "lo",
        "hi",
        *PROFILE,
        "n_days",
        dec_round(F.col("spread_min"), 2).alias("spread_min"),
        dec_round(F.col("spread_max"), 2).alias("spread_max"),
    )


@query("policy_fit_median", CH.rstrip().rstrip(",") + "\n" + _rule_sql("fit"))
def policy_fit_median(spark, sf):
    e = events(spark, sf)
    s, _, chosen = with_leaders(e)
    return _rules(PO.fit_median(PO.leader_days(s.labelled, chosen), e.settings.bins), COMBO)


_MED = ", ".join(f"{O.R(f'median({f})', 2 if f == 'has_auction' else 1)} AS {f}" for f in PROFILE)
_MIX = ", ".join(f"{O.R(f'sum(weight * {f}) / sum(weight)', 2 if f == 'has_auction' else 1)} AS {f}" for f in PROFILE)
_WFIT = _W.rstrip() + f""",
each AS (SELECT {O.CMB}, bin, agent_id, {_MED}, count(*) AS n_days, min(spread) AS spread_min, max(spread) AS spread_max
 FROM train GROUP BY GROUPING SETS (({O.CMB}, bin, agent_id), ({O.CMB}, agent_id))),
wfit AS (SELECT {O.CMB}, bin, {_MIX}, sum(n_days) AS n_days, min(spread_min) AS spread_min, max(spread_max) AS spread_max
 FROM each JOIN (SELECT {O.CMB}, agent_id, weight FROM wts) USING ({O.CMB}, agent_id) GROUP BY ALL)
"""


@query("policy_fit_weighted", CH + _WFIT + _rule_sql("wfit"))
def policy_fit_weighted(spark, sf):
    e = events(spark, sf)
    s, _, chosen = with_leaders(e)
    w = SE.leader_weights(chosen)
    return _rules(PO.fit_weighted(PO.leader_days(s.labelled, chosen), w, e.settings.bins), COMBO)


_WIN = f"""
seen AS (SELECT window_id, segment, bin, cluster_id, archetype, rel, agent_id || '|' || CAST(day AS VARCHAR) AS k FROM lab
 UNION ALL SELECT window_id, segment, '*', cluster_id, archetype, rel, agent_id || '|' || CAST(day AS VARCHAR) FROM lab),
ranked AS (SELECT window_id, segment, bin, cluster_id, max(archetype) AS archetype, {O.UM('rel')} AS relative_median, min(k) AS k FROM seen GROUP BY ALL),
winners AS (SELECT window_id, segment, nullif(bin, '*') AS bin, cluster_id, archetype, relative_median FROM
 (SELECT *, row_number() OVER (PARTITION BY window_id, segment, bin ORDER BY relative_median DESC, k) AS r FROM ranked) WHERE r = 1)
"""


@query("winners_by_bin", CH + _WIN + f"SELECT window_id, segment, bin, {BIG('cluster_id')}, archetype, relative_median FROM winners")
def winners_by_bin(spark, sf):
    e = events(spark, sf)
    return SE.winners_by_bin(stored_study(e).labelled, e.settings.bins)


_AFIT = _WIN.rstrip() + f""",
span AS (SELECT window_id, segment, min(spread) AS spread_min, max(spread) AS spread_max FROM lab GROUP BY ALL),
mine AS (SELECT l.*, w.bin AS wbin FROM lab l JOIN winners w ON l.window_id = w.window_id AND l.segment = w.segment AND l.cluster_id = w.cluster_id
 AND (w.bin = l.bin OR w.bin IS NULL)),
afit AS (SELECT window_id, segment, wbin AS bin, {_MED}, count(*) AS n_days, max(spread_min) AS spread_min, max(spread_max) AS spread_max
 FROM mine JOIN span USING (window_id, segment) GROUP BY ALL)
"""


@query("policy_fit_archetype", CH + _AFIT + _rule_sql("afit", "window_id, segment"))
def policy_fit_archetype(spark, sf):
    e = events(spark, sf)
    s = stored_study(e)
    w = SE.winners_by_bin(s.labelled, e.settings.bins)
    return _rules(PO.fit_archetype(s.labelled, w, e.settings.bins), WINDOW + ["segment"])


_CTX = O.R("context_spread", 6) + " AS context_spread"


@query(
    "policy_apply_nearest",
    sel(
        f"{O.CMB}, phase, {DAY}, {_CTX}, bin, CAST(in_distribution AS BIGINT) AS in_distribution, "
        + ", ".join(f"r_{s} AS recommended_{s}" for s in SHARES),
        "sim",
    ),
)
def policy_apply_nearest(spark, sf):
    r = event_replay(events(spark, sf))[3]
    return r.days.select(
        *COMBO,
        "phase",
        "day",
        dec_round(F.col("context_spread"), 6).alias("context_spread"),
        "bin",
        "in_distribution",
        *[f"recommended_{s}" for s in SHARES],
    )


# ------------------------------------------------------------------ backtest
@query(
    "backtest_days",
    sel(
        f"{O.CMB}, phase, {DAY}, bin, CAST(is_scarcity AS BIGINT) AS is_scarcity, CAST(in_distribution AS BIGINT) AS in_distribution, "
        "reservoir_pct, pct_contract, pct_spot, pct_unregulated, pct_auction, follower_margin, leaders_margin, segment_margin, guarantee",
        "sim",
    ),
)
def backtest_days(spark, sf):
    r = event_replay(events(spark, sf))[3]
    return r.days.select(
        *COMBO, "phase", "day", "bin", "is_scarcity", "in_distribution", "reservoir_pct", *SHARES,
        "follower_margin", "leaders_margin", "segment_margin", "guarantee",
    )


@query(
    "backtest_summary",
    sel(
        f"{O.CMB}, {BIG('days')}, demand_per_day, follower_median, follower_mean, leaders_median, segment_median, pct_beats_segment, "
        "pct_beats_leaders, guarantee_median, guarantee_max",
        "summary",
    ),
)
def backtest_summary(spark, sf):
    r = event_replay(events(spark, sf))[3]
    return BT.eval_summary(r.days.where(F.col("phase") == "eval"), COMBO)


def _dist_sql(series):
    v = f"{series}_margin"
    return f"""SELECT {O.CMB}, '{series}' AS series, CAST(count({v}) AS BIGINT) AS n, {O.R(O.UM(v, v + ' IS NOT NULL'))} AS median,
 {O.R(O.SUM2(v) + f' / count({v})')} AS mean, {O.R(O.NR(v, 0.05))} AS p5, {O.R(O.NR(v, 0.95))} AS p95,
 {O.R(f'count(*) FILTER (WHERE {v} < 0) * 100.0 / count({v})', 1)} AS pct_loss_days, {O.R(f'min({v})')} AS worst, {O.R(f'max({v})')} AS best,
 {O.R('max(pk - rn)')} AS drawdown FROM (SELECT *, greatest(0, max(rn) OVER (PARTITION BY {O.CMB} ORDER BY day ROWS UNBOUNDED PRECEDING)) AS pk FROM
 (SELECT *, sum(CAST({v} AS DECIMAL(18,2))) OVER (PARTITION BY {O.CMB} ORDER BY day ROWS UNBOUNDED PRECEDING) AS rn FROM sim WHERE phase = 'eval' AND {v} IS NOT NULL)) GROUP BY {O.CMB}"""


@query(
    "series_distribution",
    CH.rstrip().rstrip(",") + "\n" + "\nUNION ALL ".join(_dist_sql(s) for s in ("follower", "leaders", "segment")),
)
def series_distribution(spark, sf):
    r = event_replay(events(spark, sf))[3]
    return SR.distributions(r.days.where(F.col("phase") == "eval"), COMBO)


@query("replication_ratio", sel(f"{O.CMB}, replication_in, replication_out, replication_ratio", "ratios"))
def replication_ratio(spark, sf):
    return VA.replication_ratio(event_replay(events(spark, sf))[3].days, COMBO, "select")


@query(
    "stress_scenarios",
    sel(
        f"{O.CMB}, scenario, {O.R('spot', 1)} AS spot, {O.R('contract', 1)} AS contract, {O.R('spread', 1)} AS spread, bin, margin, guarantee",
        "stress",
    ),
)
def stress_scenarios(spark, sf):
    e = events(spark, sf)
    r = event_replay(e)[3]
    return BT.stress_scenarios(r.study_market, r.policies, e.settings.model, e.settings.bins)


def event_judged(spark, sf):
    e = events(spark, sf)
    s, stats, chosen, r = event_replay(e)
    r = replace(r, days=durable(r.days, "days"))
    trials = stats.groupBy(*COMBO).agg(F.count(F.lit(1)).alias("n_trials"))
    return RP.judge(
        r, s, e.settings, SR.regime_total(e.market.prices), trials, COMBO, study_phase="select"
    )


@query(
    "expected_value_decision",
    sel(
        f"{O.CMB}, stress_margin, extreme_margin, loss_scarcity_day, loss_extreme_day, ev_history, ev_dry_year, drawdown, p5, p95, "
        "CAST(kill_switch AS BIGINT) AS kill_switch, capacity_pct, CAST(over_capacity AS BIGINT) AS over_capacity, verdict",
        "judged",
    ),
)
def expected_value_decision(spark, sf):
    return event_judged(spark, sf).select(
        *COMBO, "stress_margin", "extreme_margin", "loss_scarcity_day", "loss_extreme_day", "ev_history",
        "ev_dry_year", "drawdown", "p5", "p95", "kill_switch", "capacity_pct", "over_capacity", "verdict",
    )


@query(
    "clone_fidelity",
    sel(f"{O.CMB}, " + ", ".join(f"mae_{s}" for s in SHARES) + ", mae_mean", "fidelity"),
)
def clone_fidelity(spark, sf):
    r = event_replay(events(spark, sf))[3]
    return BT.clone_fidelity(
        r.days.where(F.col("phase") == "eval"), r.realised.where(F.col("phase") == "eval")
    )


# ------------------------------------------------------------------ validity
_BOOT = (
    f"{O.CMB}, {BIG('n_units')}, {BIG('n_pool')}, {BIG('n_boot')}, boot_best, boot_null_p50, boot_null_p95, p_value, boot_percentile"
)


@query(
    "bootstrap_best_median",
    CH + O.boot_sql("units", "pool", O.CMB, O.CMB, 200) + f"SELECT {_BOOT} FROM boot",
)
def bootstrap_best_median(spark, sf):
    e = events(spark, sf)
    s = stored_study(e)
    eligible = SE.present_enough(
        PN.entity_stats(s.labelled), s.days, e.settings.selection.min_presence_pct
    )
    return VA.bootstrap_best_median(
        VA.bootstrap_units(eligible), VA.bootstrap_pool(s.labelled, eligible), n_boot=200
    )


@query("bootstrap_by_draws", CH + O.draws_sql(200) + f"SELECT {_BOOT} FROM boot")
def bootstrap_by_draws(spark, sf):
    """The definition: every value of every entity is drawn."""
    e = events(spark, sf)
    s = stored_study(e)
    eligible = SE.present_enough(
        PN.entity_stats(s.labelled), s.days, e.settings.selection.min_presence_pct
    )
    return VA.bootstrap_best_median(
        VA.bootstrap_units(eligible), VA.bootstrap_pool(s.labelled, eligible), n_boot=200, draws="md5"
    )


_CROSS_CH = CH.replace("FROM eligible s)", "FROM stats s)").replace(
    "AS level FROM eligible s", "AS level FROM stats s"
)


@query(
    "bootstrap_cross_segment",
    _CROSS_CH + O.boot_sql("units", "lab", O.CMB, "window_id, archetype", 200) + f"SELECT {_BOOT} FROM boot",
)
def bootstrap_cross_segment(spark, sf):
    s = stored_study(events(spark, sf))
    return VA.bootstrap_best_median(
        VA.bootstrap_units(PN.entity_stats(s.labelled)),
        s.labelled,
        pool_keys=["window_id", "archetype"],
        n_boot=200,
    )


_ARCH_UNITS = f"""
units2 AS (SELECT window_id, segment, archetype AS unit, count(*) AS draws, {O.UM('rel')} AS level, min(agent_id || '|' || CAST(day AS VARCHAR)) AS first_key
 FROM lab GROUP BY ALL),
besta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id, segment ORDER BY level DESC, first_key) AS r FROM units2) WHERE r = 1)
"""


@query(
    "bootstrap_archetype",
    CH + _ARCH_UNITS.rstrip() + ","
    + O.boot_sql("units2", "lab", "window_id, segment", "window_id, segment", 200)
    + f"SELECT b.window_id, b.segment, a.unit AS archetype, {_BOOT.replace(O.CMB + ', ', '')} FROM boot b JOIN besta a USING (window_id, segment)",
)
def bootstrap_archetype(spark, sf):
    s = stored_study(events(spark, sf))
    units = VA.archetype_units(s.labelled)
    keys = WINDOW + ["segment"]
    boot = VA.bootstrap_best_median(units, s.labelled, keys=keys, n_boot=200)
    return boot.join(VA.best_archetype(units), keys).select(
        *keys, "archetype", *[c for c in boot.columns if c not in keys]
    )


# The chance that the best redrawn median reaches the real one, in closed form: a
# median of n draws lies below a value of rank share x with the chance that more
# than half of n draws do.
@query(
    "bootstrap_exact",
    CH + _ARCH_UNITS.rstrip() + """,
pooled AS (SELECT l.window_id, l.segment, count(*) AS n_pool, count(*) FILTER (WHERE rel < level) / count(*) AS x, max(level) AS level
 FROM lab l JOIN besta b ON b.window_id = l.window_id AND b.segment = l.segment GROUP BY ALL),
miss AS (SELECT u.window_id, u.segment, u.unit, any_value(n_pool) AS n_pool, any_value(p.level) AS best,
  CASE any_value(x) WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE
  list_sum(list_transform(range(any_value(draws) // 2 + 1, any_value(draws) + 1), lambda k: exp(lgamma(any_value(draws) + 1.0) - lgamma(k + 1.0)
   - lgamma(any_value(draws) - k + 1.0) + k * ln(any_value(x)) + (any_value(draws) - k) * ln(1 - any_value(x))))) END AS f
 FROM units2 u JOIN pooled p ON p.window_id = u.window_id AND p.segment = u.segment GROUP BY u.window_id, u.segment, u.unit)
""" + f"""SELECT window_id, segment, CAST(count(*) AS BIGINT) AS n_units, CAST(max(n_pool) AS BIGINT) AS n_pool,
 {O.R('max(best)')} AS boot_best, {O.R('1 - product(f)', 3)} AS p_exact FROM miss GROUP BY window_id, segment""",
)
def bootstrap_exact(spark, sf):
    s = stored_study(events(spark, sf))
    return VA.exact_p(VA.archetype_units(s.labelled), s.labelled, keys=WINDOW + ["segment"])


_HOLD = f"""
hs0 AS (SELECT {O.CMB}, agent_id, count(*) AS n_days, {O.UM('margin')} AS level, min(agent_id || '|' || CAST(day AS VARCHAR)) AS k FROM hold GROUP BY ALL),
hs AS (SELECT h.*, row_number() OVER (PARTITION BY {O.CMB} ORDER BY level DESC, k) - 1 AS position, count(*) OVER (PARTITION BY {O.CMB}) AS n
 FROM hs0 h JOIN (SELECT window_id, n_study_days FROM ndays WHERE phase = 'holdout') USING (window_id) WHERE n_days >= {O.NEED('n_study_days', 20)}),
hn AS (SELECT {O.CMB}, count(*) AS n_holdout FROM hs GROUP BY ALL)
"""


@query(
    "holdout_persistence",
    CH + _HOLD + f"""SELECT l.window_id, l.segment, l.archetype, CAST(coalesce(max(n_holdout), 0) AS BIGINT) AS n_holdout,
 CAST(count(position) AS BIGINT) AS n_ranked_leaders,
 CASE WHEN max(n_holdout) IS NOT NULL THEN {O.R('count(*) FILTER (WHERE position < n_holdout / 2) * 100.0 / count(*)', 1)} END AS persistence_pct,
 {O.R('median(position / greatest(n_holdout - 1, 1)) * 100.0', 1)} AS persistence_percentile
 FROM leaders l LEFT JOIN (SELECT {O.CMB}, agent_id, position FROM hs) h USING ({O.CMB}, agent_id) LEFT JOIN hn USING ({O.CMB}) GROUP BY l.window_id, l.segment, l.archetype""",
)
def holdout_persistence(spark, sf):
    e = events(spark, sf)
    chosen = with_leaders(e)[2]
    h = e.study("holdout")
    return VA.holdout_persistence(chosen, h.labelled, h.days, e.settings.selection.min_presence_pct)


def held_archetype_sql(presence: float) -> str:
    """What became of the overall winners of a study, from tables ``winners``, ``hold`` and ``ndays``."""
    return f"""
ha0 AS (SELECT window_id, segment, archetype, count(*) AS n_rows, {O.UM('rel')} AS level, min(agent_id || '|' || CAST(day AS VARCHAR)) AS k FROM hold GROUP BY ALL),
ha AS (SELECT h.*, row_number() OVER (PARTITION BY window_id, segment ORDER BY level DESC, k) - 1 AS position, count(*) OVER (PARTITION BY window_id, segment) AS n
 FROM ha0 h JOIN (SELECT window_id, n_study_days FROM ndays WHERE phase = 'holdout') USING (window_id) WHERE n_rows >= {O.NEED('n_study_days', presence)})
SELECT w.window_id, w.segment, w.archetype, CAST(coalesce(m.n, 0) AS BIGINT) AS n_archetypes,
 CAST(CASE WHEN h.position IS NULL THEN NULL WHEN h.position < m.n / 2 THEN 100.0 ELSE 0.0 END AS DOUBLE) AS persistence_pct,
 {O.R('h.position * 100.0 / greatest(m.n - 1, 1)', 1)} AS persistence_percentile
 FROM winners w LEFT JOIN (SELECT window_id, segment, max(n) AS n FROM ha GROUP BY ALL) m USING (window_id, segment)
 LEFT JOIN ha h ON h.window_id = w.window_id AND h.segment = w.segment AND h.archetype = w.archetype WHERE w.bin IS NULL"""


@query("holdout_persistence_archetype", CH + _WIN.rstrip() + "," + held_archetype_sql(20))
def holdout_persistence_archetype(spark, sf):
    e = events(spark, sf)
    s = stored_study(e)
    h = stored_study(e, "holdout")
    winners = SE.winners_by_bin(s.labelled, e.settings.bins).where(F.col("bin").isNull())
    return VA.archetype_persistence(
        winners, h.labelled, h.days, e.settings.selection.min_presence_pct
    )


_PAIR = f"""
ls AS (SELECT k.window_id, k.segment, k.archetype, k.agent_id, k.pos, l.day, l.margin FROM leaders k JOIN lab l ON l.window_id = k.window_id AND l.agent_id = k.agent_id),
prs AS (SELECT a.window_id, a.segment, a.archetype, a.pos AS pos_a, b.pos AS pos_b, a.agent_id AS agent_a, b.agent_id AS agent_b, count(*) AS common_days,
 CASE WHEN count(*) >= 3 AND min(a.margin) < max(a.margin) AND min(b.margin) < max(b.margin) THEN covar_pop(a.margin, b.margin) / (stddev_pop(a.margin) * stddev_pop(b.margin)) END AS corr
 FROM ls a JOIN ls b ON a.window_id = b.window_id AND a.segment = b.segment AND a.archetype = b.archetype AND a.day = b.day AND a.pos < b.pos GROUP BY ALL)
"""


@query(
    "pair_correlation",
    CH + _PAIR + f"SELECT {O.CMB}, {BIG('pos_a')}, {BIG('pos_b')}, agent_a, agent_b, {BIG('common_days')}, {O.R('corr', 6)} AS corr FROM prs",
)
def pair_correlation(spark, sf):
    s, _, chosen = with_leaders(events(spark, sf))
    return VA.pair_correlation(chosen, s.labelled).withColumn("corr", dec_round(F.col("corr"), 6))


_MOM = f"""
mom AS (SELECT {O.CMB}, count(follower_margin) AS n, avg(follower_margin) AS a, stddev_samp(follower_margin) AS sd,
 avg(follower_margin ** 2) AS m2, avg(follower_margin ** 3) AS m3, avg(follower_margin ** 4) AS m4 FROM sim WHERE phase = 'eval' GROUP BY ALL)
"""


@query(
    "deflated_sharpe_moments",
    CH + _MOM + f"""SELECT {O.CMB}, {BIG('n')}, {O.R('a / sd', 4)} AS sharpe,
 {O.R('(m3 - 3 * a * m2 + 2 * a ** 3) / ((m2 - a * a) ** 1.5)', 4)} AS skew,
 {O.R('(m4 - 4 * a * m3 + 6 * a * a * m2 - 3 * a ** 4) / ((m2 - a * a) ** 2)', 4)} AS kurtosis FROM mom WHERE n >= 3 AND sd > 0""",
)
def deflated_sharpe_moments(spark, sf):
    r = event_replay(events(spark, sf))[3]
    m = VA.sharpe_moments(r.days.where(F.col("phase") == "eval"), COMBO)
    return m.select(
        *COMBO, "n", *[dec_round(F.col(c), 4).alias(c) for c in ("sharpe", "skew", "kurtosis")]
    )


@query("deflated_sharpe")
def deflated_sharpe(spark, sf):
    s, stats, chosen, r = event_replay(events(spark, sf))
    trials = stats.groupBy(*COMBO).agg(F.count(F.lit(1)).alias("n_trials"))
    m = VA.sharpe_moments(r.days.where(F.col("phase") == "eval"), COMBO).join(trials, COMBO)
    return VA.deflated_sharpe(m)


_TRIALS = f"etr AS (SELECT {O.CMB}, count(*) AS n_trials FROM stats GROUP BY ALL),"
_DSR = f"{O.CMB}, {BIG('n')}, {BIG('n_trials')}, sharpe, skew, kurtosis, dsr"
ORACLES["deflated_sharpe"] = (
    CH + _TRIALS + O.sharpe_sql("sim", O.CMB, "etr")
    + f"\nSELECT {_DSR}, CAST(dsr >= 0.95 AS BIGINT) AS dsr_significant FROM dsrs"
)


@query(
    "duplicates_n_effective",
    CH + O.duplicates_sql() + f"\nSELECT {O.CMB}, {BIG('n_leaders')}, list_aggregate(list_transform(groups, lambda g: list_aggregate(list_sort(g), 'string_agg', '+')), 'string_agg', ',') AS groups, {BIG('n_effective')} FROM nef",
)
def duplicates_n_effective(spark, sf):
    s, _, chosen = with_leaders(events(spark, sf), store=True)
    out = VA.duplicate_groups(chosen, VA.pair_correlation(chosen, s.labelled))
    return out.withColumn("groups", F.transform("groups", lambda g: F.concat_ws("+", g))).withColumn(
        "groups", F.when(F.size("groups") > 0, F.concat_ws(",", "groups"))
    )


# ------------------------------------------------------------- rolling windows
@dataclass
class Orders:
    market: PX.Market
    settings: object
    windows: DataFrame
    regime: DataFrame
    levels: DataFrame

    def daily(self):
        return ST.daily(self.market, self.settings, store=True)


def orders(spark, sf_dir, study=90, evald=7, step=30, **changes) -> Orders:
    market = PX.from_orders(spark, sf_dir)
    edges = WN.data_edges(market.prices)
    return Orders(
        market,
        PX.order_settings(**changes),
        durable(WN.window_grid(edges, study, evald, step), "windows"),
        SR.regime_total(market.prices),
        RU.reservoir_level(market.reservoirs),
    )


OC = O.order_chain()
_GRID = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in ("study_start", "study_end", "eval_start", "eval_end"))


@query("window_grid", sel(f"window_id, {_GRID}", "windows", ch=OC))
def window_grid(spark, sf):
    market = PX.from_orders(spark, sf)
    return WN.window_grid(WN.data_edges(market.prices), 90, 7, 30)


@query(
    "window_join",
    sel(
        f"window_id, phase, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT p.day) AS BIGINT) AS n_days, "
        f"{O.R('sum(CAST(p.demand AS DECIMAL(18,2)))')} AS demand, {O.R(O.SUM2('p.margin'))} AS margin",
        "panel p JOIN spans s ON p.day BETWEEN s.start_day AND s.end_day",
        "WHERE phase <> 'study' GROUP BY ALL",
        ch=OC,
    ),
)
def window_join(spark, sf):
    market = PX.from_orders(spark, sf)
    settings = PX.order_settings()
    grid = WN.window_grid(WN.data_edges(market.prices), 90, 7, 30)
    rows = WN.by_window(
        ST.daily(market, settings).panel, WN.phase_days(WN.phase_spans(grid, 2))
    )
    per_day = rows.groupBy(*WINDOW, "phase", "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("demand").cast("decimal(18,2)")).alias("d"),
        F.sum(F.col("margin").cast("decimal(18,2)")).alias("m"),
    )
    return per_day.groupBy(*WINDOW, "phase").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_days"),
        dec_round(F.sum("d"), 2).alias("demand"),
        dec_round(F.sum("m"), 2).alias("margin"),
    )


@query(
    "walk_forward_grid",
    sel(
        "CAST(s AS BIGINT) AS step, CAST(CAST(last_day - CAST(7 * s + 36 AS INTEGER) AS DATE) AS VARCHAR) AS study_start, "
        "CAST(CAST(last_day - CAST(7 * s AS INTEGER) AS DATE) AS VARCHAR) AS eval_end",
        "(SELECT max(day) AS last_day FROM prices), range(0, 6) t(s)", ch=OC,
    ),
)
def walk_forward_grid(spark, sf):
    market = PX.from_orders(spark, sf)
    edges = WN.data_edges(market.prices)
    return WN.walk_forward_grid(edges, 30, 7, 6).select("step", "study_start", "eval_end")


_SCAN = (
    f"{O.CMB}, {BIG('n_leaders')}, {BIG('n_effective')}, codes, relative_top, follower_median, p_value, replication_ratio, dsr, "
    "pct_beats_segment, CAST(kill_switch AS BIGINT) AS kill_switch, drawdown, ev_history, ev_dry_year, "
    "CAST(over_capacity AS BIGINT) AS over_capacity, capacity_pct, mae_mean, CAST(valid_cheap AS BIGINT) AS valid_cheap"
)
_SCAN_COLS = [
    *COMBO, "n_leaders", "n_effective", "codes", "relative_top", "follower_median", "p_value", "replication_ratio", "dsr",
    "pct_beats_segment", "kill_switch", "drawdown", "ev_history", "ev_dry_year", "over_capacity", "capacity_pct", "mae_mean",
    "valid_cheap",
]


def order_scan(spark, sf):
    o = orders(spark, sf)
    s, ev = SN.scan_study(o.daily(), o.market, o.settings, o.windows)
    rows = SN.scan_leaders(s, ev, o.settings, o.windows, o.regime, o.levels)
    return o, SN.with_candidates(rows, o.settings)


@query("window_scan", OC + O.scan_sql(200) + f"SELECT {_SCAN} FROM gated")
def window_scan(spark, sf):
    return order_scan(spark, sf)[1].select(*_SCAN_COLS)


@query(
    "scan_top",
    OC + O.scan_sql(200)
    + f"SELECT {_SCAN} FROM gated ORDER BY p_value NULLS FIRST, relative_top DESC NULLS LAST, window_id, segment, archetype LIMIT 20",
)
def scan_top(spark, sf):
    return SC.top_combinations(order_scan(spark, sf)[1]).select(*_SCAN_COLS)


@query(
    "gate_pass_rates",
    OC + O.scan_sql(200)
    + "SELECT gate, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_candidates AS BIGINT) AS n_candidates, p_min, p_median, "
    + f"CAST(n_passed AS BIGINT) AS n_passed, {O.R('n_passed * 100.0 / n_rows', 1)} AS pct_passed FROM (UNPIVOT (SELECT count(*) AS n_rows, "
    + f"count(*) FILTER (WHERE valid_cheap) AS n_candidates, min(p_value) AS p_min, {O.UM('p_value')} AS p_median, "
    + ", ".join(f"count(*) FILTER (WHERE {g}) AS {g}" for g in O.GATE_SQL)
    + " FROM gated) ON " + ", ".join(O.GATE_SQL) + " INTO NAME gate VALUE n_passed)",
)
def gate_pass_rates(spark, sf):
    return SC.gate_pass_rates(order_scan(spark, sf)[1], ["mode"]).drop("mode")


@query(
    "sweep",
    OC + O.scan_sql(200)
    + f""", swept AS (SELECT *, coalesce(p_value <= 0.05 AND replication_ratio >= 0.5 AND n_effective >= 3, false) AS valid FROM scan),
placed AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY valid DESC, relative_top DESC, segment, archetype) AS pos FROM swept)
SELECT {O.CMB}, {BIG('pos')}, {BIG('n_leaders')}, {BIG('n_effective')}, codes, relative_top, follower_median, p_value, replication_ratio, drawdown,
 CAST(kill_switch AS BIGINT) AS kill_switch_1_0, CAST(valid AS BIGINT) AS valid_1_0 FROM placed WHERE pos <= 20""",
)
def sweep(spark, sf):
    o, rows = order_scan(spark, sf)
    return SK.sweep_table(SN.sweep(rows, o.settings), COMBO + ["pos"])


_ASSESS_CH = O.event_chain(weighted=True)
_PERSIST = f"""
hs0 AS (SELECT {O.CMB}, agent_id, count(*) AS n_days, {O.UM('margin')} AS level, min(agent_id || '|' || CAST(day AS VARCHAR)) AS k FROM hold GROUP BY ALL),
hs AS (SELECT h.*, row_number() OVER (PARTITION BY {O.CMB} ORDER BY level DESC, k) - 1 AS position, count(*) OVER (PARTITION BY {O.CMB}) AS n
 FROM hs0 h JOIN (SELECT window_id, n_study_days FROM ndays WHERE phase = 'holdout') USING (window_id) WHERE n_days >= {O.NEED('n_study_days', 20)}),
hn AS (SELECT {O.CMB}, count(*) AS n_holdout FROM hs GROUP BY ALL),
held AS (SELECT l.window_id, l.segment, l.archetype,
 CASE WHEN max(n_holdout) IS NOT NULL THEN {O.R('count(*) FILTER (WHERE position < n_holdout / 2) * 100.0 / count(*)', 1)} END AS persistence_pct
 FROM leaders l LEFT JOIN (SELECT {O.CMB}, agent_id, position FROM hs) h USING ({O.CMB}, agent_id) LEFT JOIN hn USING ({O.CMB}) GROUP BY l.window_id, l.segment, l.archetype),
"""
_ASSESS = (
    f"{O.CMB}, {BIG('n_leaders')}, {BIG('n_effective')}, codes, relative_mean, follower_median, leaders_median, segment_median, pct_beats_segment, pct_beats_leaders, "
    "p_value, boot_best, boot_null_p50, boot_null_p95, replication_in, replication_out, replication_ratio, persistence_pct, sharpe, skew, kurtosis, dsr, "
    "stress_margin, extreme_margin, ev_history, ev_dry_year, drawdown, p5, p95, capacity_pct, verdict, "
)
_VALID = "coalesce(p_value <= 0.05 AND persistence_pct >= 50 AND replication_ratio >= 0.5 AND n_effective >= 3, false)"


def event_assessment(spark, sf):
    e = events(spark, sf)
    e.settings = replace(e.settings, policy=replace(e.settings.policy, weighted=True))
    levels = RU.reservoir_level(e.market.reservoirs)
    regime = SR.regime_total(e.market.prices)
    return e, AS.assess(e.daily, e.market, e.settings, e.windows, regime, levels=levels), levels


@query(
    "assessment",
    _ASSESS_CH + _PERSIST + O.scan_sql(1000, "persistence_pct", f"LEFT JOIN held USING ({O.CMB})").replace(
        "AS persistence\n", "AS persistence, persistence_pct\n"
    )
    + f"SELECT {_ASSESS} CAST({_VALID} AS BIGINT) AS target_valid FROM gated",
)
def assessment(spark, sf):
    a = event_assessment(spark, sf)[1]
    return a.summary.select(
        *COMBO, "n_leaders", "n_effective", "codes", "relative_mean", "follower_median", "leaders_median", "segment_median",
        "pct_beats_segment", "pct_beats_leaders", "p_value", "boot_best", "boot_null_p50", "boot_null_p95", "replication_in",
        "replication_out", "replication_ratio", "persistence_pct", "sharpe", "skew", "kurtosis", "dsr", "stress_margin",
        "extreme_margin", "ev_history", "ev_dry_year", "drawdown", "p5", "p95", "capacity_pct", "verdict", "target_valid",
    )


@query(
    "gates",
    _ASSESS_CH + _PERSIST + O.scan_sql(1000, "persistence_pct", f"LEFT JOIN held USING ({O.CMB})")
    + f"SELECT {O.CMB}, " + ", ".join(f"CAST({g} AS BIGINT) AS {g}" for g in sorted(O.GATE_SQL))
    + ", CAST(valid_cheap AS BIGINT) AS valid_cheap, CAST(valid_final AS BIGINT) AS valid_final, "
    + " || ".join(f"'{g}=' || CAST({g} AS INTEGER) || ';'" for g in sorted(O.GATE_SQL))
    + " AS gate_detail FROM gated",
)
def gates(spark, sf):
    e, a, _ = event_assessment(spark, sf)
    rows = SC.evaluate_gates(a.summary, e.settings.gates)
    return rows.select(
        *COMBO, *SC.GATES, "valid_cheap", "valid_final", SC.gate_detail().alias("gate_detail")
    )


_AC = O.order_chain(archetypes=True)
_AGATES = ", ".join(f"{v} AS {k}" for k, v in O.GATE_SQL.items())


def archetype_gated_sql(chain: str, presence: float, boot: int = 200, persistence: str = "CAST(NULL AS DOUBLE)", held: str = "") -> str:
    """Every window and segment judged by its winning archetypes, as table ``agated``."""
    return (
        chain + O.archetype_boot_sql(boot, presence).rstrip() + ",\natr AS (SELECT window_id, segment, '*' AS archetype, n_trials FROM aboot),"
        + O.sharpe_sql("sim", O.CMB, "atr")
        + f""",
acodes AS (SELECT window_id, segment, string_agg(archetype, ',' ORDER BY archetype) AS codes FROM winners WHERE bin IS NOT NULL GROUP BY ALL),
ascan AS (SELECT j.* EXCLUDE (archetype), b.best AS archetype, b.n_units AS n_leaders, b.n_units AS n_effective, b.p_value, c.codes, d.dsr,
 {persistence} AS persistence FROM judged j LEFT JOIN aboot b USING (window_id, segment) LEFT JOIN acodes c USING (window_id, segment)
 LEFT JOIN dsrs d USING (window_id, segment) {held}),
agated0 AS (SELECT *, {_AGATES} FROM ascan),
agated AS (SELECT *, V1_bootstrap AND V2_n_effective AND V4_replication AND V5_dsr AND E1_beats_segment AND E2_no_kill_switch AND E3_expected_value AND E4_capacity AS valid_cheap,
 0.0::DOUBLE AS relative_top, CAST(NULL AS DOUBLE) AS mae_mean FROM agated0)
"""
    )


@query("window_scan_archetype", archetype_gated_sql(_AC, 5) + f"SELECT {_SCAN} FROM agated")
def window_scan_archetype(spark, sf):
    o = orders(spark, sf)
    s, ev = SN.scan_study(o.daily(), o.market, o.settings, o.windows)
    rows = SN.scan_archetypes(s, ev, o.settings, o.windows, o.regime, o.levels)
    return SN.with_candidates(rows, o.settings).select(*_SCAN_COLS)


_WALK_CH = O.order_chain(spans=O.walk_spans(), main="select", weighted=True)
@query(
    "walk_forward",
    _WALK_CH + _PERSIST.replace(O.NEED("n_study_days", 20), O.NEED("n_study_days", 5))
    + O.scan_sql(1000, "persistence_pct", f"LEFT JOIN held USING ({O.CMB})").rstrip()
    + f""",
walked AS (SELECT g.*, w.step, row_number() OVER (PARTITION BY g.segment, g.archetype ORDER BY w.step) - 1 AS i FROM gated g JOIN windows w USING (window_id))
SELECT segment, archetype, CAST(step AS BIGINT) AS step, window_id, CAST(n_leaders AS BIGINT) AS n_leaders, follower_median, leaders_median, segment_median,
 replication_ratio, dsr, CAST(kill_switch AS BIGINT) AS kill_switch, p_value, persistence FROM walked WHERE i = step""",
)
def walk_forward(spark, sf):
    return walk_forward_steps(spark, sf).select(
        "segment", "archetype", "step", "window_id", "n_leaders", "follower_median", "leaders_median", "segment_median",
        "replication_ratio", "dsr", "kill_switch", "p_value", "persistence",
    )


def walk_forward_steps(spark, sf):
    market = PX.from_orders(spark, sf)
    settings = PX.order_settings()
    settings = replace(settings, policy=replace(settings.policy, weighted=True))
    edges = WN.data_edges(market.prices)
    windows = durable(WN.walk_forward_grid(edges, 30, 7, 6), "windows")
    return AS.walk_forward(
        ST.daily(market, settings, True, windows),
        market,
        settings,
        windows,
        SR.regime_total(market.prices),
        levels=RU.reservoir_level(market.reservoirs),
    )


@query(
    "walk_forward_levels",
    f"SELECT segment, archetype, count(*) AS steps, {O.UM('replication_ratio', 'replication_ratio IS NOT NULL')} AS ratio_median, "
    f"{O.UM('dsr', 'dsr IS NOT NULL')} AS dsr_median FROM ({ORACLES['walk_forward']}) GROUP BY segment, archetype",
)
def walk_forward_levels(spark, sf):
    return AS.walk_forward_levels(walk_forward(spark, sf))


def both_modes(leaders: str, archetypes: str) -> str:
    """The gated rows of both ways of a scan, one below the other, as table ``scanned``."""
    return (
        f"WITH scanned AS (SELECT * FROM ({leaders}SELECT 'leaders' AS mode, persistence, {_SCAN} FROM gated) "
        f"UNION ALL SELECT * FROM ({archetypes}SELECT 'archetype' AS mode, persistence, {_SCAN} FROM agated))"
    )


_LIMITS = PX.order_settings().scan
_PICKED = """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY mode, valid_cheap ORDER BY p_value NULLS FIRST, follower_median DESC NULLS LAST,
 window_id, segment, archetype) AS r FROM scanned),
picked AS (SELECT * EXCLUDE (r) FROM ranked """ + (
    f"WHERE CASE WHEN valid_cheap = 1 THEN r <= {_LIMITS.max_confirm} ELSE r <= {_LIMITS.near_confirm} END)\n"
)
_COARSE = both_modes(OC + O.scan_sql(200), archetype_gated_sql(_AC, 5)) + _PICKED


@query("scan_to_confirm", _COARSE + "SELECT * EXCLUDE (persistence) FROM picked")
def scan_to_confirm(spark, sf):
    """Candidates of both modes over the grid, and those that just missed."""
    o = orders(spark, sf)
    scan = AC.coarse_scan(o.daily(), o.market, o.settings, o.windows, o.regime, o.levels)
    picked = SC.to_confirm(scan, o.settings.scan.max_confirm, o.settings.scan.near_confirm)
    return picked.select("mode", *_SCAN_COLS)


_AT = {"study_start": ("a", 5), "study_end": ("b", -12), "eval_start": ("b", -9), "eval_end": ("b", -3)}
_GIVEN = {name: f"CAST({edge} + INTERVAL ({k}) DAY AS DATE)" for name, (edge, k) in _AT.items()}
_GIVEN_SPANS = f"""
ends AS (SELECT min(day) AS a, max(day) AS b FROM prices),
spans AS (SELECT 'given' AS window_id, 'select' AS phase, {_GIVEN['study_start']} AS start_day, {_GIVEN['study_end']} AS end_day FROM ends
  UNION ALL SELECT 'given', 'eval', {_GIVEN['eval_start']}, {_GIVEN['eval_end']} FROM ends)"""


@query(
    "given_window_backtest",
    O.chain(O.EVENTS, _GIVEN_SPANS, PX.EVENT_BINS, PX.EVENT_SIZES)
    + f"SELECT {O.CMB}, {BIG('days')}, demand_per_day, follower_median, follower_mean, leaders_median, segment_median, pct_beats_segment, "
    "pct_beats_leaders, guarantee_median, guarantee_max FROM summary",
)
def given_window_backtest(spark, sf):
    """A backtest between dates that the caller gives, with days between study and evaluation left out."""
    e = events(spark, sf)
    edges = WN.data_edges(e.market.prices)
    ends = edges.first()
    at = {"a": ends["first_day"], "b": ends["last_day"]}
    given = {name: at[edge] + timedelta(days=k) for name, (edge, k) in _AT.items()}
    e.windows = durable(WN.window_at_end(edges, window_id="given", **given), "windows")
    spans = WN.phase_spans(e.windows)
    e.spans = spans.withColumn("phase", F.when(F.col("phase") == "study", "select").otherwise(F.col("phase")))
    return BT.eval_summary(event_replay(e)[3].days.where(F.col("phase") == "eval"), COMBO)


_ECONOMIC = "E1_beats_segment AND E2_no_kill_switch AND E3_expected_value AND E4_capacity"
_CHEAP = "V1_bootstrap AND V2_n_effective AND V4_replication AND V5_dsr"
_FULL = f"{_SCAN}, persistence, " + ", ".join(sorted(O.GATE_SQL))
_FINE_LEADERS = (
    O.order_chain(main="select", weighted=True) + _PERSIST.replace(O.NEED("n_study_days", 20), O.NEED("n_study_days", 5))
    + O.scan_sql(_LIMITS.boot_fine, "persistence_pct", f"LEFT JOIN held USING ({O.CMB})")
)
_FINE_ARCHETYPES = archetype_gated_sql(
    _AC, 5, _LIMITS.boot_fine, "hh.persistence_pct",
    "LEFT JOIN (" + O.order_chain(main="select") + _WIN.rstrip() + "," + held_archetype_sql(5) + ") hh USING (window_id, segment)",
)
_BY_MODE = {"leaders": O.CMB, "archetype": "window_id, segment"}
_CONFIRMED = ",\n".join(
    f"fine_{mode} AS (SELECT '{mode}' AS mode, {_FULL} FROM ({sql}SELECT * FROM {table}) "
    f"SEMI JOIN (SELECT {_BY_MODE[mode]} FROM picked WHERE mode = '{mode}') USING ({_BY_MODE[mode]}))"
    for mode, sql, table in (("leaders", _FINE_LEADERS, "gated"), ("archetype", _FINE_ARCHETYPES, "agated"))
)


@query(
    "acceptance",
    _COARSE.rstrip() + ",\n" + _CONFIRMED
    + f"""
SELECT mode, window_id AS study_start, CAST(CAST(window_id AS DATE) + 89 AS VARCHAR) AS study_end, CAST(CAST(window_id AS DATE) + 90 AS VARCHAR) AS eval_start,
 CAST(CAST(window_id AS DATE) + 96 AS VARCHAR) AS eval_end, segment, archetype, n_leaders, n_effective, codes, p_value, replication_ratio, dsr, persistence,
 pct_beats_segment, kill_switch AS kill_switch_1_0, ev_history, over_capacity AS over_capacity_1_0, mae_mean,
 CAST(({_CHEAP} AND V3_holdout) AS BIGINT) AS n1_full, CAST(({_ECONOMIC}) AS BIGINT) AS n2, CAST(({_CHEAP} AND V3_holdout AND {_ECONOMIC}) AS BIGINT) AS valid_final_1_0,
 {" || ".join(f"'{g}=' || CAST({g} AS INTEGER) || ';'" for g in sorted(O.GATE_SQL))} AS gate_detail
 FROM (SELECT * FROM fine_leaders UNION ALL SELECT * FROM fine_archetype)""",
)
def acceptance(spark, sf):
    o = orders(spark, sf)
    out = AC.acceptance(o.daily(), o.market, o.settings, o.windows, o.regime, o.levels)
    return SK.confirmed_table(out["confirmed"], ("mode",))


@query("power")
def power(spark, sf):
    """Every segment and archetype of a window a year, and of the first whole year."""
    market = PX.from_orders(spark, sf)
    settings = PX.order_settings()
    edges = WN.data_edges(market.prices)
    windows = WN.window_grid(edges, 90, 7, 365).unionByName(
        WN.window_grid(edges, 365, 7, 100_000).withColumn("window_id", F.concat_ws("+", "window_id", F.lit("365")))
    )
    sizes = ("LARGE", "MEDIUM", "SMALL")
    named = [
        F.explode(F.array(*map(F.lit, names))).alias(c)
        for c, names in (("segment", sizes), ("archetype", ARCHETYPES))
    ]
    cases = (
        windows.select("window_id", F.col("study_start").alias("start_day"), F.col("study_end").alias("end_day"), named[0])
        .select("*", named[1])
    )
    cases = durable(cases, "cases")
    return AC.power_study(ST.daily(market, settings, True, cases), market, settings, cases)


_FAILED = (
    _ASSESS_CH + _PERSIST + O.scan_sql(1000, "persistence_pct", f"LEFT JOIN held USING ({O.CMB})").replace(
        "AS persistence\n", "AS persistence, persistence_pct\n"
    ).rstrip()
    + f""",
failed AS (SELECT {O.CMB}, demand_ref FROM gated WHERE NOT {_VALID})
"""
)
_TARGETS = (
    _ALT.strip()
    + """,
targets AS (SELECT a.window_id, a.alt_segment AS segment, a.alt_archetype AS archetype, a.segment AS target_segment, a.archetype AS target_archetype,
 a.alt_codes AS codes, a.alt_relative_top AS relative_top, a.alt_absolute_top AS absolute_top, x.demand_ref AS target_demand
 FROM (SELECT f.window_id, f.segment, f.archetype, c.segment AS alt_segment, c.archetype AS alt_archetype, c.codes AS alt_codes, c.relative_top AS alt_relative_top,
  c.absolute_top AS alt_absolute_top, row_number() OVER (PARTITION BY f.window_id, f.segment, f.archetype ORDER BY c.relative_top DESC, c.n_leaders DESC, c.segment, c.archetype) AS r
  FROM failed f JOIN combos c ON c.window_id = f.window_id AND (c.segment <> f.segment OR c.archetype <> f.archetype)) a
 JOIN failed x ON x.window_id = a.window_id AND x.segment = a.segment AND x.archetype = a.archetype WHERE a.r = 1)"""
)
_TARGET_KEYS = f"{O.CMB}, target_segment, target_archetype"


@query(
    "alternatives",
    _FAILED + "SELECT * FROM (" + O.event_chain(sel=Selection(top=5), targets=_TARGETS).rstrip().rstrip(",")
    + f"""
SELECT {_TARGET_KEYS}, t.codes, t.relative_top, t.absolute_top, CAST(days AS BIGINT) AS days, demand_per_day, follower_median, follower_mean,
 leaders_median, segment_median, pct_beats_segment, pct_beats_leaders, guarantee_median, guarantee_max, replication_in, replication_out, replication_ratio
 FROM targets t JOIN summary USING ({_TARGET_KEYS}) LEFT JOIN ratios USING ({_TARGET_KEYS}))""",
)
def alternatives(spark, sf):
    e, a, levels = event_assessment(spark, sf)
    return AS.alternatives(a, e.settings, levels)


# ---------------------------------------------------------------- clustering
@query(
    "cluster_assign",
    CH + f"""cen AS (SELECT window_id, cluster_id, {', '.join(
        O.R(f'{O.SUM2(f)} / count(*)', 4) + f' AS c{i}' for i, f in enumerate(SHARES))} FROM lab GROUP BY ALL),
asg AS (SELECT l.window_id, l.agent_id, l.day, c.cluster_id, row_number() OVER (PARTITION BY l.window_id, l.agent_id, l.day ORDER BY
 (pct_contract - c0) * (pct_contract - c0) + (pct_spot - c1) * (pct_spot - c1) + (pct_unregulated - c2) * (pct_unregulated - c2) + (pct_auction - c3) * (pct_auction - c3), c.cluster_id) AS r
 FROM lab l JOIN cen c ON c.window_id = l.window_id)
SELECT window_id, agent_id, {DAY}, {BIG('cluster_id')} FROM asg WHERE r = 1""",
)
def cluster_assign(spark, sf):
    s = stored_study(events(spark, sf))
    shares = [F.col(x) for x in SHARES]
    centers = (
        s.labelled.groupBy(*WINDOW, "cluster_id")
        .agg(
            F.array(
                *[
                    dec_round(
                        F.sum(x.cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)), 4
                    )
                    for x in shares
                ]
            ).alias("center")
        )
        .groupBy(*WINDOW)
        .agg(F.collect_list(F.struct(F.col("cluster_id").alias("id"), "center")).alias("centers"))
    )
    return s.labelled.join(centers, WINDOW).select(
        *WINDOW,
        "agent_id",
        "day",
        CL.nearest_center(F.array(*shares), F.col("centers"), len(shares))["id"].alias("cluster_id"),
    )


RCH = CH.replace("WITH ", "WITH RECURSIVE ", 1)
_KROWS = "klab AS (SELECT l.* EXCLUDE (cluster_id, archetype), a.id AS cluster_id FROM lab l JOIN kasg a USING (window_id, agent_id, day){})\n"


@query("kmeans_profiles", RCH + O.kmeans_sql([5]).rstrip() + ",\n" + _KROWS.format("") + O.profiles_sql("klab", _PROFILE))
def kmeans_profiles(spark, sf):
    e = events(spark, sf)
    s = ST.study(e.daily, e.market, e.settings, e.span("select"), labels="kmeans", store=True)
    return s.profiles


_KS = list(CL.NUMBERS)


@query("kmeans_best_k", RCH + O.kmeans_sql(_KS) + "SELECT window_id, CAST(k AS BIGINT) AS k, cost, silhouette, CAST(is_best AS BIGINT) AS is_best FROM kqual")
def kmeans_best_k(spark, sf):
    """Cost and silhouette per k, for one study, on whole tables."""
    s = stored_study(events(spark, sf))
    return CL.cluster_quality(CL.cluster_inputs(s.labelled))


@query(
    "kmeans_auto_profiles",
    RCH + O.kmeans_sql(_KS).rstrip() + ",\n" + _KROWS.format(" JOIN kqual k USING (window_id) WHERE k.is_best AND k.k = a.k")
    + O.profiles_sql("klab", _PROFILE),
)
def kmeans_auto_profiles(spark, sf):
    """Profiles of the clusters of the best k."""
    e = events(spark, sf)
    return ST.study(e.daily, e.market, e.settings, e.span("select"), labels="kmeans", store=True, k=None).profiles


@query("window_scan_kmeans", O.order_chain(kmeans=5) + O.scan_sql(200) + f"SELECT {_SCAN} FROM gated")
def window_scan_kmeans(spark, sf):
    """The grid with every window clustered in the same job."""
    o = orders(spark, sf)
    s, ev = SN.scan_study(o.daily(), o.market, o.settings, o.windows, labels="kmeans")
    rows = SN.scan_leaders(s, ev, o.settings, o.windows, o.regime, o.levels)
    return SN.with_candidates(rows, o.settings).select(*_SCAN_COLS)
