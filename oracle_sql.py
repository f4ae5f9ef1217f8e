"""The same questions in plain SQL, written without looking at any query plan.

``chain`` builds the common table expressions from the source tables up to the
judged policies; each oracle adds one SELECT.
"""

from __future__ import annotations

import math

from peerglass import params as P
from peerglass.sources import proxies as PX

MEASURES = (
    "demand demand_reg demand_unreg buy_contract buy_contract_reg sell_contract "
    "buy_spot sell_spot buy_auction"
).split()
SHARES = ("pct_contract", "pct_spot", "pct_unregulated", "pct_auction")
PROFILE = SHARES + ("has_auction",)
M = P.MarginModel()
CMB = "window_id, segment, archetype"


def R(x, n=2):
    return f"CAST(round(CAST(({x}) AS DECIMAL(30,10)), {n}) AS DOUBLE)"


def UM(x, where=""):
    tail = f" FILTER (WHERE {where})" if where else ""
    return f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC){tail}"


def SAFE(a, b):
    return f"(CASE WHEN ({b}) = 0 OR ({b}) IS NULL THEN 0.0 ELSE coalesce(({a}) / ({b}), 0.0) END)"


def SUM2(x, where=""):
    tail = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))){tail} AS DOUBLE)"


def NR(x, q):
    return (
        f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"
        f"[CAST(round_even({q} * (count({x}) - 1), 0) AS INTEGER) + 1]"
    )


def NEED(n, pct):
    return f"greatest(1, CAST(round_even({n} * {float(pct)} / 100.0, 0) AS BIGINT))"


def BIN(x, bins: P.SpreadBins):
    cases = " ".join(f"WHEN {x} >= {lo} AND {x} < {hi} THEN '{n}'" for n, lo, hi in bins.bins)
    first, last = bins.bins[0], bins.bins[-1]
    return f"(CASE WHEN {x} < {first[1]} THEN '{first[0]}' {cases} ELSE '{last[0]}' END)"


def BOUND(name, bins: P.SpreadBins, i):
    cases = " ".join(f"WHEN '{b[0]}' THEN CAST({b[i]} AS DOUBLE)" for b in bins.bins)
    return f"(CASE {name} {cases} END)"


ARCHETYPE = f"""(CASE WHEN pct_unregulated >= 85 THEN '{P.UNREGULATED}'
 WHEN pct_contract >= 120 AND pct_unregulated >= 40 THEN '{P.OVERCONTRACTED}'
 WHEN pct_spot >= 60 AND pct_contract < 50 THEN '{P.SPOT_EXPOSED}'
 WHEN pct_unregulated <= 30 AND pct_spot < 15 AND pct_auction >= 50 THEN '{P.INTEGRATED_REGULATED}'
 WHEN pct_unregulated <= 30 THEN '{P.REGULATED}'
 WHEN pct_auction >= 50 THEN '{P.MIXED_AUCTION}'
 ELSE '{P.MIXED}' END)"""
CODE = "(CASE archetype " + " ".join(
    f"WHEN '{a}' THEN {i}" for i, a in enumerate(P.ARCHETYPES)
) + " END)"

EVENTS = """
hourly AS (SELECT CAST(user_id AS VARCHAR) AS agent_id, ts, value * 1000.0 AS demand,
  CASE WHEN event_type IN ('view','click') THEN value * 1000.0 ELSE 0.0 END AS demand_reg,
  CASE WHEN event_type IN ('purchase','signup','error') THEN value * 1000.0 ELSE 0.0 END AS demand_unreg,
  CASE WHEN event_type IN ('purchase','signup','view') THEN value * 900.0 ELSE 0.0 END AS buy_contract,
  CASE WHEN event_type = 'purchase' THEN value * 500.0 ELSE 0.0 END AS buy_contract_reg,
  CASE WHEN event_type = 'click' THEN value * 100.0 ELSE 0.0 END AS sell_contract,
  CASE WHEN event_type IN ('error','click') THEN value * 800.0 ELSE 0.0 END AS buy_spot,
  CASE WHEN event_type = 'error' THEN value * 50.0 ELSE 0.0 END AS sell_spot,
  CASE WHEN event_type = 'purchase' THEN value * 300.0 ELSE 0.0 END AS buy_auction
  FROM events),
agents AS (SELECT CAST(c_custkey AS VARCHAR) AS agent_id, c_name AS name, c_mktsegment AS activity FROM customer),
prices AS (SELECT CAST(ts AS DATE) AS day, CAST(300.0 AS DOUBLE) AS contract,
  CAST(round(CAST(10.0 * (CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'error') AS DOUBLE)
    / count(value) FILTER (WHERE event_type = 'error')) AS DECIMAL(30,10)), 2) AS DOUBLE) AS spot,
  CAST(600.0 AS DOUBLE) AS scarcity FROM events GROUP BY 1),
reservoirs AS (SELECT CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS useful_volume,
  CAST(100.0 AS DOUBLE) AS useful_capacity FROM events)"""

ORDERS = """
hourly AS (SELECT CAST(l_suppkey AS VARCHAR) AS agent_id, l_shipdate AS ts, l_quantity * 1000.0 AS demand,
  CASE WHEN l_returnflag <> 'R' THEN l_quantity * 1000.0 ELSE 0.0 END AS demand_reg,
  CASE WHEN l_returnflag <> 'R' THEN 0.0 ELSE l_quantity * 1000.0 END AS demand_unreg,
  l_quantity * 1000.0 * (0.5 + 5.0 * l_discount) AS buy_contract,
  CASE WHEN l_returnflag <> 'R' THEN l_quantity * 1000.0 * (0.5 + 5.0 * l_discount) ELSE 0.0 END AS buy_contract_reg,
  CAST(0.0 AS DOUBLE) AS sell_contract, l_quantity * 1000.0 * 10.0 * l_tax AS buy_spot, CAST(0.0 AS DOUBLE) AS sell_spot,
  CASE WHEN l_returnflag = 'N' THEN l_quantity * 1000.0 * (0.5 + 5.0 * l_discount) * 0.6 ELSE 0.0 END AS buy_auction
  FROM lineitem),
agents AS (SELECT CAST(s_suppkey AS VARCHAR) AS agent_id, s_name AS name, 'retail' AS activity FROM supplier),
prices AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(220.0 AS DOUBLE) AS contract,
  CAST(round(CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) / 1000.0 AS DECIMAL(30,10)), 2) AS DOUBLE) AS spot,
  CAST(330.0 AS DOUBLE) AS scarcity FROM orders GROUP BY 1),
reservoirs AS (SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS useful_volume,
  CAST(1.0 AS DOUBLE) AS useful_capacity FROM orders)"""


def event_spans():
    n, w = PX.EVENT_EVAL_DAYS, PX.EVENT_WINDOW_ID
    day = lambda k: f"CAST(b - INTERVAL {k} DAY AS DATE)"
    return f"""
ends AS (SELECT min(day) AS a, max(day) AS b FROM prices),
spans AS (SELECT '{w}' AS window_id, 'study' AS phase, a AS start_day, {day(n)} AS end_day FROM ends
  UNION ALL SELECT '{w}', 'select', a, {day(n + 2)} FROM ends
  UNION ALL SELECT '{w}', 'holdout', {day(n + 1)}, {day(n)} FROM ends
  UNION ALL SELECT '{w}', 'eval', {day(n - 1)}, b FROM ends)"""


def order_spans(study=90, evald=7, step=30, holdout=2):
    return f"""
grid AS (SELECT CAST(s AS DATE) AS study_start FROM (SELECT min(day) AS first_day, max(day) AS last_day FROM prices) e,
  LATERAL (SELECT unnest(generate_series(e.first_day,
    CAST(e.last_day - INTERVAL {study + evald - 1} DAY AS DATE), INTERVAL {step} DAY)) AS s)),
windows AS (SELECT CAST(study_start AS VARCHAR) AS window_id, study_start,
  CAST(study_start + INTERVAL {study - 1} DAY AS DATE) AS study_end,
  CAST(study_start + INTERVAL {study} DAY AS DATE) AS eval_start,
  CAST(study_start + INTERVAL {study + evald - 1} DAY AS DATE) AS eval_end FROM grid),
spans AS (SELECT window_id, 'study' AS phase, study_start AS start_day, study_end AS end_day FROM windows
  UNION ALL SELECT window_id, 'select', study_start, CAST(study_end - INTERVAL {holdout} DAY AS DATE) FROM windows
  UNION ALL SELECT window_id, 'holdout', CAST(study_end - INTERVAL {holdout - 1} DAY AS DATE), study_end FROM windows
  UNION ALL SELECT window_id, 'eval', eval_start, eval_end FROM windows)"""


def _features():
    share = lambda a, b: f"{SAFE(a, b)} * 100.0"
    return f"""
 {R('demand / 1e6', 4)} AS demand_gwh, {R('ln(1 + demand / 1e6)', 4)} AS log_demand,
 {R(share('demand_unreg', 'demand_reg + demand_unreg'))} AS pct_unregulated,
 {R(share('buy_contract', 'demand'))} AS pct_contract, {R(share('buy_spot', 'demand'))} AS pct_spot,
 {R(f"least({share('buy_auction', 'buy_contract_reg')}, {M.auction_clip})")} AS pct_auction,
 CASE WHEN buy_contract_reg > 0 THEN 1.0 ELSE 0.0 END AS has_auction"""


def finance(demand, purchases, cost, net, prefix=""):
    """Named money expressions from expressions of a row."""
    income = f"(({demand}) * {M.sale_price})"
    gross = f"({income} - ({cost}) - ({purchases}) * {M.charge})"
    guarantee = f"greatest(0.0, ({net}) * {M.cover_factor})"
    gcost = f"({guarantee} * {M.annual_rate / 12.0!r})"
    prov = f"({income} * {M.bad_debt})"
    tax = f"greatest(0.0, {gross} * {M.tax})"
    profit = f"({gross} - {tax} - {gcost} - {prov})"
    return {
        "guarantee": R(guarantee, 0),
        "guarantee_cost": R(gcost, 0),
        "provision": R(prov, 0),
        "tax": R(tax, 0),
        "net_profit": R(profit, 0),
        "margin": R(SAFE(profit, demand), 2),
        "unit_cost": R(SAFE(cost, purchases), 1),
        "income": R(income, 0),
    }


ROW_FINANCE = finance(
    "demand",
    "buy_spot + buy_contract",
    "buy_contract * contract + buy_spot * spot",
    "(buy_contract * contract + buy_spot * spot) - (sell_contract * contract + sell_spot * spot)",
)
CLIPPED = f"greatest(-{M.margin_clip}, least({M.margin_clip}, {ROW_FINANCE['margin']}))"


def weights_sql():
    return f"""wts AS (SELECT *, e / sum(e) OVER (PARTITION BY {CMB}) AS weight FROM (SELECT *, exp((median_margin - max(median_margin) OVER w)
  / greatest(max(median_margin) OVER w - min(median_margin) OVER w, 1.0) + 0.5 * (n_days / max(n_days) OVER w)) AS e
  FROM leaders WINDOW w AS (PARTITION BY {CMB})))"""


def winners_sql(bins):
    key = "agent_id || '|' || CAST(day AS VARCHAR)"
    return f"""seen AS (SELECT window_id, segment, bin, cluster_id, archetype, rel, {key} AS k FROM lab
  UNION ALL SELECT window_id, segment, '*', cluster_id, archetype, rel, {key} FROM lab),
ranked AS (SELECT window_id, segment, bin, cluster_id, max(archetype) AS archetype, {UM('rel')} AS relative_median, min(k) AS k FROM seen GROUP BY ALL),
winners AS (SELECT window_id, segment, nullif(bin, '*') AS bin, cluster_id, archetype, relative_median FROM
  (SELECT *, row_number() OVER (PARTITION BY window_id, segment, bin ORDER BY relative_median DESC, k) AS r FROM ranked) WHERE r = 1)"""


def archetype_boot_sql(boot, pct):
    """Bootstrap over the archetypes of a segment, as tables ``aboot`` and ``abest``."""
    ws = "window_id, segment"
    return f"""
au0 AS (SELECT {ws}, archetype AS unit, count(*) AS draws, {UM('rel')} AS level, min(agent_id || '|' || CAST(day AS VARCHAR)) AS first_key FROM lab GROUP BY ALL),
au AS (SELECT a.* FROM au0 a JOIN (SELECT window_id, n_study_days FROM ndays WHERE phase = 'study') USING (window_id) WHERE draws >= {NEED('n_study_days', pct)}),
abest AS (SELECT {ws}, unit AS best FROM (SELECT *, row_number() OVER (PARTITION BY {ws} ORDER BY level DESC, first_key) AS r FROM au) WHERE r = 1),
apool AS (SELECT l.window_id, l.segment, l.rel FROM lab l JOIN au ON au.window_id = l.window_id AND au.segment = l.segment AND au.unit = l.archetype),
{boot_sql('au', 'apool', ws, ws, boot, 'ab').strip()},
aboot AS (SELECT {ws}, best, n_units, n_units AS n_trials, p_value FROM ab JOIN abest USING ({ws}))
"""


def chain(
    source: str,
    spans: str,
    bins: P.SpreadBins,
    sizes: P.SizeRule,
    *,
    activities=None,
    main="select",
    weighted=False,
    archetypes=False,
    kmeans=None,
    sel: P.Selection = P.Selection(),
    rules: P.PolicyRules = P.PolicyRules(),
    targets="",
):
    """The study, replay and judgement of every combination, as a list of tables.

    ``targets`` defines a table of that name: which combination stands in for which
    target (target_segment, target_archetype, target_demand). The replay then has a
    row set per target, at the target's demand.
    """
    keys = f"{CMB}, target_segment, target_archetype" if targets else CMB
    wide = ", f.target_segment, f.target_archetype" if targets else ""
    act = ", ".join(f"'{a}'" for a in activities) if activities else None
    keep = f"WHERE activity IN ({act})" if act else ""
    large, medium, small = sizes.labels
    scale = f"(date_diff('day', start_day, end_day) + 1) / {float(sizes.per_days)}" if sizes.per_days else "1.0"
    score = "relative_median" if sel.relative else "median_margin"
    med = ", ".join(f"{R(f'median({f})', 2 if f == 'has_auction' else 1)} AS {f}" for f in PROFILE)
    mix = ", ".join(
        f"{R(f'sum(weight * {f}) / sum(weight)', 2 if f == 'has_auction' else 1)} AS {f}" for f in PROFILE
    )
    ranges = "min(spread) AS spread_min, max(spread) AS spread_max"
    if archetypes:
        fit_sql = f"""{winners_sql(bins)},
span AS (SELECT window_id, segment, {ranges} FROM lab GROUP BY ALL),
mine AS (SELECT l.*, w.bin AS wbin FROM lab l JOIN winners w ON l.window_id = w.window_id AND l.segment = w.segment
  AND l.cluster_id = w.cluster_id AND (w.bin = l.bin OR w.bin IS NULL)),
fit AS (SELECT window_id, segment, '*' AS archetype, wbin AS bin, {med}, count(*) AS n_days, max(spread_min) AS spread_min, max(spread_max) AS spread_max
  FROM mine JOIN span USING (window_id, segment) GROUP BY ALL)"""
    elif weighted:
        fit_sql = f"""{weights_sql()},
each AS (SELECT {CMB}, bin, agent_id, {med}, count(*) AS n_days, {ranges}
  FROM train GROUP BY GROUPING SETS (({CMB}, bin, agent_id), ({CMB}, agent_id))),
fit AS (SELECT {CMB}, bin, {mix}, sum(n_days) AS n_days, min(spread_min) AS spread_min, max(spread_max) AS spread_max
  FROM each JOIN (SELECT {CMB}, agent_id, weight FROM wts) USING ({CMB}, agent_id) GROUP BY ALL)"""
    else:
        fit_sql = f"""fit AS (SELECT {CMB}, bin, {med}, count(*) AS n_days, {ranges}
  FROM train GROUP BY GROUPING SETS (({CMB}, bin), ({CMB})))"""
    named, demand = "", "dref d USING (window_id, segment)"
    if targets:
        fit_sql = fit_sql.replace("fit AS (", "fit0 AS (")
        named = f"{targets},\nfit AS (SELECT * FROM fit0 JOIN (SELECT {keys} FROM targets) USING ({CMB})),\n"
        demand = f"(SELECT {keys}, target_demand AS demand_ref FROM targets) d USING ({keys})"
    expo = rules.outside_exposure_factor
    previous = "coalesce(lag(spot) OVER (PARTITION BY window_id, phase ORDER BY day), spot)"
    follower_cost = "(demand_ref * (pct_contract / 100.0)) * contract + (demand_ref * (pct_spot / 100.0)) * spot"
    fin = finance(
        "demand_ref",
        "(demand_ref * (pct_contract / 100.0)) + (demand_ref * (pct_spot / 100.0))",
        follower_cost,
        follower_cost,
    )
    members = f"""SELECT s.window_id, s.phase, p.*, g.name, g.segment
  FROM panel p JOIN spans s ON p.day BETWEEN s.start_day AND s.end_day
  JOIN seg g ON g.window_id = s.window_id AND g.phase = s.phase AND g.agent_id = p.agent_id"""
    if kmeans:
        means = ", ".join(R(f"CAST(sum(CAST({f} AS DECIMAL(18,4))) AS DOUBLE) / count(*)") + f" AS {f}" for f in PROFILE)
        labels = f"""members AS ({members} WHERE s.phase = '{main}'),
{kmeans_sql([kmeans], "members").strip()},
knamed AS (SELECT window_id, id, {ARCHETYPE} AS archetype FROM
  (SELECT window_id, a.id, {means} FROM members JOIN kasg a USING (window_id, agent_id, day) GROUP BY window_id, a.id)),
lab0 AS (SELECT l.*, n.archetype FROM members l JOIN kasg a USING (window_id, agent_id, day) JOIN knamed n ON n.window_id = a.window_id AND n.id = a.id)"""
    else:
        labels = f"lab0 AS (SELECT *, {ARCHETYPE} AS archetype FROM ({members} WHERE s.phase <> 'eval'))"
    return f"""WITH {'RECURSIVE ' if kmeans else ''}{source},
daily AS (SELECT agent_id, CAST(ts AS DATE) AS day, {', '.join(f'sum({m}) AS {m}' for m in MEASURES)}
  FROM hourly GROUP BY 1, 2),
panel0 AS (SELECT d.*, coalesce(p.contract, 0) AS contract, coalesce(p.spot, 0) AS spot, coalesce(p.scarcity, 0) AS scarcity
  FROM daily d JOIN prices p USING (day)
  WHERE d.demand > 0 AND d.agent_id IN (SELECT agent_id FROM agents {keep})),
panel AS (SELECT *, {_features()}, {CLIPPED} AS margin, {ROW_FINANCE['unit_cost']} AS unit_cost FROM panel0),
levels AS (SELECT day, sum(useful_volume) / nullif(sum(useful_capacity), 0) * 100.0 AS level_pct FROM reservoirs GROUP BY 1),
{spans},
pop AS (SELECT window_id, phase, start_day, end_day, t.agent_id, a.name, a.activity, {R('d / 1e6', 3)} AS total_gwh,
  {R('r / 1e6', 3)} AS reg_gwh, {R('u / 1e6', 3)} AS unreg_gwh
  FROM (SELECT window_id, phase, start_day, end_day, agent_id, sum(demand) AS d, sum(demand_reg) AS r, sum(demand_unreg) AS u
    FROM daily JOIN spans ON day BETWEEN start_day AND end_day GROUP BY ALL HAVING sum(demand) > 0) t
  JOIN agents a USING (agent_id) {keep}),
seg AS (SELECT window_id, phase, agent_id, name, {R('total_gwh', 1)} AS total_gwh,
  {R(SAFE('coalesce(reg_gwh, 0)', 'total_gwh') + ' * 100.0', 1)} AS pct_reg,
  {R(SAFE('coalesce(unreg_gwh, 0)', 'total_gwh') + ' * 100.0', 1)} AS pct_unreg,
  CASE WHEN total_gwh >= {sizes.large_min} * ({scale}) THEN '{large}'
    WHEN total_gwh >= {sizes.medium_min} * ({scale}) THEN '{medium}' ELSE '{small}' END AS segment FROM pop),
{labels},
bench AS (SELECT window_id, phase, segment, day, {UM('margin')} AS bench FROM lab0 GROUP BY ALL),
laball AS (SELECT l.*, {CODE} AS cluster_id, b.bench, {R('margin - coalesce(b.bench, margin)')} AS rel,
  spot - contract AS spread, {BIN('(spot - contract)', bins)} AS bin
  FROM lab0 l LEFT JOIN bench b USING (window_id, phase, segment, day)),
lab AS (SELECT * FROM laball WHERE phase = '{main}'),
hold AS (SELECT * FROM laball WHERE phase = 'holdout'),
ndays AS (SELECT window_id, phase, count(DISTINCT day) AS n_study_days FROM laball GROUP BY ALL),
running AS (SELECT *, sum(CAST(margin AS DECIMAL(18,2))) OVER (PARTITION BY {CMB}, agent_id ORDER BY day
  ROWS UNBOUNDED PRECEDING) AS run FROM lab),
peaks AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY {CMB}, agent_id ORDER BY day ROWS UNBOUNDED PRECEDING)) AS peak FROM running),
stats AS (SELECT {CMB}, agent_id, max(name) AS name, count(*) AS n_days, {UM('margin')} AS median_margin,
  {R(SUM2('margin') + ' / count(*)')} AS mean_margin, {R('count(*) FILTER (WHERE margin < 0) * 100.0 / count(*)', 1)} AS pct_loss_days,
  CAST(max(peak - run) AS DOUBLE) AS drawdown, coalesce({UM('margin', 'margin < 0')}, 0.0) AS downside_median,
  {UM('rel')} AS relative_median, {R('count(*) FILTER (WHERE rel > 0) * 100.0 / count(*)', 1)} AS pct_above_segment
  FROM peaks GROUP BY ALL),
eligible AS (SELECT s.*, n_study_days FROM stats s JOIN ndays n ON n.window_id = s.window_id AND n.phase = '{main}'
  WHERE n_days >= {NEED('n_study_days', sel.min_presence_pct)}),
leaders AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {CMB} ORDER BY {score} DESC, n_days DESC, agent_id) AS pos
  FROM eligible) WHERE pos <= {sel.top}),
evalp AS (SELECT s.window_id, s.phase, p.*, g.segment FROM panel p JOIN spans s ON p.day BETWEEN s.start_day AND s.end_day AND s.phase = 'eval'
  LEFT JOIN seg g ON g.window_id = s.window_id AND g.phase = '{main}' AND g.agent_id = p.agent_id),
train AS (SELECT l.* FROM lab l SEMI JOIN leaders k ON l.window_id = k.window_id AND l.segment = k.segment
  AND l.archetype = k.archetype AND l.agent_id = k.agent_id),
{fit_sql},
{named}band AS (SELECT {keys}, {R('spread_min')} AS range_lo, {R('spread_max')} AS range_hi FROM fit WHERE bin IS NULL),
dref AS (SELECT window_id, segment, median(demand) AS demand_ref FROM lab WHERE demand > 0 GROUP BY ALL),
cap AS (SELECT window_id, segment, median(d) AS segment_demand FROM
  (SELECT window_id, segment, day, sum(demand) AS d FROM lab GROUP BY ALL) GROUP BY ALL),
rowsboth AS (SELECT window_id, phase, day, agent_id, segment, contract, spot, scarcity, margin, {', '.join(SHARES)} FROM lab
  UNION ALL SELECT window_id, phase, day, agent_id, segment, contract, spot, scarcity, margin, {', '.join(SHARES)} FROM evalp),
mdays AS (SELECT window_id, phase, day, max(contract) AS contract, max(spot) AS spot, max(scarcity) AS scarcity FROM rowsboth GROUP BY ALL),
ctx AS (SELECT *, {BIN('context_spread', bins)} AS bin FROM
  (SELECT *, {previous} - contract AS context_spread FROM mdays)),
picked AS (SELECT * FROM (SELECT c.*, f.segment, f.archetype{wide}, f.bin AS rule_bin, {', '.join(f'f.{x} AS r_{x}' for x in PROFILE)},
  row_number() OVER (PARTITION BY c.window_id, c.phase, c.day, f.segment, f.archetype{wide} ORDER BY
    CASE WHEN f.bin IS NULL THEN 2 WHEN f.bin = c.bin THEN 0 ELSE 1 END,
    CASE WHEN context_spread BETWEEN {BOUND('f.bin', bins, 1)} AND {BOUND('f.bin', bins, 2)} THEN 0.0
      ELSE least(abs(context_spread - {BOUND('f.bin', bins, 1)}), abs(context_spread - {BOUND('f.bin', bins, 2)})) END, f.bin) AS rk
  FROM ctx c JOIN fit f USING (window_id)) WHERE rk = 1),
banded AS (SELECT p.*, d.demand_ref, coalesce(context_spread BETWEEN range_lo AND range_hi, true) AS in_distribution
  FROM picked p JOIN band USING ({keys}) JOIN {demand}),
moved AS (SELECT *, CASE WHEN in_distribution THEN r_pct_spot ELSE {R(f'r_pct_spot * {expo}', 1)} END AS pct_spot FROM banded),
acted AS (SELECT *, CASE WHEN in_distribution THEN r_pct_contract ELSE {R('r_pct_contract + (r_pct_spot - pct_spot)', 1)} END AS pct_contract,
  r_pct_unregulated AS pct_unregulated, r_pct_auction AS pct_auction, r_has_auction AS has_auction FROM moved),
segday AS (SELECT window_id, phase, segment, day, {UM('margin')} AS segment_margin FROM rowsboth WHERE segment IS NOT NULL GROUP BY ALL),
ledday AS (SELECT r.window_id, r.phase, k.segment, k.archetype, r.day, {UM('r.margin')} AS leaders_margin,
  {', '.join(f"{UM('r.' + x)} AS real_{x}" for x in SHARES)}
  FROM rowsboth r JOIN leaders k ON r.window_id = k.window_id AND r.agent_id = k.agent_id GROUP BY ALL),
sim AS (SELECT a.*, {fin['margin']} AS follower_margin, {fin['guarantee']} AS guarantee, spot > scarcity AS is_scarcity,
  l.leaders_margin, {', '.join(f'l.real_{x}' for x in SHARES)}, s.segment_margin, {R('v.level_pct', 1)} AS reservoir_pct
  FROM acted a LEFT JOIN ledday l USING (window_id, phase, segment, archetype, day)
  LEFT JOIN segday s USING (window_id, phase, segment, day) LEFT JOIN levels v USING (day)),
simrun AS (SELECT *, sum(CAST(follower_margin AS DECIMAL(18,2))) OVER (PARTITION BY {keys}, phase ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM sim),
simpeak AS (SELECT *, greatest(0, max(run) OVER (PARTITION BY {keys}, phase ORDER BY day ROWS UNBOUNDED PRECEDING)) AS peak FROM simrun),
summary AS (SELECT {keys}, count(*) AS days, {R('max(demand_ref)', 0)} AS demand_per_day, max(demand_ref) AS demand_ref, {R('median(follower_margin)')} AS follower_median,
  {R(SUM2('follower_margin') + ' / count(*)')} AS follower_mean, {R('median(leaders_margin)')} AS leaders_median,
  {R('median(segment_margin)')} AS segment_median,
  {R('count(*) FILTER (WHERE follower_margin > segment_margin) * 100.0 / nullif(count(segment_margin), 0)', 1)} AS pct_beats_segment,
  {R('count(*) FILTER (WHERE follower_margin > leaders_margin) * 100.0 / nullif(count(leaders_margin), 0)', 1)} AS pct_beats_leaders,
  {R('median(guarantee)', 0)} AS guarantee_median, {R('max(guarantee)', 0)} AS guarantee_max,
  {R(NR('follower_margin', 0.05))} AS p5, {R(NR('follower_margin', 0.95))} AS p95,
  {R('max(peak - run)')} AS drawdown FROM simpeak WHERE phase = 'eval' GROUP BY ALL),
ratios AS (SELECT {keys}, ri AS replication_in, ro AS replication_out, {R('ro / nullif(ri, 0)', 3)} AS replication_ratio FROM
  (SELECT {keys}, {R(f"median(follower_margin) FILTER (WHERE phase = '{main}')")} AS ri,
    {R("median(follower_margin) FILTER (WHERE phase = 'eval')")} AS ro FROM sim GROUP BY ALL)),
refday AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY scarcity DESC, day) AS rk FROM mdays WHERE phase = '{main}') WHERE rk = 1),
shock AS (SELECT window_id, contract, scarcity * factor AS spot, scenario, scarcity * factor - contract AS spread
  FROM refday, (VALUES ('at_scarcity', 1.0), ('beyond_scarcity', 1.25)) v(scenario, factor)),
shockpick AS (SELECT * FROM (SELECT h.*, {BIN('h.spread', bins)} AS bin, f.segment, f.archetype, {', '.join(f'f.{x}' for x in PROFILE)},
  row_number() OVER (PARTITION BY h.window_id, scenario, f.segment, f.archetype ORDER BY
    CASE WHEN f.bin IS NULL THEN 2 WHEN f.bin = {BIN('h.spread', bins)} THEN 0 ELSE 1 END,
    CASE WHEN h.spread BETWEEN {BOUND('f.bin', bins, 1)} AND {BOUND('f.bin', bins, 2)} THEN 0.0
      ELSE least(abs(h.spread - {BOUND('f.bin', bins, 1)}), abs(h.spread - {BOUND('f.bin', bins, 2)})) END, f.bin) AS rk
  FROM shock h JOIN fit f USING (window_id)) WHERE rk = 1),
stress AS (SELECT p.*, {fin['margin']} AS margin, {fin['guarantee']} AS guarantee FROM shockpick p JOIN dref USING (window_id, segment)),
history AS (SELECT year(day) AS year, {R('coalesce(spot, 0) - coalesce(contract, 0)', 8)} AS spread,
  coalesce(scarcity, 0) > 0 AND coalesce(spot, 0) > coalesce(scarcity, 0) AS scarce, {BIN('(coalesce(spot, 0) - coalesce(contract, 0))', bins)} AS bin FROM prices),
regime AS (SELECT count(*) AS n_days, count(*) FILTER (WHERE scarce) AS n_scarcity,
  {R('count(*) FILTER (WHERE scarce) * 100.0 / count(*)')} AS pct_scarcity, {R(UM('spread'), 1)} AS spread_p50,
  {R(NR('spread', 0.95), 1)} AS spread_p95, {R(NR('spread', 0.99), 1)} AS spread_p99, {R('max(spread)', 1)} AS spread_max FROM history),
judged0 AS (SELECT s.*, r.replication_in, r.replication_out, r.replication_ratio, t.stress_margin, t.extreme_margin, g.pct_scarcity,
  {R('s.demand_ref / nullif(c.segment_demand, 0) * 100.0', 1)} AS capacity_pct,
  coalesce(s.demand_ref / nullif(c.segment_demand, 0) * 100.0 > {rules.capacity_max_pct}, false) AS over_capacity,
  drawdown > {rules.kill_drawdown} AS kill_switch
  FROM summary s JOIN ratios r USING ({CMB}) JOIN (SELECT {CMB}, max(margin) FILTER (WHERE scenario = 'at_scarcity') AS stress_margin,
    max(margin) FILTER (WHERE scenario = 'beyond_scarcity') AS extreme_margin FROM stress GROUP BY ALL) t USING ({CMB})
  JOIN cap c USING (window_id, segment), regime g),
judged1 AS (SELECT *, {R('(1.0 - pct_scarcity / 100.0) * follower_median + pct_scarcity / 100.0 * stress_margin')} AS ev_history,
  {R(f'(1.0 - {rules.dry_year_pct / 100.0}) * follower_median + {rules.dry_year_pct / 100.0} * stress_margin')} AS ev_dry_year,
  {R('stress_margin * demand_ref', 0)} AS loss_scarcity_day, {R('extreme_margin * demand_ref', 0)} AS loss_extreme_day FROM judged0),
judged AS (SELECT *, CASE WHEN kill_switch THEN 'kill_switch' WHEN over_capacity THEN 'over_capacity'
  WHEN stress_margin >= 0 THEN 'no_scarcity_loss' WHEN ev_dry_year < 0 THEN 'dry_year_loss'
  WHEN ev_history < 0 THEN 'history_loss' ELSE 'positive_with_tail' END AS verdict FROM judged1),
maes AS (SELECT {CMB}, {', '.join(f"{R(f'avg(abs(r_{x} - real_{x}))')} AS mae_{x}" for x in SHARES)}
  FROM sim WHERE phase = 'eval' AND leaders_margin IS NOT NULL GROUP BY ALL),
fidelity AS (SELECT *, {R('(' + ' + '.join(f'mae_{x}' for x in SHARES) + ') / 4.0')} AS mae_mean FROM maes),
units AS (SELECT s.{CMB.replace(', ', ', s.')}, agent_id AS unit, n_days AS draws, relative_median AS level FROM eligible s),
pool AS (SELECT {CMB}, agent_id, rel FROM lab SEMI JOIN eligible USING ({CMB}, agent_id)),
"""


# Chance that the best of the medians lies at position j or before: the product over the
# classes of units with equally many draws (n of them, m units) of a binomial tail's power.
def _upto(j, size="n_pool"):
    p = f"(({j} + 1) / {size})"
    term = f"exp(lgamma(c.n + 1.0) - lgamma(k + 1.0) - lgamma(c.n - k + 1.0) + k * ln({p}) + (c.n - k) * ln(1 - {p}))"
    tail = f"list_sum(list_transform(range(c.n // 2 + 1, c.n + 1), lambda k: {term}))"
    return (
        f"(CASE WHEN {j} < 0 THEN 0.0 WHEN {j} >= {size} - 1 THEN 1.0 ELSE "
        f"exp(list_sum(list_transform(classes, lambda c: c.m * ln(greatest({tail}, 1e-300))))) END)"
    )


def boot_sql(units, pool, keys, pool_keys, b, name="boot", value="rel", seed=42):
    """The bootstrap of ``units`` (keys, unit, draws, level) against ``pool``, as table ``name``.

    A replicate is the least position of the sorted pool whose chance reaches a number
    that a digest gives.
    """
    u = (
        f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {keys}, CAST(rep AS VARCHAR))), 1, 13) AS BIGINT) + 0.5::DOUBLE)"
        " / 4503599627370496::DOUBLE"
    )
    mid, hi = 0.5 * (b - 1), 0.95 * (b - 1)
    ranks = {"m0": math.floor(mid), "m1": math.ceil(mid), "h0": math.floor(hi), "h1": math.ceil(hi)}
    at = "(acc.lo + acc.hi) // 2"
    seek = (
        f"list_reduce(list_concat([{{'lo': 0::BIGINT, 'hi': n_pool - 1}}], list_transform(range(0, 34), lambda i: {{'lo': 0::BIGINT, 'hi': 0::BIGINT}})), "
        f"lambda acc, x: CASE WHEN acc.lo >= acc.hi THEN acc WHEN {_upto(at)} >= u THEN {{'lo': acc.lo, 'hi': {at}}} "
        f"ELSE {{'lo': {at} + 1, 'hi': acc.hi}} END).lo"
    )
    between = lambda lo, up, pos: (
        f"max(v) FILTER (WHERE r = '{lo}') + (max(v) FILTER (WHERE r = '{up}') - max(v) FILTER (WHERE r = '{lo}')) * {pos - math.floor(pos)}"
    )
    same = " AND ".join(f"s.{k} = k.{k}" for k in pool_keys.split(", "))
    n = name
    return f"""
{n}c AS (SELECT {keys}, list({{'n': draws, 'm': m}}) AS classes, sum(m) AS n_units, max(best) AS best FROM
  (SELECT {keys}, draws, count(*) AS m, max(level) AS best FROM {units} GROUP BY {keys}, draws) GROUP BY {keys}),
{n}p AS (SELECT {', '.join('k.' + k for k in keys.split(', '))}, any_value(classes) AS classes, any_value(n_units) AS n_units, any_value(best) AS best, count(*) AS n_pool,
  count(*) FILTER (WHERE s.{value} < best) AS n_below, count(*) FILTER (WHERE s.{value} <= best) AS n_upto
  FROM {n}c k JOIN {pool} s ON {same} GROUP BY {', '.join('k.' + k for k in keys.split(', '))}),
{n}u AS (SELECT *, list_sort(list_transform(range(1, {b + 1}), lambda rep: {u})) AS us, {_upto('(n_below - 1)')} AS below, {_upto('(n_upto - 1)')} AS upto FROM {n}p),
{n}r AS (SELECT {keys}, classes, n_pool, r, us[i + 1] AS u FROM {n}u, (VALUES {', '.join(f"('{r}', {i})" for r, i in ranks.items())}) t(r, i)),
{n}j AS (SELECT {keys}, r, {seek} AS i FROM {n}r),
{n}s AS (SELECT {pool_keys}, {value} AS v, row_number() OVER (PARTITION BY {pool_keys} ORDER BY {value}) - 1 AS i FROM {pool}),
{n}v AS (SELECT {', '.join('k.' + x for x in keys.split(', '))}, {between('m0', 'm1', mid)} AS p50, {between('h0', 'h1', hi)} AS p95
  FROM {n}j k JOIN {n}s s ON {same} AND s.i = k.i GROUP BY {', '.join('k.' + x for x in keys.split(', '))}),
{n} AS (SELECT {keys}, n_units, n_pool, {b} AS n_boot, {R('best')} AS boot_best, {R('p50')} AS boot_null_p50, {R('p95')} AS boot_null_p95,
  {R(f'(len(list_filter(us, lambda x: x > below)) + 1) / {b + 1}.0', 4)} AS p_value,
  {R(f'len(list_filter(us, lambda x: x <= upto)) * 100.0 / {b}.0', 1)} AS boot_percentile FROM {n}u JOIN {n}v USING ({keys}))
"""


def draws_sql(b, seed=42):
    """The same bootstrap with every value of every unit drawn, as table ``boot``."""
    digest = f"md5(concat_ws('|', '{seed}', window_id, segment, archetype, unit, CAST(rep AS VARCHAR), CAST(b AS VARCHAR)))"
    return f"""
draws0 AS (SELECT {CMB}, unit, draws, unnest(range(1, {b} + 1)) AS rep FROM units),
draws1 AS (SELECT {CMB}, rep, list_sort(flatten(list_transform(range(0, (draws - 1) // 4 + 1), lambda b:
    [substr({digest}, 1, 8), substr({digest}, 9, 8), substr({digest}, 17, 8), substr({digest}, 25, 8)]))[1:draws])[draws // 2 + 1] AS h FROM draws0),
nullmax AS (SELECT {CMB}, rep, max(CAST('0x' || h AS BIGINT) / 4294967296.0) AS u FROM draws1 GROUP BY ALL),
best AS (SELECT {CMB}, max(level) AS best, count(*) AS n_units FROM units GROUP BY ALL),
sized AS (SELECT {CMB}, count(*) AS n_pool FROM pool GROUP BY ALL),
spots AS (SELECT {CMB}, rel, row_number() OVER (PARTITION BY {CMB} ORDER BY rel) - 1 AS i FROM pool),
nulls AS (SELECT m.window_id, m.segment, m.archetype, m.rep, s.rel AS v FROM nullmax m JOIN sized z USING ({CMB})
  JOIN spots s ON s.window_id = m.window_id AND s.segment = m.segment AND s.archetype = m.archetype AND s.i = CAST(floor(m.u * z.n_pool) AS BIGINT)),
tested AS (SELECT {CMB}, count(*) FILTER (WHERE v >= best) AS ge, count(*) FILTER (WHERE v <= best) AS le,
  {R('max(best)')} AS boot_best, max(n_units) AS n_units, {R('quantile_cont(v, 0.5)')} AS boot_null_p50, {R('quantile_cont(v, 0.95)')} AS boot_null_p95
  FROM nulls JOIN best USING ({CMB}) GROUP BY ALL),
boot AS (SELECT {CMB}, n_units, z.n_pool, {b} AS n_boot, boot_best, boot_null_p50, boot_null_p95,
  {R(f'(ge + 1) / {b + 1}.0', 4)} AS p_value, {R(f'le * 100.0 / {b}.0', 1)} AS boot_percentile FROM tested JOIN sized z USING ({CMB}))
"""


# Standard normal: a series of positive terms for the distribution function, and
# Acklam's published rational approximation with one Newton step for its inverse.
def PHI(z):
    terms = (
        f"list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(greatest(abs({z}), 1e-300)) "
        "- (n + 1) * ln(2.0) - lgamma(n + 1.5) + 0.5 * ln(pi()))))"
    )
    return f"(CASE WHEN {z} > 8 THEN 1.0 WHEN {z} < -8 THEN 0.0 ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {terms} END)"


def PPF0(p):
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def horner(coef, x):
        out = f"({coef[0]!r})"
        for k in coef[1:]:
            out = f"({out} * {x} + ({k!r}))"
        return out

    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    mid = f"{horner(a, r)} * {q} / {horner(b + (1.0,), r)}"
    low = f"{horner(c, lo)} / {horner(d + (1.0,), lo)}"
    high = f"-{horner(c, hi)} / {horner(d + (1.0,), hi)}"
    return f"(CASE WHEN {p} < 0.02425 THEN {low} WHEN {p} > 0.97575 THEN {high} ELSE {mid} END)"


def sharpe_sql(sims, keys, trials):
    """Moments, expected maximum and deflated Sharpe ratio of eval series.

    ``trials`` is a table with ``n_trials`` per key.
    """
    shape = "(1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr)"
    newton = lambda x, p: f"({x} - ({PHI(x)} - {p}) / (exp(-{x} * {x} / 2) / sqrt(2 * pi())))"
    e = "2.718281828459045"
    return f"""
mo0 AS (SELECT {keys}, count(follower_margin) AS n, avg(follower_margin) AS a, stddev_samp(follower_margin) AS sd,
  avg(follower_margin ** 2) AS m2, avg(follower_margin ** 3) AS m3, avg(follower_margin ** 4) AS m4 FROM {sims} WHERE phase = 'eval' GROUP BY ALL),
mo1 AS (SELECT {keys}, n, a / sd AS sr, (m3 - 3 * a * m2 + 2 * a ** 3) / ((m2 - a * a) ** 1.5) AS skew,
  (m4 - 4 * a * m3 + 6 * a * a * m2 - 3 * a ** 4) / ((m2 - a * a) ** 2) AS kurt FROM mo0 WHERE n >= 3 AND sd > 0),
mo2 AS (SELECT *, 1.0 - 1.0 / n_trials AS p1, 1.0 - 1.0 / (n_trials * {e}) AS p2 FROM mo1 JOIN {trials} USING ({keys}) WHERE n_trials >= 1),
mo3 AS (SELECT *, {PPF0('greatest(p1, 1e-12)')} AS x1, {PPF0('p2')} AS x2 FROM mo2),
mo4 AS (SELECT *, {newton('x1', 'p1')} AS q1, {newton('x2', 'p2')} AS q2 FROM mo3),
mo5 AS (SELECT *, (sr - sqrt(greatest({shape} / (n - 1), 1e-12)) * ((1 - {P.EULER_GAMMA}) * q1 + {P.EULER_GAMMA} * q2)) * sqrt(n - 1.0)
  / sqrt(greatest({shape}, 1e-12)) AS z FROM mo4),
dsrs AS (SELECT {keys}, n, n_trials, {R('sr', 3)} AS sharpe, {R('skew')} AS skew, {R('kurt')} AS kurtosis,
  {R('CASE WHEN n_trials = 1 THEN 1.0 ELSE ' + PHI('z') + ' END', 3)} AS dsr FROM mo5)"""


def duplicates_sql(threshold=0.9):
    """Pairs of leaders and the sequential merge of look-alikes."""
    pos = "list_position(list_transform(acc, lambda g: list_contains(g, e[1][1]) OR list_contains(g, e[1][2])), true)"
    merged = (
        f"CASE WHEN coalesce({pos}, 0) > 0 THEN list_transform(acc, lambda g, i: CASE WHEN i = {pos} "
        "THEN list_distinct(list_concat(g, e[1])) ELSE g END) ELSE list_concat(acc, e) END"
    )
    return f"""
ls AS (SELECT k.window_id, k.segment, k.archetype, k.agent_id, k.pos, l.day, l.margin FROM leaders k JOIN lab l ON l.window_id = k.window_id AND l.agent_id = k.agent_id),
prs AS (SELECT a.window_id, a.segment, a.archetype, a.pos AS pos_a, b.pos AS pos_b, a.agent_id AS agent_a, b.agent_id AS agent_b, count(*) AS common_days,
  CASE WHEN count(*) >= 3 AND min(a.margin) < max(a.margin) AND min(b.margin) < max(b.margin) THEN covar_pop(a.margin, b.margin) / (stddev_pop(a.margin) * stddev_pop(b.margin)) END AS corr
  FROM ls a JOIN ls b ON a.window_id = b.window_id AND a.segment = b.segment AND a.archetype = b.archetype AND a.day = b.day AND a.pos < b.pos GROUP BY ALL),
eqs AS (SELECT {CMB}, list(agent_id ORDER BY pos) AS members, min(pos) AS p0 FROM leaders GROUP BY {CMB}, median_margin, mean_margin HAVING count(*) > 1),
inits AS (SELECT {CMB}, list(members ORDER BY p0) AS g0 FROM eqs GROUP BY ALL),
links AS (SELECT {CMB}, list([[agent_a, agent_b]] ORDER BY pos_a, pos_b) AS l0 FROM prs WHERE corr > {threshold} GROUP BY ALL),
merges AS (SELECT {CMB}, n_leaders, list_reduce(list_concat([coalesce(g0, CAST([] AS VARCHAR[][]))], coalesce(l0, CAST([] AS VARCHAR[][][]))),
  lambda acc, e: {merged}) AS groups FROM (SELECT {CMB}, count(*) AS n_leaders FROM leaders GROUP BY ALL) LEFT JOIN inits USING ({CMB}) LEFT JOIN links USING ({CMB})),
nef AS (SELECT {CMB}, n_leaders, groups, greatest(1, n_leaders - coalesce(list_sum(list_transform(groups, lambda g: len(g) - 1)), 0)) AS n_effective FROM merges)"""


def kmeans_sql(ks, rows="lab", starts=10):
    """K-means of ``rows`` per window by repeated assignment, as tables ``kcen``, ``kasg`` and ``kqual``.

    The statement must begin WITH RECURSIVE.
    """
    raw = ["ln(1 + demand_gwh)", "pct_unregulated", "least(ln(1 + pct_contract), 300.0)", "ln(1 + pct_spot)", "pct_auction", "has_auction"]
    dims = range(1, len(raw) + 1)
    mean, var = "(m{0} / n)", "sqrt(greatest(s{0} / n - (m{0} / n) * (m{0} / n), 0.0))"
    z = [
        f"CASE WHEN {var.format(i)} > 1e-9 THEN CAST(round(CAST((CAST(x{i} AS DOUBLE) - {mean.format(i)}) / {var.format(i)} AS DECIMAL(30,12)), 8) AS DOUBLE) ELSE 0.0 END"
        for i in dims
    ]
    gap = lambda p, q: " + ".join(f"({p}[{i}] - {q}[{i}]) * ({p}[{i}] - {q}[{i}])" for i in dims)
    gaps = f"list_transform(cs, lambda q: {gap('p', 'q.c')})"
    nearest = f"list_position({gaps}, list_min({gaps}))"
    first = [
        f"SELECT window_id, {s} AS start, [arg_min(p, ({who}agent_id, day))] AS cs FROM kpts GROUP BY window_id"
        for s in range(starts)
        for who in [f"md5(concat_ws('|', agent_id, CAST(day AS VARCHAR), '{s}')), " if s else ""]
    ]
    far = "".join(
        f"""
kini{i} AS (SELECT f.window_id, f.start, CASE WHEN gap > 0 THEN list_append(cs, pt) ELSE cs END AS cs FROM kini{i - 1} f JOIN
  (SELECT window_id, start, max(gap) AS gap, arg_max(p, (gap, agent_id, day)) AS pt FROM
    (SELECT window_id, start, agent_id, day, p, list_min(list_transform(cs, lambda q: {gap('p', 'q')})) AS gap FROM kpts JOIN kini{i - 1} USING (window_id))
   GROUP BY window_id, start) USING (window_id, start)),"""
        for i in range(1, max(ks))
    )
    sums = ", ".join(f"CAST(sum(CAST(p[{i}] AS DECIMAL(20,8))) AS DOUBLE)" for i in dims)
    means = ", ".join(f"CAST(sum(CAST(p[{i}] AS DECIMAL(20,8))) AS DOUBLE) / count(*)" for i in dims)
    square = " + ".join(f"p[{i}] * p[{i}]" for i in dims)
    cross = " + ".join(f"p[{i}] * c.s[{i}]" for i in dims)
    spread = f"greatest(c.n * ({square}) + c.q - 2 * ({cross}), 0.0)"
    mine = f"list_transform(list_filter(clusters, lambda c: c.id = a.id), lambda c: {spread})[1]"
    other = f"list_min(list_transform(list_filter(clusters, lambda c: c.id <> a.id), lambda c: ({spread}) / c.n))"
    return f"""
kraw AS (SELECT *, {', '.join(f'CAST(round(CAST(coalesce({x}, 0.0) AS DECIMAL(30,12)), 8) AS DECIMAL(18,8)) AS x{i}' for i, x in enumerate(raw, 1))} FROM {rows}),
kstat AS (SELECT window_id, CAST(count(*) AS DOUBLE) AS n, {', '.join(f'CAST(sum(x{i}) AS DOUBLE) AS m{i}, CAST(sum(CAST(x{i} AS DECIMAL(19,8)) * CAST(x{i} AS DECIMAL(19,8))) AS DOUBLE) AS s{i}' for i in dims)} FROM kraw GROUP BY window_id),
kpts AS MATERIALIZED (SELECT window_id, agent_id, day, [{', '.join(z)}] AS p FROM kraw JOIN kstat USING (window_id)),
kini0 AS ({' UNION ALL '.join(first)}),{far}
kruns AS (SELECT window_id, k, start, list_transform(cs[1:k], lambda c, i: {{'id': i - 1, 'c': c}}) AS cs FROM kini{max(ks) - 1}, (VALUES {', '.join(f'({k})' for k in ks)}) t(k)),
kmove AS (SELECT window_id, k, start, 0 AS step, cs, false AS rests FROM kruns
  UNION ALL
  SELECT window_id, k, start, any_value(step) + 1, list({{'id': id, 'c': c}} ORDER BY id), list({{'id': id, 'c': c}} ORDER BY id) = any_value(cs) FROM
    (SELECT window_id, k, start, cs[place].id AS id, any_value(step) AS step, any_value(cs) AS cs, [{means}] AS c FROM
      (SELECT m.window_id, k, start, step, cs, p, {nearest} AS place FROM kmove m JOIN kpts USING (window_id) WHERE NOT rests AND step < 300)
     GROUP BY window_id, k, start, cs[place].id)
   GROUP BY window_id, k, start),
krest AS (SELECT window_id, k, start, arg_max(cs, step) AS cs FROM kmove GROUP BY window_id, k, start),
kcost AS (SELECT window_id, k, start, any_value(cs) AS cs, CAST(sum(CAST(list_min({gaps}) AS DECIMAL(30,8))) AS DOUBLE) AS cost
  FROM krest JOIN kpts USING (window_id) GROUP BY window_id, k, start),
kcen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id, k ORDER BY cost, start) AS r FROM kcost) WHERE r = 1),
kasg AS (SELECT window_id, k, agent_id, day, p, cs[{nearest}].id AS id FROM kcen JOIN kpts USING (window_id)),
kheld AS (SELECT window_id, k, list({{'id': id, 'n': n, 'q': q, 's': s}}) AS clusters FROM (SELECT window_id, k, id, count(*) AS n,
  CAST(sum(CAST({square} AS DECIMAL(30,8))) AS DOUBLE) AS q, [{sums}] AS s FROM kasg GROUP BY window_id, k, id) GROUP BY window_id, k),
kwide AS (SELECT a.window_id, a.k, list_filter(clusters, lambda c: c.id = a.id)[1].n AS n, {mine} AS own, {other} AS b FROM kasg a JOIN kheld USING (window_id, k)),
ksil AS (SELECT window_id, k, CAST(sum(CAST(CASE WHEN n = 1 OR greatest(own / nullif(n - 1, 0), b) = 0 THEN 0.0 ELSE
   coalesce((b - own / nullif(n - 1, 0)) / greatest(own / nullif(n - 1, 0), b), 0.0) END AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS silhouette FROM kwide GROUP BY window_id, k),
kscore AS (SELECT window_id, k, {R('cost', 1)} AS cost, {R('silhouette', 4)} AS silhouette FROM kcen JOIN ksil USING (window_id, k) JOIN kstat USING (window_id) WHERE k < n),
kqual AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY silhouette DESC, k) = 1 AS is_best FROM kscore)
"""


def profiles_sql(rows, agg):
    """Named profiles of the clusters of ``rows``; ``agg`` are its aggregates."""
    return f"SELECT *, {ARCHETYPE} AS archetype FROM (SELECT {agg} FROM {rows} GROUP BY window_id, cluster_id)"


GATE_SQL = {
    "V1_bootstrap": "coalesce(p_value <= 0.05, false)",
    "V2_n_effective": "coalesce(n_effective, 0) >= 3",
    "V3_holdout": "coalesce(persistence >= 50.0, true)",
    "V4_replication": "coalesce(replication_ratio >= 0.5, false)",
    "V5_dsr": "coalesce(dsr >= 0.95, false)",
    "E1_beats_segment": "coalesce(pct_beats_segment >= 60.0, false)",
    "E2_no_kill_switch": "NOT coalesce(kill_switch, false)",
    "E3_expected_value": "coalesce(ev_history >= 0.0, false)",
    "E4_capacity": "NOT coalesce(over_capacity, true)",
}


def scan_sql(boot, persistence="CAST(NULL AS DOUBLE)", extra=""):
    """All combinations with every metric and gate, as table ``gated``."""
    gates = ", ".join(f"{v} AS {k}" for k, v in GATE_SQL.items())
    return (
        boot_sql("units", "pool", CMB, CMB, boot).rstrip()
        + ",\nntr AS (SELECT window_id, segment, archetype, n_units AS n_trials FROM boot),"
        + sharpe_sql("sim", CMB, "ntr")
        + ","
        + duplicates_sql()
        + f""",
codes AS (SELECT {CMB}, count(*) AS n_led, string_agg(agent_id, ',' ORDER BY pos) AS codes, {R('median(relative_median)')} AS relative_top,
  {R(SUM2('relative_median') + ' / count(*)')} AS relative_mean FROM leaders GROUP BY ALL),
scan AS (SELECT j.*, b.* EXCLUDE (window_id, segment, archetype), c.codes, c.relative_top, c.relative_mean, n.n_leaders, n.n_effective, f.mae_mean,
  d.sharpe, d.skew, d.kurtosis, d.n_trials, d.dsr, {persistence} AS persistence
  FROM judged j LEFT JOIN boot b USING ({CMB}) JOIN codes c USING ({CMB}) JOIN nef n USING ({CMB}) LEFT JOIN fidelity f USING ({CMB}) LEFT JOIN dsrs d USING ({CMB}) {extra}),
gated0 AS (SELECT *, {gates} FROM scan),
gated AS (SELECT *, V1_bootstrap AND V2_n_effective AND V4_replication AND V5_dsr AND E1_beats_segment AND E2_no_kill_switch AND E3_expected_value AND E4_capacity AS valid_cheap,
  V1_bootstrap AND V2_n_effective AND V3_holdout AND V4_replication AND V5_dsr AND E1_beats_segment AND E2_no_kill_switch AND E3_expected_value AND E4_capacity AS valid_final FROM gated0)
"""
    )


def event_chain(**kw):
    return chain(EVENTS, event_spans(), PX.EVENT_BINS, PX.EVENT_SIZES, **kw)


def walk_spans(study=30, evald=7, steps=6, holdout=2):
    return f"""
windows AS (SELECT CAST(CAST(last_day - CAST({evald} * s + {evald + study - 1} AS INTEGER) AS DATE) AS VARCHAR) AS window_id, s AS step,
  CAST(last_day - CAST({evald} * s + {evald + study - 1} AS INTEGER) AS DATE) AS study_start, CAST(last_day - CAST({evald} * s + {evald} AS INTEGER) AS DATE) AS study_end,
  CAST(last_day - CAST({evald} * s + {evald - 1} AS INTEGER) AS DATE) AS eval_start, CAST(last_day - CAST({evald} * s AS INTEGER) AS DATE) AS eval_end
  FROM (SELECT max(day) AS last_day FROM prices), range(0, {steps}) t(s)),
spans AS (SELECT window_id, 'select' AS phase, study_start AS start_day, CAST(study_end - {holdout} AS DATE) AS end_day FROM windows
  UNION ALL SELECT window_id, 'holdout', CAST(study_end - {holdout - 1} AS DATE), study_end FROM windows
  UNION ALL SELECT window_id, 'eval', eval_start, eval_end FROM windows)"""


def order_chain(**kw):
    spans = kw.pop("spans", None) or order_spans(*kw.pop("grid", (90, 7, 30, 2)))
    kw.setdefault("main", "study")
    return chain(ORDERS, spans, PX.ORDER_BINS, PX.ORDER_SIZES, sel=PX.ORDER_SELECTION, **kw)
