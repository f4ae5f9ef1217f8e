"""Small tables for the operator tests."""

from __future__ import annotations

from datetime import date, timedelta

DAY0 = date(2026, 1, 1)
MEASURES = (
    "demand demand_reg demand_unreg buy_contract buy_contract_reg sell_contract buy_spot sell_spot buy_auction"
).split()


def day(i: int) -> date:
    return DAY0 + timedelta(days=i)


def labelled(spark, rows):
    """Rows (agent, day index, segment, archetype, margin); one window."""
    data = [("w", a, a, day(d), s, sum(map(ord, t)), t, float(m), float(m)) for a, d, s, t, m in rows]
    return spark.createDataFrame(
        data,
        "window_id string, agent_id string, name string, day date, segment string, cluster_id int, "
        "archetype string, margin double, rel double",
    )


def panel(spark, rows):
    """Rows of dicts with volumes and prices; missing volumes are zero."""
    cols = ["agent_id", "day", *MEASURES, "contract", "spot", "scarcity"]
    data = [
        tuple(r.get(c, 0.0) if c not in ("agent_id", "day") else r[c] for c in cols) for r in rows
    ]
    schema = "agent_id string, day date, " + ", ".join(f"{c} double" for c in cols[2:])
    return spark.createDataFrame(data, schema)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def upper_median(values):
    return sorted(values)[len(values) // 2]
