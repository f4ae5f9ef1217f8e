"""Modelled margin per unit of demand, as one chain of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerglass.functions.numeric import dec_round, safe_div
from peerglass.params import MarginModel

FINANCE = (
    "guarantee",
    "guarantee_cost",
    "provision",
    "tax",
    "net_profit",
    "margin",
    "unit_cost",
    "income",
)


def model_columns(
    demand: Column,
    purchases: Column,
    energy_cost: Column,
    net_exposure: Column,
    model: MarginModel,
) -> dict[str, Column]:
    """Financial result of a row with given volumes, cost and exposure."""
    lit = F.lit
    income = demand * lit(model.sale_price)
    gross = income - energy_cost - purchases * lit(model.charge)
    guarantee = F.greatest(lit(0.0), net_exposure * lit(model.cover_factor))
    guarantee_cost = guarantee * lit(model.annual_rate / 12.0)
    provision = income * lit(model.bad_debt)
    tax = F.greatest(lit(0.0), gross * lit(model.tax))
    net = gross - tax - guarantee_cost - provision
    return {
        "guarantee": dec_round(guarantee, 0),
        "guarantee_cost": dec_round(guarantee_cost, 0),
        "provision": dec_round(provision, 0),
        "tax": dec_round(tax, 0),
        "net_profit": dec_round(net, 0),
        "margin": dec_round(safe_div(net, demand), 2),
        "unit_cost": dec_round(safe_div(energy_cost, purchases), 1),
        "income": dec_round(income, 0),
    }


def entity_day_columns(model: MarginModel) -> dict[str, Column]:
    """Financial result of an entity-day from its volumes and the day's prices."""
    c = F.col
    cost = c("buy_contract") * c("contract") + c("buy_spot") * c("spot")
    sales = c("sell_contract") * c("contract") + c("sell_spot") * c("spot")
    return model_columns(
        demand=c("demand"),
        purchases=c("buy_spot") + c("buy_contract"),
        energy_cost=cost,
        net_exposure=cost - sales,
        model=model,
    )


def clip_margin(margin: Column, limit: float | None) -> Column:
    """Winsorise to ``[-limit, limit]``; no limit leaves the margin alone."""
    if not limit:
        return margin
    return F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), margin))
