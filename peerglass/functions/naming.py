"""Archetype names from (mean) shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerglass import params as P


def archetype_name(
    unregulated: Column,
    contract: Column,
    spot: Column,
    auction: Column,
    losses: Column | None = None,
) -> Column:
    """First matching rule wins; the losses rule needs a loss share to fire."""
    losses = F.lit(0.0) if losses is None else losses
    mostly_regulated = unregulated <= 30
    rules = [
        (unregulated >= 85, P.UNREGULATED),
        ((contract >= 120) & (unregulated >= 40), P.OVERCONTRACTED),
        ((spot >= 60) & (contract < 50), P.SPOT_EXPOSED),
        (mostly_regulated & (spot < 15) & (auction >= 50), P.INTEGRATED_REGULATED),
        (mostly_regulated, P.REGULATED),
        (losses >= 5, P.MIXED_NETWORK),
        (auction >= 50, P.MIXED_AUCTION),
    ]
    head, *tail = rules
    expr = F.when(head[0], F.lit(head[1]))
    for cond, label in tail:
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(P.MIXED))


def archetype_code(name: Column) -> Column:
    """Position of a label in the rule order, usable as a cluster id."""
    expr = F.lit(None).cast("int")
    for i, label in enumerate(P.ARCHETYPES):
        expr = F.when(name == F.lit(label), F.lit(i)).otherwise(expr)
    return expr
