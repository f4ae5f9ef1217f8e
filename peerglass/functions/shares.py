"""Share features of one entity-day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peerglass.functions.numeric import dec_round, safe_div

SHARES = ("pct_contract", "pct_spot", "pct_unregulated", "pct_auction")
PROFILE = SHARES + ("has_auction",)
FEATURES = (
    "log_demand",
    "pct_unregulated",
    "pct_contract",
    "pct_spot",
    "pct_auction",
    "has_auction",
)


def _share(num: str, den: Column) -> Column:
    return safe_div(F.col(num), den) * F.lit(100.0)


def feature_columns(auction_clip: float = 100.0) -> dict[str, Column]:
    """Demand, its log and five shares, zero where the denominator is zero."""
    gwh = F.col("demand") / F.lit(1e6)
    auction = F.least(_share("buy_auction", F.col("buy_contract_reg")), F.lit(float(auction_clip)))
    return {
        "demand_gwh": dec_round(gwh, 4),
        "log_demand": dec_round(F.log1p(gwh), 4),
        "pct_unregulated": dec_round(
            _share("demand_unreg", F.col("demand_reg") + F.col("demand_unreg")), 2
        ),
        "pct_contract": dec_round(_share("buy_contract", F.col("demand")), 2),
        "pct_spot": dec_round(_share("buy_spot", F.col("demand")), 2),
        "pct_auction": dec_round(auction, 2),
        "has_auction": F.when(F.col("buy_contract_reg") > 0, 1.0).otherwise(0.0),
    }
