"""Transaction costs: as columns for whole trade tables, and for one trade inside the portfolio fold.

Half-spread 2, 5 or 10 basis points for prices above 50, above 10, or lower; impact is the spread times the root of the
trade's share of ``participation`` of the day's dollar volume, a tenth of the spread without volume.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostModel:
    """``scale`` multiplies every part; 0 means no costs."""

    name: str
    commission: float = 0.005
    participation: float = 0.01
    scale: float = 1.0

    def one(self, shares: float, price: float, volume: float) -> tuple[float, float, float]:
        """(commission, spread, impact) of one trade."""
        shares = abs(shares)
        if not self.scale or shares == 0 or price == 0:
            return 0.0, 0.0, 0.0
        value = shares * price
        spread = value * (0.0002 if price > 50 else 0.0005 if price > 10 else 0.0010)
        impact = spread * (math.sqrt(max(value / (volume * price * self.participation), 0.0)) if volume > 0 and price > 0 else 0.1)
        return self.scale * shares * self.commission, self.scale * spread, self.scale * impact

    def columns(self, shares: Column, price: Column, volume: Column) -> dict[str, Column]:
        """commission, spread_cost, market_impact and total_cost of every row."""
        shares = F.abs(shares)
        idle = (shares == 0) | (price == 0)
        value = shares * price
        rate = F.when(price > 50, 0.0002).when(price > 10, 0.0005).otherwise(0.0010)
        share = F.try_divide(value, volume * price * self.participation)
        factor = F.when((volume > 0) & (price > 0), F.sqrt(F.greatest(share, F.lit(0.0)))).otherwise(F.lit(0.1))
        parts = {"commission": shares * self.commission, "spread_cost": value * rate, "market_impact": value * rate * factor}
        parts = {k: F.when(idle, F.lit(0.0)).otherwise(c * self.scale) for k, c in parts.items()}
        return parts | {"total_cost": parts["commission"] + parts["spread_cost"] + parts["market_impact"]}


REALISTIC = CostModel("realistic")
ZERO = CostModel("zero", scale=0.0)
HIGH = CostModel("high", commission=0.01, participation=0.005, scale=2.0)
MODELS = {m.name: m for m in (REALISTIC, ZERO, HIGH)}
