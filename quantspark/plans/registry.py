"""Features: their descriptors, and a registry that user-defined computers extend."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schema import require
from ..settings import FEATURE_VERSION


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    category: str
    lookback_days: int
    version: int = FEATURE_VERSION
    description: str = ""
    dependencies: tuple[str, ...] = ()


# Every feature and its lookback in trading days.
TECHNICAL = {
    "returns_1d": 1, "returns_5d": 5, "returns_21d": 21, "returns_63d": 63, "rsi_14": 14, "rsi_28": 28,
    "macd_signal": 35, "macd_histogram": 35, "momentum_12_1": 252, "mean_reversion_5d": 5, "mean_reversion_21d": 21,
    "bollinger_upper_dist": 20, "bollinger_lower_dist": 20, "z_score_21d": 21, "sma_ratio_5_21": 21,
    "sma_ratio_21_63": 63, "ema_ratio_12_26": 26, "price_to_sma_50": 50, "price_to_sma_200": 200, "golden_cross": 200,
    "death_cross": 200, "volume_ratio_5d": 5, "volume_ratio_21d": 21, "obv_slope_14d": 14, "vwap_distance": 21,
}
VOLATILITY = {
    "realized_vol_5d": 5, "realized_vol_21d": 21, "realized_vol_63d": 63, "vol_ratio_5_21": 21, "vol_ratio_5_63": 63,
    "vol_of_vol_21d": 42, "garman_klass_vol_21d": 21, "parkinson_vol_21d": 21, "vol_regime_z_score": 315,
    "high_low_range_ratio": 21,
}
CROSS_SECTIONAL = {
    "rank_returns_21d": 21, "rank_returns_63d": 63, "sector_relative_return_21d": 21, "sector_relative_return_63d": 63,
    "sector_momentum_21d": 21, "market_breadth": 21, "dispersion_21d": 21, "rank_volume_ratio": 21,
}
MACRO = {
    "spy_returns_5d": 5, "spy_returns_21d": 21, "spy_vol_21d": 21, "spy_drawdown": 0, "spy_above_200sma": 200,
    "market_return_dispersion": 0,
}
CATALOGUE = {"technical": TECHNICAL, "volatility": VOLATILITY, "cross_sectional": CROSS_SECTIONAL, "macro": MACRO}


class FeatureRegistry:
    """Specs by name; a later registration replaces an earlier one."""

    def __init__(self) -> None:
        self._specs: dict[str, FeatureSpec] = {}

    @classmethod
    def standard(cls) -> FeatureRegistry:
        registry = cls()
        for category, features in CATALOGUE.items():
            for name, lookback in features.items():
                registry.register(FeatureSpec(name, category, lookback))
        return registry

    def register(self, spec: FeatureSpec) -> None:
        self._specs[spec.name] = spec

    def get(self, name: str) -> FeatureSpec:
        return self._specs[name]

    def list_features(self, category: str | None = None) -> list[FeatureSpec]:
        found = (s for s in self._specs.values() if category in (None, s.category))
        return sorted(found, key=lambda s: (s.category, s.name))

    def max_lookback(self) -> int:
        return max((s.lookback_days for s in self._specs.values()), default=0)

    def version_hash(self) -> str:
        """Sixteen hex digits that change with any name, version or lookback."""
        text = "|".join(f"{name}:{s.version}:{s.lookback_days}" for name, s in sorted(self._specs.items()))
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s.name, s.category, s.version, s.lookback_days, s.description) for s in self.list_features()]
        return spark.createDataFrame(rows, "feature_name string, category string, version int, lookback_days int, description string")


class FeatureComputer(ABC):
    """A user-defined group of features; it registers its specs when it is made."""

    category: str
    required_columns: tuple[str, ...] = ("ticker", "date")

    def __init__(self, registry: FeatureRegistry) -> None:
        for spec in self.specs():
            registry.register(spec)

    @abstractmethod
    def specs(self) -> list[FeatureSpec]: ...

    @abstractmethod
    def compute(self, bars: DataFrame) -> DataFrame:
        """ticker, date and a column for each spec."""

    def __call__(self, bars: DataFrame) -> DataFrame:
        return self.compute(require(bars, *self.required_columns))


class SingleTickerComputer(FeatureComputer):
    """Uses one ticker's rows: partitioned by ticker."""

    partition = "ticker"


class CrossSectionalComputer(FeatureComputer):
    """Uses all tickers of a date: partitioned by date."""

    partition = "date"
