"""All 49 features as one plan, and the pipeline that stores them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cross_sectional import cross_sectional, with_sectors
from ..operators.macro import macro
from ..operators.technical import technical
from ..operators.volatility import volatility
from ..sources.ingest import BarStore
from ..sources.store import FeatureStore
from .registry import CATALOGUE, CROSS_SECTIONAL, MACRO, TECHNICAL, VOLATILITY, FeatureRegistry

ALL_FEATURES = tuple(name for features in CATALOGUE.values() for name in features)
FIRST_DATE = datetime.date(2020, 1, 1)


def feature_frame(bars: DataFrame, index: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """ticker, date and all 49 features of every bar.

    One shuffle by ticker serves all technical and volatility windows; the market-wide features, one row per date, are
    joined last.
    """
    single = volatility(technical(bars)).select("ticker", "date", *TECHNICAL, *VOLATILITY)
    across = cross_sectional(bars, sectors)
    market = macro(index, across.select("date", "dispersion_21d"))
    joined = single.join(across, ["ticker", "date"], "left").join(market, "date", "left")
    return joined.select("ticker", "date", *TECHNICAL, *VOLATILITY, *CROSS_SECTIONAL, *MACRO)


class FeaturePipeline:
    """Computes features from stored bars and stores them.

    Bars are read from ``buffer_days`` calendar days before the first date; the default covers the longest lookback, so
    no feature starts empty for want of history.
    """

    def __init__(self, bars: BarStore, store: FeatureStore, registry: FeatureRegistry | None = None, buffer_days: int | None = None) -> None:
        self.bars, self.store = bars, store
        self.registry = registry or FeatureRegistry.standard()
        self.buffer_days = buffer_days if buffer_days is not None else int(self.registry.max_lookback() * 1.6) + 10

    def run(self, tickers: list[str], start: datetime.date, end: datetime.date, index_ticker: str = "SPY", sectors: DataFrame | None = None, only: list[str] | None = None) -> dict:
        """Features of all ``tickers``, as the cross-section needs them; stored are those of ``only``, if it is given."""
        since = start - datetime.timedelta(days=self.buffer_days)
        panel = self.bars.get_universe_data(tickers, since, end)
        there = {r[0] for r in panel.where(F.col("date") >= F.lit(since)).select("ticker").distinct().collect()}
        failures = [{"ticker": t, "error": "no data"} for t in tickers if t not in there]
        stored = 0
        if there:
            home = sectors if sectors is not None else panel.select("ticker").distinct().withColumn("sector", F.lit("Unknown"))
            index = self.bars.get_data(index_ticker, since, end)
            frame = feature_frame(with_sectors(panel, home), index).where(F.col("date").between(F.lit(start), F.lit(end)))
            stored = self.store.store_features(frame if only is None else frame.where(F.col("ticker").isin(only)))
        self.store.store_feature_metadata(self.registry)
        return {
            "tickers_processed": len(there), "tickers_failed": len(failures), "features_stored": stored,
            "feature_count": len(self.registry.list_features()), "failures": failures,
            "start_date": str(start), "end_date": str(end),
        }

    def run_incremental(self, tickers: list[str], until: datetime.date | None = None, **options) -> dict[str, dict]:
        """Continue every ticker from the day after its own last stored date; runs by their first date.

        A run stores the tickers that continue from its date; the others only take part in its cross-section.
        """
        until = until or datetime.date.today()
        last = {r["ticker"]: r["latest_date"] for r in self.store.latest_dates().where(F.col("ticker").isin(tickers)).collect()}
        groups: dict[datetime.date, list[str]] = {}
        for ticker in tickers:
            groups.setdefault(last[ticker] + datetime.timedelta(days=1) if ticker in last else FIRST_DATE, []).append(ticker)
        return {str(first): self.run(tickers, first, until, only=own, **options) for first, own in sorted(groups.items()) if first <= until}
