"""Schemas of the tables, checked where a table enters a public operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .errors import InvalidInput

BARS = "ticker string, date date, open double, high double, low double, close double, volume double, adj_close double"
FEATURES = "ticker string, date date, feature_name string, value double, computed_at timestamp"
FEATURE_METADATA = "feature_name string, category string, version int, lookback_days int, description string, last_computed timestamp"
QUALITY = "ticker string, start_date date, end_date date, total_bars long, n_issues long, is_clean boolean, reported_at timestamp"
TICKERS = "ticker string, sector string, first_date date, last_date date, total_bars long, provider string, updated_at timestamp"
INGESTION = "ticker string, start_date date, end_date date, status string, n_rows long, error string, logged_at timestamp"
SIGNALS = "window_idx int, date date, ticker string, weight double"
TRADES = (
    "run_id string, window_idx int, date date, ticker string, side string, shares double, price double, gross_value double, "
    "commission double, spread_cost double, market_impact double, total_cost double, net_value double"
)
EQUITY = (
    "run_id string, window_idx int, date date, portfolio_value double, cash double, positions_value double, "
    "daily_return double, cumulative_return double"
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InvalidInput(f"columns {missing} are missing among {df.columns}")
    return df
