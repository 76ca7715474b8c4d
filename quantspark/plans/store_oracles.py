"""DuckDB SQL for the queries through the stores."""

from __future__ import annotations

from .oracles import CHANGES, INDEX, LABELS, MISSING, _stale, bars, macro, rnd, technical
from .store_queries import HIGH, LOW, MID, TICKERS

NUMBERS = ("open", "high", "low", "close", "volume", "adj_close")
BAR = f"ticker, date, {rnd(*NUMBERS, digits=9)}"
SOME = ", ".join(f"'{t}'" for t in TICKERS)
SPAN = f"date BETWEEN DATE '{LOW}' AND DATE '{HIGH}'"
_BREAKS = "high < low OR open > high OR open < low OR close > high OR close < low"

SQL: dict[str, str] = {
    "store_schema": "SELECT * FROM (VALUES ('ohlcv', true), ('data_quality', true), ('ticker_metadata', true), ('ingestion_log', true), ('feature_values', true), ('feature_metadata', true), ('none', false)) AS v(name, present)",
    "store_get_bars": f"WITH {bars()} SELECT {BAR} FROM bars WHERE ticker = 'NATION_3' AND {SPAN}",
    "store_universe_bars": f"WITH {bars()} SELECT {BAR} FROM bars WHERE ticker IN ({SOME}) AND {SPAN}",
    "store_summary": f"WITH {bars()} SELECT count(DISTINCT ticker) AS tickers, count(*) AS total_bars, max(date) FILTER (ticker = 'NATION_3') AS latest, CAST(NULL AS DATE) AS nobody FROM bars",
    "store_upsert": f"WITH {bars()} SELECT ticker, date, {rnd(*(n for n in NUMBERS if n != 'volume'), digits=9)}, round(volume + CASE WHEN dayofweek(date) = 1 THEN 1000 ELSE 0 END, 9) AS volume FROM bars",
    "store_quality": f"""WITH {bars()}, {CHANGES}, {MISSING}, {_stale('close', 5)},
k AS (SELECT ticker FROM bars WHERE {_BREAKS} UNION ALL SELECT ticker FROM missing
  UNION ALL SELECT ticker FROM ch WHERE abs(change) > 0.5 AND n >= 30 UNION ALL SELECT ticker FROM ch WHERE abs(change) > 0.4
  UNION ALL SELECT ticker FROM bars WHERE volume = 0 UNION ALL SELECT ticker FROM st),
c AS (SELECT ticker, count(*) AS n_issues FROM k GROUP BY ticker),
b AS (SELECT ticker, min(date) AS start_date, max(date) AS end_date, count(*) AS total_bars FROM bars GROUP BY ticker)
SELECT b.*, coalesce(n_issues, 0) AS n_issues, n_issues IS NULL AS is_clean, n_issues IS NOT NULL AS listed FROM b LEFT JOIN c USING (ticker)""",
    "store_features": f"""WITH {bars()}, {technical()}, f AS (SELECT ticker, date, returns_1d, rsi_14 FROM tech WHERE ticker = 'NATION_3' AND {SPAN})
SELECT date, feature_name, round(value, 6) + 0.0 AS value FROM f UNPIVOT (value FOR feature_name IN (returns_1d, rsi_14))""",
    "ingest_run": f"""WITH {bars()}, g AS (SELECT ticker, count(*) AS n FROM bars WHERE date BETWEEN DATE '{LOW}' AND DATE '{MID}' GROUP BY ticker)
SELECT t.ticker, DATE '{LOW}' AS start_date, DATE '{MID}' AS end_date, CASE WHEN n IS NULL THEN 'failed' ELSE 'success' END AS status,
  coalesce(n, 0) AS n_rows, CASE WHEN n IS NULL THEN 'no data' END AS error
FROM (SELECT unnest([{SOME}, 'NOWHERE']) AS ticker) t LEFT JOIN g USING (ticker)""",
    "ingest_continued": f"WITH {bars()} SELECT {BAR} FROM bars WHERE ticker IN ({SOME}) AND {SPAN}",
    "provider_drops_empty_rows": f"""WITH {bars()}, h AS (SELECT ticker, date, CASE WHEN day(date) % 3 <> 0 AND day(date) % 5 <> 0 THEN open END AS open,
  high, low, close, volume, adj_close FROM bars WHERE day(date) % 3 <> 0 AND ticker IN ({SOME}) AND {SPAN}) SELECT {BAR} FROM h""",
    "bar_model": f"""WITH {bars()}, m AS (SELECT ticker, date, open, high, CASE WHEN day(date) % 4 = 0 THEN close ELSE low END AS low,
  CASE WHEN day(date) % 4 = 0 THEN low ELSE close END AS close, CASE WHEN day(date) % 7 = 0 THEN -volume ELSE volume END AS volume FROM bars)
SELECT ticker, date, NOT ({_BREAKS} OR volume < 0) AS valid FROM m""",
    "cleaned_matrix": f"""WITH {INDEX}, {macro(False)}, m AS (SELECT date, spy_returns_5d, CASE WHEN day(date) % 6 <> 0 THEN spy_vol_21d END AS spy_vol_21d, spy_above_200sma FROM macro),
f AS (SELECT date, {", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in ("spy_returns_5d", "spy_vol_21d", "spy_above_200sma"))}
  FROM m WHERE coalesce(spy_returns_5d, spy_vol_21d, spy_above_200sma) IS NOT NULL)
SELECT date, {rnd("spy_returns_5d", "spy_vol_21d", "spy_above_200sma")}, row_number() OVER (ORDER BY date) - 1 AS i FROM f
WHERE spy_returns_5d IS NOT NULL AND spy_vol_21d IS NOT NULL AND spy_above_200sma IS NOT NULL""",
    "universe_tickers": "SELECT DISTINCT n_name AS ticker FROM nation JOIN region ON n_regionkey = r_regionkey",
    "custom_feature": f"WITH {bars()} SELECT ticker, date, round(high - low, 9) + 0.0 AS day_range, 'custom' AS category, 1 AS lookback_days FROM bars",
    "pipeline_incremental": f"""WITH {bars()}, f AS (SELECT ticker, date, count(*) OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars WHERE ticker IN ({SOME}))
SELECT ticker, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM f WHERE n >= 5 AND date BETWEEN DATE '{MID}' AND DATE '1998-12-31' GROUP BY ticker""",
    "streamed_bars": f"WITH {bars()} SELECT {BAR} FROM bars WHERE date BETWEEN DATE '{LOW}' AND DATE '{MID}'",
    "json_rows": f"""WITH {INDEX}, {LABELS}, t AS (SELECT date, lag(regime) OVER (ORDER BY date) AS a, regime AS b FROM labels)
SELECT date, '{{"from_regime":' || a || ',"to_regime":' || b || '}}' AS json FROM t WHERE a <> b""",
}
