"""DuckDB SQL for the catalogue's queries, written on its own from the definitions of the operators."""

from __future__ import annotations

from ..operators.costs import MODELS
from .queries import CENTERS, SECTION_GROUPS, TECHNICAL_GROUPS, VOLATILITY_GROUPS
from .registry import CATALOGUE, CROSS_SECTIONAL, MACRO, TECHNICAL, VOLATILITY

W = "PARTITION BY ticker ORDER BY date"
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def over(f: str, k: int | None = None, w: str = W) -> str:
    frame = "" if k is None else f" ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"
    return f"{f} OVER ({w}{frame})"


def roll(f: str, x: str, k: int, w: str = W) -> str:
    return f"CASE WHEN {over(f'count({x})', k, w)} = {k} THEN {over(f'{f}({x})', k, w)} END"


def ret(x: str, n: int, w: str = W) -> str:
    return f"({x} / nullif(lag({x}, {n}) OVER ({w}), 0) - 1)"


def ewm(x: str, r: float, least: int) -> str:
    """Running sums with powers of 1/r, finite for the 2,499 dates of the panel."""
    run = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    power = f"pow({1 / r!r}, n)"
    return f"CASE WHEN count({x}) {run} >= {least} THEN sum({x} * {power}) {run} / nullif(sum(CASE WHEN {x} IS NOT NULL THEN {power} END) {run}, 0) END"


def rnd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def _panel(keys: str, source: str, name: str) -> str:
    group = keys.replace("'SPY' AS ticker, ", "").replace("'Index' AS sector, ", "")
    return f"""{name} AS (
  SELECT {keys}, first(px ORDER BY {KEY}) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY {KEY}) AS close,
    sum(l_quantity) AS volume, last(px ORDER BY {KEY}) AS adj_close
  FROM {source} GROUP BY {group})"""


def trades(ticker: str = "n_name") -> str:
    return f"""trades AS (
  SELECT l.*, CAST(l_shipdate AS DATE) AS date, l_extendedprice / nullif(l_quantity, 0) AS px, {ticker} AS ticker, r_name AS sector
  FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


ALL_TRADES = "alltrades AS (SELECT *, CAST(l_shipdate AS DATE) AS date, l_extendedprice / nullif(l_quantity, 0) AS px FROM lineitem)"
INDEX = ALL_TRADES + ", " + _panel("'SPY' AS ticker, date, 'Index' AS sector", "alltrades", "idx").replace("GROUP BY date, 'Index' AS sector", "GROUP BY date")
BOND = """bonds AS (
  SELECT 'TLT' AS ticker, date, px AS open, px AS high, px AS low, px AS close, volume, px AS adj_close, 'Bond' AS sector FROM (
    SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1000 AS px, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1))"""
COLUMNS = "ticker, date, open, high, low, close, volume, adj_close, sector"


def bars(ticker: str = "n_name") -> str:
    return trades(ticker) + ", " + _panel("ticker, date, sector", "trades", "bars")


MARKET = f"{bars()}, {INDEX}, {BOND}, market AS (SELECT {COLUMNS} FROM bars UNION ALL SELECT {COLUMNS} FROM idx UNION ALL SELECT {COLUMNS} FROM bonds)"


def technical(source: str = "bars") -> str:
    c, v = "adj_close", "volume"
    rsi = lambda p: f"CASE WHEN n > {p} THEN CASE WHEN l{p} > 0 THEN 100 - 100 / (1 + g{p} / l{p}) ELSE 100.0 END END"
    sma = {k: roll("avg", c, k) for k in (5, 20, 21, 50, 63, 200)}
    sd = {k: roll("stddev_samp", c, k) for k in (20, 21)}
    frame14 = f"OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    typical = "((high + low + adj_close) / 3 * volume)"
    made = {f"returns_{n}d": ret(c, n) for n in (1, 5, 21, 63)}
    made |= {"rsi_14": rsi(14), "rsi_28": rsi(28), "macd_signal": "macd - signal", "macd_histogram": "macd - signal"}
    made |= {"momentum_12_1": f"{ret(c, 252)} - {ret(c, 21)}"}
    made |= {f"mean_reversion_{k}d": f"({c} - s{k}) / nullif(s{k}, 0)" for k in (5, 21)}
    made |= {"bollinger_upper_dist": f"({c} - (s20 + 2 * d20)) / nullif(d20, 0)", "bollinger_lower_dist": f"({c} - (s20 - 2 * d20)) / nullif(d20, 0)"}
    made |= {"z_score_21d": f"({c} - s21) / nullif(d21, 0)", "sma_ratio_5_21": "s5 / nullif(s21, 0)", "sma_ratio_21_63": "s21 / nullif(s63, 0)"}
    made |= {"ema_ratio_12_26": "e12 / nullif(e26, 0)", "price_to_sma_50": f"{c} / nullif(s50, 0)", "price_to_sma_200": f"{c} / nullif(s200, 0)"}
    made |= {"golden_cross": "CAST(s50 > s200 AS DOUBLE)", "death_cross": "CAST(s50 < s200 AS DOUBLE)"}
    made |= {f"volume_ratio_{k}d": f"{v} / nullif({roll('avg', v, k)}, 0)" for k in (5, 21)}
    made |= {"obv_slope_14d": f"CASE WHEN count(obv) {frame14} = 14 THEN regr_slope(obv, CAST(n AS DOUBLE)) {frame14} END"}
    vwap = f"(({roll('sum', typical, 21)}) / nullif({roll('sum', v, 21)}, 0))"
    made |= {"vwap_distance": f"({c} - {vwap}) / nullif({vwap}, 0)"}
    e = {"g14": ("gain", 13 / 14, 14), "l14": ("loss", 13 / 14, 14), "g28": ("gain", 27 / 28, 28), "l28": ("loss", 27 / 28, 28), "e12": (c, 11 / 13, 12), "e26": (c, 25 / 27, 26)}
    return f"""t0 AS (SELECT *, row_number() OVER ({W}) AS n, {c} - lag({c}) OVER ({W}) AS change FROM {source}),
t1 AS (SELECT *, CASE WHEN change > 0 THEN change WHEN change <= 0 THEN 0.0 END AS gain,
  CASE WHEN change < 0 THEN -change WHEN change >= 0 THEN 0.0 END AS loss, sign(change) * {v} AS flow FROM t0),
t2 AS (SELECT *, {", ".join(f"{ewm(*x)} AS {k}" for k, x in e.items())},
  CASE WHEN flow IS NOT NULL THEN sum(flow) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS obv,
  {", ".join(f"{x} AS s{k}" for k, x in sma.items())}, {", ".join(f"{x} AS d{k}" for k, x in sd.items())} FROM t1),
t3 AS (SELECT *, e12 - e26 AS macd FROM t2),
t4 AS (SELECT *, {ewm("macd", 0.8, 9)} AS signal FROM t3),
tech AS (SELECT ticker, date, {", ".join(f"{made[k]} AS {k}" for k in TECHNICAL)} FROM t4)"""


def volatility(source: str = "bars") -> str:
    c = "adj_close"
    made = {f"realized_vol_{k}d": f"v{k}" for k in (5, 21, 63)}
    made |= {"vol_ratio_5_21": "v5 / nullif(v21, 0)", "vol_ratio_5_63": "v5 / nullif(v63, 0)", "vol_of_vol_21d": roll("stddev_samp", "v5", 21)}
    made |= {"garman_klass_vol_21d": "CASE WHEN gkm >= 0 THEN sqrt(gkm * 252) END"}
    made |= {"parkinson_vol_21d": f"sqrt(({roll('sum', 'hl2', 21)}) * 252 / (4 * 21 * ln(2)))"}
    made |= {"vol_regime_z_score": f"(v63 - {roll('avg', 'v63', 252)}) / nullif({roll('stddev_samp', 'v63', 252)}, 0)"}
    made |= {"high_low_range_ratio": f"rng / nullif({roll('avg', 'rng', 21)}, 0)"}
    return f"""u0 AS (SELECT *, ln({c} / nullif(lag({c}) OVER ({W}), 0)) AS lr, pow(ln(high / nullif(low, 0)), 2) AS hl2,
  0.5 * pow(ln(high / nullif(low, 0)), 2) - (2 * ln(2) - 1) * pow(ln({c} / nullif(open, 0)), 2) AS gk,
  (high - low) / nullif(low, 0) AS rng FROM {source}),
u1 AS (SELECT *, {", ".join(f"({roll('stddev_samp', 'lr', k)}) * sqrt(252) AS v{k}" for k in (5, 21, 63))}, {roll("avg", "gk", 21)} AS gkm FROM u0),
vola AS (SELECT ticker, date, {", ".join(f"{made[k]} AS {k}" for k in VOLATILITY)} FROM u1)"""


def section(source: str = "bars") -> str:
    rank = lambda x: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x}) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"
    made = {"rank_returns_21d": rank("r21"), "rank_returns_63d": rank("r63"), "rank_volume_ratio": rank("vr")}
    made |= {f"sector_relative_return_{k}d": f"r{k} - avg(r{k}) OVER (PARTITION BY date, sector)" for k in (21, 63)}
    made |= {"sector_momentum_21d": "avg(r21) OVER (PARTITION BY date, sector)"}
    made |= {"market_breadth": "sum(CASE WHEN r21 > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY date) / nullif(count(r21) OVER (PARTITION BY date), 0)"}
    made |= {"dispersion_21d": "stddev_samp(r21) OVER (PARTITION BY date)"}
    return f"""x0 AS (
  SELECT h.ticker, h.sector, d.date, adj_close, volume, last_value(adj_close IGNORE NULLS) OVER (PARTITION BY h.ticker ORDER BY d.date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px
  FROM (SELECT DISTINCT ticker, sector FROM {source}) h CROSS JOIN (SELECT DISTINCT date FROM {source}) d
  LEFT JOIN {source} b ON b.ticker = h.ticker AND b.date = d.date),
x1 AS (SELECT *, {ret("px", 21)} AS r21, {ret("px", 63)} AS r63, volume / nullif({roll("avg", "volume", 21)}, 0) AS vr FROM x0),
x2 AS (SELECT *, {", ".join(f"{made[k]} AS {k}" for k in CROSS_SECTIONAL)} FROM x1),
xs AS (SELECT ticker, date, {", ".join(CROSS_SECTIONAL)} FROM x2 WHERE adj_close IS NOT NULL)"""


def macro(dispersion: bool = True) -> str:
    c = "adj_close"
    spread = "(SELECT date, max(dispersion_21d) AS market_return_dispersion FROM xs GROUP BY date)" if dispersion else "(SELECT date, NULL AS market_return_dispersion FROM idx)"
    return f"""m0 AS (SELECT *, ln({c} / nullif(lag({c}) OVER ({W}), 0)) AS lr, max({c}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM idx),
m1 AS (SELECT date, {ret(c, 5)} AS spy_returns_5d, {ret(c, 21)} AS spy_returns_21d, ({roll("stddev_samp", "lr", 21)}) * sqrt(252) AS spy_vol_21d,
  ({c} - top) / nullif(top, 0) AS spy_drawdown, CAST({c} > {roll("avg", c, 200)} AS DOUBLE) AS spy_above_200sma FROM m0),
macro AS (SELECT m1.*, market_return_dispersion FROM m1 LEFT JOIN {spread} USING (date))"""


RETURNS = f"{INDEX}, rets AS (SELECT * FROM (SELECT date, {ret('adj_close', 1)} AS r FROM idx) WHERE r IS NOT NULL)"
LABELS = f"{macro(False)}, labels AS (SELECT date, CAST(ntile(4) OVER (ORDER BY spy_vol_21d, date) - 1 AS INTEGER) AS regime FROM macro WHERE spy_vol_21d IS NOT NULL)"
RUNS = """runs AS (SELECT any_value(regime) AS regime, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days FROM (
  SELECT *, sum(changed) OVER (ORDER BY date) AS island FROM (
    SELECT *, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER (ORDER BY date) THEN 1 ELSE 0 END AS changed FROM labels)) GROUP BY island)"""


def drawdown_cte(source: str, part: str) -> str:
    w = f"OVER ({part}ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""dd0 AS (SELECT *, product(1 + r) {w} AS cumulative_return FROM {source}),
dd1 AS (SELECT *, max(cumulative_return) {w} AS running_max FROM dd0),
dd AS (SELECT *, (cumulative_return - running_max) / nullif(running_max, 0) AS drawdown,
  (cumulative_return - running_max) / nullif(running_max, 0) < 0 AS in_drawdown FROM dd1)"""


def rolling_sharpe(part: str = "") -> str:
    w = f"{part}ORDER BY date"
    return f"({roll('avg', '(r - 0.04 / 252)', 63, w)}) / nullif({roll('stddev_samp', 'r', 63, w)}, 0) * sqrt(252)"


def metrics_sql(source: str, key: str | None, digits: int) -> str:
    """CTEs up to ``met``, and its select."""
    part, by = (f"PARTITION BY {key} ", f"{key}, ") if key else ("", "")
    group, using = (f"GROUP BY {key}", f"USING ({key})") if key else ("", "ON true")
    months = f"{by}date_trunc('month', date)"
    ctes = f"""{drawdown_cte(source, part)},
e1 AS (SELECT *, {rolling_sharpe(part)} AS rs, quantile_cont(r, 0.05) OVER ({part.strip() or ""}) AS q,
  CASE WHEN in_drawdown IS DISTINCT FROM lag(in_drawdown) OVER ({part}ORDER BY date) THEN 1 ELSE 0 END AS ch FROM dd),
e2 AS (SELECT *, sum(ch) OVER ({part}ORDER BY date) AS island FROM e1),
longest AS (SELECT {by}max(n) AS max_drawdown_duration_days FROM (SELECT {by}island, count(*) FILTER (in_drawdown) AS n FROM e2 GROUP BY {by}island) {group}),
mo AS (SELECT {by}date_trunc('month', date) AS month, product(1 + r) - 1 AS mr FROM {source} GROUP BY {months}),
span AS (SELECT {by}min(month) AS a, max(month) AS b, count(*) FILTER (mr > 0) AS pos FROM mo {group}),
pm AS (SELECT {by}CAST(pos AS DOUBLE) / (date_diff('month', a, b) + 1) AS pct_positive_months FROM span),
agg AS (SELECT {by}count(*) AS n_days, product(1 + r) - 1 AS total_return, stddev_samp(r) * sqrt(252) AS annualized_volatility,
  min(drawdown) AS max_drawdown, any_value(q) AS var_95, avg(r) FILTER (r <= q) AS cvar_95,
  coalesce(stddev_samp(r) FILTER (r < 0.04 / 252) * sqrt(252), 0) AS down, CAST(count(*) FILTER (r > 0) AS DOUBLE) / count(*) AS win_rate,
  coalesce(sum(r) FILTER (r > 0), 0) AS profit, coalesce(sum(r) FILTER (r < 0), 0) AS loss, coalesce(avg(r) FILTER (r > 0), 0) AS avg_win,
  coalesce(avg(r) FILTER (r < 0), 0) AS avg_loss, max(r) AS best_day, min(r) AS worst_day, skewness(r) AS skewness, kurtosis(r) AS kurtosis,
  coalesce(avg(rs), 0) AS rolling_sharpe_mean, coalesce(stddev_samp(rs), 0) AS rolling_sharpe_std FROM e2 {group}),
a2 AS (SELECT *, pow(1 + total_return, 252.0 / n_days) - 1 AS annualized_return FROM agg),
met AS (SELECT *, CASE WHEN annualized_volatility > 0 THEN (annualized_return - 0.04) / annualized_volatility ELSE 0 END AS sharpe_ratio,
  CASE WHEN down > 0 THEN (annualized_return - 0.04) / down ELSE 0 END AS sortino_ratio,
  CASE WHEN max_drawdown <> 0 THEN annualized_return / abs(max_drawdown) ELSE 0 END AS calmar_ratio,
  CASE WHEN loss <> 0 THEN profit / abs(loss) ELSE CAST('inf' AS DOUBLE) END AS profit_factor,
  CASE WHEN avg_loss <> 0 THEN avg_win / abs(avg_loss) ELSE CAST('inf' AS DOUBLE) END AS win_loss_ratio
  FROM a2 JOIN longest {using} JOIN pm {using})"""
    names = ["total_return", "annualized_return", "annualized_volatility", "max_drawdown", "var_95", "cvar_95", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "win_rate", "profit_factor", "avg_win", "avg_loss", "win_loss_ratio", "best_day", "worst_day", "skewness", "kurtosis", "rolling_sharpe_mean", "rolling_sharpe_std", "pct_positive_months"]
    return f"{ctes} SELECT {by}{rnd(*names, digits=digits)}, max_drawdown_duration_days, n_days FROM met"


WINDOWS = f"""{MARKET}, dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM market)),
starts AS (SELECT unnest(range(0, (SELECT max(i) + 1 FROM dates) - 566, 63)) AS s),
wins AS (SELECT CAST(s / 63 AS INTEGER) AS window_idx, a.date AS train_start, b.date AS train_end, c.date AS test_start, d.date AS test_end
  FROM starts JOIN dates a ON a.i = s JOIN dates b ON b.i = s + 503 JOIN dates c ON c.i = s + 504 JOIN dates d ON d.i = s + 566),
train AS (SELECT window_idx, ticker, market.date, adj_close, row_number() OVER (PARTITION BY window_idx, ticker ORDER BY market.date DESC) AS back
  FROM market JOIN wins ON market.date BETWEEN train_start AND train_end),
days AS (SELECT window_idx, date, row_number() OVER (PARTITION BY window_idx ORDER BY date) - 1 AS day,
  lag(date) OVER (PARTITION BY window_idx ORDER BY date) AS prev_date FROM (SELECT DISTINCT date FROM market) JOIN wins ON date BETWEEN test_start AND test_end)"""


def _chosen(scores: str, order: str, n: int) -> str:
    return f"""scores AS ({scores}), ranked AS (SELECT *, row_number() OVER (PARTITION BY window_idx ORDER BY {order}) AS p FROM scores),
weights AS (SELECT window_idx, ticker, 1.0 / count(*) OVER (PARTITION BY window_idx) AS weight FROM ranked WHERE p <= {n})"""


def _mix(weights: dict[str, float]) -> str:
    case = " ".join(f"WHEN '{t}' THEN {w}" for t, w in weights.items())
    names = ", ".join(f"'{t}'" for t in weights)
    return f"""raw AS (SELECT DISTINCT window_idx, ticker, CAST(CASE ticker {case} END AS DOUBLE) AS w FROM train WHERE ticker IN ({names})),
weights AS (SELECT window_idx, ticker, w / sum(w) OVER (PARTITION BY window_idx) AS weight FROM raw)"""


STRATEGY_SQL = {
    "buyandhold": _chosen("SELECT DISTINCT window_idx, ticker FROM train", "ticker", 20),
    "momentum12_1": _chosen(
        "SELECT window_idx, ticker, max(adj_close) FILTER (back = 21) / nullif(arg_min(adj_close, date), 0) - 1 AS score FROM train GROUP BY 1, 2 HAVING count(*) > 42",
        "score DESC, ticker", 10,
    ),
    "meanreversion": _chosen(
        "SELECT window_idx, ticker, max(adj_close) FILTER (back = 1) / nullif(max(adj_close) FILTER (back = 5), 0) - 1 AS score FROM train GROUP BY 1, 2 HAVING count(*) > 5",
        "score, ticker", 10,
    ),
    "spy": _mix({"SPY": 1.0}),
    "60_40": _mix({"SPY": 0.6, "TLT": 0.4}),
}

PERFORMANCE = """perf AS (SELECT regime, avg(r) AS mean_daily_return, avg(r) * 252 AS annualized_return, stddev_samp(r) * sqrt(252) AS annualized_vol,
  CASE WHEN stddev_samp(r) > 0 THEN avg(r) * 252 / (stddev_samp(r) * sqrt(252)) ELSE 0.0 END AS sharpe, count(*) AS n_days,
  avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM labels JOIN rets USING (date) GROUP BY regime)"""


def _costs() -> str:
    parts = []
    for name, m in MODELS.items():
        value, rate = "(shares * price)", "(CASE WHEN price > 50 THEN 0.0002 WHEN price > 10 THEN 0.0005 ELSE 0.0010 END)"
        impact = f"CASE WHEN volume > 0 THEN sqrt({value} / (volume * price * {m.participation})) ELSE 0.1 END"
        columns = {"commission": f"shares * {m.commission} * {m.scale}", "spread_cost": f"{value} * {rate} * {m.scale}", "market_impact": f"{value} * {rate} * {m.scale} * ({impact})"}
        columns["total_cost"] = " + ".join(f"({c})" for c in list(columns.values()))
        parts.append(f"SELECT l_orderkey, l_linenumber, '{name}' AS model, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {k}' for k, c in columns.items())} FROM t")
    return "WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS shares, l_extendedprice / l_quantity / 17 AS price, CAST(l_partkey % 500 AS DOUBLE) AS volume FROM lineitem) " + " UNION ALL ".join(parts)


def _distance_sql() -> str:
    d = [f"sqrt({' + '.join(f'pow(x{j} - ({c}), 2)' for j, c in enumerate(center))})" for center in CENTERS]
    n = range(len(CENTERS))
    return f"""WITH {INDEX}, {macro(False)},
pts AS (SELECT date, spy_returns_21d AS x0, spy_vol_21d AS x1 FROM macro WHERE spy_vol_21d IS NOT NULL AND spy_returns_21d IS NOT NULL),
ds AS (SELECT date, {", ".join(f"{x} AS d{i}" for i, x in enumerate(d))} FROM pts),
inv AS (SELECT *, {", ".join(f"1 / (d{i} + 1e-10) AS i{i}" for i in n)} FROM ds),
ps AS (SELECT *, {", ".join(f"i{i} / ({' + '.join(f'i{j}' for j in n)}) AS p{i}" for i in n)} FROM inv)
SELECT date, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS regime,
  {rnd(*(f"{x}{i}" for x in "dp" for i in n))} FROM ps"""


def _registry_sql() -> str:
    rows = ", ".join(f"('{name}', '{category}', 1, {days})" for category, group in CATALOGUE.items() for name, days in group.items())
    return f"(SELECT * FROM (VALUES {rows}) AS v(feature_name, category, version, lookback_days))"


def _features_sql(ticker: str) -> str:
    return f"""WITH {bars(ticker)}, {INDEX}, {technical()}, {volatility()}, {section()}, {macro()},
wide AS (SELECT tech.*, {", ".join(f"vola.{c}" for c in VOLATILITY)}, {", ".join(f"xs.{c}" for c in CROSS_SECTIONAL)}, {", ".join(f"macro.{c}" for c in MACRO)}
  FROM tech JOIN vola USING (ticker, date) LEFT JOIN xs USING (ticker, date) LEFT JOIN macro USING (date))"""


ALL = [name for group in CATALOGUE.values() for name in group]
STORED_CTE = f"""{_features_sql('n_name').removeprefix('WITH ')},
stored AS (SELECT ticker, date, feature_name, value FROM (SELECT ticker, date, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ALL)} FROM wide)
  UNPIVOT (value FOR feature_name IN ({', '.join(ALL)})))"""
BAR_NUMBERS = ("open", "high", "low", "close", "volume", "adj_close")
CHANGES = f"ch AS (SELECT ticker, date, close / nullif(lag(close) OVER ({W}), 0) - 1 AS change, count(*) OVER (PARTITION BY ticker) AS n FROM bars)"
MISSING = """missing AS (SELECT s.ticker, d.date FROM (SELECT ticker, min(date) AS lo, max(date) AS hi FROM bars GROUP BY ticker) s
  JOIN (SELECT DISTINCT date FROM bars) d ON d.date BETWEEN lo AND hi ANTI JOIN bars b ON b.ticker = s.ticker AND b.date = d.date)"""


def _stale(close: str, days: int) -> str:
    return f"""st AS (SELECT ticker, min(date) AS start_date, max(date) AS end_date, count(*) AS n_days FROM (
  SELECT *, sum(changed) OVER ({W}) AS island FROM (
    SELECT ticker, date, CASE WHEN {close} IS DISTINCT FROM lag({close}) OVER ({W}) THEN 1 ELSE 0 END AS changed FROM bars))
  GROUP BY ticker, island HAVING count(*) >= {days})"""


SQL: dict[str, str] = {
    "bars": f"WITH {bars()} SELECT ticker, date, sector, {rnd(*BAR_NUMBERS, digits=9)} FROM bars",
    "market_panel": f"WITH {MARKET} SELECT ticker, date, sector, {rnd(*BAR_NUMBERS, digits=9)} FROM market",
    "xs_volume_rank": f"WITH {bars()}, {section()} SELECT ticker, date, {rnd('rank_volume_ratio')} FROM xs",
    "macro_features": f"WITH {bars()}, {INDEX}, {section()}, {macro()} SELECT date, {rnd(*MACRO)} FROM macro",
    "features_49": f"{_features_sql('n_name')} SELECT ticker, date, {rnd(*ALL)} FROM wide",
    "features_49_long": f"WITH {STORED_CTE} SELECT ticker, date, feature_name, round(value, 6) + 0.0 AS value FROM stored",
    "feature_matrix": f"WITH {STORED_CTE} SELECT ticker, date, {', '.join(f'round(max(value) FILTER (feature_name = {c!r}), 6) + 0.0 AS {c}' for c in ALL)} FROM stored GROUP BY ticker, date",
    "feature_coverage": f"WITH {STORED_CTE} SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT feature_name) AS features, count(*) AS total_rows, min(date) AS earliest_date, max(date) AS latest_date FROM stored",
    "latest_feature_date": f"WITH {STORED_CTE} SELECT ticker, max(date) AS latest_date FROM stored GROUP BY ticker",
    "available_features": f"WITH {STORED_CTE} SELECT DISTINCT feature_name FROM stored",
    "feature_registry": f"SELECT *, max(lookback_days) OVER () AS max_lookback FROM {_registry_sql()}",
    "registry_hash": f"SELECT substr(sha256(string_agg(feature_name || ':' || version || ':' || lookback_days, '|' ORDER BY feature_name)), 1, 16) AS version_hash FROM {_registry_sql()}",
    "upsert_latest": "SELECT l_orderkey, l_partkey, l_shipdate, l_linenumber, l_quantity, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) = 1",
    "quality_ohlc": f"WITH {bars()}, mixed AS (SELECT ticker, date, open, close, CASE WHEN day(date) % 3 = 0 THEN low ELSE high END AS high, CASE WHEN day(date) % 3 = 0 THEN high ELSE low END AS low FROM bars) SELECT ticker, date FROM mixed WHERE high < low OR open > high OR open < low OR close > high OR close < low",
    "quality_missing": f"WITH {bars()}, {MISSING} SELECT * FROM missing",
    "quality_outliers": f"WITH {bars()}, {CHANGES} SELECT ticker, date, {rnd('change')} FROM ch WHERE abs(change) > 0.5 AND n >= 30",
    "quality_splits": f"WITH {bars()}, {CHANGES} SELECT ticker, date, {rnd('change')} FROM ch WHERE abs(change) > 0.4",
    "quality_zero_volume": f"WITH {bars()} SELECT ticker, date FROM bars WHERE volume <= 20",
    "quality_stale": f"WITH {bars()}, {_stale('floor(close / 1000)', 3)} SELECT * FROM st",
    "quality_report": f"""WITH {bars()}, {CHANGES}, {MISSING}, {_stale('close', 5)},
k AS (SELECT ticker, 'i' AS kind FROM bars WHERE high < low OR open > high OR open < low OR close > high OR close < low
  UNION ALL SELECT ticker, 'm' FROM missing UNION ALL SELECT ticker, 'o' FROM ch WHERE abs(change) > 0.5 AND n >= 30
  UNION ALL SELECT ticker, 's' FROM ch WHERE abs(change) > 0.4 UNION ALL SELECT ticker, 'z' FROM bars WHERE volume = 0
  UNION ALL SELECT ticker, 't' FROM st),
c AS (SELECT ticker, {", ".join(f"count(*) FILTER (kind = '{x}') AS {n}" for x, n in zip("imoszt", ("inconsistent", "missing_days", "outliers", "splits", "zero_volume", "stale_runs"), strict=True))} FROM k GROUP BY ticker),
b AS (SELECT ticker, min(date) AS start_date, max(date) AS end_date, count(*) AS total_bars FROM bars GROUP BY ticker)
SELECT b.*, coalesce(inconsistent, 0) AS inconsistent, coalesce(missing_days, 0) AS missing_days, coalesce(outliers, 0) AS outliers,
  coalesce(splits, 0) AS splits, coalesce(zero_volume, 0) AS zero_volume, coalesce(stale_runs, 0) AS stale_runs, c.ticker IS NULL AS is_clean
FROM b LEFT JOIN c USING (ticker)""",
    "ingest_resume": "SELECT n_name AS ticker FROM nation WHERE n_nationkey % 2 = 1",
    "universe_sectors": "SELECT DISTINCT r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey",
    "universe_sector_tickers": "SELECT n_name AS ticker FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "metrics_all": f"WITH {RETURNS}, {metrics_sql('rets', None, 6)}",
    "drawdown": f"WITH {RETURNS}, {drawdown_cte('rets', '')} SELECT date, in_drawdown, {rnd('r', 'cumulative_return', 'running_max', 'drawdown')} FROM dd",
    "rolling_metrics": f"""WITH {RETURNS}, rets2 AS (SELECT date, r, pow({roll("product", "(1 + r)", 63, "ORDER BY date")}, 4.0) - 1 AS rr FROM rets)
SELECT date, round(r, 5) AS r, round(CASE WHEN abs(rr) >= 1000 THEN round(rr, -3) ELSE rr END, 5) AS rolling_return,
  round(({roll("stddev_samp", "r", 63, "ORDER BY date")}) * sqrt(252), 5) AS rolling_volatility, round({rolling_sharpe()}, 5) AS rolling_sharpe FROM rets2""",
    "monthly_returns": f"""WITH {RETURNS}, mo AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, product(1 + r) - 1 AS r FROM rets GROUP BY 1),
every AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM mo), (SELECT max(month) FROM mo), INTERVAL 1 MONTH)) AS DATE) AS month)
SELECT month, round(coalesce(r, 0), 6) AS r FROM every LEFT JOIN mo USING (month)""",
    "monthly_matrix": f"""WITH {RETURNS}, mo AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, product(1 + r) - 1 AS r FROM rets GROUP BY 1)
SELECT CAST(year(month) AS INTEGER) AS year, {", ".join(f"round(max(r) FILTER (month(month) = {i}), 6) AS m{i}" for i in range(1, 13))} FROM mo GROUP BY 1""",
    "regime_metrics": f"WITH {RETURNS}, {LABELS}, byreg AS (SELECT regime, date, r FROM labels JOIN rets USING (date)), {metrics_sql('byreg', 'regime', 5)}",
    "walk_forward_windows": f"WITH {WINDOWS} SELECT * FROM wins",
    "trade_costs": _costs(),
    "execution_schedule": f"""WITH {WINDOWS}, {STRATEGY_SQL['meanreversion']}
SELECT days.window_idx, CAST(day AS INTEGER) AS day, days.date, m.ticker, round(m.open, 9) AS price, round(m.volume, 9) AS volume, round(weight, 9) AS weight
FROM days JOIN market m ON m.date = days.date JOIN weights w ON w.window_idx = days.window_idx AND w.ticker = m.ticker WHERE day > 0 AND m.open > 0""",
    "regime_transitions": f"WITH {INDEX}, {LABELS}, t AS (SELECT date, lag(regime) OVER (ORDER BY date) AS from_regime, regime AS to_regime FROM labels) SELECT * FROM t WHERE from_regime <> to_regime",
    "regime_runs": f"WITH {INDEX}, {LABELS}, {RUNS} SELECT * FROM runs",
    "regime_performance": f"WITH {RETURNS}, {LABELS}, {PERFORMANCE} SELECT regime, n_days, {rnd('mean_daily_return', 'annualized_return', 'annualized_vol', 'sharpe', 'hit_rate')} FROM perf",
    "regime_stats": f"""WITH {RETURNS}, {LABELS}, {RUNS}, {PERFORMANCE},
base AS (SELECT regime, count(*) AS count, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS pct_of_total FROM labels GROUP BY regime),
dur AS (SELECT regime, avg(n_days) AS avg_duration_days, max(n_days) AS max_duration_days FROM runs GROUP BY regime)
SELECT regime, count, {rnd("pct_of_total", "avg_duration_days", "annualized_return", "annualized_vol", "sharpe")}, max_duration_days,
  CASE WHEN annualized_return > 0 THEN CASE WHEN annualized_vol > 0.2 THEN 'Recovery' ELSE 'Steady Bull' END
       ELSE CASE WHEN annualized_vol > 0.2 THEN 'Crisis' ELSE 'Quiet Bear' END END AS suggested_label
FROM base JOIN dur USING (regime) LEFT JOIN perf USING (regime)""",
    "regime_dominant_features": f"""WITH {INDEX}, {LABELS},
s AS (SELECT regime, {", ".join(f"avg(abs({c})) AS {c}" for c in ("spy_returns_5d", "spy_returns_21d", "spy_vol_21d", "spy_drawdown"))} FROM labels JOIN macro USING (date) GROUP BY regime),
u AS (SELECT * FROM s UNPIVOT (mean_abs FOR feature_name IN (spy_returns_5d, spy_returns_21d, spy_vol_21d, spy_drawdown)))
SELECT regime, feature_name, round(mean_abs, 6) AS mean_abs FROM u QUALIFY row_number() OVER (PARTITION BY regime ORDER BY mean_abs DESC, feature_name) <= 3""",
    "regime_timeline": f"""WITH {INDEX}, {LABELS}, j AS (SELECT date, adj_close AS price, regime, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER (ORDER BY date) THEN 1 ELSE 0 END AS ch FROM idx JOIN labels USING (date))
SELECT date, round(price, 6) AS price, regime, CAST(sum(ch) OVER (ORDER BY date) AS BIGINT) AS block FROM j""",
    "kmeans_distance_proba": _distance_sql(),
    "regime_relabel": f"""WITH {INDEX}, {macro(False)}, l AS (SELECT CAST(dayofweek(date) AS INTEGER) AS raw, avg(spy_returns_21d) AS m FROM macro WHERE spy_vol_21d IS NOT NULL AND spy_returns_21d IS NOT NULL GROUP BY 1)
SELECT e.raw, CAST(row_number() OVER (ORDER BY m NULLS LAST, e.raw) - 1 AS INTEGER) AS regime FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS raw) e LEFT JOIN l USING (raw)""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
    "event_sessions": """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
}
SQL |= {k: f"WITH {bars()}, {technical()} SELECT ticker, date, {rnd(*v)} FROM tech" for k, v in TECHNICAL_GROUPS.items()}
SQL |= {k: f"WITH {bars()}, {volatility()} SELECT ticker, date, {rnd(*v)} FROM vola" for k, v in VOLATILITY_GROUPS.items()}
SQL |= {k: f"WITH {bars()}, {section()} SELECT ticker, date, {rnd(*v)} FROM xs" for k, v in SECTION_GROUPS.items()}
SQL |= {f"signals_{k}": f"WITH {WINDOWS}, {x} SELECT window_idx, date, ticker, round(weight, 6) AS weight FROM days JOIN weights USING (window_idx)" for k, x in STRATEGY_SQL.items()}
