"""The portfolio fold: cash and positions through all windows of a run.

What a day buys depends on the cash that all earlier days left, so a run is sequential; runs (strategy, cost model,
configuration) are independent groups, and a sweep of many runs is as parallel as it has runs.  A group's rows are
dates times priced tickers of one backtest.

Rules: sells come before buys, tickers in order; sells never exceed the shares held (no shorts); a buy spends at most 99.9 %
of the cash and is scaled down if costs would overdraw it.  Positions without a price keep their last known one.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EQUITY, TRADES
from .costs import MODELS, CostModel
from .walkforward import WalkForward

ROWS = "run_id string, kind string, window_idx int, date date, ticker string, side string, shares double, price double, gross_value double, commission double, spread_cost double, market_impact double, net_value double, portfolio_value double, cash double, positions_value double"
UNKNOWN_VOLUME = 1_000_000.0


class Book:
    def __init__(self, cash: float, costs: CostModel) -> None:
        self.cash, self.costs = cash, costs
        self.shares: dict[str, float] = {}
        self.last: dict[str, float] = {}

    def value(self) -> float:
        return sum(n * self.last[t] for t, n in self.shares.items())

    def rebalance(self, target: dict[str, float], prices: dict[str, float], volumes: dict[str, float]) -> list[tuple]:
        """Trades (ticker, side, shares, price, gross, commission, spread, impact, net) towards the target weights."""
        total = self.cash + self.value()
        held = {t: n * prices[t] / total for t, n in self.shares.items() if t in prices and total > 0}
        moves = {t: target.get(t, 0.0) - held.get(t, 0.0) for t in sorted(target.keys() | held.keys()) if t in prices}
        done = []
        for t, move in moves.items():
            if move < 0:
                price, shares = prices[t], min(-move * total / prices[t], self.shares.get(t, 0.0))
                if shares >= 0.01:
                    parts = self.costs.one(shares, price, volumes.get(t, UNKNOWN_VOLUME))
                    net = shares * price - sum(parts)
                    self.cash += net
                    self.shares[t] -= shares
                    if self.shares[t] < 0.01:
                        del self.shares[t]
                    done.append((t, "sell", shares, price, shares * price, *parts, net))
        for t, move in moves.items():
            if move > 0:
                price, volume = prices[t], volumes.get(t, UNKNOWN_VOLUME)
                spend = min(move * total, self.cash * 0.999)
                if spend < 1.0:
                    continue
                shares = spend / price
                parts = self.costs.one(shares, price, volume)
                if shares * price + sum(parts) > self.cash:
                    shares = self.cash * 0.99 / (price + sum(parts) / max(shares, 1))
                    parts = self.costs.one(shares, price, volume)
                if shares < 0.01:
                    continue
                net = shares * price + sum(parts)
                self.cash -= net
                self.shares[t] = self.shares.get(t, 0.0) + shares
                done.append((t, "buy", shares, price, shares * price, *parts, net))
        return done


def _fold(capital: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        run_id = rows["run_id"].iloc[0]
        book = Book(capital, MODELS[rows["cost_model"].iloc[0]])
        out: list[tuple] = []
        rows = rows.sort_values(["window_idx", "day", "ticker"])
        columns = {c: rows[c].to_numpy() for c in ("window_idx", "day", "date", "trades")}
        lists = [rows[c].tolist() for c in ("ticker", "price", "volume", "weight")]
        new_day = (columns["window_idx"][1:] != columns["window_idx"][:-1]) | (columns["day"][1:] != columns["day"][:-1])
        edges = [0, *(new_day.nonzero()[0] + 1).tolist(), len(rows)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            window, date = columns["window_idx"][low], columns["date"][low]
            known = [r for r in zip(*(x[low:high] for x in lists), strict=True) if isinstance(r[0], str)]
            prices = {t: price for t, price, _, _ in known}
            book.last |= prices
            if columns["trades"][low] and prices:
                volumes = {t: v for t, _, v, _ in known if v is not None and not math.isnan(v)}
                wanted = {t: w for t, _, _, w in known if w is not None and not math.isnan(w)}
                for t, side, *numbers in book.rebalance(wanted, prices, volumes):
                    out.append((run_id, "trade", window, date, t, side, *numbers, None, None, None))
            worth = book.value()
            out.append((run_id, "equity", window, date, *[None] * 9, book.cash + worth, book.cash, worth))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    return run


def simulate(schedules: DataFrame, plan: WalkForward = WalkForward()) -> DataFrame:
    """Trades and equity points of every run; ``schedules`` has run_id, cost_model and an execution schedule."""
    return schedules.groupBy("run_id").applyInPandas(_fold(plan.initial_capital), ROWS)


def trade_log(result: DataFrame) -> DataFrame:
    total = F.col("commission") + F.col("spread_cost") + F.col("market_impact")
    columns = [c.split()[0] for c in TRADES.split(", ")]
    return result.where("kind = 'trade'").withColumn("total_cost", total).select(*columns)


def equity_curve(result: DataFrame, plan: WalkForward = WalkForward()) -> DataFrame:
    w = Window.partitionBy("run_id").orderBy("window_idx", "date")
    value, before = F.col("portfolio_value"), F.lag("portfolio_value").over(w)
    daily = F.coalesce(F.when(before > 0, F.try_divide(value - before, before)), F.lit(0.0))
    rows = result.where("kind = 'equity'").withColumn("daily_return", daily).withColumn("cumulative_return", value / plan.initial_capital - 1)
    return rows.select(*[c.split()[0] for c in EQUITY.split(", ")])


def returns_of(equity: DataFrame) -> DataFrame:
    return equity.select("run_id", "date", F.col("daily_return").alias("r"))


def exposure(equity: DataFrame) -> DataFrame:
    share = lambda c, other: F.when(F.col("portfolio_value") > 0, F.try_divide(c, "portfolio_value")).otherwise(F.lit(other))
    gross = share("positions_value", 0.0)
    return equity.select("run_id", "date", gross.alias("gross_exposure"), gross.alias("net_exposure"), share("cash", 1.0).alias("cash_pct"))


def window_results(result: DataFrame, bounds: DataFrame, plan: WalkForward = WalkForward()) -> DataFrame:
    """run_id, window bounds, n_trades and window_return (over the value at the end of the window before)."""
    ends = result.where("kind = 'equity'").groupBy("run_id", "window_idx").agg(F.max_by("portfolio_value", "date").alias("after"))
    before = F.coalesce(F.lag("after").over(Window.partitionBy("run_id").orderBy("window_idx")), F.lit(plan.initial_capital))
    ends = ends.withColumn("window_return", F.coalesce(F.when(before > 0, F.col("after") / before - 1), F.lit(0.0)))
    trades = result.where("kind = 'trade'").groupBy("run_id", "window_idx").agg(F.count("*").alias("n_trades"))
    joined = ends.join(trades, ["run_id", "window_idx"], "left").join(bounds, "window_idx")
    return joined.select("run_id", *bounds.columns, F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "window_return")
