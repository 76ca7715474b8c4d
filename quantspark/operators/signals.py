"""Strategies: fit on the training rows of every walk-forward window, weights for its test dates.

All windows are fitted in one plan: a strategy maps (window_idx, ticker, date, adj_close) training rows to
(window_idx, ticker, weight).  Ties go to the ticker that sorts first.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Strategy(Protocol):
    name: str

    def fit(self, train: DataFrame) -> DataFrame: ...


def _equal(chosen: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("window_idx"))
    return chosen.select("window_idx", "ticker", (1 / n).alias("weight"))


def _top(scores: DataFrame, n: int, descending: bool) -> DataFrame:
    order = F.desc("score") if descending else F.asc("score")
    place = F.row_number().over(Window.partitionBy("window_idx").orderBy(order, "ticker"))
    return _equal(scores.where(F.col("score").isNotNull()).withColumn("_p", place).where(F.col("_p") <= n).drop("_p"))


class BuyAndHold:
    name = "BuyAndHold"

    def __init__(self, max_positions: int = 20) -> None:
        self.max_positions = max_positions

    def fit(self, train: DataFrame) -> DataFrame:
        tickers = train.select("window_idx", "ticker").distinct()
        place = F.row_number().over(Window.partitionBy("window_idx").orderBy("ticker"))
        return _equal(tickers.withColumn("_p", place).where(F.col("_p") <= self.max_positions).drop("_p"))


class Momentum:
    """Price 21 rows before the end of training over the first price of training; the lookback is the whole window."""

    name = "Momentum12-1"

    def __init__(self, skip: int = 21, top_n: int = 10) -> None:
        self.skip, self.top_n = skip, top_n

    def fit(self, train: DataFrame) -> DataFrame:
        late = Window.partitionBy("window_idx", "ticker").orderBy(F.desc("date"))
        ranked = train.withColumn("_back", F.row_number().over(late))
        scores = ranked.groupBy("window_idx", "ticker").agg(
            F.count("*").alias("n"),
            F.min_by("adj_close", "date").alias("first"),
            F.max(F.when(F.col("_back") == max(self.skip, 1), F.col("adj_close"))).alias("last"),
        )
        scores = scores.where(f"n > {self.skip + 21} AND first > 0").withColumn("score", F.try_divide("last", "first") - 1)
        return _top(scores.select("window_idx", "ticker", "score"), self.top_n, True)


class MeanReversion:
    """The last price over the one ``lookback`` rows from the end (so lookback - 1 steps before); losers are bought."""

    name = "MeanReversion"

    def __init__(self, lookback: int = 5, top_n: int = 10) -> None:
        self.lookback, self.top_n = lookback, top_n

    def fit(self, train: DataFrame) -> DataFrame:
        late = Window.partitionBy("window_idx", "ticker").orderBy(F.desc("date"))
        ranked = train.withColumn("_back", F.row_number().over(late))
        at = lambda k: F.max(F.when(F.col("_back") == k, F.col("adj_close")))
        scores = ranked.groupBy("window_idx", "ticker").agg(F.count("*").alias("n"), at(1).alias("last"), at(self.lookback).alias("base"))
        scores = scores.where(F.col("n") > self.lookback).withColumn("score", F.try_divide("last", "base") - 1)
        return _top(scores.select("window_idx", "ticker", "score"), self.top_n, False)


class FixedMix:
    """Fixed weights over those of the given tickers that training has, scaled to one."""

    def __init__(self, name: str, weights: dict[str, float]) -> None:
        self.name, self.weights = name, weights

    def fit(self, train: DataFrame) -> DataFrame:
        there = train.where(F.col("ticker").isin(list(self.weights))).select("window_idx", "ticker").distinct()
        own = F.create_map(*[x for t, w in self.weights.items() for x in (F.lit(t), F.lit(float(w)))])[F.col("ticker")]
        raw = there.withColumn("_w", own)
        return raw.select("window_idx", "ticker", (F.col("_w") / F.sum("_w").over(Window.partitionBy("window_idx"))).alias("weight"))


STRATEGIES: dict[str, Strategy] = {
    s.name: s for s in (BuyAndHold(), Momentum(), MeanReversion(), FixedMix("SPY", {"SPY": 1.0}), FixedMix("60/40", {"SPY": 0.6, "TLT": 0.4}))
}
