"""Walk-forward windows over the distinct dates of a panel, signals on test dates, and execution a day later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .signals import Strategy


@dataclass(frozen=True)
class WalkForward:
    train_days: int = 504
    test_days: int = 63
    step_days: int = 63
    initial_capital: float = 1_000_000.0
    rebalance_every: int = 1


def numbered_dates(panel: DataFrame) -> DataFrame:
    """date, i (from 0).  Dates are a few thousand whatever the number of tickers, so one task may order them."""
    return panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def windows(panel: DataFrame, plan: WalkForward = WalkForward()) -> DataFrame:
    """window_idx, train_start, train_end, test_start, test_end; none if the panel is too short."""
    dates = numbered_dates(panel)
    last = dates.agg(F.max("i").alias("last"))
    starts = last.select(F.explode(F.when(F.col("last") + 1 >= plan.train_days + plan.test_days, F.expr(f"sequence(0, last + 1 - {plan.train_days + plan.test_days}, {plan.step_days})"))).alias("s"))
    edges = starts.select((F.expr(f"s div {plan.step_days}")).cast("int").alias("window_idx"), F.explode(F.create_map(
        F.lit("train_start"), F.col("s"), F.lit("train_end"), F.col("s") + plan.train_days - 1,
        F.lit("test_start"), F.col("s") + plan.train_days, F.lit("test_end"), F.col("s") + plan.train_days + plan.test_days - 1,
    )).alias("edge", "i"))
    names = ["train_start", "train_end", "test_start", "test_end"]
    return edges.join(dates, "i").groupBy("window_idx").pivot("edge", names).agg(F.first("date"))


def training_rows(panel: DataFrame, bounds: DataFrame) -> DataFrame:
    """Panel rows of each window's training dates, with window_idx.  ``bounds`` has a row per window: a few dozen."""
    b = F.broadcast(bounds.select("window_idx", "train_start", "train_end"))
    return panel.join(b, F.col("date").between(F.col("train_start"), F.col("train_end"))).drop("train_start", "train_end")


def test_days(panel: DataFrame, bounds: DataFrame) -> DataFrame:
    """window_idx, day (from 0), date, prev_date of each window's test dates."""
    b = F.broadcast(bounds.select("window_idx", "test_start", "test_end"))
    days = panel.select("date").distinct().join(b, F.col("date").between(F.col("test_start"), F.col("test_end")))
    w = Window.partitionBy("window_idx").orderBy("date")
    return days.select("window_idx", (F.row_number().over(w) - 1).alias("day"), "date", F.lag("date").over(w).alias("prev_date"))


def signals(panel: DataFrame, strategy: Strategy, bounds: DataFrame) -> DataFrame:
    """window_idx, date, ticker, weight: the fitted weights on every test date."""
    weights = strategy.fit(training_rows(panel.select("ticker", "date", "adj_close"), bounds))
    return test_days(panel, bounds).select("window_idx", "date").join(weights, "window_idx")


def execution_schedule(panel: DataFrame, signal_rows: DataFrame, bounds: DataFrame, plan: WalkForward = WalkForward()) -> DataFrame:
    """Each test day with the signals it executes: those of the test day before.

    run_id, window_idx, day, date, ticker, price (open if positive), volume, weight, trades.  Rows are a run's priced tickers
    of a day; ``signal_rows`` may hold many runs (without a run_id column it is one).  A signal for a ticker without a
    price that day is not executed.  ``trades`` is false on a window's first day, on days without signals the day
    before, and on days between rebalances.
    """
    if "run_id" not in signal_rows.columns:
        signal_rows = signal_rows.withColumn("run_id", F.lit("run"))
    priced = panel.where("open > 0").select("ticker", "date", F.col("open").alias("price"), F.col("volume").cast("double").alias("volume"))
    # runs are the strategies and configurations that were asked for: a handful
    runs = F.broadcast(signal_rows.select("run_id").distinct())
    rows = test_days(panel, bounds).join(priced, "date", "left").crossJoin(runs)
    due = signal_rows.select("run_id", "window_idx", F.col("date").alias("prev_date"), "ticker", "weight")
    any_signal = due.select("run_id", "window_idx", "prev_date").distinct().withColumn("_signal", F.lit(True))
    rows = rows.join(due, ["run_id", "window_idx", "prev_date", "ticker"], "left").join(any_signal, ["run_id", "window_idx", "prev_date"], "left")
    turn = (F.col("day") > 0) & ((F.col("day") - 1) % plan.rebalance_every == 0)
    return rows.select("run_id", "window_idx", "day", "date", "ticker", "price", "volume", "weight", (turn & F.coalesce("_signal", F.lit(False))).alias("trades"))


def all_signals(panel: DataFrame, strategies: dict[str, Strategy], bounds: DataFrame) -> DataFrame:
    """run_id, window_idx, date, ticker, weight of several strategies: one pass over the training rows for each."""
    train = training_rows(panel.select("ticker", "date", "adj_close"), bounds)
    weights = None
    for run_id, strategy in strategies.items():
        own = strategy.fit(train).withColumn("run_id", F.lit(run_id))
        weights = own if weights is None else weights.unionByName(own)
    days = test_days(panel, bounds).select("window_idx", "date")
    return days.join(weights, "window_idx").select("run_id", "window_idx", "date", "ticker", "weight")
