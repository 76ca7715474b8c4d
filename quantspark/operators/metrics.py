"""Performance of daily return series: (keys..., date, r) frames, any number of series in one plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_series, islands, roll, running
from ..settings import TRADING_DAYS

YEARLY = math.sqrt(TRADING_DAYS)
RISK_FREE = 0.04
METRICS = (
    "total_return", "annualized_return", "annualized_volatility", "max_drawdown", "max_drawdown_duration_days", "var_95",
    "cvar_95", "sharpe_ratio", "sortino_ratio", "calmar_ratio", "win_rate", "profit_factor", "avg_win", "avg_loss",
    "win_loss_ratio", "best_day", "worst_day", "skewness", "kurtosis", "rolling_sharpe_mean", "rolling_sharpe_std",
    "pct_positive_months", "n_days",
)


def drawdowns(returns: DataFrame, *keys: str) -> DataFrame:
    """Adds cumulative_return (growth of 1), running_max, drawdown, in_drawdown; the maximum starts with the first day."""
    w = running(by_series(*keys))
    df = returns.withColumn("cumulative_return", F.product(1 + F.col("r")).over(w))
    df = df.withColumn("running_max", F.max("cumulative_return").over(w))
    df = df.withColumn("drawdown", F.try_divide(F.col("cumulative_return") - F.col("running_max"), F.col("running_max")))
    return df.withColumn("in_drawdown", F.col("drawdown") < 0)


def _rolling_sharpe(window: int, risk_free: float, *keys: str) -> Column:
    w = by_series(*keys)
    return F.try_divide(roll(F.avg, F.col("r") - risk_free / TRADING_DAYS, window, w), roll(F.stddev_samp, "r", window, w)) * YEARLY


def rolling_metrics(returns: DataFrame, *keys: str, window: int = 63, risk_free: float = RISK_FREE) -> DataFrame:
    """Adds rolling_return (annualised, compounded), rolling_volatility and rolling_sharpe."""
    w = by_series(*keys)
    grown = roll(F.product, 1 + F.col("r"), window, w)
    return returns.withColumns(
        {
            "rolling_return": F.pow(grown, F.lit(TRADING_DAYS / window)) - 1,
            "rolling_volatility": roll(F.stddev_samp, "r", window, w) * YEARLY,
            "rolling_sharpe": _rolling_sharpe(window, risk_free, *keys),
        }
    )


def monthly_returns(returns: DataFrame, *keys: str) -> DataFrame:
    """keys, month (its first day) and r of every month from first to last; a month without days has 0."""
    month = returns.withColumn("month", F.trunc("date", "MM").cast("date"))
    got = month.groupBy(*keys, "month").agg((F.product(1 + F.col("r")) - 1).alias("r"))
    span = month.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = span.select(*keys, F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return every.join(got, [*keys, "month"], "left").select(*keys, "month", F.coalesce("r", F.lit(0.0)).alias("r"))


def monthly_matrix(returns: DataFrame, *keys: str) -> DataFrame:
    """A row per year with a column m1..m12 per month, the data of a heat map."""
    months = monthly_returns(returns, *keys).withColumn("m", F.month("month"))
    wide = months.groupBy(*keys, F.year("month").alias("year")).pivot("m", list(range(1, 13)))
    return wide.agg(F.first("r")).select(*keys, "year", *(F.col(str(i)).alias(f"m{i}") for i in range(1, 13)))


def compute_all(returns: DataFrame, *keys: str, risk_free: float = RISK_FREE) -> DataFrame:
    """keys and the 23 metrics of every series; null returns are left out.

    Skewness and kurtosis carry the sample-size correction.  Ratios without a loss are infinite, ratios over a zero
    volatility or drawdown are 0, and series too short for the rolling Sharpe ratio have 0 for its mean and deviation.
    """
    series = returns.where(F.col("r").isNotNull())
    series = drawdowns(series, *keys).withColumn("_rs", _rolling_sharpe(63, risk_free, *keys))
    whole = Window.partitionBy(*keys)
    series = series.withColumn("_var", F.percentile("r", F.lit(0.05)).over(whole))
    r, rf = F.col("r"), risk_free / TRADING_DAYS
    only = lambda condition: F.when(condition, r)
    agg = series.groupBy(*keys).agg(
        F.count("*").alias("n_days"),
        (F.product(1 + r) - 1).alias("total_return"),
        F.stddev_samp("r").alias("_sd"),
        F.min("drawdown").alias("max_drawdown"),
        F.first("_var").alias("var_95"),
        F.avg(only(r <= F.col("_var"))).alias("cvar_95"),
        F.stddev_samp(only(r < rf)).alias("_down"),
        F.count_if(r > 0).alias("_wins"),
        F.sum(only(r > 0)).alias("_profit"),
        F.sum(only(r < 0)).alias("_loss"),
        F.avg(only(r > 0)).alias("_win"),
        F.avg(only(r < 0)).alias("_lose"),
        F.max("r").alias("best_day"),
        F.min("r").alias("worst_day"),
        F.skewness("r").alias("_g1"),
        F.kurtosis("r").alias("_g2"),
        F.avg("_rs").alias("_rsm"),
        F.stddev_samp("_rs").alias("_rss"),
    )
    n = F.col("n_days").cast("double")
    infinite, zero = F.lit(float("inf")), F.lit(0.0)
    agg = agg.withColumn("annualized_return", F.pow(1 + F.col("total_return"), TRADING_DAYS / n) - 1)
    agg = agg.withColumn("annualized_volatility", F.col("_sd") * YEARLY)
    excess = F.col("annualized_return") - risk_free
    down = F.coalesce(F.col("_down") * YEARLY, zero)
    profit, loss, win, lose = (F.coalesce(c, zero) for c in ("_profit", "_loss", "_win", "_lose"))
    made = {
        "sharpe_ratio": F.when(F.col("annualized_volatility") > 0, F.try_divide(excess, F.col("annualized_volatility"))).otherwise(zero),
        "sortino_ratio": F.when(down > 0, F.try_divide(excess, down)).otherwise(zero),
        "calmar_ratio": F.when(F.col("max_drawdown") != 0, F.try_divide(F.col("annualized_return"), F.abs("max_drawdown"))).otherwise(zero),
        "win_rate": F.col("_wins") / n,
        "profit_factor": F.when(loss != 0, F.try_divide(profit, F.abs(loss))).otherwise(infinite),
        "avg_win": win,
        "avg_loss": lose,
        "win_loss_ratio": F.when(lose != 0, F.try_divide(win, F.abs(lose))).otherwise(infinite),
        "skewness": F.when(n > 2, F.try_divide(F.col("_g1") * F.sqrt(n * (n - 1)), n - 2)),
        "kurtosis": F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * F.col("_g2") + 6), (n - 2) * (n - 3))),
        "rolling_sharpe_mean": F.coalesce("_rsm", zero),
        "rolling_sharpe_std": F.coalesce("_rss", zero),
    }
    agg = agg.withColumns(made)
    runs = islands(series.select(*keys, "date", "in_drawdown"), "in_drawdown", *keys).groupBy(*keys, "island")
    longest = runs.agg(F.count_if("in_drawdown").alias("n")).groupBy(*keys).agg(F.max("n").alias("max_drawdown_duration_days"))
    months = monthly_returns(series.select(*keys, "date", "r"), *keys).groupBy(*keys).agg(F.avg((F.col("r") > 0).cast("double")).alias("pct_positive_months"))
    if keys:
        out = agg.join(longest, list(keys)).join(months, list(keys))
    else:
        out = agg.crossJoin(longest).crossJoin(months)
    return out.select(*keys, *METRICS)


def regime_metrics(returns: DataFrame, labels: DataFrame, risk_free: float = RISK_FREE) -> DataFrame:
    """The metrics of the days of each regime that has more than five."""
    joined = returns.join(labels.select("date", "regime"), "date").where(F.col("r").isNotNull())
    enough = joined.groupBy("regime").agg(F.count("*").alias("n")).where("n > 5").select("regime")
    return compute_all(joined.join(enough, "regime", "left_semi").select("regime", "date", "r"), "regime", risk_free=risk_free)
