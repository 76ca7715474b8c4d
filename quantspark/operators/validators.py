"""Five integrity checks of backtests: (run_id, name, passed, value) rows for any number of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import TRADING_DAYS

MAX_TURNOVER, MIN_WINDOWS, MAX_HALF_RATIO = 50.0, 3, 3.0
MAX_SHARPE, MAX_ANNUAL_RETURN, LONG_CURVE = 4.0, 1.0, 50


def _check(rows: DataFrame, name: str, passed: Column, value: Column) -> DataFrame:
    return rows.select("run_id", F.lit(name).alias("name"), passed.alias("passed"), value.cast("double").alias("value"))


def signal_timing(runs: DataFrame, windows: DataFrame, trades: DataFrame) -> DataFrame:
    """Windows with a trade on their first test date, which no earlier signal can have caused."""
    first = trades.select("run_id", F.col("date").alias("test_start")).distinct()
    bad = windows.join(first, ["run_id", "test_start"], "left_semi").groupBy("run_id").agg(F.count("*").alias("n"))
    joined = runs.join(bad, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _check(joined, "signal_timing", F.col("n") == 0, F.col("n"))


def turnover(runs: DataFrame, equity: DataFrame, trades: DataFrame, most: float = MAX_TURNOVER) -> DataFrame:
    """Traded value over the mean portfolio value, per year."""
    traded = trades.groupBy("run_id").agg(F.sum(F.abs("gross_value")).alias("gross"))
    curve = equity.groupBy("run_id").agg(F.avg("portfolio_value").alias("mean"), (F.count("*") / TRADING_DAYS).alias("years"))
    joined = runs.join(traded, "run_id", "left").join(curve, "run_id", "left")
    value = F.coalesce(F.when((F.col("mean") > 0) & (F.col("years") > 0), F.col("gross") / F.col("mean") / F.col("years")), F.lit(0.0))
    return _check(joined, "turnover", value <= most, value)


def window_consistency(runs: DataFrame, windows: DataFrame, least: int = MIN_WINDOWS) -> DataFrame:
    found = windows.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("test_start") <= F.col("train_end")).alias("overlaps"))
    joined = runs.join(found, "run_id", "left").na.fill(0, ["n", "overlaps"])
    return _check(joined, "window_consistency", (F.col("n") >= least) & (F.col("overlaps") == 0), F.col("n"))


def data_snooping(runs: DataFrame, windows: DataFrame, most: float = MAX_HALF_RATIO) -> DataFrame:
    """Mean over deviation of window returns in the first half against the second; fewer than four windows pass."""
    w = Window.partitionBy("run_id")
    place = windows.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("window_idx")) - 1)
    half = F.when(F.col("i") < F.expr("n div 2"), F.col("window_return"))
    rest = F.when(F.col("i") >= F.expr("n div 2"), F.col("window_return"))

    def ratio(x: Column) -> Column:
        sd = F.stddev_pop(x)
        return F.avg(x) / F.when(sd > 0, sd).otherwise(F.lit(1.0))

    found = place.groupBy("run_id").agg(F.max("n").alias("n"), ratio(half).alias("a"), ratio(rest).alias("b"))
    joined = runs.join(found, "run_id", "left")
    value = F.when(F.col("b") != 0, F.abs(F.try_divide("a", "b"))).otherwise(F.abs("a"))
    few = F.coalesce(F.col("n") < 4, F.lit(True))
    return _check(joined, "data_snooping", few | (value <= most), F.when(few, F.lit(0.0)).otherwise(value))


def return_plausibility(runs: DataFrame, metrics: DataFrame, equity: DataFrame) -> DataFrame:
    points = equity.groupBy("run_id").agg(F.count("*").alias("points"))
    joined = runs.join(metrics.select("run_id", "sharpe_ratio", "annualized_return", "max_drawdown"), "run_id", "left").join(points, "run_id", "left")
    issues = [F.abs("sharpe_ratio") > MAX_SHARPE, F.col("annualized_return") > MAX_ANNUAL_RETURN, (F.col("max_drawdown") == 0) & (F.col("points") > LONG_CURVE)]
    n = sum((F.coalesce(x, F.lit(False)).cast("int") for x in issues), F.lit(0))
    return _check(joined, "return_plausibility", n == 0, n)


def validate(windows: DataFrame, equity: DataFrame, trades: DataFrame, metrics: DataFrame) -> DataFrame:
    runs = equity.select("run_id").distinct()
    checks = [
        signal_timing(runs, windows, trades), turnover(runs, equity, trades), window_consistency(runs, windows),
        data_snooping(runs, windows), return_plausibility(runs, metrics, equity),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def verdicts(checks: DataFrame) -> DataFrame:
    """run_id, passed, summary."""
    failed = F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    agg = checks.groupBy("run_id").agg(F.bool_and("passed").alias("passed"), failed.alias("failed"))
    text = F.when(F.col("passed"), F.lit("all checks passed")).otherwise(F.concat(F.lit("failed: "), F.array_join("failed", ", ")))
    return agg.select("run_id", "passed", text.alias("summary"))
