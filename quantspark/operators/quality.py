"""Checks of bars: one relational plan for all tickers; an empty panel is clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_date, islands
from ..settings import MAX_DAILY_RETURN, MIN_BARS_FOR_OUTLIERS, SPLIT_CHANGE, STALE_DAYS

VALID = "high >= low AND high >= open AND high >= close AND low <= open AND low <= close AND volume >= 0"


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars that keep the rules of a bar, the others for quarantine); a NULL that hides a rule counts as broken."""
    ok = F.coalesce(F.expr(VALID), F.lit(False))
    return bars.where(ok), bars.where(~ok)


def inconsistent(bars: DataFrame) -> DataFrame:
    return bars.where("high < low OR open > high OR open < low OR close > high OR close < low").select("ticker", "date")


def missing_sessions(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Sessions between a ticker's first and last bar without a bar; the default calendar is all dates of the panel."""
    calendar = (calendar or bars).select("date").distinct()
    spans = bars.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    due = spans.join(calendar, F.col("date").between(F.col("lo"), F.col("hi"))).select("ticker", "date")
    return due.join(bars.select("ticker", "date"), ["ticker", "date"], "left_anti")


def with_change(bars: DataFrame) -> DataFrame:
    w = by_date()
    change = F.try_divide("close", F.lag("close").over(w)) - 1
    return bars.withColumn("change", change).withColumn("n_bars", F.count("*").over(Window.partitionBy("ticker")))


def outliers(bars: DataFrame) -> DataFrame:
    found = with_change(bars).where((F.abs("change") > MAX_DAILY_RETURN) & (F.col("n_bars") >= MIN_BARS_FOR_OUTLIERS))
    return found.select("ticker", "date", "change")


def suspected_splits(bars: DataFrame) -> DataFrame:
    return with_change(bars).where(F.abs("change") > SPLIT_CHANGE).select("ticker", "date", "change")


def zero_volume(bars: DataFrame) -> DataFrame:
    return bars.where("volume = 0").select("ticker", "date")


def stale_runs(bars: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    """ticker, start_date, end_date, n_days of runs of equal closes."""
    runs = islands(bars, "close", "ticker").groupBy("ticker", "island")
    return runs.agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_days")).where(F.col("n_days") >= days).drop("island")


def quality_report(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """A row per ticker: total_bars, the count of each kind of issue, is_clean."""
    checks = {
        "inconsistent": inconsistent(bars),
        "missing_days": missing_sessions(bars, calendar),
        "outliers": outliers(bars),
        "splits": suspected_splits(bars),
        "zero_volume": zero_volume(bars),
        "stale_runs": stale_runs(bars),
    }
    spans = bars.groupBy("ticker").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("total_bars"))
    issues = None
    for name, rows in checks.items():
        named = rows.select("ticker", F.lit(name).alias("kind"))
        issues = named if issues is None else issues.unionByName(named)
    counts = issues.groupBy("ticker").pivot("kind", list(checks)).count()
    out = spans.join(counts, "ticker", "left").na.fill(0, list(checks))
    return out.withColumn("is_clean", F.expr(" + ".join(checks) + " = 0"))
