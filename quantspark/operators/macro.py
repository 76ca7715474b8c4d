"""Six market-wide features from an index series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_date, ret, roll, running
from ..plans.registry import MACRO
from ..schema import require
from ..settings import TRADING_DAYS


def macro(index: DataFrame, dispersion: DataFrame | None = None) -> DataFrame:
    """date and the macro features; ``dispersion`` (date, dispersion_21d) fills market_return_dispersion."""
    require(index, "ticker", "date", "adj_close")
    w, c = by_date(), F.col("adj_close")
    df = index.withColumn("_lr", F.ln(F.try_divide(c, F.lag(c).over(w)))).withColumn("_top", F.max(c).over(running(w)))
    made = {
        "spy_returns_5d": ret(c, 5, w),
        "spy_returns_21d": ret(c, 21, w),
        "spy_vol_21d": roll(F.stddev_samp, "_lr", 21, w) * math.sqrt(TRADING_DAYS),
        "spy_drawdown": F.try_divide(c - F.col("_top"), F.col("_top")),
        "spy_above_200sma": (c > roll(F.avg, c, 200, w)).cast("double"),
    }
    df = df.select("date", *(x.alias(n) for n, x in made.items()))
    if dispersion is None:
        return df.withColumn("market_return_dispersion", F.lit(None).cast("double"))
    per_date = dispersion.select("date", F.col("dispersion_21d").alias("market_return_dispersion")).groupBy("date").agg(F.max("market_return_dispersion").alias("market_return_dispersion"))
    return df.join(per_date, "date", "left").select("date", *MACRO)
