"""Ten volatility features per ticker."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import by_date, clean, roll
from ..plans.registry import VOLATILITY
from ..schema import require
from ..settings import TRADING_DAYS


def volatility(bars: DataFrame) -> DataFrame:
    """``bars`` with the volatility features.  A negative Garman-Klass variance has no root and is NULL."""
    require(bars, "ticker", "date", "adj_close", "open", "high", "low")
    w, c, keep = by_date(), F.col("adj_close"), bars.columns
    yearly = math.sqrt(TRADING_DAYS)
    log = lambda a, b: F.ln(F.try_divide(a, b))
    high_low = log(F.col("high"), F.col("low"))
    df = bars.withColumns(
        {
            "_lr": log(c, F.lag(c).over(w)),
            "_hl2": F.pow(high_low, F.lit(2.0)),
            "_gk": 0.5 * F.pow(high_low, F.lit(2.0)) - (2 * math.log(2) - 1) * F.pow(log(c, F.col("open")), F.lit(2.0)),
            "_range": F.try_divide(F.col("high") - F.col("low"), F.col("low")),
        }
    )
    df = df.withColumns({f"realized_vol_{k}d": roll(F.stddev_samp, "_lr", k, w) * yearly for k in (5, 21, 63)})
    v63 = F.col("realized_vol_63d")
    made = {f"realized_vol_{k}d": F.col(f"realized_vol_{k}d") for k in (5, 21, 63)}
    made |= {f"vol_ratio_5_{k}": F.try_divide("realized_vol_5d", f"realized_vol_{k}d") for k in (21, 63)}
    made |= {"vol_of_vol_21d": roll(F.stddev_samp, "realized_vol_5d", 21, w)}
    made |= {"garman_klass_vol_21d": clean(F.sqrt(roll(F.avg, "_gk", 21, w) * TRADING_DAYS))}
    made |= {"parkinson_vol_21d": F.sqrt(roll(F.sum, "_hl2", 21, w) * (TRADING_DAYS / (4 * 21 * math.log(2))))}
    made |= {"vol_regime_z_score": F.try_divide(v63 - roll(F.avg, v63, 252, w), roll(F.stddev_samp, v63, 252, w))}
    made |= {"high_low_range_ratio": F.try_divide(F.col("_range"), roll(F.avg, "_range", 21, w))}
    return df.select(*keep, *(made[name].alias(name) for name in VOLATILITY))
