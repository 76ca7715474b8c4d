"""Eight features of a ticker among all tickers of a date.

Returns count rows of the market calendar, not of the ticker: on the dense grid a ticker's price is carried forward from
its first bar, so every listed ticker takes part on every date.  Volume is not carried: a missing bar leaves the 21-day
mean empty.  Results are kept for the dates on which the ticker really traded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.windows import by_date, ffill, pct_rank, ret, roll
from ..plans.registry import CROSS_SECTIONAL
from ..schema import require
from ..sources.panel import dense_grid


def with_sectors(bars: DataFrame, sectors: DataFrame | None) -> DataFrame:
    """``bars`` with a sector from the (ticker, sector) frame, 'Unknown' where it has none."""
    if sectors is None:
        if "sector" not in bars.columns:
            raise InvalidInput("cross-sectional features need a sector for every ticker")
        return bars
    known = sectors.select("ticker", F.col("sector").alias("_sector")).dropDuplicates(["ticker"])
    return bars.drop("sector").join(known, "ticker", "left").withColumn("sector", F.coalesce("_sector", F.lit("Unknown"))).drop("_sector")


def cross_sectional(bars: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """ticker, date and the cross-sectional features of every bar."""
    require(bars, "ticker", "date", "adj_close", "volume")
    placed = with_sectors(bars, sectors).select("ticker", "date", "sector", "adj_close", "volume")
    home = placed.select("ticker", "sector").distinct()
    grid = dense_grid(placed.drop("sector")).join(home, "ticker")
    w = by_date()
    grid = grid.withColumn("_px", ffill("adj_close", w))
    volume = F.col("volume").cast("double")
    grid = grid.withColumns({"_r21": ret("_px", 21, w), "_r63": ret("_px", 63, w), "_vr": F.try_divide(volume, roll(F.avg, volume, 21, w))})
    day, sector = Window.partitionBy("date"), Window.partitionBy("date", "sector")
    mean21 = F.avg("_r21").over(sector)
    made = {
        "rank_returns_21d": pct_rank("_r21", "date"),
        "rank_returns_63d": pct_rank("_r63", "date"),
        "sector_relative_return_21d": F.col("_r21") - mean21,
        "sector_relative_return_63d": F.col("_r63") - F.avg("_r63").over(sector),
        "sector_momentum_21d": mean21,
        "market_breadth": F.try_divide(F.count_if(F.col("_r21") > 0).over(day), F.count("_r21").over(day)),
        "dispersion_21d": F.stddev_samp("_r21").over(day),
        "rank_volume_ratio": pct_rank("_vr", "date"),
    }
    grid = grid.withColumns({name: made[name] for name in CROSS_SECTIONAL})
    return grid.where(F.col("adj_close").isNotNull()).select("ticker", "date", *CROSS_SECTIONAL)
