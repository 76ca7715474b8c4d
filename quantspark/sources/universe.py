"""The universe of tickers as a (ticker, sector) table that the user supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import read

# A small test universe.
TEST_TICKERS = (
    "AAPL", "MSFT", "JNJ", "UNH", "JPM", "GS", "AMZN", "TSLA", "GOOGL", "META", "CAT", "HON", "PG", "KO", "XOM", "CVX",
    "NEE", "DUK", "AMT", "PLD", "LIN", "APD",
)


def from_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return joined.select(F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"))


def tickers(universe: DataFrame) -> DataFrame:
    return universe.select("ticker").distinct().orderBy("ticker")


def sectors(universe: DataFrame) -> DataFrame:
    return universe.select("sector").distinct().orderBy("sector")


def sector_tickers(universe: DataFrame, sector: str) -> DataFrame:
    """Tickers of a sector in order; ValueError if there is no such sector."""
    found = universe.where(F.col("sector") == sector).select("ticker").distinct().orderBy("ticker")
    if not found.limit(1).count():
        known = [r[0] for r in sectors(universe).collect()]
        raise ValueError(f"no sector {sector!r}; there are {', '.join(known)}")
    return found
