"""Daily bars from the driver's tables.

A bar's ticker is the supplier's nation (or region), its date the day of shipping, a trade's price the extended price per
unit.  Open and close are the prices of the day's first and last trade in the full key order; min_by and max_by over
that key combine on the map side, so no window orders the trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import keep

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(trades: DataFrame, *keys: str | Column) -> DataFrame:
    at = F.struct(*ORDER)
    bars = trades.groupBy(*keys).agg(
        F.min_by("px", at).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", at).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )
    return bars.withColumn("adj_close", F.col("close"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(*ORDER, F.col("l_shipdate").cast("date").alias("date"))
    return lines.withColumn("px", F.try_divide("l_extendedprice", "l_quantity"))


def homes(spark: SparkSession, sf_dir: str, ticker: str = "n_name") -> DataFrame:
    """s_suppkey, ticker, sector of every supplier."""
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # 25 nations and 5 regions, whatever the scale
    nations = F.broadcast(read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey")))
    return suppliers.join(nations, F.expr("s_nationkey = n_nationkey")).select("s_suppkey", F.col(ticker).alias("ticker"), F.col("r_name").alias("sector"))


COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume", "adj_close", "sector")


def bars(spark: SparkSession, sf_dir: str, ticker: str = "n_name") -> DataFrame:
    """ticker, date, open, high, low, close, volume, adj_close, sector."""
    joined = trades(spark, sf_dir).join(homes(spark, sf_dir, ticker), F.expr("l_suppkey = s_suppkey"))
    return _bars(joined, "ticker", "date", "sector").select(*COLUMNS)


def bars_and_index(spark: SparkSession, sf_dir: str, ticker: str = "n_name") -> tuple[DataFrame, DataFrame]:
    """:func:`bars` and :func:`index_bars` from one scan of the trades, kept: bars are few, and features read them often.

    A bar carries the places of its first and last trade, so that the day's bar of all tickers follows from theirs.
    """
    joined = trades(spark, sf_dir).join(homes(spark, sf_dir, ticker), F.expr("l_suppkey = s_suppkey"), "left")
    at = F.struct(*ORDER)
    parts = joined.groupBy("ticker", "date", "sector").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.sum("l_quantity").alias("volume"), F.min(at).alias("first"), F.max(at).alias("last"),
    )
    parts = keep(parts.withColumn("adj_close", F.col("close")), "bars")
    whole = parts.groupBy("date").agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"),
        F.sum("volume").alias("volume"),
    )
    index = whole.withColumns({"adj_close": F.col("close"), "ticker": F.lit("SPY"), "sector": F.lit("Index")})
    return parts.where("ticker IS NOT NULL").select(*COLUMNS), index.select(*COLUMNS)


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market index SPY: all trades of a day as one bar."""
    out = _bars(trades(spark, sf_dir), "date").withColumn("ticker", F.lit("SPY"))
    return out.select("ticker", "date", "open", "high", "low", "close", "volume", "adj_close", F.lit("Index").alias("sector"))


def bond_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second asset TLT: the mean order value of a day, in thousands."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    px = orders.groupBy("date").agg((F.avg("o_totalprice") / 1000).alias("px"), F.count("*").cast("double").alias("volume"))
    prices = [F.col("px").alias(c) for c in ("open", "high", "low", "close")]
    return px.select(F.lit("TLT").alias("ticker"), "date", *prices, "volume", F.col("px").alias("adj_close"), F.lit("Bond").alias("sector"))


def market_panel(spark: SparkSession, sf_dir: str, ticker: str = "n_name") -> DataFrame:
    each, index = bars_and_index(spark, sf_dir, ticker)
    return each.unionByName(index).unionByName(bond_bars(spark, sf_dir))


def dense_grid(panel: DataFrame) -> DataFrame:
    """Every ticker on every date of the panel, with NULL where it did not trade.

    The product of two distinct key lists is exactly the dense panel, the domain of the cross-sectional features.
    """
    dates, tickers = panel.select("date").distinct(), panel.select("ticker").distinct()
    return dates.crossJoin(tickers).join(panel, ["ticker", "date"], "left")
