"""What regimes look like: (date, regime) labels against features and returns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import islands
from ..settings import TRADING_DAYS

HIGH_VOLATILITY = 0.20
POSITIONAL = ("Crisis", "Quiet Bear", "Recovery", "Steady Bull")
YEARLY = math.sqrt(TRADING_DAYS)


def transitions(labels: DataFrame) -> DataFrame:
    """date, from_regime, to_regime of every change."""
    before = F.lag("regime").over(Window.orderBy("date"))
    return labels.withColumn("from_regime", before).where("from_regime <> regime").select("date", "from_regime", F.col("regime").alias("to_regime"))


def runs(labels: DataFrame) -> DataFrame:
    """regime, start_date, end_date, n_days of every run: also the data of a timeline plot."""
    marked = islands(labels.withColumn("_all", F.lit(0)), "regime", "_all")
    grouped = marked.groupBy("island").agg(F.first("regime").alias("regime"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_days"))
    return grouped.select("regime", "start_date", "end_date", "n_days")


def suggested_label(regime: Column, n_regimes: Column, annual_return: Column, annual_vol: Column) -> Column:
    up, wild = annual_return > 0, annual_vol > HIGH_VOLATILITY
    by_stats = F.when(up & ~wild, "Steady Bull").when(up & wild, "Recovery").when(~up & ~wild, "Quiet Bear").otherwise("Crisis")
    names = F.array(*[F.lit(x) for x in POSITIONAL])
    by_place = F.when(n_regimes <= len(POSITIONAL), F.get(names, F.pmod(regime, F.lit(len(POSITIONAL))).cast("int")))
    by_place = by_place.otherwise(F.concat(F.lit("Regime "), regime.cast("string")))
    return F.when(annual_return.isNotNull() & annual_vol.isNotNull(), by_stats).otherwise(by_place)


def _returns(joined: DataFrame) -> DataFrame:
    daily = joined.where(F.col("r").isNotNull()).groupBy("regime")
    agg = daily.agg(F.avg("r").alias("mean_daily_return"), F.stddev_samp("r").alias("_sd"), F.count("*").alias("n_days"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"))
    agg = agg.withColumn("annualized_return", F.col("mean_daily_return") * TRADING_DAYS).withColumn("annualized_vol", F.col("_sd") * YEARLY)
    sharpe = F.when(F.col("annualized_vol") > 0, F.try_divide("annualized_return", "annualized_vol")).otherwise(F.lit(0.0))
    return agg.withColumn("sharpe", sharpe).drop("_sd")


def performance(labels: DataFrame, returns: DataFrame) -> DataFrame:
    """regime, mean_daily_return, annualized_return, annualized_vol, sharpe, n_days, hit_rate."""
    out = _returns(labels.select("date", "regime").join(returns.select("date", "r"), "date"))
    return out.select("regime", "mean_daily_return", "annualized_return", "annualized_vol", "sharpe", "n_days", "hit_rate")


def dominant_features(labels: DataFrame, matrix: DataFrame, features: Sequence[str], top: int = 5) -> DataFrame:
    """regime, feature_name, mean_abs of the features with the largest mean size; ties by name."""
    joined = labels.select("date", "regime").join(matrix, "date")
    sizes = joined.groupBy("regime").agg(*[F.avg(F.abs(f)).alias(f) for f in features])
    long = sizes.unpivot(["regime"], list(features), "feature_name", "mean_abs").where(F.col("mean_abs").isNotNull())
    place = F.row_number().over(Window.partitionBy("regime").orderBy(F.desc("mean_abs"), "feature_name"))
    return long.withColumn("_p", place).where(F.col("_p") <= top).drop("_p")


def characterize(labels: DataFrame, matrix: DataFrame | None = None, features: Sequence[str] = (), returns: DataFrame | None = None) -> DataFrame:
    """A row per regime: count, pct_of_total, average and longest duration, return statistics, suggested label."""
    total = F.sum("count").over(Window.partitionBy())
    base = labels.groupBy("regime").agg(F.count("*").alias("count"))
    base = base.withColumn("pct_of_total", F.col("count") / total).withColumn("_n", F.count("*").over(Window.partitionBy()))
    lengths = runs(labels).groupBy("regime").agg(F.avg("n_days").alias("avg_duration_days"), F.max("n_days").alias("max_duration_days"))
    out = base.join(lengths, "regime")
    if returns is not None:
        stats = _returns(labels.select("date", "regime").join(returns.select("date", "r"), "date", "left"))
        out = out.join(stats.select("regime", "annualized_return", "annualized_vol", "sharpe"), "regime", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("annualized_return", "annualized_vol", "sharpe")})
    label = suggested_label(F.col("regime"), F.col("_n"), F.col("annualized_return"), F.col("annualized_vol"))
    out = out.withColumn("suggested_label", label).drop("_n")
    if matrix is not None and features:
        tops = dominant_features(labels, matrix, features).groupBy("regime").agg(
            F.map_from_entries(F.collect_list(F.struct("feature_name", "mean_abs"))).alias("dominant_features")
        )
        out = out.join(tops, "regime", "left")
    return out


def timeline(prices: DataFrame, labels: DataFrame) -> DataFrame:
    """date, price, regime, block: prices with the contiguous blocks of regimes to shade."""
    joined = prices.select("date", F.col("adj_close").alias("price")).join(labels.select("date", "regime"), "date")
    return islands(joined.withColumn("_all", F.lit(0)), "regime", "_all").withColumnRenamed("island", "block").drop("_all")


def scatter(components: DataFrame, labels: DataFrame) -> DataFrame:
    """date, pc1, pc2, regime."""
    pcs = components.select("date", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2"))
    return pcs.join(labels.select("date", "regime"), "date")
