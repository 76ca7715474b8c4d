"""Queries through the stores: what a user of the data layer calls daily, run on fresh tables in the shared folder."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..operators.macro import macro
from ..operators.pca import cleaned
from ..operators.technical import technical
from ..sources import panel, scratch, universe
from ..sources.ingest import BarStore, FrameProvider, ingest_historical, ingest_incremental
from ..sources.store import FeatureStore
from ..sources.tables import verify
from ..streaming.features import stream_bars
from .pipeline import FeaturePipeline
from .registry import TECHNICAL, FeatureComputer, FeatureRegistry, FeatureSpec, SingleTickerComputer

#: The dates of the examples: the tables' trades lie in 1995 to 2001.
LOW, MID, HIGH = datetime.date(1996, 3, 5), datetime.date(1998, 6, 30), datetime.date(1999, 9, 20)
TICKERS = ("NATION_3", "NATION_11", "NATION_24")
COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume", "adj_close")


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _stores(spark: SparkSession) -> tuple[BarStore, FeatureStore]:
    root = scratch.new_path(spark, "store")
    bars, features = BarStore(spark, root), FeatureStore(spark, root)
    bars.create_schema()
    features.create_schema()
    return bars, features


def _filled(spark: SparkSession, sf_dir: str) -> BarStore:
    store = _stores(spark)[0]
    store.upsert_bars(panel.bars(spark, sf_dir))
    return store


def store_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are there after create_schema, and one that nobody made."""
    bars, features = _stores(spark)
    missing = BarStore(spark, scratch.new_path(spark, "none")).bars
    return verify([*bars.tables, features.values, features.metadata]).unionByName(verify([missing]).withColumn("name", F.lit("none")))


def store_get_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_filled(spark, sf_dir).get_data("NATION_3", LOW, HIGH))


def store_universe_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_filled(spark, sf_dir).get_universe_data(TICKERS, LOW, HIGH))


def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary and the latest date of one ticker and of one that is not there."""
    store = _filled(spark, sf_dir)
    row = store.get_summary() | {"latest": store.get_latest_date("NATION_3"), "nobody": store.get_latest_date("NOBODY")}
    return spark.createDataFrame([row], "tickers long, total_bars long, latest date, nobody date")


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars after a second batch has replaced those of every Monday: the merge, not only its window."""
    store = _filled(spark, sf_dir)
    store.upsert_bars(panel.bars(spark, sf_dir).where("dayofweek(date) = 2").withColumn("volume", F.col("volume") + 1000))
    return rounded(store.bars.read())


def store_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored quality reports, and whether the ticker is among those with issues."""
    store = _stores(spark)[0]
    store.store_quality_reports(quality.quality_report(panel.bars(spark, sf_dir)))
    issues = store.tickers_with_issues().withColumn("listed", F.lit(True))
    reports = store.quality.read().join(issues, "ticker", "left")
    return reports.select("ticker", "start_date", "end_date", "total_bars", "n_issues", "is_clean", F.coalesce("listed", F.lit(False)).alias("listed"))


def store_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of one ticker between two dates, out of all technical features of all tickers."""
    store = _stores(spark)[1]
    store.store_features(technical(panel.bars(spark, sf_dir)).select("ticker", "date", *TECHNICAL))
    return rounded(store.get_features("NATION_3", ["returns_1d", "rsi_14"], LOW, HIGH), 6)


def ingest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of an ingestion until MID in which one ticker does not exist."""
    store = _stores(spark)[0]
    ingest_historical([*TICKERS, "NOWHERE"], LOW, MID, FrameProvider(panel.bars(spark, sf_dir).select(*COLUMNS)), store, 2)
    return store.log.read().select("ticker", "start_date", "end_date", "status", "n_rows", "error")


def ingest_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars after an ingestion until MID and an incremental one until HIGH."""
    store = _stores(spark)[0]
    provider = FrameProvider(panel.bars(spark, sf_dir).select(*COLUMNS))
    ingest_historical(TICKERS, LOW, MID, provider, store)
    ingest_incremental([*TICKERS, "NOWHERE"], provider, store, HIGH)
    return rounded(store.bars.read())


def provider_drops_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider hands on when the prices of every third day are missing altogether, and one price on others."""
    bars = panel.bars(spark, sf_dir).select(*COLUMNS)
    day = F.dayofmonth("date")
    holes = bars.withColumns({c: F.when(day % 3 != 0, F.col(c)) for c in ("open", "high", "low", "close")}).withColumn("open", F.when(day % 5 != 0, F.col("open")))
    return rounded(FrameProvider(holes).fetch_bulk(TICKERS, LOW, HIGH))


def bar_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that break the rules of a bar when every fourth day's low and close change places and every seventh's volume is negative."""
    bars, day = panel.bars(spark, sf_dir).select(*COLUMNS), F.dayofmonth("date")
    mixed = bars.withColumns({"low": F.when(day % 4 == 0, F.col("close")).otherwise(F.col("low")), "close": F.when(day % 4 == 0, F.col("low")).otherwise(F.col("close")), "volume": F.when(day % 7 == 0, -F.col("volume")).otherwise(F.col("volume"))})
    good, bad = quality.split_valid(mixed)
    return good.withColumn("valid", F.lit(True)).unionByName(bad.withColumn("valid", F.lit(False))).select("ticker", "date", "valid")


def cleaned_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the PCA: gaps filled forward, rows before every feature has begun dropped."""
    names = ("spy_returns_5d", "spy_vol_21d", "spy_above_200sma")
    market = macro(panel.index_bars(spark, sf_dir)).withColumn("spy_vol_21d", F.when(F.dayofmonth("date") % 6 != 0, F.col("spy_vol_21d")))
    return rounded(cleaned(market.select("date", *names), names).withColumn("i", F.col("i").cast("long")), 6)


def universe_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.tickers(universe.from_nations(spark, sf_dir))


class DayRange(SingleTickerComputer):
    """An example of a user's own group of features."""

    category = "custom"
    required_columns = ("ticker", "date", "high", "low")

    def specs(self) -> list[FeatureSpec]:
        return [FeatureSpec("day_range", self.category, 1)]

    def compute(self, bars: DataFrame) -> DataFrame:
        return bars.select("ticker", "date", (F.col("high") - F.col("low")).alias("day_range"))


def custom_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined feature, with what the registry then knows of it."""
    registry = FeatureRegistry()
    computer: FeatureComputer = DayRange(registry)
    spec = registry.get("day_range")
    return rounded(computer(panel.bars(spark, sf_dir)).withColumns({"category": F.lit(spec.category), "lookback_days": F.lit(spec.lookback_days)}))


def pipeline_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that a run of the pipeline and its continuation have stored, per ticker."""
    bars, features = _stores(spark)
    bars.upsert_bars(panel.bars(spark, sf_dir).where(F.col("ticker").isin(*TICKERS)))
    bars.upsert_bars(panel.index_bars(spark, sf_dir))
    pipeline = FeaturePipeline(bars, features)
    pipeline.run(list(TICKERS), MID, datetime.date(1998, 9, 30))
    pipeline.run_incremental(list(TICKERS), datetime.date(1998, 12, 31))
    stored = features.values.read(["volume_ratio_5d"])
    return stored.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"))


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that a stream has upserted into the store, file by file."""
    source, store = scratch.new_path(spark, "arriving"), _stores(spark)[0]
    bars = panel.bars(spark, sf_dir).select(*COLUMNS).where(F.col("date").between(F.lit(LOW), F.lit(MID)))
    bars.repartition(3).write.parquet(source)
    stream_bars(spark.readStream.schema(bars.schema).parquet(source), store, scratch.new_path(spark, "stream")).awaitTermination()
    return rounded(store.bars.read())


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of the volatility regimes as JSON lines."""
    from ..operators.analysis import transitions
    from ..operators.detector import volatility_rule

    changes = transitions(volatility_rule(panel.index_bars(spark, sf_dir)))
    return changes.select("date", F.to_json(F.struct("from_regime", "to_regime")).alias("json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        store_schema, store_get_bars, store_universe_bars, store_summary, store_upsert, store_quality, store_features, ingest_run,
        ingest_continued, provider_drops_empty_rows, bar_model, cleaned_matrix, universe_tickers, custom_feature, pipeline_incremental,
        streamed_bars, json_rows,
    )
}
