"""The feature store: long (ticker, date, feature) rows, partitioned by feature."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import FeatureRegistry
from ..schema import FEATURE_METADATA, FEATURES
from .tables import KeyedTable


def to_long(wide: DataFrame, features: list[str] | None = None) -> DataFrame:
    """ticker, date, feature_name, value of the values that are there; NaN counts as missing."""
    names = features or [c for c in wide.columns if c not in ("ticker", "date")]
    doubles = wide.select("ticker", "date", *(F.col(c).cast("double").alias(c) for c in names))
    return doubles.unpivot(["ticker", "date"], names, "feature_name", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def to_wide(long: DataFrame, features: list[str]) -> DataFrame:
    """ticker, date and a column for each named feature; the list is given, so no job looks for it."""
    return long.groupBy("ticker", "date").pivot("feature_name", features).agg(F.first("value", ignorenulls=True))


def coverage(long: DataFrame) -> DataFrame:
    """One row: tickers, features, total_rows, earliest_date, latest_date."""
    return long.agg(
        F.countDistinct("ticker").alias("tickers"),
        F.countDistinct("feature_name").alias("features"),
        F.count("*").alias("total_rows"),
        F.min("date").alias("earliest_date"),
        F.max("date").alias("latest_date"),
    )


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.values = KeyedTable(spark, root, "feature_values", FEATURES, ["ticker", "date", "feature_name"], "feature_name")
        self.metadata = KeyedTable(spark, root, "feature_metadata", FEATURE_METADATA, ["feature_name"])

    def create_schema(self) -> None:
        self.values.create()
        self.metadata.create()

    def store_features(self, wide: DataFrame, ticker: str | None = None) -> int:
        """Upsert the values of a wide frame (of one ticker, if it has no ticker column); rows stored."""
        if "ticker" not in wide.columns:
            wide = wide.withColumn("ticker", F.lit(ticker))
        return self.values.upsert(to_long(wide).withColumn("computed_at", F.current_timestamp()), "computed_at")

    def store_feature_metadata(self, registry: FeatureRegistry) -> int:
        return self.metadata.upsert(registry.to_frame(self.spark).withColumn("last_computed", F.current_timestamp()), "last_computed")

    def _select(self, tickers: list[str], names: list[str] | None, start: datetime.date | None, end: datetime.date | None) -> DataFrame:
        # a partition for each feature: only the named ones are read
        rows = self.values.read(names).where(F.col("ticker").isin(tickers) if tickers else F.lit(False))
        if names is not None:
            rows = rows.where(F.col("feature_name").isin(names) if names else F.lit(False))
        if start is not None:
            rows = rows.where(F.col("date") >= F.lit(start))
        return rows if end is None else rows.where(F.col("date") <= F.lit(end))

    def get_features(self, ticker: str, names: list[str] | None = None, start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
        return self._select([ticker], names, start, end).select("date", "feature_name", "value").orderBy("date", "feature_name")

    def get_feature_matrix(self, tickers: list[str], names: list[str] | None = None, start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
        """ticker, date and a column per feature; an empty list of tickers gives an empty frame."""
        return to_wide(self._select(tickers, names, start, end), names or self.get_available_features()).orderBy("ticker", "date")

    def get_latest_feature_date(self, ticker: str | None = None) -> datetime.date | None:
        rows = self.values.read()
        return (rows if ticker is None else rows.where(F.col("ticker") == ticker)).agg(F.max("date")).first()[0]

    def latest_dates(self) -> DataFrame:
        return self.values.read().groupBy("ticker").agg(F.max("date").alias("latest_date"))

    def get_available_features(self) -> list[str]:
        return [r[0] for r in self.values.read().select("feature_name").distinct().orderBy("feature_name").collect()]

    def get_feature_coverage(self) -> dict:
        row = coverage(self.values.read()).first().asDict()
        return row | {k: None if row[k] is None else str(row[k]) for k in ("earliest_date", "latest_date")}
