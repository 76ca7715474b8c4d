"""Bars in the store: providers, resumable ingestion, incremental updates."""

from __future__ import annotations

import datetime
import time
from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput, SourceFailure
from ..operators.quality import quality_report, split_valid
from ..schema import BARS, INGESTION, QUALITY, TICKERS
from ..settings import Settings, get_settings
from .tables import KeyedTable


class Provider(ABC):
    """A source of bars.  Subclasses fetch; the base class paces calls, repeats failed ones and drops empty rows."""

    name = "provider"

    def __init__(self, settings: Settings | None = None) -> None:
        self.settings = settings or get_settings()
        self._next = 0.0

    @abstractmethod
    def _fetch(self, tickers: Sequence[str], start: datetime.date, end: datetime.date) -> DataFrame:
        """Bars of the tickers that exist, both dates included."""

    def health_check(self) -> bool:
        return True

    def fetch_bulk(self, tickers: Sequence[str], start: datetime.date, end: datetime.date) -> DataFrame:
        for attempt in range(self.settings.max_retries):
            time.sleep(max(0.0, self._next - time.monotonic()))
            self._next = time.monotonic() + 1 / self.settings.calls_per_second
            try:
                rows = self._fetch(tickers, start, end)
                return rows.na.drop("all", subset=["open", "high", "low", "close"])
            except Exception as e:
                if attempt + 1 == self.settings.max_retries:
                    raise SourceFailure(f"the provider {self.name} failed {attempt + 1} times") from e
                time.sleep(self.settings.retry_seconds * 2**attempt)
        raise InvalidInput("max_retries allows no attempt")

    def fetch_historical(self, ticker: str, start: datetime.date, end: datetime.date) -> DataFrame:
        return self.fetch_bulk([ticker], start, end)


class FrameProvider(Provider):
    """Serves bars from a DataFrame, such as a Parquet table."""

    name = "frame"

    def __init__(self, bars: DataFrame, settings: Settings | None = None) -> None:
        super().__init__(settings or Settings(calls_per_second=1e9, retry_seconds=0.0))
        self.bars = bars

    def _fetch(self, tickers: Sequence[str], start: datetime.date, end: datetime.date) -> DataFrame:
        return self.bars.where(F.col("ticker").isin(list(tickers)) & F.col("date").between(F.lit(start), F.lit(end)))


#: Bars lie in a partition per month: a day's batch touches one, a query of some dates reads those months only.
MONTH = "date_format(date, 'yyyy-MM')"


class BarStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.bars = KeyedTable(spark, root, "ohlcv", BARS, ["ticker", "date"], MONTH)
        self.quality = KeyedTable(spark, root, "data_quality", QUALITY, ["ticker", "start_date", "end_date"])
        self.tickers = KeyedTable(spark, root, "ticker_metadata", TICKERS, ["ticker"])
        self.log = KeyedTable(spark, root, "ingestion_log", INGESTION, ["ticker", "start_date", "end_date", "logged_at"])
        self.tables = [self.bars, self.quality, self.tickers, self.log]

    def create_schema(self) -> None:
        for table in self.tables:
            table.create()

    def upsert_bars(self, bars: DataFrame) -> int:
        return self.bars.upsert(bars)

    def get_universe_data(self, tickers: Sequence[str], start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
        low, high = start.strftime("%Y-%m") if start else "", end.strftime("%Y-%m") if end else "~"
        rows = self.bars.read([m for m in self.bars.partitions() if low <= m <= high])
        rows = rows.where(F.col("ticker").isin(list(tickers)) if tickers else F.lit(False))
        if start is not None:
            rows = rows.where(F.col("date") >= F.lit(start))
        return rows if end is None else rows.where(F.col("date") <= F.lit(end))

    def get_data(self, ticker: str, start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
        return self.get_universe_data([ticker], start, end).orderBy("date")

    def get_latest_date(self, ticker: str) -> datetime.date | None:
        return self.get_universe_data([ticker]).agg(F.max("date")).first()[0]

    def get_summary(self) -> dict:
        return self.bars.read().agg(F.countDistinct("ticker").alias("tickers"), F.count("*").alias("total_bars")).first().asDict()

    def log_ingestion(self, rows: DataFrame) -> None:
        self.log.append(rows.withColumn("logged_at", F.current_timestamp()))

    def completed(self, start: datetime.date, end: datetime.date) -> DataFrame:
        """Tickers that a run over the same dates has finished with success."""
        done = self.log.read().where((F.col("status") == "success") & (F.col("start_date") == F.lit(start)) & (F.col("end_date") == F.lit(end)))
        return done.select("ticker").distinct()

    def store_quality_reports(self, report: DataFrame) -> int:
        issues = " + ".join(c for c in report.columns if c not in ("ticker", "start_date", "end_date", "total_bars", "is_clean"))
        rows = report.withColumn("n_issues", F.expr(issues).cast("long")).withColumn("reported_at", F.current_timestamp())
        return self.quality.upsert(rows, "reported_at")

    def tickers_with_issues(self) -> DataFrame:
        return self.quality.read().where("NOT is_clean").select("ticker").distinct().orderBy("ticker")

    def update_metadata(self, rows: DataFrame) -> int:
        return self.tickers.upsert(rows.withColumn("updated_at", F.current_timestamp()), "updated_at")


def todo(requested: DataFrame, completed: DataFrame) -> DataFrame:
    return requested.join(completed, "ticker", "left_anti")


def _store_batch(store: BarStore, provider: Provider, batch: list[str], start: datetime.date, end: datetime.date) -> tuple[int, int, int, int]:
    """(succeeded, failed, clean, dirty) of one batch of tickers."""
    spark = store.spark
    fetched = provider.fetch_bulk(batch, start, end).select(*(c.split()[0] for c in BARS.split(", ")))
    good, _ = split_valid(fetched)
    report = quality_report(good)
    got = {r["ticker"]: (r["total_bars"], r["is_clean"]) for r in report.select("ticker", "total_bars", "is_clean").collect()}
    if got:
        store.upsert_bars(good)
        store.store_quality_reports(report)
        spans = good.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("total_bars"))
        store.update_metadata(spans.withColumn("sector", F.lit(None).cast("string")).withColumn("provider", F.lit(provider.name)))
    rows = [(t, start, end, "success" if t in got else "failed", got.get(t, (0,))[0], None if t in got else "no data") for t in batch]
    store.log_ingestion(spark.createDataFrame(rows, LOGGED))
    clean = sum(flag for _, flag in got.values())
    return len(got), len(batch) - len(got), clean, len(got) - clean


LOGGED = "ticker string, start_date date, end_date date, status string, n_rows long, error string"


def _store_alone(store: BarStore, provider: Provider, batch: list[str], start: datetime.date, end: datetime.date) -> tuple[int, int, int, int]:
    """As :func:`_store_batch`; where the provider fails, each ticker is tried alone, and one that fails is logged and counted."""
    try:
        return _store_batch(store, provider, batch, start, end)
    except SourceFailure as e:
        if len(batch) > 1:
            each = [_store_alone(store, provider, [t], start, end) for t in batch]
            return tuple(map(sum, zip(*each, strict=True)))  # type: ignore[return-value]
        store.log_ingestion(store.spark.createDataFrame([(batch[0], start, end, "failed", 0, str(e.__cause__ or e)[:500])], LOGGED))
        return 0, 1, 0, 0


def ingest_historical(tickers: Sequence[str], start: datetime.date, end: datetime.date, provider: Provider, store: BarStore, batch_size: int | None = None) -> dict[str, int]:
    """Fetch, check and store bars; tickers that an earlier run finished are skipped, a failing ticker fails alone."""
    if start > end:
        raise InvalidInput(f"the first date {start} is after the last, {end}")
    spark = store.spark
    requested = spark.createDataFrame([(t,) for t in dict.fromkeys(tickers)], "ticker string")
    left = [r[0] for r in todo(requested, store.completed(start, end)).orderBy("ticker").collect()]
    total = len(dict.fromkeys(tickers))
    out = dict.fromkeys(("succeeded", "failed", "clean_tickers", "dirty_tickers"), 0)
    size = batch_size or provider.settings.batch_size
    for at in range(0, len(left), size):
        batch = left[at : at + size]
        found = _store_alone(store, provider, batch, start, end)
        out = {k: v + n for (k, v), n in zip(out.items(), found, strict=True)}
    return {"total": total, "skipped": total - len(left)} | out


def ingest_incremental(tickers: Sequence[str], provider: Provider, store: BarStore, until: datetime.date | None = None) -> dict[str, int]:
    """Continue every ticker from the day after its last bar; a ticker without any bar fails, and each fails alone."""
    until = until or datetime.date.today()
    last = {r["ticker"]: r["d"] for r in store.get_universe_data(list(tickers)).groupBy("ticker").agg(F.max("date").alias("d")).collect()}
    out = {"total": len(tickers), "succeeded": 0, "failed": 0, "skipped": 0}
    by_start: dict[datetime.date, list[str]] = {}
    for ticker in tickers:
        if ticker not in last:
            out["failed"] += 1
        elif last[ticker] >= until:
            out["skipped"] += 1
        else:
            by_start.setdefault(last[ticker] + datetime.timedelta(days=1), []).append(ticker)
    for start, batch in by_start.items():
        good, bad, _, _ = _store_alone(store, provider, batch, start, until)
        out["succeeded"] += good
        out["failed"] += bad
    return out
