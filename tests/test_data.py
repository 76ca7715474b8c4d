import datetime

import pytest
from pyspark.sql import functions as F

from quantspark.errors import InvalidInput, SourceFailure
from quantspark.operators import quality
from quantspark.plans.pipeline import FeaturePipeline
from quantspark.settings import Settings, get_settings, reset_settings
from quantspark.sources import universe
from quantspark.sources.ingest import BarStore, FrameProvider, Provider, ingest_historical, ingest_incremental
from quantspark.sources.store import FeatureStore, to_long, to_wide
from quantspark.sources.tables import verify
from quantspark.streaming.features import stream_bars, user_sessions

from .conftest import walk

START, END = datetime.date(2020, 1, 1), datetime.date(2021, 12, 31)


@pytest.fixture
def store(spark, tmp_path):
    out = BarStore(spark, str(tmp_path))
    out.create_schema()
    out.create_schema()
    return out


def test_bars_roundtrip_and_upsert(spark, store):
    bars = spark.createDataFrame(walk(20))
    assert store.upsert_bars(bars) == 20 and store.upsert_bars(bars) == 20 and store.get_data("AAA").count() == 20
    store.upsert_bars(bars.limit(1).withColumn("volume", F.lit(7.0)))
    assert store.get_data("AAA").where("volume = 7").count() == 1
    assert store.upsert_bars(bars.limit(0)) == 0
    assert store.get_latest_date("AAA") == walk(20)["date"].iloc[-1] and store.get_latest_date("ZZZ") is None
    assert store.get_summary() == {"tickers": 1, "total_bars": 20} and store.get_universe_data([]).count() == 0
    assert store.get_data("AAA", walk(20)["date"].iloc[3], walk(20)["date"].iloc[7]).count() == 5
    assert verify(store.tables).where("NOT present").count() == 0


def test_missing_table(spark, tmp_path):
    with pytest.raises(SourceFailure):
        BarStore(spark, str(tmp_path / "none")).get_summary()


def test_ingest_resumes_and_isolates_failures(spark, store, panel_rows):
    provider = FrameProvider(spark.createDataFrame(panel_rows))
    got = ingest_historical(["AAA", "NONE"], START, END, provider, store)
    assert (got["total"], got["succeeded"], got["failed"], got["skipped"]) == (2, 1, 1, 0)
    got = ingest_historical(["AAA", "BBB", "NONE"], START, END, provider, store, batch_size=1)
    assert (got["skipped"], got["succeeded"], got["failed"]) == (1, 1, 1)
    assert store.get_data("BBB").count() == 360 and store.tickers.read().count() == 2
    assert ingest_historical(["AAA"], START, END, provider, store)["skipped"] == 1


def test_ingest_incremental(spark, store):
    store.upsert_bars(spark.createDataFrame(walk(50)))
    provider = FrameProvider(spark.createDataFrame(walk(60)))
    got = ingest_incremental(["AAA", "NEW"], provider, store, END)
    assert got["succeeded"] == 1 and got["failed"] == 1 and store.get_data("AAA").count() == 60


def test_provider_repeats_and_gives_up(spark):
    class Flaky(Provider):
        calls = 0

        def _fetch(self, tickers, start, end):
            self.calls += 1
            if self.calls < 3:
                raise OSError("later")
            return spark.createDataFrame(walk(5))

    quick = Settings(retry_seconds=0.0, calls_per_second=1e9)
    assert Flaky(quick).fetch_historical("AAA", START, END).count() == 5
    with pytest.raises(SourceFailure):
        Flaky(Settings(retry_seconds=0.0, calls_per_second=1e9, max_retries=2)).fetch_bulk(["AAA"], START, END)


def test_settings(monkeypatch):
    monkeypatch.setenv("QUANTSPARK_BATCH_SIZE", "7")
    reset_settings()
    assert get_settings().batch_size == 7
    monkeypatch.setenv("QUANTSPARK_BATCH_SIZE", "x")
    reset_settings()
    with pytest.raises(InvalidInput):
        get_settings()
    monkeypatch.undo()
    reset_settings()


def test_quality_finds_each_kind(spark):
    rows = walk(60)
    rows.loc[20, "volume"] = 0
    rows.loc[30:36, "close"] = 100.0
    rows.loc[45:, "close"] = rows.loc[45:, "close"] * 0.3
    rows.loc[5, "high"] = 0.5
    rows = rows.drop(index=[10, 11])
    bars = spark.createDataFrame(rows)
    calendar = spark.createDataFrame(walk(60)[["date"]])
    report = quality.quality_report(bars, calendar).first()
    assert report["missing_days"] == 2 and report["zero_volume"] == 1 and report["stale_runs"] == 1
    assert report["splits"] >= 1 and report["outliers"] >= 1 and report["inconsistent"] >= 1 and not report["is_clean"]
    good, bad = quality.split_valid(bars)
    assert bad.count() >= 1 and good.count() + bad.count() == 58
    assert quality.quality_report(bars.limit(0)).count() == 0
    assert quality.quality_report(spark.createDataFrame(walk(1))).first()["is_clean"]


def test_feature_store(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    store.create_schema()
    wide = spark.createDataFrame([("A", datetime.date(2020, 1, d), float(d), None if d == 2 else 1.0) for d in (1, 2, 3)], "ticker string, date date, x double, y double")
    assert store.store_features(wide) == 5 and store.store_features(wide.withColumn("x", F.col("x") + 1)) == 5
    assert [r["value"] for r in store.get_features("A", ["x"]).collect()] == [2.0, 3.0, 4.0]
    assert store.get_available_features() == ["x", "y"] and store.get_latest_feature_date("A") == datetime.date(2020, 1, 3)
    assert store.get_latest_feature_date("B") is None and store.get_feature_matrix([]).count() == 0
    assert store.get_feature_matrix(["A"]).where("y IS NULL").count() == 1
    assert store.get_feature_coverage()["total_rows"] == 5
    assert sorted(map(str, to_wide(to_long(wide), ["x", "y"]).collect())) == sorted(map(str, wide.collect()))


def test_pipeline_runs_and_continues(spark, tmp_path, panel_rows):
    bars, features = BarStore(spark, str(tmp_path)), FeatureStore(spark, str(tmp_path))
    bars.create_schema()
    features.create_schema()
    bars.upsert_bars(spark.createDataFrame(panel_rows))
    days = sorted(panel_rows["date"].unique())
    pipeline = FeaturePipeline(bars, features)
    summary = pipeline.run(["AAA", "BBB", "NONE"], days[330], days[340])
    assert summary["tickers_processed"] == 2 and summary["tickers_failed"] == 1 and summary["feature_count"] == 49
    assert features.get_feature_coverage()["features"] == 49
    again = pipeline.run_incremental(["AAA", "BBB"], days[345])
    assert list(again) == [str(days[340] + datetime.timedelta(days=1))] and features.get_latest_feature_date("AAA") == days[345]
    assert pipeline.run_incremental(["AAA", "BBB"], days[345]) == {}


def test_universe(spark, sf):
    table = universe.from_nations(spark, sf)
    assert universe.sectors(table).count() == 5 and universe.tickers(table).count() == 25
    with pytest.raises(ValueError):
        universe.sector_tickers(table, "NOWHERE")


def test_streamed_bars(spark, store, tmp_path):
    source = str(tmp_path / "in")
    bars = spark.createDataFrame(walk(30))
    bars.write.parquet(source)
    query = stream_bars(spark.readStream.schema(bars.schema).parquet(source), store, str(tmp_path / "check"))
    query.awaitTermination()
    assert store.get_data("AAA").count() == 30


def test_sessions(spark):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 10, 50, 59)]
    events = spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["n"] for r in user_sessions(events).collect()) == [2, 2]


def test_an_upsert_that_dies_leaves_the_table(spark, store, monkeypatch):
    bars = spark.createDataFrame(walk(40))
    store.upsert_bars(bars)
    before = sorted(map(str, store.bars.read().collect()))

    def die(*_):
        raise OSError("lost")

    monkeypatch.setattr(store.bars, "_commit", die)
    with pytest.raises(SourceFailure) as found:
        store.upsert_bars(bars.withColumn("close", F.lit(1.0)))
    assert isinstance(found.value.__cause__, OSError) and sorted(map(str, store.bars.read().collect())) == before
    monkeypatch.undo()
    version = store.bars.versions()[-1]
    with pytest.raises(SourceFailure):  # another run was faster
        store.bars._commit(version, {})
    assert store.upsert_bars(bars.withColumn("close", F.lit(1.0))) == 40 and store.bars.read().where("close = 1").count() == 40
    used = {f.split("/")[0] for v in store.bars.versions() for folders in store.bars._manifest(v).values() for f in folders}
    assert set(store.bars._names("data")) == used and len(store.bars.versions()) == 2


def test_a_batch_touches_its_months_only(spark, store):
    store.upsert_bars(spark.createDataFrame(walk(60)))
    before = store.bars._current()[1]
    store.upsert_bars(spark.createDataFrame(walk(60)).where("date >= '2020-03-01'"))
    after = store.bars._current()[1]
    assert sorted(before) == sorted(after) == ["2020-01", "2020-02", "2020-03"]
    assert [m for m in after if after[m] == before[m]] == ["2020-01", "2020-02"] and store.bars.read().count() == 60
    assert store.bars.read(["2020-02"]).agg(F.min("date")).first()[0] == datetime.date(2020, 2, 3)
    for _ in range(40):
        store.log.append(spark.createDataFrame([("A", START, END, "success", 1, None, None)], store.log.schema))
    assert store.log.read().count() == 40 and len(store.log._current()[1][""]) < 40


def test_a_failing_ticker_fails_alone_and_is_logged(spark, store, panel_rows):
    class Picky(FrameProvider):
        def _fetch(self, tickers, start, end):
            if "BBB" in tickers:
                raise OSError("no BBB")
            return super()._fetch(tickers, start, end)

    provider = Picky(spark.createDataFrame(panel_rows), Settings(retry_seconds=0.0, calls_per_second=1e9, max_retries=1))
    got = ingest_historical(["AAA", "BBB", "CCC"], START, END, provider, store)
    assert (got["succeeded"], got["failed"]) == (2, 1)
    assert [(r["ticker"], r["status"], r["error"]) for r in store.log.read().where("status = 'failed'").collect()] == [("BBB", "failed", "no BBB")]
    store.upsert_bars(spark.createDataFrame(walk(10, "BBB")))
    later = ingest_incremental(["AAA", "BBB"], provider, store, END + datetime.timedelta(days=9))
    assert later["failed"] >= 1


def test_a_new_ticker_does_not_recompute_the_others(spark, tmp_path, panel_rows):
    bars, features = BarStore(spark, str(tmp_path)), FeatureStore(spark, str(tmp_path))
    bars.create_schema()
    features.create_schema()
    bars.upsert_bars(spark.createDataFrame(panel_rows))
    days = sorted(panel_rows["date"].unique())
    pipeline = FeaturePipeline(bars, features)
    pipeline.run(["AAA"], days[330], days[340])
    first = features.values.read().agg(F.max("computed_at")).first()[0]
    runs = pipeline.run_incremental(["AAA", "BBB"], days[342])
    assert len(runs) == 2
    stored = features.values.read().groupBy("ticker").agg(F.min("date").alias("low"), F.max("date").alias("high"))
    assert {r["ticker"]: (r["low"], r["high"]) for r in stored.collect()} == {"AAA": (days[330], days[342]), "BBB": (days[0], days[342])}
    assert features.values.read().where((F.col("ticker") == "AAA") & (F.col("date") <= F.lit(days[340])) & (F.col("computed_at") > F.lit(first))).count() == 0
