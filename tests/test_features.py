import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantspark.errors import InvalidInput
from quantspark.functions.windows import ewm_block, pct_rank, with_ewm
from quantspark.operators.cross_sectional import cross_sectional, with_sectors
from quantspark.operators.macro import macro
from quantspark.operators.technical import technical
from quantspark.plans.pipeline import ALL_FEATURES, feature_frame
from quantspark.plans.registry import FeatureRegistry, FeatureSpec, SingleTickerComputer

from .conftest import walk


@pytest.mark.parametrize("alpha", [0.5, 0.2, 1 / 14, 1 / 28])
def test_ewm_equals_pandas_over_block_borders_and_gaps(spark, alpha):
    n = 2 * ewm_block(1 - alpha) + 300
    x = np.random.default_rng(1).normal(10, 2, n)
    x[[0, 1, 50, n - 40]] = np.nan
    rows = pd.DataFrame({"ticker": "A", "date": np.arange(n), "x": x})
    df = spark.createDataFrame(rows).withColumn("x", F.nanvl("x", F.lit(None)))
    got = with_ewm(df, {"y": ("x", alpha, 5)}).orderBy("date").toPandas()["y"]
    want = rows["x"].ewm(alpha=alpha, min_periods=5).mean()
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(), rtol=1e-9, equal_nan=True)


def test_percent_rank_averages_ties(spark):
    x = [3.0, 1.0, 3.0, None, 2.0]
    got = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "d int, i int, x double").withColumn("p", pct_rank("x", "d")).orderBy("i").toPandas()["p"]
    np.testing.assert_allclose(got, pd.Series(x, dtype=float).rank(pct=True), equal_nan=True)


def test_technical_against_pandas(spark):
    rows = walk(300)
    got = technical(spark.createDataFrame(rows)).orderBy("date").toPandas()
    c, delta = rows["adj_close"], rows["adj_close"].diff()
    gain, loss = delta.clip(lower=0), (-delta).clip(lower=0)
    rs = gain.ewm(alpha=1 / 14, min_periods=14).mean() / loss.ewm(alpha=1 / 14, min_periods=14).mean()
    rsi = 100 - 100 / (1 + rs)
    rsi[:14] = np.nan
    obv = (np.sign(delta) * rows["volume"]).cumsum()
    slope = obv.rolling(14).apply(lambda v: np.polyfit(np.arange(14), v, 1)[0])
    wanted = {"returns_21d": c.pct_change(21), "rsi_14": rsi, "z_score_21d": (c - c.rolling(21).mean()) / c.rolling(21).std(), "obv_slope_14d": slope}
    for name, series in wanted.items():
        np.testing.assert_allclose(got[name].to_numpy(float), series.to_numpy(), rtol=1e-6, equal_nan=True, err_msg=name)
    first = {"macd_signal": 33, "ema_ratio_12_26": 25, "obv_slope_14d": 14, "rsi_14": 14, "price_to_sma_200": 199, "returns_1d": 1}
    for name, at in first.items():
        assert got[name].first_valid_index() == at, name


def test_no_feature_looks_ahead(spark, panel_rows):
    """The most important test: cutting the future off changes nothing before the cut."""
    whole = spark.createDataFrame(panel_rows)
    cut = panel_rows["date"].iloc[330]

    def frame(bars):
        stocks = with_sectors(bars.where("ticker <> 'SPY'"), spark.createDataFrame([("AAA", "x"), ("BBB", "x")], "ticker string, sector string"))
        return feature_frame(stocks, bars.where("ticker = 'SPY'")).where(F.col("date") <= F.lit(cut)).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)

    long, short = frame(whole), frame(whole.where(F.col("date") <= F.lit(cut)))
    assert list(long.columns) == ["ticker", "date", *ALL_FEATURES] and len(ALL_FEATURES) == 49
    pd.testing.assert_frame_equal(long, short, check_exact=False, rtol=1e-9)
    assert not np.isinf(long[list(ALL_FEATURES)].astype(float)).any().any()
    ranks = long["rank_returns_21d"].dropna()
    assert ranks.between(0, 1).all() and long["rsi_14"].dropna().between(0, 100).all() and (long["spy_drawdown"].dropna() <= 0).all()
    sums = long.groupby(["date"])["sector_relative_return_21d"].sum()
    assert abs(sums).max() < 1e-9


def test_constant_price_and_empty_panel(spark):
    rows = walk(60)
    for column in ("open", "high", "low", "close", "adj_close"):
        rows[column] = 100.0
    got = technical(spark.createDataFrame(rows)).orderBy("date").toPandas()
    assert got["z_score_21d"].isna().all() and (got["rsi_14"].dropna() == 100).all()
    assert technical(spark.createDataFrame(rows).limit(0)).count() == 0


def test_inputs_are_checked(spark):
    with pytest.raises(InvalidInput):
        technical(spark.createDataFrame([("A", 1.0)], "ticker string, adj_close double"))
    with pytest.raises(InvalidInput):
        cross_sectional(spark.createDataFrame(walk(30)))


def test_a_new_ticker_leaves_the_past_alone(spark, panel_rows):
    bars = spark.createDataFrame(panel_rows).withColumn("sector", F.lit("s"))
    late = bars.where(f"ticker <> 'DDD' OR date >= '{panel_rows['date'].iloc[200]}'")
    pick = lambda df: sorted(map(str, cross_sectional(df).where(f"date < '{panel_rows['date'].iloc[200]}'").collect()))
    assert pick(late) == pick(bars.where("ticker <> 'DDD'").unionByName(late.where("ticker = 'DDD'")))


def test_macro_without_dispersion(spark):
    got = macro(spark.createDataFrame(walk(250, "SPY"))).toPandas()
    assert got["market_return_dispersion"].isna().all() and got["spy_above_200sma"].notna().sum() == 51


def test_registry_and_user_features(spark):
    registry = FeatureRegistry.standard()
    assert len(registry.list_features()) == 49 and registry.max_lookback() == 315 and FeatureRegistry().max_lookback() == 0
    before = registry.version_hash()

    class Doubled(SingleTickerComputer):
        category, required_columns = "own", ("ticker", "date", "close")

        def specs(self):
            return [FeatureSpec("doubled", "own", 0)]

        def compute(self, bars):
            return bars.select("ticker", "date", (F.col("close") * 2).alias("doubled"))

    computer = Doubled(registry)
    assert registry.get("doubled").category == "own" and registry.version_hash() != before and len(before) == 16
    assert computer(spark.createDataFrame(walk(3))).columns == ["ticker", "date", "doubled"]
    with pytest.raises(KeyError):
        registry.get("nothing")
