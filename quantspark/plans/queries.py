"""The catalogue of queries: a key per operator or group of operators, (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import by_date, ret
from ..operators import analysis, metrics, portfolio, quality, report, validators, walkforward
from ..operators.clustering import KMeansRegimes, argmax, distances, inverse_distance_share, relabel_map, transition_matrix
from ..operators.costs import MODELS
from ..operators.cross_sectional import cross_sectional
from ..operators.detector import RegimeDetector, volatility_rule
from ..operators.macro import macro
from ..operators.pca import MarketPCA, RollingPCA, market_returns
from ..operators.signals import STRATEGIES
from ..operators.technical import technical
from ..operators.volatility import volatility
from ..sources import panel, store, tables, universe
from ..sources.ingest import todo
from ..streaming import features as streams
from .pipeline import ALL_FEATURES, feature_frame
from .registry import FeatureRegistry

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6

TECHNICAL_GROUPS = {
    "returns": ("returns_1d", "returns_5d", "returns_21d", "returns_63d"),
    "rsi": ("rsi_14", "rsi_28"),
    "macd": ("macd_signal", "macd_histogram"),
    "momentum": ("momentum_12_1",),
    "mean_reversion": ("mean_reversion_5d", "mean_reversion_21d"),
    "bollinger_z": ("bollinger_upper_dist", "bollinger_lower_dist", "z_score_21d"),
    "sma_ratios": ("sma_ratio_5_21", "sma_ratio_21_63", "price_to_sma_50", "price_to_sma_200"),
    "ema_ratio": ("ema_ratio_12_26",),
    "crosses": ("golden_cross", "death_cross"),
    "volume_ratios": ("volume_ratio_5d", "volume_ratio_21d"),
    "obv_slope": ("obv_slope_14d",),
    "vwap_distance": ("vwap_distance",),
}
VOLATILITY_GROUPS = {
    "realized_vol": ("realized_vol_5d", "realized_vol_21d", "realized_vol_63d", "vol_ratio_5_21", "vol_ratio_5_63", "vol_of_vol_21d"),
    "range_vol": ("garman_klass_vol_21d", "parkinson_vol_21d", "high_low_range_ratio"),
    "vol_regime": ("vol_regime_z_score",),
}
SECTION_GROUPS = {
    "xs_ranks": ("rank_returns_21d", "rank_returns_63d"),
    "xs_sector": ("sector_relative_return_21d", "sector_relative_return_63d", "sector_momentum_21d"),
    "xs_breadth_dispersion": ("market_breadth", "dispersion_21d"),
}
REGIME_FEATURES = ("returns_21d", "z_score_21d", "volume_ratio_21d", "realized_vol_21d", "parkinson_vol_21d", "rsi_14")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that engines which add in another order agree; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _select(features: Callable[[DataFrame], DataFrame], names: tuple[str, ...], ticker: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features(panel.bars(spark, sf_dir, ticker)).select("ticker", "date", *names))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.bars(spark, sf_dir), 9)


def market_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel.market_panel(spark, sf_dir), 9)


def macro_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    each, index = panel.bars_and_index(spark, sf_dir)
    return rounded(macro(index, cross_sectional(each).select("date", "dispersion_21d")))


def features_49_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stored(spark, sf_dir))


def features_49(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feature_frame(*panel.bars_and_index(spark, sf_dir)))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature store's rows: all features of all bars."""
    return store.to_long(feature_frame(*panel.bars_and_index(spark, sf_dir)))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(store.to_wide(_stored(spark, sf_dir), list(ALL_FEATURES)))


def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.coverage(_stored(spark, sf_dir))


def latest_feature_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).groupBy("ticker").agg(F.max("date").alias("latest_date"))


def available_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).select("feature_name").distinct()


def feature_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = FeatureRegistry.standard()
    return registry.to_frame(spark).withColumn("max_lookback", F.lit(registry.max_lookback())).drop("description")


def registry_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of the registry, from its table."""
    parts = F.sort_array(F.collect_list(F.struct("feature_name", F.concat_ws(":", "feature_name", "version", "lookback_days").alias("p"))))
    frame = FeatureRegistry.standard().to_frame(spark)
    return frame.agg(F.substring(F.sha2(F.array_join(F.transform(parts, lambda x: x["p"]), "|"), 256), 1, 16).alias("version_hash"))


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of every order and part: last write wins."""
    lines = panel.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice")
    return tables.latest(lines, ["l_orderkey", "l_partkey"], "l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice")


def quality_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with every third day's high and low exchanged, so that the check has something to find."""
    all_bars = panel.bars(spark, sf_dir)
    broken = F.dayofmonth("date") % 3 == 0
    mixed = all_bars.withColumns({"high": F.when(broken, F.col("low")).otherwise(F.col("high")), "low": F.when(broken, F.col("high")).otherwise(F.col("low"))})
    return quality.inconsistent(mixed)


def quality_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_sessions(panel.bars(spark, sf_dir))


def quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.outliers(panel.bars(spark, sf_dir)))


def quality_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.suspected_splits(panel.bars(spark, sf_dir)))


def quality_zero_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = panel.bars(spark, sf_dir).withColumn("volume", F.when(F.col("volume") > 20, F.col("volume")).otherwise(F.lit(0.0)))
    return quality.zero_volume(quiet)


def quality_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = panel.bars(spark, sf_dir).withColumn("close", F.floor(F.col("close") / 1000))
    return quality.stale_runs(coarse, 3)


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(panel.bars(spark, sf_dir))


def ingest_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations still to be fetched when those with an even key are done."""
    nations = panel.read(spark, sf_dir, "nation")
    return todo(nations.select(F.col("n_name").alias("ticker")), nations.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("ticker")))


def universe_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.sectors(universe.from_nations(spark, sf_dir))


def universe_sector_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.sector_tickers(universe.from_nations(spark, sf_dir), "ASIA")


def _index_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns of the index."""
    return panel.index_bars(spark, sf_dir).select("date", ret("adj_close", 1, by_date()).alias("r")).where("r IS NOT NULL")


def metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.compute_all(_index_returns(spark, sf_dir)))


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.drawdowns(_index_returns(spark, sf_dir)))


def rolling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.rolling_metrics(_index_returns(spark, sf_dir))
    # compounded to a year the largest are in the billions, where engines agree in about fifteen digits
    coarse = F.when(F.abs("rolling_return") >= 1000, F.round("rolling_return", -3)).otherwise(F.col("rolling_return"))
    return rounded(found.withColumn("rolling_return", coarse), 5)


def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.monthly_returns(_index_returns(spark, sf_dir)))


def monthly_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.monthly_matrix(_index_returns(spark, sf_dir)))


def regime_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = volatility_rule(panel.index_bars(spark, sf_dir))
    return rounded(metrics.regime_metrics(_index_returns(spark, sf_dir), labels), 5)


def _market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    market = panel.market_panel(spark, sf_dir)
    return market, walkforward.windows(market)


def walk_forward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _market(spark, sf_dir)[1]


def _signals(strategy: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    market, bounds = _market(spark, sf_dir)
    return rounded(walkforward.signals(market, STRATEGIES[strategy], bounds))


def trade_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of every line item as a trade under the three models."""
    lines = panel.read(spark, sf_dir, "lineitem")
    trades = lines.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity") / 17).alias("price"), (F.col("l_partkey") % 500).cast("double").alias("volume"))
    made = []
    for name, model in MODELS.items():
        made.append(trades.select("l_orderkey", "l_linenumber", F.lit(name).alias("model"), *(c.alias(k) for k, c in model.columns(F.col("shares"), F.col("price"), F.col("volume")).items())))
    return rounded(made[0].unionByName(made[1]).unionByName(made[2]))


def execution_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    market, bounds = _market(spark, sf_dir)
    rows = walkforward.execution_schedule(market, walkforward.signals(market, STRATEGIES["MeanReversion"], bounds), bounds)
    return rounded(rows.where("trades AND weight IS NOT NULL").drop("trades", "run_id"), 9)


def _backtests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results of every strategy under realistic costs, and of one without costs; window bounds.

    The fold's result, a row per day and trade, is read several times and therefore kept.
    """
    market = panel.market_panel(spark, sf_dir).persist()
    bounds = walkforward.windows(market).persist()
    runs = dict(STRATEGIES) | {"SPY zero": STRATEGIES["SPY"]}
    schedule = walkforward.execution_schedule(market, walkforward.all_signals(market, runs, bounds), bounds)
    cost = F.when(F.col("run_id") == "SPY zero", "zero").otherwise("realistic")
    return portfolio.simulate(schedule.withColumn("cost_model", cost)).persist(), bounds


def backtest_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.equity_curve(_backtests(spark, sf_dir)[0]), 4)


def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.trade_log(_backtests(spark, sf_dir)[0]), 4)


def backtest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, bounds = _backtests(spark, sf_dir)
    return rounded(portfolio.window_results(result, bounds))


def backtest_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.exposure(portfolio.equity_curve(_backtests(spark, sf_dir)[0])))


def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.compute_all(portfolio.returns_of(portfolio.equity_curve(_backtests(spark, sf_dir)[0])), "run_id"))


def backtest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, bounds = _backtests(spark, sf_dir)
    equity, trades = portfolio.equity_curve(result), portfolio.trade_log(result)
    found = metrics.compute_all(portfolio.returns_of(equity), "run_id")
    return rounded(validators.validate(portfolio.window_results(result, bounds), equity, trades, found))


def strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.compute_all(portfolio.returns_of(portfolio.equity_curve(_backtests(spark, sf_dir)[0])), "run_id")
    return rounded(report.comparison(found, list(STRATEGIES)))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility_rule(panel.index_bars(spark, sf_dir))


def regime_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.transitions(_labels(spark, sf_dir))


def regime_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.runs(_labels(spark, sf_dir))


def regime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.characterize(_labels(spark, sf_dir), returns=_index_returns(spark, sf_dir)))


def regime_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.performance(_labels(spark, sf_dir), _index_returns(spark, sf_dir)))


def regime_dominant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = macro(panel.index_bars(spark, sf_dir))
    return rounded(analysis.dominant_features(_labels(spark, sf_dir), market, ("spy_returns_5d", "spy_returns_21d", "spy_vol_21d", "spy_drawdown"), 3))


def regime_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.timeline(panel.index_bars(spark, sf_dir), _labels(spark, sf_dir)))


#: Fixed centers for the query of distances and pseudo-probabilities.
CENTERS = [[-0.02, 0.2], [0.0, 0.1], [0.02, 0.3]]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = macro(panel.index_bars(spark, sf_dir)).where("spy_vol_21d IS NOT NULL AND spy_returns_21d IS NOT NULL")
    return market.select("date", F.array("spy_returns_21d", "spy_vol_21d").alias("pc"))


def kmeans_distance_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).withColumn("d", distances(F.col("pc"), CENTERS))
    rows = rows.withColumn("p", inverse_distance_share(F.col("d"))).withColumn("regime", argmax(F.col("p")))
    numbers = [F.get(x, F.lit(i)).alias(f"{x}{i}") for x in ("d", "p") for i in range(len(CENTERS))]
    return rounded(rows.select("date", "regime", *numbers))


def regime_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labels by day of the week, ordered by the mean of the first component."""
    raw = _points(spark, sf_dir).withColumn("raw", (F.dayofweek("date") - 1).cast("int"))
    return relabel_map(raw, 7)


def _regime_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = panel.index_bars(spark, sf_dir)
    return volatility(technical(index)).select("date", *REGIME_FEATURES)


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RollingPCA(n_components=3).fit_transform(_regime_matrix(spark, sf_dir), REGIME_FEATURES)


def rolling_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = [F.get("pc", F.lit(i)).alias(f"pc{i + 1}") for i in range(3)]
    return rounded(_components(spark, sf_dir).select("date", "refit", *numbers, "total_explained"), 4)


def pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(RollingPCA(n_components=3).loadings(_regime_matrix(spark, sf_dir), REGIME_FEATURES), 4)


def market_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_bars = panel.bars(spark, sf_dir)
    names = sorted(r[0] for r in panel.read(spark, sf_dir, "nation").select("n_name").collect())
    return rounded(MarketPCA(n_components=2).exposures(market_returns(all_bars, names), names), 4)


def kmeans_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = _components(spark, sf_dir).cache()
    return KMeansRegimes(4).fit(components).predict(components).select("date", "regime")


def _detector(method: str) -> RegimeDetector:
    return RegimeDetector(method, 3, RollingPCA(n_components=3))


def hmm_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _detector("hmm").detect(_regime_matrix(spark, sf_dir), REGIME_FEATURES)
    return result.labels.select("date", "regime")


def hmm_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.clustering import HMMRegimes

    return rounded(transition_matrix(HMMRegimes(3).models(_components(spark, sf_dir))), 4)


def regime_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_detector("ensemble").detect(_regime_matrix(spark, sf_dir), REGIME_FEATURES).summary, 4)


def regime_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = _regime_matrix(spark, sf_dir).na.drop()
    detector = _detector("kmeans")
    detector.detect(matrix, REGIME_FEATURES)
    latest = matrix.orderBy(F.desc("date")).limit(5)
    return rounded(detector.detect_live(latest).select("date", "regime", "confidence"), 4)


def regime_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.scatter(_components(spark, sf_dir), _labels(spark, sf_dir)), 4)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(streams.event_windows(panel.read(spark, sf_dir, "events")))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(streams.user_sessions(panel.read(spark, sf_dir, "events")), 4)


QUERIES: dict[str, Query] = {"bars": bars, "market_panel": market_panel}
QUERIES |= {k: partial(_select, technical, v, "n_name") for k, v in TECHNICAL_GROUPS.items()}
QUERIES |= {k: partial(_select, volatility, v, "n_name") for k, v in VOLATILITY_GROUPS.items()}
QUERIES |= {k: partial(_select, cross_sectional, v, "n_name") for k, v in SECTION_GROUPS.items()}
QUERIES |= {"xs_volume_rank": partial(_select, cross_sectional, ("rank_volume_ratio",), "n_name")}
QUERIES |= {f"signals_{k.lower().replace('-', '_').replace('/', '_')}": partial(_signals, k) for k in STRATEGIES}
QUERIES |= {
    f.__name__: f
    for f in (
        macro_features, features_49, features_49_long, feature_matrix, feature_coverage, latest_feature_date, available_features,
        feature_registry, registry_hash, upsert_latest, quality_ohlc, quality_missing, quality_outliers, quality_splits,
        quality_zero_volume, quality_stale, quality_report, ingest_resume, universe_sectors, universe_sector_tickers, metrics_all,
        drawdown, rolling_metrics, monthly_returns, monthly_matrix, regime_metrics, walk_forward_windows, trade_costs,
        execution_schedule, backtest_equity, backtest_trades, backtest_windows, backtest_exposure, backtest_metrics,
        backtest_validation, strategy_comparison, regime_transitions, regime_runs, regime_stats, regime_performance,
        regime_dominant_features, regime_timeline, kmeans_distance_proba, regime_relabel, rolling_pca, pca_loadings, market_pca,
        kmeans_regimes, hmm_regimes, hmm_transition_matrix, regime_detect, regime_live, regime_scatter, event_windows,
        event_sessions,
    )
}
