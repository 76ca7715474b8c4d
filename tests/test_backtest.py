import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantspark.operators import metrics, portfolio, report, validators, walkforward
from quantspark.operators.costs import HIGH, MODELS, REALISTIC, ZERO
from quantspark.operators.signals import STRATEGIES, BuyAndHold, FixedMix, Momentum

from .conftest import walk

PLAN = walkforward.WalkForward(train_days=100, test_days=40, step_days=40)


@pytest.fixture(scope="module")
def market(spark):
    rows = pd.concat([walk(300, t, 7 + i) for i, t in enumerate(("AAA", "BBB", "CCC", "SPY", "TLT"))])
    return spark.createDataFrame(rows).cache()


@pytest.fixture(scope="module")
def result(spark, market):
    bounds = walkforward.windows(market, PLAN)
    rows = walkforward.execution_schedule(market, walkforward.all_signals(market, STRATEGIES, bounds), bounds, PLAN)
    return portfolio.simulate(rows.withColumn("cost_model", F.lit("realistic")), PLAN).cache(), bounds


def test_windows(market, spark):
    got = walkforward.windows(market, PLAN).orderBy("window_idx").collect()
    assert len(got) == 5 and all(w["train_end"] < w["test_start"] for w in got)
    assert walkforward.windows(market.where("ticker = 'AAA'").limit(50), PLAN).count() == 0


def test_costs_agree_row_by_row(spark):
    rows = [(s, p, v) for s in (0.0, 10.0, -500.0) for p in (0.0, 5.0, 20.0, 80.0) for v in (0.0, 1000.0)]
    df = spark.createDataFrame(rows, "s double, p double, v double")
    for model in MODELS.values():
        got = df.select("s", "p", "v", *(c.alias(k) for k, c in model.columns(F.col("s"), F.col("p"), F.col("v")).items())).collect()
        for r in got:
            np.testing.assert_allclose([r["commission"], r["spread_cost"], r["market_impact"]], model.one(r["s"], r["p"], r["v"]))
    assert sum(ZERO.one(10, 10, 10)) == 0 and HIGH.one(10, 60, 1e6)[1] == pytest.approx(2 * REALISTIC.one(10, 60, 1e6)[1])


def test_strategies(market):
    bounds = walkforward.windows(market, PLAN)
    train = walkforward.training_rows(market.select("ticker", "date", "adj_close"), bounds).cache()
    for strategy in STRATEGIES.values():
        sums = strategy.fit(train).groupBy("window_idx").agg(F.sum("weight").alias("w")).collect()
        assert len(sums) == 5 and all(abs(r["w"] - 1) < 1e-12 for r in sums), strategy.name
    assert [r["ticker"] for r in BuyAndHold(2).fit(train).where("window_idx = 0").orderBy("ticker").collect()] == ["AAA", "BBB"]
    pdf = train.where("window_idx = 1").toPandas().sort_values("date")
    scores = {t: g["adj_close"].iloc[-21] / g["adj_close"].iloc[0] - 1 for t, g in pdf.groupby("ticker")}
    best = max(scores, key=scores.get)
    assert Momentum(top_n=1).fit(train).where("window_idx = 1").first()["ticker"] == best
    assert FixedMix("none", {"XXX": 1.0}).fit(train).count() == 0


def test_fold_against_a_plain_simulation(market, result):
    """Cash and shares of the one-asset run, without any of the fold's code."""
    rows = result[0].where("run_id = 'SPY' AND kind = 'equity'").orderBy("date").toPandas()
    bars = market.where("ticker = 'SPY'").toPandas().set_index("date")
    cash, shares, values = 1e6, 0.0, []
    for (_, day), (_, before) in zip(rows.iterrows(), [(None, None), *rows.iterrows()], strict=False):
        price, volume = bars.loc[day["date"], "open"], bars.loc[day["date"], "volume"]
        total = cash + shares * price
        if before is not None and before["window_idx"] == day["window_idx"]:
            move = 1.0 - shares * price / total
            if move > 0 and min(move * total, cash * 0.999) >= 1:
                n = min(move * total, cash * 0.999) / price
                cost = lambda n: n * 0.005 + n * price * (r := 0.0002 if price > 50 else 0.0005) + n * price * r * math.sqrt(n / (volume * 0.01))  # noqa: E731, B023
                if n * price + cost(n) > cash:
                    n = cash * 0.99 / (price + cost(n) / max(n, 1))
                if n >= 0.01:
                    cash, shares = cash - n * price - cost(n), shares + n
        values.append(cash + shares * price)
    np.testing.assert_allclose(rows["portfolio_value"], values, rtol=1e-9)


def test_runs_and_reports(result):
    rows, bounds = result
    equity, trades = portfolio.equity_curve(rows, PLAN), portfolio.trade_log(rows)
    assert equity.groupBy("run_id").count().where("count <> 200").count() == 0 and equity.where("cash < -1e-6").count() == 0
    found = metrics.compute_all(portfolio.returns_of(equity), "run_id").cache()
    windows = portfolio.window_results(rows, bounds, PLAN)
    checks = validators.validate(windows, equity, trades, found)
    assert checks.count() == 25 and checks.where("name = 'signal_timing' AND NOT passed").count() == 0
    assert validators.verdicts(checks).count() == 5
    assert report.comparison(found, list(STRATEGIES)).count() == 9 and "Sharpe" in report.comparison_text(found, list(STRATEGIES))
    text = report.text_summary("SPY", windows, found, trades, checks)
    assert "window 0" in text and "signal_timing" in text
    assert portfolio.exposure(equity).where("gross_exposure > 1.0001").count() == 0


def test_validators_trip(spark):
    day = pd.Timestamp("2024-01-01").date()
    runs = spark.createDataFrame([("r",)], "run_id string")
    windows = spark.createDataFrame([("r", i, day, day, 0.5 + 0.01 * (i % 2) if i < 3 else 0.001 * i) for i in range(6)], "run_id string, window_idx int, train_end date, test_start date, window_return double")
    trades = spark.createDataFrame([("r", day, 1e9)], "run_id string, date date, gross_value double")
    equity = spark.createDataFrame([("r", 1e6)] * 60, "run_id string, portfolio_value double")
    bad = spark.createDataFrame([("r", 9.0, 3.0, 0.0)], "run_id string, sharpe_ratio double, annualized_return double, max_drawdown double")
    for check in (validators.signal_timing(runs, windows, trades), validators.turnover(runs, equity, trades), validators.window_consistency(runs, windows), validators.data_snooping(runs, windows), validators.return_plausibility(runs, bad, equity)):
        assert not check.first()["passed"], check.first()


def test_metrics_against_pandas(spark):
    r = pd.Series(np.random.default_rng(3).normal(0.0005, 0.01, 400), index=pd.bdate_range("2022-01-03", periods=400))
    rows = pd.DataFrame({"date": r.index.date, "r": r.to_numpy()})
    got = metrics.compute_all(spark.createDataFrame(rows)).first()
    grown = (1 + r).cumprod()
    drawdown = grown / grown.cummax() - 1
    wanted = {
        "total_return": grown.iloc[-1] - 1, "annualized_return": grown.iloc[-1] ** (252 / 400) - 1, "annualized_volatility": r.std() * 252**0.5,
        "max_drawdown": drawdown.min(), "var_95": r.quantile(0.05), "cvar_95": r[r <= r.quantile(0.05)].mean(), "skewness": r.skew(),
        "kurtosis": r.kurtosis(), "win_rate": (r > 0).mean(), "profit_factor": r[r > 0].sum() / -r[r < 0].sum(), "n_days": 400,
        "pct_positive_months": (r.resample("ME").apply(lambda x: (1 + x).prod() - 1) > 0).mean(),
        "sortino_ratio": (grown.iloc[-1] ** (252 / 400) - 1.04) / (r[r < 0.04 / 252].std() * 252**0.5),
    }
    for name, value in wanted.items():
        assert got[name] == pytest.approx(value, rel=1e-9), name
    always = metrics.compute_all(spark.createDataFrame(rows.assign(r=np.abs(rows["r"]) + 0.01))).first()
    assert math.isinf(always["profit_factor"]) and always["sortino_ratio"] == 0 and always["max_drawdown_duration_days"] == 0
    assert metrics.compute_all(spark.createDataFrame(rows).withColumn("k", F.lit(1)).limit(0), "k").count() == 0
