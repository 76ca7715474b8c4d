import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantspark.errors import InvalidInput
from quantspark.operators import analysis
from quantspark.operators.clustering import GaussianHMM, HMMRegimes, KMeansRegimes, transition_matrix
from quantspark.operators.detector import RegimeDetector
from quantspark.operators.pca import MarketPCA, RollingPCA, transform_with

NAMES = [f"f{i}" for i in range(8)]


def matrix(n=300, shift=None, seed=42):
    rng = np.random.default_rng(seed)
    factors = np.stack([np.sin(np.arange(n) / 9), np.cos(np.arange(n) / 17), np.linspace(-1, 1, n)], axis=1)
    x = factors @ rng.normal(size=(3, len(NAMES))) + 0.1 * rng.normal(size=(n, len(NAMES)))
    if shift is not None:
        x[shift:] += 6
    out = pd.DataFrame(x, columns=NAMES)
    out.insert(0, "date", pd.bdate_range("2020-01-01", periods=n).date)
    return out


def test_pca_finds_the_factors_and_does_not_look_ahead(spark):
    pca, rows = RollingPCA(3, 100, 21), matrix()
    long = pca.fit_transform(spark.createDataFrame(rows), NAMES).orderBy("date").toPandas()
    assert len(long) == 200 and (long["total_explained"] > 0.9).all() and long["refit"].nunique() == 10
    short = pca.fit_transform(spark.createDataFrame(rows[:230]), NAMES).orderBy("date").toPandas()
    np.testing.assert_allclose(np.stack(long["pc"][:130]), np.stack(short["pc"]), atol=1e-9)
    window = rows[NAMES].to_numpy()[21:122]
    model = pca.models(spark.createDataFrame(rows), NAMES).where("refit = 1").first()
    np.testing.assert_allclose(model["mean"], window.mean(0))
    live = transform_with(pca.models(spark.createDataFrame(rows), NAMES), spark.createDataFrame(rows[-1:]), NAMES).first()
    np.testing.assert_allclose(live["pc"], long["pc"].iloc[-1], atol=1e-9)


def test_pca_guards(spark):
    with pytest.raises(InvalidInput):
        RollingPCA(3, 20)
    pca = RollingPCA(10, 100)
    with pytest.raises(InvalidInput):
        pca.check(spark.createDataFrame(matrix(80)), NAMES)
    assert pca.fit_transform(spark.createDataFrame(matrix(100)), NAMES).count() == 0
    padded = pca.fit_transform(spark.createDataFrame(matrix(101)), NAMES).first()
    assert padded["pc"][8:] == [None, None] and MarketPCA(2, 100).exposures(spark.createDataFrame(matrix(101)), NAMES).count() == 16


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(42)
    truth = np.repeat([0, 1, 0, 1], 100)
    x = rng.normal(0, 0.5, (400, 3)) + np.where(truth, 5, -5)[:, None]
    rows = pd.DataFrame({"date": pd.bdate_range("2020-01-01", periods=400).date, "pc": x.tolist()})
    return spark.createDataFrame(rows, "date date, pc array<double>").cache(), truth


def test_kmeans(separable):
    rows, truth = separable
    got = KMeansRegimes(2, 3).fit(rows).predict(rows).orderBy("date").toPandas()
    assert (got["regime"] == truth).mean() > 0.9
    np.testing.assert_allclose(np.stack(got["proba"]).sum(1), 1)
    with pytest.raises(InvalidInput):
        KMeansRegimes(5).fit(rows.limit(3))
    with pytest.raises(InvalidInput):
        KMeansRegimes(2).predict(rows)


def test_hmm(separable):
    rows, truth = separable
    hmm = HMMRegimes(2, seed=1)
    got = hmm.detect(rows).orderBy("date").toPandas()
    assert (got["regime"] == truth).mean() > 0.9
    np.testing.assert_allclose(np.stack(got["proba"]).sum(1), 1)
    p = transition_matrix(hmm.models(rows)).toPandas()
    np.testing.assert_allclose(p.groupby("from_regime")["p"].sum(), 1)
    x = np.array(rows.orderBy("date").toPandas()["pc"].tolist())
    assert (GaussianHMM(2).fit(x).viterbi(x) == GaussianHMM(2).fit(x).viterbi(x)).all()


@pytest.mark.parametrize("method", ["hmm", "kmeans", "ensemble"])
def test_detector(spark, method):
    rows = spark.createDataFrame(matrix(260, shift=180))
    detector = RegimeDetector(method, 2, RollingPCA(3, 100), n_init=2)
    result = detector.detect(rows, NAMES)
    summary = result.summary.first()
    assert 0.5 <= summary["current_confidence"] <= 1 + 1e-9 and 0 <= summary["transition_probability"] <= 1
    assert result.labels.count() == 160 and result.to_json().count() == 160
    if method == "ensemble":
        with pytest.raises(InvalidInput):
            detector.detect_live(rows)
    else:
        last = result.labels.orderBy(F.desc("date")).first()
        live = detector.detect_live(rows.orderBy(F.desc("date")).limit(1)).first()
        assert 0 <= live["regime"] < 2 and (method == "hmm" or live["regime"] == last["regime"])


def test_analysis(spark):
    days = pd.bdate_range("2024-01-01", periods=8).date
    labels = spark.createDataFrame(list(zip(days, [0, 0, 1, 1, 1, 0, 1, 1], strict=True)), "date date, regime int")
    assert [(r["from_regime"], r["to_regime"]) for r in analysis.transitions(labels).orderBy("date").collect()] == [(0, 1), (1, 0), (0, 1)]
    stats = {r["regime"]: r for r in analysis.characterize(labels).collect()}
    assert stats[1]["max_duration_days"] == 3 and stats[1]["avg_duration_days"] == 2.5 and stats[0]["suggested_label"] == "Crisis"
    returns = spark.createDataFrame([(d, 0.01 if i % 2 else 0.02) for i, d in enumerate(days)], "date date, r double")
    assert {r["suggested_label"] for r in analysis.characterize(labels, returns=returns).collect()} == {"Steady Bull"}
    assert analysis.performance(labels, returns).where("hit_rate = 1").count() == 2


def test_market_pca_of_many_tickers_matches_numpy(spark):
    """25 named columns with gaps: a condition on all of them below the fill took 2**25 forms in the planner."""
    rng, n, tickers = np.random.default_rng(3), 150, [f"T{i:02}" for i in range(25)]
    days = pd.bdate_range("2020-01-01", periods=n).date
    wide = pd.DataFrame(rng.normal(size=(n, 25)) @ rng.normal(size=(25, 25)), index=days, columns=tickers)
    wide = wide.mask(rng.random(wide.shape) < 0.1)
    wide.iloc[[60, 61]] = None
    rows = [(d, None if pd.isna(x) else float(x), t) for t in tickers for d, x in wide[t].items()]
    long = spark.createDataFrame(rows, "date date, r double, ticker string")
    returns = long.groupBy("date").pivot("ticker", tickers).agg(F.first("r"))
    full = wide.dropna(how="all").ffill().dropna()
    pca = MarketPCA(2, 100, 21)
    found = pca.exposures(returns, tickers).toPandas().pivot(index=["refit", "factor"], columns="ticker", values="exposure")
    refits = [at for at in range(100, len(full), 21)]
    assert len(found) == 2 * len(refits) > 2
    for g, at in enumerate(refits):
        x = full.to_numpy()[at - 100 : at + 1]
        v = np.linalg.svd((x - x.mean(0)) / x.std(0), full_matrices=False)[2][:2]
        np.testing.assert_allclose(np.abs(found.loc[g].to_numpy()), np.abs(v), atol=1e-7)
    assert pca.fit_transform(returns, tickers).count() == len(full) - 100
