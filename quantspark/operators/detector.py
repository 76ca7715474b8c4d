"""Regime detection: rolling PCA, a clustering method, and one summary row.

PCA is causal.  The clusterer is fitted on the whole history of components, and Viterbi and smoothing look ahead within it, so
labels describe the past; ``detect_live`` scores a new row with fitted models only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from .analysis import characterize, transitions
from .clustering import GaussianHMM, HMMRegimes, KMeansRegimes, argmax
from .pca import RollingPCA, transform_with

METHODS = ("hmm", "kmeans", "ensemble")


@dataclass(frozen=True)
class RegimeResult:
    """``labels``: date, regime, proba; ``summary``: one row; ``stats``: a row per regime; ``changes``: transitions."""

    labels: DataFrame
    summary: DataFrame
    stats: DataFrame
    changes: DataFrame
    components: DataFrame

    def to_json(self) -> DataFrame:
        names = F.transform("proba", lambda p, i: F.struct(F.concat(F.lit("regime_"), i.cast("string")).alias("k"), p.alias("v")))
        return self.labels.select(F.to_json(F.struct("date", "regime", F.map_from_entries(names).alias("probabilities"))).alias("json"))


class RegimeDetector:
    def __init__(self, method: str = "ensemble", n_regimes: int = 4, pca: RollingPCA | None = None, n_init: int = 10, seed: int = 42) -> None:
        if method not in METHODS:
            raise InvalidInput(f"no method {method!r}")
        self.method, self.pca = method, pca or RollingPCA()
        self.hmm, self.kmeans = HMMRegimes(n_regimes, seed=seed), KMeansRegimes(n_regimes, n_init, seed)
        self._models: DataFrame | None = None
        self._hmm_models: DataFrame | None = None
        self._features: list[str] = []

    def _labels(self, components: DataFrame) -> DataFrame:
        if self.method != "kmeans":
            markov = self.hmm.detect(components).select("date", "regime", "proba")
            self._hmm_models = self.hmm.models(components)
            if self.method == "hmm":
                return markov
        means = self.kmeans.fit(components).predict(components).select("date", "regime", "proba")
        if self.method == "kmeans":
            return means
        both = markov.select("date", F.col("proba").alias("a")).join(means.select("date", F.col("proba").alias("b")), "date")
        both = both.withColumn("proba", F.zip_with("a", "b", lambda x, y: (x + y) / 2))
        return both.select("date", argmax(F.col("proba")).alias("regime"), "proba")

    def detect(self, matrix: DataFrame, features: Sequence[str]) -> RegimeResult:
        self.pca.check(matrix, features)
        self._features = list(features)
        components = self.pca.fit_transform(matrix, features).cache()
        if not components.limit(1).count():
            raise InvalidInput("PCA gave no components")
        self._models = self.pca.models(matrix, features)
        width = min(self.pca.n, len(self._features))
        labels = self._labels(components.withColumn("pc", F.slice("pc", 1, width))).cache()
        changes = transitions(labels)
        last = labels.orderBy(F.desc("date")).limit(1)
        summary = last.select(
            F.col("date").alias("as_of"),
            F.col("regime").alias("current_regime"),
            F.array_max("proba").alias("current_confidence"),
            (1 - F.get("proba", F.col("regime"))).alias("transition_probability"),
        )
        return RegimeResult(labels, summary, characterize(labels, matrix, features), changes, components)

    def detect_live(self, rows: DataFrame) -> DataFrame:
        """``rows`` with pc, regime, proba and confidence from the fitted models; not for the ensemble."""
        if self.method == "ensemble":
            raise InvalidInput("the ensemble needs a batch")
        if self._models is None:
            raise InvalidInput("detect comes before detect_live")
        scored = transform_with(self._models, rows, self._features)
        if self.method == "kmeans":
            scored = self.kmeans.predict(scored).drop("distance")
        else:
            row = self._hmm_models.first()  # the parameters of one model
            model = GaussianHMM(len(row["start"]))
            model.means, model.covs = np.array(row["means"]), np.array(row["covs"])
            model.start, model.trans = np.log(np.array(row["start"])), np.log(np.array(row["transitions"]))
            from pyspark.sql.functions import pandas_udf

            @pandas_udf("array<double>")
            def posterior(pc):  # noqa: ANN001, ANN202
                import pandas as pd

                return pd.Series([model.posteriors(np.array([x], float))[0].tolist() for x in pc])

            scored = scored.withColumn("proba", posterior("pc")).withColumn("regime", argmax(F.col("proba")))
        return scored.withColumn("confidence", F.array_max("proba"))


def volatility_rule(index: DataFrame, n: int = 4) -> DataFrame:
    """date, regime: quartiles of the index's 21-day volatility, a rule that needs no model."""
    from .macro import macro

    vol = macro(index).select("date", "spy_vol_21d").where("spy_vol_21d IS NOT NULL")
    return vol.select("date", (F.ntile(n).over(Window.orderBy("spy_vol_21d", "date")) - 1).alias("regime"))
