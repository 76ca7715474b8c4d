"""Regime models on principal components: k-means and a Gaussian hidden Markov model.

Labels are ordered by the mean of the first component, so regime 0 is the lowest in every fit; a state that no row has
comes last.  K-means is Spark ML's, the best of several seeds.  The Markov model is sequential in its rows; each series is
a group, and many series run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput


def relabel_map(labelled: DataFrame, n_regimes: int, label: str = "raw") -> DataFrame:
    """raw, regime: labels by rising mean of pc[0]; labels without rows follow in order."""
    spark = labelled.sparkSession
    means = labelled.groupBy(label).agg(F.avg(F.get("pc", F.lit(0))).alias("m"))
    every = spark.range(n_regimes).select(F.col("id").cast("int").alias(label)).join(means, label, "left")
    order = Window.orderBy(F.asc_nulls_last("m"), label)  # a row per regime
    return every.select(label, (F.row_number().over(order) - 1).alias("regime"))


def distances(pc: Column, centers: list[list[float]]) -> Column:
    """Array of Euclidean distances to the centers."""
    each = []
    for center in centers:
        here = F.array(*[F.lit(float(x)) for x in center])
        square = F.aggregate(F.zip_with(pc, here, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        each.append(F.sqrt(square))
    return F.array(*each)


def inverse_distance_share(dist: Column) -> Column:
    """Pseudo-probabilities: inverse distances scaled to sum to one."""
    inverse = F.transform(dist, lambda d: 1.0 / (d + 1e-10))
    total = F.aggregate(inverse, F.lit(0.0), lambda s, x: s + x)
    return F.transform(inverse, lambda x: x / total)


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


class KMeansRegimes:
    def __init__(self, n_regimes: int = 4, n_init: int = 10, seed: int = 42) -> None:
        self.n, self.n_init, self.seed = n_regimes, n_init, seed
        self.centers: list[list[float]] | None = None

    def fit(self, components: DataFrame) -> KMeansRegimes:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = components.select(array_to_vector("pc").alias("features"), "pc").cache()
        try:
            if rows.count() < self.n:
                raise InvalidInput(f"k-means needs a row for each of {self.n} regimes")
            models = [KMeans(k=self.n, seed=self.seed + i).fit(rows) for i in range(self.n_init)]
        finally:
            rows.unpersist()
        best = min(models, key=lambda m: m.summary.trainingCost)
        self.centers = sorted((c.tolist() for c in best.clusterCenters()), key=lambda c: c[0])
        return self

    def predict(self, components: DataFrame) -> DataFrame:
        """Adds distance (array), proba (array) and regime."""
        if self.centers is None:
            raise InvalidInput("fit comes before predict")
        out = components.withColumn("distance", distances(F.col("pc"), self.centers))
        nearest = (F.array_position("distance", F.array_min("distance")) - 1).cast("int")
        return out.withColumn("proba", inverse_distance_share(F.col("distance"))).withColumn("regime", nearest)


def _log_normal(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    root = np.linalg.cholesky(cov)
    z = np.linalg.solve(root, (x - mean).T)
    return -0.5 * (x.shape[1] * np.log(2 * np.pi) + (z * z).sum(axis=0)) - np.log(np.diag(root)).sum()


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class GaussianHMM:
    """Baum-Welch in log space with full covariances; k-means++ style seeding from a fixed generator."""

    def __init__(self, n: int, n_iter: int = 200, seed: int = 42, tol: float = 1e-3, ridge: float = 1e-3) -> None:
        self.n, self.n_iter, self.seed, self.tol, self.ridge = n, n_iter, seed, tol, ridge

    def _seed(self, x: np.ndarray) -> np.ndarray:
        rng, best, least = np.random.default_rng(self.seed), None, np.inf
        for _ in range(5):
            centers = x[[rng.integers(len(x))]]
            while len(centers) < self.n:
                d = ((x[:, None] - centers[None]) ** 2).sum(-1).min(1)
                centers = np.vstack([centers, x[rng.choice(len(x), p=d / d.sum() if d.sum() > 0 else None)]])
            for _ in range(30):
                label = ((x[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
                centers = np.stack([x[label == j].mean(0) if (label == j).any() else centers[j] for j in range(self.n)])
            cost = ((x - centers[label]) ** 2).sum()
            if cost < least:
                best, least = label, cost
        return best

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_log_normal(x, m, c) for m, c in zip(self.means, self.covs, strict=True)], axis=1)

    def _forward_backward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = self.start + e[0]
        for t in range(1, len(e)):
            a[t] = _lse(a[t - 1][:, None] + self.trans, 0) + e[t]
        for t in range(len(e) - 2, -1, -1):
            b[t] = _lse(self.trans + (e[t + 1] + b[t + 1])[None], 1)
        return a, b, float(_lse(a[-1], 0))

    def fit(self, x: np.ndarray) -> GaussianHMM:
        n, d = self.n, x.shape[1]
        hot = np.eye(n)[self._seed(x)]
        ridge = self.ridge * max(float(x.var()), 1e-9) * np.eye(d)
        self.start, self.trans = np.full(n, -np.log(n)), np.full((n, n), -np.log(n))
        last = -np.inf
        for step in range(self.n_iter + 1):
            mass = hot.sum(0) + 1e-10
            self.means = hot.T @ x / mass[:, None]
            self.covs = np.stack([((x - m).T * h) @ (x - m) / w for m, h, w in zip(self.means, hot.T, mass, strict=True)]) + ridge
            e = self._emissions(x)
            a, b, like = self._forward_backward(e)
            if step == self.n_iter or like - last < self.tol and step > 1:
                break
            last = like
            hot = np.exp(a + b - like)
            hot /= hot.sum(1, keepdims=True)
            pair = np.exp(a[:-1, :, None] + self.trans[None] + (e[1:] + b[1:])[:, None, :] - like).sum(0) + 1e-10
            self.trans, self.start = np.log(pair / pair.sum(1, keepdims=True)), np.log(hot[0] + 1e-10)
        # every state gets a place, so no probability column is ever lost
        label = self.viterbi(x)
        order = sorted(range(n), key=lambda j: (float(x[label == j, 0].mean()) if (label == j).any() else np.inf, j))
        self.means, self.covs = self.means[order], self.covs[order]
        self.start, self.trans = self.start[order], self.trans[np.ix_(order, order)]
        return self

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        e = self._emissions(x)
        back, best = np.zeros(e.shape, int), self.start + e[0]
        for t in range(1, len(e)):
            step = best[:, None] + self.trans
            back[t] = step.argmax(0)
            best = step.max(0) + e[t]
        path = [int(best.argmax())]
        for t in range(len(e) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return np.array(path[::-1])

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        a, b, like = self._forward_backward(self._emissions(x))
        p = np.exp(a + b - like)
        return p / p.sum(1, keepdims=True)


HMM_ROWS = "series string, date date, regime int, proba array<double>"
HMM_MODEL = "series string, means array<array<double>>, covs array<array<array<double>>>, start array<double>, transitions array<array<double>>"


class HMMRegimes:
    def __init__(self, n_regimes: int = 4, n_iter: int = 200, seed: int = 42) -> None:
        self.n, self.n_iter, self.seed = n_regimes, n_iter, seed

    def _fitted(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, GaussianHMM]:
        rows = rows.sort_values("date")
        x = np.array([[v for v in pc if v is not None] for pc in rows["pc"]], float)
        if len(x) < 2 * self.n:
            raise InvalidInput(f"a Markov model of {self.n} regimes needs two rows for each; there are {len(x)}")
        return rows, x, GaussianHMM(self.n, self.n_iter, self.seed).fit(x)

    def detect(self, components: DataFrame, series: str | None = None) -> DataFrame:
        """series, date, regime (Viterbi) and proba (smoothed posteriors); a model is fitted per series."""

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows, x, model = self._fitted(rows)
            return pd.DataFrame({"series": rows["series"], "date": rows["date"], "regime": model.viterbi(x), "proba": model.posteriors(x).tolist()})

        return self._series(components, series).groupBy("series").applyInPandas(run, HMM_ROWS)

    def models(self, components: DataFrame, series: str | None = None) -> DataFrame:
        """A row per series with the fitted parameters, start and transitions as probabilities."""

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows, _, m = self._fitted(rows)
            return pd.DataFrame([(rows["series"].iloc[0], m.means.tolist(), m.covs.tolist(), np.exp(m.start).tolist(), np.exp(m.trans).tolist())], columns=["series", "means", "covs", "start", "transitions"])

        return self._series(components, series).groupBy("series").applyInPandas(run, HMM_MODEL)

    @staticmethod
    def _series(components: DataFrame, series: str | None) -> DataFrame:
        return components.select((F.col(series) if series else F.lit("all")).alias("series"), "date", "pc")


def transition_matrix(models: DataFrame) -> DataFrame:
    """series, from_regime, to_regime, p: the data of a heat map."""
    rows = models.select("series", F.posexplode("transitions").alias("from_regime", "row"))
    return rows.select("series", "from_regime", F.posexplode("row").alias("to_regime", "p"))
