"""Rolling PCA: every refit is an independent group.

Rows are numbered after cleaning.  Refit g happens at row W + g F; it is trained on the W + 1 rows up to there and
transforms the F rows from there on, so values never depend on later rows.  The rows of a refit (W + F at most) go to one
group; refits run in parallel.  Signs are fixed: each component's largest loading is positive.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.windows import ffill
from ..settings import MIN_PCA_ROWS

COMPONENTS = "date date, refit int, pc array<double>, explained array<double>, total_explained double"
MODEL = "refit int, refit_date date, mean array<double>, scale array<double>, loadings array<array<double>>, explained array<double>"


def cleaned(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with a value, gaps filled from earlier rows, rows before every feature has begun dropped; ``i`` from 0.

    Rows without a value fill nothing, so they are dropped after the fill.  Below it a condition on all columns would meet
    the projection that names them, and the planner keeps it under each choice of old and new names: 2**features of them.
    """
    w = Window.orderBy("date")
    own = [f"_own{i}" for i in range(len(features))]
    rows = matrix.select("date", *(F.col(f).alias(o) for f, o in zip(features, own, strict=True)))
    filled = rows.select("date", *own, *(ffill(o, w).alias(f) for f, o in zip(features, own, strict=True)))
    some = filled.where(F.coalesce(*own).isNotNull()).select("date", *features)
    return some.na.drop("any", subset=list(features)).withColumn("i", F.row_number().over(w) - 1)


def fit(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, loadings, explained share) of standardised rows."""
    mean, scale = values.mean(axis=0), values.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    _, s, v = np.linalg.svd((values - mean) / scale, full_matrices=False)
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    power = s**2
    share = power / power.sum() if power.sum() > 0 else np.zeros_like(power)
    return mean, scale, v[:n], share[:n]


class RollingPCA:
    def __init__(self, n_components: int = 10, window_days: int = 252, refit_every: int = 21) -> None:
        if window_days + 1 < MIN_PCA_ROWS:
            raise InvalidInput(f"a window of {window_days} rows is too short, the least is {MIN_PCA_ROWS}")
        self.n, self.window, self.every = n_components, window_days, refit_every

    def _groups(self, matrix: DataFrame, features: Sequence[str]) -> DataFrame:
        """Rows of every refit: its training rows and the rows it transforms."""
        rows = cleaned(matrix, features)
        w, f = self.window, self.every
        # row i trains the refits g with W + gF - W <= i <= W + gF and is transformed by g = (i - W) div F
        low = F.greatest(F.ceil((F.col("i") - w) / f).cast("int"), F.lit(0))
        high = F.floor(F.col("i") / f).cast("int")
        refits = F.array_distinct(F.concat(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")), F.when(F.col("i") >= w, F.array(F.floor((F.col("i") - w) / f).cast("int"))).otherwise(F.array().cast("array<int>"))))
        # the rows are in one partition for their numbers; a window there spares a second scan for the last one
        spread = rows.withColumn("top", F.max("i").over(Window.partitionBy())).withColumn("refit", F.explode(refits))
        return spread.where(F.col("refit") * f + w <= F.col("top")).drop("top")

    def _run(self, features: Sequence[str], models: bool):
        n, w, f, names = self.n, self.window, self.every, list(features)

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("i")
            g = int(rows["refit"].iloc[0])
            at = w + g * f
            mean, scale, loadings, share = fit(rows[rows["i"] <= at][names].to_numpy(float), n)
            pad = [None] * (n - len(loadings))
            if models:
                when = rows.loc[rows["i"] == at, "date"].iloc[0]
                return pd.DataFrame([(g, when, mean.tolist(), scale.tolist(), [r.tolist() for r in loadings], share.tolist())], columns=[c.split()[0] for c in MODEL.split(", ")])
            own = rows[rows["i"] >= at]
            scores = (own[names].to_numpy(float) - mean) / scale @ loadings.T
            made = [(d, g, s.tolist() + pad, share.tolist() + pad, float(share.sum())) for d, s in zip(own["date"], scores, strict=True)]
            return pd.DataFrame(made, columns=["date", "refit", "pc", "explained", "total_explained"])

        return run

    def check(self, matrix: DataFrame, features: Sequence[str]) -> None:
        n = cleaned(matrix, features).count()
        if n < self.window:
            raise InvalidInput(f"{n} valid rows do not fill a window of {self.window}")

    def fit_transform(self, matrix: DataFrame, features: Sequence[str]) -> DataFrame:
        """date, refit, pc, explained, total_explained of every row from row ``window_days`` on."""
        return self._groups(matrix, features).groupBy("refit").applyInPandas(self._run(features, False), COMPONENTS)

    def models(self, matrix: DataFrame, features: Sequence[str]) -> DataFrame:
        """A row per refit: its date, scaler and loadings."""
        return self._groups(matrix, features).groupBy("refit").applyInPandas(self._run(features, True), MODEL)

    def loadings(self, matrix: DataFrame, features: Sequence[str]) -> DataFrame:
        """refit, refit_date, component, feature, loading."""
        rows = self.models(matrix, features).select("refit", "refit_date", F.posexplode("loadings").alias("component", "row"))
        names = F.array(*[F.lit(f) for f in features])
        flat = rows.select("refit", "refit_date", "component", F.posexplode("row").alias("j", "loading"))
        return flat.select("refit", "refit_date", (F.col("component") + 1).alias("component"), F.get(names, F.col("j")).alias("feature"), "loading")


def transform_with(model: DataFrame, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with pc under the latest model: a scaled dot product in columns, for live rows or a stream."""
    last = model.orderBy(F.desc("refit")).limit(1).select("mean", "scale", "loadings")
    values = F.array(*[F.col(f).cast("double") for f in features])
    scaled = F.zip_with(F.zip_with(values, "mean", lambda x, m: x - m), "scale", lambda x, s: x / s)
    dot = lambda row: F.aggregate(F.zip_with(row, "_z", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    joined = rows.crossJoin(F.broadcast(last)).withColumn("_z", scaled)  # one row
    return joined.withColumn("pc", F.transform("loadings", dot)).select(*rows.columns, "pc")


def market_returns(bars: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """date and a column of daily returns per ticker."""
    from ..functions.windows import ret

    daily = bars.select("ticker", "date", ret("adj_close", 1).alias("r"))
    return daily.groupBy("date").pivot("ticker", list(tickers)).agg(F.first("r"))


class MarketPCA(RollingPCA):
    """Factors of a returns matrix (dates by tickers); exposures are the loadings per refit."""

    def exposures(self, returns: DataFrame, tickers: Sequence[str]) -> DataFrame:
        return self.loadings(returns, tickers).withColumnsRenamed({"feature": "ticker", "component": "factor", "loading": "exposure"})
