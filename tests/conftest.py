import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def walk(n, ticker="AAA", seed=42, start="2020-01-01", price=100.0):
    """A random walk of bars as rows."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    close = price * np.exp(np.cumsum(rng.normal(0.0005, 0.02, n)))
    open_ = np.concatenate([[price], close[:-1]])
    high, low = np.maximum(open_, close) * (1 + rng.random(n) / 100), np.minimum(open_, close) * (1 - rng.random(n) / 100)
    dates = pd.bdate_range(start, periods=n).date
    return pd.DataFrame({"ticker": ticker, "date": dates, "open": open_, "high": high, "low": low, "close": close, "volume": np.floor(rng.normal(1e6, 2e5, n)), "adj_close": close})


@pytest.fixture(scope="session")
def panel_rows():
    import pandas as pd

    return pd.concat([walk(360, t, 42 + i) for i, t in enumerate(("AAA", "BBB", "CCC", "DDD", "SPY"))])
