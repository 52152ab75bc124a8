"""Bars for the tests."""


def random_walk(n, seed=42, symbol="WALK", freq="D"):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * (1 + rng.normal(0, 0.005, n))
    high = np.maximum(open_, close) * (1 + rng.uniform(0.0005, 0.01, n))
    low = np.minimum(open_, close) * (1 - rng.uniform(0.0005, 0.01, n))
    return pd.DataFrame(
        {
            "Date": pd.date_range("1990-01-01", periods=n, freq=freq),
            "Open": open_,
            "High": high,
            "Low": low,
            "Close": close,
            "Volume": rng.integers(1_000, 100_000, n).astype(float),
            "Symbol": symbol,
        }
    )


def daily(spark, pdf):
    from pyspark.sql import functions as F

    return spark.createDataFrame(pdf).withColumn("Date", F.to_date("Date"))
