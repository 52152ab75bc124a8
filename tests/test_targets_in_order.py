"""Targets of the feature table come from rows as they lie, with the values of windows over them."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.running import add_ahead
from tidemark.operators.targets import classification_target, regression_targets
from tidemark.plans.features import FeatureConfig, build_features, feature_table

CONFIG = FeatureConfig(
    sma=(3,), ema=(3,), price_vs_sma=(3,), macd=None, stochastic=None, atr=None, bollinger=None, volatility=(3,), volume_sma=3,
    returns=(1, 2), buy=0.01, sell=-0.01, return_horizons=(2, 1, 4),
)


@pytest.fixture(scope="module")
def bars(spark):
    """Series of unlike length, one without a symbol, closes that are missing or zero, two splits."""
    i = F.col("id")
    day, of = (i / 9).cast("int"), i % 9
    close = F.when((i % 23 == 4) | (of == 7), None).when(i % 31 == 6, 0.0).otherwise(10 + (i * 37 % 101) / 10.0)
    return spark.range(0, 1500, 1, 5).where((of != 5) | (day < 4)).select(
        F.when(of != 3, F.concat(F.lit("S"), of.cast("string"))).alias("Symbol"),
        F.date_add(F.lit("2001-01-01"), day).alias("Date"),
        F.when(day < 90, "train").otherwise("test").alias("split"),
        close.alias("Open"), (close + 1).alias("High"), (close - 1).alias("Low"), close.alias("Close"), (i % 50 + 1.0).alias("Volume"),
    )


@pytest.mark.parametrize("batch", [10000, 7])
@pytest.mark.parametrize("horizon", [1, 3])
@pytest.mark.parametrize("drop", [True, False])
def test_the_values_of_windows(spark, bars, batch, horizon, drop):
    config = FeatureConfig(**{**CONFIG.__dict__, "label_horizon": horizon, "drop_warmup": drop})
    feats = build_features(bars, config).localCheckpoint()
    want = regression_targets(classification_target(feats, horizon, 0.01, -0.01), config.return_horizons)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = feature_table(bars, config)
        found = sorted(map(repr, got.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.dtypes == want.dtypes and len(found) > 300
    assert found == sorted(map(repr, want.collect()))


def test_one_exchange(bars):
    plan = feature_table(bars, CONFIG)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_rows_out_of_order_raise(spark):
    rows = spark.createDataFrame([("a", 2, 1.0), ("a", 1, 1.0)], "Symbol string, row int, Close double").coalesce(1)
    with pytest.raises(Exception, match="not together and in order"):
        add_ahead(rows, ["Symbol"], "row", "Close", 1, {}).collect()
