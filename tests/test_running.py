"""All indicators come from one pass over sorted rows: no window with a sliding frame, whatever the batches."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from bar_data import daily, random_walk
from pyspark.sql import functions as F

from tidemark.functions.ewm import exponential_mean
from tidemark.operators.indicators import add_indicators
from tidemark.operators.running import Between, Over, _statistics, _whole_series, add_running
from tidemark.plans.features import FeatureConfig


def test_one_window_and_one_pass_for_all_features(spark, tmp_path, walk):
    daily(spark, walk).write.parquet(str(tmp_path / "bars"))
    df = add_indicators(spark.read.parquet(str(tmp_path / "bars")), FeatureConfig().indicators())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Window") == 1 and plan.count("MapInArrow") == 1 and "specifiedwindowframe(RowFrame, -19" not in plan


def test_series_over_several_batches_meet_whole():
    rows = pd.DataFrame({"row": [0, 1, 0, 1, 2, 3, 4, 0]})
    cuts = [rows[0:1], rows[1:4], rows[4:5], rows[5:7], rows[7:7], rows[7:8]]
    parts = list(_whole_series([pa.RecordBatch.from_pandas(c, preserve_index=False) for c in cuts], "row"))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [0, 1, 2, 3, 4], [0]]
    assert not list(_whole_series([], "row"))
    torn = pa.RecordBatch.from_pydict({"row": [0, 1, 3], "x": [1.0, 2.0, 3.0]})
    with pytest.raises(ValueError, match="in order"):
        _statistics(torn, "row", {"s": Over("sum", "x")})


def test_batches_of_any_size_give_the_same(spark):
    bars = daily(spark, pd.concat([random_walk(300, s, f"S{s}") for s in range(4)]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        small = add_indicators(bars, FeatureConfig().indicators()).orderBy("Symbol", "Date").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(small, add_indicators(bars, FeatureConfig().indicators()).orderBy("Symbol", "Date").toPandas())


def test_statistics_of_missing_equal_and_infinite_values():
    x = pa.array([1.0, 1.0, 1.0, None, float("nan"), 2.0, float("inf"), 3.0, 0.1, 0.1, 0.1])
    part = pa.RecordBatch.from_arrays([x, pa.array([0, 1, 2, 3, 4, 5, 6, 0, 1, 2, 3])], names=["x", "row"])
    wanted = {
        "dev": Over("stddev_samp", "x", 3), "low": Over("min", "x", 2), "high": Over("max", "x", 2), "__sum": Over("sum", "x"),
        "same": Between(("x", "__sum")), "none": Between(("x", "x", "low", "low")),
    }
    got = {k: [v if ok else None for v, ok in zip(a.tolist(), held)] for k, (a, held) in _statistics(part, "row", wanted).items()}
    assert got["dev"][2] == 0.0 and got["dev"][10] == 0.0 and got["dev"][:2] == [None, None] and got["dev"][3] is None
    assert got["low"][5] == 2.0 and np.isnan(got["high"][5]) and got["high"][6] == float("inf") and got["low"][4] is None
    assert got["__sum"][:4] == [1.0, 2.0, 3.0, 3.0] and got["__sum"][7:9] == [3.0, 3.1]
    assert got["same"][1] == -1.0 and got["none"] == [None] * 11


def test_a_mean_over_long_gaps_and_after_other_series():
    rng = np.random.default_rng(3)
    given = rng.random(5000) < 0.3
    x = np.where(given, rng.normal(size=5000), np.nan)
    at = np.concatenate([np.arange(1000), np.arange(4000)])
    mean, held = exponential_mean(x, given, at, 0.1, 5)
    want = pd.Series(x).groupby(np.repeat([0, 1], [1000, 4000])).transform(lambda s: s.ewm(alpha=0.1, adjust=False, min_periods=5).mean())
    np.testing.assert_allclose(np.where(held, mean, np.nan), want, rtol=1e-12, atol=1e-12)


def test_helpers_end_with_the_pass(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 5), ("a", 1, 2.0, None)], "k string, row int, __x double, n int").coalesce(1)
    out = add_running(df, "row", {"__s": Over("sum", "__x"), "d": Between(("__s", "__x")), "t": Over("sum", "n")})
    assert out.dtypes == [("k", "string"), ("row", "int"), ("n", "int"), ("d", "double"), ("t", "double")]
    assert [tuple(r) for r in out.orderBy(F.col("row")).collect()] == [("a", 0, 5, 0.0, 5.0), ("a", 1, None, 1.0, 5.0)]


def test_recipes_need_no_session():
    code = "import __spark_entry__ as e; assert 'feature_table' in e.queries()"
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
