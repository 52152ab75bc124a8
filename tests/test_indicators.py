import numpy as np
import pandas as pd
import pytest
from bar_data import daily, random_walk
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators.indicators import add_indicators
from tidemark.operators.targets import classification_target, forward_returns, regression_targets
from tidemark.plans.features import FeatureConfig, build_features, feature_table

CONFIG = FeatureConfig()


def ewm(x, n, **kw):
    return x.ewm(adjust=False, min_periods=n, **kw).mean()


def expected(p):
    """All default features with pandas, one series."""
    c, h, lo, v = p.Close, p.High, p.Low, p.Volume
    out = {f"sma_{n}": c.rolling(n).mean() for n in (20, 50)}
    out |= {f"ema_{n}": ewm(c, n, span=n) for n in (20, 50)}
    out |= {f"price_vs_sma{n}": c / c.rolling(n).mean() - 1 for n in (20, 50)}
    out["macd"] = ewm(c, 12, span=12) - ewm(c, 26, span=26)
    out["macd_signal"] = ewm(out["macd"], 9, span=9)
    out["macd_hist"] = out["macd"] - out["macd_signal"]
    d = c.diff()
    gain, loss = ewm(d.clip(lower=0), 14, alpha=1 / 14), ewm(-d.clip(upper=0), 14, alpha=1 / 14)
    out["rsi_14"] = 100 - 100 / (1 + gain / loss)
    ll, hh = lo.rolling(14).min(), h.rolling(14).max()
    out["stoch_k"] = 100 * (c - ll) / (hh - ll)
    out["stoch_d"] = out["stoch_k"].rolling(3).mean()
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    out["atr_14"] = ewm(tr, 14, alpha=1 / 14)
    out["atr_ratio"] = out["atr_14"] / c
    mid, dev = c.rolling(20).mean(), c.rolling(20).std()
    out |= {"bb_upper": mid + 2 * dev, "bb_middle": mid, "bb_lower": mid - 2 * dev}
    out["bb_bandwidth"] = 4 * dev / mid
    out["bb_pct_b"] = (c - mid + 2 * dev) / (4 * dev)
    out |= {f"volatility_{n}d": c.pct_change().rolling(n).std() for n in (10, 20)}
    out["volume_sma_20"] = v.rolling(20).mean()
    out["volume_ratio"] = v / v.rolling(20).mean()
    out["obv"] = (np.sign(d).fillna(0) * v).cumsum()
    out |= {f"return_{n}d": c / c.shift(n) - 1 for n in (1, 5, 10, 20)}
    return pd.DataFrame(out)


def same(got, want, rtol=1e-9, atol=1e-9):
    for c in want.columns:
        np.testing.assert_allclose(
            got[c].to_numpy(float), want[c].to_numpy(float), rtol=rtol, atol=atol, err_msg=c
        )


def collected(df, *by):
    return df.orderBy(*by, "Date").toPandas()


def test_defaults_match_pandas(spark, walk):
    got = collected(add_indicators(daily(spark, walk), CONFIG.indicators()))
    same(got, expected(walk))
    assert list(got.columns[7:]) == CONFIG.columns() and len(CONFIG.columns()) == 28
    first = {c: got[c].first_valid_index() for c in got.columns}
    assert (first["sma_20"], first["macd"], first["macd_signal"]) == (19, 25, 33)
    assert (first["rsi_14"], first["atr_14"]) == (14, 13)
    ok = got.dropna()
    assert ok.rsi_14.between(0, 100).all() and ok.stoch_k.between(0, 100).all() and (ok.atr_14 > 0).all()
    assert (ok.bb_upper >= ok.bb_middle).all() and (ok.bb_middle >= ok.bb_lower).all()


def test_series_do_not_mix(spark):
    parts = [random_walk(80, s, f"S{s}") for s in range(3)]
    got = add_indicators(daily(spark, pd.concat(parts)), CONFIG.indicators())
    for p in parts:
        one = collected(got.where(F.col("Symbol") == p.Symbol[0]))
        same(one, expected(p))


def test_long_series_restarts_the_running_total(spark):
    """7,000 rows span three strides; one running total would overflow."""
    p = random_walk(7000)
    got = collected(add_indicators(daily(spark, p), CONFIG.indicators()))
    same(got, expected(p), rtol=1e-8, atol=1e-8)
    assert np.isfinite(got.macd_signal[33:]).all()


def test_spans_far_apart(spark):
    p = random_walk(3000)
    got = collected(add_indicators(daily(spark, p), [ind.ema(3), ind.ema(200), ind.ema(1)]))
    want = pd.DataFrame({f"ema_{n}": ewm(p.Close, n, span=n) for n in (3, 200, 1)})
    same(got, want)


def test_intraday_series_is_cut_into_blocks(spark):
    """A hot intraday series over many blocks equals the same series in one window."""
    hot = random_walk(9000, 1, "HOT", "min")
    cold = random_walk(300, 2, "COLD", "min")
    bars = spark.createDataFrame(pd.concat([hot, cold])).withColumn("Date", F.col("Date").cast("timestamp_ntz"))
    got = add_indicators(bars, CONFIG.indicators(), block_rows=2000)
    for p in (hot, cold):
        one = collected(got.where(F.col("Symbol") == p.Symbol[0]))
        assert len(one) == len(p)
        same(one, expected(p), rtol=1e-8, atol=1e-8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in plan
    targets = forward_returns(bars, (1, 5), block_rows=100)
    one = collected(targets.where("Symbol = 'HOT'"))
    want = pd.DataFrame({f"target_return_{h}d": hot.Close.shift(-h) / hot.Close - 1 for h in (1, 5)})
    same(one, want)


def test_one_exchange_for_all_features(spark, tmp_path, walk):
    daily(spark, walk).write.parquet(str(tmp_path / "bars"))
    df = add_indicators(spark.read.parquet(str(tmp_path / "bars")), CONFIG.indicators())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("+- Sort") <= 2


def test_warmup_and_targets(spark, walk):
    bars = daily(spark, walk)
    feats = build_features(bars)
    assert feats.count() == 101
    labelled = classification_target(feats)
    assert labelled.count() == 100
    assert {r[0] for r in labelled.select("target_classification").distinct().collect()} <= {0, 1, 2}
    assert regression_targets(labelled).count() == 99
    table = feature_table(bars)
    assert table.count() == 99 and table.columns[-5:] == CONFIG.target_columns()


@pytest.mark.parametrize("fwd,label", [(0.5, 2), (-0.5, 0), (0.49, 1), (-0.49, 1)])
def test_label_bounds_are_inclusive(spark, fwd, label):
    rows = [("A", "2020-01-01", 100.0), ("A", "2020-01-02", 100.0 * (1 + fwd))]
    df = spark.createDataFrame(rows, "Symbol string, Date string, Close double").withColumn("Date", F.to_date("Date"))
    assert classification_target(df, 1, 0.5, -0.5).head()["target_classification"] == label


def test_flat_prices(spark):
    p = random_walk(60)
    for c in ("Open", "High", "Low", "Close"):
        p[c] = 10.0
    got = collected(add_indicators(daily(spark, p), CONFIG.indicators()))
    assert got.rsi_14.iloc[-1] == 100.0 and got.stoch_k.isna().all() and got.bb_pct_b.isna().all()
    assert build_features(daily(spark, p)).count() == 0


def test_groups_can_be_switched_off(spark, walk):
    config = FeatureConfig(groups=("trend", "returns"), macd=None)
    assert config.columns() == [
        "sma_20", "sma_50", "ema_20", "ema_50", "price_vs_sma20", "price_vs_sma50",
        "return_1d", "return_5d", "return_10d", "return_20d",
    ]
    assert build_features(daily(spark, walk), config).count() == 101
    assert config.digest() != CONFIG.digest() and len(CONFIG.digest()) == 12


def gappy(n, seed=5, freq="D", symbol="GAPS"):
    """A walk with gaps at the start, alone, in runs and over thousands of rows, each column its own."""
    p = random_walk(n, seed, symbol, freq)
    rng = np.random.default_rng(seed)
    for c, share in (("Close", 0.2), ("High", 0.05), ("Low", 0.05)):
        p.loc[rng.random(n) < share, c] = np.nan
        for at in rng.integers(0, n, 5):
            p.loc[at : at + rng.integers(2, 40), c] = np.nan
    p.loc[:6, ["Close", "High"]] = np.nan
    return p


EWM = ["ema_20", "ema_50", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14", "atr_ratio"]


def missing(spark, p):
    """NaN is NULL here."""
    nums = ["Open", "High", "Low", "Close", "Volume"]
    df = spark.createDataFrame(p)
    return df.select("Date", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in nums], "Symbol")


@pytest.mark.parametrize("n,hole", [(400, None), (9000, (1000, 8000)), (9000, (0, 8500))])
def test_exponential_means_over_gaps(spark, n, hole):
    """As pandas has it, also where whole strides hold no value."""
    p = gappy(n)
    if hole:
        p.loc[hole[0] : hole[1], "Close"] = np.nan
    df = missing(spark, p).withColumn("Date", F.to_date("Date"))
    got = collected(add_indicators(df, [ind.ema(20), ind.ema(50), ind.macd(), ind.rsi(), ind.atr()]))
    want = expected(p)[EWM]
    assert want.notna().any().all() or hole
    same(got, want)


def test_exponential_means_over_gaps_in_blocks(spark):
    """Blocks reach back over gaps as far as it takes."""
    p = gappy(9000, 6, "min")
    p.loc[3000:6000, "Close"] = np.nan
    bars = missing(spark, p).withColumn("Date", F.col("Date").cast("timestamp_ntz"))
    got = collected(add_indicators(bars, [ind.ema(20), ind.macd(), ind.rsi(), ind.atr()], block_rows=1500))
    assert len(got) == len(p)
    same(got, expected(p)[[c for c in EWM if c != "ema_50"]], rtol=1e-8, atol=1e-8)
