"""The chain as ML transformers: saved, loaded, and with a model behind it."""

import pandas as pd
import pytest
from bar_data import daily, random_walk
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.operators.indicators import sma
from tidemark.operators.split import assign_split
from tidemark.plans.bars import BarConfig
from tidemark.plans.features import FeatureConfig, feature_table
from tidemark.plans.stages import AddTargets, BuildFeatures, CleanBars, chain

BARS = BarConfig(train_end="1990-08-31", validation_end="1990-10-31", test_start=None)
FEATURES = FeatureConfig(sma=(5,), ema=(5,), price_vs_sma=(5,), macd=None, stochastic=None, volatility=(5,), returns=(1, 2), buy=0.01, sell=-0.01)


def raw(spark):
    walk = pd.concat([random_walk(400, seed=s, symbol=f"S{s}") for s in (1, 2)])
    bars = daily(spark, walk).withColumn("ingest_seq", F.monotonically_increasing_id())
    again = bars.where("dayofmonth(Date) = 7").withColumns({"Close": F.col("Close") * 2, "ingest_seq": F.col("ingest_seq") - 10**15})
    broken = F.when(F.dayofmonth("Date") == 13, None).otherwise(F.col("Open"))
    return bars.unionByName(again).withColumn("Open", broken)


def test_saved_and_loaded_chain_gives_the_same_rows(spark, tmp_path):
    df = raw(spark)
    names = FEATURES.columns()
    model = DecisionTreeClassifier(featuresCol="x", labelCol="target_classification", maxDepth=3, seed=1)
    fitted = Pipeline(stages=[*chain(BARS, FEATURES), VectorAssembler(inputCols=names, outputCol="x"), model]).fit(df)
    fitted.write().overwrite().save(str(tmp_path / "chain"))
    loaded = PipelineModel.load(str(tmp_path / "chain"))
    assert [type(s).__name__ for s in loaded.stages[:4]] == ["CleanBars", "SplitBars", "BuildFeatures", "AddTargets"]
    shown = ["Symbol", "Date", "split", *names, "target_label", "prediction"]
    rows = loaded.transform(df).select(*shown).orderBy("Symbol", "Date").collect()
    assert rows == fitted.transform(df).select(*shown).orderBy("Symbol", "Date").collect()

    plain = df.where("Open IS NOT NULL AND ingest_seq >= 0").drop("ingest_seq")
    want = feature_table(assign_split(plain, BARS.train_end, BARS.validation_end), FEATURES)
    assert [r[:-1] for r in rows] == [tuple(r) for r in want.select(*shown[:-1]).orderBy("Symbol", "Date").collect()]


def test_settings_come_back_as_they_were(spark, tmp_path):
    BuildFeatures.of(FEATURES).save(str(tmp_path / "f"))
    again = BuildFeatures.load(str(tmp_path / "f")).config()
    assert again == FEATURES and again.digest() == FEATURES.digest()
    assert [type(s) for s in chain(BARS, FEATURES, targets=False)][-1] is BuildFeatures
    assert CleanBars().setting() == {} and AddTargets().config() == FeatureConfig()
    with pytest.raises(ValueError):
        BuildFeatures.of(FeatureConfig(extra=(sma(3),)))


def test_an_empty_table_passes_through(spark):
    out = PipelineModel(chain(BARS, FEATURES)).transform(raw(spark).limit(0))
    assert out.count() == 0 and {"target_label", *FEATURES.columns()} <= set(out.columns)
