"""Rows of fits and of whole series are dealt to tasks of bounded, even size."""

from pyspark.sql import functions as F

from tidemark.operators import models, series
from tidemark.operators.indicators import add_indicators, sma
from tidemark.operators.models import create, in_whole_rounds


def held(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()


def test_a_fit_reads_its_rows_in_whole_rounds(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    for n in (9000, 500, 500, 40, 40, 40, 40, 40, 40):
        spark.range(0, n, 1, 1).write.mode("append").parquet(path)
    monkeypatch.setattr(models, "FIT_ROWS", 1000)
    out = in_whole_rounds(spark.read.parquet(path))
    sizes = held(out)
    assert len(sizes) == 16 and sum(sizes) == 10240 and max(sizes) < 1000
    few = spark.read.parquet(path).where("id < 200").coalesce(3)
    assert in_whole_rounds(few) is few


def test_a_forest_keeps_where_its_rows_are():
    assert create("random_forest", 3)[0].getCacheNodeIds()
    assert not create("random_forest", 3, cacheNodeIds=False)[0].getCacheNodeIds()


def test_whole_series_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(series, "TASK_ROWS", 500)
    bars = spark.range(0, 12000, 1, 3).select(
        (F.col("id") % 60).cast("string").alias("Symbol"),
        F.when(F.col("id") % 60 < 30, "train").otherwise("test").alias("split"),
        F.date_add(F.lit("2020-01-01"), (F.col("id") / 60).cast("int")).alias("Date"),
        F.col("id").cast("double").alias("Close"),
    )
    out = add_indicators(series.deal(bars, 12000), [sma(5)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    sizes = held(out)
    assert len(sizes) == 24 and sum(sizes) == 12000
    assert out.withColumn("t", F.spark_partition_id()).groupBy("Symbol").agg(F.count_distinct("t").alias("n")).where("n > 1").isEmpty()
    assert series.deal(bars, 4000) is bars  # one round holds them
