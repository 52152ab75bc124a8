"""Profiles merged from the parts of loads."""

from pyspark.sql import functions as F

from tidemark.operators import kept_profile as kp
from tidemark.operators.profile import dataset_profile


def test_three_loads_equal_one_pass(spark, tmp_path):
    path = str(tmp_path / "parts")
    n = F.col("id")
    df = spark.range(30_000).select(
        n.alias("key"),
        F.when(n % 3 == 0, "HOT").otherwise(F.concat(F.lit("S"), (n % 50).cast("string"))).alias("Symbol"),
        F.when(n % 7 != 0, (n % 1000) / 8).alias("x y"),
        F.when(n % 2 == 0, "").otherwise("b").alias("text"),
        F.lit(None).cast("double").alias("none"),
    )
    loads = {"one": n < 10_000, "two": (n >= 10_000) & (n < 10_001), "three": n >= 10_001}
    for name in ("one", "two", "three", "one"):  # written again, a load counts once
        kp.add_load(df.withColumn("id", F.col("key")).where(loads[name]).drop("id"), path, name, df.columns, ("Symbol",))
    parts = kp.read_parts(spark, path)
    got = {r.column: r for r in kp.kept_profile(parts).collect()}
    want = {r.column: r for r in dataset_profile(df).collect()}
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert (got[c].n, got[c].missing, got[c].missing_pct, got[c].dtype) == (30_000, w.missing, w.missing_pct, w.dtype)
        assert abs(got[c].unique_values - w.unique_values) <= kp.DISTINCT_ERROR * w.unique_values
    assert got["text"].unique_values == 2 and got["none"].unique_values == 0
    counts = {r.value: r.n for r in kp.kept_distribution(parts, "Symbol").collect()}
    assert counts == {r.Symbol: r["count"] for r in df.groupBy("Symbol").count().collect()}


def test_an_empty_load(spark, tmp_path):
    empty = spark.createDataFrame([], "a string, b int")
    kp.add_load(empty, str(tmp_path / "p"), "only", dims=("b",))
    row = kp.kept_profile(kp.read_parts(spark, str(tmp_path / "p"))).collect()
    assert [(r.column, r.n, r.missing, r.missing_pct, r.unique_values) for r in row] == [("a", 0, 0, None, 0)]
    assert kp.kept_distribution(kp.read_parts(spark, str(tmp_path / "p")), "b").count() == 0
