"""The summary of splits builds the features once and keeps only what it counts."""

from pyspark.sql import functions as F

from tidemark.catalog import features as cat


def test_split_summary_stores_no_features(spark, tmp_path, monkeypatch):
    day = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("id") % 600).cast("int"))
    lines = spark.range(1200).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"),
        F.when(F.col("id") < 600, 1).otherwise(2).cast("long").alias("l_suppkey"),
        (F.lit(10.0) + F.col("id") * 7 % 13).alias("l_quantity"), (F.lit(500.0) + F.col("id") * 31 % 101).alias("l_extendedprice"),
        day.cast("timestamp").alias("l_shipdate"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = []
    write = cat.stored
    monkeypatch.setattr(cat, "stored", lambda df, name="stage": kept.append(df.columns) or write(df, name))
    got = {r["split"]: r for r in cat.split_summary(spark, str(tmp_path)).collect()}
    assert kept == [["split", "Symbol", "Date", "Close", "complete"]]
    assert {k: (r["initial_rows"], r["warmup_rows_dropped"]) for k, r in got.items()} == {"train": (730, 98), "validation": (470, 98)}
    assert {k: r["final_rows"] for k, r in got.items()} == {"train": 628, "validation": 368}
    assert all(r["n_sell"] + r["n_hold"] + r["n_buy"] == r["final_rows"] for r in got.values())
