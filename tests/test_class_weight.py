"""Class weights reach the rows where they are."""

from pyspark.sql import functions as F

from tidemark.operators.metrics import with_class_weight


def test_rows_are_not_dealt_by_class(spark):
    label = F.when(F.col("id") % 10 == 9, F.lit(None)).otherwise(F.col("id") % 3)
    df = spark.range(0, 6000, 1, 16).select("id", label.alias("label"))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        out = with_class_weight(df, "label")
        held = [n for n in out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        weights = {r["label"]: r["weight"] for r in out.distinct().collect()}
    finally:
        spark.conf.set(limit, before)
    assert len(held) == 16 and max(held) < 400
    assert sum(held) == 5400 and {k: round(w, 9) for k, w in weights.items()} == {0: 1.0, 1: 1.0, 2: 1.0}
