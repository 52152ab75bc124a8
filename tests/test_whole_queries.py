"""Model queries do their whole job: full presets, every test row."""

from pyspark.sql import functions as F

from tidemark.catalog import models


def planted(spark, n):
    """(split, Symbol, Date, features, label) with n test rows."""
    rows = spark.range(0, n + 100, 1, 4)
    values = [((F.col("id") * (j + 3)) % 17).cast("double").alias(f) for j, f in enumerate(models.FEATURES)]
    split = F.when(F.col("id") < n, "test").otherwise("train").alias("split")
    key = [F.concat(F.lit("S"), F.col("id") % 7).alias("Symbol"), F.date_add(F.lit("2001-01-01"), (F.col("id") / 7).cast("int")).alias("Date")]
    return rows.select(split, *key, *values, (F.col("id") % 3).cast("int").alias(models.LABEL))


def test_boosted_fits_take_the_whole_presets(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(models, "training_table", lambda spark, sf: planted(spark, 50))
    monkeypatch.setattr(models, "train", lambda df, features, label, name, **params: asked.append((name, params)))
    monkeypatch.setattr(models, "evaluate", lambda model, df, label: df.groupBy("split").count())
    models.query.__globals__["QUERIES"]["fit_gbt"](spark, "")
    assert asked == [("xgboost", {}), ("lightgbm", {})]
    rounds = {name: models_of(name) for name in ("xgboost", "lightgbm")}
    assert rounds == {"xgboost": (100, 8), "lightgbm": (100, 4)}


def models_of(name):
    from tidemark.operators.models import create

    booster = create(name, 28)[0].getClassifier()
    return booster.getMaxIter(), booster.getMaxDepth()


def test_attributions_take_every_test_row(spark, monkeypatch):
    monkeypatch.setattr(models, "training_table", lambda spark, sf: planted(spark, 5200))
    monkeypatch.setattr(models.ex, "shapley", lambda model, rows, ground, permutations: rows.select("row_id", F.lit(permutations).alias("walks")))
    out = models.shapley_sample(spark, "")
    assert out.where("walks = 8").count() == 5200 and out.distinct().count() == 5200


def test_walks_of_many_rows_go_to_more_tasks(spark, monkeypatch):
    from tidemark.operators import explain
    from tidemark.operators.models import Scorecard

    monkeypatch.setattr(explain, "WALKED_ROWS", 10)
    rows = spark.range(300).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"))
    centers = spark.createDataFrame([(0, 1, [1.0])], "center int, size long, values array<double>")
    card = Scorecard("card", ["x"], [[1.0], [2.0], [3.0]], [0.0, 0.0, 0.0])
    out = explain.shapley(card, rows, centers, 2)
    assert "hashpartitioning(row_id" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 30)" in plan
    assert {(r["row_id"], r["class"]): r["attribution"] for r in out.collect()} == {(i, k): (k + 1.0) * (i - 1) for i in range(300) for k in range(3)}
