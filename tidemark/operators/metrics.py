"""Classifier metrics from one aggregate of confusion-matrix cells.

Rows meet in a single ``groupBy`` whose result holds all cells of a group side
by side; every metric is then plain arithmetic on those few numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import or_zero, ratio
from tidemark.operators.labels import open_metrics

CLASSES = (0, 1, 2)
METRICS = (
    "accuracy",
    "balanced_accuracy",
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "weighted_f1",
    "mcc",
)


def _cell(a, p) -> str:
    return f"c_{a}_{p}"


def confusion_cells(
    df: DataFrame,
    by: Sequence[str] = (),
    actual: str = "actual",
    prediction: str = "prediction",
    labels: Sequence[int] = CLASSES,
    weight: str | None = None,
) -> DataFrame:
    """One row per group, one column per (true, predicted) pair.

    ``weight`` names a count column when rows are already aggregated.
    """
    cells = []
    for a in labels:
        for p in labels:
            hit = (F.col(actual) == a) & (F.col(prediction) == p)
            n = F.count_if(hit) if weight is None else F.coalesce(F.sum(F.when(hit, F.col(weight))), F.lit(0))
            cells.append(n.cast("long").alias(_cell(a, p)))
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)


def _sum(cols: list[Column]) -> Column:
    return reduce(add, cols)


class _Counts:
    """Named sums over the cells of one row."""

    def __init__(self, labels: Sequence[int]):
        self.labels = labels
        c = lambda a, p: F.col(_cell(a, p))
        self.hit = {k: c(k, k) for k in labels}
        self.true = {k: _sum([c(k, p) for p in labels]) for k in labels}
        self.pred = {k: _sum([c(a, k) for a in labels]) for k in labels}
        self.n = _sum(list(self.true.values()))

    def precision(self, k) -> Column:
        return or_zero(ratio(self.hit[k].cast("double"), self.pred[k]))

    def recall(self, k) -> Column:
        return or_zero(ratio(self.hit[k].cast("double"), self.true[k]))

    def f1(self, k) -> Column:
        return or_zero(ratio(2.0 * self.hit[k], self.true[k] + self.pred[k]))

    def used(self, k) -> Column:
        """Class occurs among the true or the predicted labels."""
        return self.true[k] + self.pred[k] > 0

    def macro(self, metric) -> Column:
        total = _sum([F.when(self.used(k), metric(k)).otherwise(0.0) for k in self.labels])
        return ratio(total, _sum([self.used(k).cast("int") for k in self.labels]))

    def weighted(self, metric) -> Column:
        return ratio(_sum([metric(k) * self.true[k] for k in self.labels]), self.n)

    def mcc(self) -> Column:
        f = lambda x: x.cast("double")
        s, hits = f(self.n), f(_sum(list(self.hit.values())))
        tp = _sum([f(self.true[k]) * f(self.pred[k]) for k in self.labels])
        pp = _sum([f(self.pred[k]) * f(self.pred[k]) for k in self.labels])
        tt = _sum([f(self.true[k]) * f(self.true[k]) for k in self.labels])
        return or_zero(ratio(hits * s - tp, F.sqrt(s * s - pp) * F.sqrt(s * s - tt)))


def metrics_from_cells(cells: DataFrame, by: Sequence[str] = (), labels: Sequence[int] = CLASSES) -> DataFrame:
    c = _Counts(labels)
    present = [F.when(c.true[k] > 0, c.recall(k)).otherwise(0.0) for k in labels]
    n_present = _sum([(c.true[k] > 0).cast("int") for k in labels])
    return cells.select(
        *by,
        c.n.alias("n"),
        ratio(_sum(list(c.hit.values())).cast("double"), c.n).alias("accuracy"),
        ratio(_sum(present), n_present).alias("balanced_accuracy"),
        c.macro(c.precision).alias("macro_precision"),
        c.macro(c.recall).alias("macro_recall"),
        c.macro(c.f1).alias("macro_f1"),
        c.weighted(c.f1).alias("weighted_f1"),
        c.mcc().alias("mcc"),
    )


def classifier_metrics(df: DataFrame, by: Sequence[str] = ("model",), labels: Sequence[int] | None = None, **kw) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted scores and MCC per group.

    Every label that occurs is a class, and every row counts; with ``labels`` only
    rows count whose labels are among them.
    """
    if labels is None:
        return open_metrics(df, by, **kw)
    return metrics_from_cells(confusion_cells(df, by, labels=labels, **kw), by, labels)


def per_ticker_metrics(df: DataFrame, by: Sequence[str] = ("model", "Symbol"), **kw) -> DataFrame:
    return classifier_metrics(df, by, **kw)


def confusion_matrix(df: DataFrame, by: Sequence[str] = ("model",), labels: Sequence[int] = CLASSES, **kw) -> DataFrame:
    """Long matrix with zero cells, and each cell's share of its true class."""
    cells = confusion_cells(df, by, labels=labels, **kw)
    c = _Counts(labels)
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("actual"),
                F.lit(p).alias("prediction"),
                F.col(_cell(a, p)).alias("n"),
                or_zero(ratio(F.col(_cell(a, p)).cast("double"), c.true[a])).alias("recall_share"),
            )
            for a in labels
            for p in labels
        ]
    )
    return cells.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")


def classification_report(df: DataFrame, by: Sequence[str] = ("model",), labels: Sequence[int] = CLASSES, **kw) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    cells = confusion_cells(df, by, labels=labels, **kw)
    c = _Counts(labels)

    def entry(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            support.alias("support"),
        )

    rows = [
        F.when(c.used(k), entry(str(k), c.precision(k), c.recall(k), c.f1(k), c.true[k])) for k in labels
    ]
    rows.append(entry("macro avg", c.macro(c.precision), c.macro(c.recall), c.macro(c.f1), c.n))
    rows.append(entry("weighted avg", c.weighted(c.precision), c.weighted(c.recall), c.weighted(c.f1), c.n))
    return cells.select(*by, F.explode(F.array_compact(F.array(*rows))).alias("e")).select(*by, "e.*")


def model_comparison(df: DataFrame, by: str = "model", **kw) -> DataFrame:
    """Leaderboard by accuracy; absent figures are 0."""
    labels = kw.get("labels", CLASSES)
    cells = confusion_cells(df, (by,), **kw)
    c = _Counts(labels)
    scores = metrics_from_cells(
        cells.withColumns({f"f1_{k}": c.f1(k) for k in labels}), (by, *[f"f1_{k}" for k in labels]), labels
    )
    return scores.select(
        F.col(by).alias("Model"),
        or_zero(F.col("accuracy")).alias("Accuracy"),
        or_zero(F.col("balanced_accuracy")).alias("Balanced_Accuracy"),
        or_zero(F.col("macro_f1")).alias("Macro_F1"),
        or_zero(F.col("mcc")).alias("MCC"),
        F.col("f1_2").alias("BUY_F1"),
        F.col("f1_0").alias("SELL_F1"),
        F.col("f1_1").alias("HOLD_F1"),
    ).orderBy(F.desc("Accuracy"), "Model")


def long_metrics(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return scores.unpivot(list(by), list(METRICS), "metric", "value")


def metric_delta(scores: DataFrame, baseline: str, candidate: str, by: str = "model") -> DataFrame:
    """Metric by metric: candidate minus baseline."""
    long = long_metrics(scores, (by,))
    pick = lambda name: F.max(F.when(F.col(by) == name, F.col("value")))
    return (
        long.groupBy("metric")
        .agg(pick(baseline).alias("baseline"), pick(candidate).alias("candidate"))
        .withColumn("delta", F.col("candidate") - F.col("baseline"))
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class; a table of k rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every_class = Window.partitionBy()  # one row per class by now
    total, kinds = F.sum("n").over(every_class), F.count(F.lit(1)).over(every_class)
    return counts.withColumn("weight", F.try_divide(total.cast("double"), kinds * F.col("n")))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the class weight to each row that has a class.

    The weights are one row per class and go to every task.  Left to the adaptive plan
    the rows would be shuffled by class, a third of them to each of three tasks: it does
    not send out a small side when few partitions of the large one hold rows.
    """
    weights = F.broadcast(class_weights(df, label).select(label, F.col("weight").alias(name)))
    return df.join(weights, label).select(*df.columns, name)
