"""Classifier metrics, comparisons, weights and the bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import OPEN_PREDICTIONS, PREDICTIONS, TABLE_SQL, query, r, rounded, sql_rounded
from tidemark.catalog.features import table
from tidemark.operators import labels as lb
from tidemark.operators import metrics as m
from tidemark.operators.stats import paired_bootstrap
from tidemark.sources.sinks import read_metrics
from tidemark.sources.storage import fresh_path


def scores_sql(source: str, by: str, extra: str = "") -> str:
    """CTE ``scores``: every metric of ``source`` per group ``by``."""
    cells = ", ".join(
        f"sum(CASE WHEN actual = {a} AND prediction = {p} THEN w ELSE 0 END) AS c{a}{p}"
        for a in range(3)
        for p in range(3)
    )
    true = {k: f"(c{k}0 + c{k}1 + c{k}2)" for k in range(3)}
    pred = {k: f"(c0{k} + c1{k} + c2{k})" for k in range(3)}
    n = "(" + " + ".join(true.values()) + ")"
    prec = [f"coalesce(c{k}{k} * 1.0E0 / nullif({pred[k]}, 0), 0)" for k in range(3)]
    rec = [f"coalesce(c{k}{k} * 1.0E0 / nullif({true[k]}, 0), 0)" for k in range(3)]
    f1 = [f"coalesce(c{k}{k} * 2.0E0 / nullif({true[k]} + {pred[k]}, 0), 0)" for k in range(3)]
    used = [f"CASE WHEN {true[k]} + {pred[k]} > 0 THEN 1 ELSE 0 END" for k in range(3)]
    present = [f"CASE WHEN {true[k]} > 0 THEN 1 ELSE 0 END" for k in range(3)]
    macro = lambda x: f"({' + '.join(x)}) / ({' + '.join(used)})"
    hits = "(c00 + c11 + c22)"
    tp = " + ".join(f"{true[k]} * {pred[k]}" for k in range(3))
    pp = " + ".join(f"{pred[k]} * {pred[k]}" for k in range(3))
    tt = " + ".join(f"{true[k]} * {true[k]}" for k in range(3))
    return f"""
cells AS (SELECT {by}, {cells} FROM (SELECT *, 1.0E0 AS w{extra} FROM {source}) GROUP BY {by}),
scores AS (
  SELECT *, CAST({n} AS BIGINT) AS n, {hits} / {n} AS accuracy,
         ({' + '.join(rec)}) / ({' + '.join(present)}) AS balanced_accuracy,
         {macro(prec)} AS macro_precision, {macro(rec)} AS macro_recall, {macro(f1)} AS macro_f1,
         ({' + '.join(f'{f1[k]} * {true[k]}' for k in range(3))}) / {n} AS weighted_f1,
         coalesce(({hits} * {n} - ({tp})) / nullif(sqrt({n} * {n} - ({pp})) * sqrt({n} * {n} - ({tt})), 0), 0) AS mcc,
         {', '.join(f'{prec[k]} AS p{k}, {rec[k]} AS r{k}, {f1[k]} AS f{k}, {true[k]} AS s{k}, {pred[k]} AS d{k}' for k in range(3))},
         ({' + '.join(f'{prec[k]} * {true[k]}' for k in range(3))}) / {n} AS weighted_precision,
         ({' + '.join(f'{rec[k]} * {true[k]}' for k in range(3))}) / {n} AS weighted_recall
  FROM cells)"""


_SCORES = f"WITH {PREDICTIONS}, {scores_sql('predictions', 'model')}"


@query("classifier_metrics", f"{_SCORES} SELECT model, n, {sql_rounded(m.METRICS)} FROM scores")
def classifier_metrics(spark, sf):
    return rounded(m.classifier_metrics(fx.predictions(spark, sf)))


@query(
    "per_ticker_metrics",
    f"WITH {PREDICTIONS}, {scores_sql('predictions', 'model, Symbol')} SELECT model, Symbol, n, {sql_rounded(m.METRICS)} FROM scores",
)
def per_ticker_metrics(spark, sf):
    return rounded(m.per_ticker_metrics(fx.predictions(spark, sf)))


@query(
    "two_class_metrics",
    "WITH l AS (SELECT quality AS actual, 1 - toxic AS prediction, 'quality' AS model FROM labels), "
    f"{scores_sql('l', 'model')} SELECT model, n, {sql_rounded(m.METRICS)} FROM scores",
)
def two_class_metrics(spark, sf):
    labels = fx.table(spark, sf, "labels").select(
        F.lit("quality").alias("model"), F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("prediction")
    )
    return rounded(m.classifier_metrics(labels, labels=(0, 1)))


@query(
    "confusion_matrix",
    f"{_SCORES} "
    + " UNION ALL ".join(
        f"SELECT model, {a} AS actual, {p} AS prediction, CAST(c{a}{p} AS BIGINT) AS n, "
        f"{r(f'coalesce(c{a}{p} / nullif(s{a}, 0), 0)')} AS recall_share FROM scores"
        for a in range(3)
        for p in range(3)
    ),
)
def confusion_matrix(spark, sf):
    return rounded(m.confusion_matrix(fx.predictions(spark, sf)))


@query(
    "classification_report",
    f"{_SCORES} "
    + " UNION ALL ".join(
        f"SELECT model, '{k}' AS class, {r(f'p{k}')} AS precision, {r(f'r{k}')} AS recall, {r(f'f{k}')} AS f1_score, "
        f"CAST(s{k} AS BIGINT) AS support FROM scores WHERE s{k} + d{k} > 0"
        for k in range(3)
    )
    + f" UNION ALL SELECT model, 'macro avg', {r('macro_precision')}, {r('macro_recall')}, {r('macro_f1')}, n FROM scores"
    + f" UNION ALL SELECT model, 'weighted avg', {r('weighted_precision')}, {r('weighted_recall')}, {r('weighted_f1')}, n FROM scores",
)
def classification_report(spark, sf):
    return rounded(m.classification_report(fx.predictions(spark, sf)))


@query(
    "model_comparison",
    f"{_SCORES} SELECT model AS Model, {r('accuracy')} AS Accuracy, {r('balanced_accuracy')} AS Balanced_Accuracy, "
    f"{r('macro_f1')} AS Macro_F1, {r('mcc')} AS MCC, {r('f2')} AS BUY_F1, {r('f0')} AS SELL_F1, {r('f1')} AS HOLD_F1 FROM scores",
)
def model_comparison(spark, sf):
    return rounded(m.model_comparison(fx.predictions(spark, sf)))


@query(
    "metric_delta",
    f"{_SCORES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, {r('b')} AS baseline, {r('c')} AS candidate, {r('c - b')} AS delta FROM "
        f"(SELECT max(CASE WHEN model = 'always_hold' THEN {c} END) AS b, max(CASE WHEN model = 'reversal1' THEN {c} END) AS c FROM scores)"
        for c in m.METRICS
    ),
)
def metric_delta(spark, sf):
    scores = m.classifier_metrics(fx.predictions(spark, sf))
    return rounded(m.metric_delta(scores, "always_hold", "reversal1"))


@query(
    "metrics_precedence",
    f"WITH {PREDICTIONS}, s AS (SELECT *, CASE WHEN Date <= DATE '2000-06-30' THEN 'validation' ELSE 'test' END AS part FROM predictions), "
    f"{scores_sql('s', 'model, part')} SELECT model, part AS source, {sql_rounded(m.METRICS)} FROM scores "
    "WHERE part = CASE WHEN model = 'always_hold' THEN 'validation' ELSE 'test' END",
)
def metrics_precedence(spark, sf):
    """Metrics of two splits stored per model, one model without test figures."""
    part = F.when(F.col("Date") <= F.lit("2000-06-30").cast("date"), "validation").otherwise("test")
    scores = m.classifier_metrics(fx.predictions(spark, sf).withColumn("part", part), ("model", "part"))
    pick = lambda p: F.max(F.when(F.col("part") == p, F.struct(*m.METRICS))).alias(p)
    files = scores.where("model <> 'always_hold' or part = 'validation'").groupBy("model").agg(pick("test"), pick("validation"))
    path = fresh_path(spark, "metrics")
    files.write.partitionBy("model").json(path)
    return rounded(read_metrics(spark, path))


@query(
    "class_weights",
    f"WITH {TABLE_SQL} SELECT target_classification, count(*) AS n, "
    f"{r('sum(count(*)) OVER () * 1.0E0 / (count(*) OVER () * count(*))')} AS weight FROM ftable "
    "WHERE split = 'train' GROUP BY target_classification",
)
def class_weights(spark, sf):
    train = table(spark, sf).where("split = 'train'").select("target_classification")
    return rounded(m.class_weights(train, "target_classification"))


_MODELS = ("reversal1", "reversal5", "always_hold")
_B, _N = 1_000, 10_000
_BOOT = f"""WITH {PREDICTIONS},
wide AS (
  SELECT Symbol, Date, max(actual) AS actual,
         {', '.join(f"max(CASE WHEN model = '{x}' THEN prediction END) AS {x}" for x in _MODELS)}
  FROM predictions GROUP BY Symbol, Date),
pick AS (SELECT * FROM wide ORDER BY md5(concat_ws('|', Symbol, CAST(Date AS VARCHAR), '42')), Symbol, Date LIMIT {_N}),
num AS (SELECT *, row_number() OVER (ORDER BY Symbol, Date) - 1 AS pos FROM pick),
draws AS (
  SELECT rep, ('0x' || substr(md5(concat(CAST(rep AS VARCHAR), '-', CAST(i AS VARCHAR))), 1, 8))::UBIGINT % {_N} AS pos
  FROM range({_B}) b(rep), range({_N}) d(i)),
drawn AS (SELECT rep, actual, {', '.join(_MODELS)} FROM draws JOIN num USING (pos)),
predicted AS ({' UNION ALL '.join(f"SELECT rep, '{x}' AS model, actual, {x} AS prediction FROM drawn" for x in _MODELS)}),
{scores_sql('predicted', 'rep, model')},
pairs AS (
  SELECT a.model AS model_a, b.model AS model_b, a.macro_f1 - b.macro_f1 AS d_f1, a.accuracy - b.accuracy AS d_accuracy
  FROM scores a JOIN scores b ON a.rep = b.rep
   AND (a.model, b.model) IN (('reversal1', 'reversal5'), ('reversal1', 'always_hold'), ('reversal5', 'always_hold')))
SELECT model_a, model_b, """ + ", ".join(
    f"round(avg(d_{x}), 4) AS delta_{x}, round(quantile_cont(d_{x}, 0.025), 4) AS {x}_ci_low, "
    f"round(quantile_cont(d_{x}, 0.975), 4) AS {x}_ci_high, "
    f"round(2 * least(avg(CASE WHEN d_{x} > 0 THEN 1.0E0 ELSE 0 END), avg(CASE WHEN d_{x} < 0 THEN 1.0E0 ELSE 0 END)), 4) AS p_value_{x}, "
    f"2 * least(avg(CASE WHEN d_{x} > 0 THEN 1.0E0 ELSE 0 END), avg(CASE WHEN d_{x} < 0 THEN 1.0E0 ELSE 0 END)) < 0.05 AS {x}_significant"
    for x in ("f1", "accuracy")
) + " FROM pairs GROUP BY model_a, model_b"


@query("paired_bootstrap", _BOOT)
def bootstrap(spark, sf):
    return paired_bootstrap(fx.predictions(spark, sf), _MODELS, sample_size=_N, replicates=_B)


_OPEN = f"""WITH {OPEN_PREDICTIONS},
lab AS (
  SELECT model, label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(d) AS BIGINT) AS predicted, CAST(sum(h) AS BIGINT) AS hit FROM (
    SELECT model, actual AS label, 1 AS s, 0 AS d, CASE WHEN actual IS NOT DISTINCT FROM prediction THEN 1 ELSE 0 END AS h FROM open_predictions
    UNION ALL SELECT model, prediction, 0, 1, 0 FROM open_predictions)
  GROUP BY model, label),
sc AS (
  SELECT *, coalesce(hit * 1.0E0 / nullif(predicted, 0), 0) AS precision, coalesce(hit * 1.0E0 / nullif(support, 0), 0) AS recall,
         coalesce(hit * 2.0E0 / nullif(support + predicted, 0), 0) AS f1 FROM lab),
o AS (
  SELECT model, CAST(sum(support) AS BIGINT) AS n, sum(hit) * 1.0E0 / sum(support) AS accuracy,
         sum(CASE WHEN support > 0 THEN recall ELSE 0E0 END) / count_if(support > 0) AS balanced_accuracy,
         avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
         sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall,
         sum(f1 * support) / sum(support) AS weighted_f1,
         (sum(hit) * 1.0E0 * sum(support) - sum(support * 1.0E0 * predicted))
         / nullif(sqrt(pow(sum(support), 2) - sum(pow(predicted, 2))) * sqrt(pow(sum(support), 2) - sum(pow(support, 2))), 0) AS m
  FROM sc GROUP BY model),
om AS (SELECT *, coalesce(m, 0) AS mcc FROM o)"""


@query("metrics_open_labels", f"{_OPEN} SELECT model, n, {sql_rounded(m.METRICS)} FROM om")
def metrics_open_labels(spark, sf):
    """Metrics where a fourth label, a fifth among the predictions, and missing labels occur."""
    return rounded(m.classifier_metrics(fx.open_predictions(spark, sf)))


@query(
    "report_open_labels",
    f"{_OPEN} SELECT model, coalesce(CAST(label AS VARCHAR), 'missing') AS class, {r('precision')} AS precision, "
    f"{r('recall')} AS recall, {r('f1')} AS f1_score, support FROM sc"
    + "".join(
        f" UNION ALL SELECT model, '{k} avg', {r(f'{k}_precision')}, {r(f'{k}_recall')}, {r(f'{k}_f1')}, n FROM om"
        for k in ("macro", "weighted")
    ),
)
def report_open_labels(spark, sf):
    return rounded(lb.open_report(fx.open_predictions(spark, sf), ("model",)))


@query(
    "confusion_open_labels",
    f"WITH {OPEN_PREDICTIONS} SELECT model, actual, prediction, count(*) AS n FROM open_predictions GROUP BY ALL",
)
def confusion_open_labels(spark, sf):
    return lb.label_cells(fx.open_predictions(spark, sf), ("model",))
