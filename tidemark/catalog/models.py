"""Model training, scoring, attribution and masking tests on the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import FEATURE_SQL, FEATURES, PREDICTIONS, query, r, rounded
from tidemark.catalog.features import features, table
from tidemark.operators import explain as ex
from tidemark.operators.models import Scorecard, evaluate, train, train_eval
from tidemark.operators.stats import seeded_sample
from tidemark.operators.trees import Leaves, forest_leaves, tree_attributions
from tidemark.plans.modelling import explain_model, faithfulness_table, first_rows, with_row_id
from tidemark.sources.storage import fresh_path, stored

LABEL = "target_classification"
# Models behind queries about something else than the fit; fitting the presets takes minutes.
SMALL = {
    "random_forest": dict(numTrees=10, maxDepth=5),
    "xgboost": dict(maxIter=3, maxDepth=3),
    "lightgbm": dict(maxIter=3, maxDepth=2),
    "neural_baseline": dict(hidden=(16,), maxIter=20),
}


def training_table(spark, sf):
    return stored(table(spark, sf).select("split", "Symbol", "Date", *FEATURES, LABEL), "features")


def fitted(df, name: str):
    return train(df.where("split = 'train'"), FEATURES, LABEL, name, **SMALL[name])


def fit_query(key: str, *names: str, **params):
    """Fits of whole presets, unless ``params`` spells one out."""

    def run(spark, sf):
        """Metrics of each split after fitting on train."""
        df = training_table(spark, sf)
        out = None
        for name in names:
            model = train(df.where("split = 'train'"), FEATURES, LABEL, name, **params)
            part = evaluate(model, df, LABEL).withColumn("model", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return rounded(out)

    query(key)(run)


fit_query("fit_rf", "random_forest", numTrees=200, maxDepth=8)
fit_query("fit_gbt", "xgboost", "lightgbm")
fit_query("fit_mlp", "neural_baseline", hidden=(128, 64, 32), maxIter=100)


@query("train_eval")
def train_and_evaluate(spark, sf):
    """Per-symbol test metrics of a model that was saved along the way."""
    path = fresh_path(spark, "model")
    _, _, per_symbol = train_eval(
        training_table(spark, sf), FEATURES, LABEL, "random_forest", path, **SMALL["random_forest"]
    )
    return rounded(per_symbol)


@query("score_batch")
def score_batch(spark, sf):
    df = training_table(spark, sf)
    out = fitted(df, "random_forest").predict(df)
    return out.select("split", "Symbol", "Date", "prediction", "probability", "confidence")


@query("background_kmeans")
def background_kmeans(spark, sf):
    return ex.background(training_table(spark, sf), FEATURES, 10)


def explained(spark, sf, permutations: int = 8):
    """Sampled Shapley values of every test row."""
    df = training_table(spark, sf)
    model = fitted(df, "random_forest")
    rows = stored(with_row_id(df.where("split = 'test'")), "explained")
    ground = ex.background(df, FEATURES, 10)
    return df, model, rows, stored(ex.shapley(model, rows, ground, permutations), "attributions")


@query("shapley_sample")
def shapley_sample(spark, sf):
    return rounded(explained(spark, sf)[3])


@query("global_importance")
def global_importance(spark, sf):
    return rounded(ex.global_importance(explained(spark, sf)[3]))


@query("faithfulness")
def faithfulness(spark, sf):
    """Masking test of every test row with the split importances' first and last feature."""
    df = training_table(spark, sf)
    model = fitted(df, "random_forest")
    ranked = sorted(model.importances().items(), key=lambda kv: (-kv[1], kv[0]))
    out = ex.masked_confidences(model, df.where("split = 'test'"), ranked[0][0], ranked[-1][0])
    cols = ["baseline_confidence", "top_confidence", "control_confidence", "top_confidence_drop", "control_confidence_drop"]
    return ex.row_faithfulness(out).select("Symbol", "Date", "pred_class", *cols, "faithfulness_ratio")


@query("explain_first_row")
def explain_first_row(spark, sf):
    df = training_table(spark, sf)
    out = explain_model(fitted(df, "random_forest"), df.where("split = 'test'"))[2]
    return out.select("Symbol", "Date", "pred_class", "baseline_confidence", "top_confidence_drop", "control_confidence_drop", "faithfulness_ratio")


@query("faithfulness_agg")
def faithfulness_agg(spark, sf):
    """Masking test of two models over the same 500 sampled rows."""
    df = training_table(spark, sf)
    models = {n: fitted(df, n) for n in ("random_forest", "lightgbm")}
    importances = {
        n: spark.createDataFrame(list(m.importances().items()), "feature string, importance double")
        for n, m in models.items()
    }
    return faithfulness_table(models, importances, df.where("split = 'test'"), 500)


_DROPS = f"""WITH {PREDICTIONS},
c AS (SELECT model, confidence AS base, confidence * 0.8E0 - (prediction * 0.05E0) AS top, confidence * 0.95E0 + actual * 0.02E0 AS ctl FROM predictions),
d AS (SELECT model, base, base - top AS dt, base - ctl AS dc FROM c)
SELECT model, count(*) AS instances, round(avg(base), 4) AS baseline_confidence_mean,
       round(avg(dt), 4) AS top_drop_mean, round(stddev_pop(dt) / sqrt(count(*)), 4) AS top_drop_sem,
       round(avg(dc), 4) AS control_drop_mean, round(stddev_pop(dc) / sqrt(count(*)), 4) AS control_drop_sem,
       round(avg(dt) / greatest(1E-5, abs(avg(dc))), 2) AS faithfulness_ratio,
       round(avg(CASE WHEN dt > dc THEN 1.0E0 ELSE 0 END) * 100, 2) AS dominance_rate_pct
FROM d GROUP BY model"""


@query("faithfulness_formulas", _DROPS)
def faithfulness_formulas(spark, sf):
    """The summary formulas on confidences that follow from the predictions by rule."""
    p = fx.predictions(spark, sf)
    c = F.col("confidence")
    rows = p.select(
        "model",
        c.alias("baseline_confidence"),
        (c * 0.8 - F.col("prediction") * 0.05).alias("top_confidence"),
        (c * 0.95 + F.col("actual") * 0.02).alias("control_confidence"),
    )
    return ex.faithfulness_summary(rows)


# Importances that need no model: scaled mean size of a feature per rule.
_RULES = {
    "a": {f: 1.0 for f in FEATURES[:8]},
    "b": {f: 0.5 for f in FEATURES[2:12]},
    "c": {f: 2.0 for f in FEATURES[4:6]},
    "d": {f: 0.25 for f in FEATURES[:4]},
}
_IMPORTANCE = "imp AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, '{f}' AS feature, round(avg(abs({f})) * {w!r}E0, 3) AS importance FROM feat"
    for m, rule in _RULES.items()
    for f, w in rule.items()
) + ")"


def importances(spark, sf):
    means = features(spark, sf).agg(*[F.avg(F.abs(f)).alias(f) for f in FEATURES[:12]])
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(f).alias("feature"), F.round(F.col(f) * w, 3).alias("importance"))
            for m, rule in _RULES.items()
            for f, w in rule.items()
        ]
    )
    return means.select(F.explode(cells).alias("e")).select("e.*")


@query(
    "global_importance_rank",
    f"WITH {FEATURE_SQL}, {_IMPORTANCE}, w AS (SELECT feature, "
    + ", ".join(f"max(CASE WHEN model = '{m}' THEN importance END) AS {m}" for m in _RULES)
    + " FROM imp GROUP BY feature), z AS (SELECT feature, a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d FROM w WHERE a IS NOT NULL) "
    f"SELECT feature, a, b, c, d, {r('(a + b + c + d) / 4')} AS mean_importance, "
    "CAST(row_number() OVER (ORDER BY (a + b + c + d) / 4 DESC, feature) AS INTEGER) AS overall_rank FROM z",
)
def global_importance_rank(spark, sf):
    out = ex.importance_rank(importances(spark, sf), list(_RULES))
    return out.withColumn("mean_importance", F.floor(F.col("mean_importance") * 1e6 + 0.5) / 1e6)


@query("importance_normalize", f"WITH {FEATURE_SQL}, {_IMPORTANCE} SELECT model, feature, importance FROM imp")
def importance_normalize(spark, sf):
    """Both artifact shapes: a map per model, and two parallel lists."""
    parts = F.sort_array(F.collect_list(F.struct("feature", "importance")))  # one entry per feature
    grouped = importances(spark, sf).groupBy("model").agg(parts.alias("p"))
    as_map = F.to_json(F.map_from_entries("p"))
    as_lists = F.to_json(F.struct(F.col("p.feature").alias("features"), F.col("p.importance").alias("importance")))
    files = grouped.select("model", F.when(F.col("model").isin("a", "c"), as_map).otherwise(as_lists).alias("json"))
    return ex.normalize_importance(files)


@query(
    "explained_rows",
    f"WITH {FEATURE_SQL} SELECT * FROM (SELECT Symbol, Date, 'first' AS how FROM feat ORDER BY Date, Symbol LIMIT 100) "
    "UNION ALL SELECT * FROM (SELECT Symbol, Date, 'hash' AS how FROM feat "
    "ORDER BY md5(concat_ws('|', Symbol, CAST(Date AS VARCHAR), '42')), Symbol, Date LIMIT 100)",
)
def explained_rows(spark, sf):
    """The sample an explanation starts from: first rows in time order, then n by hash."""
    rows = stored(features(spark, sf).select("Symbol", "Date", "Close"), "features")
    return first_rows(rows, 100).select("Symbol", "Date", F.lit("first").alias("how")).unionByName(
        seeded_sample(rows, ("Symbol", "Date"), 100).select("Symbol", "Date", F.lit("hash").alias("how"))
    )


# A planted tree over two features, one of them asked twice on a path.
_INF = float("inf")
PLANTED = Leaves.of(
    [
        ({0: (-_INF, 0.0, 0.4), 1: (-_INF, 40.0, 0.25)}, [0.8]),
        ({0: (-_INF, 0.0, 0.4), 1: (40.0, _INF, 0.75)}, [0.3]),
        ({0: (0.0, 0.02, 0.3)}, [0.5]),
        ({0: (0.02, _INF, 0.3), 1: (-_INF, 60.0, 0.7)}, [0.2]),
        ({0: (0.02, _INF, 0.3), 1: (60.0, _INF, 0.3)}, [0.9]),
    ]
)
_TREE = f"""WITH {FEATURE_SQL},
v AS (
  SELECT split, Symbol, Date, return_1d AS x, rsi_14 AS y,
         CASE WHEN return_1d <= 0 THEN CASE WHEN rsi_14 <= 40 THEN 0.8E0 ELSE 0.3E0 END
              WHEN return_1d <= 0.02 THEN 0.5E0 WHEN rsi_14 <= 60 THEN 0.2E0 ELSE 0.9E0 END AS v12,
         CASE WHEN return_1d <= 0 THEN 0.25E0 * 0.8E0 + 0.75E0 * 0.3E0
              WHEN return_1d <= 0.02 THEN 0.5E0 ELSE 0.7E0 * 0.2E0 + 0.3E0 * 0.9E0 END AS v1,
         0.4E0 * CASE WHEN rsi_14 <= 40 THEN 0.8E0 ELSE 0.3E0 END + 0.3E0 * 0.5E0
         + 0.3E0 * CASE WHEN rsi_14 <= 60 THEN 0.2E0 ELSE 0.9E0 END AS v2,
         0.4E0 * (0.25E0 * 0.8E0 + 0.75E0 * 0.3E0) + 0.3E0 * 0.5E0 + 0.3E0 * (0.7E0 * 0.2E0 + 0.3E0 * 0.9E0) AS v0
  FROM feat)
SELECT split, Symbol, Date, 'return_1d' AS feature, 0 AS class, {r('x')} AS raw_value, {r('(v1 - v0 + v12 - v2) / 2', 9)} AS attribution FROM v
UNION ALL
SELECT split, Symbol, Date, 'rsi_14', 0, {r('y', 4)}, {r('(v2 - v0 + v12 - v1) / 2', 9)} FROM v"""


@query("tree_attributions", _TREE)
def planted_attributions(spark, sf):
    """Every row's exact attributions under a planted tree, against its four conditional scores."""
    out = tree_attributions(features(spark, sf), [PLANTED], ["return_1d", "rsi_14"], ["split", "Symbol", "Date"])
    digits = F.when(F.col("feature") == "rsi_14", 1e4).otherwise(1e6)
    return out.withColumns(
        {
            "raw_value": F.floor(F.col("raw_value") * digits + 0.5) / digits,
            "attribution": F.floor(F.col("attribution") * 1e9 + 0.5) / 1e9,
        }
    )


@query("forest_attributions")
def forest_attributions(spark, sf):
    """Exact attributions of every test row under a fitted forest."""
    df = training_table(spark, sf)
    leaves = forest_leaves(fitted(df, "random_forest"))
    return tree_attributions(df.where("split = 'test'"), leaves, FEATURES, ["Symbol", "Date"])


# Two planted scorecards and the centers their attributions start from.
_SCORED = ["return_1d", "rsi_14", "volume_ratio", "bb_pct_b"]
_CARDS = {
    "steep": Scorecard("steep", _SCORED, [[-0.4, -0.02, 0.1, -0.3], [0.1, 0.01, -0.2, 0.2], [0.5, 0.02, 0.1, 0.4]], [1.2, 0.3, -0.9]),
    "flat": Scorecard("flat", _SCORED, [[0.2, 0.01, 0.05, 0.1], [-0.1, -0.01, 0.3, -0.2], [0.3, 0.005, -0.1, 0.1]], [0.1, 0.8, 0.2]),
}
_CENTERS = [(0, 5, [0.1, 45.0, 1.0, 0.5]), (1, 3, [-0.2, 60.0, 0.8, 0.7]), (2, 8, [0.3, 50.0, 1.5, 0.2])]
_IMPORTANT = {"steep": ("rsi_14", "return_1d"), "flat": ("volume_ratio", "bb_pct_b")}


def _score_sql(card: Scorecard, k: int, zero: str = "") -> str:
    terms = [f"{w!r}E0 * {'0.0E0' if f == zero else f}" for f, w in zip(card.features, card.weights[k])]
    return " + ".join([f"{card.base[k]!r}E0", *terms])


def _center_sql(i: int) -> str:
    upto, cases = 0, []
    for _, size, values in _CENTERS:
        upto += size
        cases.append(f"WHEN draw < {upto} THEN {values[i]!r}E0")
    return f"CASE {' '.join(cases)} END"


_WALKS = f"""WITH {FEATURE_SQL},
x AS (SELECT concat_ws('|', Symbol, CAST(Date AS VARCHAR)) AS row_id, {', '.join(_SCORED)} FROM feat WHERE split = 'test'),
d AS (SELECT x.*, {sum(size for _, size, _ in _CENTERS)} * (('0x' || substr(md5(concat_ws('-', row_id, CAST(perm AS VARCHAR), 'center')), 1, 8))::UBIGINT / 4294967296E0) AS draw
      FROM x, (SELECT unnest(range(8)) AS perm) p),
m AS (SELECT row_id, {', '.join(f'max({f}) AS {f}, avg({_center_sql(i)}) AS c{i}' for i, f in enumerate(_SCORED))} FROM d GROUP BY row_id)
""" + " UNION ALL ".join(
    f"SELECT row_id, '{f}' AS feature, {k} AS class, {r(f)} AS raw_value, "
    f"{r(f'{_CARDS["steep"].weights[k][i]!r}E0 * ({f} - c{i})', 8)} AS attribution FROM m"
    for i, f in enumerate(_SCORED)
    for k in range(3)
)


@query("scorecard_attributions", _WALKS)
def scorecard_attributions(spark, sf):
    """Sampled Shapley values of every test row under a scorecard: weight times distance from the centers drawn."""
    key = F.concat_ws("|", F.col("Symbol").cast("string"), F.col("Date").cast("string"))
    rows = stored(features(spark, sf).where("split = 'test'").select(key.alias("row_id"), *_SCORED), "explained")
    centers = spark.createDataFrame(_CENTERS, "center int, size long, values array<double>")
    return rounded(ex.shapley(_CARDS["steep"], rows, centers), attribution=8)


def _masked_sql(name: str, source: str) -> str:
    """Scores of a scorecard as they are and with a feature set to zero, in the class of the highest."""
    card, (top, control) = _CARDS[name], _IMPORTANT[name]
    parts = [f"{_score_sql(card, k, zero)} AS {p}{k}" for p, zero in (("b", ""), ("t", top), ("o", control)) for k in range(3)]
    at = lambda p: f"CASE WHEN b0 >= b1 AND b0 >= b2 THEN {p}0 WHEN b1 >= b2 THEN {p}1 ELSE {p}2 END"
    return (
        f"SELECT '{name}' AS model, Symbol, Date, CAST({at('class').replace('class', '')} AS INTEGER) AS pred_class, "
        f"{at('b')} AS base, {at('t')} AS top, {at('o')} AS ctl FROM (SELECT Symbol, Date, {', '.join(parts)} FROM {source}) s"
    )


@query(
    "scorecard_masking",
    f"WITH {FEATURE_SQL}, x AS (SELECT * FROM feat WHERE split = 'test'), m AS ({_masked_sql('steep', 'x')}) "
    f"SELECT Symbol, Date, pred_class, {r('base')} AS baseline_confidence, {r('base - top')} AS top_confidence_drop, "
    f"{r('base - ctl')} AS control_confidence_drop, {r('(base - top) / greatest(1E-5, base - ctl)', 3)} AS faithfulness_ratio FROM m",
)
def scorecard_masking(spark, sf):
    """Masking test of every test row under a scorecard."""
    out = ex.masked_confidences(_CARDS["steep"], features(spark, sf).where("split = 'test'"), *_IMPORTANT["steep"])
    cols = ["baseline_confidence", "top_confidence_drop", "control_confidence_drop", "faithfulness_ratio"]
    return rounded(ex.row_faithfulness(out).select("Symbol", "Date", "pred_class", *cols), faithfulness_ratio=3)


_NAMED = "CASE model " + " ".join(f"WHEN '{m}' THEN '{{{i}}}'" for i, m in enumerate(_IMPORTANT)) + " END"
_AGGREGATED = f"""WITH {FEATURE_SQL},
x AS (SELECT * FROM feat WHERE split = 'test' ORDER BY md5(concat_ws('|', Symbol, CAST(Date AS VARCHAR), '42')), Symbol, Date LIMIT 500),
c AS ({' UNION ALL '.join(_masked_sql(m, 'x') for m in _CARDS)}),
d AS (SELECT model, base, base - top AS dt, base - ctl AS dc FROM c)
SELECT model, {_NAMED.format(*[t for t, _ in _IMPORTANT.values()])} AS top_feature,
       {_NAMED.format(*[c for _, c in _IMPORTANT.values()])} AS control_feature,
""" + _DROPS[_DROPS.index("count(*) AS instances") :]


@query("scorecard_faithfulness", _AGGREGATED)
def scorecard_faithfulness(spark, sf):
    """Aggregated masking test of both scorecards over the same 500 sampled rows, features by importance."""
    ranks = {
        m: spark.createDataFrame([(top, 0.9), ("macd", 0.5), (control, 0.1)], "feature string, importance double")
        for m, (top, control) in _IMPORTANT.items()
    }
    return faithfulness_table(_CARDS, ranks, features(spark, sf).where("split = 'test'"))
