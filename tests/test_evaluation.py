import numpy as np
import pandas as pd
import pytest
from bar_data import daily
from pyspark.sql import functions as F

from tidemark.operators import explain as ex
from tidemark.operators import leakage as lk
from tidemark.operators import metrics as m
from tidemark.operators import profile as pf
from tidemark.operators import records as rec
from tidemark.operators import stats as st
from tidemark.operators import texteval as te
from tidemark.operators.models import Model, get, list_models, target_column, train, train_eval
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.features import FeatureConfig, build_features, checked_feature_table

# Published confusion counts (rows true SELL, HOLD, BUY) and the figures they give:
# accuracy, balanced accuracy, macro F1, weighted F1, MCC.
GOLDEN = {
    "a": ([[122381, 140348, 78850], [68711, 164814, 49544], [88105, 110048, 85670]], (0.410431, 0.414121, 0.403492, 0.402850, 0.120861)),
    "b": ([[168812, 106285, 66482], [105701, 134679, 42689], [128209, 83067, 72547]], (0.413924, 0.408533, 0.402986, 0.406171, 0.113269)),
    "c": ([[114900, 152245, 74434], [63931, 173470, 45668], [84026, 119634, 80163]], (0.405663, 0.410546, 0.395891, 0.394826, 0.116605)),
    "d": ([[122354, 165549, 53676], [71355, 180773, 30941], [90308, 132100, 61415]], (0.401270, 0.404401, 0.383898, 0.384284, 0.110060)),
}


def test_golden_confusions(spark):
    rows = [
        (name, a, p, n)
        for name, (counts, _) in GOLDEN.items()
        for a, line in enumerate(counts)
        for p, n in enumerate(line)
    ]
    df = spark.createDataFrame(rows, "model string, actual int, prediction int, n long")
    scores = m.metrics_from_cells(m.confusion_cells(df, ("model",), weight="n"), ("model",))
    for r in scores.collect():
        got = [r[c] for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "mcc")]
        assert got == pytest.approx(GOLDEN[r["model"]][1], abs=6e-7)


def test_absent_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "actual int, prediction int").withColumn("model", F.lit("x"))
    r = m.classifier_metrics(df).head()
    assert r["balanced_accuracy"] == pytest.approx(0.75) and r["macro_recall"] == pytest.approx(0.75)
    only = m.classifier_metrics(df.where("actual = 0")).head()
    assert only["balanced_accuracy"] == 0.5 and only["macro_recall"] == 0.25 and only["mcc"] == 0.0
    report = m.classification_report(df).collect()
    assert {x["class"] for x in report} == {"0", "1", "macro avg", "weighted avg"}


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_quantiles(spark, parts):
    """A third of the values are equal, the rest heavy-tailed; how rows are dealt must not show."""
    rng = np.random.default_rng(0)
    x = np.concatenate([np.full(10_000, 2.5), np.exp(rng.normal(0, 3, 20_000))])
    y = np.where(rng.random(30_000) < 0.1, np.nan, rng.normal(size=30_000))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).select("x", F.when(~F.isnan("y"), F.col("y")).alias("y"))
    probs = (0.0, 1 / 3, 0.5, 0.75, 0.999, 1.0)
    got = {(r["feature"], r["p"]): r["value"] for r in exact_quantiles(df.repartition(parts), ["x", "y"], probs).collect()}
    for p in probs:
        assert got["x", p] == pytest.approx(np.quantile(x, p), rel=1e-12)
        assert got["y", p] == pytest.approx(np.nanquantile(y, p), rel=1e-12)


def test_exact_quantiles_of_edge_values(spark):
    inf, tiny = float("inf"), 5e-324
    rows = [(-inf, None, 3), (-1.5, None, 3), (-0.0, None, 3), (0.0, None, None), (tiny, None, 9), (inf, None, 9), (float("nan"), None, 3)]
    df = spark.createDataFrame(rows, "a double, b double, `c d` int")
    got = {(r["feature"], r["p"]): r["value"] for r in exact_quantiles(df, ["a", "b", "c d"], (0.0, 0.2, 0.5, 0.8, 1.0)).collect()}
    assert got == {
        ("a", 0.0): -inf, ("a", 0.2): -1.5, ("a", 0.5): 0.0, ("a", 0.8): tiny, ("a", 1.0): inf,
        ("c d", 0.0): 3.0, ("c d", 0.2): 3.0, ("c d", 0.5): 3.0, ("c d", 0.8): 9.0, ("c d", 1.0): 9.0,
    }
    assert exact_quantiles(df.limit(0), ["a", "b"], (0.5,)).count() == 0


def test_correlation_is_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame(rng.normal(size=(500, 3)), columns=list("abc")) + 1000.0
    p["b"] += p["a"] * 0.5
    p.loc[rng.random(500) < 0.2, "c"] = np.nan
    df = spark.createDataFrame(p).withColumn("c", F.when(~F.isnan("c"), F.col("c")))
    got = {(r["f1"], r["f2"]): r["r"] for r in pf.feature_correlation(df, list("abc")).collect()}
    want = p.corr()
    assert len(got) == 9
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-10)


def test_sample_is_exact_and_stable(spark):
    df = spark.range(20_000).withColumn("k", F.col("id") % 7)
    a = {r[0] for r in st.seeded_sample(df, ("id",), 1000).collect()}
    b = {r[0] for r in st.seeded_sample(df.repartition(13), ("id",), 1000).collect()}
    assert len(a) == 1000 and a == b
    assert st.seeded_sample(df, ("id",), 50_000).count() == 20_000


def test_bootstrap_against_brute_force(spark):
    rng = np.random.default_rng(3)
    n, reps = 200, 30
    actual = rng.integers(0, 3, n)
    preds = {"p": np.where(rng.random(n) < 0.6, actual, rng.integers(0, 3, n)), "q": rng.integers(0, 3, n)}
    rows = [(mm, int(i), int(actual[i]), int(v[i])) for mm, v in preds.items() for i in range(n)]
    df = spark.createDataFrame(rows, "model string, id long, actual int, prediction int")
    got = st.paired_bootstrap(df, ["p", "q"], sample_size=n, replicates=reps, keys=("id",)).head()
    idx = st.replicate_index(df, reps, n).toPandas()
    diffs = [np.mean(preds["p"][g.pos] == actual[g.pos]) - np.mean(preds["q"][g.pos] == actual[g.pos]) for _, g in idx.groupby("rep")]
    assert len(diffs) == reps and got["delta_accuracy"] == round(float(np.mean(diffs)), 4)
    lo, hi = np.percentile(diffs, [2.5, 97.5])
    assert got["accuracy_ci_low"] == pytest.approx(lo, abs=6e-5) and got["accuracy_ci_high"] == pytest.approx(hi, abs=6e-5)
    assert got["accuracy_significant"]


def test_leakage_checks(spark, walk):
    feats = build_features(daily(spark, walk))
    cols = FeatureConfig().columns()
    assert lk.verify_no_leakage(feats, cols, ["target_classification"])["passed"]
    with pytest.raises(lk.LeakageError):
        lk.verify_no_leakage(feats, [*cols, "future_price"])
    with pytest.raises(lk.LeakageError):
        lk.verify_no_leakage(feats, [*cols, "rsi_14"], ["rsi_14"])
    from tidemark.operators.targets import forward_returns

    planted = forward_returns(feats, (1,), names=("g",)).withColumn("sneaky_feature", F.col("Close") * (F.col("g") + 1))
    found = lk.verify_no_leakage(planted, [*cols, "sneaky_feature"], raise_on_error=False)
    assert not found["passed"] and "sneaky_feature" in found["issues"][0]
    assert found["checked_rows_count"] == planted.count()
    narrow = planted.withColumn("sneaky_feature", F.col("sneaky_feature").cast("decimal(24,12)"))
    assert len(lk.verify_no_leakage(narrow, ["sneaky_feature"], raise_on_error=False)["issues"]) == 1
    back = planted.withColumn("arrival", -F.unix_date("Date").cast("long"))
    assert len(lk.verify_no_leakage(back, cols, order="arrival", raise_on_error=False)["issues"]) == 1
    assert checked_feature_table(daily(spark, walk)).count() == 99


@pytest.mark.parametrize("width", [1 << 20, 7, 1])
def test_order_violations_across_ranges(spark, width):
    rng = np.random.default_rng(5)
    day = rng.integers(0, 50, 300)
    rows = [("A", int(d), i) for i, d in enumerate(day)] + [("B", i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "Symbol string, Date int, ingest_seq long")
    got = {r["Symbol"]: r["violations"] for r in lk.order_violations(df, width=width).collect()}
    assert got == {"A": int((np.diff(day) < 0).sum()), "B": 0}


def test_top_features(spark):
    feats, shap, raw = ["rsi_14", "macd", "bb_pct_b", "volume_ratio"], [0.15, -0.45, 0.05, -0.02], [55.0, 1.2, None, 0.9]
    df = spark.range(1)
    arr = rec.attribution_list(
        feats, {f: F.lit(s) for f, s in zip(feats, shap)}, {f: F.lit(v) for f, v in zip(feats, raw)}
    )
    top = df.select(rec.top_features(arr, 3).alias("t")).head()["t"]
    assert [t["feature"] for t in top] == ["macd", "rsi_14", "bb_pct_b"] and top[2]["raw_value"] == 0.0
    ties = rec.attribution_list(list("xyz"), {c: F.lit(1.0) for c in "xyz"}, {c: F.lit(0.0) for c in "xyz"})
    assert [t["feature"] for t in df.select(rec.top_features(ties, 2).alias("t")).head()["t"]] == ["x", "y"]


def test_record_defaults_and_positions(spark):
    rows = [("train", s, f"2020-01-0{d}", float(d)) for s in ("B", "A") for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "split string, Symbol string, Date string, rsi_14 double").withColumn("Date", F.to_date("Date"))
    out = rec.instruction_records(df, None, ["rsi_14"]).orderBy("row_id").collect()
    assert [r["row_id"] for r in out] == list(range(6)) and out[0]["Symbol"] == "A"
    assert [r["task_type"] for r in out] == list(rec.TASKS)
    user = out[0]["messages"][1]["content"].split("\n")
    assert user[:5] == [
        "TASK: SIGNAL_EXPLANATION", "MODEL_PREDICTION: BUY", "CONFIDENCE_LEVEL: HIGH",
        "PROBABILITIES: {'BUY': 0.7, 'HOLD': 0.2, 'SELL': 0.1}", "TOP_SHAP_FEATURES:",
    ]
    assert user[5] == "  - RSI_14: value=65.2000, contribution=+0.4500" and user[-1] == "  - rsi_14: 1.0000"
    assert rec.instruction_records(df, None, ["rsi_14"], limit=4).count() == 4


def test_texts(spark):
    df = spark.createDataFrame(
        [("BUY", "The CEO said news guarantees profit", ["macd"]), ("SELL", "Sell because RSI_14 and macd agree", ["rsi_14", "macd"]), ("HOLD", "x", [])],
        "label string, text string, features array<string>",
    )
    bad, good, none = te.evaluate_texts(df).collect()
    assert bad["hallucinations"] == ["ceo", "news"] and bad["causal_claims"] == ["guarantees"] and not bad["signal_consistent"]
    assert good["grounding_score"] == 1.0 and good["signal_consistent"] and not good["hallucination_detected"]
    assert none["grounding_score"] == 0.0


def test_long_conversation_continues_in_parts(spark):
    df = spark.range(25).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    parts = te.flatten_chat(te.conversation_records(df, 10)).orderBy("part").collect()
    assert len(parts) == 3
    assert "".join(p["text"] for p in parts) == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(25))


def test_threshold_bounds_are_exclusive(spark):
    df = spark.createDataFrame([(0.01,), (-0.01,), (0.02,)], "return_1d double")
    r = st.threshold_sweep(df, thresholds=(0.01,)).head()
    assert (r["sell_count"], r["hold_count"], r["buy_count"]) == (0, 2, 1)


def test_ratio_floor(spark):
    df = spark.createDataFrame([(0.5815364718, 0.4447329640, 0.5996226668)], "baseline_confidence double, top_confidence double, control_confidence double")
    assert ex.row_faithfulness(df).head()["faithfulness_ratio"] == pytest.approx(13680.35, abs=0.01)
    assert ex.explainer_kind("kernel_shap") == "kernel" and ex.explainer_kind("tree_shap") == "tree"


def test_registry():
    assert list_models() == ["xgboost", "lightgbm", "random_forest", "neural_baseline"]
    with pytest.raises(KeyError, match="known: "):
        get("nothing")


@pytest.fixture(scope="module")
def small(spark):
    """Two features that matter and one that does not; three classes."""
    rng = np.random.default_rng(7)
    n = 900
    x = rng.normal(size=(n, 3))
    y = np.digitize(x[:, 0] + 0.3 * x[:, 1], [-0.5, 0.5])
    p = pd.DataFrame(x, columns=["f0", "f1", "f2"])
    p["target_cls_h1"], p["row_id"] = y, np.arange(n)
    p["split"] = np.where(p.row_id < 600, "train", np.where(p.row_id < 750, "validation", "test"))
    p["Symbol"] = np.where(p.row_id % 2 == 0, "A", "B")
    return spark.createDataFrame(p).cache()


SMALL = {
    "random_forest": dict(numTrees=10, maxDepth=5),
    "lightgbm": dict(maxIter=3),
    "neural_baseline": dict(hidden=(8,), maxIter=50),
}


@pytest.mark.parametrize("name", SMALL)
def test_models_learn_and_score(small, name):
    feats = ["f0", "f1", "f2"]
    model = train(small, feats, model=name, **SMALL[name])
    scored = model.predict(small)
    assert scored.count() == 900 and model.features == feats
    r = scored.agg(
        F.min(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b)).alias("lo"),
        F.max(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b)).alias("hi"),
        F.avg((F.col("prediction") == F.col("target_cls_h1")).cast("int")).alias("acc"),
    ).head()
    assert r["lo"] == pytest.approx(1) and r["hi"] == pytest.approx(1) and r["acc"] > 0.75


def test_train_eval_saves_and_loads(spark, small, tmp_path):
    model, by_split, per_symbol = train_eval(
        small, ["f0", "f1", "f2"], target_column(small), "random_forest", str(tmp_path), **SMALL["random_forest"]
    )
    assert {r["split"] for r in by_split.collect()} == {"validation", "test"}
    assert {r["Symbol"] for r in per_symbol.collect()} == {"A", "B"}
    again = Model.load(str(tmp_path / "model"))
    first = lambda x: [r["probability"] for r in x.score(small.where("row_id < 5")).orderBy("row_id").collect()]
    assert first(again) == first(model)
    assert set(model.importances()) == {"f0", "f1", "f2"}


def test_shapley_adds_up(small):
    feats = ["f0", "f1", "f2"]
    model = train(small, feats, model="random_forest", **SMALL["random_forest"])
    center = small.sparkSession.createDataFrame([(0, 900, [0.1, -0.2, 0.3])], "center int, size long, values array<double>")
    rows = small.where("row_id < 30")
    attributions = ex.shapley(model, rows, center, permutations=6).cache()
    base = model.score(small.sparkSession.createDataFrame([center.head()["values"]], feats)).head()["probability"]
    want = {r["row_id"]: np.array(r["probability"]) - np.array(base) for r in model.score(rows).collect()}
    got = attributions.groupBy("row_id", "class").agg(F.sum("attribution").alias("s")).collect()
    assert len(got) == 90
    for r in got:
        assert r["s"] == pytest.approx(want[r["row_id"]][r["class"]], abs=1e-12)
    ranked = ex.global_importance(attributions).collect()
    assert ranked[0]["feature"] == "f0" and ranked[-1]["feature"] == "f2"
    sizes = ex.background(small, feats, 10).agg(F.count("*"), F.sum("size")).head()
    assert tuple(sizes) == (10, 900)


def test_masking_matters_more_for_the_top_feature(small):
    model = train(small, ["f0", "f1", "f2"], model="random_forest", **SMALL["random_forest"])
    out = ex.masked_confidences(model, small.where("split = 'test'"), "f0", "f2")
    s = ex.faithfulness_summary(out.withColumn("model", F.lit("rf"))).head()
    assert s["instances"] == 150 and s["top_drop_mean"] > s["control_drop_mean"]
    assert out.agg(F.sum("f0")).head()[0] == pytest.approx(small.where("split = 'test'").agg(F.sum("f0")).head()[0])
