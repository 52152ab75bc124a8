"""Profiles of bars and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import BARS, FEATURE_SQL, FEATURES, PREDICTIONS, RAW, TABLE_SQL, query, r, rounded
from tidemark.catalog.features import CONFIG, features, table
from tidemark.catalog.metrics import scores_sql
from tidemark.operators import kept_profile as kp
from tidemark.operators import profile as pf
from tidemark.operators.stats import seeded_sample, threshold_sweep
from tidemark.plans.features import feature_metadata as plan_metadata
from tidemark.sources.sinks import write_metadata
from tidemark.sources.storage import fresh_path, stored

_PROFILED = ["Symbol", "Date", "Open", "High", "Low", "Close", "Volume", "ingest_seq"]
_TYPES = dict(Symbol="string", Date="date", ingest_seq="bigint")


@query(
    "dataset_profile",
    f"WITH {RAW} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{_TYPES.get(c, 'double')}' AS dtype, count(*) - count({c}) AS missing, "
        f"{r(f'(count(*) - count({c})) * 100.0E0 / count(*)')} AS missing_pct, count(DISTINCT {c}) AS unique_values FROM raw_bars"
        for c in _PROFILED
    ),
)
def dataset_profile(spark, sf):
    return rounded(pf.dataset_profile(fx.raw_bars(spark, sf), _PROFILED))


_LOADS = ("1996-01-01", "1999-01-01")


def kept_parts(spark, sf):
    """All raw bars in three loads by date, the second of them written twice."""
    path = fresh_path(spark, "profile")
    raw = stored(fx.raw_bars(spark, sf), "raw").withColumn("year", F.year("Date"))
    first, last = (F.lit(d).cast("date") for d in _LOADS)
    spans = {"a": F.col("Date") < first, "b": (F.col("Date") >= first) & (F.col("Date") < last), "c": F.col("Date") >= last}
    for load in ("a", "b", "c", "b"):
        kp.add_load(raw.where(spans[load]), path, load, _PROFILED, ("Symbol", "year"))
    return kp.read_parts(spark, path), raw


@query(
    "kept_profile",
    f"WITH {RAW} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{_TYPES.get(c, 'double')}' AS dtype, count(*) AS n, count(*) - count({c}) AS missing, "
        f"{r(f'(count(*) - count({c})) * 100.0E0 / count(*)')} AS missing_pct, count(DISTINCT {c}) AS unique_values, TRUE AS sketch_close FROM raw_bars"
        for c in _PROFILED
    ),
)
def kept_profile(spark, sf):
    """The merged profile beside a full pass: counts equal, the sketch within its bound."""
    parts, raw = kept_parts(spark, sf)
    exact = pf.dataset_profile(raw, _PROFILED).select("column", F.col("unique_values").alias("exact"))
    both = kp.kept_profile(parts).join(exact, "column")
    close = F.abs(F.col("unique_values") - F.col("exact")) <= F.col("exact") * kp.DISTINCT_ERROR
    return rounded(both.select("column", "dtype", "n", "missing", "missing_pct", F.col("exact").alias("unique_values"), close.alias("sketch_close")))


@query(
    "kept_distribution",
    f"WITH {RAW} SELECT CAST(year(Date) AS VARCHAR) AS value, count(*) AS n, {r('count(*) * 100.0E0 / sum(count(*)) OVER ()')} AS percentage "
    f"FROM raw_bars GROUP BY 1 UNION ALL SELECT Symbol, count(*), {r('count(*) * 100.0E0 / sum(count(*)) OVER ()')} FROM raw_bars GROUP BY 1",
)
def kept_distribution(spark, sf):
    parts, _ = kept_parts(spark, sf)
    return rounded(kp.kept_distribution(parts, "year").unionByName(kp.kept_distribution(parts, "Symbol")))


_PRICES = ["Open", "High", "Low", "Close", "Volume"]


@query(
    "column_roles",
    f"WITH {TABLE_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{'price' if c in _PRICES else 'feature'}' AS role, count({x}) AS n, "
        f"count(CASE WHEN target_label = 'BUY' THEN {x} END) AS n_buy FROM ftable"
        for c, x in [*((c, c) for c in _PRICES + FEATURES), ("turnover", "CASE WHEN day(Date) <> 5 THEN Close END")]
    ),
)
def column_roles(spark, sf):
    """The columns a model may see, a decimal one among them, and the label found by its candidates."""
    some = F.when(F.dayofmonth("Date") != 5, F.col("Close") * F.col("Volume")).cast("decimal(18,2)")
    df = table(spark, sf).withColumn("turnover", some)
    label = pf.find_column(df, ("label", "target_label", "target"))
    known = set(pf.feature_columns(df))
    columns = pf.numeric_columns(df)
    seen = [
        F.struct(
            F.lit("feature" if c in known else "price").alias("role"),
            F.count(c).alias("n"),
            F.count(F.when(F.col(label) == "BUY", F.col(c))).alias("n_buy"),
        ).alias(c)
        for c in columns
    ]
    return df.agg(*seen).unpivot([], columns, "column", "s").select("column", "s.*")


@query(
    "ticker_distribution",
    f"WITH {BARS} SELECT Symbol, count(*) AS observations, "
    f"{r('count(*) * 100.0E0 / sum(count(*)) OVER ()')} AS percentage FROM bars GROUP BY Symbol",
)
def ticker_distribution(spark, sf):
    return rounded(pf.ticker_distribution(fx.bars(spark, sf)))


@query(
    "ticker_top",
    f"WITH {BARS} SELECT Symbol, count(*) AS observations, "
    f"{r('count(*) * 100.0E0 / sum(count(*)) OVER ()')} AS percentage FROM bars GROUP BY Symbol "
    "ORDER BY observations DESC, Symbol LIMIT 30",
)
def ticker_top(spark, sf):
    return rounded(pf.ticker_distribution(fx.bars(spark, sf), top=30))


@query(
    "yearly_distribution",
    f"WITH {BARS} SELECT CAST(year(Date) AS INTEGER) AS year, count(*) AS observations FROM bars GROUP BY 1",
)
def yearly_distribution(spark, sf):
    return pf.yearly_distribution(fx.bars(spark, sf))


@query(
    "label_by_year",
    f"WITH {TABLE_SQL} SELECT CAST(year(Date) AS INTEGER) AS year, "
    + ", ".join(
        r(f"sum(CASE WHEN target_label = '{v}' THEN 1 ELSE 0 END) * 100.0E0 / count(*)") + f" AS pct_{v}"
        for v in ("SELL", "HOLD", "BUY")
    )
    + " FROM ftable GROUP BY 1",
)
def label_by_year(spark, sf):
    return rounded(pf.label_by_year(table(spark, sf), "target_label", ("SELL", "HOLD", "BUY")))


@query(
    "feature_summary",
    f"WITH {FEATURE_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS \"count\", {r(f'avg({c})', 3)} AS mean, {r(f'stddev_samp({c})', 3)} AS std, "
        f"{r(f'min({c})', 3)} AS min, {r(f'max({c})', 3)} AS max, "
        f"{r(f'(count(*) - count({c})) * 100.0E0 / count(*)', 3)} AS missing_pct, "
        f"{r(f'quantile_cont({c}, 0.25)', 3)} AS q25, {r(f'quantile_cont({c}, 0.5)', 3)} AS q50, "
        f"{r(f'quantile_cont({c}, 0.75)', 3)} AS q75 FROM ind"
        for c in FEATURES
    ),
)
def feature_summary(spark, sf):
    from tidemark.operators.indicators import add_indicators

    full = add_indicators(fx.split_bars(spark, sf), CONFIG.indicators()).select(*FEATURES)
    return rounded(pf.feature_summary(stored(full, "features"), FEATURES), 3)


_CORR = [(a, b) for a in FEATURES for b in FEATURES]


@query(
    "feature_correlation",
    f"WITH {FEATURE_SQL}, c AS (SELECT "
    + ", ".join(f"corr({a}, {b}) AS x{i}" for i, (a, b) in enumerate(_CORR))
    + " FROM feat), u AS (SELECT unnest(["
    + ", ".join(f"{{'f1': '{a}', 'f2': '{b}', 'r': x{i}}}" for i, (a, b) in enumerate(_CORR))
    + f"]) AS s FROM c) SELECT s.f1 AS f1, s.f2 AS f2, {r('s.r')} AS r FROM u",
)
def feature_correlation(spark, sf):
    kept = stored(features(spark, sf).select(*FEATURES), "features")
    return rounded(pf.feature_correlation(kept, FEATURES))


_HIST = FEATURES


def _histogram_sql(source: str, by: str, bins: int) -> str:
    return f"""
rng AS (SELECT {by}, min(value) AS lo, max(value) AS hi FROM {source} GROUP BY {by}),
edges AS (SELECT {by}, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS a, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS b FROM rng),
placed AS (SELECT {by}, a, (b - a) / {bins} AS w, value FROM {source} JOIN edges USING ({by})),
binned AS (SELECT {by}, a, w, CAST(least(floor((value - a) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM placed GROUP BY ALL)
SELECT {by}, bin, {r('a + bin * w', 4)} AS left_edge, {r('a + (bin + 1) * w', 4)} AS right_edge, n FROM binned"""


@query(
    "feature_histogram",
    f"WITH {FEATURE_SQL}, long AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM feat" for c in _HIST)
    + f"), {_histogram_sql('long', 'feature', 50)}",
)
def feature_histogram(spark, sf):
    return rounded(pf.feature_histogram(features(spark, sf), _HIST), 4)


@query(
    "confidence_histogram",
    f"WITH {PREDICTIONS}, long AS (SELECT model, prediction = actual AS correct, confidence AS value FROM predictions), "
    f"{_histogram_sql('long', 'model, correct', 30)}",
)
def confidence_histogram(spark, sf):
    return rounded(pf.confidence_histogram(fx.predictions(spark, sf)), 4)


@query(
    "volatility_regimes",
    f"WITH {FEATURE_SQL}, e AS (SELECT quantile_cont(volatility_20d, 1.0E0 / 3) AS a, quantile_cont(volatility_20d, 2.0E0 / 3) AS b FROM feat) "
    "SELECT CASE WHEN volatility_20d <= a THEN 'Low' WHEN volatility_20d <= b THEN 'Medium' ELSE 'High' END AS volatility_regime, "
    "count(*) AS n FROM feat, e GROUP BY 1",
)
def volatility_regimes(spark, sf):
    return pf.volatility_regimes(stored(features(spark, sf).select("volatility_20d"), "volatility"), "volatility_20d")


@query(
    "market_snapshot",
    f"WITH {BARS}, x AS (SELECT *, max(Date) OVER (PARTITION BY Symbol) AS latest_date FROM bars), "
    "y AS (SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Date DESC) AS k FROM x WHERE Date >= latest_date - INTERVAL 12 MONTH), "
    "z AS (SELECT Symbol, latest_date, max(CASE WHEN k = 1 THEN Close END) AS latest_close, "
    "coalesce(max(CASE WHEN k = 2 THEN Close END), max(CASE WHEN k = 1 THEN Close END)) AS previous_close, "
    "max(High) AS period_high, min(Low) AS period_low, count(*) AS n_rows FROM y GROUP BY Symbol, latest_date) "
    f"SELECT Symbol, latest_date, {r('latest_close')} AS latest_close, {r('previous_close')} AS previous_close, "
    f"{r('period_high')} AS period_high, {r('period_low')} AS period_low, n_rows, "
    f"{r('coalesce((latest_close / nullif(previous_close, 0) - 1) * 100, 0)')} AS change_pct FROM z",
)
def market_snapshot(spark, sf):
    return rounded(pf.market_snapshot(fx.bars(spark, sf), "1y"))


_TAUS = (0.0025, 0.005, 0.0075, 0.01, 0.0125, 0.015, 0.02)


@query(
    "threshold_sweep",
    f"WITH {FEATURE_SQL}, c AS ("
    + " UNION ALL ".join(
        f"SELECT {t!r}E0 AS tau, sum(CASE WHEN return_1d < -{t!r} THEN 1 ELSE 0 END) AS s, "
        f"sum(CASE WHEN return_1d > {t!r} THEN 1 ELSE 0 END) AS b, count(*) AS n FROM feat"
        for t in _TAUS
    )
    + "), d AS (SELECT *, n - s - b AS h FROM c), p AS (SELECT *, s * 1.0E0 / n AS ps, h * 1.0E0 / n AS ph, b * 1.0E0 / n AS pb FROM d) "
    "SELECT round(tau * 100, 2) AS threshold_pct, CAST(s AS BIGINT) AS sell_count, round(ps * 100, 2) AS sell_pct, "
    "CAST(h AS BIGINT) AS hold_count, round(ph * 100, 2) AS hold_pct, CAST(b AS BIGINT) AS buy_count, round(pb * 100, 2) AS buy_pct, "
    "round(-(CASE WHEN ps > 0 THEN ps * log2(ps) ELSE 0 END + CASE WHEN ph > 0 THEN ph * log2(ph) ELSE 0 END "
    "+ CASE WHEN pb > 0 THEN pb * log2(pb) ELSE 0 END), 4) AS entropy_bits, "
    "round(greatest(s, h, b) * 1.0E0 / greatest(1, least(s, h, b)), 2) AS imbalance_ratio FROM p",
)
def sweep(spark, sf):
    return threshold_sweep(features(spark, sf).select("return_1d"))


@query(
    "seeded_sample",
    f"WITH {BARS} SELECT Symbol, Date, Close FROM bars "
    "ORDER BY md5(concat_ws('|', Symbol, CAST(Date AS VARCHAR), '42')), Symbol, Date LIMIT 500",
)
def sample(spark, sf):
    return seeded_sample(fx.bars(spark, sf).select("Symbol", "Date", "Close"), ("Symbol", "Date"), 500)


@query(
    "dataset_summary",
    f"WITH {TABLE_SQL}{PREDICTIONS[len(BARS):]}, own AS (SELECT * FROM predictions WHERE model = 'reversal1'), "
    f"{scores_sql('own', 'model')} SELECT (SELECT count(*) FROM ftable) AS total_rows, 41 AS total_columns, "
    "(SELECT count(DISTINCT Symbol) FROM ftable) AS unique_tickers, (SELECT min(Date) FROM ftable) AS date_start, "
    "(SELECT max(Date) FROM ftable) AS date_end, 28 AS feature_count, "
    f"{r('accuracy')} AS model_accuracy, {r('balanced_accuracy')} AS balanced_accuracy, {r('macro_f1')} AS macro_f1 FROM scores",
)
def dataset_summary(spark, sf):
    own = fx.predictions(spark, sf).where("model = 'reversal1'")
    return rounded(pf.dataset_summary(table(spark, sf), FEATURES, own))


@query(
    "feature_metadata",
    f"WITH {TABLE_SQL} SELECT '{CONFIG.digest()}' AS config_version_hash, 28 AS feature_count, "
    f"'{', '.join(FEATURES)}' AS feature_names, count(*) AS n_rows, min(Date) AS start_date, max(Date) AS end_date FROM ftable",
)
def feature_metadata(spark, sf):
    """Written as JSON metadata and read back."""
    path = fresh_path(spark, "metadata")
    write_metadata(plan_metadata(table(spark, sf), CONFIG), path)
    back = spark.read.schema(
        "config_version_hash string, feature_count int, feature_names array<string>, n_rows long, start_date date, end_date date"
    ).json(path)
    return back.withColumn("feature_names", F.concat_ws(", ", "feature_names"))
