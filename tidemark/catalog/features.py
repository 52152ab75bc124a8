"""Indicators, feature tables, targets and leakage checks."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import (
    BARS,
    FEATURE_SQL,
    FEATURES,
    GAPPY,
    SPLIT,
    TABLE_SQL,
    TARGETS,
    gap_means,
    indicator_sql,
    query,
    r,
    rounded,
    sql_rounded,
)
from tidemark.operators import indicators as ind
from tidemark.operators.indicators import add_indicators
from tidemark.operators.leakage import name_checks, shift_checks
from tidemark.operators.profile import feature_quality
from tidemark.operators.targets import classification_target, forward_returns
from tidemark.plans import features as plan
from tidemark.sources.storage import stored

CONFIG = plan.FeatureConfig(buy=fx.BUY, sell=fx.SELL)
# Price-scale values carry fewer exact decimals than ratios do.
DIGITS = 4


def features(spark, sf):
    return plan.build_features(fx.split_bars(spark, sf), CONFIG)


def table(spark, sf):
    return plan.feature_table(fx.split_bars(spark, sf), CONFIG)


_IND = f"WITH {BARS}, {indicator_sql('bars', 'Symbol')}"


def indicator(name: str, *recipes, columns: list[str] | None = None, digits: int = DIGITS):
    columns = columns or [c for i in recipes for c in i.columns]

    def run(spark, sf):
        out = add_indicators(fx.bars(spark, sf), recipes)
        return rounded(out.select("Symbol", "Date", *columns), digits)

    query(name, f"{_IND} SELECT Symbol, Date, {sql_rounded(columns, digits)} FROM ind")(run)


indicator("sma", ind.sma(20), ind.sma(50))
indicator("ema", ind.ema(20), ind.ema(50))
indicator("price_vs_sma", ind.price_vs_sma(20), ind.price_vs_sma(50), digits=6)
indicator("rsi", ind.rsi(14))
indicator("macd", ind.macd())
indicator("stochastic", ind.stochastic())
indicator("volume_sma", ind.volume_sma(20))
indicator("volume_ratio", ind.volume_ratio(20), digits=6)
indicator("obv", ind.obv())
indicator("atr", ind.true_range(), ind.atr(14))
indicator("bollinger", ind.bollinger())
indicator("rolling_volatility", ind.rolling_volatility(), digits=6)
indicator("lagged_returns", ind.lagged_returns(), digits=6)


_GAPS = f"""WITH {GAPPY},
g0 AS (
  SELECT *, row_number() OVER (PARTITION BY Symbol ORDER BY Date) - 1 AS rn, lag(Close) OVER (PARTITION BY Symbol ORDER BY Date) AS c1 FROM gappy),
g AS (
  SELECT *, greatest(Close - c1, CASE WHEN Close - c1 IS NOT NULL THEN 0E0 END) AS gain,
         greatest(c1 - Close, CASE WHEN Close - c1 IS NOT NULL THEN 0E0 END) AS loss,
         greatest(High - Low, abs(High - c1), abs(Low - c1)) AS true_range FROM g0),"""


def over_gaps(name: str, ctes: str, values: dict[str, str], *recipes):
    """A query of exponential means over bars with gaps."""

    def run(spark, sf):
        out = add_indicators(fx.gappy_bars(spark, sf), recipes)
        return rounded(out.select("Symbol", "Date", *values), DIGITS)

    columns = ", ".join(f"{r(v, DIGITS)} AS {k}" for k, v in values.items())
    query(name, f"{_GAPS}{ctes} SELECT Symbol, Date, {columns} FROM y")(run)


def _span(n: int) -> float:
    return 2.0 / (n + 1.0)


over_gaps(
    "ema_gaps",
    gap_means("g", "y", {"ema_20": ("Close", _span(20), 20), "ema_50": ("Close", _span(50), 50)}),
    {"ema_20": "ema_20", "ema_50": "ema_50"},
    ind.ema(20), ind.ema(50),
)
over_gaps(
    "macd_gaps",
    gap_means("g", "m", {"fast": ("Close", _span(12), 12), "slow": ("Close", _span(26), 26)})
    + ", m2 AS (SELECT *, fast - slow AS macd FROM m),"
    + gap_means("m2", "y", {"macd_signal": ("macd", _span(9), 9)}),
    {"macd": "macd", "macd_signal": "macd_signal", "macd_hist": "macd - macd_signal"},
    ind.macd(),
)
over_gaps(
    "rsi_gaps",
    gap_means("g", "y", {"up": ("gain", 1 / 14, 14), "down": ("loss", 1 / 14, 14)}),
    {"rsi_14": "CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / nullif(down, 0)) END"},
    ind.rsi(14),
)
over_gaps(
    "atr_gaps",
    gap_means("g", "y", {"atr_14": ("true_range", 1 / 14, 14)}),
    {"atr_14": "atr_14", "atr_ratio": "atr_14 / nullif(Close, 0)"},
    ind.atr(14),
)


@query(
    "log_returns",
    f"WITH {BARS} SELECT Symbol, Date, "
    + ", ".join(
        f"{r(f'ln(Close / lag(Close, {h}) OVER (PARTITION BY Symbol ORDER BY Date))')} AS return_{h}d"
        for h in (1, 5)
    )
    + " FROM bars",
)
def log_returns(spark, sf):
    out = add_indicators(fx.bars(spark, sf), [ind.lagged_returns((1, 5), log=True)])
    return rounded(out.select("Symbol", "Date", "return_1d", "return_5d"))


@query(
    "feature_matrix",
    f"WITH {SPLIT}, {indicator_sql('sb', 'split, Symbol')} "
    f"SELECT split, Symbol, Date, {sql_rounded(FEATURES, DIGITS)} FROM ind",
)
def feature_matrix(spark, sf):
    out = add_indicators(fx.split_bars(spark, sf), CONFIG.indicators())
    return rounded(out.select("split", "Symbol", "Date", *FEATURES), DIGITS)


@query(
    "warmup_drop",
    f"WITH {FEATURE_SQL}, n AS (SELECT split, Symbol, count(*) AS kept FROM feat GROUP BY split, Symbol) "
    "SELECT sb.split, sb.Symbol, count(*) AS initial_rows, coalesce(max(kept), 0) AS kept_rows, "
    "count(*) - coalesce(max(kept), 0) AS dropped_rows "
    "FROM sb LEFT JOIN n ON sb.split = n.split AND sb.Symbol = n.Symbol GROUP BY sb.split, sb.Symbol",
)
def warmup_drop(spark, sf):
    out = add_indicators(fx.split_bars(spark, sf), CONFIG.indicators())
    complete = ~F.greatest(*[F.col(c).isNull() for c in FEATURES])
    return out.groupBy("split", "Symbol").agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(complete).alias("kept_rows"),
        F.count_if(~complete).alias("dropped_rows"),
    )


@query(
    "target_class",
    f"WITH {BARS}, x AS (SELECT *, lead(Close, 1) OVER (PARTITION BY Symbol ORDER BY Date) / Close - 1 AS fwd FROM bars) "
    "SELECT Symbol, Date, CASE WHEN fwd >= 0.5 THEN 2 WHEN fwd <= -0.5 THEN 0 ELSE 1 END AS target_classification, "
    "CASE WHEN fwd >= 0.5 THEN 'BUY' WHEN fwd <= -0.5 THEN 'SELL' ELSE 'HOLD' END AS target_label "
    "FROM x WHERE fwd IS NOT NULL",
)
def target_class(spark, sf):
    out = classification_target(fx.bars(spark, sf), 1, fx.BUY, fx.SELL)
    return out.select("Symbol", "Date", "target_classification", "target_label")


@query(
    "target_returns",
    f"WITH {BARS}, x AS (SELECT Symbol, Date, "
    + ", ".join(f"lead(Close, {h}) OVER w / Close - 1 AS target_return_{h}d" for h in (1, 5, 10))
    + " FROM bars WINDOW w AS (PARTITION BY Symbol ORDER BY Date)) SELECT Symbol, Date, "
    + sql_rounded([f"target_return_{h}d" for h in (1, 5, 10)])
    + " FROM x WHERE target_return_1d IS NOT NULL",
)
def target_returns(spark, sf):
    from tidemark.operators.targets import regression_targets

    out = regression_targets(fx.bars(spark, sf), (1, 5, 10))
    return rounded(out.select("Symbol", "Date", *[f"target_return_{h}d" for h in (1, 5, 10)]))


@query(
    "feature_table",
    f"WITH {TABLE_SQL} SELECT split, Symbol, Date, {sql_rounded(FEATURES + TARGETS[2:], DIGITS)}, "
    "target_classification, target_label FROM ftable",
)
def feature_table(spark, sf):
    return rounded(table(spark, sf).select("split", "Symbol", "Date", *FEATURES, *TARGETS), DIGITS)


@query(
    "label_distribution",
    f"WITH {TABLE_SQL} SELECT target_label AS target, count(*) AS n, "
    f"{r('count(*) * 100.0E0 / sum(count(*)) OVER ()')} AS percentage FROM ftable GROUP BY target_label",
)
def label_distribution(spark, sf):
    from tidemark.operators.profile import label_distribution as shares

    return rounded(shares(table(spark, sf).select("target_label"), "target_label"))


@query(
    "split_summary",
    f"WITH {TABLE_SQL}, a AS (SELECT split, count(*) AS initial_rows FROM sb GROUP BY split), "
    "b AS (SELECT split, count(*) AS complete_rows FROM feat GROUP BY split), "
    "c AS (SELECT split, count(*) AS final_rows, "
    + ", ".join(
        f"CAST(sum(CASE WHEN target_classification = {k} THEN 1 ELSE 0 END) AS BIGINT) AS n_{n}"
        for k, n in ((0, "sell"), (1, "hold"), (2, "buy"))
    )
    + ", min(Date) AS start_date, max(Date) AS end_date FROM ftable GROUP BY split) "
    "SELECT split, initial_rows, final_rows, n_sell, n_hold, n_buy, start_date, end_date, "
    "initial_rows - complete_rows AS warmup_rows_dropped FROM a JOIN b USING (split) JOIN c USING (split)",
)
def split_summary(spark, sf):
    from tidemark.operators.targets import regression_targets

    # One pass over the bars: what is counted and what targets look at, with a mark on complete rows.
    built = plan.build_features(fx.split_bars(spark, sf), replace(CONFIG, drop_warmup=False))
    given = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    complete = reduce(and_, [given(c) for c in CONFIG.columns()])
    bars = stored(built.select("split", "Symbol", "Date", "Close", complete.alias("complete")), "features")
    feats = bars.where("complete").drop("complete")
    labelled = classification_target(feats, CONFIG.label_horizon, CONFIG.buy, CONFIG.sell)
    return plan.split_summary(bars, feats, regression_targets(labelled, CONFIG.return_horizons))


@query(
    "feature_quality",
    f"WITH {FEATURE_SQL} "
    + " UNION ALL ".join(
        f"SELECT split, '{c}' AS feature, 'double' AS dtype, count(*) - count({c}) AS nan_count, "
        f"CAST(0 AS BIGINT) AS inf_count, round(min({c}), 4) AS min, round(max({c}), 4) AS max, "
        f"round(avg({c}), 4) AS mean, CASE WHEN count(*) > count({c}) THEN 'FAIL_NAN_OR_INF' ELSE 'PASS' END AS status "
        "FROM ind GROUP BY split"
        for c in FEATURES
    ),
)
def quality(spark, sf):
    out = add_indicators(fx.split_bars(spark, sf), CONFIG.indicators())
    return feature_quality(out, FEATURES)


@query(
    "feature_categories",
    f"WITH {FEATURE_SQL}, n AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n_values FROM ind" for c in FEATURES)
    + "), c AS (SELECT feature, n_values, unnest(["
    "CASE WHEN feature LIKE '%sma%' OR feature LIKE '%ema%' OR feature LIKE '%macd%' THEN 'trend' END, "
    "CASE WHEN feature LIKE '%rsi%' OR feature LIKE '%stoch%' THEN 'momentum' END, "
    "CASE WHEN feature LIKE '%atr%' OR feature LIKE '%bb\\_%' ESCAPE '\\' OR feature LIKE '%volatility%' THEN 'volatility' END, "
    "CASE WHEN feature LIKE '%volume%' OR feature LIKE '%obv%' THEN 'volume' END, "
    "CASE WHEN feature LIKE 'return\\_%' ESCAPE '\\' THEN 'returns' END]) AS category FROM n) "
    "SELECT category, feature, n_values FROM c WHERE category IS NOT NULL",
)
def categories(spark, sf):
    out = add_indicators(fx.split_bars(spark, sf), CONFIG.indicators())
    return plan.feature_categories(out, FEATURES)


_NAMES = [*FEATURES, "target_return_5d", *TARGETS]


@query(
    "leakage_names",
    f"WITH {TABLE_SQL}, n AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_values, {c in FEATURES or c == 'target_return_5d'} AS is_feature, "
        f"{c in TARGETS} AS is_target FROM ftable"
        for c in dict.fromkeys(_NAMES)
    )
    + ') SELECT *, "column" LIKE \'target%\' AS forbidden_name, is_feature AND is_target AS target_in_features FROM n',
)
def leakage_names(spark, sf):
    """One target slipped in among the features."""
    return name_checks(table(spark, sf), [*FEATURES, "target_return_5d"], TARGETS)


_SHIFTED = ["sma_20", "rsi_14", "return_1d", "sneaky_feature"]


@query(
    "leakage_shift",
    f"WITH {FEATURE_SQL}, s AS (SELECT *, lead(Close, 1) OVER (PARTITION BY split, Symbol ORDER BY Date) AS ahead FROM feat), "
    "z AS (SELECT *, ahead AS sneaky_feature FROM s), g AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, split, Symbol, count(*) AS n, max(abs({c} - ahead)) AS gap, "
        f"count(abs({c} - ahead)) AS valid FROM z GROUP BY split, Symbol"
        for c in _SHIFTED
    )
    + ") SELECT feature, count(*) AS n_series, CAST(sum(CASE WHEN n >= 30 AND valid > 20 AND gap < 1E-7 THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS n_leaking, {r('min(gap)', 4)} AS smallest_gap FROM g GROUP BY feature",
)
def leakage_shift(spark, sf):
    """A planted copy of the next close must be found, real features must not."""
    planted = forward_planted(features(spark, sf))
    return rounded(shift_checks(planted, _SHIFTED), 4)


def forward_planted(df):
    ahead = forward_returns(df, (1,), names=("fwd_gain",))
    return ahead.withColumn("sneaky_feature", F.col("Close") * (F.col("fwd_gain") + 1.0)).drop("fwd_gain")
