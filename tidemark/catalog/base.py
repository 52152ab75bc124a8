"""Registration of queries and the SQL fragments their twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, so that summation order does not show.

    Spelled with floor on both sides: the engines' own round() break ties apart.
    """

    def value(c: str) -> Column:
        scale = 10.0 ** special.get(c, digits)
        return F.floor(F.col(f"`{c}`") * scale + 0.5) / scale

    return df.select(
        *[value(c).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def r(expr: str, digits: int = 6) -> str:
    scale = f"1E{digits}"
    return f"floor(({expr}) * {scale} + 0.5E0) / {scale}"


def sql_rounded(columns, digits: int = 6, **special: int) -> str:
    return ", ".join(f"{r(c, special.get(c, digits))} AS {c}" for c in columns)


BARS = """
t AS (
  SELECT CAST(l_suppkey AS VARCHAR(20)) AS Symbol, CAST(l_shipdate AS DATE) AS Date,
         l_extendedprice / l_quantity AS px, l_quantity AS q,
         row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS rn,
         row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
           ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC) AS rd
  FROM lineitem),
bars AS (
  SELECT Symbol, Date,
         max(CASE WHEN rn = 1 THEN px END) AS Open, max(px) AS High, min(px) AS Low,
         max(CASE WHEN rd = 1 THEN px END) AS Close, sum(q) AS Volume
  FROM t GROUP BY Symbol, Date)"""

RAW = BARS + """,
b AS (SELECT *, CAST(year(Date) * 10000 + month(Date) * 100 + day(Date) AS BIGINT) AS ymd FROM bars),
f AS (
  SELECT Symbol, Date, ymd,
         CASE WHEN ymd % 53 = 0 THEN NULL ELSE Open END AS Open,
         CASE WHEN ymd % 61 = 0 THEN Low - 1 ELSE High END AS High, Low, Close,
         CASE WHEN ymd % 67 = 0 THEN -Volume ELSE Volume END AS Volume,
         CAST(Symbol AS BIGINT) * 100000000 + ymd AS ingest_seq FROM b),
raw_bars AS (
  SELECT Symbol, Date, Open, High, Low, Close, Volume, ingest_seq FROM f
  UNION ALL
  SELECT Symbol, Date, Open, High, Low, Close * 1.01E0, Volume, ingest_seq + 10000000000000 FROM f WHERE ymd % 29 = 0)"""

DEDUP = RAW + """,
dedup AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY Symbol, Date ORDER BY ingest_seq DESC) AS k FROM raw_bars)
  WHERE k = 1)"""

SPLIT = BARS + """,
sb AS (
  SELECT *, CASE WHEN Date <= DATE '1998-12-31' THEN 'train'
                 WHEN Date <= DATE '2000-06-30' THEN 'validation' ELSE 'test' END AS split FROM bars)"""

PREDICTIONS = BARS + """,
r AS (
  SELECT Symbol, Date,
         Close / lag(Close, 1) OVER (PARTITION BY Symbol ORDER BY Date) - 1 AS r1,
         Close / lag(Close, 5) OVER (PARTITION BY Symbol ORDER BY Date) - 1 AS r5,
         lead(Close, 1) OVER (PARTITION BY Symbol ORDER BY Date) / Close - 1 AS fwd FROM bars),
p AS (
  SELECT Symbol, Date, r1, r5,
         CASE WHEN fwd >= 0.5 THEN 2 WHEN fwd <= -0.5 THEN 0 ELSE 1 END AS actual
  FROM r WHERE fwd IS NOT NULL AND r5 IS NOT NULL),
predictions AS (
  SELECT 'reversal1' AS model, Symbol, Date, actual,
         CASE WHEN r1 >= 0.5 THEN 0 WHEN r1 <= -0.5 THEN 2 ELSE 1 END AS prediction,
         0.4E0 + 0.6E0 * (abs(r1) / (abs(r1) + 1.0E0)) AS confidence FROM p
  UNION ALL
  SELECT 'reversal5', Symbol, Date, actual,
         CASE WHEN r5 >= 0.5 THEN 0 WHEN r5 <= -0.5 THEN 2 ELSE 1 END,
         0.4E0 + 0.6E0 * (abs(r5) / (abs(r5) + 1.0E0)) FROM p
  UNION ALL
  SELECT 'always_hold', Symbol, Date, actual, 1, 0.4E0 FROM p)"""


def _ewm(x: str, a: float, n: int, lead: int, part: str) -> str:
    q = repr(1.0 - a) + "E0"
    return (
        f"CASE WHEN rn - {lead} + 1 >= {n} THEN pow({q}, rn) * "
        f"sum(CASE WHEN rn = {lead} THEN 1.0E0 ELSE {a!r}E0 END * {x} * pow({q}, -rn)) "
        f"OVER (PARTITION BY {part} ORDER BY Date) END"
    )


GAPPY = BARS + """,
gappy AS (
  SELECT Symbol, Date, Open,
         CASE WHEN dayofyear(Date) % 11 <> 5 THEN High END AS High,
         CASE WHEN dayofyear(Date) % 13 <> 6 THEN Low END AS Low,
         CASE WHEN NOT (Date < DATE '1995-02-15' OR dayofyear(Date) % 7 = 3 OR month(Date) = 6) THEN Close END AS Close, Volume
  FROM bars)"""

OPEN_PREDICTIONS = PREDICTIONS + """,
open_predictions AS (
  SELECT model, Symbol, Date, CASE WHEN day(Date) = 9 THEN 3 WHEN day(Date) <> 17 THEN actual END AS actual,
         CASE WHEN day(Date) = 21 THEN 7 WHEN day(Date) <> 25 AND day(Date) <> 17 THEN prediction END AS prediction
  FROM predictions)"""


def gap_means(source: str, out: str, means: dict[str, tuple[str, float, int]]) -> str:
    """CTE ``out``: ``source`` (with rn) and exponential means {name: (column, factor, least values)} over gaps."""
    w = "OVER (PARTITION BY Symbol ORDER BY Date)"
    before = "OVER (PARTITION BY Symbol ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    seen, steps, sums, last = [], [], [], []
    for k, (x, a, n) in means.items():
        left = f"pow({1.0 - a!r}E0, rn - seen_{k})"
        new = f"{x} IS NULL OR seen_{k} IS NULL"
        seen.append(f"last_value(CASE WHEN {x} IS NOT NULL THEN rn END IGNORE NULLS) {before} AS seen_{k}")
        steps.append(f"CASE WHEN {new} THEN 0E0 ELSE -ln({left} / ({left} + {a!r}E0)) END AS e_{k}")
        steps.append(f"CASE WHEN {x} IS NULL THEN 0E0 WHEN seen_{k} IS NULL THEN {x} ELSE {a!r}E0 * {x} / ({left} + {a!r}E0) END AS b_{k}")
        sums.append(f"sum(e_{k}) {w} AS s_{k}")
        last.append(f"CASE WHEN count({x}) {w} >= {n} THEN exp(-s_{k}) * sum(b_{k} * exp(s_{k})) {w} END AS {k}")
    return f"""
{out}_1 AS (SELECT *, {', '.join(seen)} FROM {source}),
{out}_2 AS (SELECT *, {', '.join(steps)} FROM {out}_1),
{out}_3 AS (SELECT *, {', '.join(sums)} FROM {out}_2),
{out} AS (SELECT *, {', '.join(last)} FROM {out}_3)"""


def indicator_sql(source: str, part: str) -> str:
    """CTEs ``ind`` with every default indicator of ``source``, per series ``part``."""

    def roll(agg: str, x: str, n: int) -> str:
        frame = f"OVER (PARTITION BY {part} ORDER BY Date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count({x}) {frame} = {n} THEN {agg}({x}) {frame} END"

    w = f"OVER (PARTITION BY {part} ORDER BY Date)"
    lag = lambda h: f"lag(Close, {h}) {w}"
    span = lambda n: 2.0 / (n + 1.0)
    return f"""
i0 AS (
  SELECT *, row_number() {w} - 1 AS rn, {lag(1)} AS c1,
         Close / {lag(1)} - 1 AS return_1d, Close / {lag(5)} - 1 AS return_5d,
         Close / {lag(10)} - 1 AS return_10d, Close / {lag(20)} - 1 AS return_20d,
         {roll('avg', 'Close', 20)} AS sma_20, {roll('avg', 'Close', 50)} AS sma_50,
         {roll('stddev_samp', 'Close', 20)} AS dev_20,
         {roll('min', 'Low', 14)} AS lo, {roll('max', 'High', 14)} AS hi,
         {roll('avg', 'Volume', 20)} AS volume_sma_20
  FROM {source}),
i1 AS (
  SELECT *, {_ewm('Close', span(20), 20, 0, part)} AS ema_20, {_ewm('Close', span(50), 50, 0, part)} AS ema_50,
         ({_ewm('Close', span(12), 12, 0, part)}) - ({_ewm('Close', span(26), 26, 0, part)}) AS macd,
         CASE WHEN c1 IS NOT NULL THEN greatest(Close - c1, 0) END AS gain,
         CASE WHEN c1 IS NOT NULL THEN greatest(c1 - Close, 0) END AS loss,
         greatest(High - Low, abs(High - c1), abs(Low - c1)) AS true_range,
         100 * (Close - lo) / nullif(hi - lo, 0) AS stoch_k,
         coalesce(sign(Close - c1), 0) * Volume AS flow
  FROM i0),
i2 AS (
  SELECT *, {_ewm('macd', span(9), 9, 25, part)} AS macd_signal,
         {_ewm('gain', 1 / 14, 14, 1, part)} AS mean_gain, {_ewm('loss', 1 / 14, 14, 1, part)} AS mean_loss,
         {_ewm('true_range', 1 / 14, 14, 0, part)} AS atr_14,
         {roll('avg', 'stoch_k', 3)} AS stoch_d,
         {roll('stddev_samp', 'return_1d', 10)} AS volatility_10d, {roll('stddev_samp', 'return_1d', 20)} AS volatility_20d,
         sum(flow) {w} AS obv,
         sma_20 + 2 * dev_20 AS bb_upper, sma_20 - 2 * dev_20 AS bb_lower
  FROM i1),
ind AS (
  SELECT *, (Close - sma_20) / nullif(sma_20, 0) AS price_vs_sma20, (Close - sma_50) / nullif(sma_50, 0) AS price_vs_sma50,
         macd - macd_signal AS macd_hist,
         CASE WHEN mean_loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + mean_gain / nullif(mean_loss, 0)) END AS rsi_14,
         atr_14 / nullif(Close, 0) AS atr_ratio, sma_20 AS bb_middle,
         (bb_upper - bb_lower) / nullif(sma_20, 0) AS bb_bandwidth,
         (Close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_pct_b,
         Volume / nullif(volume_sma_20, 0) AS volume_ratio
  FROM i2)"""


BASE_COLUMNS = ["Symbol", "Date", "split", "Open", "High", "Low", "Close", "Volume"]
# The 28 default features, in table order.
FEATURES = [
    "sma_20", "sma_50", "ema_20", "ema_50", "price_vs_sma20", "price_vs_sma50",
    "macd", "macd_signal", "macd_hist", "rsi_14", "stoch_k", "stoch_d",
    "atr_14", "atr_ratio", "bb_upper", "bb_middle", "bb_lower", "bb_bandwidth", "bb_pct_b",
    "volatility_10d", "volatility_20d", "volume_sma_20", "volume_ratio", "obv",
    "return_1d", "return_5d", "return_10d", "return_20d",
]
TARGETS = ["target_classification", "target_label", "target_return_1d", "target_return_5d", "target_return_10d"]

FEATURE_SQL = SPLIT + "," + indicator_sql("sb", "split, Symbol") + f""",
feat AS (
  SELECT {', '.join(BASE_COLUMNS + FEATURES)} FROM ind
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)})"""

TABLE_SQL = FEATURE_SQL + """,
t1 AS (
  SELECT * EXCLUDE (fwd),
         CASE WHEN fwd >= 0.5 THEN 2 WHEN fwd <= -0.5 THEN 0 ELSE 1 END AS target_classification,
         CASE WHEN fwd >= 0.5 THEN 'BUY' WHEN fwd <= -0.5 THEN 'SELL' ELSE 'HOLD' END AS target_label
  FROM (SELECT *, lead(Close, 1) OVER (PARTITION BY split, Symbol ORDER BY Date) / Close - 1 AS fwd FROM feat)
  WHERE fwd IS NOT NULL),
ftable AS (
  SELECT * FROM (
    SELECT *, lead(Close, 1) OVER w / Close - 1 AS target_return_1d,
           lead(Close, 5) OVER w / Close - 1 AS target_return_5d,
           lead(Close, 10) OVER w / Close - 1 AS target_return_10d
    FROM t1 WINDOW w AS (PARTITION BY split, Symbol ORDER BY Date))
  WHERE target_return_1d IS NOT NULL)"""
