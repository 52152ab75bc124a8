"""Bars: symbol lists, scans, cleaning, validation, splits, load log, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import BARS, DEDUP, PREDICTIONS, RAW, SPLIT, TABLE_SQL, query
from tidemark.operators import clean as cl
from tidemark.operators.leakage import order_violations
from tidemark.operators.split import check_split, split_bounds, split_counts
from tidemark.operators.validate import Rules, validate, validation_report
from tidemark.plans.bars import run_metadata as bar_metadata
from tidemark.plans.features import feature_table
from tidemark.sources import bars as src
from tidemark.sources import sinks
from tidemark.sources.storage import fresh_path

PRICED = ["Open", "High", "Low", "Close", "Volume"]
PRICES_SQL = ", ".join(PRICED)
RULES = Rules(min_rows=510)


def suppliers(spark, sf):
    return fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("Symbol"))


def raw_text_bars(spark, sf):
    """Raw bars as a landed CSV would hold them: odd names, text, some junk."""
    raw = fx.raw_bars(spark, sf)
    junk = F.dayofmonth("Date") == 13
    return raw.select(
        F.col("Date").cast("string").alias("datetime"),
        F.col("Open").alias("open"),
        F.col("High").alias("HIGH"),
        F.col("Low").alias(" Low "),
        F.col("Close").alias("adj close"),
        F.when(junk, F.lit("n/a")).otherwise(F.col("Volume").cast("string")).alias("volume"),
        "Symbol",
        "ingest_seq",
    )


@query(
    "ticker_list",
    "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS Symbol FROM lineitem WHERE l_suppkey IS NOT NULL",
)
def ticker_list(spark, sf):
    return src.ticker_list(fx.table(spark, sf, "lineitem"), "l_suppkey")


@query("ticker_text", "SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS Symbol FROM supplier")
def ticker_text(spark, sf):
    path = fresh_path(spark, "tickers")
    suppliers(spark, sf).select(F.concat(F.lit("  "), "Symbol", F.lit(" \n")).alias("value")).write.text(path)
    return src.tickers_from_text(spark, path)


@query("ticker_csv", "SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS Symbol FROM supplier")
def ticker_csv(spark, sf):
    path = fresh_path(spark, "tickers")
    suppliers(spark, sf).withColumnRenamed("Symbol", "Code").write.option("header", True).csv(path)
    return src.tickers_from_csv(spark, path)


@query(
    "scan_bars",
    f"WITH {BARS} SELECT Symbol, Date, {PRICES_SQL} FROM bars "
    "WHERE Date >= DATE '1997-01-01' AND Date < DATE '2000-01-01'",
)
def scan_bars(spark, sf):
    path = fresh_path(spark, "landing")
    fx.bars(spark, sf).withColumnRenamed("Date", "Datetime").write.parquet(path)
    scanned = src.in_range(src.scan_bars(spark, path), "1997-01-01", "2000-01-01")
    return scanned.select("Symbol", "Date", *PRICED)


@query(
    "scan_file_symbol",
    f"WITH {BARS} SELECT Symbol, count(*) AS n_rows, count(DISTINCT Close) AS n_closes FROM bars GROUP BY Symbol",
)
def scan_file_symbol(spark, sf):
    """The folder a CSV lies in names its symbol."""
    path = fresh_path(spark, "landing")
    sinks.write_symbol_csv(fx.bars(spark, sf), path)
    schema = f"Symbol string, {src.BAR_SCHEMA}, file_symbol string"
    back = src.scan_bars(spark, path, "csv", schema, header=True)
    return back.groupBy(F.col("file_symbol").alias("Symbol")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Close").alias("n_closes")
    )


@query(
    "standardize",
    f"WITH {RAW} SELECT Date, Open, High, Low, Close, "
    "CASE WHEN day(Date) = 13 THEN NULL ELSE Volume END AS Volume, Symbol, ingest_seq FROM raw_bars",
)
def standardize(spark, sf):
    out = cl.standardize(raw_text_bars(spark, sf))
    return out.withColumn("Volume", cl.to_number(F.col("Volume")))


@query(
    "coerce_numeric",
    f"WITH {RAW} SELECT Symbol, Date, ingest_seq, Open, High, Low, Close, "
    "CASE WHEN day(Date) = 13 THEN NULL ELSE Volume END AS Volume FROM raw_bars",
)
def coerce_numeric(spark, sf):
    out = cl.coerce_numeric(cl.standardize(raw_text_bars(spark, sf)))
    return out.select("Symbol", "Date", "ingest_seq", *PRICED)


@query(
    "drop_invalid",
    f"WITH {RAW} SELECT Symbol, Date, ingest_seq, {PRICES_SQL} FROM raw_bars "
    "WHERE Open IS NOT NULL AND day(Date) <> 13",
)
def drop_invalid(spark, sf):
    out = cl.drop_invalid(cl.standardize(raw_text_bars(spark, sf)))
    return out.select("Symbol", "Date", "ingest_seq", *PRICED)


@query("dedup_last", f"WITH {DEDUP} SELECT Symbol, Date, {PRICES_SQL}, ingest_seq FROM dedup")
def dedup_last(spark, sf):
    return cl.dedup_last(fx.raw_bars(spark, sf))


_GAPPED = DEDUP + """,
gapped AS (SELECT Symbol, Date, CASE WHEN ingest_seq % 7 IN (1, 2, 3) THEN NULL ELSE Open END AS Open,
                  CASE WHEN ingest_seq % 5 = 0 THEN NULL ELSE High END AS High, Low, Close,
                  CASE WHEN ingest_seq % 11 = 0 THEN NULL ELSE Volume END AS Volume FROM dedup)"""


def _filled(c: str) -> str:
    w = "OVER (PARTITION BY Symbol ORDER BY Date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    return f"last_value({c} IGNORE NULLS) {w} AS {c}"


@query(
    "ffill_limit",
    f"WITH {_GAPPED} SELECT Symbol, Date, {_filled('Open')}, {_filled('High')}, {_filled('Low')}, "
    f"{_filled('Close')}, coalesce(Volume, 0) AS Volume FROM gapped",
)
def ffill_limit(spark, sf):
    seq = F.col("ingest_seq")
    gapped = cl.dedup_last(fx.raw_bars(spark, sf)).select(
        "Symbol",
        "Date",
        F.when(~(seq % 7).isin(1, 2, 3), F.col("Open")).alias("Open"),
        F.when(seq % 5 != 0, F.col("High")).alias("High"),
        "Low",
        "Close",
        F.when(seq % 11 != 0, F.col("Volume")).alias("Volume"),
    )
    return cl.fill_forward(gapped, 2)


_CLEAN_STATS = f"""WITH {DEDUP},
filled AS (SELECT *, last_value(Open IGNORE NULLS) OVER (PARTITION BY Symbol ORDER BY Date
             ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS o FROM dedup)
SELECT Symbol, CAST(max(n_raw) AS BIGINT) AS raw_rows, CAST(sum(CASE WHEN o IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS cleaned_rows,
       CAST(max(n_raw) - count(*) AS BIGINT) AS duplicates_removed,
       CAST(sum(CASE WHEN Open IS NULL AND o IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_filled,
       CAST(sum(CASE WHEN o IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS invalid_rows_dropped
FROM filled JOIN (SELECT Symbol, count(*) AS n_raw FROM raw_bars GROUP BY Symbol) USING (Symbol) GROUP BY Symbol"""


@query("clean_metrics", _CLEAN_STATS)
def clean_metrics(spark, sf):
    return cl.clean_metrics(fx.raw_bars(spark, sf), fill_missing=True, fill_limit=5)


def _validation(source: str) -> str:
    def issue(cond: str, text: str) -> str:
        return f"CASE WHEN {cond} THEN {text} END"

    issues = ", ".join(
        [
            issue("rows = 0", "'DataFrame is empty.'"),
            issue("rows > 0 AND rows < 510", "'Insufficient history: ' || rows || ' rows < minimum 510.'"),
            issue("duplicate_dates > 0", "'Found ' || duplicate_dates || ' duplicate dates.'"),
            issue(
                "ratio > 0.05",
                "'Missing value ratio (' || printf('%.2f', ratio * 100) || '%) exceeds threshold (5.00%).'",
            ),
            issue(
                "ohlc_violations > 0",
                "'Found ' || ohlc_violations || ' rows with OHLC logical inconsistencies (e.g. High < Low or High < Close).'",
            ),
            issue("negative_prices > 0", "'Found ' || negative_prices || ' rows with negative prices.'"),
            issue("negative_volume > 0", "'Found ' || negative_volume || ' rows with negative volume.'"),
        ]
    )
    return f"""
stats AS (
  SELECT Symbol, count(*) AS rows, min(Date) AS start_date, max(Date) AS end_date,
         CAST(count(*) - count(DISTINCT Date) AS BIGINT) AS duplicate_dates,
         CAST(sum(CASE WHEN Open IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_values_total,
         CAST(sum(CASE WHEN High < Open OR High < Close OR High < Low OR Low > Open OR Low > Close THEN 1 ELSE 0 END) AS BIGINT) AS ohlc_violations,
         CAST(sum(CASE WHEN Open < 0 OR High < 0 OR Low < 0 OR Close < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_prices,
         CAST(sum(CASE WHEN Volume < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_volume
  FROM {source} GROUP BY Symbol),
asked AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS Symbol FROM supplier UNION SELECT 'ABSENT.NS'),
full_stats AS (
  SELECT a.Symbol, coalesce(rows, 0) AS rows, start_date, end_date, coalesce(duplicate_dates, 0) AS duplicate_dates,
         coalesce(missing_values_total, 0) AS missing_values_total, coalesce(ohlc_violations, 0) AS ohlc_violations,
         coalesce(negative_prices, 0) AS negative_prices, coalesce(negative_volume, 0) AS negative_volume,
         missing_values_total / (rows * 6.0E0) AS ratio
  FROM asked a LEFT JOIN stats s ON a.Symbol = s.Symbol),
report AS (
  SELECT Symbol AS symbol, rows, start_date, end_date, duplicate_dates, missing_values_total,
         coalesce(round(ratio, 4), 0) AS missing_pct, ohlc_violations, negative_prices, negative_volume,
         concat_ws('; ', {issues}) AS issues_summary
  FROM full_stats)"""


def requested(spark, sf):
    """All suppliers and one symbol nothing was loaded for."""
    extra = fx.table(spark, sf, "supplier").agg(F.lit("ABSENT.NS").alias("Symbol"))
    return suppliers(spark, sf).union(extra)


@query(
    "validate_bars",
    f"WITH {RAW}, {_validation('raw_bars')} SELECT *, issues_summary = '' AS passed FROM report",
)
def validate_bars(spark, sf):
    return validation_report(validate(fx.raw_bars(spark, sf), RULES, requested(spark, sf)))


@query(
    "drop_failed",
    f"WITH {DEDUP}, gone AS (SELECT * FROM dedup WHERE Open IS NOT NULL), "
    "ok AS (SELECT Symbol FROM gone GROUP BY Symbol HAVING count(*) >= 525) "
    "SELECT Symbol, count(*) AS n_rows FROM gone WHERE Symbol IN (SELECT Symbol FROM ok) GROUP BY Symbol",
)
def drop_failed(spark, sf):
    cleaned = cl.clean(fx.raw_bars(spark, sf))
    report = validate(cleaned, Rules(min_rows=525, check_ohlc=False, check_non_negative=False))
    kept = cl.drop_failed(cleaned, report)
    return kept.groupBy("Symbol").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "load_log",
    f"WITH {BARS}, asked AS (SELECT CAST(s_suppkey AS VARCHAR) AS Symbol FROM supplier UNION SELECT 'ABSENT.NS'), "
    "got AS (SELECT Symbol, count(*) AS rows, min(Date) AS start_date, max(Date) AS end_date FROM bars GROUP BY Symbol) "
    "SELECT a.Symbol AS symbol, CASE WHEN rows > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status, "
    "coalesce(rows, 0) AS rows, start_date, end_date FROM asked a LEFT JOIN got g ON a.Symbol = g.Symbol",
)
def load_log(spark, sf):
    return src.load_log(requested(spark, sf), fx.bars(spark, sf))


@query("split_counts", f"WITH {SPLIT} SELECT split, count(*) AS n_rows FROM sb GROUP BY split")
def count_splits(spark, sf):
    return split_counts(fx.split_bars(spark, sf))


@query(
    "split_bounds",
    f"WITH {SPLIT} SELECT *, train_end < validation_start AND validation_end < test_start AS disjoint FROM (SELECT "
    + ", ".join(
        f"{a}(CASE WHEN split = '{s}' THEN Date END) AS {s}_{e}"
        for s in ("train", "validation", "test")
        for a, e in (("min", "start"), ("max", "end"))
    )
    + " FROM sb)",
)
def bounds(spark, sf):
    return split_bounds(fx.split_bars(spark, sf))


@query(
    "union_splits",
    f"WITH {SPLIT} SELECT Symbol, Date, split, {PRICES_SQL} FROM sb",
)
def union_splits(spark, sf):
    """The three splits, one of them without a volume column, put together again."""
    sb = fx.split_bars(spark, sf)
    part = lambda s: sb.where(F.col("split") == s)
    test = part("test").withColumn("V", F.col("Volume")).drop("Volume").withColumnRenamed("V", "Volume")
    out = part("train").unionByName(part("validation")).unionByName(test, allowMissingColumns=True)
    return out


@query(
    "leakage_order",
    f"WITH {RAW}, seen AS (SELECT Symbol, Date, lag(Date) OVER (PARTITION BY Symbol ORDER BY ingest_seq) AS before FROM raw_bars) "
    "SELECT Symbol, count(*) AS n_rows, CAST(sum(CASE WHEN before > Date THEN 1 ELSE 0 END) AS BIGINT) AS violations, "
    "sum(CASE WHEN before > Date THEN 1 ELSE 0 END) = 0 AS ordered FROM seen GROUP BY Symbol",
)
def leakage_order(spark, sf):
    return order_violations(fx.raw_bars(spark, sf))


@query(
    "run_metadata",
    f"WITH {DEDUP}, cleaned AS (SELECT * FROM dedup WHERE Open IS NOT NULL), {_validation('cleaned')}, "
    "c AS (SELECT count(*) AS n, count(DISTINCT Symbol) AS syms FROM raw_bars), "
    "d AS (SELECT count(*) AS n FROM dedup), k AS (SELECT count(*) AS n, min(Date) AS a, max(Date) AS b FROM cleaned) "
    "SELECT (SELECT count(*) FROM asked) AS tickers_requested, c.syms AS tickers_collected, "
    "(SELECT count(*) FROM report WHERE issues_summary = '' AND rows > 0) AS tickers_validated_success, "
    "(SELECT count(*) FROM asked) - c.syms AS failed_downloads_count, c.n AS total_raw_rows, k.n AS total_cleaned_rows, "
    "k.a AS start_date, k.b AS end_date, c.n - d.n AS duplicates_removed, CAST(0 AS BIGINT) AS missing_values_detected, "
    "CAST(0 AS BIGINT) AS missing_values_filled, d.n - k.n AS invalid_rows_dropped FROM c, d, k",
)
def run_metadata(spark, sf):
    cleaned, counters = cl.clean_counted(fx.raw_bars(spark, sf))
    return bar_metadata(validate(cleaned, RULES), counters, requested(spark, sf))


_CLASSED = """
    SELECT *, CASE WHEN fwd >= 0.5 THEN 2 WHEN fwd <= -0.5 THEN 0 ELSE 1 END AS target_cls_h1 FROM (
      SELECT *, lead(Close, 1) OVER (PARTITION BY split, Symbol ORDER BY Date) / Close - 1 AS fwd FROM sb)"""


def old_layout(spark, sf):
    """Split bars as the old layout stored them, with the forward return inside."""
    from tidemark.operators.targets import forward_returns

    return forward_returns(fx.split_bars(spark, sf), (1,), names=("next_day_return",))


@query(
    "relabel",
    f"WITH {SPLIT} SELECT Symbol AS Ticker, Date, split, {PRICES_SQL}, target_cls_h1 FROM ({_CLASSED})",
)
def relabel(spark, sf):
    return sinks.relabel(old_layout(spark, sf), 0.5, -0.5)


@query(
    "convert_split_stats",
    f"WITH {SPLIT} SELECT split, count(*) AS n_rows, 9 AS n_columns, 0 AS feature_count, "
    "count(DISTINCT Symbol) AS tickers, min(Date) AS date_start, max(Date) AS date_end, "
    + ", ".join(
        f"CAST(sum(CASE WHEN target_cls_h1 = {k} THEN 1 ELSE 0 END) AS BIGINT) AS {n}"
        for k, n in ((0, "n_sell"), (1, "n_hold"), (2, "n_buy"))
    )
    + f" FROM ({_CLASSED}) GROUP BY split",
)
def convert_split_stats(spark, sf):
    source, target = fresh_path(spark, "old"), fresh_path(spark, "new")
    old = old_layout(spark, sf)
    old.write.option("header", True).csv(source)
    new = sinks.convert_split(spark, source, target, old.schema, buy=0.5, sell=-0.5)
    return sinks.split_stats(new, []).select(
        "split", "n_rows", "n_columns", "feature_count", "tickers", "date_start", "date_end", "n_sell", "n_hold", "n_buy"
    )


@query(
    "sink_combined",
    f"WITH {RAW} SELECT Symbol, count(*) AS n_rows, (SELECT count(*) FROM raw_bars) AS written FROM raw_bars GROUP BY Symbol",
)
def sink_combined(spark, sf):
    path = fresh_path(spark, "combined")
    n = sinks.write_counted(fx.raw_bars(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("Symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(n).alias("written"))


@query("sink_splits", f"WITH {SPLIT} SELECT Symbol, Date, {PRICES_SQL}, split FROM sb WHERE split = 'validation'")
def sink_splits(spark, sf):
    path = fresh_path(spark, "splits")
    sinks.write_splits(check_split(fx.split_bars(spark, sf)), path)
    return sinks.read_split(spark, path, "validation")


@query(
    "sink_features",
    f"WITH {TABLE_SQL} SELECT split, count(*) AS n_rows, count(DISTINCT Symbol) AS n_symbols FROM ftable GROUP BY split",
)
def sink_features(spark, sf):
    path = fresh_path(spark, "features")
    from tidemark.catalog.features import CONFIG

    sinks.write_splits(feature_table(fx.split_bars(spark, sf), CONFIG), path)
    return sinks.read_split(spark, path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Symbol").alias("n_symbols")
    )


@query(
    "convert_predictions",
    f"WITH {PREDICTIONS} SELECT model, Symbol, Date, actual, prediction FROM predictions",
)
def convert_predictions(spark, sf):
    base = fresh_path(spark, "predictions")
    rows = fx.predictions(spark, sf).select("model", "Symbol", F.col("Date").cast("string").alias("Date"), "actual", "prediction")
    rows.write.option("header", True).csv(f"{base}/second.csv")
    return sinks.convert_predictions(
        spark, [f"{base}/first.csv", f"{base}/second.csv"], f"{base}/out", rows.schema
    )


@query(
    "report_csv",
    f"WITH {RAW}, {_validation('raw_bars')} SELECT symbol, issues_summary FROM report WHERE issues_summary <> ''",
)
def report_csv(spark, sf):
    path = fresh_path(spark, "report")
    sinks.write_report(validation_report(validate(fx.raw_bars(spark, sf), RULES, requested(spark, sf))), path)
    back = spark.read.option("header", True).csv(path)
    return back.where(F.col("issues_summary") != "").select("symbol", "issues_summary")
