import datetime as dt
import time

import pytest
from bar_data import daily, random_walk
from pyspark.sql import functions as F

from tidemark.operators import clean as cl
from tidemark.operators.split import assign_split, check_split, split_bounds
from tidemark.operators.validate import Rules, validate, validation_report
from tidemark.plans.bars import BarConfig, prepare_bars
from tidemark.sources import bars as src
from tidemark.sources import sinks
from tidemark.sources.storage import fresh_path, shared_dir

BAR = "Date string, Open double, High double, Low double, Close double, Volume double, Symbol string, ingest_seq long"


def bars(spark, *rows):
    number = lambda x: None if x is None else float(x)
    full = [(d, *map(number, rest), "A", i) for i, (d, *rest) in enumerate(rows)]
    return spark.createDataFrame(full, BAR)


def test_synonyms(spark):
    df = spark.createDataFrame(
        [("2023-01-01", 1.0, 2.0, 0.5, 1.5, 10)], "datetime string, open double, HIGH double, Low double, `adj close` double, Volume int"
    )
    out = cl.standardize(df, "TEST")
    assert out.columns == ["Date", "Open", "High", "Low", "Close", "Volume", "Symbol"]
    assert out.head()["Close"] == 1.5 and out.head()["Symbol"] == "TEST" and out.head()["Date"] == dt.date(2023, 1, 1)


def test_exact_close_beats_adjusted():
    assert cl.column_mapping(["Adj Close", " close "])["Close"] == " close "


def test_dedup_keeps_last(spark):
    df = bars(spark, ("2023-01-02", 1, 2, 0, 1, 5), ("2023-01-01", 1, 2, 0, 1, 5), ("2023-01-02", 9, 9, 9, 9, 9))
    out = cl.dedup_last(df, copies="n")
    assert {(r["Date"], r["Close"], r["n"]) for r in out.collect()} == {("2023-01-01", 1.0, 1), ("2023-01-02", 9.0, 2)}


def test_dedup_hashes_and_keeps_whole_rows(spark):
    df = bars(spark, ("2020-01-01", 1, 1, 1, 1, 1), ("2020-01-01", 2, 2, 2, 2, None))
    df = df.withColumn("ingest_seq", F.when(F.col("Close") == 1, F.lit(7).cast("long"))).withColumn("note", F.lit("x"))
    plan = cl.dedup_last(df.drop("note"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert cl.dedup_last(df).first()["Close"] == 1.0
    with pytest.raises(ValueError, match="arrived last"):
        cl.clean(df.drop("ingest_seq"))


def test_scan_adds_arrival(spark, tmp_path):
    for turn, close in enumerate((5.0, 6.0)):
        rows = [(f"2020-01-0{d}", *[close] * 5) for d in (1, 2)]
        day = bars(spark, *rows).drop("ingest_seq")
        day.coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
        day.coalesce(1).write.mode("append").csv(f"{tmp_path}/c", header=True)
        time.sleep(1.1 - turn)
    for fmt in ("parquet", "csv"):
        df = src.scan_bars(spark, f"{tmp_path}/{fmt[0]}", fmt, arrival="came", header=True)
        got = cl.clean(df, order="came").collect()
        assert [r["Close"] for r in got] == [6.0, 6.0]


def test_fill_limit(spark):
    values = [1.0, None, None, None, None, 5.0, None, 7.0]
    rows = [(f"2023-01-0{i + 1}", v, v, v, v, None) for i, v in enumerate(values)]
    df = cl.standardize(bars(spark, *rows))
    out = [r["Open"] for r in cl.fill_forward(df, 2).orderBy("Date").collect()]
    assert out == [1, 1, 1, None, None, 5, 5, 7]
    metrics = cl.clean_metrics(bars(spark, *rows), fill_missing=True, fill_limit=2).head()
    assert (metrics["raw_rows"], metrics["cleaned_rows"], metrics["missing_filled"], metrics["invalid_rows_dropped"]) == (8, 6, 12, 2)


def test_clean_drops_missing_and_junk(spark):
    df = spark.createDataFrame(
        [("2023-01-01", "x", 1), ("2023-01-02", "3", 2), ("2023-01-03", "nan", 3), ("2023-01-04", None, 4)], "Date string, Open string, ingest_seq long"
    )
    for c in ("High", "Low", "Close", "Volume"):
        df = df.withColumn(c, F.lit("4"))
    out = cl.clean(df.withColumn("Symbol", F.lit("A")))
    assert [(r["Date"], r["Open"]) for r in out.collect()] == [(dt.date(2023, 1, 2), 3.0)]


def test_validate(spark):
    good = [(f"2023-01-0{i}", 100, 110, 90, 105, 10) for i in (1, 2, 3)]
    rules = Rules(min_rows=2)
    ok = validate(bars(spark, *good), rules).head()
    assert ok["passed"] and ok["issues"] == [] and ok["rows"] == 3
    bad = validate(bars(spark, ("2023-01-01", 110, 105, -5, 100, -100), *good[1:]), rules).head()
    assert not bad["passed"] and (bad["ohlc_violations"], bad["negative_prices"], bad["negative_volume"]) == (1, 1, 1)
    asked = spark.createDataFrame([("A",), ("B",)], "Symbol string")
    empty = validate(bars(spark, *good), rules, asked).where("symbol = 'B'").head()
    assert empty["issues"] == ["DataFrame is empty."] and not empty["passed"]
    lacking = validate(bars(spark, *good).drop("Volume"), rules).head()
    assert not lacking["passed"] and "Missing required columns" in lacking["issues"][0]
    zero = validate(bars(spark, *[(d, 0, 0, 0, 0, 0) for d, *_ in good]), rules).head()
    assert zero["passed"]
    text = validation_report(validate(bars(spark, good[0], good[0]), Rules(min_rows=5))).head()
    assert text["issues_summary"] == "Insufficient history: 2 rows < minimum 5.; Found 1 duplicate dates."


def test_split(spark):
    df = spark.range(2192).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("Date"))
    out = assign_split(df, "2023-12-31", "2024-12-31", "2025-01-01")
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 1461, "validation": 366, "test": 365}
    assert split_bounds(out).head()["disjoint"] and check_split(out) is out
    overlapping = out.withColumn("split", F.when(F.dayofmonth("Date") == 1, "test").otherwise(F.col("split")))
    with pytest.raises(ValueError):
        check_split(overlapping)
    assert assign_split(df, "2023-12-31", "2024-12-31").where("split = 'test'").count() == 365


def test_ticker_sources(spark, tmp_path):
    assert [r[0] for r in src.tickers_from_list(spark, ["B", "A", "B"]).collect()] == ["A", "B"]
    (tmp_path / "t.txt").write_text(" MSFT \n\nAAPL\n")
    assert [r[0] for r in src.tickers_from_text(spark, str(tmp_path / "t.txt")).collect()] == ["AAPL", "MSFT"]
    (tmp_path / "t.csv").write_text("Code,Name\nZ,z\nA,a\n,x\n")
    assert [r[0] for r in src.tickers_from_csv(spark, str(tmp_path / "t.csv")).collect()] == ["A", "Z"]


def test_date_range_reaches_the_scan(spark, tmp_path):
    daily(spark, random_walk(30)).write.parquet(str(tmp_path / "b"))
    df = src.in_range(src.scan_bars(spark, str(tmp_path / "b")), "1990-01-05", "1990-01-10")
    assert df.count() == 5
    assert "PushedFilters: [IsNotNull(Date), GreaterThanOrEqual(Date" in df._jdf.queryExecution().toString()


def test_symbol_from_file_and_datetime(spark, tmp_path):
    (tmp_path / "TCS.csv").write_text("Datetime,Close\n2023-01-01 09:15:00,5\n")
    row = src.scan_bars(spark, str(tmp_path / "TCS.csv"), "csv", header=True, symbol_from_file=True).head()
    assert row["Symbol"] == "TCS" and row["Date"] == dt.datetime(2023, 1, 1, 9, 15)


def test_symbol_file_names(spark):
    df = spark.createDataFrame([("TCS.NS",), ("X.BO",), ("^NSEI",)], "Symbol string")
    assert [r[0] for r in df.select(sinks.file_symbol()).collect()] == ["TCS", "X", "NSEI"]


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_prepare_bars(spark):
    p = random_walk(400)
    raw = daily(spark, p).withColumn("ingest_seq", F.monotonically_increasing_id())
    asked = spark.createDataFrame([("WALK",), ("NONE",)], "Symbol string")
    out = fresh_path(spark, "run")
    config = BarConfig(train_end="1990-06-30", validation_end="1990-12-31", test_start="1991-01-01")
    done = prepare_bars(raw, asked, config, out)
    assert done["rows"] == 400
    meta = done["metadata"].head()
    assert (meta["tickers_requested"], meta["tickers_collected"], meta["failed_downloads_count"], meta["total_cleaned_rows"]) == (2, 1, 1, 400)
    assert sinks.read_split(spark, done["splits"], "validation").count() == 184
    with pytest.raises(FileNotFoundError):
        sinks.read_split(spark, done["splits"], "holdout")


def test_split_files_are_in_date_order(spark, tmp_path):
    rows = spark.range(0, 400, 1, 3).selectExpr(
        "concat('S', id % 5) AS Symbol", "date_add(DATE'2024-01-01', CAST(id * 37 % 400 AS INT)) AS Date",
        "if(id % 2 = 0, 'train', 'test') AS split",
    )
    assert sinks.write_splits(rows, str(tmp_path / "s")) == 400
    for file in (tmp_path / "s").rglob("*.parquet"):
        got = [(r["Symbol"], r["Date"]) for r in spark.read.parquet(str(file)).collect()]
        assert got and got == sorted(got)


def test_hot_symbol_and_hot_date(spark):
    """A third of all raw rows are copies of one bar, another third one symbol."""
    hot = spark.range(20_000).select(
        F.lit("HOT").alias("Symbol"), F.lit("2020-01-01").alias("Date"), F.col("id").cast("double").alias("Close"), F.col("id").alias("ingest_seq")
    )
    long = spark.range(20_000).select(
        F.lit("LONG").alias("Symbol"), F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") % 5000).cast("int")).cast("string").alias("Date"),
        F.col("id").cast("double").alias("Close"), F.col("id").alias("ingest_seq"),
    )
    rest = spark.range(20_000).select(
        (F.col("id") % 1000).cast("string").alias("Symbol"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 1000).cast("int")).cast("string").alias("Date"),
        F.col("id").cast("double").alias("Close"), F.col("id").alias("ingest_seq"),
    )
    raw = hot.union(long).union(rest)
    for c in ("Open", "High", "Low", "Volume"):
        raw = raw.withColumn(c, F.col("Close"))
    done = {r["Symbol"]: r for r in cl.clean_metrics(raw).collect()}
    assert (done["HOT"]["raw_rows"], done["HOT"]["cleaned_rows"]) == (20_000, 1)
    assert (done["LONG"]["cleaned_rows"], done["LONG"]["duplicates_removed"]) == (5000, 15_000)
    assert sum(r["cleaned_rows"] for r in done.values()) == 25_001
    cleaned = cl.clean(raw)
    assert cleaned.where("Symbol = 'HOT'").head()["Close"] == 19_999.0
    assert cleaned.where("Symbol = 'LONG'").agg(F.min("Close")).head()[0] == 15_000.0


def test_validate_counts_nan_as_missing(spark):
    df = bars(spark, ("2023-01-01", "nan", 2, 1, 1, 5), ("2023-01-02", 1, 2, 0, 1, 5))
    out = validate(df).first()
    assert out["missing_values_total"] == 1 and out["ohlc_violations"] == 0
