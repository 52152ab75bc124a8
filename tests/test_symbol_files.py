"""Data sources of bar files."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan
from pyspark.sql.types import StructType

from tidemark.sources.symbol_files import (
    FILE_COLUMN,
    LandedReader,
    SymbolBatchWriter,
    SymbolFiles,
    SymbolFileWriter,
    provider_scan,
    write_symbol_files,
)

BARS = "Symbol string, Date date, Open double, High double, Low double, Close double, Volume double"


def rows(symbol, n, first=dt.date(2020, 1, 1)):
    return [(symbol, first + dt.timedelta(days=k), 1.0, 2.0, 0.5, 1.5 + k, None if k % 5 == 0 else 10.0) for k in range(n)]


def test_one_file_per_symbol_by_name(spark, tmp_path):
    data = rows("HOT.NS", 900) + rows("^IDX", 3) + rows("A/B", 2) + rows('q,"x"', 1)
    write_symbol_files(spark.createDataFrame(data, BARS).repartition(7), str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"HOT.csv", "IDX.csv", "A_B.csv", 'q,"x".csv'}
    lines = (tmp_path / "out" / "HOT.csv").read_text().splitlines()
    assert lines[0] == "Symbol,Date,Open,High,Low,Close,Volume" and len(lines) == 901
    assert lines[1:] == sorted(lines[1:]) and lines[1] == "HOT.NS,2020-01-01,1.0,2.0,0.5,1.5,"
    back = spark.read.schema(BARS).csv(str(tmp_path / "out"), header=True, escape='"')
    assert sorted(map(tuple, back.collect()), key=str) == sorted(data, key=str)


def test_written_again_a_file_is_replaced(spark, tmp_path):
    write_symbol_files(spark.createDataFrame(rows("A", 5) + rows("B", 5), BARS), str(tmp_path / "out"))
    write_symbol_files(spark.createDataFrame(rows("A", 2), BARS), str(tmp_path / "out"))
    sizes = {p.name: len(p.read_text().splitlines()) for p in (tmp_path / "out").iterdir()}
    assert sizes == {"A.csv": 3, "B.csv": 6}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bars = spark.createDataFrame(rows("A", 50) + rows("B", 50), BARS)
    fails = bars.withColumn("Close", F.when((F.col("Symbol") == "B") & (F.col("Close") > 40), F.raise_error("planted").cast("double")).otherwise(F.col("Close")))
    with pytest.raises(Exception, match="planted"):
        write_symbol_files(fails, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="its file has no name"):
        write_symbol_files(spark.createDataFrame(rows(None, 1), BARS), str(tmp_path / "out"))


def test_empty_table_writes_no_file(spark, tmp_path):
    write_symbol_files(spark.createDataFrame([], BARS), str(tmp_path / "out"))
    assert list((tmp_path / "out").iterdir()) == []


def test_provider_opens_only_files_of_the_range(spark, tmp_path):
    days = spark.createDataFrame(rows("A", 20) + rows("B", 20), BARS).withColumn("day", F.col("Date").cast("string"))
    write_symbol_files(days, str(tmp_path / "in"), symbol="day", order=("Symbol",))
    (tmp_path / "in" / "2020-01-03.csv").write_text("Symbol,Date,Close\nA,no date,x\n")  # fails if it is read
    got = provider_scan(spark, str(tmp_path / "in")).where("Date >= DATE '2020-01-05' AND Date < DATE '2020-01-08'")
    assert sorted((r.Symbol, r.Date.day, r.Close, r.Volume) for r in got.collect()) == [
        (s, d, 0.5 + d, None if d == 6 else 10.0) for s in "AB" for d in (5, 6, 7)
    ]
    assert provider_scan(spark, str(tmp_path / "in")).where("Date = DATE '2020-01-06'").count() == 2
    assert provider_scan(spark, str(tmp_path / "in")).where("Date > DATE '2021-01-06'").count() == 0
    with pytest.raises(Exception):
        provider_scan(spark, str(tmp_path / "in")).count()


def test_planned_files(tmp_path):
    for d in range(1, 10):
        (tmp_path / f"2020-01-0{d}.csv").write_text("x\n")
    reader = LandedReader(str(tmp_path), StructType())
    bounds = [GreaterThanOrEqual(("Date",), dt.date(2020, 1, 4)), LessThan(("Date",), dt.date(2020, 1, 6))]
    assert list(reader.pushFilters(bounds)) == bounds
    assert [p.rsplit("/", 1)[1] for part in reader.partitions() for p in part.paths] == ["2020-01-04.csv", "2020-01-05.csv"]


def test_batches_give_the_text_of_rows(spark, tmp_path):
    kinds = f"Symbol string, Date date, x double, y float, n long, b boolean, d decimal(9,2), {FILE_COLUMN} string"
    day, nan = dt.date(2020, 2, 29), float("nan")
    data = [
        ('q,"x"', day, 1e16, 0.1, -5, True, Decimal("1.50"), "a"),
        ("line\nend", None, 1e-5, 1.5, None, False, None, "a"),
        (None, day, nan, nan, 2**62, None, Decimal("-0.01"), "a"),
        ("", day, float("-inf"), None, 0, True, Decimal("0.00"), "b"),
        ("é", day, -0.0, -0.0, 7, True, Decimal("9999999.99"), "b"),
        ("é", day, 0.0, 0.1, 7, True, None, "c"),
        ("é", day, None, 1e30, 7, True, None, "c"),
    ]
    df = spark.createDataFrame(data, kinds).coalesce(1)
    source = SymbolFiles({"path": str(tmp_path / "batch")})
    assert isinstance(source.writer(df.schema, False), SymbolBatchWriter)
    by_row = SymbolFileWriter(str(tmp_path / "row"), df.schema)
    by_row.commit([by_row.write(iter(df.collect()))])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # files over several batches
    try:
        spark.dataSource.register(SymbolFiles)
        df.write.format("symbol_files").mode("append").save(str(tmp_path / "batch"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    text = lambda at: {p.name: p.read_bytes() for p in (tmp_path / at).iterdir()}
    assert set(text("row")) == {"a.csv", "b.csv", "c.csv"} and text("batch") == text("row")


def test_other_types_go_row_by_row(spark, tmp_path):
    at = dt.datetime(2020, 1, 1, 9, 30)
    df = spark.createDataFrame([("A", at, 1.0)], "Symbol string, Date timestamp, Close double")
    assert not isinstance(SymbolFiles({"path": "x"}).writer(df.withColumn(FILE_COLUMN, F.lit("A")).schema, False), SymbolBatchWriter)
    write_symbol_files(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "A.csv").read_text() == f"Symbol,Date,Close\nA,{at},1.0\n"
