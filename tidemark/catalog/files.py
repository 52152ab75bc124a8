"""Bars written as one file per symbol, and read from a provider's landed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.catalog.base import BARS, query, r, rounded
from tidemark.sources.bars import in_range
from tidemark.sources.storage import fresh_path
from tidemark.sources.symbol_files import provider_scan, write_symbol_files

START, END = "1998-03-01", "1998-07-01"


@query(
    "symbol_files",
    f"WITH {BARS} SELECT Symbol || '.csv' AS file, count(*) AS n_rows, min(Date) AS first_date, max(Date) AS last_date, "
    f"{r('sum(Close)', 3)} AS close_sum FROM bars GROUP BY Symbol",
)
def symbol_files(spark, sf):
    """Suffixes and index marks leave the file names; the rows come back file by file."""
    path = fresh_path(spark, "symbols")
    n = F.col("Symbol").cast("long")
    marked = F.when(n % 3 == 0, F.concat("Symbol", F.lit(".NS"))).when(n % 3 == 1, F.concat(F.lit("^"), "Symbol")).otherwise(F.concat("Symbol", F.lit(".BO")))
    write_symbol_files(fx.bars(spark, sf).withColumn("Symbol", marked), path)
    schema = "Symbol string, Date date, Open double, High double, Low double, Close double, Volume double"
    back = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    out = back.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("Date").alias("first_date"), F.max("Date").alias("last_date"), F.sum("Close").alias("close_sum")
    )
    return rounded(out, 3)


@query(
    "provider_scan",
    f"WITH {BARS} SELECT Symbol, Date, {r('Open')} AS Open, {r('High')} AS High, {r('Low')} AS Low, {r('Close')} AS Close, "
    f"{r('Volume')} AS Volume FROM bars WHERE Date >= DATE '{START}' AND Date < DATE '{END}'",
)
def provider(spark, sf):
    """All bars land as one file per day; the scan opens those of the range."""
    path = fresh_path(spark, "landed")
    days = fx.bars(spark, sf).withColumn("day", F.col("Date").cast("string"))
    write_symbol_files(days, path, symbol="day", order=("Symbol",))
    return rounded(in_range(provider_scan(spark, path), START, END))
