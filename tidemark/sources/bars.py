"""Symbol lists, landed bars and the load log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = "Date timestamp_ntz, Open double, High double, Low double, Close double, Volume double"


def tickers_from_list(spark: SparkSession, symbols: Sequence[str]) -> DataFrame:
    return ticker_list(spark.createDataFrame([(s,) for s in symbols], "Symbol string"))


def tickers_from_csv(spark: SparkSession, path: str, column: str = "Symbol") -> DataFrame:
    """The named column, or the first one where it is absent."""
    raw = spark.read.csv(path, header=True)
    name = column if column in raw.columns else raw.columns[0]
    return ticker_list(raw.select(F.col(f"`{name}`").alias("Symbol")))


def tickers_from_text(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line, blank lines ignored."""
    lines = spark.read.text(path).select(F.trim("value").alias("Symbol"))
    return ticker_list(lines.where(F.col("Symbol") != ""))


def ticker_list(df: DataFrame, column: str = "Symbol") -> DataFrame:
    """Distinct non-null symbols in order."""
    name = F.col(column).cast("string").alias("Symbol")
    return df.select(name).where(F.col("Symbol").isNotNull()).distinct().orderBy("Symbol")


def scan_bars(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    schema: str | T.StructType | None = None,
    symbol_from_file: bool = False,
    arrival: str | None = None,
    **options,
) -> DataFrame:
    """Landed bar files; the symbol may be the file name.

    ``arrival`` names a column for the order of arrival: a file's time and path,
    then the row's place in it.
    """
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    if symbol_from_file:
        name = F.regexp_replace(F.col("_metadata.file_name"), r"(\.[A-Za-z]+)+$", "")
        df = df.withColumn("Symbol", name)
    if arrival is not None:
        place = [F.col("_metadata.row_index")]
        if fmt != "parquet":  # rows of other formats are counted per block of a file
            place = [F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")]
        df = df.withColumn(arrival, F.struct("_metadata.file_modification_time", "_metadata.file_path", *place))
    return landed(df)


def landed(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """``Datetime`` becomes ``Date`` without a zone; ``symbol`` fills an absent column."""
    if "Date" not in df.columns and "Datetime" in df.columns:
        df = df.withColumnRenamed("Datetime", "Date")
    kind = df.schema["Date"].dataType if "Date" in df.columns else None
    if isinstance(kind, (T.StringType, T.TimestampType)):
        df = df.withColumn("Date", F.try_to_timestamp("Date").cast("timestamp_ntz") if isinstance(kind, T.StringType) else F.col("Date").cast("timestamp_ntz"))
    if symbol is not None and "Symbol" not in df.columns:
        df = df.withColumn("Symbol", F.lit(symbol))
    return df


def in_range(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "Date") -> DataFrame:
    """start <= date < end; reaches the Parquet scan as a pushed filter."""
    kind = df.schema[ts].dataType
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(ts) < F.lit(end).cast(kind))
    return df


def load_log(requested: DataFrame, loaded: DataFrame, key: str = "Symbol", ts: str = "Date") -> DataFrame:
    """Per requested symbol: status, rows and first and last date."""
    got = loaded.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.to_date(F.min(ts)).alias("start_date"),
        F.to_date(F.max(ts)).alias("end_date"),
    )
    return (
        requested.select(key)
        .distinct()
        .join(got, key, "left")
        .select(
            F.col(key).alias("symbol"),
            F.when(F.col("rows") > 0, "SUCCESS").otherwise("FAILED").alias("status"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
            "start_date",
            "end_date",
        )
    )


def failed_symbols(log: DataFrame) -> DataFrame:
    return log.where("status = 'FAILED'").select("symbol")
