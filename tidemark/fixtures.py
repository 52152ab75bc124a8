"""Bars, faulty bars and rule-based predictions derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators.series import deal
from tidemark.operators.split import assign_split

TRAIN_END, VALIDATION_END = "1998-12-31", "2000-06-30"
BUY, SELL = 0.5, -0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and ship date.

    Open and close are ``min_by``/``max_by`` over a total order, so the whole
    table is one aggregate with map-side combining: a supplier with a third of
    all lines shrinks to one row per day before anything is shuffled.
    """
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("Symbol"),
        F.to_date("l_shipdate").alias("Date"),
        px.alias("px"),
        F.col("l_quantity").alias("q"),
        order.alias("at"),
    )
    return lines.groupBy("Symbol", "Date").agg(
        F.min_by("px", "at").alias("Open"),
        F.max("px").alias("High"),
        F.min("px").alias("Low"),
        F.max_by("px", "at").alias("Close"),
        F.sum("q").alias("Volume"),
    )


def split_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_split(dealt(spark, sf_dir, bars(spark, sf_dir)), TRAIN_END, VALIDATION_END)


def dealt(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Bars for work on whole series; there are no more of them than lines, which the files' footers count."""
    return deal(df, table(spark, sf_dir, "lineitem").count())


def _ymd(d: Column) -> Column:
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("long")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with missing opens, broken highs, negative volumes and later corrections."""
    ymd, close = F.col("ymd"), F.col("Close")
    faulty = bars(spark, sf_dir).withColumn("ymd", _ymd(F.col("Date"))).select(
        "Symbol",
        "Date",
        F.when(ymd % 53 != 0, F.col("Open")).alias("Open"),
        F.when(ymd % 61 == 0, F.col("Low") - 1).otherwise(F.col("High")).alias("High"),
        "Low",
        "Close",
        F.when(ymd % 67 == 0, -F.col("Volume")).otherwise(F.col("Volume")).alias("Volume"),
        (F.col("Symbol").cast("long") * 100000000 + ymd).alias("ingest_seq"),
        F.explode(F.when(ymd % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    )
    later = F.col("again") == 1
    return faulty.select(
        "Symbol",
        "Date",
        "Open",
        "High",
        "Low",
        F.when(later, close * 1.01).otherwise(close).alias("Close"),
        "Volume",
        F.when(later, F.col("ingest_seq") + 10000000000000).otherwise(F.col("ingest_seq")).alias("ingest_seq"),
    )


def gappy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that lack closes at the start, one day a week and all June, and some highs and lows."""
    day = F.dayofyear("Date")
    early = F.col("Date") < F.lit("1995-02-15").cast("date")
    return bars(spark, sf_dir).withColumns(
        {
            "Close": F.when(~(early | (day % 7 == 3) | (F.month("Date") == 6)), F.col("Close")),
            "High": F.when(day % 11 != 5, F.col("High")),
            "Low": F.when(day % 13 != 6, F.col("Low")),
        }
    )


def open_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions with a fourth label, and labels missing on either side."""
    day = F.dayofmonth("Date")
    return predictions(spark, sf_dir).withColumns(
        {
            "actual": F.when(day == 9, F.lit(3)).when(day != 17, F.col("actual")),
            "prediction": F.when(day == 21, F.lit(7)).when((day != 25) & (day != 17), F.col("prediction")),
        }
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rule-based models scored on every observable bar."""
    from tidemark.operators.indicators import add_indicators, lagged_returns
    from tidemark.operators.targets import forward_returns

    moves = add_indicators(bars(spark, sf_dir), [lagged_returns((1, 5))])
    seen = forward_returns(moves, (1,), names=("fwd",)).where(
        F.col("fwd").isNotNull() & F.col("return_5d").isNotNull()
    )

    def contrarian(r: Column) -> Column:
        return F.when(r >= BUY, 0).when(r <= SELL, 2).otherwise(1)

    def scored(model: str, r: Column, pred: Column) -> Column:
        strength = F.abs(r)
        return F.struct(
            F.lit(model).alias("model"),
            pred.alias("prediction"),
            (F.lit(0.4) + 0.6 * ratio(strength, strength + 1.0)).alias("confidence"),
        )

    r1, r5 = F.col("return_1d"), F.col("return_5d")
    votes = F.array(
        scored("reversal1", r1, contrarian(r1)),
        scored("reversal5", r5, contrarian(r5)),
        scored("always_hold", F.lit(0.0), F.lit(1)),
    )
    fwd = F.col("fwd")
    actual = F.when(fwd >= BUY, 2).when(fwd <= SELL, 0).otherwise(1)
    return seen.select("Symbol", "Date", actual.alias("actual"), F.explode(votes).alias("v")).select(
        "v.model", "Symbol", "Date", "actual", "v.prediction", "v.confidence"
    )
