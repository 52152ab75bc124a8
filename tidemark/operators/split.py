"""Chronological split into train, validation and test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


def assign_split(
    df: DataFrame,
    train_end: str,
    validation_end: str,
    test_start: str | None = None,
    ts: str = "Date",
) -> DataFrame:
    """Add ``split``; rows that belong to no split are dropped.

    Bounds are inclusive.  Without ``test_start`` the test split begins right
    after ``validation_end``.
    """
    at = F.col(ts)
    t1, t2 = F.lit(train_end).cast("date"), F.lit(validation_end).cast("date")
    tested = at > t2 if test_start is None else (at > t2) & (at >= F.lit(test_start).cast("date"))
    name = F.when(at <= t1, "train").when((at > t1) & (at <= t2), "validation").when(tested, "test")
    return df.withColumn("split", name).where(F.col("split").isNotNull())


def split_bounds(df: DataFrame, ts: str = "Date") -> DataFrame:
    """One row: first and last date of each split and whether they are disjoint."""
    edges = []
    for s in SPLITS:
        here = F.when(F.col("split") == s, F.col(ts))
        edges += [F.min(here).alias(f"{s}_start"), F.max(here).alias(f"{s}_end")]
    ordered = F.coalesce(F.col("train_end") < F.col("validation_start"), F.lit(True)) & F.coalesce(
        F.col("validation_end") < F.col("test_start"), F.lit(True)
    )
    return df.agg(*edges).withColumn("disjoint", ordered)


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def check_split(df: DataFrame, ts: str = "Date") -> DataFrame:
    """Raise when splits overlap in time, else hand the table back."""
    if not split_bounds(df, ts).head()["disjoint"]:
        raise ValueError("splits overlap in time")
    return df
