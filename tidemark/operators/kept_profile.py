"""Profiles kept up to date: mergeable parts per load, merged when they are read.

A load adds its own counts and sketches as one small partition; no later load reads
its rows again.  A load that is written again replaces its own part, so a repeated
job does not count twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 14  # sketch size: 2^14 registers
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)  # three standard errors, 2.5 percent
PARTS = "load string, column string, value string, dtype string, n long, missing long, sketch binary"


def profile_parts(df: DataFrame, columns: Sequence[str] | None = None, dims: Sequence[str] = ()) -> DataFrame:
    """One row per column (rows, missing, sketch of the values), one per value of each of ``dims``.

    Sketches leave out empty texts, so values carry a mark before them.
    Both come from one aggregate each, combined on the map side: a value that a third
    of the rows share costs one row per task.  ``dims`` are meant for columns whose
    values are few beside the rows (symbols, years, labels); their counts are exact.
    """
    columns = list(columns or [c for c in df.columns if c not in dims])
    types = dict(df.dtypes)
    wide = df.agg(
        *[
            F.struct(
                F.lit(types[c]).alias("dtype"),
                F.count(F.lit(1)).alias("n"),
                F.count_if(F.col(f"`{c}`").isNull()).alias("missing"),
                F.hll_sketch_agg(F.concat(F.lit("."), F.col(f"`{c}`").cast("string")), F.lit(LG_K)).alias("sketch"),
            ).alias(c)
            for c in columns
        ]
    )
    none = F.lit(None).cast("string")
    parts = wide.unpivot([], columns, "column", "s").select("column", none.alias("value"), "s.*")
    if not dims:
        return parts
    values = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in dims]).unpivot([], list(dims), "column", "value")
    counted = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    seen = counted.select(
        "column", "value", F.lit("value").alias("dtype"), "n", F.lit(None).cast("long").alias("missing"), F.lit(None).cast("binary").alias("sketch")
    )
    return parts.unionByName(seen)


def add_load(df: DataFrame, path: str, load: str, columns: Sequence[str] | None = None, dims: Sequence[str] = ()) -> None:
    """Write a load's parts; a load of the same name is replaced."""
    parts = profile_parts(df, columns, dims).withColumn("load", F.lit(load))
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(path)


def kept_profile(parts: DataFrame) -> DataFrame:
    """Per column as ``dataset_profile``: exact rows and missing, distinct values within ``DISTINCT_ERROR``."""
    merged = parts.where(F.col("sketch").isNotNull()).groupBy("column").agg(
        F.max_by("dtype", "load").alias("dtype"),
        F.sum("n").alias("n"),
        F.sum("missing").alias("missing"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_values"),
    )
    share = F.try_divide(F.col("missing"), F.col("n")) * 100.0
    return merged.select("column", "dtype", "n", "missing", share.alias("missing_pct"), "unique_values")


def kept_distribution(parts: DataFrame, dim: str) -> DataFrame:
    """Rows per value of a dimension over all loads, with their share in percent."""
    counts = parts.where((F.col("column") == dim) & F.col("sketch").isNull()).groupBy("value").agg(F.sum("n").alias("n"))
    return counts.withColumn("percentage", F.try_divide(F.col("n"), counts.agg(F.sum("n")).scalar()) * 100.0)
