"""Profiles of feature tables: quality, distributions, summaries, regimes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import classifier_metrics
from tidemark.operators.quantiles import exact_quantiles
from tidemark.sources.storage import stored

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
METADATA = ("Symbol", "Ticker", "Date", "Open", "High", "Low", "Close", "Volume", "Adj Close")


def is_numeric(dtype: str) -> bool:
    return dtype in NUMERIC or dtype.startswith("decimal")


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither metadata nor forward-looking."""
    skip = {*METADATA, "split", "ingest_seq", *exclude}
    return [
        c
        for c, t in df.dtypes
        if is_numeric(t) and c not in skip and not c.startswith(("target_", "target", "fwd_"))
    ]


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns without targets; prices and volume included."""
    return [c for c, t in df.dtypes if is_numeric(t) and not c.startswith(("target", "fwd_"))]


def find_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100.0


def _total(df: DataFrame, column: str) -> Column:
    """Grand total as a scalar subquery: no single-task window over all groups."""
    return df.agg(F.sum(column)).scalar()


def feature_quality(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per split and feature: missing and infinite values, range, mean, status."""
    types = dict(df.dtypes)
    present = [f for f in features if f in types]
    absent = [f for f in features if f not in types]

    def stats(c: str) -> Column:
        x = F.col(c)
        numeric = is_numeric(types[c])
        number = x.cast("double") if numeric else F.lit(None).cast("double")
        return F.struct(
            F.lit(types[c]).alias("dtype"),
            F.count_if(x.isNull() | (F.isnan(number) if numeric else F.lit(False))).alias("nan_count"),
            F.count_if(F.abs(number) == float("inf")).alias("inf_count"),
            F.round(F.min(number), 4).alias("min"),
            F.round(F.max(number), 4).alias("max"),
            F.round(F.avg(number), 4).alias("mean"),
        ).alias(c)

    wide = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), *[stats(c) for c in present])
    for c in absent:
        none = F.lit(None).cast("double")
        wide = wide.withColumn(
            c,
            F.struct(
                F.lit("MISSING").alias("dtype"), F.col("n_rows").alias("nan_count"),
                F.lit(0).cast("long").alias("inf_count"), none.alias("min"), none.alias("max"), none.alias("mean"),
            ),
        )
    long = wide.unpivot(["split"], list(features), "feature", "s")
    broken = (F.col("s.nan_count") > 0) | (F.col("s.inf_count") > 0)
    status = (
        F.when(F.col("s.dtype") == "MISSING", "FAIL_MISSING").when(broken, "FAIL_NAN_OR_INF").otherwise("PASS")
    )
    return long.select("split", "feature", "s.*", status.alias("status"))


def dataset_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Per column: type, missing count and share, distinct values.

    Exact distinct counts go through one (column, value) aggregate that combines
    on the map side, so a value found in most rows costs one row per task.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    dtype = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])[F.col("column")]
    if approximate:
        wide = df.agg(
            *[
                F.struct(
                    F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col(c).isNull()).alias("missing"),
                    F.approx_count_distinct(c).alias("unique_values"),
                ).alias(c)
                for c in columns
            ]
        )
        seen = wide.unpivot([], columns, "column", "s").select("column", "s.*")
    else:
        cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
            [], columns, "column", "value"
        )
        seen = (
            cells.groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("column")
            .agg(
                F.sum("n").alias("n"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
                F.count("value").alias("unique_values"),
            )
        )
    return seen.select(
        "column",
        dtype.alias("dtype"),
        "missing",
        _share(F.col("missing"), F.col("n")).alias("missing_pct"),
        "unique_values",
    )


def ticker_distribution(df: DataFrame, key: str = "Symbol", top: int | None = None) -> DataFrame:
    """Rows per symbol with their share, largest first."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("observations"))
    total = _total(counts, "observations")
    out = counts.withColumn("percentage", _share(F.col("observations"), total))
    ranked = out.orderBy(F.desc("observations"), key)
    return ranked.limit(top) if top else ranked


def yearly_distribution(df: DataFrame, ts: str = "Date") -> DataFrame:
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(F.year(ts).alias("year"))
        .agg(F.count(F.lit(1)).alias("observations"))
    )


def label_distribution(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per label, a missing label being a group of its own, with its share."""
    counts = df.groupBy(*by, F.col(label).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
        return counts.join(totals, list(by)).withColumn(
            "percentage", _share(F.col("n"), F.col("total"))
        ).drop("total")
    every_label = Window.partitionBy()  # one row per label by now
    return counts.withColumn("percentage", _share(F.col("n"), F.sum("n").over(every_label)))


def label_by_year(df: DataFrame, label: str, labels: Sequence, ts: str = "Date") -> DataFrame:
    """Share of each label per calendar year, in percent; one column per label."""
    known = F.col(label).isin(list(labels))
    out = df.where(F.col(ts).isNotNull() & known).groupBy(F.year(ts).alias("year")).agg(
        *[_share(F.count_if(F.col(label) == v), F.count(F.lit(1))).alias(f"pct_{v}") for v in labels]
    )
    return out


def feature_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max and missing share per feature."""
    wide = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
                _share(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias("missing_pct"),
            ).alias(c)
            for c in features
        ]
    )
    stats = wide.unpivot([], list(features), "feature", "s").select("feature", "s.*")
    at = exact_quantiles(df, features, (0.25, 0.5, 0.75))
    named = at.groupBy("feature").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    )
    return stats.join(named, "feature", "left")


def feature_correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlation over rows where both values are present.

    Each task folds its rows into one matrix of pair sums, around the global
    means so that nothing cancels; the sums of all tasks then add up.  Some
    hundred ``corr`` aggregates side by side would be interpreted row by row.
    """
    k = len(features)
    row = df.agg(*[F.avg(c).alias(c) for c in features]).head()
    means = np.array([row[c] or 0.0 for c in features], dtype=float)
    left, right = np.triu_indices(k)

    def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            x = np.column_stack(cols) - means
            here = np.isfinite(x)
            x, m = np.where(here, x, 0.0), here.astype(float)
            n += m.T @ m
            sx += x.T @ m  # sum of column i over rows where column j is present
            sxx += (x * x).T @ m
            sxy += x.T @ x
        pick = lambda a: a[left, right]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(v)
                for v in (
                    left.astype("int32"), right.astype("int32"),
                    pick(n), pick(sx), pick(sx.T), pick(sxx), pick(sxx.T), pick(sxy),
                )
            ],
            names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"],
        )

    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    sums = doubles.mapInArrow(
        pair_sums, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    )
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = F.col("sxx") - sx * F.try_divide(sx, n), F.col("syy") - sy * F.try_divide(sy, n)
    r = F.try_divide(F.col("sxy") - sx * F.try_divide(sy, n), F.sqrt(vx) * F.sqrt(vy))
    names = F.array(*[F.lit(c) for c in features])
    name = lambda c: F.element_at(names, F.col(c) + 1)
    sides = F.array_distinct(
        F.array(
            F.struct(name("i").alias("f1"), name("j").alias("f2")),
            F.struct(name("j").alias("f1"), name("i").alias("f2")),
        )
    )
    return total.select(r.alias("r"), F.explode(sides).alias("s")).select("s.f1", "s.f2", "r")


def _bins(value: Column, lo: Column, hi: Column, bins: int) -> tuple[Column, Column, Column]:
    """Bin number and edges: equal widths, last bin closed, unit width around a constant."""
    flat = lo == hi
    a, b = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    width = (b - a) / bins
    n = F.least(F.floor((value - a) / width), F.lit(bins - 1))
    return n, a, width


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str]) -> DataFrame:
    """Counts per group and equal-width bin over that group's own range.

    The ranges, one row per group, are stored before they join back: the planner
    then knows their size and broadcasts them only if they are small.
    """
    seen = df.where(F.col(value).isNotNull())
    ranges = stored(seen.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi")), "ranges")
    n, a, width = _bins(F.col(value), F.col("lo"), F.col("hi"), bins)
    placed = seen.join(ranges, list(by)).select(*by, n.cast("int").alias("bin"), a.alias("a"), width.alias("w"))
    return placed.groupBy(*by, "bin", "a", "w").agg(F.count(F.lit(1)).alias("n")).select(
        *by,
        "bin",
        (F.col("a") + F.col("bin") * F.col("w")).alias("left_edge"),
        (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("right_edge"),
        "n",
    )


def feature_histogram(df: DataFrame, features: Sequence[str], bins: int = 50) -> DataFrame:
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [], list(features), "feature", "value"
    )
    return histogram(long, "value", bins, ("feature",))


def confidence_histogram(df: DataFrame, bins: int = 30, by: Sequence[str] = ("model",)) -> DataFrame:
    """Histogram of confidence for right and for wrong predictions."""
    marked = df.withColumn("correct", F.col("prediction") == F.col("actual"))
    return histogram(marked, "confidence", bins, (*by, "correct"))


REGIMES = ("Low", "Medium", "High")


def with_regime(df: DataFrame, column: str, name: str = "volatility_regime") -> DataFrame:
    """Equal-frequency thirds of ``column``, upper bounds inclusive."""
    edges = [r["value"] for r in exact_quantiles(df, [column], (1 / 3, 2 / 3)).orderBy("p").collect()]
    if not edges:
        return df.withColumn(name, F.lit(None).cast("string"))
    x = F.col(column)
    regime = F.when(x <= edges[0], REGIMES[0]).when(x <= edges[1], REGIMES[1]).when(x.isNotNull(), REGIMES[2])
    return df.withColumn(name, regime)


def volatility_regimes(df: DataFrame, column: str) -> DataFrame:
    return (
        with_regime(df, column)
        .where(F.col("volatility_regime").isNotNull())
        .groupBy("volatility_regime")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# The lookback ranges on offer, in months.
PERIODS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60}


def market_snapshot(df: DataFrame, period: str = "1y", key: str = "Symbol", ts: str = "Date") -> DataFrame:
    """Latest and previous close, change in percent, high and low of the period."""
    months = PERIODS[period]
    last = df.groupBy(key).agg(F.max(ts).alias("latest_date"))
    recent = df.join(last, key).where(F.col(ts) >= F.add_months("latest_date", -months))
    latest, prev = F.col("latest_close"), F.col("previous_close")
    earlier = F.when(F.col(ts) < F.col("latest_date"), F.col(ts))
    return (
        recent.groupBy(key, "latest_date")
        .agg(
            F.max_by("Close", ts).alias("latest_close"),
            F.max_by("Close", earlier).alias("previous_close"),
            F.max("High").alias("period_high"),
            F.min("Low").alias("period_low"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .withColumn("previous_close", F.coalesce(prev, latest))
        .withColumn("change_pct", F.coalesce((F.try_divide(latest, prev) - 1.0) * 100.0, F.lit(0.0)))
    )


def dataset_summary(df: DataFrame, features: Sequence[str], predictions: DataFrame | None = None) -> DataFrame:
    """One row: rows, columns, symbols, dates, features, and scores of the predictions."""
    one = F.lit(1).alias("one")
    out = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.count_distinct("Symbol").alias("unique_tickers"),
        F.min("Date").alias("date_start"),
        F.max("Date").alias("date_end"),
        F.lit(len(features)).alias("feature_count"),
    )
    if predictions is None:
        return out
    scores = classifier_metrics(predictions, ()).select(
        one, F.col("accuracy").alias("model_accuracy"), "balanced_accuracy", "macro_f1"
    )
    return out.select(one, "*").join(scores, "one").drop("one")
