"""How the rows of one series are laid out for window functions.

A series of daily bars holds at most one row per calendar day once it is
deduplicated, so its length is bounded by the calendar however much raw data a
symbol has.  For a ``date`` column one window per series is therefore safe, and
everything runs behind a single exchange on the series key.

For a ``timestamp`` column (intraday bars) a series has no such bound.  Its rows
are numbered through per-day counts, cut into blocks of ``block_rows`` and every
block gets copies of the rows before and after it that the operator looks at.
Windows then run per (series, block), so a symbol with a third of all rows is
spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 65_536
#: Rows of whole series per task: the sorts and windows of all indicators hold most of a kilobyte a row.
TASK_ROWS = 1_500_000


@dataclass(frozen=True)
class Series:
    """A laid-out table plus the window specs that fit it."""

    df: DataFrame
    keys: tuple[str, ...]
    window: WindowSpec
    blocked: bool = False

    ROW = "__row"
    BLOCK = "__block"
    OWN = "__own"
    POS = "__pos"
    DAY = "__day"

    def own(self) -> Column:
        """True for rows that belong here, false for copies from a neighbour."""
        return F.col(self.OWN) if self.blocked else F.lit(True)

    def close(self, df: DataFrame) -> DataFrame:
        """Drop the copies and the helper columns."""
        if self.blocked:
            df = df.where(F.col(self.OWN))
        helpers = [c for c in df.columns if c.startswith("__")]
        return df.drop(*helpers)


def series_keys(df: DataFrame, key: str) -> tuple[str, ...]:
    """Series never cross a split, so ``split`` joins the key when present."""
    return ("split", key) if "split" in df.columns and key != "split" else (key,)


def is_calendar_bound(df: DataFrame, ts: str) -> bool:
    return isinstance(df.schema[ts].dataType, T.DateType)


def number_rows(df: DataFrame, keys: tuple[str, ...], ts: str) -> DataFrame:
    """0-based position of each row in its series, without a window per series.

    Only the per-day counts of a series meet in one task (one row per calendar
    day); the rows themselves are ranked within (series, day).
    """
    day = F.to_date(F.col(ts))
    counts = df.groupBy(*keys, day.alias(Series.DAY)).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(Series.DAY).rowsBetween(Window.unboundedPreceding, -1)
    by = [*keys, Series.DAY]
    starts = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)],
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"),
    )
    # Null keys and null times are kept: they form a series or a day of their own.
    rows = df.withColumn(Series.DAY, day)
    same = reduce(and_, [rows[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)])
    in_day = Window.partitionBy(*keys, Series.DAY).orderBy(ts)
    return (
        rows.join(starts, same)
        .withColumn(Series.POS, F.col("__start") + F.row_number().over(in_day) - 1)
        .drop("__start", Series.DAY, *[f"__k{i}" for i in range(len(by))])
    )


def lay_out(
    df: DataFrame,
    key: str = "Symbol",
    ts: str = "Date",
    lookback: int = 0,
    lookahead: int = 0,
    block_rows: int = BLOCK_ROWS,
    sparse: Sequence[str] = (),
) -> Series:
    """Prepare ``df`` for window functions that reach ``lookback`` rows back and
    ``lookahead`` rows ahead; with ``sparse`` columns it looks back over so many
    values of each of them instead of rows."""
    keys = series_keys(df, key)
    blocked = not is_calendar_bound(df, ts)
    parts, order = list(keys), ts
    if blocked:
        df = number_rows(df, keys, ts)
        pos = F.col(Series.POS)
        if sparse:
            lookback = reach_over_gaps(df, keys, lookback, sparse)
        first = F.greatest(F.lit(0), F.floor((pos - lookahead) / block_rows)).cast("long")
        last = F.floor((pos + lookback) / block_rows).cast("long")
        df = df.withColumn(Series.BLOCK, F.explode(F.sequence(first, last))).withColumn(
            Series.OWN, F.col(Series.BLOCK) == F.floor(pos / block_rows)
        )
        parts, order = [*keys, Series.BLOCK], Series.POS
    return Series(df, keys, Window.partitionBy(*parts).orderBy(order), blocked)


def deal(df: DataFrame, rows: int, key: str = "Symbol") -> DataFrame:
    """Deal whole calendar-bound series to tasks of about ``TASK_ROWS`` of ``rows`` rows.

    The adaptive plan sizes tasks by shuffled bytes: 64 MB of bars are gigabytes once every
    indicator is a column, and one task more than there are cores takes a round of its own.
    What the cores hold in one round anyway is left to it.  Operators on the same series,
    per split too, need no exchange after this one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rounds = -(-rows // (TASK_ROWS * cores))
    return df.repartition(rounds * cores, key) if rounds > 1 else df


def reach_over_gaps(df: DataFrame, keys: tuple[str, ...], values: int, columns: Sequence[str]) -> int:
    """Rows that hold at least ``values`` values of every column before any row, or all rows before it.

    Numbered rows are counted in granules of twice as many rows.  Granules that hold
    too few values and follow one another are passed over; the longest such run says
    how far to reach.  One row per granule meets in a window.
    """
    granule = 2 * max(1, values)
    # A change from the row before needs both, so a gap takes the value after it along.
    full = reduce(and_, [F.col(c).isNotNull() for c in columns])
    by = [F.col(k) for k in keys]
    held = df.groupBy(*by, F.floor(F.col(Series.POS) / granule).alias("__g")).agg(
        (F.count(F.lit(1)) - 2 * F.count_if(~full) >= values).alias("__dense")
    )
    before = Window.partitionBy(*by).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("__g") - 1 - F.coalesce(F.last(F.when(F.col("__dense"), F.col("__g")), ignorenulls=True).over(before), F.lit(-1))
    longest = held.select(run.alias("__run")).agg(F.max("__run")).first()[0] or 0
    return (longest + 2) * granule


def row_number(series: Series) -> Column:
    """0-based row of the series (or of its block), as the window sees it."""
    return F.row_number().over(series.window) - 1


def add_block_offsets(df: DataFrame, series: Series, columns: list[str]) -> DataFrame:
    """Turn running totals of one block into running totals of the series."""
    by = [*series.keys, Series.BLOCK]
    ends = (
        df.where(F.col(Series.OWN))
        .groupBy(*by)
        .agg(*[F.max_by(c, Series.POS).alias(c) for c in columns])
    )
    earlier = Window.partitionBy(*series.keys).orderBy(Series.BLOCK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = ends.select(*by, *[F.sum(c).over(earlier).alias(f"__off_{c}") for c in columns])
    joined = df.join(offsets, by, "left")
    return joined.withColumns(
        {c: F.col(c) + F.coalesce(F.col(f"__off_{c}"), F.lit(0.0)) for c in columns}
    )
