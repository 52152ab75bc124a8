"""Exact quantiles by refinement of order-preserving digits.

The built-in ``percentile`` keeps every distinct value of a column in one buffer.  Here
a double is a 64-bit key in value order, cut into four digits of 16 bits.  One pass
counts rows per (column, leading digit) and finds the digit that holds each wanted
rank; three more passes count the next digit among the rows that share the digits found
so far.  The plan and the number of passes are the same at every size; a task holds at
most 65,536 counters per column, and so does the window that adds them up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGIT, DIGITS = 16, 4
SIGN = np.uint64(1 << 63)
CELLS = pa.schema([("i", pa.int32()), ("lead", pa.int64()), ("digit", pa.int32()), ("n", pa.int64())])


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned keys in the same order; both zeros are one value."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def key_value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _counts(df: DataFrame, columns: Sequence[str], level: int, leads: dict[int, list[int]]) -> DataFrame:
    """(i, lead, digit, n): rows per column and digit of a level, below the leading digits asked for."""
    shift = np.uint64(64 - DIGIT * (level + 1))
    asked = {i: np.array(sorted(set(v)), np.uint64) for i, v in leads.items()}
    low = np.uint64((1 << DIGIT) - 1)

    def cells(i: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        values, n = np.unique(keys, return_counts=True)
        if len(values):
            lead, digit = (values >> np.uint64(DIGIT)).astype(np.int64), (values & low).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i, np.int32)), pa.array(lead), pa.array(digit), pa.array(n.astype(np.int64))], schema=CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros((len(columns), 1 << DIGIT), np.int64) if level == 0 else None
        for batch in batches:
            for i, column in enumerate(batch.columns):
                x = column.drop_null().to_numpy(zero_copy_only=False)
                keys = ordered_keys(x[~np.isnan(x)]) >> shift
                if first is not None:
                    first[i] += np.bincount(keys.astype(np.int64), minlength=1 << DIGIT)
                elif i in asked:
                    lead = keys >> np.uint64(DIGIT)
                    at = np.minimum(np.searchsorted(asked[i], lead), len(asked[i]) - 1)
                    yield from cells(i, keys[asked[i][at] == lead])
        if first is not None:
            i, digit = np.nonzero(first)
            arrays = [i.astype(np.int32), np.zeros(len(i), np.int64), digit.astype(np.int32), first[i, digit]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=CELLS)

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    return rows.mapInArrow(count, "i int, lead long, digit int, n long").groupBy("i", "lead", "digit").agg(F.sum("n").alias("n"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(feature, p, value)`` with linear interpolation between ranks.

    Nulls and NaN do not count; a column without values has no rows.  ``df`` is read
    four times: hand in a stored table, not a long plan.
    """
    spark = df.sparkSession
    probs = [float(p) for p in probs]
    whole = Window.partitionBy("i", "lead")
    upto = F.sum("n").over(whole.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
    first = _counts(df, columns, 0, {}).select("i", "digit", "n", upto.alias("upto"), F.sum("n").over(whole).alias("total"))
    rank = [p * (F.col("total") - 1) for p in probs]
    ends = F.array(*[F.struct(F.lit(j).alias("j"), f(r).cast("long").alias("k")) for j, r in enumerate(rank) for f in (F.floor, F.ceil)])
    here = F.filter(ends, lambda e: (e["k"] >= F.col("upto") - F.col("n")) & (e["k"] < F.col("upto")))
    found = first.select("i", "digit", "total", (F.col("upto") - F.col("n")).alias("before"), F.explode(F.array_distinct(here)).alias("e"))
    # From here on two ranks per column and quantile: sized by the arguments, not by the data.
    kept = found.collect()
    totals = {r["i"]: r["total"] for r in kept}
    places = {(r["i"], r["e"]["j"], r["e"]["k"]): (r["digit"], r["e"]["k"] - r["before"]) for r in kept}
    for level in range(1, DIGITS if places else 0):
        leads: dict[int, list[int]] = {}
        for (i, _, _), (lead, _) in places.items():
            leads.setdefault(i, []).append(lead)
        wanted = spark.createDataFrame(
            [(i, lead, j, k, left) for (i, j, k), (lead, left) in places.items()], "i int, lead long, j int, k long, left long"
        )
        counted = _counts(df, columns, level, leads).select("i", "lead", "digit", "n", upto.alias("upto"))
        inside = (F.col("left") >= F.col("upto") - F.col("n")) & (F.col("left") < F.col("upto"))
        hits = counted.join(F.broadcast(wanted), ["i", "lead"]).where(inside)
        step = {}
        for r in hits.select("i", "j", "k", "lead", "digit", (F.col("left") - F.col("upto") + F.col("n")).alias("rest")).collect():
            step[r["i"], r["j"], r["k"]] = ((r["lead"] << DIGIT) | r["digit"], r["rest"])
        places = step
    rows = []
    for i, total in sorted(totals.items()):
        for j, p in enumerate(probs):
            at = p * (total - 1)
            a, b = (key_value(places[i, j, k][0]) for k in (math.floor(at), math.ceil(at)))
            rows.append((columns[i], p, a if a == b else a + (b - a) * (at % 1.0)))
    return spark.createDataFrame(rows, "feature string, p double, value double")

