"""Statistics over the rows of one series, in a single pass over sorted rows.

A window with a sliding frame starts anew at every row, and an exponential mean takes four
windows.  Here the rows of a task, sorted by series and numbered within it, pass through
Arrow batches once: sliding statistics are sums of shifted arrays, exponential means are
composed over rows twice as far apart each time.  Spark deals, sorts and numbers the rows; a task holds one batch, and the
rows of one series (or of one of its blocks) that goes on over several.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.functions.ewm import exponential_mean


@dataclass(frozen=True)
class Over:
    """A statistic of the numeric column ``source`` as a double.

    ``avg``, ``stddev_samp``, ``min`` and ``max`` are over the last ``rows`` rows, NULL unless
    all of them hold a value; ``sum`` is over all rows so far; ``ewm`` is the exponential mean
    with factor ``alpha``, NULL before ``rows`` values.
    """

    kind: str
    source: str
    rows: int = 0
    alpha: float = 0.0

    @property
    def sources(self) -> tuple[str, ...]:
        return (self.source,)


@dataclass(frozen=True)
class Between:
    """``factor * (a - b)``, or that over ``c - d``: NULL where a part is missing or the divisor is 0."""

    sources: tuple[str, ...]
    factor: float = 1.0


def add_running(df: DataFrame, row: str, wanted: dict[str, Over | Between]) -> DataFrame:
    """Append ``wanted``, in order, to rows sorted by series and by ``row``, the 0-based row of the series.

    A source may be a wanted column before it.  Helpers (``__``) that served as a source end here.
    """
    used = {c for x in wanted.values() for c in x.sources if c.startswith("__")}
    fields = [f for f in df.schema.fields if f.name not in wanted and f.name not in used]
    names, added = [f.name for f in fields], [name for name in wanted if name not in used]
    schema = T.StructType([*fields, *[T.StructField(name, T.DoubleType()) for name in added]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_series(batches, row):
            found = _statistics(part, row, wanted)
            new = [pa.array(x, pa.float64(), mask=~held, from_pandas=False) for x, held in map(found.get, added)]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *new], names=[*names, *added])

    return df.mapInArrow(run, schema)


def add_ahead(df: DataFrame, keys: Sequence[str], row: str, price: str, first: int, wanted: dict[str, int]) -> DataFrame:
    """Append prices of rows ahead to rows that lie together by ``keys`` and in order of ``row``; rows may be missing.

    ``__ahead`` is the price ``first`` rows ahead in the series.  Rows where it can be divided by
    the own price stay in the series for ``wanted``, the names of prices so many such rows ahead.
    """
    names = [f.name for f in df.schema.fields]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, df.schema[price].dataType) for n in ("__ahead", *wanted)]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_keys(batches, keys):
            series, at, own = np.cumsum(_starts(part, keys)), part.column(row).to_numpy(), part.column(price)
            if (np.diff(at)[np.diff(series) == 0] <= 0).any():
                raise ValueError("the rows of a series are not together and in order")
            given = own.is_valid().to_numpy(zero_copy_only=False)
            to, seen = _places_ahead(series, first)
            divisor = own.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
            stay = np.flatnonzero(seen & given & given[to] & (divisor != 0))
            new = [own.take(pa.array(to, mask=~seen))]
            for rows in wanted.values():
                later, found = np.zeros(len(series), np.int64), np.zeros(len(series), bool)
                place, found[stay] = _places_ahead(series[stay], rows)
                later[stay] = stay[place]
                new.append(own.take(pa.array(later, mask=~found)))
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *new], names=[*names, "__ahead", *wanted])

    return df.mapInArrow(run, schema)


def _places_ahead(series: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The place so many rows ahead (0 where none is), and where it is of the same series."""
    n = len(series)
    to, seen = np.arange(n) + rows, np.zeros(n, bool)
    m = max(0, n - rows)
    seen[:m] = series[rows:] == series[:m]
    to[~seen] = 0
    return to, seen


def _starts(batch: pa.RecordBatch, keys: Sequence[str], before: pa.RecordBatch | None = None) -> np.ndarray:
    """True for rows whose keys differ from those of the row before, the first one's being the last of ``before``."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = before is None
    for k in keys:
        last = before.column(k).slice(before.num_rows - 1) if before else batch.column(k).slice(0, 1)
        codes = pa.chunked_array([last, batch.column(k)]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        out |= codes[1:] != codes[:-1]
    return out


def _by_keys(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end with a series."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            starts = np.flatnonzero(_starts(batch, keys, held[-1] if held else None))
            if len(starts):
                yield from _joined([*held, batch.slice(0, starts[-1])])
                held = [batch.slice(starts[-1])]
            else:
                held.append(batch)
    yield from _joined(held)


def _whole_series(batches: Iterable[pa.RecordBatch], row: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end with a series."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column(row).to_numpy() == 0)
        if len(starts):
            yield from _joined([*held, batch.slice(0, starts[-1])])
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
    yield from _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []


def _statistics(part: pa.RecordBatch, row: str, wanted: dict[str, Over | Between]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Values, and where there are any, of every wanted column."""
    at = part.column(row).to_numpy().astype(np.int64)
    if not np.array_equal(at, np.where(at == 0, 0, np.concatenate([[-1], at[:-1]]) + 1)):
        raise ValueError("the rows of a series are not together and in order")
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def column(name: str) -> tuple[np.ndarray, np.ndarray]:
        if name not in found:
            x = part.column(name)
            found[name] = (x.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False))
        return found[name]

    with np.errstate(all="ignore"):
        for name, x in wanted.items():
            parts = [column(c) for c in x.sources]
            if isinstance(x, Between):
                found[name] = _between(parts, x.factor)
            elif x.kind == "ewm":
                found[name] = exponential_mean(*parts[0], at, x.alpha, x.rows)
            elif x.kind == "sum":
                found[name] = _total(*parts[0], at)
            else:
                found[name] = _rolled(*parts[0], at, x.rows, _ROLLED[x.kind])
    return found


def _between(parts: list[tuple[np.ndarray, np.ndarray]], factor: float) -> tuple[np.ndarray, np.ndarray]:
    values, held = [x for x, _ in parts], np.logical_and.reduce([given for _, given in parts])
    out = factor * (values[0] - values[1])
    if len(values) == 2:
        return out, held
    divisor = values[2] - values[3]
    return out / divisor, held & (divisor != 0)


def _total(x: np.ndarray, given: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum so far in each series, of what is given."""
    x, bounds = np.where(given, x, 0.0), [*np.flatnonzero(at == 0), len(at)]
    sums, held = np.empty(len(x)), np.empty(len(x), bool)
    for a, b in zip(bounds, bounds[1:]):
        np.cumsum(x[a:b], out=sums[a:b])
        np.logical_or.accumulate(given[a:b], out=held[a:b])
    return sums, held


def _rolled(x: np.ndarray, given: np.ndarray, at: np.ndarray, n: int, stat: Callable) -> tuple[np.ndarray, np.ndarray]:
    """``stat`` over the last n rows, and where those are all of one series and given."""
    out, held, m = np.zeros(len(x)), np.zeros(len(x), bool), len(x) - n + 1
    if m > 0:
        count = np.concatenate([[0], np.cumsum(given)])
        held[n - 1 :] = (count[n:] - count[:m] == n) & (at[n - 1 :] >= n - 1)
        out[n - 1 :] = stat([x[k : k + m] for k in range(n)])
    return (out, held) if stat is not _stddev or n > 1 else (out, np.zeros(len(x), bool))


def _mean(shifted: list[np.ndarray]) -> np.ndarray:
    total = shifted[0].copy()
    for x in shifted[1:]:
        total += x
    return total / len(shifted)


def _stddev(shifted: list[np.ndarray]) -> np.ndarray:
    """Over differences from the first row, so that equal values deviate by exactly nothing."""
    apart = [x - shifted[0] for x in shifted]
    mean, squares = _mean(apart), np.zeros(len(shifted[0]))
    for x in apart:
        squares += (x - mean) ** 2
    return np.sqrt(squares / (len(shifted) - 1))


def _least(shifted: list[np.ndarray]) -> np.ndarray:
    out = shifted[0].copy()
    for x in shifted[1:]:
        np.fmin(out, x, out=out)  # NaN counts as the largest, as in Spark
    return out


def _most(shifted: list[np.ndarray]) -> np.ndarray:
    out = shifted[0].copy()
    for x in shifted[1:]:
        np.maximum(out, x, out=out)
    return out


_ROLLED = {"avg": _mean, "stddev_samp": _stddev, "min": _least, "max": _most}
