"""Technical indicators over bars: trend, momentum, volatility, volume, returns.

Each indicator is a small recipe: the columns it yields, how far it looks back
and its columns by stage.  ``add_indicators`` lays the table out once and merges
the stages of all recipes, so any number of indicators share one exchange, one
sort, one window and one pass over the sorted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ewm import alpha_for_span, memory_rows
from tidemark.functions.numeric import ratio
from tidemark.operators.running import Between, Over, add_running
from tidemark.operators.series import Series, add_block_offsets, lay_out, row_number

Stages = dict[int, dict[str, Column | Over | Between]]

# A stage may use the columns of all earlier ones.  BASE holds windows over the given
# columns, DERIVED plain expressions, RUNNING what one pass over the rows adds, in order,
# VALUE plain expressions; helpers that RUNNING starts from are gone by then.
BASE, DERIVED, RUNNING, VALUE = range(4)


@dataclass(frozen=True)
class Indicator:
    columns: tuple[str, ...]
    lookback: int
    stages: Callable[[Series], Stages]
    totals: tuple[str, ...] = ()
    prices: tuple[str, ...] = ()  # whose gaps lengthen what an exponential mean looks back at


def add_indicators(
    df: DataFrame, indicators: Iterable[Indicator], key: str = "Symbol", ts: str = "Date", numbered: bool = False, **layout
) -> DataFrame:
    """Append the columns of all ``indicators``.

    With ``numbered`` the row of its series comes along as ``Series.ROW`` where the rows lie by series and in that order.
    """
    chosen = list(indicators)
    if not chosen:
        return df
    reach = max(i.lookback for i in chosen)
    prices = sorted({p for i in chosen for p in i.prices})
    series = lay_out(df, key, ts, lookback=reach, sparse=prices, **layout)
    stages: Stages = {n: {} for n in (BASE, DERIVED, RUNNING, VALUE)}
    for i in chosen:
        for n, columns in i.stages(series).items():
            stages[n].update(columns)
    if stages[RUNNING]:
        # The window that numbers the rows also brings them in order.
        stages[BASE][Series.ROW] = row_number(series)
    out = series.df
    for n, columns in stages.items():
        if columns:
            out = add_running(out, Series.ROW, columns) if n == RUNNING else out.withColumns(columns)
    totals = [c for i in chosen for c in i.totals]
    if totals and series.blocked:
        out = add_block_offsets(out, series, totals)
    wanted = [c for i in chosen for c in i.columns if c not in df.columns]
    if numbered and stages[RUNNING] and not series.blocked:
        return out.select(*df.columns, *wanted, Series.ROW)
    return series.close(out).select(*df.columns, *wanted)


def _ewm_reach(*alphas: float) -> int:
    return sum(memory_rows(a) for a in alphas)


def _mean(source: str, alpha: float, min_periods: int) -> dict[str, Over]:
    """An exponential mean, named after what it holds."""
    name = f"__{source}_mean_{alpha!r}_{min_periods}".replace(".", "_")
    return {name: Over("ewm", source, min_periods, alpha)}


def _only(columns: dict[str, Over]) -> Column:
    return F.col(next(iter(columns)))


# Rolling statistics are named after what they hold, so recipes that need the
# same one (a mean and the band around it, say) share it.


def _rolled(kind: str, source: str, n: int) -> dict[str, Over]:
    """The statistic of the last n rows, NULL unless all n hold a value."""
    return {f"__{kind}_{source}_{n}": Over(kind, source, n)}


def _prev(s: Series, column: str, rows: int = 1) -> dict[str, Column]:
    return {f"__{column}_{rows}_back": F.lag(column, rows).over(s.window)}


def _growth(column: str, rows: int = 1) -> Column:
    return ratio(F.col(column), F.col(f"__{column}_{rows}_back"))


# --- trend -----------------------------------------------------------------


def sma(n: int = 20, price: str = "Close", name: str | None = None) -> Indicator:
    """Mean of the last n rows."""
    name = name or f"sma_{n}"
    mean = _rolled("avg", price, n)
    return Indicator((name,), n, lambda s: {RUNNING: mean, VALUE: {name: _only(mean)}})


def ema(span: int = 20, price: str = "Close") -> Indicator:
    """Exponential mean with a = 2/(span+1), seeded by the first value."""
    name, a = f"ema_{span}", alpha_for_span(span)
    reach = 1 if span == 1 else _ewm_reach(a) + span
    return Indicator((name,), reach, lambda s: {RUNNING: {name: Over("ewm", price, span, a)}}, prices=(price,))


def price_vs_sma(n: int = 20, price: str = "Close") -> Indicator:
    """Relative distance of the price from its n-row mean."""
    name, rolled = f"price_vs_sma{n}", _rolled("avg", price, n)

    def stages(s: Series) -> Stages:
        mean = _only(rolled)
        return {RUNNING: rolled, VALUE: {name: ratio(F.col(price) - mean, mean)}}

    return Indicator((name,), n, stages)


def macd(fast: int = 12, slow: int = 26, signal: int = 9, price: str = "Close") -> Indicator:
    """Fast minus slow exponential mean, its own exponential mean, and their gap."""
    a_fast, a_slow, a_sig = (alpha_for_span(n) for n in (fast, slow, signal))
    near, far = _mean(price, a_fast, fast), _mean(price, a_slow, slow)

    def stages(s: Series) -> Stages:
        return {
            RUNNING: {**near, **far, "macd": Between((*near, *far)), "macd_signal": Over("ewm", "macd", signal, a_sig)},
            VALUE: {"macd_hist": F.col("macd") - F.col("macd_signal")},
        }

    reach = _ewm_reach(a_slow, a_sig) + slow + signal
    return Indicator(("macd", "macd_signal", "macd_hist"), reach, stages, prices=(price,))


# --- momentum --------------------------------------------------------------


def rsi(n: int = 14, price: str = "Close") -> Indicator:
    """Relative strength index with Wilder smoothing; 100 when nothing was lost."""
    name, a = f"rsi_{n}", 1.0 / n

    def stages(s: Series) -> Stages:
        gains, losses = _mean("__gain", a, n), _mean("__loss", a, n)
        gain, loss = _only(gains), _only(losses)
        move = F.col(price) - F.col(f"__{price}_1_back")
        return {
            BASE: _prev(s, price),
            DERIVED: {
                "__gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))),
                "__loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0))),
            },
            RUNNING: {**gains, **losses},
            VALUE: {name: F.when(loss == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + ratio(gain, loss)))},
        }

    return Indicator((name,), _ewm_reach(a) + n + 1, stages, prices=(price,))


def stochastic(k: int = 14, d: int = 3) -> Indicator:
    """Close inside the k-row high/low range in percent, and its d-row mean."""

    lows, highs, smooth = _rolled("min", "Low", k), _rolled("max", "High", k), _rolled("avg", "stoch_k", d)
    place = Between(("Close", *lows, *highs, *lows), 100.0)

    def stages(s: Series) -> Stages:
        return {RUNNING: {**lows, **highs, "stoch_k": place, **smooth}, VALUE: {"stoch_d": _only(smooth)}}

    return Indicator(("stoch_k", "stoch_d"), k + d, stages)


# --- volatility ------------------------------------------------------------


def _true_range() -> Column:
    high, low, prev = F.col("High"), F.col("Low"), F.col("__Close_1_back")
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def true_range() -> Indicator:
    """Widest of high-low and the gaps to the previous close."""
    return Indicator(
        ("true_range",), 1, lambda s: {BASE: _prev(s, "Close"), DERIVED: {"true_range": _true_range()}}
    )


def atr(n: int = 14) -> Indicator:
    """Wilder mean of the true range, and its ratio to the close."""
    name, a = f"atr_{n}", 1.0 / n

    def stages(s: Series) -> Stages:
        ranges = _mean("__range", a, n)
        mean = _only(ranges)
        return {
            BASE: _prev(s, "Close"),
            DERIVED: {"__range": _true_range()},
            RUNNING: ranges,
            VALUE: {name: mean, "atr_ratio": ratio(mean, F.col("Close"))},
        }

    return Indicator((name, "atr_ratio"), _ewm_reach(a) + n + 1, stages, prices=("High", "Low", "Close"))


def bollinger(n: int = 20, k: float = 2.0, price: str = "Close") -> Indicator:
    """Bands of k sample deviations around the n-row mean."""

    means, deviations = _rolled("avg", price, n), _rolled("stddev_samp", price, n)

    def stages(s: Series) -> Stages:
        p, mid, dev = F.col(price), _only(means), _only(deviations)
        upper, lower = mid + k * dev, mid - k * dev
        return {
            RUNNING: {**means, **deviations},
            VALUE: {
                "bb_upper": upper,
                "bb_middle": mid,
                "bb_lower": lower,
                "bb_bandwidth": ratio(upper - lower, mid),
                "bb_pct_b": ratio(p - lower, upper - lower),
            },
        }

    return Indicator(("bb_upper", "bb_middle", "bb_lower", "bb_bandwidth", "bb_pct_b"), n, stages)


def rolling_volatility(windows: Sequence[int] = (10, 20), price: str = "Close") -> Indicator:
    """Sample deviation of one-row returns, not annualized."""

    rolled = {f"volatility_{n}d": Over("stddev_samp", "__move", n) for n in windows}

    def stages(s: Series) -> Stages:
        return {BASE: _prev(s, price), DERIVED: {"__move": _growth(price) - 1.0}, RUNNING: rolled}

    return Indicator(tuple(f"volatility_{n}d" for n in windows), max(windows) + 1, stages)


# --- volume ----------------------------------------------------------------


def volume_sma(n: int = 20) -> Indicator:
    return sma(n, "Volume", f"volume_sma_{n}")


def volume_ratio(n: int = 20) -> Indicator:
    """Volume relative to its n-row mean."""
    mean = _rolled("avg", "Volume", n)
    return Indicator(("volume_ratio",), n, lambda s: {RUNNING: mean, VALUE: {"volume_ratio": ratio(F.col("Volume"), _only(mean))}})


def obv() -> Indicator:
    """Running volume, signed by the direction of the close."""

    def stages(s: Series) -> Stages:
        sign = F.signum(F.col("Close") - F.col("__Close_1_back"))
        flow = F.coalesce(sign, F.lit(0.0)) * F.col("Volume")
        return {
            BASE: _prev(s, "Close"),
            DERIVED: {"__flow": F.when(s.own(), flow).otherwise(0.0)},
            RUNNING: {"obv": Over("sum", "__flow")},
        }

    return Indicator(("obv",), 1, stages, totals=("obv",))


# --- returns ---------------------------------------------------------------


def lagged_returns(
    horizons: Sequence[int] = (1, 5, 10, 20), log: bool = False, price: str = "Close"
) -> Indicator:
    """Return over the last h rows, simple or logarithmic."""

    def stages(s: Series) -> Stages:
        back = [_prev(s, price, h) for h in horizons]
        return {
            BASE: {name: x for columns in back for name, x in columns.items()},
            DERIVED: {
                f"return_{h}d": F.ln(_growth(price, h)) if log else _growth(price, h) - 1.0
                for h in horizons
            },
        }

    return Indicator(tuple(f"return_{h}d" for h in horizons), max(horizons), stages)
