"""Feature tables: indicators, warm-up removal, targets, checks, metadata."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators.indicators import Indicator, add_indicators
from tidemark.operators.leakage import verify_no_leakage
from tidemark.operators.profile import feature_quality
from tidemark.operators.series import Series
from tidemark.operators.targets import LABELS, classification_target, regression_targets, targets_in_order


@dataclass(frozen=True)
class FeatureConfig:
    """What to compute; the defaults are the standard 28 features."""

    sma: tuple[int, ...] = (20, 50)
    ema: tuple[int, ...] = (20, 50)
    price_vs_sma: tuple[int, ...] = (20, 50)
    macd: tuple[int, int, int] | None = (12, 26, 9)
    rsi: int | None = 14
    stochastic: tuple[int, int] | None = (14, 3)
    atr: int | None = 14
    bollinger: tuple[int, float] | None = (20, 2.0)
    bollinger_bandwidth: bool = True
    bollinger_pct_b: bool = True
    volatility: tuple[int, ...] = (10, 20)
    volume_sma: int | None = 20
    volume_ratio: bool = True
    obv: bool = True
    returns: tuple[int, ...] = (1, 5, 10, 20)
    log_returns: bool = False
    groups: tuple[str, ...] = ("trend", "momentum", "volatility", "volume", "returns")
    drop_warmup: bool = True
    label_horizon: int = 1
    buy: float = 0.0075
    sell: float = -0.0075
    return_horizons: tuple[int, ...] = (1, 5, 10)
    extra: tuple[Indicator, ...] = field(default=(), compare=False, repr=False)

    def indicators(self) -> list[Indicator]:
        chosen: dict[str, list[Indicator]] = {
            "trend": [
                *map(ind.sma, self.sma),
                *map(ind.ema, self.ema),
                *map(ind.price_vs_sma, self.price_vs_sma),
                *([ind.macd(*self.macd)] if self.macd else []),
            ],
            "momentum": [
                *([ind.rsi(self.rsi)] if self.rsi else []),
                *([ind.stochastic(*self.stochastic)] if self.stochastic else []),
            ],
            "volatility": [
                *([ind.atr(self.atr)] if self.atr else []),
                *([ind.bollinger(*self.bollinger)] if self.bollinger else []),
                *([ind.rolling_volatility(self.volatility)] if self.volatility else []),
            ],
            "volume": [
                *([ind.volume_sma(self.volume_sma)] if self.volume_sma else []),
                *([ind.volume_ratio(self.volume_sma or 20)] if self.volume_ratio else []),
                *([ind.obv()] if self.obv else []),
            ],
            "returns": [ind.lagged_returns(self.returns, self.log_returns)] if self.returns else [],
        }
        return [i for g, items in chosen.items() if g in self.groups for i in items] + list(self.extra)

    def columns(self) -> list[str]:
        skip = set()
        if not self.bollinger_bandwidth:
            skip.add("bb_bandwidth")
        if not self.bollinger_pct_b:
            skip.add("bb_pct_b")
        return [c for i in self.indicators() for c in i.columns if c not in skip]

    def target_columns(self) -> list[str]:
        return ["target_classification", "target_label", *[f"target_return_{h}d" for h in self.return_horizons]]

    def digest(self) -> str:
        """First 12 hex digits of the SHA-256 of the sorted settings."""
        settings = {k: v for k, v in asdict(self).items() if k != "extra"}
        return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:12]


def build_features(bars: DataFrame, config: FeatureConfig = FeatureConfig(), **kw) -> DataFrame:
    """All configured features; with ``drop_warmup`` only complete rows remain."""
    out = add_indicators(bars, config.indicators(), **kw)
    out = out.select(*bars.columns, *config.columns(), *[c for c in out.columns if c == Series.ROW and c not in bars.columns])
    return out.dropna(subset=config.columns()) if config.drop_warmup else out


def feature_table(bars: DataFrame, config: FeatureConfig = FeatureConfig(), **kw) -> DataFrame:
    """Features and targets; the targets look ahead over the rows that remain."""
    out = build_features(bars, config, numbered=Series.ROW not in bars.columns, **kw)
    if Series.ROW in out.columns and Series.ROW not in bars.columns:
        # The rows still lie as the indicators' window sorted them.
        return targets_in_order(out, config.label_horizon, config.buy, config.sell, config.return_horizons, kw.get("key", "Symbol"))
    out = classification_target(out, config.label_horizon, config.buy, config.sell, **kw)
    return regression_targets(out, config.return_horizons, **kw)


def checked_feature_table(
    bars: DataFrame, config: FeatureConfig = FeatureConfig(), order: str | None = None, **kw
) -> DataFrame:
    """The feature table, or ``LeakageError``; the checks read the stored table.

    ``order`` names the bars' arrival number; with it rows that arrived out of date
    order are an error too.
    """
    from tidemark.sources.storage import stored

    table = stored(feature_table(bars, config, **kw), "features")
    verify_no_leakage(table, config.columns(), config.target_columns(), order, **kw)
    return table


def feature_category(name: Column) -> dict[str, Column]:
    """Membership per category by name part; a feature may be in several."""
    # The name parts of each category.
    parts = {
        "trend": ("sma", "ema", "macd"),
        "momentum": ("rsi", "stoch"),
        "volatility": ("atr", "bb_", "volatility"),
        "volume": ("volume", "obv"),
    }
    found = {c: F.greatest(F.lit(False), *[name.contains(p) for p in ps]) for c, ps in parts.items()}
    return {**found, "returns": name.startswith("return_")}


def feature_categories(df: DataFrame, features: list[str]) -> DataFrame:
    """(category, feature) pairs with the number of values each feature has."""
    counted = df.agg(*[F.count(c).alias(c) for c in features]).unpivot([], features, "feature", "n_values")
    named = [F.when(hit, F.lit(c)) for c, hit in feature_category(F.col("feature")).items()]
    return counted.select(F.explode(F.array_compact(F.array(*named))).alias("category"), "feature", "n_values")


def split_summary(bars: DataFrame, features: DataFrame, table: DataFrame) -> DataFrame:
    """Per split: rows in, rows after warm-up, rows out, label counts, date range."""
    n = lambda df, name: df.groupBy("split").agg(F.count(F.lit(1)).alias(name))
    out = table.groupBy("split").agg(
        F.count(F.lit(1)).alias("final_rows"),
        *[
            F.count_if(F.col("target_classification") == k).alias(f"n_{v.lower()}")
            for k, v in LABELS.items()
        ],
        F.min("Date").alias("start_date"),
        F.max("Date").alias("end_date"),
    )
    return (
        n(bars, "initial_rows")
        .join(n(features, "complete_rows"), "split", "left")
        .join(out, "split", "left")
        .fillna(0)
        .withColumn("warmup_rows_dropped", F.col("initial_rows") - F.col("complete_rows"))
        .drop("complete_rows")
    )


def feature_metadata(table: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """One row describing the table, for a JSON sink."""
    names = config.columns()
    return table.agg(
        F.lit(config.digest()).alias("config_version_hash"),
        F.lit(len(names)).alias("feature_count"),
        F.array(*[F.lit(n) for n in names]).alias("feature_names"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("Date").alias("start_date"),
        F.max("Date").alias("end_date"),
    )


__all__ = [
    "FeatureConfig",
    "build_features",
    "checked_feature_table",
    "feature_categories",
    "feature_metadata",
    "feature_quality",
    "feature_table",
    "split_summary",
]
