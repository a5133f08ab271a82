"""Signals: scores from features, positions from scores, and ensembles. A signal is a name and two column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.stats import clip
from quantloom.functions.windows import by_instrument
from quantloom.operators.features import momentum, zscore


@dataclass(frozen=True)
class PositionRule:
    """tanh: L * tanh(k * x). scaled_clip: x over its largest absolute value in the series, to +-L. clip: x to +-L."""

    method: str = "tanh"
    max_leverage: float = 1.0
    k: float = 1.0

    def __post_init__(self):
        if self.method not in ("tanh", "scaled_clip", "clip") or self.max_leverage <= 0:
            raise ValueError("unknown method or leverage")

    def __call__(self, score: Column) -> Column:
        if self.method == "tanh":
            return self.max_leverage * F.tanh(self.k * score)
        if self.method == "scaled_clip":
            score = F.try_divide(score, F.max(F.abs(score)).over(by_instrument()))
        return clip(score, -self.max_leverage, self.max_leverage)


class Signal(Protocol):
    name: str
    rule: PositionRule

    def alpha(self, columns: list[str]) -> Column: ...


@dataclass(frozen=True)
class Momentum:
    """z-score of momentum: the feature z_mom_w if there is one, else from ret_1."""

    window: int = 20
    rule: PositionRule = field(default_factory=PositionRule)
    sign: float = 1.0
    name: str = "momentum"

    def alpha(self, columns: list[str]) -> Column:
        if f"z_mom_{self.window}" in columns:
            return self.sign * F.col(f"z_mom_{self.window}")
        return self.sign * F.col(f"_z_{self.window}")

    def prepare(self, features: DataFrame) -> DataFrame:
        if f"z_mom_{self.window}" in features.columns:
            return features
        return features.withColumn("_m", momentum("ret_1", self.window)).withColumn(f"_z_{self.window}", zscore("_m", self.window)).drop("_m")


def mean_reversion(window: int = 20, rule: PositionRule = PositionRule()) -> Momentum:
    """The negative of momentum."""
    return Momentum(window, rule, -1.0, "mean_reversion")


def run_signal(features: DataFrame, signal: Momentum) -> DataFrame:
    """(instrument, ts, alpha, position); rows without a score are dropped before the position is formed."""
    ready = signal.prepare(features)
    scored = ready.select("instrument", "ts", signal.alpha(ready.columns).alias("alpha")).filter("alpha is not null")
    return scored.withColumn("position", signal.rule(F.col("alpha")))


@dataclass(frozen=True)
class Ensemble:
    signals: tuple[Momentum, ...]
    weights: tuple[float, ...] | None = None
    method: str = "sum"
    normalise: bool = True
    rule: PositionRule = field(default_factory=PositionRule)

    def resolved(self) -> list[float]:
        weights = list(self.weights or [1.0 / len(self.signals)] * len(self.signals))
        total = sum(abs(w) for w in weights)
        if len(weights) != len(self.signals) or total == 0:
            raise ValueError("one weight a signal, not all 0")
        return [w / total for w in weights] if self.normalise else weights


def run_ensemble(features: DataFrame, cfg: Ensemble) -> DataFrame:
    """(instrument, ts, alpha, position) of the weighted signals; sum skips missing ones, mean divides by those present."""
    for signal in cfg.signals:
        features = signal.prepare(features)
    alphas = [w * s.alpha(features.columns) for w, s in zip(cfg.resolved(), cfg.signals, strict=True)]
    total = sum((F.coalesce(a, F.lit(0.0)) for a in alphas), F.lit(0.0))
    present = sum((a.isNotNull().cast("int") for a in alphas), F.lit(0))
    alpha = total if cfg.method == "sum" else F.try_divide(total, present)
    kept = features.select("instrument", "ts", alpha.alias("alpha"), present.alias("_n")).filter("_n > 0" if cfg.method == "mean" else f"_n = {len(alphas)}")
    return kept.drop("_n").withColumn("position", cfg.rule(F.col("alpha")))
