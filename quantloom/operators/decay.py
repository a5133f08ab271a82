"""Decay and smoothing: exponential means, weighted kernels, position inertia, and half-life estimates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import linear
from quantloom.functions.stats import both, correlation
from quantloom.functions.windows import by_instrument, by_time, col, lag, last_rows, row_number


def half_life_to_alpha(half_life: float) -> float:
    if half_life <= 0:
        raise ValueError("a half-life is positive")
    return 1 - math.exp(-math.log(2) / half_life)


def kernel_weights(kind: str, n: int, power: float = 1.0, alpha: float = 0.1) -> list[float]:
    """Weights of the last n rows, oldest first, that sum to 1."""
    if n < 1 or kind not in ("linear", "step", "power", "ewma"):
        raise ValueError("unknown kernel or window")
    raw = {
        "linear": [float(i) for i in range(1, n + 1)],
        "step": [1.0] * n,
        "power": [float(i) ** power for i in range(1, n + 1)],
        "ewma": [(1 - alpha) ** (n - i) * alpha for i in range(1, n + 1)],
    }[kind]
    return [w / sum(raw) for w in raw]


def kernel_mean(x: Column | str, weights: list[float], min_periods: int | None = None) -> Column:
    """Weighted sum of the last rows. Before the window is full, the newest rows meet the last weights, not scaled up."""
    n = len(weights)
    x = col(x)
    total = sum((F.coalesce(F.lag(x, k).over(by_time()), F.lit(0.0)) * weights[n - 1 - k] for k in range(n)), F.lit(0.0))
    return F.when(F.count(x).over(last_rows(n)) >= (min_periods or n), total)


def ewma_frame(x: Column | str, alpha: float, tolerance: float = 1e-15) -> Column:
    """Recursive exponential mean of a column without NULL, as a weighted sum over the rows that still matter.

    Rows older than the frame weigh less than ``tolerance`` together. With NULL inside a series use ewma().
    """
    n = max(2, math.ceil(math.log(tolerance) / math.log(1 - alpha)))
    values = F.collect_list(col(x)).over(last_rows(n))
    rn = row_number()
    start = F.when(rn <= n, F.element_at(values, 1)).otherwise(0.0)
    terms = F.aggregate(values, F.lit(0.0), lambda y, v: y * (1 - alpha) + v * alpha)
    return terms + start * F.pow(F.lit(1 - alpha), F.least(rn, F.lit(n)))


def with_ewma(panel: DataFrame, x: str, alpha: float, name: str, min_periods: int = 1, bucket_s: int = linear.BUCKET_S) -> DataFrame:
    """panel with the recursive exponential mean of x as ``name``, by time buckets, without a task that holds a series.

    Over a gap of NULL the old value decays by a step a row and weights are renormalised; NULL rows carry the value.
    """
    rows = linear.placed(panel, x, bucket_s)
    left = F.pow(F.lit(1 - alpha), F.col("_at") - F.col("_held"))  # what is left of the old value's weight
    known, begun = F.col(x).isNotNull(), F.col("_held").isNotNull()
    keep = F.when(~known, 1.0).when(begun, left / (left + alpha)).otherwise(0.0)
    add = F.when(~known, 0.0).when(begun, F.col(x) * alpha / (left + alpha)).otherwise(F.col(x))
    out = linear.scan(rows, keep, add, name, bucket_s)
    return out.withColumn(name, F.when(F.col("_seen") >= max(min_periods, 1), F.col(name))).drop("_at", "_seen", "_held", "_was")


def ewma(panel: DataFrame, x: str, alpha: float, min_periods: int = 1, bucket_s: int = linear.BUCKET_S) -> DataFrame:
    """(instrument, ts, x_ewma) for any column, NULL included."""
    return with_ewma(panel.select("instrument", "ts", x), x, alpha, f"{x}_ewma", min_periods, bucket_s).select("instrument", "ts", f"{x}_ewma")


def ewma_by_time(panel: DataFrame, x: str, half_life_s: float, min_periods: int = 1, carry: bool = True, bucket_s: int = linear.BUCKET_S) -> DataFrame:
    """(instrument, ts, x_ewma) with weights by the time since the row before.

    NULL carries the value, or gives NULL without ``carry``; the step of time to a NULL row is lost.
    """
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    rows = linear.placed(panel.select("instrument", "ts", x), x, bucket_s)
    weight = linear.half_life_weight(seconds("ts") - seconds("_was"), half_life_s)
    known, begun = F.col(x).isNotNull(), F.col("_held").isNotNull()
    keep = F.when(~known, 1.0).when(begun, weight).otherwise(0.0)
    add = F.when(~known, 0.0).when(begun, (1 - weight) * F.col(x)).otherwise(F.col(x))
    out = linear.scan(rows, keep, add, "_mean", bucket_s)
    shown = (F.col("_seen") >= max(min_periods, 1)) & (F.lit(carry) | known)
    return out.select("instrument", "ts", F.when(shown, F.col("_mean")).alias(f"{x}_ewma"))


def inertia(panel: DataFrame, target: str, half_life: float, bucket_s: int = linear.BUCKET_S) -> DataFrame:
    """(instrument, ts, position): the target with inertia of the given half-life in rows; NULL leaves the position."""
    alpha = half_life_to_alpha(half_life)
    rows = linear.placed(panel.select("instrument", "ts", target), target, bucket_s)
    known, begun = F.col(target).isNotNull(), F.col("_held").isNotNull()
    keep = F.when(~known, 1.0).when(begun, 1 - alpha).otherwise(0.0)
    add = F.when(~known, 0.0).when(begun, alpha * F.col(target)).otherwise(F.col(target))
    return linear.scan(rows, keep, add, "_moved", bucket_s).select("instrument", "ts", F.when(F.col("_seen") >= 1, F.col("_moved")).alias("position"))


@dataclass(frozen=True)
class DecayConfig:
    kind: str = "none"
    alpha: float = 0.1
    window: int = 20
    power: float = 1.0
    min_periods: int = 1
    fill: float | None = None
    shift: int = 0

    def __post_init__(self):
        if not 0 < self.alpha <= 1 or self.window < 1 or self.min_periods < 1 or self.shift < 0:
            raise ValueError("decay settings are out of range")


def apply_decay(panel: DataFrame, x: str, cfg: DecayConfig) -> DataFrame:
    """(instrument, ts, x_decay): gaps filled, decayed, shifted, and what is still missing filled."""
    filled = lambda c: F.coalesce(c, F.lit(cfg.fill)) if cfg.fill is not None else F.col(c)
    panel = panel.select("instrument", "ts", filled(x).alias(x))
    if cfg.kind == "ewma":
        out = ewma(panel, x, cfg.alpha, cfg.min_periods).withColumnRenamed(f"{x}_ewma", "_d")
    elif cfg.kind == "none":
        out = panel.select("instrument", "ts", F.col(x).alias("_d"))
    else:
        weights = kernel_weights(cfg.kind, cfg.window, cfg.power)
        out = panel.select("instrument", "ts", kernel_mean(x, weights, cfg.min_periods).alias("_d"))
    out = out.withColumn("_d", lag("_d", cfg.shift)) if cfg.shift else out
    return out.select("instrument", "ts", filled("_d").alias(f"{x}_decay"))


def ar1_half_life(panel: DataFrame, x: str) -> DataFrame:
    """(instrument, phi, half_life): slope of x on its lag over complete pairs; half-life only for 0 < phi < 1."""
    now, before = both("_now", "_before")
    pairs = panel.select("instrument", F.col(x).alias("_now"), lag(x).alias("_before"))
    phi = pairs.groupBy("instrument").agg(F.try_divide(F.covar_pop(now, before), F.var_pop(before)).alias("phi"))
    inside = (F.col("phi") > 0) & (F.col("phi") < 1)
    return phi.withColumn("half_life", F.when(inside, -math.log(2) / F.log(F.when(inside, F.col("phi")))))


def ic_decay_curve(panel: DataFrame, signal: str, returns: str, horizons: tuple[int, ...]) -> DataFrame:
    """(instrument, horizon, ic): correlation of the signal with the return ``horizon`` rows later."""
    led = panel.select("instrument", F.col(signal).alias("_s"), *[F.lead(returns, h).over(by_time()).alias(f"_r{h}") for h in horizons])
    wide = led.groupBy("instrument").agg(*[correlation("_s", f"_r{h}").alias(f"_ic{h}") for h in horizons])
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_ic{h}").alias("ic")) for h in horizons]))
    return wide.select("instrument", cells.alias("c")).select("instrument", "c.horizon", "c.ic")


def max_abs(x: str) -> Column:
    return F.max(F.abs(x)).over(by_instrument())
