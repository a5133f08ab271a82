"""Risk overlay: volatility target, turnover cap, drawdown guard, and historical tail measures."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import sliding
from quantloom.functions.linear import BUCKET_S
from quantloom.functions.stats import clip
from quantloom.functions.windows import col, compound, lag, rolling, row_number, up_to_now
from quantloom.operators import sequential
from quantloom.operators.decay import with_ewma
from quantloom.operators.features import simple_return

FLOOR = 1e-12


@dataclass(frozen=True)
class VolTarget:
    window: int = 20
    target: float = 0.10
    low: float = 0.0
    high: float = 5.0
    shift: int = 1
    periods: float | None = 252.0


@dataclass(frozen=True)
class DrawdownGuard:
    limit: float = 0.2
    mode: str = "flatten"
    floor: float = 0.0
    cooldown: int = 0
    shift: int = 0


@dataclass(frozen=True)
class RiskConfig:
    max_leverage: float = 1.0
    vol: VolTarget | None = field(default_factory=VolTarget)
    max_turnover: float | None = 1.0
    smooth_alpha: float | None = None
    guard: DrawdownGuard | None = None
    var_es: bool = False

    def __post_init__(self):
        if self.var_es:
            raise NotImplementedError("the overlay has no step by value at risk or expected shortfall")
        if self.max_leverage <= 0 or (self.max_turnover is not None and self.max_turnover <= 0):
            raise ValueError("leverage and turnover are positive")
        if self.guard and self.guard.mode not in ("flatten", "linear_delever"):
            raise ValueError("unknown guard mode")


def rolling_vol(returns: Column | str, n: int) -> Column:
    vol = rolling(F.stddev_pop, returns, n)
    return F.when(vol.isNotNull(), F.greatest(vol, F.lit(FLOOR)))


def vol_scale(vol: Column | str, cfg: VolTarget) -> Column:
    """Scale to the volatility target from volatility known ``shift`` rows ago; 1 while that is unknown."""
    year = math.sqrt(cfg.periods) if cfg.periods else 1.0
    scale = clip(cfg.target / (col(vol) * year), cfg.low, cfg.high)
    return F.coalesce(lag(scale, cfg.shift), F.lit(1.0))


def turnover(position: Column | str) -> Column:
    return F.coalesce(F.abs(col(position) - lag(position)), F.lit(0.0))


def drawdown(equity: Column | str) -> Column:
    """1 - equity over its running maximum, 0 where that is undefined."""
    return F.coalesce(1 - F.try_divide(col(equity), F.max(col(equity)).over(up_to_now())), F.lit(0.0))


def cooldown(trigger: Column | str, bars: int) -> Column:
    """True on a trigger and on the ``bars`` rows after it."""
    rn = row_number()
    since = rn - F.last(F.when(col(trigger), rn), ignorenulls=True).over(up_to_now())
    return F.coalesce(since <= max(bars, 0), F.lit(False))


def guarded(panel: DataFrame, cfg: DrawdownGuard, position: str = "position", returns: str = "returns", start: float = 1.0) -> DataFrame:
    """panel with equity_proxy, drawdown, guard_active, guard_scale and the guarded position.

    The proxy earns the position of the row before, guard left out, so nothing feeds back.
    """
    out = panel.withColumn("_pnl", lag(position) * F.col(returns)).withColumn("equity_proxy", start * compound("_pnl"))
    out = out.withColumn("drawdown", drawdown("equity_proxy")).withColumn("_hit", F.col("drawdown") >= cfg.limit)
    out = out.withColumn("guard_active", cooldown("_hit", cfg.cooldown))
    if cfg.mode == "flatten":
        scale = F.when(F.col("guard_active"), F.lit(0.0)).otherwise(1.0)
    else:
        scale = F.when(F.col("guard_active"), F.lit(cfg.floor)).otherwise(clip(1 - F.col("drawdown") / cfg.limit, cfg.floor, 1.0))
    out = out.withColumn("_scale", scale)
    out = out.withColumn("guard_scale", F.coalesce(lag("_scale", cfg.shift), F.lit(1.0)) if cfg.shift else F.col("_scale"))
    return out.withColumn(position, F.col(position) * F.col("guard_scale")).drop("_pnl", "_hit", "_scale")


def cap_turnover(panel: DataFrame, cap: float, position: str = "position", keep: tuple[str, ...] = ("instrument", "ts"), bucket_s: int = BUCKET_S) -> DataFrame:
    """The kept columns and the position moving by at most ``cap`` a row from what it was after capping, by time buckets."""
    return sequential.run_scan(panel, [position], [position], sequential.capped(cap), tuple(c for c in keep if c != position), bucket_s)


def historical_es(panel: DataFrame, returns: str, n: int, alpha: float, chunk_rows: int = sliding.CHUNK_ROWS) -> DataFrame:
    """panel with var, the interpolated alpha quantile of the last n returns, and es, the mean of those that are at most var.

    Both are NULL unless the last n rows all have a return. A task holds a chunk of rows and one sorted window.
    """
    keep = tuple(c for c in panel.columns if c not in ("var", "es"))
    return sliding.run_sliding(panel, [returns], ["var", "es"], lambda x, first, last: sliding.tail(x, first, last, n, alpha), n, keep=keep, chunk_rows=chunk_rows)


def historical_var(panel: DataFrame, returns: str, n: int, alpha: float) -> DataFrame:
    """panel with var, as historical_es gives it."""
    return historical_es(panel, returns, n, alpha).drop("es")


def overlay(panel: DataFrame, cfg: RiskConfig = RiskConfig(), start: float = 1.0) -> DataFrame:
    """(instrument, ts, price, returns, position_raw, vol, vol_scale, turnover columns, guard columns, position_target).

    The panel has price and position. Steps: volatility target, smoothing, turnover cap, drawdown guard, leverage bound;
    a position that is still unknown is 0.
    """
    out = panel.withColumn("returns", simple_return()).withColumn("position_raw", F.col("position"))
    if cfg.vol:
        out = out.withColumn("vol", rolling_vol("returns", cfg.vol.window)).withColumn("vol_scale", vol_scale("vol", cfg.vol))
    else:
        out = out.withColumn("vol", F.lit(None).cast("double")).withColumn("vol_scale", F.lit(1.0))
    out = out.withColumn("position", clip(F.col("position") * F.col("vol_scale"), -cfg.max_leverage, cfg.max_leverage))
    out = out.withColumn("position_vol", F.col("position"))
    keep = ("instrument", "ts", "price", "returns", "position_raw", "vol", "vol_scale", "position_vol")
    if cfg.smooth_alpha is not None:
        out = with_ewma(out, "position", cfg.smooth_alpha, "position")
    if cfg.max_turnover is not None:
        out = cap_turnover(out, cfg.max_turnover, keep=keep)
    out = out.withColumn("position_capped", F.col("position")).withColumn("turnover", turnover("position"))
    if cfg.guard:
        out = guarded(out, cfg.guard, start=start)
    else:
        out = out.withColumn("equity_proxy", F.product(1 + F.coalesce("returns", F.lit(0.0))).over(up_to_now())).withColumn("drawdown", F.lit(0.0)).withColumn("guard_active", F.lit(False)).withColumn("guard_scale", F.lit(1.0))
    return out.withColumn("position_target", F.coalesce(clip("position", -cfg.max_leverage, cfg.max_leverage), F.lit(0.0))).drop("position")


def late_nulls(panel: DataFrame, returns: str = "returns") -> DataFrame:
    """NULL returns after the first row of each instrument; any makes the overlay's input invalid."""
    return panel.withColumn("_rn", row_number()).groupBy("instrument").agg(F.sum(F.when((F.col("_rn") > 1) & F.col(returns).isNull(), 1).otherwise(0)).alias("n_late_nulls"))
