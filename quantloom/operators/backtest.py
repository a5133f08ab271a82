"""Backtest accounting: a position earns the next bar's return; costs are paid on changes of the applied position."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.windows import by_instrument, compound, lag, row_number, up_to_before, up_to_now
from quantloom.operators.features import simple_return
from quantloom.operators.risk import turnover


@dataclass(frozen=True)
class BacktestConfig:
    initial_equity: float = 1.0
    cost_bps: float = 0.0
    slippage_bps: float = 0.0
    max_leverage: float = 1.0
    periods: float = 252.0

    def __post_init__(self):
        if self.initial_equity <= 0 or self.cost_bps < 0 or self.slippage_bps < 0 or self.max_leverage <= 0 or self.periods <= 0:
            raise ValueError("backtest settings are out of range")


def align(price: DataFrame, position: DataFrame) -> DataFrame:
    """Rows that both have, by instrument and time."""
    return price.join(position, ["instrument", "ts"], "inner")


def costs(turned: Column | str, cfg: BacktestConfig) -> Column:
    turned = F.col(turned) if isinstance(turned, str) else turned
    return turned * ((cfg.cost_bps + cfg.slippage_bps) / 1e4)


def run_bars(panel: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """Bars of a panel with price and position, the first of each instrument left out, as it has no return.

    applied is the position of the bar before; the first applied position is free of costs; equity stops at 0.
    """
    bars = panel.withColumn("returns", simple_return()).withColumn("applied", lag("position")).withColumn("_rn", row_number()).filter("_rn > 1").drop("_rn")
    bars = bars.withColumn("turnover", turnover("applied")).withColumn("costs", costs("turnover", cfg))
    bars = bars.withColumn("gross", F.col("applied") * F.col("returns")).withColumn("pnl", F.col("gross") - F.col("costs"))
    bars = bars.withColumn("equity", cfg.initial_equity * compound("pnl"))
    bars = bars.withColumn("drawdown_neg", F.coalesce(F.try_divide(F.col("equity"), F.max("equity").over(up_to_now())) - 1, F.lit(0.0)))
    return bars.withColumn("trade", F.coalesce(F.col("applied") - lag("applied"), F.lit(0.0))).withColumn("cum_costs", F.sum("costs").over(up_to_now()))


def summary(bars: DataFrame, cfg: BacktestConfig = BacktestConfig()) -> DataFrame:
    """One row an instrument: bars, final equity, total return, cagr, volatility, Sharpe ratio, drawdown, turnover, costs."""
    out = bars.groupBy("instrument").agg(
        F.count("*").alias("bars"),
        F.max_by("equity", "ts").alias("final_equity"),
        F.avg("pnl").alias("_mean"),
        (F.stddev_pop("pnl") * math.sqrt(cfg.periods)).alias("volatility"),
        F.min("drawdown_neg").alias("max_drawdown"),
        F.sum("turnover").alias("turnover"),
        F.sum("costs").alias("costs"),
    )
    ratio = F.col("final_equity") / cfg.initial_equity
    return out.select(
        "instrument",
        "bars",
        "final_equity",
        (ratio - 1).alias("total_return"),
        F.when(ratio <= 0, -1.0).otherwise(F.pow(F.greatest(ratio, F.lit(1e-300)), cfg.periods / F.col("bars")) - 1).alias("cagr"),
        "volatility",
        F.coalesce(F.try_divide(F.col("_mean") * cfg.periods, F.col("volatility")), F.lit(0.0)).alias("sharpe"),
        "max_drawdown",
        "turnover",
        "costs",
    )


def events(bars: DataFrame) -> DataFrame:
    """(instrument, ts, event): signal flips, cost spikes of at least 0.8 of the highest cost, and new lows of drawdown."""
    marked = (
        bars.withColumn("_flip", F.col("position") != lag("position"))
        .withColumn("_top", F.greatest(F.max("costs").over(by_instrument()), F.lit(1e-12)))
        .withColumn("_low", F.coalesce(F.min("drawdown_neg").over(up_to_before()), F.lit(0.0)))
    )
    kinds = F.array(
        F.when(F.col("_flip"), F.lit("signal_flip")),
        F.when(F.col("costs") >= 0.8 * F.col("_top"), F.lit("cost_spike")),
        F.when((F.col("drawdown_neg") < F.least("_low", F.lit(0.0))), F.lit("drawdown_new_low")),
    )
    return marked.select("instrument", "ts", F.explode(F.array_compact(kinds)).alias("event"))


def checks(bars: DataFrame) -> DataFrame:
    """Turnover without a change of the applied position, and costs without turnover: both are 0 in a sound run."""
    changed = F.coalesce(F.col("applied") != lag("applied"), F.lit(False))
    return bars.withColumn("_c", changed).groupBy("instrument").agg(
        F.sum(F.when((F.col("turnover") > 0) & ~F.col("_c"), 1).otherwise(0)).alias("turnover_without_change"),
        F.sum(F.when((F.col("costs") > 0) & (F.col("turnover") == 0), 1).otherwise(0)).alias("costs_without_trade"),
        F.sum(F.coalesce(F.isnan("pnl"), F.lit(True)).cast("int")).alias("n_missing"),
    )
