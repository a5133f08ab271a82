"""Whole strategy runs: cleaning to evaluation as one lazy plan, and the reports beside it."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import by_time
from quantloom.operators import backtest, clean, evaluate, features, risk, signals
from quantloom.operators.backtest import BacktestConfig
from quantloom.operators.clean import CleanConfig
from quantloom.operators.features import FeatureConfig
from quantloom.operators.risk import RiskConfig
from quantloom.operators.signals import Ensemble, Momentum, mean_reversion

#: What a run can and cannot do, for clients.
CAPABILITIES = {"meta_models": ["logistic", "ridge"], "calibrations": ["none", "platt", "beta", "isotonic"], "regimes": ["quantile_vol", "trend_range", "hmm"], "cost_delay_sensitivity": False}


@dataclass(frozen=True)
class StrategyConfig:
    clean: CleanConfig = field(default_factory=CleanConfig)
    features: FeatureConfig = field(default_factory=lambda: FeatureConfig((3, 5, 10), (5,), (5,), 1))
    ensemble: Ensemble = field(default_factory=lambda: Ensemble((Momentum(5), mean_reversion(5)), (0.5, 0.5)))
    risk: RiskConfig = field(default_factory=RiskConfig)
    backtest: BacktestConfig = field(default_factory=BacktestConfig)


@dataclass(frozen=True)
class StrategyRun:
    """Lazy frames of one run."""

    price: DataFrame
    features: DataFrame
    signal: DataFrame
    risk: DataFrame
    bars: DataFrame
    summary: DataFrame
    metrics: DataFrame


def run_strategy(ticks: DataFrame, cfg: StrategyConfig = StrategyConfig(), time_column: str = "ts", gate: DataFrame | None = None) -> StrategyRun:
    """The frames of a run over raw ticks (instrument, time, price, seq).

    gate: (instrument, ts, size) multiplies the position after the risk overlay; rows without a size keep theirs. Metrics
    are of pnl, not of the asset's returns.
    """
    price = clean.clean(ticks, time_column, cfg.clean)
    feats = features.build_features(price, cfg.features)
    signal = signals.run_ensemble(feats, cfg.ensemble)
    overlaid = risk.overlay(backtest.align(price, signal.select("instrument", "ts", "position")), cfg.risk)
    target = overlaid.select("instrument", "ts", "price", F.col("position_target").alias("position"))
    if gate is not None:
        target = target.join(gate.select("instrument", "ts", "size"), ["instrument", "ts"], "left").withColumn("position", F.col("position") * F.coalesce("size", F.lit(1.0))).drop("size")
    bars = backtest.run_bars(target, cfg.backtest)
    metrics = evaluate.performance(bars, "pnl", equity="equity", position="applied", periods=cfg.backtest.periods)
    return StrategyRun(price, feats, signal, overlaid, bars, backtest.summary(bars, cfg.backtest), metrics)


#: Stages of a run in order, and why each may leave rows out.
STAGES = (("duplicates", "later_row_of_the_same_time"), ("positive", "non_positive_price"), ("outliers", "log_return_over_the_limit"), ("resample", "merged_into_a_bucket"), ("features", "window_not_full"), ("bars", "no_position_or_no_price"))


def stage_report(ticks: DataFrame, cfg: StrategyConfig = StrategyConfig(), time_column: str = "ts") -> DataFrame:
    """(instrument, stage_no, stage, rows_in, rows_out, dropped, reason): what each stage of a run takes in and leaves out.

    Rows are counted by stage, side by side, and the counts of an instrument, one row a stage, are then put in order.
    """
    read = clean.with_price(clean.with_utc(ticks, time_column, cfg.clean.tz), cfg.clean)
    limit = cfg.clean.max_abs_log_return
    marked = clean.marked_outliers(clean.keep_last(read), math.inf if limit is None else limit)
    if limit is None:  # without a limit the cleaning keeps prices as they are
        marked = marked.withColumn("reason", F.lit(None).cast("string"))
    price = clean.clean(ticks, time_column, cfg.clean)
    feats = features.build_features(price, cfg.features)
    position = signals.run_ensemble(feats, cfg.ensemble).select("instrument", "ts", "position")
    of = lambda df, **counts: df.groupBy("instrument").agg(*[c.alias(n) for n, c in counts.items()])
    n, bad = F.count("*"), lambda why: F.sum(F.when(F.col("reason") == why, 1).otherwise(0))
    counts = of(read, raw=n)
    for part in (of(marked, times=n, unpriced=bad("non_positive_price"), jumps=bad("outlier")), of(price, buckets=n), of(feats, rows=n), of(backtest.align(price, position), bars=n)):
        counts = counts.join(part, "instrument", "left")
    counts = counts.fillna(0)
    kept = [F.col("raw"), F.col("times"), F.col("times") - F.col("unpriced"), F.col("times") - F.col("unpriced") - F.col("jumps"), F.col("buckets"), F.col("rows"), F.col("bars")]
    rows = [F.struct(F.lit(i + 1).alias("stage_no"), F.lit(stage).alias("stage"), kept[i].alias("rows_in"), kept[i + 1].alias("rows_out"), (kept[i] - kept[i + 1]).alias("dropped"), F.lit(why).alias("reason")) for i, (stage, why) in enumerate(STAGES)]
    return counts.select("instrument", F.explode(F.array(*rows)).alias("s")).select("instrument", "s.*")


def slice_run(bars: DataFrame, start: str | None = None, end: str | None = None, stride: int = 1) -> DataFrame:
    """Bars from start to end, both included, and of those every stride-th of each instrument, beginning with the first."""
    out = bars
    if start:
        out = out.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return out.withColumn("_k", F.row_number().over(by_time())).filter((F.col("_k") - 1) % stride == 0).drop("_k")


def trace(bars: DataFrame, at: str) -> DataFrame:
    """All columns of the bars at one time."""
    return bars.filter(F.col("ts") == F.lit(at).cast("timestamp_ntz"))


def diagnostics(bars: DataFrame, max_leverage: float = 1.0) -> DataFrame:
    """One row an instrument: bars, turnover spikes above the 95th percentile, leverage breaches, active bars, costs."""
    line = F.expr("percentile(turnover, 0.95)").over(Window.partitionBy("instrument"))
    marked = bars.withColumn("_line", line)
    return marked.groupBy("instrument").agg(
        F.count("*").alias("n_bars"),
        F.sum((F.col("turnover") > F.col("_line")).cast("int")).alias("n_spikes"),
        F.sum((F.abs("applied") > max_leverage).cast("int")).alias("n_breaches"),
        F.sum((F.col("applied") != 0).cast("int")).alias("n_active"),
        F.sum("costs").alias("costs"),
    )


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(instrument, n_left, n_both, share): how much of left's times right has."""
    return left.select("instrument", "ts").join(right.select("instrument", "ts").withColumn("_m", F.lit(1)), ["instrument", "ts"], "left").groupBy("instrument").agg(F.count("*").alias("n_left"), F.count("_m").alias("n_both"), (F.count("_m") / F.count("*")).alias("share"))


def meta_summary(decided: DataFrame) -> DataFrame:
    """(instrument, p_mean, p_std, n_follow, n_skip, n_sized) of a decided panel."""
    return decided.groupBy("instrument").agg(F.avg("p_follow").alias("p_mean"), F.stddev_pop("p_follow").alias("p_std"), F.sum((F.col("action") != 0).cast("int")).alias("n_follow"), F.sum((F.col("action") == 0).cast("int")).alias("n_skip"), F.sum((F.col("size") != 0).cast("int")).alias("n_sized"))


def ingest_report(ticks: DataFrame, keep: int = 10) -> tuple[DataFrame, DataFrame]:
    """Quality of raw ticks by instrument, and the last rows of each."""
    quality = clean.duplicate_counts(ticks).join(ticks.groupBy("instrument").agg(F.sum((F.col("price") <= 0).cast("int")).alias("n_invalid"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), "instrument")
    order = Window.partitionBy("instrument").orderBy(F.desc("ts"), F.desc("seq"))
    return quality, ticks.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= keep).drop("_k")
