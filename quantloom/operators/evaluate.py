"""Evaluation of return series: performance, drawdowns, distribution, benchmark, rolling metrics and robustness."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.stats import both, correlation, excess_kurtosis_sample, normal_cdf, normal_ppf, skew_sample
from quantloom.functions.windows import lag, rolling, row_number, up_to_now
from quantloom.operators.features import annualise_return

PERCENTILES = (1, 5, 10, 50, 90, 95, 99)




def performance(panel: DataFrame, returns: str = "returns", equity: str | None = None, position: str | None = None, periods: float | None = 252.0, risk_free: float = 0.0) -> DataFrame:
    """One row an instrument. With equity, total return is last over first. Ratios without a denominator are 0, profit factor NULL."""
    r = F.col(returns)
    year = math.sqrt(periods) if periods else 1.0
    excess = r - risk_free / (periods or 1.0)
    low = F.least(excess, F.lit(0.0))
    aggs = [
        F.count(r).alias("n"),
        (F.product(1 + r) - 1).alias("total_return") if equity is None else (F.max_by(equity, "ts") / F.min_by(equity, "ts") - 1).alias("total_return"),
        (F.stddev_pop(r) * year).alias("vol_annual"),
        F.avg(excess).alias("_mean"),
        F.stddev_pop(excess).alias("_sd"),
        F.sqrt(F.avg(low * low)).alias("_down"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
        F.try_divide(F.sum(F.when(r > 0, r).otherwise(0.0)), F.abs(F.sum(F.when(r < 0, r).otherwise(0.0)))).alias("profit_factor"),
    ]
    if position:
        p = F.col(position)
        aggs += [F.avg(F.abs(p)).alias("exposure_mean"), F.avg((p != 0).cast("double")).alias("exposure_share"), F.max(F.abs(p)).alias("exposure_max")]
    out = panel.groupBy("instrument").agg(*aggs)
    zero = F.lit(0.0)
    return (
        out.withColumn("cagr", annualise_return("total_return", "n", periods))
        .withColumn("sharpe", F.coalesce(F.try_divide(F.col("_mean"), F.col("_sd")) * year, zero))
        .withColumn("sortino", F.coalesce(F.try_divide(F.col("_mean"), F.col("_down")) * year, zero))
        .drop("_mean", "_sd", "_down")
    )


def equity_curve(panel: DataFrame, returns: str, start: float = 1.0) -> DataFrame:
    """panel with equity, start times the running product of 1 + return, NULL counting as 0; a return of -1 or less raises."""
    growth = 1 + F.coalesce(F.col(returns), F.lit(0.0))
    checked = F.when(growth > 0, growth).otherwise(F.raise_error(F.lit("a return of -1 or less leaves no equity")))
    return panel.withColumn("_g", checked).withColumn("equity", start * F.product("_g").over(up_to_now())).drop("_g")


def drawdowns(panel: DataFrame, equity: str = "equity") -> DataFrame:
    """One row an instrument: greatest drawdown, longest run of rows under water, root mean square under water."""
    under = panel.withColumn("_u", F.coalesce(1 - F.try_divide(F.col(equity), F.max(equity).over(up_to_now())), F.lit(0.0)))
    island = row_number() - F.sum((F.col("_u") > 0).cast("int")).over(up_to_now())
    runs = under.withColumn("_i", island).groupBy("instrument", "_i").agg(F.sum((F.col("_u") > 0).cast("int")).alias("_run"), F.max("_u").alias("_m"), F.sum(F.col("_u") * F.col("_u")).alias("_s"), F.count("*").alias("_n"))
    return runs.groupBy("instrument").agg(F.max("_m").alias("max_drawdown"), F.max("_run").alias("longest_under_water"), F.sqrt(F.sum("_s") / F.sum("_n")).alias("ulcer_index"))


def calmar(metrics: DataFrame, drawn: DataFrame) -> DataFrame:
    return metrics.join(drawn, "instrument").withColumn("calmar", F.try_divide(F.col("cagr"), F.col("max_drawdown")))


def distribution(panel: DataFrame, returns: str = "returns") -> DataFrame:
    """One row an instrument: bias-corrected moments, 1 % tail, tail ratio, best and worst."""
    r = F.col(returns)
    quantile = lambda p: F.expr(f"percentile({returns}, {p})")
    low = panel.groupBy("instrument").agg(quantile(0.01).alias("var_1pct"))
    joined = panel.join(low, "instrument")
    return joined.groupBy("instrument").agg(
        skew_sample(returns).alias("skew"),
        excess_kurtosis_sample(returns).alias("excess_kurtosis"),
        (excess_kurtosis_sample(returns) + 3).alias("kurtosis"),
        F.first("var_1pct").alias("var_1pct"),
        F.avg(F.when(r <= F.col("var_1pct"), r)).alias("es_1pct"),
        F.try_divide(F.abs(quantile(0.95)), F.abs(quantile(0.05))).alias("tail_ratio"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
    )


def percentile_table(panel: DataFrame, returns: str = "returns", percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(instrument, percentile, value)."""
    shares = ", ".join(str(p / 100) for p in percents)
    all_at_once = panel.groupBy("instrument").agg(F.expr(f"percentile({returns}, array({shares}))").alias("v"))
    named = F.arrays_zip(F.array(*[F.lit(p) for p in percents]).alias("p"), F.col("v"))
    return all_at_once.select("instrument", F.explode(named).alias("z")).select("instrument", F.col("z.p").alias("percentile"), F.col("z.v").alias("value"))


def benchmark(panel: DataFrame, returns: str = "returns", against: str = "benchmark", periods: float | None = 252.0) -> DataFrame:
    """One row an instrument: tracking error, information ratio, beta, alpha, r2 over rows with both returns."""
    year = math.sqrt(periods) if periods else 1.0
    r, b = both(returns, against)
    out = panel.groupBy("instrument").agg(
        (F.stddev_pop(r - b) * year).alias("tracking_error"),
        F.avg(r - b).alias("_gap"),
        F.stddev_pop(r - b).alias("_sd"),
        F.try_divide(F.covar_pop(r, b), F.var_pop(b)).alias("beta"),
        F.avg(r).alias("_r"),
        F.avg(b).alias("_b"),
        correlation(returns, against).alias("_c"),
    )
    return out.select("instrument", "tracking_error", (F.try_divide(F.col("_gap"), F.col("_sd")) * year).alias("information_ratio"), "beta", (F.col("_r") - F.col("beta") * F.col("_b")).alias("alpha"), (F.col("_c") * F.col("_c")).alias("r2"))


def rolling_metrics(panel: DataFrame, windows: tuple[int, ...] = (20, 60, 252), returns: str = "returns", periods: float | None = 252.0) -> DataFrame:
    """panel's keys with rolling mean, volatility and Sharpe ratio for each window; Sharpe is NULL for zero volatility."""
    year = math.sqrt(periods) if periods else 1.0
    out = panel.select("instrument", "ts", returns)
    for n in windows:
        out = out.withColumn(f"mean_{n}", rolling(F.avg, returns, n)).withColumn(f"vol_{n}", rolling(F.stddev_pop, returns, n) * year)
        out = out.withColumn(f"sharpe_{n}", F.try_divide(F.col(f"mean_{n}") * (periods or 1.0), F.col(f"vol_{n}")))
    return out.drop(returns)


def psr_dsr(metrics: DataFrame, trials: int = 10, threshold: float = 0.0) -> DataFrame:
    """metrics (n, sharpe, skew, kurtosis) with the probabilistic and the deflated Sharpe ratio; NULL under a negative root."""
    sr = F.col("sharpe")
    spread = 1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr
    root = F.when((spread > 0) & (F.col("n") > 1), F.sqrt(F.abs(spread)))
    z = lambda line: (sr - line) * F.sqrt(F.greatest(F.col("n") - 1, F.lit(0))) / root
    best = normal_ppf(F.lit(1 - 1.0 / trials)) * root / F.sqrt(F.greatest(F.col("n") - 1, F.lit(1)))
    return metrics.withColumn("psr", normal_cdf(z(F.lit(threshold)))).withColumn("dsr", normal_cdf(z(best)))


def hac_sharpe(panel: DataFrame, returns: str = "returns", periods: float | None = 252.0) -> DataFrame:
    """(instrument, sharpe, rho, hac_sharpe): Sharpe ratio shrunk for positive autocorrelation."""
    year = math.sqrt(periods) if periods else 1.0
    pairs = panel.select("instrument", F.col(returns).alias("_r"), lag(returns).alias("_p"))
    out = pairs.groupBy("instrument").agg((F.try_divide(F.avg("_r"), F.stddev_pop("_r")) * year).alias("sharpe"), correlation("_r", "_p").alias("rho"))
    shrink = F.when((F.col("rho") > 0) & (F.col("rho") < 1), F.sqrt((1 - F.greatest("rho", F.lit(0.0))) / (1 + F.greatest("rho", F.lit(0.0))))).otherwise(1.0)
    return out.withColumn("hac_sharpe", F.col("sharpe") * shrink)


def stability(rolling_frame: DataFrame, column: str) -> DataFrame:
    """(instrument, share_positive, p10, p50, p90) of a rolling Sharpe ratio."""
    q = {f"p{p}": F.expr(f"percentile({column}, {p / 100})").alias(f"p{p}") for p in (10, 50, 90)}
    return rolling_frame.filter(F.col(column).isNotNull()).groupBy("instrument").agg(F.avg((F.col(column) > 0).cast("double")).alias("share_positive"), *q.values())


