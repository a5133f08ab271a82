"""Returns, rolling features, transforms and targets of a panel. Values at ts use rows up to ts only, targets excepted."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.quantiles import with_quantiles
from quantloom.functions.windows import col, compound, lag, last_rows, next_rows, rolling, row_number, up_to_now

EPSILON = 1e-12


@dataclass(frozen=True)
class FeatureConfig:
    momentum: tuple[int, ...] = (5, 20, 60)
    volatility: tuple[int, ...] = (20,)
    zscore: tuple[int, ...] = (20,)
    decision_shift: int = 1

    def __post_init__(self):
        if self.decision_shift < 1 or min(self.volatility + self.zscore, default=2) < 2 or min(self.momentum, default=1) < 1:
            raise ValueError("windows and shift are too small")

    def warm_up(self) -> int:
        """Rows of an instrument that have no full set of features."""
        return max(max(self.momentum, default=0), max(self.volatility, default=0), 2 * max(self.zscore, default=0) - 1) + self.decision_shift


def log_return(price: Column | str = "price") -> Column:
    return F.log(col(price)) - lag(F.log(col(price)))


def simple_return(price: Column | str = "price") -> Column:
    return col(price) / lag(price) - 1


def momentum(returns: Column | str, n: int) -> Column:
    return rolling(F.sum, returns, n)


def volatility(returns: Column | str, n: int) -> Column:
    return rolling(F.stddev_pop, returns, n)


def zscore(x: Column | str, n: int) -> Column:
    return (col(x) - rolling(F.avg, x, n)) / (rolling(F.stddev_pop, x, n) + EPSILON)


def build_features(panel: DataFrame, cfg: FeatureConfig = FeatureConfig(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(instrument, ts, kept columns, ret_1, mom_w, rv_w, z_mom_w): features lagged by the decision shift, rows without a full set
    dropped. Kept columns stay on their own rows, so targets need no join with another build of the panel."""
    out = panel.withColumn("ret_1", log_return())
    names = ["ret_1"]
    for n in cfg.momentum:
        out, names = out.withColumn(f"mom_{n}", momentum("ret_1", n)), [*names, f"mom_{n}"]
    for n in cfg.volatility:
        out, names = out.withColumn(f"rv_{n}", volatility("ret_1", n)), [*names, f"rv_{n}"]
    for n in cfg.zscore:
        out, names = out.withColumn("_m", momentum("ret_1", n)).withColumn(f"z_mom_{n}", zscore("_m", n)), [*names, f"z_mom_{n}"]
    shifted = [lag(c, cfg.decision_shift).alias(c) for c in names]
    return out.select("instrument", "ts", *keep, *shifted).dropna("any", subset=names)


def rolling_fit(panel: DataFrame, n: int) -> DataFrame:
    """panel with slope_n and r2_n of ln(price) against the row number over the last n rows; r2 is 0 for a constant price."""
    base = panel.withColumn("_y", F.log("price")).withColumn("_x", row_number().cast("double"))
    frame, full = last_rows(n), F.count("_y").over(last_rows(n)) >= n
    base = base.withColumn(f"slope_{n}", F.when(full, F.regr_slope("_y", "_x").over(frame)))
    flat = F.var_pop("_y").over(frame) == 0
    return base.withColumn(f"r2_{n}", F.when(full, F.when(flat, 0.0).otherwise(F.regr_r2("_y", "_x").over(frame)))).drop("_x", "_y")


def regime_features(panel: DataFrame, windows: tuple[int, ...] = (20,), periods: float | None = None, shift: int = 0) -> DataFrame:
    """(instrument, ts, ret_1, ret_abs, ret_sq and, for each window, volatility, momentum, slope, r2, z-score of price, vol of vol)."""
    out = panel.withColumn("ret_1", simple_return()).withColumn("ret_abs", F.abs("ret_1")).withColumn("ret_sq", F.col("ret_1") * F.col("ret_1"))
    names, year = ["ret_1", "ret_abs", "ret_sq"], math.sqrt(periods) if periods else 1.0
    for n in windows:
        out = rolling_fit(out.withColumn(f"vol_roll_{n}", volatility("ret_1", n) * year).withColumn(f"mom_{n}", F.col("price") / lag("price", n) - 1), n)
        spread = rolling(F.stddev_pop, "price", n)
        out = out.withColumn(f"zscore_price_{n}", F.try_divide(F.col("price") - rolling(F.avg, "price", n), spread))
        out = out.withColumn(f"vol_of_vol_{n}", rolling(F.stddev_pop, f"vol_roll_{n}", n))
        names += [f"{c}_{n}" for c in ("vol_roll", "mom", "slope", "r2", "zscore_price", "vol_of_vol")]
    return out.select("instrument", "ts", *[(lag(c, shift) if shift else F.col(c)).alias(c) for c in names])


def interactions(features: DataFrame, names: list[str]) -> DataFrame:
    """features with the product a_x_b of every two of the names."""
    return features.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in itertools.combinations(names, 2)])


def pseudo_price(returns: Column | str) -> Column:
    """Running product of 1 + return, NULL counting as 0."""
    return F.product(1 + F.coalesce(col(returns), F.lit(0.0))).over(up_to_now())


def equity(returns: Column | str, start: float = 1.0) -> Column:
    return start * compound(returns)


def forward_return(returns: Column | str, horizon: int) -> Column:
    """Sum of the next ``horizon`` returns; NULL where the series ends before."""
    frame = next_rows(horizon)
    return F.when(F.count(F.lit(1)).over(frame) >= horizon, F.sum(F.coalesce(col(returns), F.lit(0.0))).over(frame))


def winsorise(panel: DataFrame, x: str, q: float, name: str) -> DataFrame:
    """panel with ``name``: x within the q and 1 - q quantiles of its instrument."""
    out = with_quantiles(panel, x, (q, 1 - q), "_q")
    return out.withColumn(name, F.when(F.col(x).isNotNull(), F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], F.col(x))))).drop("_q")


def scale_to_std(x: Column | str, target: float, n: int = 60) -> Column:
    return col(x) * target / (rolling(F.stddev_pop, x, n) + EPSILON)


def annualise_vol(x: Column | str, periods: float | None) -> Column:
    return col(x) * math.sqrt(periods) if periods else col(x)


def annualise_return(total: Column | str, n: Column | str, periods: float | None) -> Column:
    """(1 + R)^(periods / n) - 1; NULL where 1 + R is not positive or n is 0."""
    growth = 1 + col(total)
    return F.when((growth > 0) & (col(n) > 0), F.pow(growth, (periods or 0) / F.greatest(col(n), F.lit(1))) - 1)


#: Periods a year by the one gap in seconds that a series has.
PERIODS = {1: 31_536_000, 60: 525_600, 3600: 8_760, 86_400: 365, 604_800: 52}


def infer_periods(panel: DataFrame) -> DataFrame:
    """(instrument, periods): by the only gap of the series; 252 if it runs Monday to Friday; NULL if there is none."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    gaps = panel.withColumn("gap", seconds - lag(seconds)).withColumn("weekday", F.weekday("ts"))
    facts = gaps.groupBy("instrument").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.max("weekday").alias("late"), F.min(F.when(F.col("gap") == 86_400 * 3, F.col("weekday"))).alias("a"), F.max(F.when(F.col("gap") == 86_400 * 3, F.col("weekday"))).alias("b"), F.sum(F.when(~F.col("gap").isin(86_400, 86_400 * 3), 1).otherwise(0)).alias("other"))
    same = F.lit(None).cast("int")
    for gap, periods in PERIODS.items():
        same = F.when((F.col("low") == gap) & (F.col("high") == gap), periods).otherwise(same)
    for low, high, periods in ((28, 31, 12), (90, 92, 4), (365, 366, 1)):
        same = F.when((F.col("low") >= low * 86_400) & (F.col("high") <= high * 86_400), periods).otherwise(same)
    business = (F.col("late") <= 4) & (F.col("other") == 0) & (F.col("a") == 0) & (F.col("b") == 0)
    return facts.select("instrument", F.when(business, 252).otherwise(same).alias("periods"))


def lookahead_report(features: DataFrame, raw: DataFrame, names: list[str], shift: int) -> DataFrame:
    """For each instrument, the rows in which a feature differs from its unshifted self ``shift`` rows before: 0 is right."""
    plain = raw.select("instrument", "ts", *[lag(c, shift).alias(f"_{c}") for c in names])
    off = sum(((F.col(c) != F.col(f"_{c}")) | F.col(f"_{c}").isNull()).cast("int") for c in names)
    return features.join(plain, ["instrument", "ts"], "left").groupBy("instrument").agg(F.count("*").alias("n_rows"), F.sum(off).alias("n_off"))


