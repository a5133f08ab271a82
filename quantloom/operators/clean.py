"""Cleaning of raw prices: time, price choice, duplicates, outliers, resampling, and quality reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.windows import by_time, lag

#: Buckets by name, in seconds.
BUCKETS = {"1min": 60, "1H": 3600, "1D": 86_400, "1W": 604_800}
METHODS = ("last", "first", "mean")


@dataclass(frozen=True)
class CleanConfig:
    tz: str = "UTC"
    price_columns: tuple[str, ...] = ("mid", "px_last", "price", "close")
    bid: str = "bid"
    ask: str = "ask"
    max_abs_log_return: float | None = 0.10
    bucket: str = "1D"
    method: str = "last"

    def __post_init__(self):
        if self.bucket not in BUCKETS or self.method not in METHODS:
            raise ValueError("unknown bucket or method")
        if self.max_abs_log_return is not None and self.max_abs_log_return <= 0:
            raise ValueError("max_abs_log_return must be positive")


def with_utc(raw: DataFrame, column: str, tz: str = "UTC") -> DataFrame:
    """raw with ts, the column read as local time of tz and turned into UTC; what cannot be read raises."""
    local = F.col(column).cast("timestamp_ntz")
    checked = F.when(local.isNull(), F.raise_error(F.lit("a timestamp is missing or cannot be read"))).otherwise(local)
    return raw.withColumn("ts", F.convert_timezone(F.lit(tz), F.lit("UTC"), checked))


def with_price(raw: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """raw with price: the mid of bid and ask if both columns are there, else the first of the named columns that is."""
    if cfg.bid in raw.columns and cfg.ask in raw.columns:
        return raw.withColumn("price", (F.col(cfg.bid) + F.col(cfg.ask)) / 2)
    for name in cfg.price_columns:
        if name in raw.columns:
            return raw.withColumn("price", F.col(name).cast("double"))
    raise ValueError("there is no price column")


def keep_last(ticks: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each instrument and ts, the last in order."""
    return ticks.groupBy("instrument", "ts").agg(F.max_by("price", order).alias("price"))


def marked_outliers(panel: DataFrame, max_abs_log_return: float = 0.10) -> DataFrame:
    """panel with reason: why a row is no price (non_positive_price, outlier), NULL if it is; such prices that are not positive
    are NULL, and each step is taken from the row before, whatever that is."""
    step = F.log(F.col("price")) - lag(F.log(F.col("price")))
    marked = panel.withColumn("step", step).withColumn("price", F.when(F.col("price") > 0, F.col("price")))
    reason = F.when(F.col("price").isNull(), "non_positive_price").when(F.abs("step") > max_abs_log_return, "outlier")
    return marked.withColumn("reason", reason).drop("step")


def drop_outliers(panel: DataFrame, max_abs_log_return: float = 0.10) -> DataFrame:
    """Rows whose log return against the row before stays within the limit; prices that are not positive go as well."""
    return marked_outliers(panel, max_abs_log_return).filter("reason is null").drop("reason")


def resample(panel: DataFrame, bucket: str = "1D", method: str = "last") -> DataFrame:
    """One row for each bucket that has rows, at the start of the bucket."""
    pick = {"last": F.max_by("price", "ts"), "first": F.min_by("price", "ts"), "mean": F.avg("price")}[method]
    start = F.window("ts", f"{BUCKETS[bucket]} seconds")["start"]
    return panel.groupBy("instrument", start.alias("ts")).agg(pick.alias("price"))


def clean(raw: DataFrame, time_column: str, cfg: CleanConfig = CleanConfig(), order: str = "seq") -> DataFrame:
    """The whole chain: time, price, duplicates, outliers, resampling. Raw rows have instrument, the time and the order."""
    ticks = with_price(with_utc(raw, time_column, cfg.tz), cfg)
    panel = keep_last(ticks, order)
    if cfg.max_abs_log_return is not None:
        panel = drop_outliers(panel, cfg.max_abs_log_return)
    return resample(panel, cfg.bucket, cfg.method)


def duplicate_counts(ticks: DataFrame) -> DataFrame:
    """Rows, distinct times and surplus rows of each instrument."""
    return ticks.groupBy("instrument").agg(F.count("*").alias("n_rows"), F.countDistinct("ts").alias("n_times")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_times"))


def invalid_prices(ticks: DataFrame) -> DataFrame:
    """The rows whose price is not positive, with the reason."""
    return ticks.filter("price <= 0").withColumn("reason", F.lit("non_positive_price"))


def gap_histogram(panel: DataFrame) -> DataFrame:
    """Gaps between neighbouring rows in seconds: how often each comes, and whether it is above the median gap."""
    gaps = with_gaps(panel)
    median = F.expr("percentile(gap_s, 0.5)").over(Window.partitionBy("instrument"))
    return gaps.withColumn("median_s", median).groupBy("instrument", "gap_s").agg(F.count("*").alias("n"), F.first("median_s").alias("median_s")).withColumn("above", F.col("gap_s") > F.col("median_s"))


def with_gaps(panel: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return panel.withColumn("gap_s", seconds - F.lag(seconds).over(by_time())).filter("gap_s is not null")


def irregularity(panel: DataFrame) -> DataFrame:
    """Share of gaps that differ from the median gap, and the number of longer ones."""
    return gap_histogram(panel).groupBy("instrument").agg(
        (F.sum(F.when(F.col("gap_s") != F.col("median_s"), F.col("n")).otherwise(0)) / F.sum("n")).alias("irregularity"),
        F.sum(F.when(F.col("above"), F.col("n")).otherwise(0)).alias("n_above"),
        F.first("median_s").alias("median_s"),
    )


def missing_intervals(panel: DataFrame) -> DataFrame:
    """Starts and ends of the gaps above the median gap."""
    median = F.expr("percentile(gap_s, 0.5)").over(Window.partitionBy("instrument"))
    before = panel.withColumn("since", lag("ts"))
    return with_gaps(before).withColumn("median_s", median).filter("gap_s > median_s").select("instrument", "since", F.col("ts").alias("until"), "gap_s")


def backward_steps(ticks: DataFrame, order: str = "seq") -> DataFrame:
    """How often time does not advance in the order of arrival."""
    previous = F.lag("ts").over(Window.partitionBy("instrument").orderBy(order))
    return ticks.withColumn("previous", previous).groupBy("instrument").agg(F.sum(F.when(F.col("ts") <= F.col("previous"), 1).otherwise(0)).alias("n_backward"))


def validate(panel: DataFrame, value: str = "price", max_abs: float | None = None, positive: bool = False, nulls: bool = False) -> DataFrame:
    """One row for each instrument: rows, repeated times, NULL, non-finite, non-positive and too large values, and ok."""
    x = F.col(value)
    out = panel.groupBy("instrument").agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - F.countDistinct("ts")).alias("n_repeated"),
        F.sum(x.isNull().cast("int")).alias("n_null"),
        F.sum(F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False)).cast("int")).alias("n_nonfinite"),
        F.sum(F.coalesce(x <= 0, F.lit(False)).cast("int")).alias("n_nonpositive"),
        F.sum(F.coalesce(F.abs(x) > (max_abs if max_abs is not None else float("inf")), F.lit(False)).cast("int")).alias("n_large"),
    )
    bad = F.col("n_repeated") + F.col("n_nonfinite") + F.col("n_large") + (F.lit(0) if nulls else F.col("n_null")) + (F.col("n_nonpositive") if positive else F.lit(0))
    return out.withColumn("ok", bad == 0)
