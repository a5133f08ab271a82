"""Streaming bars and recursions over ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tick_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Ticks from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def bar_stream(ticks: DataFrame, bucket: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(instrument, ts, price, n): last price of each bucket, final once the watermark has passed; later ticks are dropped."""
    timed = ticks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    bars = timed.groupBy("instrument", F.window("at", bucket).alias("w")).agg(F.max_by("price", "at").alias("price"), F.count("*").alias("n"))
    return bars.select("instrument", F.col("w.start").alias("ts"), "price", "n")


def ewma_stream(ticks: DataFrame, alpha: float) -> DataFrame:
    """(instrument, ts, price, ewma): recursive mean carried in state from batch to batch, in time order inside a batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for price in pdf["price"]:
            y = price if y is None else alpha * price + (1 - alpha) * y
            out.append(y)
        state.update((float(y),))
        yield pd.DataFrame({"instrument": key[0], "ts": pdf["ts"].to_numpy(), "price": pdf["price"].to_numpy(), "ewma": out})

    return ticks.groupBy("instrument").applyInPandasWithState(step, "instrument string, ts timestamp, price double, ewma double", "y double", "append", GroupStateTimeout.NoTimeout)


def cusum_stream(ticks: DataFrame, threshold: float, drift: float) -> DataFrame:
    """(instrument, ts, flag): two-sided cumulative sum of price steps with reset, carried in state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, last = state.get if state.exists else (0.0, 0.0, None)
        pdf = pd.concat(list(frames)).sort_values("ts", kind="stable")
        flags = []
        for price in pdf["price"]:
            v = 0.0 if last is None else price - last
            last, up, down, flag = price, max(0.0, up + v - drift), min(0.0, down + v + drift), 0
            if up > threshold or down < -threshold:
                up, down, flag = 0.0, 0.0, 1
            flags.append(flag)
        state.update((float(up), float(down), float(last)))
        yield pd.DataFrame({"instrument": key[0], "ts": pdf["ts"].to_numpy(), "flag": flags})

    return ticks.groupBy("instrument").applyInPandasWithState(step, "instrument string, ts timestamp, flag int", "up double, down double, last double", "append", GroupStateTimeout.NoTimeout)
