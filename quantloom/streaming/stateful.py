"""Recursions over streams whose results do not depend on how ticks fall into batches.

Ticks wait in the state of their instrument until the watermark has passed them, and are then taken in time order by an
event-time timer; what comes later than the watermark is late and dropped. So the rows given out are those of the batch
recursion over all ticks that were in time, whatever the split into batches and the order inside them. State is typed:
the recursion's own numbers, and the ticks that wait, which the delay bounds.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quantloom.operators.hmm_model import Hmm, forward_from

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PENDING = "us long, price double"


class InOrder(StatefulProcessor):
    """Holds ticks until the watermark passes them, then hands them to ``step`` in time order.

    step(state, seconds, prices) gives the next state, a tuple of doubles, and the output columns as arrays.
    """

    def __init__(self, width: int, start: tuple[float, ...], step: Callable[[tuple[float, ...], np.ndarray, np.ndarray], tuple[tuple[float, ...], dict[str, Any]]]):
        self.width, self.start, self.step = width, start, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.held = handle.getValueState("held", ", ".join(f"s{i} double" for i in range(self.width)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for pdf in rows:
            us = pdf["at"].to_numpy().astype("datetime64[us]").astype(np.int64)
            new = [(int(t), float(p)) for t, p in zip(us, pdf["price"], strict=True) if t > mark and not math.isnan(p)]
            if new:
                self.pending.appendList(new)
                # a timer fires once the watermark is beyond its time, and then takes all ticks up to the watermark
                self.handle.registerTimer(min(t for t, _ in new) // 1000 + 1)
                self.handle.registerTimer(max(t for t, _ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ticks = sorted((int(t), float(p)) for t, p in self.pending.get()) if self.pending.exists() else []
        ready, later = [t for t in ticks if t[0] <= mark], [t for t in ticks if t[0] > mark]
        if not ready:
            return
        if later:
            self.pending.put(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        else:
            self.pending.clear()
        us, price = np.array([t for t, _ in ready], dtype=np.int64), np.array([p for _, p in ready])
        state, out = self.step(tuple(self.held.get()) if self.held.exists() else self.start, us / 1e6, price)
        self.held.update(tuple(float(s) for s in state))
        yield pd.DataFrame({"instrument": key[0], "ts": us.view("datetime64[us]"), "price": price} | out)

    def close(self) -> None:
        pass


def _run(ticks: DataFrame, delay: str, width: int, start: tuple[float, ...], step: Callable, outputs: str) -> DataFrame:
    timed = ticks.withColumn("at", ticks["ts"].cast("timestamp")).select("instrument", "at", ticks["price"].cast("double").alias("price")).withWatermark("at", delay)
    schema = f"instrument string, ts timestamp, price double, {outputs}"
    return timed.groupBy("instrument").transformWithStateInPandas(InOrder(width, start, step), schema, "Append", "EventTime")


def ewma_by_time_stream(ticks: DataFrame, half_life_s: float, delay: str = "2 hours") -> DataFrame:
    """(instrument, ts, price, ewma): the mean whose weight halves in half_life_s, as decay.ewma_by_time gives it."""

    def step(state: tuple[float, ...], seconds: np.ndarray, price: np.ndarray):
        last, y = state
        out = np.empty(len(price))
        for i, (t, p) in enumerate(zip(seconds.tolist(), price.tolist(), strict=True)):
            keep = 0.0 if math.isnan(y) else math.exp(-math.log(2) * (t - last) / half_life_s)
            last, y = t, p if math.isnan(y) else (1 - keep) * p + keep * y
            out[i] = y
        return (last, y), {"ewma": out}

    return _run(ticks, delay, 2, (math.nan, math.nan), step, "ewma double")


def hmm_stream(ticks: DataFrame, model: Hmm, delay: str = "2 hours") -> DataFrame:
    """(instrument, ts, price, state, p_state_k): filtered states of the price under a fitted model, which a row at ts knows
    from rows up to ts only."""
    k = len(model.start)

    def step(state: tuple[float, ...], seconds: np.ndarray, price: np.ndarray):
        p, _, _ = forward_from(np.array(state) @ model.step if sum(state) > 0 else model.start, model.densities(price[:, None]), model.step)
        return tuple(p[-1]), {"state": p.argmax(axis=1).astype(np.int32)} | {f"p_state_{j}": p[:, j] for j in range(k)}

    return _run(ticks, delay, k, (0.0,) * k, step, "state int, " + ", ".join(f"p_state_{j} double" for j in range(k)))
