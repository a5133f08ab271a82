"""Recursions that no window can express: numpy kernels, what a stretch of rows does to their state, and how they run.

Each kernel takes arrays in time order, NaN for NULL, and is pure Python and numpy. A kernel with a state that rows of a
time bucket change as one map runs by buckets (run_scan): every bucket is summed up as its map without knowing the state
that enters it, the maps of a series are applied one after the other, which is little work, and every bucket is then run
again from its true state. No task holds a series. run_kernel is the plain form, one task a series.
"""

from __future__ import annotations

import bisect
import math
import pickle
from collections.abc import Callable
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quantloom.functions.linear import BUCKET_S, bucketed


def run_kernel(panel: DataFrame, inputs: list[str], outputs: list[str], kernel: Callable[..., tuple[np.ndarray, ...]], keep: tuple[str, ...] = ("instrument", "ts"), by: str = "instrument") -> DataFrame:
    """The kept columns of each series in time order, with the kernel's outputs as doubles (NaN as NULL)."""
    fields = [f for f in panel.schema.fields if f.name in keep]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        found = kernel(*(pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in inputs))
        out = {f.name: pdf[f.name].to_numpy() for f in fields}
        for name, values in zip(outputs, found, strict=True):
            out[name] = pd.array(np.asarray(values, dtype=float), dtype="Float64")
            out[name][np.isnan(np.asarray(values, dtype=float))] = pd.NA
        return pd.DataFrame(out)

    schema = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in outputs)])
    columns = list(dict.fromkeys([*(f.name for f in fields), by, "ts", *inputs]))
    return panel.select(*columns).groupBy(by).applyInPandas(run, schema)


class Scan(NamedTuple):
    """A recursion by buckets: start is the state before a series, summary a bucket's map, after the state that the map
    makes of one, and replay a bucket's outputs from the state that enters it."""

    start: Any
    summary: Callable[..., Any]
    after: Callable[[Any, Any], Any]
    replay: Callable[..., tuple[np.ndarray, ...]]


def run_scan(panel: DataFrame, inputs: list[str], outputs: list[str], scan: Scan, keep: tuple[str, ...] = ("instrument", "ts"), bucket_s: int = BUCKET_S) -> DataFrame:
    """The kept columns of each series with the recursion's outputs as doubles (NaN as NULL), bucket by bucket."""
    fields = [f for f in panel.schema.fields if f.name in keep]
    kind = panel.schema["instrument"].dataType.simpleString()
    arrays = lambda pdf: [pdf[c].to_numpy(dtype=float, na_value=np.nan) for c in inputs]

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        found = scan.summary(*arrays(pdf.sort_values("ts", kind="stable")))
        return pdf.iloc[:1][["instrument", "_bucket"]].assign(note=[pickle.dumps(found)])

    def hand_on(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("_bucket"), scan.start, []
        for note in pdf["note"]:
            out.append(pickle.dumps(state))
            state = scan.after(state, pickle.loads(note))
        return pdf.assign(note=out)

    def replay(pdf: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        found = scan.replay(pickle.loads(notes["note"].iloc[0]), *arrays(pdf))
        out = {f.name: pdf[f.name].to_numpy() for f in fields}
        for name, values in zip(outputs, found, strict=True):
            out[name] = pd.array(np.asarray(values, dtype=float), dtype="Float64")
            out[name][np.isnan(np.asarray(values, dtype=float))] = pd.NA
        return pd.DataFrame(out)

    columns = list(dict.fromkeys([*(f.name for f in fields), "instrument", "ts", *inputs]))
    rows, keys, note = bucketed(panel.select(*columns), bucket_s), ["instrument", "_bucket"], f"instrument {kind}, _bucket long, note binary"
    notes = rows.groupBy(*keys).applyInPandas(sum_up, note).groupBy("instrument").applyInPandas(hand_on, note)
    schema = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in outputs)])
    return rows.groupBy(*keys).cogroup(notes.groupBy(*keys)).applyInPandas(replay, schema)


def ewma(x: np.ndarray, alpha: float, min_periods: int = 1) -> np.ndarray:
    """Recursive exponential mean. Over a gap of NaN the old value decays by a step a row and weights are renormalised."""
    out, y, old, seen = np.full(len(x), np.nan), math.nan, 1.0, 0
    for i, v in enumerate(x):
        if math.isnan(y):
            if not math.isnan(v):
                y, old, seen = v, 1.0, 1
        else:
            old *= 1 - alpha
            if not math.isnan(v):
                y, old, seen = (old * y + alpha * v) / (old + alpha), 1.0, seen + 1
        out[i] = y if seen >= min_periods else math.nan
    return out


def ewma_by_time(x: np.ndarray, seconds: np.ndarray, half_life: float, min_periods: int = 1, carry: bool = True) -> np.ndarray:
    """Exponential mean whose weight halves in ``half_life`` seconds; NaN carries the value, and its step of time is lost."""
    out, y, seen = np.full(len(x), np.nan), math.nan, 0
    for i, v in enumerate(x):
        if math.isnan(v):
            out[i] = y if carry and seen >= min_periods else math.nan
            continue
        keep = 0.0 if math.isnan(y) else math.exp(-math.log(2) * (seconds[i] - seconds[i - 1]) / half_life)
        y, seen = v if math.isnan(y) else (1 - keep) * v + keep * y, seen + 1
        out[i] = y if seen >= min_periods else math.nan
    return out


def inertia(target: np.ndarray, alpha: float) -> np.ndarray:
    """Position that moves by ``alpha`` of the way to its target a row; NaN leaves it where it is."""
    out, y = np.full(len(target), np.nan), math.nan
    for i, v in enumerate(target):
        if not math.isnan(v):
            y = v if math.isnan(y) else alpha * v + (1 - alpha) * y
        out[i] = y
    return out


def cap_steps(position: np.ndarray, cap: float, y: float = math.nan) -> np.ndarray:
    """Position that follows the given one by at most ``cap`` a row, from y before the first; NaN starts anew after it."""
    out = np.full(len(position), np.nan)
    for i, v in enumerate(position):
        y = v if math.isnan(y) else y + min(max(v - y, -cap), cap)
        out[i] = y
    return out


class CapMap(NamedTuple):
    """What rows of a capped position make of the position before them.

    Each row moves the state up by cap, down by cap, or to its own value, so together they are a rising map of pieces of
    slope 0 and 1, held by its corners (xs, ys) and continued with slope 1. New corners are a flat piece of 2 * cap at
    least, so within any range of positions there are no more than range / cap. Without corners (constant) the state
    before does not matter; anew is the state if there was none before.
    """

    anew: float
    constant: bool
    xs: list[float]
    ys: list[float]


def cap_map(position: np.ndarray, cap: float) -> CapMap:
    y, constant, xs, ys = math.nan, len(position) == 0, [], []
    touched = False
    for v in position.tolist():
        y = v if math.isnan(y) else y + min(max(v - y, -cap), cap)
        if math.isnan(v) or constant:
            constant, touched = True, True
            continue
        low, high = v - cap, v + cap
        if not touched:
            xs, ys, touched = [low, high], [v, v], True
            continue
        i, j = bisect.bisect_left(ys, low), bisect.bisect_right(ys, high)
        from_low = xs[i - 1] + (low - ys[i - 1]) if i else xs[0] - (ys[0] - low)
        from_high = xs[j - 1] + (high - ys[j - 1]) if j else xs[0] - (ys[0] - high)
        from_low = max(from_low, xs[i - 1]) if i else from_low  # rounding leaves the corners in order
        from_high = max(from_low, min(from_high, xs[j]) if j < len(xs) else from_high)
        xs = [*xs[:i], from_low, from_high, *xs[j:]]
        ys = [*(min(u + cap, v) for u in ys[:i]), v, v, *(max(u - cap, v) for u in ys[j:])]
    return CapMap(y, constant and len(position) > 0, xs, ys)


def after_cap(y: float, found: CapMap) -> float:
    """The position after a bucket that had y before it."""
    if math.isnan(y) or found.constant or not found.xs:
        return found.anew
    i = bisect.bisect_right(found.xs, y)
    if i == 0:
        return found.ys[0] - (found.xs[0] - y)
    if i == len(found.xs):
        return found.ys[-1] + (y - found.xs[-1])
    return found.ys[i - 1] if found.ys[i] == found.ys[i - 1] else found.ys[i - 1] + (y - found.xs[i - 1])


def capped(cap: float) -> Scan:
    return Scan(math.nan, lambda v: cap_map(v, cap), after_cap, lambda y, v: (cap_steps(v, cap, y),))


def cusum(x: np.ndarray, threshold: float, drift: float, up: float = 0.0, down: float = 0.0) -> np.ndarray:
    """1 where the two-sided cumulative sum passes the threshold, which resets it; NaN rows are passed over."""
    out = np.zeros(len(x))
    for i, v in enumerate(x):
        if math.isnan(v):
            continue
        up, down = max(0.0, up + v - drift), min(0.0, down + v + drift)
        if up > threshold or down < -threshold:
            out[i], up, down = 1.0, 0.0, 0.0
    return out


class CusumMap(NamedTuple):
    """What rows make of the two sums (up, down) before them.

    Until its first alarm a pair only adds the rows' sums, or has touched 0 and forgotten where it began: it becomes
    (max(up_from_0, up + up_sum), min(down_from_0, down + down_sum)). Each entry of alarms is (most up, least down, the
    pair at the end): a pair beyond those lines, and within those of the entries before, had its first alarm there, and
    from an alarm on all pairs are one. Entries that end alike are merged, so there are few.
    """

    alarms: list[tuple[float, float, tuple[float, float]]]
    up_from_0: float
    up_sum: float
    down_from_0: float
    down_sum: float


def cusum_map(x: np.ndarray, threshold: float, drift: float) -> CusumMap:
    most, least, alive = math.inf, -math.inf, True
    up = up_sum = down = down_sum = 0.0
    alarms: list[list] = []  # [most, least, the pair since the alarm, which entries share]
    pairs: list[list[float]] = []
    for v in x.tolist():
        if math.isnan(v):
            continue
        rose, fell = v - drift, v + drift
        fresh = None
        for pair in pairs:
            pair[0], pair[1] = max(0.0, pair[0] + rose), min(0.0, pair[1] + fell)
            if pair[0] > threshold or pair[1] < -threshold:
                pair[0] = pair[1] = 0.0
        if alive:
            up, down, up_sum, down_sum = max(0.0, up + rose), min(0.0, down + fell), up_sum + rose, down_sum + fell
            if up > threshold or down < -threshold:
                most_now, least_now, alive = -math.inf, math.inf, False
            else:
                most_now, least_now = min(most, threshold - up_sum), max(least, -threshold - down_sum)
            if (most_now < most and most_now < threshold) or (least_now > least and least_now > -threshold):
                fresh = [0.0, 0.0]
                pairs.append(fresh)
                alarms.append([most_now, least_now, fresh])
            most, least = most_now, least_now
        if len(pairs) > 1:  # pairs that have met stay together
            kept: dict[tuple, list[float]] = {}
            moved = {id(pair): kept.setdefault((pair[0], pair[1]), pair) for pair in pairs}
            if len(kept) < len(pairs):
                pairs = list(kept.values())
                merged: list[list] = []
                for entry in alarms:
                    entry[2] = moved[id(entry[2])]
                    if merged and merged[-1][2] is entry[2]:
                        merged[-1] = entry
                    else:
                        merged.append(entry)
                alarms = merged
    return CusumMap([(a, b, (pair[0], pair[1])) for a, b, pair in alarms], up, up_sum, down, down_sum)


def after_cusum(sums: tuple[float, float], found: CusumMap) -> tuple[float, float]:
    up, down = sums
    for most, least, end in found.alarms:
        if up > most or down < least:
            return end
    return max(found.up_from_0, up + found.up_sum), min(found.down_from_0, down + found.down_sum)


def flagged(threshold: float, drift: float) -> Scan:
    return Scan((0.0, 0.0), lambda x: cusum_map(x, threshold, drift), after_cusum, lambda s, x: (cusum(x, threshold, drift, *s),))
