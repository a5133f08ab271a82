"""Windows that slide over order statistics: chunks of rows with their neighbours, and the structures that move along them.

A window of n rows keeps its values in order; a row enters and another leaves at the cost of a search, so a task holds a
chunk and one window, not a window for each row.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions import chunks
from quantloom.functions.linear import BUCKET_S

CHUNK_ROWS = 250_000


def run_sliding(
    panel: DataFrame,
    inputs: list[str],
    outputs: list[str],
    kernel: Callable[..., tuple[np.ndarray, ...]],
    rows_before: int,
    rows_after: int = 0,
    keep: tuple[str, ...] = ("instrument", "ts"),
    keys: tuple[str, ...] = ("instrument",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The kept columns with the kernel's outputs as doubles (NaN as NULL), chunk by chunk of each series.

    kernel(*arrays, first, last) gets a chunk with its neighbours, NaN for NULL, and gives outputs for rows first .. last - 1.
    """
    fields = [f for f in panel.schema.fields if f.name in keep]
    names = {f.name: f"_k{i}" for i, f in enumerate(fields)}
    values = {c: f"_v{i}" for i, c in enumerate(inputs)}
    series = F.concat_ws(chunks.MARK, *[F.col(k).cast("string") for k in keys])
    rows = panel.select(series.alias("instrument"), "ts", *[F.col(c).alias(n) for c, n in names.items()], *[F.col(c).cast("double").alias(n) for c, n in values.items()], F.lit(1).alias("_one"))
    rows = chunks.dealt(chunks.numbered(rows, BUCKET_S, "_one"), rows_before, max(chunk_rows, rows_before, rows_after, 1), rows_after)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        own = np.flatnonzero(pdf["own"].to_numpy(dtype=bool))
        first, last = int(own[0]), int(own[-1]) + 1
        found = kernel(*(pdf[n].to_numpy(dtype=float, na_value=np.nan) for n in values.values()), first, last)
        out = {c: pdf[n].to_numpy()[first:last] for c, n in names.items()}
        for name, x in zip(outputs, found, strict=True):
            out[name] = pd.array(np.asarray(x, dtype=float), dtype="Float64")
            out[name][np.isnan(np.asarray(x, dtype=float))] = pd.NA
        return pd.DataFrame(out)

    schema = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in outputs)])
    wanted = ["instrument", "_chunk", "_rn", "own", *names.values(), *values.values()]
    return rows.select(*wanted).groupBy("instrument", "_chunk").applyInPandas(run, schema)


class SortedWindow:
    """The values of a sliding window in order."""

    def __init__(self):
        self.values: list[float] = []

    def add(self, v: float) -> None:
        bisect.insort(self.values, v)

    def remove(self, v: float) -> None:
        del self.values[bisect.bisect_left(self.values, v)]

    def quantile(self, share: float) -> float:
        """The quantile between the two values around its place, as percentile gives it."""
        place = share * (len(self.values) - 1)
        low, high = self.values[math.floor(place)], self.values[math.ceil(place)]
        return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high

    def mean_upto(self, line: float) -> float:
        """Mean of the values that are at most line; 0 if there are none."""
        n = bisect.bisect_right(self.values, line)
        return sum(self.values[:n]) / max(n, 1)


def tail(x: np.ndarray, first: int, last: int, n: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The alpha quantile of the last n values, and the mean of those at most as large; NaN unless all n are there."""
    window, var, es = SortedWindow(), np.full(last - first, np.nan), np.full(last - first, np.nan)
    for i in range(max(first - n + 1, 0), last):
        if not math.isnan(x[i]):
            window.add(x[i])
        if i - n >= max(first - n + 1, 0) and not math.isnan(x[i - n]):
            window.remove(x[i - n])
        if i >= first and len(window.values) >= n:
            var[i - first] = window.quantile(alpha)
            es[i - first] = window.mean_upto(var[i - first])
    return var, es


def spearman(x: np.ndarray, y: np.ndarray, first: int, last: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank correlation of the last n pairs, ties sharing the mean of their ranks, NaN without spread; and 1 from n rows on.

    Ranks move along with the window: a value that enters or leaves shifts those above it by one and its equals by a half.
    """
    out, full, mean = np.full(last - first, np.nan), np.zeros(last - first), (n + 1) / 2
    place, held = np.full((2, n), np.nan), np.full((2, n), np.nan)  # of the pair of row i at i % n
    for i in range(max(first - n + 1, 0), last):
        at = i % n
        for k, v in ((0, x[i]), (1, y[i])):
            gone = held[k, at]
            if not math.isnan(gone):
                held[k, at] = np.nan
                place[k] -= (held[k] > gone) + 0.5 * (held[k] == gone)
            above, equal = held[k] > v, held[k] == v
            place[k] += above + 0.5 * equal
            place[k, at] = 1 + np.count_nonzero(held[k] < v) + 0.5 * np.count_nonzero(equal)
            held[k, at] = v
        if i >= first and i - max(first - n + 1, 0) >= n - 1:
            a, b = place - mean
            spread = math.sqrt((a @ a) * (b @ b))
            out[i - first], full[i - first] = (a @ b) / spread if spread else np.nan, 1.0
    return out, full


def first_touch(price: np.ndarray, first: int, last: int, horizon: int, up: float, down: float) -> tuple[np.ndarray]:
    """1 where a return of ``up`` from the row's price is met first within the horizon, -1 where one of -down is, else the
    sign of the last return; NaN without a later price.

    Range maxima and minima over spans of 1, 2, 4, ... rows let each row skip, longest spans first, what holds no touch.
    """
    n, rows = len(price), np.arange(first, last)
    gap = np.isnan(price)
    high, low = [np.where(gap, -np.inf, price)], [np.where(gap, np.inf, price)]
    while 2 << (len(high) - 1) <= horizon:
        span = 1 << (len(high) - 1)
        for levels, pick in ((high, np.maximum), (low, np.minimum)):
            levels.append(pick(levels[-1][: len(levels[-1]) - span], levels[-1][span:]) if len(levels[-1]) > span else levels[-1][:0])
    base, end = price[rows], np.minimum(rows + horizon, n - 1) + 1

    def touch(levels: list[np.ndarray], met: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        at = rows + 1
        for k in range(len(levels) - 1, -1, -1):  # one span of each length at most is left out
            can = np.flatnonzero(at + (1 << k) <= end)
            can = can[~met(levels[k][at[can]], base[can])]
            at[can] += 1 << k
        return at

    def either(levels: list[np.ndarray], mirrored: list[np.ndarray], met: Callable) -> np.ndarray:
        """Returns fall as prices rise where the row's own price is negative."""
        return np.where(base < 0, touch(mirrored, met), touch(levels, met)) if (base < 0).any() else touch(levels, met)

    with np.errstate(invalid="ignore", divide="ignore"):
        rise = either(high, low, lambda p, b: p / b - 1 >= up)
        fall = either(low, high, lambda p, b: p / b - 1 <= -down)
        seen = np.maximum.accumulate(np.where(gap, -1, np.arange(n)))
        final = seen[end - 1]
        out = np.where(final > rows, np.sign(price[np.maximum(final, 0)] / base - 1), np.nan)
        out = np.where((fall < end) & (fall < rise), -1.0, out)
        out = np.where((rise < end) & (rise <= fall), 1.0, out)
    return (out,)
