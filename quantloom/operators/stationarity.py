"""Stationarity tests of long series: augmented Dickey-Fuller and KPSS from moments that chunks of rows add up to.

Both tests need lagged products only. A chunk, with the rows before it that its lags reach, gives the Gram matrix of all
regressors and the lagged products of deviations; chunks are added up by Spark in two steps. One factorisation of the
sum gives the residuals of every number of lags at once, as each model is a leading block of the next.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import chunks
from quantloom.functions.stats import normal_cdf, polynomial
from quantloom.functions.windows import by_instrument, by_time, up_to_now

#: Published critical values of the KPSS statistic for a constant, and their levels.
KPSS_LINES, KPSS_LEVELS = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)
#: Published response-surface coefficients of the Dickey-Fuller critical values for a constant, by level.
ADF_LINES = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}
#: Published response surface of the Dickey-Fuller p-value for a constant, by ascending power, for small and
#: for large p-values; where the two meet; and beyond which statistics p is 0 or 1.
ADF_SMALL_P, ADF_LARGE_P = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_MEET, ADF_LEAST, ADF_MOST = -1.61, -18.83, 2.74
#: Least rows of a chunk, and chunks that are added up before a series' sum is made.
CHUNK_ROWS, SLICE = 250_000, 64
BUCKET_S = 30 * 86_400


def kpss_lags(n: int) -> int:
    """Lags of the long-run variance by the length of the series."""
    return int(math.ceil(12 * (n / 100) ** 0.25))


def _kpss_p(stat) -> Column:
    """p-value between the published lines, by linear interpolation; the outer levels beyond them."""
    p = F.when(stat <= KPSS_LINES[0], KPSS_LEVELS[0])
    for k in range(3):
        share = (stat - KPSS_LINES[k]) / (KPSS_LINES[k + 1] - KPSS_LINES[k])
        p = p.when(stat <= KPSS_LINES[k + 1], KPSS_LEVELS[k] + share * (KPSS_LEVELS[k + 1] - KPSS_LEVELS[k]))
    return p.when(stat.isNotNull(), KPSS_LEVELS[-1])


def kpss(panel: DataFrame, x: str, lags: int) -> DataFrame:
    """(instrument, n, kpss, p_value) around a constant: squared partial sums over the Bartlett long-run variance."""
    rows = panel.filter(F.col(x).isNotNull()).select("instrument", "ts", F.col(x).alias("_x"))
    rows = rows.withColumn("_e", F.col("_x") - F.avg("_x").over(by_instrument()))
    rows = rows.select("*", F.sum("_e").over(up_to_now()).alias("_s"), *[(F.col("_e") * F.lag("_e", k).over(by_time())).alias(f"_c{k}") for k in range(1, lags + 1)])
    n = F.count("*")
    long_run = F.sum(F.col("_e") * F.col("_e")) / n
    for k in range(1, lags + 1):
        long_run = long_run + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_c{k}"), F.lit(0.0)) / n
    out = rows.groupBy("instrument").agg(n.alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("_q"), long_run.alias("_v"))
    out = out.withColumn("kpss", F.try_divide(F.col("_q"), F.col("n") * F.col("n") * F.col("_v"))).drop("_q", "_v")
    return out.withColumn("p_value", _kpss_p(F.col("kpss")))


def most_adf_lags(n: int) -> int:
    """The lags that are tried at most; negative for a series too short for the test."""
    return min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)


def gram(e: np.ndarray, first: int, begin: int, lags: int, skip: int) -> np.ndarray:
    """Sums of products of (1, level before, the steps 1 .. lags before, step) over the rows of a chunk.

    e: deviations in time order, e[0] being row ``begin`` of the series, of which those from ``first`` on are the chunk's
    own. Only rows with ``skip`` lagged steps count.
    """
    rows = np.arange(max(first, skip + 1 - begin), len(e))
    if not len(rows):
        return np.zeros((lags + 3, lags + 3))
    d = np.diff(e)
    design = np.column_stack([np.ones(len(rows)), e[rows - 1], *(d[rows - 1 - k] for k in range(1, lags + 1)), d[rows - 1]])
    return design.T @ design


def best_lags(g: np.ndarray) -> int:
    """The number of lags of least AIC from the Gram matrix with the most lags; the fewest of equals.

    Row j of the factor holds what the step still correlates with regressor j, all before it taken out, so each model's
    squared residuals are what is left of the step's own square after as many terms.
    """
    n = g[0, 0]
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    factor = _factor(g * scale * scale[:, None])
    left = (1.0 - np.cumsum(factor[-1, :-1] ** 2)) / scale[-1] ** 2
    aic = [n * math.log(max(left[k + 1] / n, 1e-300)) + 2 * (k + 2) for k in range(len(g) - 2)]
    return int(np.argmin(aic))


def _factor(g: np.ndarray) -> np.ndarray:
    """Lower Cholesky factor; a regressor that those before it explain gets no column of its own."""
    out = np.zeros_like(g)
    for j in range(len(g)):
        left = g[j, j] - out[j, :j] @ out[j, :j]
        if left > 1e-13:
            out[j, j] = math.sqrt(left)
            out[j + 1 :, j] = (g[j + 1 :, j] - out[j + 1 :, :j] @ out[j, :j]) / out[j, j]
    return out


def t_of_level(g: np.ndarray) -> float:
    """t statistic of the level before from a Gram matrix, which is taken out last; NaN without residuals."""
    order = [0, *range(2, len(g) - 1), 1, len(g) - 1]
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    factor = _factor((g * scale * scale[:, None])[np.ix_(order, order)])
    n, k = g[0, 0], len(g) - 1
    left = 1.0 - factor[-1, :-1] @ factor[-1, :-1]
    return float(factor[-1, -2] / math.sqrt(left / (n - k))) if left > 1e-13 and n > k and factor[-2, -2] > 0 else math.nan


def lagged_products(e: np.ndarray, first: int, lags: int) -> np.ndarray:
    """Sums of e[t] * e[t - k] for k = 0 .. lags over the chunk's own rows t."""
    own = e[first:]
    return np.array([own @ e[first - k : len(e) - k] if k <= first else own[k - first :] @ e[: len(e) - k] if k < len(e) else 0.0 for k in range(lags + 1)])


def long_run_lags(products: np.ndarray, n: int) -> int:
    """Lags of the long-run variance by the series' own correlation, from its lagged products up to n^(2/9)."""
    pairs = products[1:] / (n / 2)
    s0, s1 = products[0] / n + pairs.sum(), (np.arange(1, len(products)) * pairs).sum()
    if s0 == 0:
        return 0
    return min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)


def _chunked(panel: DataFrame, x: str, chunk_rows: int) -> DataFrame:
    """(instrument, _chunk, _rn, own, _rows, _e): deviations from the mean, each chunk with the rows its lags may reach."""
    rows = panel.filter(F.col(x).isNotNull()).select("instrument", "ts", F.col(x).cast("double").alias("_x"))
    rows = chunks.numbered(rows, BUCKET_S, "_x").withColumn("_e", F.col("_x") - F.col("_total") / F.col("_rows"))
    n = F.col("_rows").cast("double")
    reach = F.greatest(F.ceil(12 * F.pow(n / 100, F.lit(0.25))) + 1, F.ceil(1.1447 * F.pow(n, F.lit(13 / 27))) + 1)  # s1 / s0 is n^(2/9) at most
    return chunks.dealt(rows, reach, F.greatest(F.lit(chunk_rows).cast("long"), reach)).select("instrument", "_chunk", "_rn", "own", "_rows", "_e")


def _added(notes: DataFrame, kind: str) -> DataFrame:
    """Tuples of arrays and numbers of each chunk added up by series; _chunk is that of the first part."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [pickle.loads(n) for n in pdf["note"]]
        total = tuple(sum(parts[1:], parts[0]) for parts in zip(*found, strict=True))
        return pdf.iloc[:1][["instrument", "_slice"]].assign(note=[pickle.dumps(total)])

    schema = f"instrument {kind}, _slice long, note binary"
    parts = notes.withColumn("_slice", F.floor(F.col("_chunk") / SLICE)).select("instrument", "_slice", "note").groupBy("instrument", "_slice").applyInPandas(add, schema)
    return parts.withColumn("_slice", F.lit(0).cast("long")).groupBy("instrument", "_slice").applyInPandas(add, schema).select("instrument", "note")


def stationarity_report(panel: DataFrame, x: str, lags: int | None = None, adf_lags: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row a series, in 15 columns and two verdicts at 5 %, adf_stationary and kpss_stationary: (instrument, adf_stat, adf_pvalue, adf_usedlag, adf_nobs, adf_crit_1pct, adf_crit_5pct,
    adf_crit_10pct, kpss_stat, kpss_pvalue, kpss_lags, kpss_crit_10pct, kpss_crit_5pct, kpss_crit_2_5pct, kpss_crit_1pct).

    Lags of the Dickey-Fuller regression are those of least AIC on equal rows, those of the long-run variance follow from
    the series' own correlation; lags and adf_lags fix them. NULLs of x are left out first; a series without values has no
    row; statistics that a short or constant series does not have are NULL.
    """
    kind = panel.schema["instrument"].dataType.simpleString()
    rows, note = _chunked(panel, x, chunk_rows), f"instrument {kind}, _chunk long, note binary"
    keys = ["instrument", "_chunk"]

    def read(pdf: pd.DataFrame) -> tuple[np.ndarray, int, int, int]:
        pdf = pdf.sort_values("_rn")
        return pdf["_e"].to_numpy(dtype=float), int((~pdf["own"]).sum()), int(pdf["_rn"].iloc[0]), int(pdf["_rows"].iloc[0])

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        e, ahead, begin, n = read(pdf)
        most = max(most_adf_lags(n), 0)
        found = (gram(e, ahead, begin, most, most), lagged_products(e, ahead, int(n ** (2 / 9))))
        return pdf.iloc[:1][keys].assign(note=[pickle.dumps(found)])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text, n in zip(pdf["note"], pdf["n"], strict=True):
            g, products = pickle.loads(text)
            out.append((best_lags(g) if adf_lags is None and most_adf_lags(n) >= 0 else max(adf_lags or 0, 0), long_run_lags(products, n) if lags is None else min(lags, n - 1)))
        return pdf[["instrument"]].assign(used=[a for a, _ in out], held=[b for _, b in out])

    def second(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        e, ahead, begin, n = read(pdf)
        used, held = int(told["used"].iloc[0]), int(told["held"].iloc[0])
        sums = np.cumsum(e[ahead:])  # partial sums from the start of the chunk; what was before it is added later
        found = (gram(e, ahead, begin, used, used), lagged_products(e, ahead, held))
        order = int(pdf["_chunk"].iloc[0])
        return pdf.iloc[:1][keys].assign(note=[pickle.dumps(found)], moved=[sums[-1]], s1=[sums.sum()], s2=[(sums * sums).sum()], m=[len(sums)], order=[order])

    def report(frames):
        for pdf in frames:
            out = []
            for text, n in zip(pdf["note"], pdf["n"], strict=True):
                g, products = pickle.loads(text)
                held = len(products) - 1
                spread = (products[0] + 2 * sum((1 - k / (held + 1)) * products[k] for k in range(1, held + 1))) / n
                short = most_adf_lags(n) < 0 or products[0] <= 0
                out.append((math.nan if short else t_of_level(g), len(g) - 3, int(g[0, 0]), held, spread))
            stat, used, rows_used, held, spread = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [], [])
            yield pdf[["instrument", "n"]].assign(adf_stat=stat, adf_usedlag=used, adf_nobs=rows_used, kpss_lags=held, spread=spread)

    n_rows = rows.filter("own").groupBy("instrument").agg(F.count("*").alias("n"))
    one = rows.groupBy(*keys).applyInPandas(first, note)
    chosen = _added(one, kind).join(n_rows, "instrument").mapInPandas(lambda frames: (choose(f) for f in frames), f"instrument {kind}, used int, held int")
    told = one.select(*keys).join(chosen, "instrument")
    two = rows.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(second, note + ", moved double, s1 double, s2 double, m long, order long")
    before = F.coalesce(F.sum("moved").over(Window.partitionBy("instrument").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    squares = two.withColumn("_b", before).groupBy("instrument").agg(F.sum(F.col("m") * F.col("_b") * F.col("_b") + 2 * F.col("_b") * F.col("s1") + F.col("s2")).alias("_q"))
    found = _added(two.select(*keys, "note"), kind).join(n_rows, "instrument").mapInPandas(report, f"instrument {kind}, n long, adf_stat double, adf_usedlag int, adf_nobs long, kpss_lags int, spread double").join(squares, "instrument")
    adf = F.when(~F.isnan("adf_stat"), F.col("adf_stat"))
    n, stat = F.col("adf_nobs").cast("double"), F.try_divide(F.col("_q"), F.col("n") * F.col("n") * F.when(F.col("spread") > 0, F.col("spread")))
    crit = {f"adf_crit_{int(100 * p)}pct": F.when(adf.isNotNull(), cs[0] + cs[1] / n + cs[2] / (n * n) + cs[3] / (n * n * n)) for p, cs in ADF_LINES.items()}
    kpss_crit = {f"kpss_crit_{name}pct": F.lit(v) for name, v in zip(("10", "5", "2_5", "1"), KPSS_LINES, strict=True)}
    out = found.select(
        "instrument", adf.alias("adf_stat"), adf_p(adf).alias("adf_pvalue"), "adf_usedlag", "adf_nobs", *[c.alias(k) for k, c in crit.items()],
        stat.alias("kpss_stat"), _kpss_p(stat).alias("kpss_pvalue"), "kpss_lags", *[c.alias(k) for k, c in kpss_crit.items()],
    )
    return out.withColumn("adf_stationary", F.col("adf_stat") < F.col("adf_crit_5pct")).withColumn("kpss_stationary", F.col("kpss_pvalue") > 0.05)


def adf_p(stat) -> Column:
    """p-value of the Dickey-Fuller statistic by the published response surface."""
    near = F.when(stat <= ADF_MEET, polynomial(stat, ADF_SMALL_P[::-1])).otherwise(polynomial(stat, ADF_LARGE_P[::-1]))
    return F.when(stat > ADF_MOST, 1.0).when(stat < ADF_LEAST, 0.0).when(stat.isNotNull(), normal_cdf(near))
