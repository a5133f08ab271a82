"""Market regimes: quantile and trend labels, CUSUM flags, a Gaussian hidden Markov model, transitions and durations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.linear import BUCKET_S
from quantloom.functions.quantiles import with_quantiles
from quantloom.functions.windows import by_time
from quantloom.operators import sequential
from quantloom.operators.hmm_model import Hmm, HmmConfig, fit_hmm  # noqa: F401
from quantloom.operators.hmm_scan import scan_hmm


def quantile_labels(panel: DataFrame, vol: str, quantiles: tuple[float, ...] = (0.3, 0.7), calibrate: Column | None = None) -> DataFrame:
    """panel with state, the number of thresholds below the volatility, and p_state_k; NULL volatility has no state.

    Thresholds are quantiles of the rows marked by ``calibrate``, of all rows without it.
    """
    base = F.col(vol) if calibrate is None else F.when(calibrate, F.col(vol))
    out = with_quantiles(panel, base, quantiles, "_edges")
    edges = F.array_distinct("_edges")
    out = out.withColumn("state", F.when(F.col(vol).isNotNull(), F.size(F.filter(edges, lambda t: t < F.col(vol))))).drop("_edges")
    return _with_p(out, len(quantiles) + 1)


def _with_p(labelled: DataFrame, n: int) -> DataFrame:
    """labelled with p_state_k, 1 for the state of the row."""
    return labelled.withColumns({f"p_state_{k}": F.coalesce(F.col("state") == k, F.lit(False)).cast("double") for k in range(n)})


def trend_labels(panel: DataFrame, slope: str, r2: str, quantile: float = 0.7, least_r2: float = 0.5, calibrate: Column | None = None) -> DataFrame:
    """panel with state: 1 where the slope is steep for its series and fits well, else 0; NULL without a slope; and p_state_k."""
    base = F.abs(slope) if calibrate is None else F.when(calibrate, F.abs(slope))
    out = with_quantiles(panel, base, (quantile,), "_line")
    known = F.col(slope).isNotNull() & F.col(r2).isNotNull()
    state = F.when(known, ((F.abs(slope) >= F.col("_line")[0]) & (F.col(r2) >= least_r2)).cast("int"))
    return _with_p(out.withColumn("state", state).drop("_line"), 2)


def cusum(panel: DataFrame, x: str, threshold: float, drift: float, bucket_s: int = BUCKET_S) -> DataFrame:
    """(instrument, ts, flag) of the two-sided cumulative sum with reset, by time buckets."""
    flags = sequential.run_scan(panel, [x], ["flag"], sequential.flagged(threshold, drift), bucket_s=bucket_s)
    return flags.withColumn("flag", F.col("flag").cast("int"))


def transition_matrix(panel: DataFrame, n_states: int, state: str = "state") -> DataFrame:
    """(instrument, from_state, to_state, p): row shares of the steps between rows with a state; rows never left are 0."""
    known = panel.filter(F.col(state).isNotNull()).withColumn("_p", F.lag(state).over(by_time()))
    counts = known.filter("_p is not null").groupBy("instrument", F.col("_p").alias("from_state"), F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
    grid = known.select("instrument").distinct().withColumn("from_state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1)))).withColumn("to_state", F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))))
    full = grid.join(counts, ["instrument", "from_state", "to_state"], "left").fillna(0, ["n"])
    p = F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("instrument", "from_state"))), F.lit(0.0))
    return full.select("instrument", "from_state", "to_state", p.alias("p"))


def runs(panel: DataFrame, state: str = "state") -> DataFrame:
    """(instrument, run, state, length) of the runs of equal states; rows without a state are passed over."""
    known = panel.filter(F.col(state).isNotNull()).withColumn("_n", F.coalesce((F.col(state) != F.lag(state).over(by_time())).cast("int"), F.lit(0)))
    numbered = known.withColumn("run", F.sum("_n").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("instrument", "run").agg(F.first(state).alias("state"), F.count("*").alias("length"))


def durations(panel: DataFrame, state: str = "state") -> DataFrame:
    """(instrument, state, n_runs, n_rows, mean, median, p90) of the run lengths."""
    q = lambda p: F.expr(f"percentile(length, {p})")
    return runs(panel, state).groupBy("instrument", "state").agg(F.count("*").alias("n_runs"), F.sum("length").alias("n_rows"), F.avg("length").alias("mean"), q(0.5).alias("median"), q(0.9).alias("p90"))


def hmm(panel: DataFrame, columns: list[str], cfg: HmmConfig = HmmConfig(), mode: str = "filter", calibrate: str | None = None, bucket_s: int | None = None) -> DataFrame:
    """(instrument, ts, state, p_state_k) of each series: filter uses rows up to ts; smooth and viterbi use all of them.

    The model is fitted on the rows marked by ``calibrate``, on all rows without it. Rows with a NULL feature are left out;
    a series with fewer than 10 * n_states rows has no states. With ``bucket_s`` a task holds the rows of so many seconds
    of a series, without it a whole series; the results are the same.
    """
    if mode not in ("filter", "smooth", "viterbi"):
        raise ValueError("unknown mode")
    if bucket_s:
        return scan_hmm(panel, columns, cfg, mode, calibrate, bucket_s)
    schema = "instrument string, ts timestamp_ntz, state int, " + ", ".join(f"p_state_{k} double" for k in range(cfg.n_states))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=columns).sort_values("ts", kind="stable")
        x = pdf[columns].to_numpy(dtype=float)
        train = x[pdf[calibrate].to_numpy(dtype=bool)] if calibrate else x
        if len(train) < 10 * cfg.n_states:
            return pdf[["instrument", "ts"]].iloc[:0].assign(state=np.empty(0, dtype=np.int32), **{f"p_state_{k}": np.empty(0) for k in range(cfg.n_states)})
        model = fit_hmm(train, cfg)
        logs = model.densities(x)
        p = model.smooth(logs)[0] if mode == "smooth" else model.forward(logs)[0]
        state = model.viterbi(logs) if mode == "viterbi" else p.argmax(axis=1)
        if mode == "viterbi":
            p = np.eye(cfg.n_states)[state]
        return pd.DataFrame({"instrument": pdf["instrument"].to_numpy(), "ts": pdf["ts"].to_numpy(), "state": state.astype(np.int32)} | {f"p_state_{k}": p[:, k] for k in range(cfg.n_states)})

    wanted = ["instrument", "ts", *columns, *([calibrate] if calibrate else [])]
    return panel.select(*wanted).groupBy("instrument").applyInPandas(run, schema)


def shift_states(labelled: DataFrame, shift: int, n_states: int) -> DataFrame:
    """States and probabilities moved ``shift`` rows later, so that a row uses only what was known before it."""
    names = ["state", *(f"p_state_{k}" for k in range(n_states))]
    return labelled.withColumns({c: F.lag(c, shift).over(by_time()) for c in names if c in labelled.columns}) if shift else labelled
