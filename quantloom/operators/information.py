"""Information measures of features against targets: IC, mutual information, entropy, drift, transfer entropy, selection.

Most operators take a long frame: (instrument, feature, ts, x, y, ...), one row for each feature and time; ``keys`` are
the columns that separate one statistic from the next.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import sliding
from quantloom.functions.quantiles import exact_quantiles
from quantloom.functions.stats import average_rank, correlation, normal_cdf, normal_ppf
from quantloom.operators.features import forward_return

EPSILON = 1e-12
KEYS = ("instrument", "feature")


def unpivot(wide: DataFrame, features: list[str], keep: tuple[str, ...] = ("instrument", "ts", "y")) -> DataFrame:
    """Wide features to the long frame."""
    return wide.unpivot([F.col(c) for c in keep], [F.col(c) for c in features], "feature", "x")


def targets(panel: DataFrame, forward: str = "fwd", signal: str | None = None, costs_bps: float = 0.0) -> DataFrame:
    """panel with up (forward return above 0, NULL stays) and, with a signal, pays (signal * forward above costs)."""
    f = F.col(forward)
    out = panel.withColumn("up", F.when(f.isNotNull(), (f > 0).cast("int")))
    return out.withColumn("pays", F.when(f.isNotNull() & F.col(signal).isNotNull(), (F.col(signal) * f > costs_bps / 1e4).cast("int"))) if signal else out


def complete(long: DataFrame) -> DataFrame:
    return long.filter("x is not null and y is not null")


def ranked(long: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The complete rows with x and y as average ranks."""
    out = complete(long)
    for c in ("x", "y"):
        rank = average_rank(c, Window.partitionBy(*keys).orderBy(c), Window.partitionBy(*keys, c))
        out = out.withColumn(f"_{c}", rank.cast("double"))
    return out.drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})


def ic(long: DataFrame, method: str = "pearson", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ic, n): Pearson or Spearman correlation of the complete rows, NULL below two."""
    rows = complete(long) if method == "pearson" else ranked(long, keys)
    return rows.groupBy(*keys).agg(correlation("x", "y").alias("ic"), F.count("*").alias("n"))


def ic_decay(panel: DataFrame, signal: str, returns: str, horizons: tuple[int, ...]) -> DataFrame:
    """(instrument, horizon, ic, n): Spearman correlation of the signal with the return summed over the next ``horizon`` rows."""
    wide = panel.select("instrument", "ts", F.col(signal).alias("x"), *[forward_return(returns, h).alias(f"y{h}") for h in horizons])
    ahead = wide.select("instrument", "ts", "x", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y{h}").alias("y")) for h in horizons])))
    return ic(ahead, "spearman", ("instrument", "horizon"))


def ic_rolling(long: DataFrame, n: int, method: str = "pearson", keys: tuple[str, ...] = KEYS, chunk_rows: int = sliding.CHUNK_ROWS) -> DataFrame:
    """(keys, ts, ic) over the last n complete rows, from the first full window on; Spearman ranks inside each window."""
    order = Window.partitionBy(*keys).orderBy("ts")
    frame = order.rowsBetween(1 - n, 0)
    rows = complete(long).withColumn("_n", F.count("*").over(frame))
    if method == "pearson":
        return rows.withColumn("ic", correlation("x", "y", frame)).filter(F.col("_n") >= n).select(*keys, "ts", "ic")
    out = sliding.run_sliding(complete(long), ["x", "y"], ["ic", "_full"], lambda x, y, first, last: sliding.spearman(x, y, first, last, n), n, keep=(*keys, "ts"), keys=keys, chunk_rows=chunk_rows)
    return out.filter("_full = 1").select(*keys, "ts", "ic")


def ic_stats(series: DataFrame, lags: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ic_mean, ic_std, ic_ir, t_stat, pvalue, n) of an IC series (keys, ts, ic), the variance by Newey and West."""
    order, whole = Window.partitionBy(*keys).orderBy("ts"), Window.partitionBy(*keys)
    rows = series.filter("ic is not null").withColumn("_d", F.col("ic") - F.avg("ic").over(whole))
    rows = rows.select("*", *[(F.col("_d") * F.lag("_d", k).over(order)).alias(f"_c{k}") for k in range(1, lags + 1)])
    n = F.count("*")
    variance = F.sum(F.col("_d") * F.col("_d")) / n
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"_c{k}"), F.lit(0.0)) / n
    out = rows.groupBy(*keys).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), variance.alias("_v"), n.alias("n"))
    t = F.try_divide(F.col("ic_mean"), F.sqrt(F.greatest(F.col("_v"), F.lit(0.0)) / F.col("n")))
    out = out.withColumn("ic_ir", F.try_divide(F.col("ic_mean"), F.col("ic_std"))).withColumn("t_stat", t)
    return out.withColumn("pvalue", 2 * (1 - normal_cdf(F.abs("t_stat")))).drop("_v")


def quantile_bin(x: str, bins: int, over) -> Column:
    """Bin number by quantiles of x in the window: right-closed, the least value in bin 0, equal edges merged."""
    shares = ", ".join(repr(k / bins) for k in range(bins + 1))
    edges = F.array_distinct(F.expr(f"percentile({x}, array({shares}))").over(over))
    return F.when(F.col(x).isNotNull(), F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e < F.col(x))) - 1))


def width_bin(x: str, bins: int, over) -> Column:
    """Bin number by equal widths between the least and the greatest x in the window, right-closed."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    at = F.ceil(F.try_divide(F.col(x) - low, high - low) * bins) - 1
    return F.when(F.col(x).isNotNull(), F.greatest(F.lit(0), F.coalesce(at, F.lit(0))).cast("int"))


def binned_exactly(long: DataFrame, columns: tuple[str, ...], bins: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """long with b_x for each column, as binned() by quantiles gives them; edges by distributed selection, so that no task
    holds the values of a key."""
    out = long
    for c in columns:
        edges = exact_quantiles(long, list(keys), c, tuple(k / bins for k in range(bins + 1)), "_edges").withColumn("_edges", F.array_distinct("_edges"))
        x = F.col(c)
        below = F.size(F.filter("_edges", lambda e: e < x))  # noqa: B023
        out = out.join(edges, list(keys), "left").withColumn(f"b_{c}", F.when(x.isNotNull(), F.greatest(F.lit(0), below - 1))).drop("_edges")
    return out


def binned(long: DataFrame, columns: tuple[str, ...], bins: int, binning: str = "quantile", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """long with b_x for each column; bins come from each column's own values."""
    how = quantile_bin if binning == "quantile" else width_bin
    return long.withColumns({f"b_{c}": how(c, bins, Window.partitionBy(*keys)) for c in columns})


def mi_hist(long: DataFrame, bins: int = 10, binning: str = "quantile", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, mi): mutual information in nats of the contingency table, each cell raised by 1e-12."""
    table = binned(long, ("x", "y"), bins, binning, keys).filter("b_x is not null and b_y is not null").groupBy(*keys, "b_x", "b_y").agg(F.count("*").cast("double").alias("n"))
    whole = Window.partitionBy(*keys)
    out = table.withColumn("p", F.col("n") / F.sum("n").over(whole))
    out = out.withColumn("px", F.sum("p").over(Window.partitionBy(*keys, "b_x"))).withColumn("py", F.sum("p").over(Window.partitionBy(*keys, "b_y")))
    return out.groupBy(*keys).agg(F.sum(F.col("p") * F.log((F.col("p") + EPSILON) / (F.col("px") * F.col("py") + EPSILON))).alias("mi"))


def mi_copula(long: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, mi): -ln(1 - rho^2) / 2 of the normal scores of the ranks, NULL below three rows."""
    rows = ranked(long, keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    for c in ("x", "y"):
        rows = rows.withColumn(c, normal_ppf((F.col(c) - 0.5) / n))
    rho = rows.groupBy(*keys).agg(correlation("x", "y").alias("rho"), F.count("*").alias("n"))
    bound = F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("rho")))
    return rho.select(*keys, F.when((F.col("n") >= 3) & F.col("rho").isNotNull(), -0.5 * F.log(1 - bound * bound)).alias("mi"))


def mutual_information(long: DataFrame, estimator: str = "hist", bins: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    if estimator not in ("hist", "copula"):
        raise ValueError("unknown estimator")
    return mi_hist(long, bins, keys=keys) if estimator == "hist" else mi_copula(long, keys)


def conditional_mi(long: DataFrame, bins: int = 10, keys: tuple[str, ...] = KEYS, regime: str = "regime") -> DataFrame:
    """(keys, cmi): mean over regimes of the mutual information inside each, by rows."""
    rows = complete(long).filter(F.col(regime).isNotNull())
    weights = rows.groupBy(*keys, regime).agg(F.count("*").alias("n"))
    return mi_hist(rows, bins, keys=(*keys, regime)).join(weights, [*keys, regime]).groupBy(*keys).agg((F.sum(F.col("mi") * F.col("n")) / F.sum("n")).alias("cmi"))


def pairwise_mi(long: DataFrame, bins: int = 10, instrument: str = "instrument", most: int = 200) -> DataFrame:
    """(instrument, f1, f2, mi) for all ordered pairs of features, 0 on the diagonal; refuses more than ``most`` features.

    The rows of one time meet each other, never those of another, so the join grows with rows times features.
    """
    features = [r[0] for r in long.select("feature").distinct().limit(most + 1).collect()]
    if len(features) > most:
        raise ValueError("too many features")
    rows = binned(long.select(instrument, "feature", "ts", "x"), ("x",), bins)
    a = rows.select(instrument, "ts", F.col("feature").alias("f1"), F.col("b_x").alias("b1"))
    b = rows.select(instrument, "ts", F.col("feature").alias("f2"), F.col("b_x").alias("b2"))
    table = a.join(b, [instrument, "ts"]).filter("f1 < f2 and b1 is not null and b2 is not null").groupBy(instrument, "f1", "f2", "b1", "b2").agg(F.count("*").cast("double").alias("n"))
    whole = [instrument, "f1", "f2"]
    out = table.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*whole)))
    out = out.withColumn("px", F.sum("p").over(Window.partitionBy(*whole, "b1"))).withColumn("py", F.sum("p").over(Window.partitionBy(*whole, "b2")))
    upper = out.groupBy(*whole).agg(F.sum(F.col("p") * F.log((F.col("p") + EPSILON) / (F.col("px") * F.col("py") + EPSILON))).alias("mi"))
    lower = upper.select(instrument, F.col("f2").alias("f1"), F.col("f1").alias("f2"), "mi")
    diagonal = long.select(instrument, F.col("feature").alias("f1"), F.col("feature").alias("f2"), F.lit(0.0).alias("mi")).distinct()
    return upper.unionByName(lower).unionByName(diagonal)


def entropy(long: DataFrame, bins: int = 10, binning: str = "quantile", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, entropy) in nats of the binned x."""
    counts = binned(long, ("x",), bins, binning, keys).filter("b_x is not null").groupBy(*keys, "b_x").agg(F.count("*").cast("double").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def joint_entropy(long: DataFrame, bins: int = 10, binning: str = "quantile", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, entropy) in nats of the binned pair, complete rows only."""
    rows = binned(long, ("x", "y"), bins, binning, keys).filter("b_x is not null and b_y is not null")
    counts = rows.groupBy(*keys, "b_x", "b_y").agg(F.count("*").cast("double").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg((-F.sum(F.col("p") * F.log(F.col("p") + EPSILON))).alias("entropy"))


def surprisal(long: DataFrame, bins: int = 10, binning: str = "quantile", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts, surprisal): -ln of the share of the row's bin."""
    rows = binned(long, ("x",), bins, binning, keys).filter("b_x is not null")
    share = F.count("*").over(Window.partitionBy(*keys, "b_x")) / F.count("*").over(Window.partitionBy(*keys))
    return rows.select(*keys, "ts", (-F.log(share)).alias("surprisal"))


def divergences(p: Column, q: Column) -> dict[str, Column]:
    """Aggregates over bins: PSI, KL, cross entropy, Jensen-Shannon, Hellinger; p and q are positive."""
    m = (p + q) / 2
    return {
        "psi": F.sum((p - q) * F.log(p / q)),
        "kl": F.sum(p * F.log(p / q)),
        "cross_entropy": -F.sum(p * F.log(q)),
        "js": F.sum(p * F.log(p / m) + q * F.log(q / m)) / 2,
        "hellinger": F.sqrt(F.sum((F.sqrt(p) - F.sqrt(q)) * (F.sqrt(p) - F.sqrt(q))) / 2),
    }


def drift_edges(train: DataFrame, bins: int, binning: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, inner): the edges between the bins of x, the outer ones left out; equal edges are merged.

    By "quantile" one task adds up the distinct values of a key, by "selection" none does; the edges are the same.
    """
    shares = tuple(k / bins for k in range(bins + 1))
    if binning in ("quantile", "selection"):
        percentiles = F.expr(f"percentile(x, array({', '.join(map(repr, shares))}))")
        edges = exact_quantiles(train, list(keys), "x", shares, "_e") if binning == "selection" else train.groupBy(*keys).agg(percentiles.alias("_e"))
        edges = edges.withColumn("_e", F.array_distinct("_e"))
        return edges.select(*keys, F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0))).alias("inner"))
    if binning != "width":
        raise ValueError("bins are by quantile, by selection or by width")
    ends = train.filter("x is not null").groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    margin = F.when(F.col("_lo") < F.col("_hi"), 0.0).otherwise(F.when(F.col("_lo") == 0, 0.001).otherwise(0.001 * F.abs("_lo")))  # one value lies in the middle
    low, high = F.col("_lo") - margin, F.col("_hi") + margin
    return ends.select(*keys, F.array(*[low + (high - low) / bins * k for k in range(1, bins)]).alias("inner"))


def drift(train: DataFrame, live: DataFrame, bins: int = 10, keys: tuple[str, ...] = KEYS, binning: str = "quantile") -> DataFrame:
    """(keys, psi, kl, cross_entropy, js, hellinger) of live against train, in left-closed bins by train's quantiles (quantile,
    or selection for keys that no task can hold), or of equal width between train's extremes; the outer bins are open."""
    cut = drift_edges(train, bins, binning, keys)
    place = F.size(F.filter("inner", lambda e: e <= F.col("x")))
    count = lambda df, name: df.filter("x is not null").join(cut, [*keys]).groupBy(*keys, place.alias("b")).agg(F.count("*").cast("double").alias(name))
    grid = cut.select(*keys, F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("b"))
    both_sides = grid.join(count(train, "n_p"), [*keys, "b"], "left").join(count(live, "n_q"), [*keys, "b"], "left")
    whole = Window.partitionBy(*keys)
    for c in ("p", "q"):
        n = F.coalesce(F.col(f"n_{c}"), F.lit(0.0))
        both_sides = both_sides.withColumn(f"_{c}", F.try_divide(n, F.sum(n).over(whole)) + EPSILON)
        both_sides = both_sides.withColumn(c, F.col(f"_{c}") / F.sum(f"_{c}").over(whole))
    return both_sides.groupBy(*keys).agg(*[v.alias(k) for k, v in divergences(F.col("p"), F.col("q")).items()])


def transfer_entropy(long: DataFrame, lags_x: tuple[int, ...] = (1,), lags_y: tuple[int, ...] = (1,), bins: int = 5, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, te) in nats from x to y, both binned first and then lagged."""
    order = Window.partitionBy(*keys).orderBy("ts")
    rows = binned(long, ("x", "y"), bins, keys=keys)
    past_x = F.array(*[F.lag("b_x", k).over(order) for k in lags_x])
    past_y = F.array(*[F.lag("b_y", k).over(order) for k in lags_y])
    rows = rows.withColumn("px", past_x).withColumn("py", past_y)
    whole = rows.filter(F.col("b_y").isNotNull() & F.forall("px", lambda v: v.isNotNull()) & F.forall("py", lambda v: v.isNotNull()))
    cells = whole.groupBy(*keys, "b_y", "px", "py").agg(F.count("*").cast("double").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*keys, *c))
    cells = cells.withColumn("t", over()).withColumn("n_y_py", over("b_y", "py")).withColumn("n_py", over("py")).withColumn("n_py_px", over("py", "px"))
    return cells.groupBy(*keys).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("n_py") / (F.col("n_py_px") * F.col("n_y_py")))).alias("te"))


def _codes(b: np.ndarray, lags: tuple[int, ...], bins: int, skip: int) -> np.ndarray:
    """The lagged values of each row from ``skip`` on as one number, a digit a lag."""
    out = np.zeros(len(b) - skip, dtype=np.int64)
    for k in lags:
        out = out * bins + b[skip - k : len(b) - k]
    return out


def _te(y: np.ndarray, past_y: np.ndarray, past_x: np.ndarray) -> float:
    """Transfer entropy in nats from coded pasts: counts of the pairs and triples that occur, however many could."""
    y_of, py, px = np.unique(y, return_inverse=True)[1], np.unique(past_y, return_inverse=True)[1], np.unique(past_x, return_inverse=True)[1]
    n_y, n_py, n_px = (int(v.max()) + 1 for v in (y_of, py, px))

    def counts(code: np.ndarray, size: int) -> np.ndarray:
        """The count of each row's own code."""
        if size <= 1 << 22:
            return np.bincount(code, minlength=size)[code]
        _, place, n = np.unique(code, return_inverse=True, return_counts=True)
        return n[place]

    both = py * n_px + px
    triple, pair, own, past = counts(both * n_y + y_of, n_y * n_py * n_px), counts(both, n_py * n_px), counts(py * n_y + y_of, n_py * n_y), counts(py, n_py)
    return float(np.log(triple * past / (pair.astype(float) * own)).mean())


def te_significance(
    long: DataFrame,
    bins: int = 5,
    runs: int = 200,
    block: int = 0,
    seed: int = 7,
    keys: tuple[str, ...] = KEYS,
    lags_x: tuple[int, ...] = (1,),
    lags_y: tuple[int, ...] = (1,),
) -> DataFrame:
    """(keys, te, pvalue) by permuting x, or by blocks of it, before its lags are taken; run i is seeded by (seed, i).

    x and y are binned once, by Spark; a task gets one key as two columns of small codes, once for all its runs. NULL for a
    key with no row that has all its lags.
    """
    schema = ", ".join([*(f"{k} string" for k in keys), "te double", "pvalue double"])
    rows = binned(complete(long), ("x", "y"), bins, keys=keys).select(*keys, "ts", F.col("b_x").cast("short").alias("b_x"), F.col("b_y").cast("short").alias("b_y"))
    skip = max((*lags_x, *lags_y))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        bx, by = pdf["b_x"].to_numpy(dtype=np.int16), pdf["b_y"].to_numpy(dtype=np.int16)
        if len(bx) <= skip:
            return pd.DataFrame([[*key, None, None]], columns=[*keys, "te", "pvalue"])
        y, past_y = by[skip:], _codes(by, lags_y, bins, skip)
        te, above = _te(y, past_y, _codes(bx, lags_x, bins, skip)), 0
        for i in range(runs):
            rng = np.random.default_rng([seed, i])
            if block > 1:
                starts = rng.integers(0, max(len(bx) - block + 1, 1), -(-len(bx) // block))
                index = (starts[:, None] + np.arange(block)).ravel()[: len(bx)] % len(bx)
            else:
                index = rng.permutation(len(bx))
            above += _te(y, past_y, _codes(bx[index], lags_x, bins, skip)) >= te
        return pd.DataFrame([[*key, te, (above + 1) / (runs + 1)]], columns=[*keys, "te", "pvalue"])

    return rows.groupBy(*keys).applyInPandas(run, schema)


def bh_fdr(pvalues: DataFrame, alpha: float = 0.05, column: str = "pvalue", keys: tuple[str, ...] = ("instrument",), name: str = "feature") -> DataFrame:
    """pvalues with significant, by the Benjamini-Hochberg step-up rule inside each key; NULL p-values do not count."""
    order = Window.partitionBy(*keys).orderBy(F.col(column).asc_nulls_last(), name)
    n = F.count(column).over(Window.partitionBy(*keys))
    rows = pvalues.withColumn("_rk", F.row_number().over(order)).withColumn("_ok", F.col(column) <= alpha * F.col("_rk") / n)
    top = F.max(F.when(F.col("_ok"), F.col("_rk"))).over(Window.partitionBy(*keys))
    return rows.withColumn("significant", F.coalesce((F.col("_rk") <= top) & F.col(column).isNotNull(), F.lit(False))).drop("_rk", "_ok")


def summary_table(*reports: DataFrame, on: tuple[str, ...] = KEYS) -> DataFrame:
    """Full outer join of reports by feature."""
    out = reports[0]
    for report in reports[1:]:
        out = out.join(report, list(on), "full_outer")
    return out


def rank_features(long: DataFrame, bins: int = 10, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ic, n, mi): Spearman IC beside histogram mutual information."""
    return ic(long, "spearman", keys).join(mi_hist(long, bins, keys=keys), list(keys), "full_outer")


def top_features(report: DataFrame, k: int, column: str = "ic") -> DataFrame:
    """The k features of each instrument with the greatest absolute value."""
    order = Window.partitionBy("instrument").orderBy(F.abs(column).desc_nulls_last(), "feature")
    return report.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mrmr(long: DataFrame, k: int, bins: int = 10) -> DataFrame:
    """(instrument, rank, feature, score): features picked one by one for relevance less mean redundancy.

    Both tables of mutual information are computed in Spark; the greedy choice runs over one row a pair of features.
    """
    relevance = mi_hist(long, bins).select("instrument", F.col("feature").alias("f1"), F.lit(None).cast("string").alias("f2"), "mi")
    pairs = pairwise_mi(long, bins).select("instrument", "f1", "f2", "mi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rel = pdf[pdf["f2"].isna()].set_index("f1")["mi"].sort_index()
        red = pdf[~pdf["f2"].isna()].set_index(["f1", "f2"])["mi"]
        chosen: list[tuple[str, float]] = []
        while len(chosen) < min(k, len(rel)):
            left = [f for f in rel.index if f not in {c for c, _ in chosen}]
            score = {f: rel[f] - (np.mean([red.get((f, c), 0.0) for c, _ in chosen]) if chosen else 0.0) for f in left}
            best = max(left, key=lambda f: score[f])
            chosen.append((best, float(score[best])))
        return pd.DataFrame({"instrument": pdf["instrument"].iloc[0], "rank": range(1, len(chosen) + 1), "feature": [c for c, _ in chosen], "score": [s for _, s in chosen]})

    return relevance.unionByName(pairs).groupBy("instrument").applyInPandas(run, "instrument string, rank int, feature string, score double")


def newey_west_lags(horizon: int, overlap: bool) -> int:
    return horizon if overlap else 0
