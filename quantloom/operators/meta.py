"""Meta-model: labels, purged splits, small linear models, calibration, thresholds and decision policies."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import sliding
from quantloom.functions.quantiles import with_quantiles
from quantloom.functions.windows import by_instrument, by_time
from quantloom.operators.features import forward_return
from quantloom.operators.meta_scan import calibration_by_buckets, fit_by_buckets, isotonic_by_ranges, pooled

CLIP = 1e-6


def sign_label(returns: str, horizon: int, null_tail: bool = True) -> Column:
    """1 if the forward return is above 0, 0 below, NULL at 0; the tail without a full horizon is NULL, or 0 if so asked."""
    f = forward_return(returns, horizon)
    label = F.when(f == 0, None).otherwise((f > 0).cast("int"))
    return F.when(f.isNull(), None if null_tail else 0).otherwise(label)


def meta_label(signal: str, returns: str, horizon: int, costs_bps: float = 0.0, null_tail: bool = True) -> Column:
    """1 if following the signal pays more than costs over the horizon; NULL without a signal."""
    f = forward_return(returns, horizon)
    side = F.signum(F.col(signal))
    pays = F.when(f.isNull(), None if null_tail else 0).otherwise((side * f - costs_bps / 1e4 > 0).cast("int"))
    return F.when(side.isNull() | (side == 0), None).otherwise(pays)


def quantile_label(panel: DataFrame, returns: str, horizon: int, q: float = 0.8, null_tail: bool = True) -> DataFrame:
    """panel with label: 1 where the forward return is at least its q quantile over the series."""
    out = with_quantiles(panel.withColumn("_f", forward_return(returns, horizon)), "_f", (q,), "_line")
    return out.withColumn("label", F.when(F.col("_f").isNull(), None if null_tail else 0).otherwise((F.col("_f") >= F.col("_line")[0]).cast("int"))).drop("_f", "_line")


def triple_barrier(panel: DataFrame, price: str, signal: str, horizon: int, up: float, down: float, chunk_rows: int = sliding.CHUNK_ROWS) -> DataFrame:
    """panel with hit (1: the upper barrier is met first, -1: the lower, else the sign of the last return) and label.

    The upper barrier is looked at first on each row; the horizon is cut at the end of the series; NULL prices are passed
    over; label is 1 if the hit is on the signal's side, NULL without a signal or a next row. A task holds a chunk of rows
    and the extremes of its spans, whatever the horizon.
    """
    keep = tuple(c for c in panel.columns if c not in ("hit", "label"))
    out = sliding.run_sliding(panel, [price], ["hit"], lambda p, first, last: sliding.first_touch(p, first, last, horizon, up, down), 0, horizon, keep, chunk_rows=chunk_rows)
    out, side = out.withColumn("hit", F.col("hit").cast("int")), F.signum(F.col(signal))
    return out.withColumn("label", F.when(side.isNull() | (side == 0) | F.col("hit").isNull(), None).otherwise((F.col("hit") * side > 0).cast("int")))


def numbered(panel: DataFrame) -> DataFrame:
    """panel with row, from 0, and n, the rows of the series."""
    return panel.withColumn("row", F.row_number().over(by_time()) - 1).withColumn("n", F.count("*").over(by_instrument()))


def purged_kfold(panel: DataFrame, folds: int, horizon: int = 1, purge: int = 0, embargo: int = 0) -> DataFrame:
    """(instrument, ts, row, fold, part): for each fold its test rows, and its train rows off the purge and the embargo.

    The first n mod folds test blocks have one row more. A row comes once a fold at most, so output is rows times folds.
    """
    rows = numbered(panel.select("instrument", "ts")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    base, extra = F.floor(F.col("n") / folds), F.col("n") % folds
    start = F.col("fold") * base + F.least("fold", extra)
    stop = start + base + (F.col("fold") < extra).cast("int")
    row = F.col("row")
    part = F.when((row >= start) & (row < stop), "test").when((row >= start - max(purge, horizon)) & (row < stop + max(embargo, horizon)), None).otherwise("train")
    return rows.withColumn("part", part).filter("part is not null").select("instrument", "ts", "row", "fold", "part")


combinatorial_purged_cv = purged_kfold


def walk_forward(panel: DataFrame, train: int, test: int, step: int | None = None, gap: int = 0) -> DataFrame:
    """(instrument, ts, row, fold, part): windows of ``train`` rows, a gap, then ``test`` rows, moved by ``step``."""
    step = step or test
    rows = numbered(panel.select("instrument", "ts"))
    span = train + gap + test
    last = F.floor((F.col("n") - span) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("row") - span + 1) / F.lit(step)))
    own = rows.filter((F.col("n") >= span) & (first <= F.least(F.floor(F.col("row") / step), last))).withColumn("fold", F.explode(F.sequence(first, F.least(F.floor(F.col("row") / step), last))))
    at = F.col("row") - F.col("fold") * step
    part = F.when(at < train, "train").when(at >= train + gap, "test")
    return own.withColumn("part", part).filter("part is not null").select("instrument", "ts", "row", F.col("fold").cast("int").alias("fold"), "part")


@dataclass(frozen=True)
class ModelConfig:
    kind: str = "logistic"
    c: float = 1.0
    rounds: int = 200
    rate: float = 0.1
    seed: int = 7

    def __post_init__(self):
        if self.kind not in ("logistic", "ridge"):
            raise NotImplementedError(f"no model {self.kind}")


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std > 0, std, 1.0)
    return (x - mean) / std, mean, std


def fit_logistic(x: np.ndarray, y: np.ndarray, cfg: ModelConfig) -> tuple[np.ndarray, float]:
    """Weights and intercept for standardised x by gradient steps with an L2 term of 1 / c."""
    w, b = np.random.default_rng(cfg.seed).normal(0, 0.01, x.shape[1]), 0.0
    for _ in range(cfg.rounds):
        gap = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        w, b = w - cfg.rate * (x.T @ gap / len(y) + w / max(cfg.c, CLIP)), b - cfg.rate * gap.mean()
    return w, float(b)


def fit_ridge(x: np.ndarray, y: np.ndarray, cfg: ModelConfig) -> tuple[np.ndarray, float]:
    """Ridge weights on the 0 and 1 target as it is; no intercept."""
    return np.linalg.solve(x.T @ x + np.eye(x.shape[1]) / cfg.c, x.T @ y), 0.0


def ridge_moments(panel: DataFrame, features: list[str], label: str, by: str = "instrument") -> DataFrame:
    """One row a series with everything a ridge fit needs: n, sums, products of features, and products with the label."""
    rows = panel.dropna(subset=[*features, label])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    return rows.groupBy(by).agg(
        F.count("*").alias("n"),
        F.sum(F.col(label)).alias("s_y"),
        *[F.sum(a).alias(f"s_{a}") for a in features],
        *[F.sum(F.col(a) * F.col(label)).alias(f"y_{a}") for a in features],
        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs],
    )


def fit_models(panel: DataFrame, features: list[str], label: str, cfg: ModelConfig = ModelConfig(), by: tuple[str, ...] = ("instrument",), calibration: str = "none", bucket_s: int | None = None) -> DataFrame:
    """(by, n, intercept, weights, means, stds, cal_x, cal_y): one fit for each key, side by side, and the calibration of its
    scores on the rows it was fitted on; fewer than two classes give no row. With ``bucket_s`` a task holds the rows of so
    many seconds of a key, without it a whole key; the results are the same."""
    if bucket_s and calibration == "isotonic":
        models = fit_by_buckets(panel, features, label, cfg, by, "none", bucket_s)
        rows = panel.select(*by, "ts", *features, label).dropna(subset=[*features, label])
        knots = isotonic_by_ranges(predict(rows, models, features, by).dropna(subset=["p_follow"]), "p_follow", label, list(by))
        return models.drop("cal_x", "cal_y").join(knots, list(by))
    if bucket_s:
        return fit_by_buckets(panel, features, label, cfg, by, calibration, bucket_s)
    features = sorted(features)
    schema = ", ".join([*(f"{c} {panel.schema[c].dataType.simpleString()}" for c in by), "n long, intercept double, weights array<double>, means array<double>, stds array<double>, cal_x array<double>, cal_y array<double>"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        x, mean, std = standardise(pdf[features].to_numpy(dtype=float))
        y = pdf[label].to_numpy(dtype=float)
        names = [*by, "n", "intercept", "weights", "means", "stds", "cal_x", "cal_y"]
        if len(np.unique(y)) < 2:
            return pd.DataFrame(columns=names)
        w, b = (fit_logistic if cfg.kind == "logistic" else fit_ridge)(x, y, cfg)
        cal = fit_calibration(1 / (1 + np.exp(-(x @ w + b))), y, calibration)
        return pd.DataFrame([[*key, len(y), b, w.tolist(), mean.tolist(), std.tolist(), *(c.tolist() for c in cal)]], columns=names)

    return panel.select(*by, "ts", *features, label).dropna(subset=[*features, label]).groupBy(*by).applyInPandas(run, schema)


def predict(panel: DataFrame, models: DataFrame, features: list[str], by: tuple[str, ...] = ("instrument",), calibration: str | None = None) -> DataFrame:
    """panel with p_follow, the sigmoid of the linear score, calibrated if a calibration is named; a feature that panel lacks
    counts as NULL, and so does p_follow."""
    features = sorted(features)
    x = F.array(*[F.col(c).cast("double") if c in panel.columns else F.lit(None).cast("double") for c in features])
    joined = panel.join(models.drop("n"), list(by), "left").withColumn("_x", x)
    terms = F.transform(F.arrays_zip(F.col("_x").alias("x"), F.col("weights").alias("w"), F.col("means").alias("m"), F.col("stds").alias("s")), lambda t: t["w"] * (t["x"] - t["m"]) / t["s"])
    score = F.aggregate(terms, F.col("intercept"), lambda s, t: s + t)
    out = joined.withColumn("p_follow", 1 / (1 + F.exp(-score)))
    if calibration:
        out = out.withColumn("p_follow", calibrated(F.col("p_follow"), F.col("cal_x"), F.col("cal_y"), calibration))
    return out.drop("_x", "weights", "means", "stds", "intercept", "cal_x", "cal_y")


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone least-squares fit by pooling adjacent violators."""
    order = np.argsort(scores, kind="stable")
    blocks = pooled([[v, 1.0, s, s] for s, v in zip(scores[order], y[order], strict=True)])
    return np.array([x for b in blocks for x in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


def fit_calibration(scores: np.ndarray, y: np.ndarray, kind: str, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of a calibration: knots and their values (isotonic), or weights and intercept (platt, beta) by gradient
    steps from zero, 200 on the score itself and 300 on the logarithms of it and of its complement."""
    if kind == "none":
        return np.empty(0), np.empty(0)
    if kind == "isotonic":
        return isotonic(scores, y)
    if kind not in ("platt", "beta"):
        raise ValueError("unknown calibration")
    p = np.clip(scores, CLIP, 1 - CLIP)
    x = scores[:, None] if kind == "platt" else np.stack([np.log(p), np.log(1 - p)], axis=1)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(200 if kind == "platt" else 300):
        gap = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - rate * x.T @ gap / len(y), b - rate * gap.mean()
    return w, np.array([b])


def calibrate_scores(scores: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """Calibrated probabilities of the scores by a calibration fitted on them: none (kept inside [1e-6, 1 - 1e-6]), platt, beta
    or isotonic."""
    w, v = fit_calibration(scores, y, kind)
    p = np.clip(scores, CLIP, 1 - CLIP)
    if kind == "isotonic":
        return np.interp(scores, w, v)
    if kind == "none":
        return p
    return 1 / (1 + np.exp(-(scores * w[0] + v[0] if kind == "platt" else np.log(p) * w[0] + np.log(1 - p) * w[1] + v[0])))


def calibrated(score: Column, x: Column, y: Column, kind: str) -> Column:
    """The calibration with parameters x and y, arrays as fit_calibration() gives them, of a score."""
    p = F.least(F.greatest(score, F.lit(CLIP)), F.lit(1 - CLIP))
    if kind == "none":
        return p
    if kind == "platt":
        return 1 / (1 + F.exp(-(score * x[0] + y[0])))
    if kind == "beta":
        return 1 / (1 + F.exp(-(F.log(p) * x[0] + F.log(1 - p) * x[1] + y[0])))
    if kind != "isotonic":
        raise ValueError("unknown calibration")
    k = F.size(F.filter(x, lambda v: v <= score))  # knots at or below the score
    at = lambda a, i: F.try_element_at(a, i)
    between = at(y, k) + (score - at(x, k)) / (at(x, k + 1) - at(x, k)) * (at(y, k + 1) - at(y, k))
    return F.when(score.isNull() | x.isNull(), None).when(k == 0, at(y, F.lit(1))).when(k == F.size(x), at(y, F.size(x))).otherwise(between)


def calibrate(panel: DataFrame, kind: str, score: str = "p_follow", label: str = "label", bucket_s: int | None = None) -> DataFrame:
    """(instrument, ts, score, label, p) with one calibration for each instrument, fitted on its labelled rows.

    An isotonic fit goes by ranges of the score, which lies in [0, 1]. With ``bucket_s`` the gradient steps of the others go
    by time buckets, without it a task holds an instrument; the results are the same.
    """
    rows = panel.select("instrument", "ts", F.col(score).cast("double"), F.col(label).cast("int")).dropna()
    if kind == "isotonic" or (bucket_s and kind in ("platt", "beta")):
        fits = isotonic_by_ranges(rows, score, label, ["instrument"]) if kind == "isotonic" else calibration_by_buckets(rows, kind, score, label, bucket_s)
        return rows.join(fits, "instrument").withColumn("p", calibrated(F.col(score), F.col("cal_x"), F.col("cal_y"), kind)).drop("cal_x", "cal_y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        return pdf.assign(p=calibrate_scores(pdf[score].to_numpy(dtype=float), pdf[label].to_numpy(dtype=float), kind))

    return rows.groupBy("instrument").applyInPandas(run, f"instrument string, ts timestamp_ntz, {score} double, {label} int, p double")


def brier_ece(panel: DataFrame, p: str = "p_follow", label: str = "label", bins: int = 10) -> DataFrame:
    """(instrument, brier, ece) over rows with both; bins of equal width, p = 1 in the last one."""
    rows = panel.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).withColumn("_b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    gap = F.col(label) - F.col(p)
    cells = rows.groupBy("instrument", "_b").agg(F.count("*").alias("_n"), F.avg(gap).alias("_g"), F.sum(gap * gap).alias("_s"))
    return cells.groupBy("instrument").agg((F.sum("_s") / F.sum("_n")).alias("brier"), (F.sum(F.abs("_g") * F.col("_n")) / F.sum("_n")).alias("ece"))


THRESHOLDS = tuple(round(0.10 + 0.05 * k, 2) for k in range(17))


def select_threshold(panel: DataFrame, p: str = "p_follow", pnl: str = "pnl") -> DataFrame:
    """(instrument, threshold, mean_pnl): the threshold whose followed rows earn most on average; ties go to the lower one, 0.5 if none is followed."""
    tried = panel.filter(F.col(p).isNotNull() & F.col(pnl).isNotNull()).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    means = tried.groupBy("instrument", "threshold").agg(F.avg(F.when(F.col(p) >= F.col("threshold"), F.col(pnl))).alias("mean_pnl"))
    best = means.groupBy("instrument").agg(F.max_by(F.struct("threshold", "mean_pnl"), F.when(F.col("mean_pnl").isNotNull(), F.struct("mean_pnl", (-F.col("threshold")).alias("t")))).alias("b"))
    return best.select("instrument", F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"), F.col("b.mean_pnl").alias("mean_pnl"))


def decide(panel: DataFrame, policy: str = "threshold", threshold: float | Column = 0.5, p: str = "p_follow", signal: str = "signal", max_size: float = 1.0, payoff: float = 1.0) -> DataFrame:
    """panel with action (the signal's side, 0: skip), size and edge by threshold, kelly_fraction or bayes_risk, also called utility.

    threshold: follows from the threshold on, and the size is the part of the way from there to 1. kelly_fraction: the size
    is the Kelly fraction for the payoff. bayes_risk: the size is the edge p - (1 - p), which the other policies leave
    NULL. Sizes stay in [0, 1] or [0, max_size]; a NULL chance has no size and action 0.
    """
    chance, bounded = F.col(p), lambda x, top: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(top), x)))
    edge = F.lit(None).cast("double")
    if policy == "threshold":
        line = F.lit(threshold) if isinstance(threshold, float) else threshold
        go, size = chance >= line, bounded((chance - line) / (1 - line), 1.0)
    elif policy == "kelly_fraction":
        kept = F.when(chance.isNotNull(), F.least(F.greatest(chance, F.lit(CLIP)), F.lit(1 - CLIP)))
        size = bounded((kept * payoff - (1 - kept)) / max(payoff, CLIP), max_size)
        go = size > 0
    elif policy in ("bayes_risk", "utility"):
        edge = chance - (1 - chance)
        go, size = edge > 0, bounded(edge, max_size)
    else:
        raise ValueError("unknown policy")
    action = F.when(F.coalesce(go, F.lit(False)), F.signum(signal)).otherwise(0.0)
    return panel.withColumn("edge", edge).withColumn("action", action).withColumn("size", size)


def fingerprint(config) -> str:
    """The first 16 hex digits of the sha256 of a config."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True, default=str).encode()).hexdigest()[:16]


def schema_fingerprint(columns: list[str]) -> str:
    """sha256 of the sorted column names."""
    return hashlib.sha256(",".join(sorted(columns)).encode()).hexdigest()


def out_of_sample(panel: DataFrame, features: list[str], label: str, folds: DataFrame, cfg: ModelConfig = ModelConfig(), calibration: str = "none") -> DataFrame:
    """(instrument, ts, fold, label, p_follow): each test row predicted, and calibrated, by its own fold's train rows."""
    joined = panel.join(folds.select("instrument", "ts", "fold", "part"), ["instrument", "ts"])
    models = fit_models(joined.filter("part = 'train'"), features, label, cfg, ("instrument", "fold"), calibration)
    tested = predict(joined.filter("part = 'test'"), models, features, ("instrument", "fold"), calibration)
    return tested.select("instrument", "ts", "fold", label, "p_follow")


