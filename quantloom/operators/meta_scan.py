"""Model fits and calibrations over keys that no task can hold.

Gradients, moments and products of features are sums over rows: each time bucket of a key gives its part, and the parts
are added up (functions.rounds). All keys take their steps side by side. Isotonic regression goes by ranges of the score:
pooling is associative, so each range pools its own violators, and the blocks of the ranges are pooled in turn.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.rounds import Messages, pack

MARK = "\u0001"
#: Ranges of a score that are pooled apart, and scores are kept this far from 0 and 1 in logarithms.
RANGES, CLIP = 1024, 1e-6


def sigmoid(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-score))


def _quiet(sums: list) -> list:
    return [None] * len(sums)


def _moments(rows: Messages) -> None:
    """Mean and deviation of the features, the last column being the label; keys with fewer than two classes end."""

    def count(known: dict, own, x: np.ndarray):
        return len(x), x[:, :-1].sum(axis=0), set(x[:, -1].tolist())

    def to_mean(known: dict, sums: list) -> tuple[dict, list]:
        n, classes = sum(s[0] for s in sums), set().union(*(s[2] for s in sums))
        return known | {"n": n, "mean": sum(s[1] for s in sums) / n, "done": len(classes) < 2, "few": len(classes) < 2}, _quiet(sums)

    def to_std(known: dict, sums: list) -> tuple[dict, list]:
        std = np.sqrt(sum(sums) / known["n"])
        return known | {"std": np.where(std > 0, std, 1.0)}, _quiet(sums)

    rows.round(count, to_mean)
    rows.round(lambda known, own, x: ((x[:, :-1] - known["mean"]) ** 2).sum(axis=0), to_std)


def _descend(rows: Messages, design: Callable[[dict, np.ndarray], np.ndarray], start: Callable[[int], np.ndarray], rounds: int, rate: float, penalty: float, name: str, limit: float | None) -> None:
    """Logistic gradient steps; known[name] becomes (weights, intercept)."""

    def gradient(known: dict, own, x: np.ndarray):
        z, y = design(known, x), x[:, -1]
        w, b = known.get(name) or (start(z.shape[1]), 0.0)
        score = z @ w + b
        gap = sigmoid(score if limit is None else np.clip(score, -limit, limit)) - y
        return z.T @ gap, gap.sum()

    def step(known: dict, sums: list) -> tuple[dict, list]:
        slope, level = sum(s[0] for s in sums), sum(s[1] for s in sums)
        w, b = known.get(name) or (start(len(slope)), 0.0)
        return known | {name: (w - rate * (slope / known["n"] + w * penalty), b - rate * level / known["n"])}, _quiet(sums)

    for _ in range(rounds):
        rows.round(gradient, step)


def scaled(known: dict, x: np.ndarray) -> np.ndarray:
    return (x[:, :-1] - known["mean"]) / known["std"]


def _ridge(rows: Messages, c: float) -> None:
    def products(known: dict, own, x: np.ndarray):
        z = scaled(known, x)
        return z.T @ z, z.T @ x[:, -1]

    def solve(known: dict, sums: list) -> tuple[dict, list]:
        a, b = (sum(s[i] for s in sums) for i in (0, 1))
        return known | {"model": (np.linalg.solve(a + np.eye(len(b)) / c, b), 0.0)}, _quiet(sums)

    rows.round(products, solve)


def _score(known: dict, x: np.ndarray) -> np.ndarray:
    w, b = known["model"]
    return sigmoid(scaled(known, x) @ w + b)


def calibration_design(kind: str, p: np.ndarray) -> np.ndarray:
    held = np.clip(p, CLIP, 1 - CLIP)
    return p[:, None] if kind == "platt" else np.stack([np.log(held), np.log(1 - held)], axis=1)


def _talk(panel: DataFrame, columns: list[str], by: tuple[str, ...], bucket_s: int) -> Messages:
    """Messages about the rows of each key, their columns packed in order."""
    one = panel.select(F.concat_ws(MARK, *[F.col(c).cast("string") for c in by]).alias("instrument"), "ts", *columns)
    chunks = pack(one, columns, None, bucket_s)
    first = pickle.dumps(({}, None))
    told = chunks.select("instrument", "_bucket", F.lit(bytearray(first)).alias("note"), F.lit(False).alias("done"))
    return Messages(chunks, told, len(columns))


def fit_by_buckets(panel: DataFrame, features: list[str], label: str, cfg, by: tuple[str, ...], calibration: str, bucket_s: int) -> DataFrame:
    """The rows of meta.fit_models, by time buckets of each key; calibrations are none, platt or beta."""
    features = sorted(features)
    rows = _talk(panel, [*features, label], by, bucket_s)
    _moments(rows)
    if cfg.kind == "logistic":
        _descend(rows, scaled, lambda d: np.random.default_rng(cfg.seed).normal(0, 0.01, d), cfg.rounds, cfg.rate, 1 / max(cfg.c, CLIP), "model", 30.0)
    else:
        _ridge(rows, cfg.c)
    if calibration in ("platt", "beta"):
        _descend(rows, lambda known, x: calibration_design(calibration, _score(known, x)), np.zeros, 200 if calibration == "platt" else 300, 0.1, 0.0, "calibration", None)
    elif calibration != "none":
        raise ValueError("this calibration is no descent")
    rows.write()
    fields = ", ".join(f"{c} {panel.schema[c].dataType.simpleString()}" for c in by)
    schema = "instrument string, n long, intercept double, weights array<double>, means array<double>, stds array<double>, cal_x array<double>, cal_y array<double>"

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for key, note in zip(pdf["instrument"], pdf["note"], strict=True):
                known = pickle.loads(note)[0]
                if not known["few"]:
                    w, b = known["model"]
                    x, y = (known["calibration"][0], [known["calibration"][1]]) if "calibration" in known else ([], [])
                    out.append([key, known["n"], float(b), *(list(map(float, v)) for v in (w, known["mean"], known["std"], x, y))])
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    one = rows.told.groupBy("instrument").agg(F.min_by("note", "_bucket").alias("note"))
    parts = F.split("instrument", MARK)
    keys = [parts[i].cast(f.split()[1]).alias(f.split()[0]) for i, f in enumerate(fields.split(", "))]
    return one.mapInPandas(emit, schema).select(*keys, *[f.split()[0] for f in schema.split(", ")][1:])


def pooled(blocks: list[list[float]]) -> list[list[float]]:
    """Blocks (mean, rows, least score, greatest score) by rising score, with neighbours that do not rise pooled."""
    out: list[list[float]] = []
    for block in blocks:
        out.append(block)
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            v2, n2, _, high = out.pop()
            v1, n1, low, _ = out.pop()
            out.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, low, high])
    return out


def isotonic_by_ranges(rows: DataFrame, score: str, label: str, by: list[str], ranges: int = RANGES) -> DataFrame:
    """(by, cal_x, cal_y): the knots of the isotonic fit of each key; rows have scores in [0, 1], labels and ts, no NULLs."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in by}
    held = rows.select(*by, "ts", F.col(score).alias("_s"), F.col(label).cast("double").alias("_y")).withColumn("_range", F.least(F.floor(F.col("_s") * ranges), F.lit(ranges - 1)))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "ts"], kind="stable")
        blocks = pooled([[y, 1.0, s, s] for s, y in zip(pdf["_s"].tolist(), pdf["_y"].tolist(), strict=True)])
        return pdf.iloc[:1][[*by, "_range"]].assign(note=[pickle.dumps(blocks)])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = pooled([b for note in pdf.sort_values("_range")["note"] for b in pickle.loads(note)])
        return pdf.iloc[:1][by].assign(cal_x=[[v for b in blocks for v in (b[2], b[3])]], cal_y=[[b[0] for b in blocks for _ in (0, 1)]])

    keys = ", ".join(f"{c} {k}" for c, k in kind.items())
    parts = held.groupBy(*by, "_range").applyInPandas(own, f"{keys}, _range long, note binary")
    return parts.groupBy(*by).applyInPandas(merge, f"{keys}, cal_x array<double>, cal_y array<double>")


def calibration_by_buckets(rows: DataFrame, kind: str, score: str, label: str, bucket_s: int, rounds: int | None = None) -> DataFrame:
    """(instrument, cal_x, cal_y) of a Platt or beta calibration, as meta.fit_calibration gives them."""
    talk = _talk(rows, [score, label], ("instrument",), bucket_s)
    talk.round(lambda known, own, x: len(x), lambda known, sums: (known | {"n": sum(sums)}, _quiet(sums)))
    _descend(talk, lambda known, x: calibration_design(kind, x[:, 0]), np.zeros, rounds or (200 if kind == "platt" else 300), 0.1, 0.0, "calibration", None)
    talk.write()

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [pickle.loads(n)[0]["calibration"] for n in pdf["note"]]
            yield pdf[["instrument"]].assign(cal_x=[w.tolist() for w, _ in found], cal_y=[[float(b)] for _, b in found])

    one = talk.told.groupBy("instrument").agg(F.min_by("note", "_bucket").alias("note"))
    return one.mapInPandas(emit, "instrument string, cal_x array<double>, cal_y array<double>")
