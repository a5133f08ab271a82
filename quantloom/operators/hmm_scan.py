"""Hidden Markov models of series that no task can hold.

A series is cut into time buckets, packed one row each. What a bucket does to the probabilities of the states is one
k x k matrix: the product of its rows' operators. Matrices of the buckets are handed through forwards, for what enters
each bucket, and backwards, for what comes after it; the same matrix serves both ways. Each bucket then knows its
smoothed probabilities, and what a round of expectation-maximisation needs are sums over buckets. The best path goes the
same way, with sums of logarithms and maxima in place of products and sums.

A round is one of functions.rounds. Starting values come from exact distributed quantiles.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.quantiles import order_statistics
from quantloom.functions.rounds import Messages, pack
from quantloom.operators.hmm_model import LEAST_MASS, LEAST_STEP, Hmm, HmmConfig, backward_from, best_products, best_path, forward_from, operator_of

def _begin(chunks: DataFrame, values: DataFrame, cfg: HmmConfig) -> DataFrame:
    """The first messages, with the order statistics of the first feature that the starting states are cut at."""
    shares = tuple(np.linspace(0, 1, cfg.n_states + 1)[1:-1].tolist())
    cuts = order_statistics(values, ["instrument"], "_x", shares)
    cuts = cuts.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("share_no", "position", "low", "high"))).alias("cuts"))
    kind = chunks.schema["instrument"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [[] if c is None else [(float(s["position"]), float(s["low"]), float(s["high"])) for s in c] for c in pdf["cuts"]]
            yield pdf[["instrument", "_bucket"]].assign(note=[pickle.dumps(({"cuts": c}, None)) for c in found])

    keys = chunks.select("instrument", "_bucket").join(cuts, "instrument", "left")
    return keys.mapInPandas(run, f"instrument {kind}, _bucket long, note binary")


def _scaled(known: dict, x: np.ndarray) -> np.ndarray:
    return (x - known["centre"]) / known["scale"]


def _near(known: dict, z: np.ndarray) -> np.ndarray:
    """The starting state of each row: by cuts of the first feature, or by the nearest of means."""
    if "edges" in known:
        return np.searchsorted(known["edges"], z[:, 0], "right")
    return ((z[:, None] - known["nearest"][None]) ** 2).sum(axis=2).argmin(axis=1)


def _starting(cfg: HmmConfig) -> list[tuple[Callable, Callable]]:
    """The rounds before the first model: mean, deviation, and means and variances of the starting states."""
    k = cfg.n_states
    told = lambda sums: [None] * len(sums)

    def to_mean(known: dict, sums: list) -> tuple[dict, list]:
        counts = [s[0] for s in sums]
        n = sum(counts)
        if n < 10 * k:
            return {"done": True, "model": None}, told(sums)
        chosen = np.random.default_rng(cfg.seed).choice(n, k, replace=False) if cfg.init == "kmeans" else None
        before = np.concatenate(([0], np.cumsum(counts)[:-1])).tolist()
        return known | {"n": n, "centre": sum(s[1] for s in sums) / n, "chosen": chosen}, before

    def spreads(known: dict, before: int, x: np.ndarray):
        chosen = [] if known["chosen"] is None else [(j, x[i - before]) for j, i in enumerate(known["chosen"].tolist()) if before <= i < before + len(x)]
        return ((x - known["centre"]) ** 2).sum(axis=0), chosen

    def to_scale(known: dict, sums: list) -> tuple[dict, list]:
        scale = np.sqrt(sum(s[0] for s in sums) / known["n"])
        flat = scale == 0
        known = known | {"scale": np.where(flat, 1.0, scale), "whole": np.where(flat, 0.0, 1.0)}
        if cfg.init == "kmeans":
            rows = dict(c for s in sums for c in s[1])
            means = _scaled(known, np.stack([rows[j] for j in range(k)]))
            return known | {"nearest": means, "means": means}, told(sums)
        edges = []
        for position, low, high in known["cuts"]:
            a, b = ((v - known["centre"][0]) / known["scale"][0] for v in (low, high))
            t = position - math.floor(position)
            edges.append(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t))
        return known | {"edges": np.array(edges), "means": np.zeros((k, len(scale)))}, told(sums)

    def state_sums(known: dict, own, x: np.ndarray):
        z = _scaled(known, x)
        near = _near(known, z)
        return np.array([(near == j).sum() for j in range(k)]), np.stack([z[near == j].sum(axis=0) for j in range(k)])

    def to_means(known: dict, sums: list) -> tuple[dict, list]:
        counts, totals = sum(s[0] for s in sums), sum(s[1] for s in sums)
        return known | {"counts": counts, "means": np.where(counts[:, None] > 0, totals / np.maximum(counts, 1)[:, None], known["means"])}, told(sums)

    def to_nearest(known: dict, sums: list) -> tuple[dict, list]:
        known, out = to_means(known, sums)
        return known | {"nearest": known["means"]}, out

    def state_spreads(known: dict, own, x: np.ndarray):
        z = _scaled(known, x)
        near = _near(known, z)
        return np.stack([((z[near == j] - known["means"][j]) ** 2).sum(axis=0) for j in range(k)])

    def to_model(known: dict, sums: list) -> tuple[dict, list]:
        counts = known["counts"][:, None]
        spread = np.where(counts > 0, sum(sums) / np.maximum(counts, 1), known["whole"])
        model = Hmm(np.full(k, 1 / k), np.full((k, k), 1 / k), known["means"], np.maximum(spread, cfg.floor), known["centre"], known["scale"])
        return {"whole": known["whole"], "model": model, "was": -math.inf, "rounds": 0}, told(sums)

    lloyd = [(state_sums, to_nearest)] * 9 if cfg.init == "kmeans" else []
    return [(lambda known, own, x: (len(x), x.sum(axis=0)), to_mean), (spreads, to_scale), *lloyd, (state_sums, to_means), (state_spreads, to_model)]


def _operator(known: dict, own, x: np.ndarray):
    model = known["model"]
    return operator_of(model.densities(x), model.step) if model is not None and len(x) else None


def _hand_on(known: dict, operators: list) -> tuple[dict, list]:
    """What enters each bucket, (the probabilities before it, or None, and the weights of what follows it)."""
    model, held, before, after = known["model"], None, [], []
    if model is None:
        return known, [None] * len(operators)
    for m in operators:
        before.append(held)
        if m is not None:
            joint = (model.start if held is None else held @ model.step) @ m
            held = joint / joint.sum()
    follow = np.ones(len(model.start))
    for m in reversed(operators):
        after.append(follow)
        if m is not None:
            follow = model.step @ (m @ follow)
            follow = follow / follow.max()
    return known, list(zip(before, reversed(after), strict=True))


def _expect(known: dict, own, x: np.ndarray):
    """The sums of a round over one bucket: (first weights, steps, mass, sums, spreads about the old means, likelihood)."""
    if not len(x):
        return None
    model, (before, follow) = known["model"], own
    logs = model.densities(x)
    held, ahead, gain = forward_from(model.start if before is None else before @ model.step, logs, model.step)
    weight = backward_from(held, follow, logs, model.step)
    ratio = weight / np.maximum(ahead, 1e-300)
    earlier = np.concatenate([held[:0] if before is None else before[None], held[:-1]])
    counts = model.step * (earlier.T @ ratio[len(ratio) - len(earlier) :])
    z = (x - model.centre) / model.scale
    gaps = (z[:, None, :] - model.means[None]) ** 2
    return weight[0] if before is None else None, counts, weight.sum(axis=0), weight.T @ z, (weight[:, :, None] * gaps).sum(axis=0), float(gain.sum())


def _maximise(cfg: HmmConfig) -> Callable:
    def draw(known: dict, sums: list) -> tuple[dict, list]:
        found = [s for s in sums if s is not None]
        first = next(s[0] for s in found if s[0] is not None)
        counts, mass, totals, spreads = (sum(s[i] for s in found) for i in range(1, 5))
        gain, old = sum(s[5] for s in found), known["model"]
        dead, safe = mass < LEAST_MASS, np.maximum(mass, LEAST_MASS)
        means = totals / safe[:, None]
        spread = spreads / safe[:, None] - (means - old.means) ** 2
        means[dead], spread[dead] = 0.0, known["whole"]
        start, step = np.maximum(first, LEAST_STEP), counts + LEAST_STEP
        model = Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), means, np.maximum(spread, cfg.floor), old.centre, old.scale)
        rounds = known["rounds"] + 1
        done = abs(gain - known["was"]) < cfg.tolerance or rounds >= cfg.rounds
        return known | {"model": model, "was": gain, "rounds": rounds, "done": done}, [None] * len(sums)

    return draw


def _enter_paths(known: dict, operators: list) -> tuple[dict, list]:
    """For each bucket the best scores before its first row and the state that the best path leaves it in."""
    model, own = known["model"], []
    if model is None:
        return known, [None] * len(operators)
    step, best, states = np.log(np.maximum(model.step, 1e-300)), None, []
    for m in operators:
        entering = np.log(np.maximum(model.start, 1e-300)) if best is None else (best[:, None] + step).max(axis=0)
        own.append([best, entering, None])
        best = (entering[:, None] + m).max(axis=0)
    end = int(best.argmax())
    for (before, entering, _), m, place in zip(reversed(own), reversed(operators), range(len(own) - 1, -1, -1), strict=True):
        own[place][2] = end
        first = int((entering + m[:, end]).argmax())
        if before is not None:
            end = int((before + step[:, first]).argmax())
    return known, [(entering, end) for _, entering, end in own]


def _path_operator(known: dict, own, x: np.ndarray):
    return best_products(known["model"].densities(x), known["model"].step) if known["model"] is not None else None


def _ordered(answer: Callable) -> Callable:
    """The same answer of a series whose states are put in order first."""

    def run(known: dict, own, x: np.ndarray):
        return answer(known if known["model"] is None else known | {"model": known["model"].ordered()}, own, x)

    return run


def _label(talk: Messages, cfg: HmmConfig, mode: str) -> DataFrame:
    """The rows of each bucket from what enters it."""
    k, d = cfg.n_states, talk.d

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, x, at, told in zip(pdf["instrument"], pdf["x"], pdf["at"], pdf["note"], strict=True):
                known, own = pickle.loads(told)
                if known["model"] is None:
                    continue
                model, x = known["model"].ordered(), np.frombuffer(x).reshape(-1, d)
                logs = model.densities(x)
                if mode == "viterbi":
                    state = best_path(own[0], logs, model.step, own[1])
                    p = np.eye(k)[state]
                else:
                    before, follow = own
                    p = forward_from(model.start if before is None else before @ model.step, logs, model.step)[0]
                    p = backward_from(p, follow, logs, model.step) if mode == "smooth" else p
                    state = p.argmax(axis=1)
                times = np.frombuffer(at, dtype=np.int64).view("datetime64[us]")
                yield pd.DataFrame({"instrument": name, "ts": times, "state": state.astype(np.int32)} | {f"p_state_{j}": p[:, j] for j in range(k)})

    schema = f"instrument {talk.kind}, ts timestamp_ntz, state int, " + ", ".join(f"p_state_{j} double" for j in range(k))
    return talk.met(["x", "at"]).mapInPandas(run, schema)


def scan_hmm(panel: DataFrame, columns: list[str], cfg: HmmConfig, mode: str, calibrate: str | None, bucket_s: int) -> DataFrame:
    """(instrument, ts, state, p_state_k) as regimes.hmm gives them, bucket by bucket."""
    chunks = pack(panel, columns, calibrate, bucket_s)
    fitted = panel.filter(F.coalesce(F.col(calibrate).cast("boolean"), F.lit(False))) if calibrate else panel
    values = fitted.dropna(subset=columns).select("instrument", F.col(columns[0]).cast("double").alias("_x"))
    talk = Messages(chunks, _begin(chunks, values, cfg), len(columns))
    talk.write()
    for answer, draw in _starting(cfg):
        talk.round(answer, draw)
    talk.write()
    for _ in range(cfg.rounds):
        talk.round(_operator, _hand_on)
        talk.round(_expect, _maximise(cfg))
        if talk.since == 0 and talk.all_done():
            break
    answer, draw = (_path_operator, _enter_paths) if mode == "viterbi" else (_operator, _hand_on)
    talk.round(_ordered(answer), lambda known, sums: draw(known if known["model"] is None else known | {"model": known["model"].ordered()}, sums), last=True)
    talk.write()
    return _label(talk, cfg, mode)
