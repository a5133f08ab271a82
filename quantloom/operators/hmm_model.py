"""A Gaussian hidden Markov model of one series: its scans, its fit and its best path."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Least mass of a live state, and what is added to each count of steps.
LEAST_MASS, LEAST_STEP = 1e-6, 1e-12


@dataclass(frozen=True)
class HmmConfig:
    n_states: int = 2
    rounds: int = 100
    tolerance: float = 1e-4
    floor: float = 1e-6
    init: str = "quantile"
    seed: int = 7

    def __post_init__(self):
        if not 2 <= self.n_states <= 4 or self.init not in ("quantile", "kmeans"):
            raise ValueError("2 to 4 states, started by quantile or kmeans")


def products(m: np.ndarray) -> np.ndarray:
    """Running products m[0] m[1] ... m[t] of matrices (n, k, k), each up to a positive factor.

    A prefix scan: pairs are multiplied, their running products found in the same way, and the rest is one product each.
    """
    if len(m) == 1:
        return m
    scaled = lambda x: x / x.max(axis=(1, 2), keepdims=True)
    pairs = products(scaled(m[0 : len(m) - 1 : 2] @ m[1::2]))
    out = np.empty_like(m)
    out[0], out[1::2] = m[0], pairs
    out[2::2] = scaled(pairs[: len(m[2::2])] @ m[2::2])
    return out


def _rows(v: np.ndarray) -> np.ndarray:
    return v / v.sum(axis=1, keepdims=True)


def forward_from(now: np.ndarray, logs: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered probabilities, probabilities before each row is seen, and log likelihoods of rows; now holds before the first."""
    top = logs.max(axis=1)
    seen = np.exp(logs - top[:, None])
    ahead = np.concatenate([now[None], now @ products(seen[:-1, :, None] * step)] if len(logs) > 1 else [now[None]])
    ahead = _rows(ahead)
    joint = ahead * seen
    return _rows(joint), ahead, top + np.log(joint.sum(axis=1))


def backward_from(held: np.ndarray, follow: np.ndarray, logs: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Smoothed probabilities of rows from their filtered ones and the weights of what follows the last."""
    weights = np.empty_like(held)
    weights[-1] = follow
    if len(held) > 1:
        seen = np.exp(logs - logs.max(axis=1, keepdims=True))[:0:-1]
        after = follow @ products(np.swapaxes(step * seen[:, None, :], 1, 2))
        weights[:-1] = after[::-1]
    return _rows(held * weights / weights.max(axis=1, keepdims=True))


def operator_of(logs: np.ndarray, step: np.ndarray) -> np.ndarray:
    """What rows do to the probabilities before the first, up to a factor: row vector times this matrix."""
    seen = np.exp(logs - logs.max(axis=1, keepdims=True))
    return products(seen[:-1, :, None] * step)[-1] * seen[-1] if len(logs) > 1 else np.diag(seen[0])


def best_products(logs: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best score of a path through the rows by the state of the first row and of the last."""
    paths, step = np.where(np.eye(len(step), dtype=bool), logs[0], -np.inf), np.log(np.maximum(step, 1e-300))
    for row in logs[1:]:
        paths = (paths[:, :, None] + step[None]).max(axis=1) + row
    return paths


def best_path(entering: np.ndarray, logs: np.ndarray, step: np.ndarray, end: int | None = None) -> np.ndarray:
    """The best path through the rows, from the scores before the first row, to the state ``end`` if that is given."""
    step, best = np.log(np.maximum(step, 1e-300)), entering + logs[0]
    came = np.zeros(logs.shape, dtype=int)
    for i in range(1, len(logs)):
        paths = best[:, None] + step
        came[i] = paths.argmax(axis=0)
        best = paths.max(axis=0) + logs[i]
    out = np.empty(len(logs), dtype=int)
    out[-1] = best.argmax() if end is None else end
    for i in range(len(logs) - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    step: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Log densities of rows (n, d) under each state (n, k)."""
        z = (x - self.centre) / self.scale
        gap = z[:, None, :] - self.means[None]
        return -0.5 * ((gap**2 / self.variances).sum(axis=2) + np.log(2 * math.pi * self.variances).sum(axis=1))

    def forward(self, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filtered probabilities and the log likelihood of each row given those before."""
        held, _, gain = forward_from(self.start, logs, self.step)
        return held, gain

    def smooth(self, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Smoothed probabilities, expected steps between states, log likelihood."""
        held, ahead, gain = forward_from(self.start, logs, self.step)
        back = backward_from(held, np.ones(len(self.start)), logs, self.step)
        ratio = back / np.maximum(ahead, 1e-300)
        return back, self.step * (held[:-1].T @ ratio[1:]), float(gain.sum())

    def viterbi(self, logs: np.ndarray) -> np.ndarray:
        return best_path(np.log(np.maximum(self.start, 1e-300)), logs, self.step)

    def ordered(self) -> Hmm:
        """The states by ascending first mean."""
        order = np.argsort(self.means[:, 0], kind="stable")
        return Hmm(self.start[order], self.step[np.ix_(order, order)], self.means[order], self.variances[order], self.centre, self.scale)


def fit_hmm(x: np.ndarray, cfg: HmmConfig) -> Hmm:
    """Diagonal Gaussian hidden Markov model of rows (n, d) by expectation-maximisation; states by ascending first mean."""
    n, k = len(x), cfg.n_states
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - centre) / scale
    if cfg.init == "quantile":
        near = np.searchsorted(np.quantile(z[:, 0], np.linspace(0, 1, k + 1)[1:-1]), z[:, 0], "right")
        means = np.stack([z[near == j].mean(axis=0) if (near == j).any() else z.mean(axis=0) for j in range(k)])
    else:
        means = z[np.random.default_rng(cfg.seed).choice(n, k, replace=False)]
        for _ in range(10):
            near = ((z[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
            means = np.stack([z[near == j].mean(axis=0) if (near == j).any() else means[j] for j in range(k)])
    variances = np.stack([z[near == j].var(axis=0) if (near == j).any() else z.var(axis=0) for j in range(k)])
    model = Hmm(np.full(k, 1 / k), np.full((k, k), 1 / k), means, np.maximum(variances, cfg.floor), centre, scale)
    was = -math.inf
    for _ in range(cfg.rounds):
        weight, counts, gain = model.smooth(model.densities(x))
        mass = weight.sum(axis=0)
        dead, safe = mass < LEAST_MASS, np.maximum(mass, LEAST_MASS)
        means = weight.T @ z / safe[:, None]
        spread = np.stack([(weight[:, j, None] * (z - means[j]) ** 2).sum(axis=0) / safe[j] for j in range(k)])
        means[dead], spread[dead] = z.mean(axis=0), z.var(axis=0)  # a state that holds nothing starts again from all rows
        start, step = np.maximum(weight[0], LEAST_STEP), counts + LEAST_STEP
        model = Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), means, np.maximum(spread, cfg.floor), centre, scale)
        if abs(gain - was) < cfg.tolerance:
            break
        was = gain
    return model.ordered()
