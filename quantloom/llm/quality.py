"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each whole text are computed once. Shallow trees, grown on resampled labelled rows, give the rules: every
path from a root to a node is a conjunction of comparisons of statistics with constants. A logistic model with a lasso
penalty weighs the rules, most of which get no weight. The remaining ones are compiled into one Spark column
expression over the statistics, so scoring is a projection.

The fit uses at most ``SAMPLE`` labelled rows, those with the least hash of their id, whatever the input; scoring covers
every row. Labels are taken from rows whose crc32(doc_id) mod 5 is not 0, and neither labels nor doc_id, lang or source
enter a score.

Defined cases: NULL texts count as empty, whose statistics are all 0; they are scored like any other. Without labelled
rows every score is 0.5; if all labels agree, every score is (n1 + 1) / (n + 2). Rows with a NULL label are not used; a
doc_id labelled twice counts once, with the lower label and its least text. Repeated rows are each scored. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.base import fold, hash_grams, hash_words, map_texts, read_table, whole_rows

SAMPLE = 12_000
TREES, DEPTH, LEAST_ROWS, BINS = 30, 3, 20, 32
PENALTY, ROUNDS = 0.001, 250
THRESHOLD = 0.3

#: Bytes by kind.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:",
    "bang": b"!?",
    "pipe": b"|<>{}[]\\",
    "symbol": b"#$%&*+=@^_~`/",
    "line": b"\n",
    "wide": bytes(range(128, 256)),
}
#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it that was for on are with as be by this from or an not der die und das den von zu mit ist "
    "im dem ein eine des auf nicht de la le et les des en un une du que est pour dans par sur au el los las y del se por con para al lo no"
).split()

STATS = ("words", "length", *KINDS, "distinct", "top", "repeat", "grams", "common", "lines")


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of STATS for each text; shares are of bytes or of words, counts are logarithms."""
    table = np.zeros((256, len(KINDS)))
    for k, members in enumerate(KINDS.values()):
        table[list(members), k] = 1
    size = np.array([len(t) for t in texts], dtype=np.float64)
    seen = np.array([np.bincount(np.frombuffer(t, dtype=np.uint8), minlength=256) for t in texts])
    words, counts = hash_words(texts)
    grams, owner = hash_grams(words, counts, 5)
    stop, _ = hash_words([" ".join(STOP_WORDS).encode()])
    ends, gram_ends = np.cumsum(counts), np.cumsum(np.bincount(owner, minlength=len(texts)))
    out = np.zeros((len(texts), len(STATS)))
    out[:, 0] = np.log1p(counts)
    out[:, 1] = size / np.maximum(counts, 1)
    out[:, 2 : 2 + len(KINDS)] = seen @ table / np.maximum(size, 1)[:, None]
    common = np.isin(words, stop)
    for i, n in enumerate(counts.tolist()):
        if not n:
            continue
        own = words[ends[i] - n : ends[i]]
        each = np.unique(own, return_counts=True)[1]
        part = grams[(gram_ends[i - 1] if i else 0) : gram_ends[i]]
        rows = texts[i].split(b"\n")
        out[i, 2 + len(KINDS) :] = (
            len(each) / n,
            each.max() / n,
            float((own[1:] == own[:-1]).sum()) / n,
            len(np.unique(part)) / len(part) if len(part) else 1.0,
            common[ends[i] - n : ends[i]].mean(),
            len(set(rows)) / len(rows),
        )
    return out


def with_statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """map_texts() with STATS of each text, as s_<name>."""
    return map_texts(docs, lambda texts: [pa.array(c) for c in statistics(texts).T.copy()], [(f"s_{c}", T.DoubleType()) for c in STATS], whole)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, value): statistic > value, or statistic <= value if not above."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, value in self.terms:
            out &= (x[:, k] > value) == above
        return out

    def column(self) -> Column:
        out = None
        for k, above, value in self.terms:
            term = F.col(f"s_{STATS[k]}") > value if above else F.col(f"s_{STATS[k]}") <= value
            out = term if out is None else out & term
        return out.cast("double")


@dataclass(frozen=True)
class Rules:
    intercept: float
    weighted: tuple[tuple[float, Rule], ...]

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for weight, rule in self.weighted:
            total = total + weight * rule.column()
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator) -> Iterator[Rule]:
    """The node paths of one tree grown on a resample, with a random half of the statistics at each node."""
    stack = [(np.unique(rng.integers(0, len(y), len(y))), ())]
    while stack:
        rows, terms = stack.pop()
        if terms:
            yield Rule(terms)
        p = y[rows].mean()
        if len(terms) == DEPTH or len(rows) < 2 * LEAST_ROWS or p in (0.0, 1.0):
            continue
        best = None
        for k in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2].tolist():
            if not len(cuts[k]):
                continue
            slot = np.searchsorted(cuts[k], x[rows, k])
            n = np.bincount(slot, minlength=len(cuts[k]) + 1).cumsum()[:-1]
            ones = np.bincount(slot, weights=y[rows], minlength=len(cuts[k]) + 1).cumsum()[:-1]
            m = len(rows) - n
            ok = (n >= LEAST_ROWS) & (m >= LEAST_ROWS)
            if ok.any():
                gain = np.where(ok, ones**2 / np.maximum(n, 1) + (p * len(rows) - ones) ** 2 / np.maximum(m, 1), -1)
                at = int(gain.argmax())
                if best is None or gain[at] > best[0]:
                    best = gain[at], k, float(cuts[k][at])
        if best is None or best[0] <= p * p * len(rows) + 1e-9:
            continue
        _, k, value = best
        above = x[rows, k] > value
        stack += [(rows[above], (*terms, (k, True, value))), (rows[~above], (*terms, (k, False, value)))]


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss + penalty * sum |w|, by accelerated proximal steps."""
    z = np.hstack([np.ones((len(z), 1)), z])
    gram = z.T @ z / len(z)
    u = np.ones(len(gram))
    for _ in range(50):  # power iteration for the largest eigenvalue, which bounds the curvature
        u = gram @ (u / np.linalg.norm(u))
    step = 4 / max(1.02 * float(np.linalg.norm(u)), 1e-12)
    w = np.zeros(z.shape[1])
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        grad = z.T @ (1 / (1 + np.exp(-np.clip(z @ v, -30, 30))) - y) / len(y)
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / after * (new - w), new, after
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules and weights for labels y (0 or 1) of statistics x."""
    if not len(y):
        return Rules(0.0, ())
    p = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return Rules(float(np.log(p / (1 - p))), ())
    rng = np.random.default_rng(7)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, np.quantile(x[y == 0, k], np.linspace(0, 1, BINS + 1)[1:-1])])) for k, c in enumerate(cuts)]
    rules: dict[bytes, Rule] = {}
    for _ in range(TREES):
        for rule in _paths(x, y, cuts, rng):
            rules.setdefault(np.packbits(rule.holds(x)).tobytes(), rule)
    kept = list(rules.values())
    z = np.stack([r.holds(x) for r in kept], axis=1).astype(np.float64) if kept else np.zeros((len(y), 0))
    intercept, w = lasso_logistic(z, y, PENALTY, ROUNDS)
    return Rules(intercept, tuple((float(w[k]), kept[k]) for k in np.flatnonzero(np.abs(w) > 1e-6)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    """(doc_id, label, text) of at most SAMPLE labelled documents outside the held-out fold, those of least hash of id.

    Of unlike texts that share a doc_id the least one counts.
    """
    own = labels.select("doc_id", F.col(label).alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", parts) != held))
    least = own.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(least), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Rules:
    sample = labelled_sample(docs, labels, "quality", 5, 0)
    stats = with_statistics(sample, whole=True).select("_keep.doc_id", F.col("_keep.label").cast("double").alias("label"), *[f"s_{c}" for c in STATS])
    rows = stats.toPandas().sort_values("doc_id")  # SAMPLE rows at most
    return fit_rules(rows[[f"s_{c}" for c in STATS]].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float))


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    doc_id = F.col("_keep.doc_id")
    out = with_statistics(docs).select(doc_id.alias("doc_id"), (fold(doc_id, 5) == 0).alias("held_out"), rules.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of docs that are predicted to be good, unchanged."""
    return with_statistics(docs, whole=True).filter(rules.column() >= THRESHOLD).select(*whole_rows(docs, docs.columns))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return score(docs, fit(docs, read_table(spark, folder, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_quality": op2_quality}
