"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier.

1. Of near-copies among the labelled documents one is kept. Terms, words and word beginnings of three to seven letters, are
   counted over labelled documents in Spark; those that are much commoner in toxic than in clean documents become voters:
   the strongest terms each by itself, the others in lexicons of words and groups of patterns. A voter fires on a document
   that holds one of its terms.
2. In the label model each voter fires with one probability on toxic and another on clean documents, and that none
   fires is a voter of its own. Expectation-maximisation estimates these rates and the share of toxic documents, starting
   from the labelled rates. The correlations of voters inside each class are estimated as well, and a vote counts for one
   over the number of votes on the same document that it repeats.
3. A logistic model on the terms themselves is trained on the posterior labels, so that it learns what single terms
   mean, and scores every document.

The fit uses at most ``quality.SAMPLE`` labelled rows and ``TERMS`` terms, whatever the input; scoring covers every word
of every row. Labels are taken from rows whose crc32(doc_id) mod 3 is not 1; neither labels nor doc_id, lang or source
enter a score.

Defined cases: NULL texts count as empty and score as a document without terms; without labelled rows or without toxic
ones every score is the share of toxic ones, (n1 + 1) / (n + 2), or 0.0 if no row is labelled. Rows with a NULL label
are not used; a doc_id labelled twice counts once, with the lower label and its least text. Repeated rows are each scored. Extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.base import Scratch, chunks, fold, map_texts, read_table, whole_rows
from quantloom.llm.near_dup import STIR, TURN, shingle_sets
from quantloom.llm.quality import SAMPLE, labelled_sample

TERMS = 4000
STEMS = (3, 4, 5, 6, 7)
#: A term needs so many toxic documents, and a log likelihood ratio against a term that means nothing of so much more than
#: the logarithm of the labelled documents, as more documents bring more terms that stand out by chance.
LEAST_TOXIC, LEAST_RATIO = 3, 5.0
SINGLE, LEXICONS = 160, 8
#: Least shingle hashes by which near-copies among the labelled documents are told.
FAMILY = 8
THRESHOLD = 0.7
_WORDS = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[str]:
    """A word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def words_of(text: str) -> set[str]:
    """The distinct lower-case words of a text."""
    return set(_WORDS(text.lower()))


@dataclass
class Finder:
    """The numbers of the known terms of a text; words met before are looked up in a bounded cache."""

    number: dict[str, int]

    def __post_init__(self):
        self.cache: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        cache, out = self.cache, set()
        for word in words_of(text):
            found = cache.get(word)
            if found is None:
                if len(cache) > 500_000:
                    cache.clear()
                found = cache[word] = tuple(self.number[t] for t in terms_of(word) if t in self.number)
            if found:
                out.update(found)
        return sorted(out)


def mine_terms(sample: DataFrame) -> list[str]:
    """At most TERMS terms of labelled documents (label, text), by descending association with toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for begin, texts in chunks(batch, "text"):
                ones: dict[str, int] = {}
                zeros: dict[str, int] = {}
                for label, text in zip(labels[begin:], texts, strict=False):
                    into = ones if label else zeros
                    for term in {t for w in words_of(text.decode("utf-8", "replace")) for t in terms_of(w)}:
                        into[term] = into.get(term, 0) + 1
                names = list({**ones, **zeros})
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([ones.get(t, 0) for t in names], pa.int64()), pa.array([zeros.get(t, 0) for t in names], pa.int64())], ["term", "toxic", "clean"])

    total = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("ones"), F.count("*").alias("n")).first()
    ones, zeros = float(total["ones"]), float(total["n"] - total["ones"])
    counts = sample.select("label", F.col("text").cast("binary").alias("text")).mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = min(max(ones / max(ones + zeros, 1.0), 1e-9), 1 - 1e-9)
    toxic, clean = F.col("toxic"), F.col("clean")
    part = lambda n, p: F.when(n > 0, n * F.log(n / (toxic + clean) / p)).otherwise(0.0)
    strong = counts.filter(toxic >= LEAST_TOXIC).withColumn("ratio", part(toxic, share) + part(clean, 1 - share))
    top = strong.filter((F.col("ratio") >= LEAST_RATIO + float(np.log(1 + ones + zeros))) & (toxic > clean)).orderBy(F.desc("ratio"), "term").limit(TERMS)
    return without_parents([(r["term"], r["toxic"], r["ratio"]) for r in top.collect()])


def without_parents(found: list[tuple[str, int, float]]) -> list[str]:
    """The terms (term, toxic documents, ratio) in order, but for beginnings that one longer term explains: it has most of
    their toxic documents and tells the classes apart as well."""
    explained = set()
    strength = {t: (n, ratio) for t, n, ratio in found}
    for term, n, ratio in found:
        word = term.rstrip("*")
        for cut in STEMS:
            n_of, ratio_of = strength.get(word[:cut] + "*", (0, 0.0)) if cut < len(word) else (0, 0.0)
            if n_of and n >= 0.7 * n_of and ratio >= ratio_of:
                explained.add(word[:cut] + "*")
    return [t for t, _, _ in found if t not in explained]


def voters(terms: list[str]) -> np.ndarray:
    """The voter of each term, terms by descending strength: each of the first SINGLE terms is a voter of its own, and
    the other words and the other beginnings form LEXICONS groups of like strength each."""
    rest = range(min(SINGLE, len(terms)), len(terms))
    words, stems = [k for k in rest if not terms[k].endswith("*")], [k for k in rest if terms[k].endswith("*")]
    out = np.arange(len(terms))
    for k, part in enumerate([*np.array_split(words, LEXICONS), *np.array_split(stems, LEXICONS)]):
        out[np.asarray(part, dtype=np.int64)] = SINGLE + k
    return out


@dataclass(frozen=True)
class LabelModel:
    """A voter's silence says nothing; that all are silent is the vote of one more voter, for clean."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    repeats: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Each vote counts for one over the number of cast votes that it repeats, itself included."""
        evidence = votes / np.maximum(votes @ self.repeats, 1.0) @ np.log(self.on_toxic / self.on_clean)
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + evidence, -30, 30)))


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> LabelModel:
    """Firing rates, prior and squared correlations of the voters (columns of votes).

    Expectation-maximisation over the votes starts from the rates on the labels, which also stay in as prior counts. A correlation is what two voters share beyond what their rates explain, inside a class.
    """
    n, m = votes.shape
    ones, zeros = max(float(labels.sum()), 1.0), max(float((1 - labels).sum()), 1.0)
    a0, b0 = (labels @ votes + 0.05) / (ones + 0.1), ((1 - labels) @ votes + 2.0) / (zeros + 4.0)
    model = LabelModel(float(np.clip(ones / n, 1e-4, 0.9)), a0, b0, np.eye(m))
    q = labels.astype(np.float64)
    for k in range(rounds):
        spread = votes - np.outer(q, model.on_toxic) - np.outer(1 - q, model.on_clean)
        around = spread.T @ spread / n
        scale = np.sqrt(np.maximum(np.diag(around), 1e-12))
        repeated = (around / np.outer(scale, scale)) ** 2
        model = LabelModel(model.prior, model.on_toxic, model.on_clean, repeated)
        after = model.posterior(votes)
        if k and np.abs(after - q).max() < 1e-4:
            break
        q, mass = after, after.sum()
        a = (q @ votes + ones * a0) / (mass + ones)
        b = ((1 - q) @ votes + zeros * b0) / (n - mass + zeros)
        model = LabelModel(float(np.clip((mass + ones) / (2 * n), 1e-4, 0.9)), a, b, model.repeats)
    return model


@dataclass(frozen=True)
class Classifier:
    terms: tuple[str, ...]
    weights: np.ndarray
    intercept: float

    def scores(self, found: Iterable[list[int]]) -> np.ndarray:
        z = np.array([self.weights[f].sum() for f in found]) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(found: list[list[int]], target: np.ndarray, terms: list[str], ridge: float = 1e-5, rounds: int = 600) -> Classifier:
    """Ridge logistic weights of the terms for soft targets, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = np.array([k for f in found for k in f], dtype=np.int64)
    n, w, b = len(found), np.zeros(len(terms)), 0.0
    v, c, t = w, b, 1.0
    width = np.bincount(row, minlength=n) + 1.0
    bend = np.bincount(col, weights=width[row], minlength=len(terms)) / (4 * n) + ridge  # bounds the curvature of each weight
    bend_b = width.mean() / 4
    for _ in range(rounds):
        z = np.bincount(row, weights=v[col], minlength=n) + c
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        new = v - (np.bincount(col, weights=gap[row], minlength=len(terms)) / n + ridge * v) / bend
        new_b = c - gap.mean() / bend_b
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c, w, b, t = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b), new, new_b, after
    return Classifier(tuple(terms), w, float(b))


def one_of_each_family(sample: DataFrame) -> DataFrame:
    """The labelled documents but for those that share a least shingle hash with one of smaller hash of id before them.

    Near-copies carry the same rare words, which would otherwise stand out by chance. At most SAMPLE rows of eight numbers
    reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch, "text"):
                least = [((s[:, None] ^ STIR[:FAMILY]) * TURN[:FAMILY]).min(axis=0).view(np.int64) if len(s) else np.empty(0, np.int64) for s in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array([x.tolist() for x in least], pa.list_(pa.int64()))], ["doc_id", "least"])

    rows = sample.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, least array<long>").withColumn("h", F.xxhash64("doc_id"))
    seen: set[tuple[int, int]] = set()
    kept = []
    for r in sorted(rows.collect(), key=lambda r: (r["h"], r["doc_id"], r["least"])):
        keys = set(enumerate(r["least"]))
        if not keys & seen:
            kept.append((r["doc_id"],))
        seen |= keys
    ids = sample.sparkSession.createDataFrame(kept, "doc_id long").distinct()
    return sample.join(F.broadcast(ids), "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    sample = one_of_each_family(Scratch(docs.sparkSession).write(labelled_sample(docs, labels, "toxic", 3, 1)))
    terms = mine_terms(sample)
    finder = Finder({t: k for k, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch, "text"):
                found = [finder(t.decode("utf-8", "replace")) for t in texts]
                keys = [batch.column(k).slice(begin, len(texts)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "found"])

    rows = sample.select(F.col("doc_id").cast("long"), F.col("label").cast("int"), F.col("text").cast("binary").alias("text"))
    held = rows.mapInArrow(run, "doc_id long, label int, found array<int>").collect()  # SAMPLE rows at most
    held.sort(key=lambda r: (r["doc_id"], r["found"]))
    ones = sum(bool(r["label"]) for r in held)
    if not held or not ones or not terms:
        p = (ones + 1) / (len(held) + 2) if held else 1e-12
        return Classifier((), np.zeros(0), float(np.log(p / (1 - p))))
    found = [r["found"] for r in held]
    voter = voters(terms)
    votes = np.zeros((len(found), int(voter.max()) + 2))
    for i, f in enumerate(found):
        votes[i, voter[f] if f else -1] = 1
    votes = votes[:, votes.any(axis=0)]
    model = fit_label_model(votes, np.array([float(bool(r["label"])) for r in held]))
    return fit_linear(found, model.posterior(votes), terms)


def with_scores(docs: DataFrame, model: Classifier, whole: bool = False) -> DataFrame:
    """map_texts() with the score of each text."""
    finder = Finder({t: k for k, t in enumerate(model.terms)})
    return map_texts(docs, lambda texts: [pa.array(model.scores([finder(t.decode("utf-8", "replace")) for t in texts]), pa.float64())], [("_score", T.DoubleType())], whole)


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    doc_id = F.col("_keep.doc_id")
    out = with_scores(docs, model).select(doc_id.alias("doc_id"), (fold(doc_id, 3) == 1).alias("held_out"), F.col("_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, unchanged."""
    return with_scores(docs, model, whole=True).filter(F.col("_score") < THRESHOLD).select(*whole_rows(docs, docs.columns))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return score(docs, fit(docs, read_table(spark, folder, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_toxicity": op10_toxicity}
