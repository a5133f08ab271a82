"""Encoding, scores, near-duplicates, mixing and classifiers on odd rows, and against plain versions on the small tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quantloom.llm import bpe, lm_score, mixing, near_dup, quality, toxicity
from quantloom.llm.base import hash_words
from quantloom.llm.quality import fit_rules, lasso_logistic, statistics
from tests.llm import brute
from tests.llm.conftest import TEXTS

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def small(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").limit(150).cache()


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(VOCABULARY), special_tokens={})


def test_words_are_hashed_alike_wherever_they_stand():
    texts = [b"One two  three", b"", b"three\tone", b"x" * 100 + b" ONE", b"\x00a \x00"]
    h, counts = hash_words(texts)
    assert counts.tolist() == [3, 0, 2, 2, 2]
    assert h[0] == h[4] == h[6] and h[2] == h[3] and len({int(x) for x in h}) == 6


def test_encoding_equals_the_library(codec, tik):
    rng = random.Random(1)
    alphabet = "ab eE'slt\n\t0123.,!é東\U0001f600 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(300)] + [t or "" for _, t in TEXTS]
    texts += ["<|endoftext|>", "aaaa" * 200, "=" * 999, " " * 50 + "x"]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        own = np.frombuffer(ids, dtype="<u4")
        assert own.tolist() == tik.encode_ordinary(text)
        assert codec.decode(own.astype(np.int64)) == text.encode()


def test_encode_and_decode_frames(odd_docs, no_docs):
    out = bpe.encode(odd_docs, VOCABULARY, public_tokenizers.PATTERN)
    back = bpe.decode(out, VOCABULARY, public_tokenizers.PATTERN).toPandas()
    assert sorted(back["text"]) == sorted(t or "" for _, t in TEXTS)
    digests = bpe.encode(odd_docs, VOCABULARY, public_tokenizers.PATTERN, digests=True).toPandas()
    empty = hashlib.sha256(b"").hexdigest()
    assert digests[digests["doc_id"] == 1][["n_tokens", "ids_sha256", "decoded_sha256"]].values.tolist() == [[0, empty, empty]]
    assert bpe.encode(no_docs, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    out = near_dup.near_duplicates(odd_docs).toPandas()
    got = {None if np.isnan(r.doc_id) else int(r.doc_id): (r.n_shingles, r.component_id, r.kept) for r in out.itertuples()}
    assert len(out) == len(TEXTS)
    assert got[1][:2] == (0, 1) and got[2][:2] == (0, 2) and got[3][:2] == (0, 3)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False)
    assert [got[k][1] for k in (6, 7, 8, 12)] == [6, 6, 6, 6] and got[9][:2] == (19_996, 9) and got[10][:2] == (1, 10)
    assert got[None][0] == 20 and np.isnan(got[None][1]) and got[None][2]
    assert near_dup.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_equal_brute_force(spark, block):
    rng = random.Random(3)
    docs = {}
    for family in range(12):
        base = [rng.choice("abcdefghij") * rng.randrange(1, 6) for _ in range(60)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(60)] = f"new{rng.randrange(10**6)}"
            docs[len(docs) * 3 + 1] = " ".join(copy)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    out = near_dup.near_duplicates(frame, block=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute.near_components(docs)
    assert {r["doc_id"]: r["n_shingles"] for r in out} == {i: len(brute.shingles(t)) for i, t in docs.items()}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    x, y = a[:2200], a[300:]
    merged = np.maximum(near_dup.sketch(x), near_dup.sketch(y))
    assert (merged == near_dup.sketch(np.union1d(x, y))).all()
    u, v = near_dup.sketch(x), near_dup.sketch(y)
    guess = near_dup.estimate(np.array([(u > v).sum()]).astype(float), np.array([(u < v).sum()]).astype(float), np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(guess - len(np.intersect1d(x, y)) / len(a)) < 0.12


def test_mixing_of_odd_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs.select("doc_id", "text", "source", "size")).toPandas()
    assert len(out) == len(TEXTS) and (out["taken"] <= 3 * out["size"]).all() and (out["taken"] % out["size"].clip(lower=1) == 0).all()
    assert out[out["doc_id"].isin([1, 2, 3])]["taken"].tolist() == [0, 0, 0]
    assert abs(out.groupby("source", dropna=False)["target"].first().sum() - out["size"].sum()) < 1e-6
    assert mixing.mix(no_docs).count() == 0 and mixing.curriculum(no_docs).count() == 0
    copies = mixing.curriculum(odd_docs)
    assert copies.columns == odd_docs.columns and copies.count() == out["copies"].sum()


def test_targets_fill_up(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 10), (None, 50), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == {"a": 30, "b": 860, "c": 30, None: 150, "d": 0}


def test_mix_comes_near_its_targets_and_reruns_agree(small):
    first, second = (mixing.mix(small, texts=False).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert first.drop(columns="places").equals(second.drop(columns="places"))
    by = first.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), n=("doc_id", "size"))
    assert (abs(by["taken"] - by["target"]) <= first["size"].max() / 2 + 1).all()
    other = mixing.place_copies(small, slices=16, texts=False).toPandas()
    assert sorted(len(p) for p in other["places"]) == sorted(first["copies"])


def test_query_takes_its_rows_from_the_numbered_range_sort(spark, odd_docs, data, monkeypatch):
    tables = [spark.read.parquet(f"{data}/documents.parquet"), odd_docs]
    for docs in (d.select("doc_id", "source", "text") for d in tables):
        rows, plain = mixing.copies_in_order(docs).collect(), mixing.mix(docs, texts=False).collect()
        copies = sorted((r for r in rows if r["position"] is not None), key=lambda r: r["position"])
        assert [r["position"] for r in copies] == list(range(sum(r["copies"] for r in plain)))
        assert [r["place"] for r in copies] == sorted(p for r in plain for p in r["places"])
        assert len({r["uid"] for r in rows}) == len(plain) and all(r["place"] is None for r in rows if r["position"] is None)
        found, sort = [], mixing.range_sorted
        with monkeypatch.context() as patch:
            patch.setattr(mixing, "read_table", lambda *_, docs=docs: docs)
            patch.setattr(mixing, "range_sorted", lambda *a: found.append(sort(*a)) or found[-1])
            out = mixing.op5_mixing(spark, "").collect()
        key = lambda i, *rest: (-1 if i is None else i, *rest)
        want = [key(r["doc_id"], r["size"], r["copies"], r["taken"], round(min(r["places"], default=-1.0), 6)) for r in plain]
        assert sorted(key(r["doc_id"], r["size"], r["copies"], r["taken"], -1.0 if r["first_place"] is None else r["first_place"]) for r in out) == sorted(want)
        assert len(found) == 1


def test_places_follow_the_schedule():
    import pyspark.sql.functions as F

    for slope in mixing.SLOPES:
        t = np.linspace(0, 1, 11)
        done = t * (1 - slope) + slope * t * t
        curved = (slope - 1 + np.sqrt((1 - slope) ** 2 + 4 * slope * done)) / (2 * slope) if slope else done
        assert np.allclose(curved, t)
    assert mixing.place(F.lit(0.5), F.lit(0.0)) is not None


@pytest.mark.parametrize("most", [10**8, 0])
def test_scores_against_plain_counts(spark, small, most):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()] + TEXTS
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = lm_score.score(frame, most_bytes=most, hot=4000).toPandas()
    n, want = brute.base_scores(rows)
    assert set(out["train_tokens"]) == {n} and len(out) == len(rows)
    key = lambda i, v: (-1 if i is None or np.isnan(i) else int(i), v[0], v[1], round(v[2], 6))
    got = sorted(key(r.doc_id, (r.n_tokens, r.n_known, r.base_score)) for r in out.itertuples())
    assert got == sorted(key(i, want[k]) for k, (i, _) in enumerate(rows))
    # but for lookups that the filter answers too high, scores are those of the quantised exact counts
    want = {i: score for (i, _), score in zip(rows, brute.model_scores(rows), strict=True) if i is not None}
    gaps = [abs(r.score - want[r.doc_id]) / abs(want[r.doc_id]) for r in out.itertuples() if not np.isnan(r.doc_id) and r.doc_id > 13]
    assert min(gaps) < 1e-9 and np.median(gaps) < 0.02 and np.quantile(gaps, 0.95) < 0.08
    held = out[out["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and (out["score"] < 0).all() and np.isfinite(out["score"]).all()


def test_shuffled_lookups_give_the_broadcast_scores(small):
    a, b = (lm_score.score(small, most_bytes=m, hot=4000).toPandas().set_index("doc_id")["score"] for m in (10**8, 0))
    assert (a - b).abs().max() < 1e-9


def test_shuffled_lookups_send_no_row_for_each_token(small, monkeypatch):
    plans, plain = [], lm_score.shuffled_scores
    monkeypatch.setattr(lm_score, "shuffled_scores", lambda *a: plans.append(plain(*a)) or plans[-1])
    out = lm_score.score(small, most_bytes=0, hot=4000)
    assert out.count() == small.count()
    text = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "place" not in text


def test_repeated_rows_score_alike_on_both_paths(spark, small):
    frame = small.unionByName(small.filter("doc_id % 3 = 0")).unionByName(small.filter("doc_id % 6 = 0")).select("doc_id", "text")
    a, b = (sorted((r["doc_id"], r["score"], r["base_score"]) for r in lm_score.score(frame, most_bytes=m, hot=4000).collect()) for m in (10**8, 0))
    assert len(a) == frame.count() > small.count() and [r[0] for r in a] == [r[0] for r in b]
    assert np.abs(np.array(a)[:, 1:] - np.array(b)[:, 1:]).max() < 1e-9


def test_scores_of_no_rows_and_of_no_training_rows(spark, no_docs):
    assert lm_score.score(no_docs).count() == 0
    held = next(i for i in range(50) if brute.fold(i, 5) == 1)
    out = lm_score.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).toPandas()
    assert out["train_tokens"].tolist() == [0] and out["n_known"].tolist() == [0] and np.isfinite(out[["score", "base_score"]]).all().all()


def test_filter_never_loses_a_level():
    rng = np.random.default_rng(2)
    grams, counts = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(1, 5000, 5000)
    levels = lm_score.level_of(counts)
    table = lm_score.build_filter(grams, levels)
    sizes = np.array([len(table)])
    assert (lm_score.probe_one(grams, table) >= levels).all()
    absent = lm_score.probe_one(rng.integers(0, 2**63, 5000).astype(np.uint64), table)
    assert (absent > 0).mean() < 0.06


def test_classifiers_on_odd_rows(odd_docs, no_docs, labels, no_labels):
    for module, keep in ((quality, quality.keep_good), (toxicity, toxicity.keep_clean)):
        for docs, marks in ((odd_docs, labels), (odd_docs, no_labels), (no_docs, labels)):
            model = module.fit(docs, marks)
            out = module.score(docs, model).toPandas()
            assert len(out) == docs.count() and out["score"].between(0, 1).all()
            kept = keep(docs, model)
            assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert quality.score(odd_docs, quality.fit(odd_docs, no_labels)).filter("score <> 0.5").count() == 0


def test_quality_rules_tell_repetition_from_prose():
    rng = random.Random(4)
    prose = [" ".join(rng.choice(["the", "of", "house", "tree", "runs", "blue", "and", "walks", "sea"]) + rng.choice(["", "s", "ing"]) for _ in range(80)) for _ in range(150)]
    junk = [" ".join([rng.choice(["spam", "buy"])] * 80) for _ in range(150)]
    x, y = statistics([t.encode() for t in prose + junk]), np.array([1.0] * 150 + [0.0] * 150)
    model = fit_rules(x[::2], y[::2])
    z = model.intercept + sum(w * r.holds(x[1::2]) for w, r in model.weighted)
    assert ((z > 0) == y[1::2]).mean() > 0.97 and len(model.weighted) < 60


def test_lasso_drops_what_means_nothing():
    rng = np.random.default_rng(1)
    z = rng.integers(0, 2, (400, 12)).astype(float)
    w = lasso_logistic(z, z[:, 0], 0.02, 400)[1]
    assert w[0] > 1 and np.abs(w[1:]).max() < 0.2


def test_toxic_terms_are_learned(spark):
    rng = random.Random(6)
    plain = ["table", "river", "window", "green", "paper", "stone", "cloud", "bread"]
    rows, marks = [], []
    for i in range(600):
        bad = i % 6 == 0
        text = [rng.choice(plain) + rng.choice(["", "s", "ly", "er"]) for _ in range(30)]
        if bad:
            text[rng.randrange(30)] = rng.choice(["nastyword", "vile", "krumpf" + rng.choice("abcdefgh")])
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))).toPandas().merge(__import__("pandas").DataFrame(marks, columns=["doc_id", "toxic"]))
    held = out[out["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.98
