"""Fits and calibrations by buckets against those of one task a key."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import meta
from quantloom.operators.meta import ModelConfig
from quantloom.operators.meta_scan import calibration_by_buckets, pooled

DAY = 86_400


def labelled(spark):
    rng, rows = np.random.default_rng(20), []
    for name, n in (("a", 300), ("b", 90), ("one class", 30)):
        for i in range(n):
            x, z = float(rng.normal(2, 3)), float(np.round(rng.normal(), 1))
            y = 1 if name == "one class" else int(x - 2 + z + rng.normal() > 0)
            rows.append((name, i % 2, dt.datetime(2021, 1, 1) + dt.timedelta(hours=9 * i), x if rng.random() > 0.03 else None, z, 1.5, y))
    return spark.createDataFrame(rows, "instrument string, fold int, ts timestamp_ntz, x double, z double, flat double, label int").repartition(3)


@pytest.mark.parametrize("cfg, calibration", [(ModelConfig(rounds=10), "none"), (ModelConfig("ridge", 0.5), "isotonic"), (ModelConfig("ridge"), "none")])
def test_fits_by_buckets_equal_those_of_one_task(spark, cfg, calibration):
    df = labelled(spark)
    want, got = ({(r["instrument"], r["fold"]): r for r in meta.fit_models(df, ["z", "x", "flat"], "label", cfg, ("instrument", "fold"), calibration, bucket_s).collect()} for bucket_s in (None, 10 * DAY))
    assert want.keys() == got.keys() and len(want) == 4
    for k, w in want.items():
        assert got[k]["n"] == w["n"]
        for c in ("intercept", "weights", "means", "stds"):
            np.testing.assert_allclose(got[k][c], w[c], atol=1e-9)
        p = np.linspace(0, 1, 101)
        if calibration == "isotonic":
            np.testing.assert_allclose(np.interp(p, got[k]["cal_x"], got[k]["cal_y"]), np.interp(p, w["cal_x"], w["cal_y"]), atol=1e-9)


def scored(spark):
    df = labelled(spark).withColumn("p_follow", 1 / (1 + F.exp(-F.col("z"))))
    return df, df.orderBy("instrument", "ts").collect()


def test_isotonic_calibration_by_ranges_equals_that_of_one_task(spark):
    df, rows = scored(spark)
    got = {(r["instrument"], r["ts"]): r["p"] for r in meta.calibrate(df, "isotonic").collect()}
    assert len(got) == len(rows)
    for name in ("a", "b", "one class"):
        own = [r for r in rows if r["instrument"] == name]
        want = meta.calibrate_scores(np.array([r["p_follow"] for r in own]), np.array([r["label"] for r in own], dtype=float), "isotonic")
        np.testing.assert_allclose([got[name, r["ts"]] for r in own], want, atol=1e-9)


@pytest.mark.parametrize("kind", ["platt", "beta"])
def test_descent_of_calibrations_by_buckets(spark, kind):
    df, rows = scored(spark)
    got = {r["instrument"]: r for r in calibration_by_buckets(df, kind, "p_follow", "label", 20 * DAY, rounds=6).collect()}
    for name in ("a", "b", "one class"):
        p, y = (np.array([float(r[c]) for r in rows if r["instrument"] == name]) for c in ("p_follow", "label"))
        x = p[:, None] if kind == "platt" else np.stack([np.log(p), np.log(1 - p)], axis=1)
        w, b = np.zeros(x.shape[1]), 0.0
        for _ in range(6):
            gap = 1 / (1 + np.exp(-(x @ w + b))) - y
            w, b = w - 0.1 * x.T @ gap / len(y), b - 0.1 * gap.mean()
        np.testing.assert_allclose([*got[name]["cal_x"], *got[name]["cal_y"]], [*w, b], atol=1e-12)


def test_pooling_ranges_and_then_their_blocks_is_pooling_all():
    rng = np.random.default_rng(21)
    for _ in range(100):
        rows = [[float(v), 1.0, float(s), float(s)] for s, v in enumerate(rng.integers(0, 3, size=40))]
        cuts = sorted(rng.integers(0, 41, size=3).tolist())
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 40], strict=True)]
        copy = lambda blocks: [list(b) for b in blocks]
        fitted = lambda blocks: np.repeat([b[0] for b in blocks], [int(b[1]) for b in blocks])
        np.testing.assert_allclose(fitted(pooled([b for p in parts for b in pooled(copy(p))])), fitted(pooled(copy(rows))), atol=1e-12)
