"""Recursions, hidden Markov models, quantiles and stationarity by chunks against their plain forms."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import chunks, linear, quantiles, sliding
from quantloom.operators import decay, features, information, meta, regimes, risk, sequential, stationarity
from quantloom.operators.hmm_model import HmmConfig, products

DAY = 86_400


def panel(spark, sizes=(400, 3, 1), seed: int = 0, gaps: float = 0.2, **columns):
    """Series with NULLs at uneven times; rows in no order."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        at = np.cumsum(rng.integers(1, 4, size=n)) * DAY // 2
        for i in range(n):
            x = None if rng.random() < gaps else float(rng.normal(0, 3))
            rows.append((f"s{k}", dt.datetime(2020, 1, 1) + dt.timedelta(seconds=int(at[i])), x))
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], "instrument string, ts timestamp_ntz, x double").repartition(3)


def by_series(df, column: str) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in df.orderBy("instrument", "ts").collect():
        out.setdefault(r["instrument"], []).append(r[column])
    return out


def arrays(df) -> dict[str, np.ndarray]:
    return {k: np.array([math.nan if v is None else v for v in xs]) for k, xs in by_series(df, "x").items()}


def same(got: dict, want: dict, tolerance: float = 1e-12) -> None:
    assert got.keys() == want.keys()
    for k in want:
        a = np.array([math.nan if v is None else v for v in got[k]], dtype=float)
        np.testing.assert_allclose(a, want[k], rtol=tolerance, atol=tolerance)


@pytest.mark.parametrize("bucket_s", [20 * DAY, 3 * DAY, 10_000 * DAY])
@pytest.mark.parametrize("alpha, least", [(0.2, 1), (0.9, 3), (1.0, 1), (1e-3, 1)])
def test_ewma_by_buckets(spark, bucket_s, alpha, least):
    df = panel(spark)
    same(by_series(decay.ewma(df, "x", alpha, least, bucket_s), "x_ewma"), {k: sequential.ewma(v, alpha, least) for k, v in arrays(df).items()})


def test_means_by_time_and_inertia_by_buckets(spark):
    df = panel(spark, seed=1)
    seconds = {k: np.array([(t - dt.datetime(2020, 1, 1)).total_seconds() for t in v]) for k, v in by_series(df, "ts").items()}
    for bucket_s, half_life, carry in ((15 * DAY, 5.0 * DAY, True), (4 * DAY, 10.0, True), (60 * DAY, 900.0 * DAY, False)):
        want = {k: sequential.ewma_by_time(v, seconds[k], half_life, 2, carry) for k, v in arrays(df).items()}
        same(by_series(decay.ewma_by_time(df, "x", half_life, 2, carry, bucket_s), "x_ewma"), want)
    want = {k: sequential.inertia(v, decay.half_life_to_alpha(4.0)) for k, v in arrays(df).items()}
    same(by_series(decay.inertia(df, "x", 4.0, 12 * DAY), "position"), want)


def test_linear_scan_over_many_segments(spark):
    """Weights so small that segments are short, and long runs of weight 1 between them."""
    rng = np.random.default_rng(2)
    n = 3000
    a = np.where(rng.random(n) < 0.3, rng.choice([0.0, 1e-60, 0.5, 1e-200], size=n), np.where(rng.random(n) < 0.5, 1.0, 0.97))
    a[0], b = 0.0, rng.normal(size=n)
    rows = [("i", dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), float(a[i]), float(b[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, a double, b double")
    y, want = 0.0, []
    for i in range(n):
        y = a[i] * y + b[i]
        want.append(y)
    for bucket_s in (5 * DAY, 3600):
        same(by_series(linear.scan(df, F.col("a"), F.col("b"), "y", bucket_s), "y"), {"i": np.array(want)}, 1e-11)


def test_recursive_means_use_no_python(spark):
    for out in (decay.ewma(panel(spark), "x", 0.1), decay.ewma_by_time(panel(spark), "x", 5.0), decay.inertia(panel(spark), "x", 5.0)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("cap, gaps", [(0.5, 0.0), (0.01, 0.0), (2.0, 0.1), (100.0, 0.02)])
def test_turnover_cap_by_buckets(spark, cap, gaps):
    df = panel(spark, seed=3, gaps=gaps)
    want = {k: sequential.cap_steps(v, cap) for k, v in arrays(df).items()}
    for bucket_s in (10 * DAY, 3 * DAY):
        same(by_series(risk.cap_turnover(df, cap, "x", bucket_s=bucket_s), "x"), want)


def test_cap_map_is_the_recursion_from_every_state():
    rng = np.random.default_rng(4)
    for _ in range(300):
        v = np.round(rng.normal(0, 3, size=rng.integers(1, 30)), rng.integers(0, 3))
        cap = float(rng.choice([0.1, 1.0, 2.5]))
        found = sequential.cap_map(v, cap)
        assert len(found.xs) <= 2 * len(v) and found.xs == sorted(found.xs) and found.ys == sorted(found.ys)
        for y in [math.nan, *rng.normal(0, 8, size=20), *v]:
            assert abs(sequential.after_cap(y, found) - sequential.cap_steps(v, cap, y)[-1]) < 1e-9


def test_cusum_map_is_the_recursion_from_every_state():
    rng = np.random.default_rng(5)
    for _ in range(300):
        x = rng.normal(0, 1, size=rng.integers(1, 60))
        x[rng.random(len(x)) < 0.1] = math.nan
        h, drift = float(rng.choice([0.5, 2.0, 6.0])), float(rng.choice([0.0, 0.1, -0.05]))
        found = sequential.cusum_map(x, h, drift)
        for up, down in [(0.0, 0.0), (h, -h), *zip(rng.uniform(0, h, 25), -rng.uniform(0, h, 25), strict=True)]:
            a, b = up, down
            for v in x:
                if not math.isnan(v):
                    a, b = max(0.0, a + v - drift), min(0.0, b + v + drift)
                    if a > h or b < -h:
                        a = b = 0.0
            assert np.allclose(sequential.after_cusum((up, down), found), (a, b), atol=1e-9)


@pytest.mark.parametrize("threshold, drift", [(4.0, 0.1), (0.5, 0.0), (1e9, 0.0)])
def test_cusum_by_buckets(spark, threshold, drift):
    df = panel(spark, seed=6)
    want = {k: sequential.cusum(v, threshold, drift) for k, v in arrays(df).items()}
    for bucket_s in (10 * DAY, 2 * DAY):
        same(by_series(regimes.cusum(df, "x", threshold, drift, bucket_s), "flag"), want)


def test_overlay_smooths_and_caps_by_buckets(spark):
    df = panel(spark, sizes=(300,), seed=7, gaps=0.0).withColumn("price", F.exp(F.col("x") / 20)).withColumn("position", F.col("x") / 6)
    out = risk.overlay(df.select("instrument", "ts", "price", "position"), risk.RiskConfig(1.0, risk.VolTarget(10), 0.1, 0.3, risk.DrawdownGuard(0.1, cooldown=2)))
    got = out.orderBy("ts").collect()
    smooth = sequential.ewma(np.array([r["position_vol"] for r in got]), 0.3)
    np.testing.assert_allclose([r["position_capped"] for r in got], sequential.cap_steps(smooth, 0.1), atol=1e-12)
    assert all(abs(r["position_target"] - r["position_capped"] * r["guard_scale"]) < 1e-12 for r in got) and any(r["guard_active"] for r in got)


def test_running_products_of_matrices():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 17, 64):
        m = rng.uniform(0.1, 1, size=(n, 3, 3))
        want, now = [], np.eye(3)
        for k in range(n):
            now = now @ m[k]
            now = now / now.max()
            want.append(now)
        got = products(m)
        np.testing.assert_allclose(got / got.max(axis=(1, 2), keepdims=True), want, rtol=1e-12)


def two_regimes(spark, sizes=(500, 160, 12), seed: int = 9):
    rng, rows = np.random.default_rng(seed), []
    for k, n in enumerate(sizes):
        state = np.cumsum(rng.random(n) < 0.05) % 2
        for i in range(n):
            a = None if rng.random() < 0.03 else float(rng.normal(0, (0.3, 2.0)[state[i]]))
            rows.append((f"s{k}", dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * i), a, float(rng.normal(state[i], 0.7)), bool(i < 0.7 * n)))
    return spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, a double, b double, fit boolean").repartition(3)


def states(df) -> list[tuple]:
    return [tuple(r) for r in df.orderBy("instrument", "ts").collect()]


@pytest.mark.parametrize("mode, cfg, calibrate", [("filter", HmmConfig(2, 6), None), ("smooth", HmmConfig(3, 5), "fit"), ("viterbi", HmmConfig(2, 4), None), ("smooth", HmmConfig(2, 4, init="kmeans"), "fit"), ("filter", HmmConfig(2, 100, 0.5), None)])
def test_hmm_by_buckets_equals_one_task(spark, mode, cfg, calibrate):
    df = two_regimes(spark)
    want, got = (states(regimes.hmm(df, ["a", "b"], cfg, mode, calibrate, bucket_s)) for bucket_s in (None, 20 * DAY))
    assert [r[:3] for r in got] == [r[:3] for r in want] and len({r[0] for r in want}) == 2
    np.testing.assert_allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-9)


@pytest.mark.parametrize("kind", ["normal", "ties", "one value", "heavy tail"])
def test_exact_quantiles_are_percentiles(spark, kind):
    rng = np.random.default_rng(10)
    draw = {"normal": lambda n: rng.normal(size=n), "ties": lambda n: rng.integers(0, 4, size=n), "one value": lambda n: np.full(n, 2.5), "heavy tail": lambda n: np.exp(rng.normal(0, 20, size=n))}[kind]
    rows = [(k, float(v) if rng.random() > 0.05 else None) for k, n in (("a", 5000), ("b", 7), ("c", 1)) for v in draw(n)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.8, 0.99, 1.0)
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.expr(f"percentile(x, array({', '.join(map(repr, shares))}))").alias("q")).collect() if r["q"]}
    assert {r["k"]: r["q"] for r in quantiles.exact_quantiles(df, ["k"], "x", shares, "q").collect()} == want


def plain_adf(x: np.ndarray, used: int | None = None) -> tuple[float, int, int]:
    def fit(lags: int, skip: int) -> tuple[float, float, int]:
        d = np.diff(x)
        rows = np.arange(skip, len(d))
        design = np.column_stack([x[rows], np.ones(len(rows)), *(d[rows - k] for k in range(1, lags + 1))])
        coef = np.linalg.lstsq(design, d[rows], rcond=None)[0]
        gap = d[rows] - design @ coef
        n, k = design.shape
        error = math.sqrt(gap @ gap / (n - k) * np.linalg.inv(design.T @ design)[0, 0])
        return coef[0] / error, n * math.log(gap @ gap / n) + 2 * k, n

    most = stationarity.most_adf_lags(len(x))
    used = min(range(most + 1), key=lambda k: fit(k, most)[1]) if used is None else used
    t, _, n = fit(used, used)
    return t, used, n


def plain_kpss(x: np.ndarray, lags: int | None = None) -> tuple[float, int]:
    e, n = x - x.mean(), len(x)
    if lags is None:
        pairs = [(e[k:] @ e[: n - k]) / (n / 2) for k in range(1, int(n ** (2 / 9)) + 1)]
        s0, s1 = e @ e / n + sum(pairs), sum(k * p for k, p in enumerate(pairs, 1))
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    spread = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[: n - k]) for k in range(1, lags + 1))) / n
    return (np.cumsum(e) ** 2).sum() / n**2 / spread, lags


@pytest.mark.parametrize("chunk_rows", [250_000, 60])
def test_stationarity_report_by_chunks(spark, chunk_rows):
    rng = np.random.default_rng(11)
    noise = rng.normal(size=700)
    made = {"noise": 1000 + noise, "walk": np.cumsum(noise), "ar": np.zeros(500), "short": noise[:9], "flat": np.ones(40), "tiny": noise[:3]}
    for i in range(3, 500):
        made["ar"][i] = 0.5 * made["ar"][i - 1] - 0.3 * made["ar"][i - 3] + noise[i]
    rows = [(k, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(v)) for k, xs in made.items() for i, v in enumerate(xs)]
    rows += [("noise", dt.datetime(2019, 1, 1), None), ("none", dt.datetime(2019, 1, 1), None)]
    df = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, x double")
    out = stationarity.stationarity_report(df, "x", chunk_rows=chunk_rows)
    assert len(out.columns) == 17 and out.columns[15:] == ["adf_stationary", "kpss_stationary"]
    found = {r["instrument"]: r for r in out.collect()}
    assert found.keys() == made.keys()
    for name in ("noise", "walk", "ar", "short"):
        r, x = found[name], made[name]
        t, used, n = plain_adf(x)
        stat, lags = plain_kpss(x)
        assert (r["adf_usedlag"], r["adf_nobs"], r["kpss_lags"]) == (used, n, lags)
        np.testing.assert_allclose([r["adf_stat"], r["kpss_stat"]], [t, stat], rtol=1e-8)
    assert found["noise"]["adf_pvalue"] < 1e-6 < 0.05 < found["walk"]["adf_pvalue"] < 1
    assert found["walk"]["kpss_pvalue"] == 0.01 and found["noise"]["kpss_pvalue"] > 0.05
    assert found["flat"]["adf_stat"] is None and found["flat"]["kpss_stat"] is None and found["tiny"]["adf_stat"] is None
    fixed = {r["instrument"]: r for r in stationarity.stationarity_report(df, "x", 4, 2, chunk_rows).collect()}
    np.testing.assert_allclose([fixed["ar"]["adf_stat"], fixed["ar"]["kpss_stat"]], [plain_adf(made["ar"], 2)[0], plain_kpss(made["ar"], 4)[0]], rtol=1e-8)


def test_adf_p_values_meet_the_published_lines(spark):
    lines = spark.createDataFrame([(v[0], p) for p, v in stationarity.ADF_LINES.items()], "stat double, p double")
    assert all(abs(r["q"] - r["p"]) < 5e-4 for r in lines.withColumn("q", stationarity.adf_p(F.col("stat"))).collect())


@pytest.mark.parametrize("lags_x, lags_y", [((1,), (1,)), ((1, 2), (1,)), ((2, 3), (1, 4))])
def test_te_significance_of_lag_vectors(spark, lags_x, lags_y):
    rng = np.random.default_rng(12)
    x = rng.normal(size=400)
    y = np.concatenate([rng.normal(size=2), x[:-2]]) + 0.5 * rng.normal(size=400)
    rows = [("i", "f", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(x[i]), float(y[i])) for i in range(400)]
    long = spark.createDataFrame(rows, "instrument string, feature string, ts timestamp_ntz, x double, y double")
    got = information.te_significance(long, bins=2, runs=40, lags_x=lags_x, lags_y=lags_y).first()
    want = information.transfer_entropy(long, lags_x, lags_y, bins=2).first()["te"]
    assert abs(got["te"] - want) < 1e-12 and abs(got["pvalue"] * 41 - round(got["pvalue"] * 41)) < 1e-9
    assert got["pvalue"] < 0.03 or 2 not in lags_x


def test_chunks_are_dealt_with_the_rows_before_them(spark):
    rows = chunks.numbered(panel(spark, sizes=(50, 7), gaps=0.0), 5 * DAY, "x")
    got = chunks.dealt(rows, 4, 10).collect()
    for name, n in (("s0", 50), ("s1", 7)):
        for c in range(-(-n // 10)):
            own = sorted(r["_rn"] for r in got if r["instrument"] == name and r["_chunk"] == c and r["own"])
            ahead = sorted(r["_rn"] for r in got if r["instrument"] == name and r["_chunk"] == c and not r["own"])
            assert own == list(range(10 * c, min(10 * c + 10, n))) and ahead == (list(range(10 * c - 4, 10 * c)) if c else [])
    assert len({r["_chunk"] for r in got if r["instrument"] == "s0"}) == 5


@pytest.mark.parametrize("chunk_rows", [250_000, 25])
def test_sliding_tail_equals_each_window(spark, chunk_rows):
    df = panel(spark, sizes=(160, 12, 3), gaps=0.03, seed=13)
    out = risk.historical_es(df.withColumn("other", F.lit("o")), "x", 10, 0.15, chunk_rows)
    assert set(out.columns) == {"instrument", "ts", "x", "other", "var", "es"}
    for column, f in (("var", lambda w: np.quantile(w, 0.15)), ("es", lambda w: w[w <= np.quantile(w, 0.15)].mean())):
        want = {k: np.array([f(v[i - 9 : i + 1]) if i >= 9 and not np.isnan(v[i - 9 : i + 1]).any() else math.nan for i in range(len(v))]) for k, v in arrays(df).items()}
        same(by_series(out, column), want)


@pytest.mark.parametrize("chunk_rows", [250_000, 12])
def test_sliding_spearman_equals_each_window(spark, chunk_rows):
    rng = np.random.default_rng(14)
    rows = [("i", f, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(rng.integers(0, 5)), float(rng.normal()) if rng.random() > 0.1 else None) for f in "fg" for i in range(60)]
    long = spark.createDataFrame(rows, "instrument string, feature string, ts timestamp_ntz, x double, y double")
    got = {(r["feature"], r["ts"]): r["ic"] for r in information.ic_rolling(long, 7, "spearman", chunk_rows=chunk_rows).collect()}
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for f in "fg":
        kept = [r for r in rows if r[1] == f and r[4] is not None]
        assert sum(k[0] == f for k in got) == len(kept) - 6
        for i in range(6, len(kept)):
            x, y = (rank(np.array([r[c] for r in kept[i - 6 : i + 1]])) for c in (3, 4))
            assert abs(got[f, kept[i][2]] - np.corrcoef(x, y)[0, 1]) < 1e-12


def plain_touch(p: np.ndarray, horizon: int, up: float, down: float) -> list:
    out = []
    for i in range(len(p)):
        r = [x / p[i] - 1 for x in p[i + 1 : i + 1 + horizon] if not math.isnan(x)]
        hit = next((1 if x >= up else -1 for x in r if x >= up or x <= -down), None)
        out.append(math.nan if not r or math.isnan(p[i]) else hit if hit else float(np.sign(r[-1])))
    return out


def test_first_touch_equals_a_walk():
    rng = np.random.default_rng(15)
    for _ in range(200):
        p = np.exp(np.cumsum(rng.normal(0, 0.1, size=rng.integers(1, 80))))
        p[rng.random(len(p)) < 0.1] = math.nan
        p = p * np.where(rng.random(len(p)) < 0.05, -1, 1)
        horizon, up, down = int(rng.integers(1, 40)), float(rng.choice([0.0, 0.05, 0.5])), float(rng.choice([0.02, 0.3]))
        first, last = sorted(rng.integers(0, len(p) + 1, size=2))
        np.testing.assert_array_equal(sliding.first_touch(p, first, last, horizon, up, down)[0], plain_touch(p, horizon, up, down)[first:last])


@pytest.mark.parametrize("horizon, chunk_rows", [(5, 250_000), (30, 40), (1000, 250_000)])
def test_triple_barrier_by_chunks(spark, horizon, chunk_rows):
    df = panel(spark, sizes=(200, 5), gaps=0.05, seed=16).withColumn("price", F.exp(F.col("x") / 10)).withColumn("side", F.lit(1.0))
    got = by_series(meta.triple_barrier(df, "price", "side", horizon, 0.3, 0.2, chunk_rows), "hit")
    prices = {k: np.array([math.nan if v is None else v for v in vs]) for k, vs in by_series(df, "price").items()}
    same(got, {k: np.array(plain_touch(v, horizon, 0.3, 0.2)) for k, v in prices.items()})


def test_labels_and_bins_by_exact_quantiles(spark):
    df = panel(spark, sizes=(120, 30), gaps=0.1, seed=17)
    values = {k: v[~np.isnan(v)] for k, v in arrays(df).items()}
    for r in features.winsorise(df, "x", 0.1, "w").collect():
        low, high = np.quantile(values[r["instrument"]], [0.1, 0.9])
        assert r["w"] is None if r["x"] is None else abs(r["w"] - min(max(r["x"], low), high)) < 1e-12
    trend = regimes.trend_labels(df.withColumn("r2", F.lit(0.9)), "x", "r2").collect()
    assert all((r["p_state_0"], r["p_state_1"]) == ((0.0, 0.0) if r["state"] is None else (float(r["state"] == 0), float(r["state"] == 1))) for r in trend)
    long = df.withColumn("feature", F.lit("f")).withColumn("y", F.col("x") * F.col("x"))
    exact, plain = (sorted(map(str, f(long, ("x", "y"), 7).select("instrument", "ts", "b_x", "b_y").collect())) for f in (information.binned_exactly, information.binned))
    assert exact == plain


def test_drift_in_bins_of_equal_width(spark):
    rng = np.random.default_rng(18)
    train, live = rng.normal(0, 1, 500), rng.normal(0.5, 1, 300)
    frame = lambda x, k: spark.createDataFrame([("i", "f", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(v), 0.0) for i, v in enumerate(x)] + [("i", "c", dt.datetime(2020, 1, 1), 2.0, 0.0)] * k, "instrument string, feature string, ts timestamp_ntz, x double, y double")
    got = {r["feature"]: r["psi"] for r in information.drift(frame(train, 3), frame(live, 2), 8, binning="width").collect()}
    edges = np.linspace(train.min(), train.max(), 9)
    edges[0], edges[-1] = -np.inf, np.inf
    p, q = ((h + 1e-12 * h.sum()) / (h + 1e-12 * h.sum()).sum() for h in (np.histogram(x, edges)[0].astype(float) for x in (train, live)))
    assert abs(got["f"] - ((p - q) * np.log(p / q)).sum()) < 1e-9 and abs(got["c"]) < 1e-9
