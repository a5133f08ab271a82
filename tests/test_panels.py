"""Micro examples, invariants and absence of lookahead for the panel operators."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.stats import normal_cdf, normal_ppf
from quantloom.operators import backtest, clean, decay, evaluate, features, information, meta, regimes, risk, sequential, signals, stationarity

DAY = datetime.datetime(2024, 1, 1)


def series(spark, step_hours: int = 24, instrument: str = "a", **columns):
    n = len(next(iter(columns.values())))
    rows = [(instrument, DAY + datetime.timedelta(hours=step_hours * k), *(None if v[k] is None else float(v[k]) for v in columns.values())) for k in range(n)]
    return spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))


def values(df, column: str) -> list:
    return [r[column] for r in df.orderBy("instrument", "ts").select(column).collect()]


def near(got, want, tolerance: float = 1e-9) -> bool:
    return len(got) == len(want) and all((a is None and b is None) or (a is not None and b is not None and abs(a - b) <= tolerance) for a, b in zip(got, want, strict=True))


def test_next_bar_pays(spark):
    bars = backtest.run_bars(series(spark, price=[100, 110, 121, 121], position=[0, 1, 1, 0]))
    assert near(values(bars, "returns"), [0.1, 0.1, 0]) and near(values(bars, "applied"), [0, 1, 1]) and near(values(bars, "pnl"), [0, 0.1, 0])


def test_costs_and_equity(spark):
    cfg = backtest.BacktestConfig(1000.0, 10.0)
    flat = backtest.run_bars(series(spark, price=[1, 1, 1, 1], position=[0, 1, 1, -1]), cfg)
    assert near(values(flat, "turnover"), [0, 1, 0]) and near(values(flat, "costs"), [0, 0.001, 0])
    moved = backtest.run_bars(series(spark, price=[100, 110, 121, 108.9, 108.9], position=[0, 1, 1, 1, 1]), backtest.BacktestConfig(1000.0))
    assert near(values(moved, "equity"), (1000 * np.cumprod(1 + np.array(values(moved, "pnl")))).tolist())


def test_equity_stops_at_zero(spark):
    bars = backtest.run_bars(series(spark, price=[1, 3, 1, 2], position=[-1, -1, -1, -1]))
    assert values(bars, "equity") == [0.0, 0.0, 0.0]
    assert backtest.summary(bars).first()["cagr"] == -1.0


def test_scaling_positions_scales_pnl(spark):
    one, two = (backtest.run_bars(series(spark, price=[1, 1.1, 1.05, 1.2], position=[0.2 * k, 0.4 * k, -0.1 * k, 0])) for k in (1, 2))
    assert near([2 * x for x in values(one, "pnl")], values(two, "pnl"))
    still = backtest.run_bars(series(spark, price=[1, 1.1, 1.05, 1.2], position=[0.5] * 4))
    assert values(still, "turnover") == [0, 0, 0]


def test_keep_last_and_resample(spark):
    ticks = spark.createDataFrame([("a", DAY, 1.0, 0), ("a", DAY, 2.0, 1), ("a", DAY + datetime.timedelta(days=2), 3.0, 2)], "instrument string, ts timestamp_ntz, price double, seq long")
    assert values(clean.keep_last(ticks), "price") == [2.0, 3.0]
    assert values(clean.resample(series(spark, 6, price=range(6)), "1D", "last"), "price") == [3.0, 5.0]
    assert values(clean.resample(series(spark, 6, price=range(6)), "1D", "first"), "price") == [0.0, 4.0]


def test_outliers_go_with_their_return(spark):
    assert values(clean.drop_outliers(series(spark, price=[1, 1.01, 2, 1.02, 1.03, -1, 1.04])), "price") == [1, 1.01, 1.03, 1.04]


def test_time_zone_and_bad_times(spark):
    raw = spark.createDataFrame([("2024-07-01 12:00:00", 1.0)], "t string, price double")
    assert clean.with_utc(raw, "t", "Europe/Berlin").first()["ts"] == datetime.datetime(2024, 7, 1, 10)
    with pytest.raises(Exception, match="missing"):
        clean.with_utc(spark.createDataFrame([(None, 1.0)], "t string, price double"), "t").collect()


def test_price_choice(spark):
    raw = spark.createDataFrame([(1.0, 3.0, 9.0)], "bid double, ask double, close double")
    assert clean.with_price(raw).first()["price"] == 2.0 and clean.with_price(raw.drop("bid")).first()["price"] == 9.0
    with pytest.raises(ValueError):
        clean.with_price(raw.select("bid"))


def test_validation_counts(spark):
    got = clean.validate(series(spark, price=[1, None, float("inf"), -2, 500]), max_abs=100.0, positive=True).first()
    assert (got["n_null"], got["n_nonfinite"], got["n_nonpositive"], got["n_large"], got["ok"]) == (1, 1, 1, 2, False)


def test_warm_up_and_no_lookahead(spark):
    cfg = features.FeatureConfig((2, 3), (2,), (2,), 1)
    price = [1 + 0.1 * math.sin(k) + 0.01 * k for k in range(20)]
    full = features.build_features(series(spark, price=price), cfg)
    assert full.count() == 20 - cfg.warm_up()
    changed = features.build_features(series(spark, price=[*price[:15], *[9.0] * 5]), cfg)
    for c in ("ret_1", "mom_2", "rv_2", "z_mom_2"):
        assert near(values(full, c)[: 15 - cfg.warm_up()], values(changed, c)[: 15 - cfg.warm_up()])


@pytest.mark.parametrize("rows", [9, 10, 40])
def test_chunks_change_nothing(spark, rows):
    from quantloom.functions import chunks

    rng = np.random.default_rng(8)
    df = series(spark, price=np.exp(rng.normal(size=50).cumsum() * 0.1)).unionByName(series(spark, instrument="b", price=range(1, 14)))
    cfg = features.FeatureConfig((2, 3), (2,), (2,), 1)
    f = lambda p: features.build_features(p, cfg)
    whole, cut = f(df).orderBy("instrument", "ts").collect(), chunks.in_chunks(df, f, 9, rows, 7 * 86_400).orderBy("instrument", "ts").collect()
    assert [r[:2] for r in whole] == [r[:2] for r in cut] and all(near(list(a[2:]), list(b[2:]), 1e-12) for a, b in zip(whole, cut, strict=True))
    with pytest.raises(ValueError):
        chunks.in_chunks(df, f, 9, 5)


def test_one_series_does_not_touch_another(spark):
    a, b = series(spark, price=[1, 2, 3, 5, 8, 13]), series(spark, instrument="b", price=[5, 4, 5, 4, 5, 4])
    f = lambda df: features.regime_features(df, (3,))
    alone, together = f(a).orderBy("ts").collect(), f(a.unionByName(b)).filter("instrument = 'a'").orderBy("ts").collect()
    assert alone == together


def test_forward_return_and_labels(spark):
    df = series(spark, price=[1, 1, 1, 1], r=[0.1, -0.2, 0.3, 0.0])
    assert near(values(df.withColumn("f", features.forward_return("r", 2)), "f"), [0.1, 0.3, None, None])
    assert values(df.withColumn("l", meta.sign_label("r", 1)), "l") == [0, 1, None, None]
    assert values(df.withColumn("l", meta.sign_label("r", 1, null_tail=False)), "l") == [0, 1, None, 0]


def test_triple_barrier(spark):
    out = meta.triple_barrier(series(spark, price=[100, 111, 80, 100, 101], side=[1, 1, -1, 1, 1]), "price", "side", 2, 0.1, 0.1)
    assert values(out, "hit") == [1, -1, 1, 1, None] and values(out, "label") == [1, 0, 0, 1, None]


def test_decay_examples(spark):
    assert near(values(decay.inertia(series(spark, target=[0, 1, 1]), "target", 1.0), "position"), [0, 0.5, 0.75])
    step = series(spark, x=[1.0] * 8).withColumn("k", decay.kernel_mean("x", decay.kernel_weights("linear", 5)))
    assert near(values(step, "k"), [None] * 4 + [1.0] * 4)
    assert near(sequential.ewma(np.array([1, np.nan, 2, 3.0]), 0.5).tolist(), [1, 1, 5 / 3, 7 / 3])
    x = [math.sin(k) for k in range(60)]
    both = series(spark, x=x)
    assert near(values(both.withColumn("e", decay.ewma_frame("x", 0.3)), "e"), values(decay.ewma(both, "x", 0.3), "x_ewma"), 1e-12)


def test_time_aware_mean_by_spacing():
    y = sequential.ewma_by_time(np.array([0, 1, 1.0]), np.array([0, 86_400, 11 * 86_400.0]), 86_400.0)
    assert near(y.tolist(), [0, 0.5, 1 - 0.5 * 2**-10])


def test_turnover_cap_bounds_every_step():
    y = sequential.cap_steps(np.array([0, 2, -2, 2.0]), 0.5)
    assert (np.abs(np.diff(y)) <= 0.5 + 1e-12).all() and y[0] == 0


def test_guard_cooldown_and_vol_scale(spark):
    df = series(spark, price=[1] * 7, hit=[0, 1, 0, 0, 0, 1, 0]).withColumn("t", F.col("hit") == 1)
    assert values(df.withColumn("c", risk.cooldown("t", 2)), "c") == [False, True, True, True, False, True, True]
    out = risk.overlay(series(spark, price=[1.0, 1.05, 1.02, 1.03, 1.04, 1.01], position=[0, 1, -1, 0.5, 0, 0.25]), risk.RiskConfig(vol=risk.VolTarget(window=2)))
    assert all(abs(p) <= 1 for p in values(out, "position_target")) and values(out, "vol_scale")[:3] == [1.0, 1.0, 1.0]
    proxy = risk.guarded(series(spark, position=[2, 2, 2], returns=[0, -1.5, 0]), risk.DrawdownGuard())
    assert values(proxy, "equity_proxy")[1:] == [0.0, 0.0]


def test_evaluation_examples(spark):
    eq = series(spark, r=[0.1, -0.2, 0.05]).withColumn("equity", features.equity("r"))
    drawn = evaluate.drawdowns(eq).first()
    assert abs(drawn["max_drawdown"] - 0.2) < 1e-12 and drawn["longest_under_water"] == 2
    assert evaluate.performance(series(spark, returns=[0.01] * 5)).first()["sharpe"] == 0.0
    bench = evaluate.benchmark(series(spark, returns=[0.02, -0.04, 0.06], benchmark=[0.01, -0.02, 0.03])).first()
    assert abs(bench["beta"] - 2) < 1e-12 and abs(bench["alpha"]) < 1e-12 and abs(bench["r2"] - 1) < 1e-12
    last = evaluate.rolling_metrics(series(spark, returns=[0, 0.1, -0.1]), (2,), periods=None).orderBy(F.desc("ts")).first()
    assert abs(last["mean_2"]) < 1e-12 and abs(last["vol_2"] - 0.1) < 1e-12 and abs(last["sharpe_2"]) < 1e-9


def test_normal_functions_invert(spark):
    df = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.3, 0.5, 0.8, 0.99)], "p double").withColumn("z", normal_ppf("p")).withColumn("q", normal_cdf("z"))
    assert all(abs(r["p"] - r["q"]) < 2e-7 for r in df.collect())


def long_of(spark, x, y, feature: str = "f"):
    return series(spark, x=x, y=y).withColumn("feature", F.lit(feature))


def test_information_on_known_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    same, noise = long_of(spark, x, np.exp(x)), long_of(spark, x, rng.normal(size=400))
    assert abs(information.ic(same, "spearman").first()["ic"] - 1) < 1e-12
    assert information.mi_hist(same).first()["mi"] > 2 > 0.3 > information.mi_hist(noise).first()["mi"]
    assert information.mi_copula(same).first()["mi"] > 2 > 0.1 > information.mi_copula(noise).first()["mi"]
    assert information.ic(long_of(spark, [1, 2, None, 4], [None, 1, 2, 3])).first()["n"] == 2
    assert information.ic(long_of(spark, [1, 1, 1], [1, 2, 3])).first()["ic"] is None


def test_transfer_entropy_has_a_direction(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=1000)
    x = np.roll(y, 1) + 0.1 * rng.normal(size=1000)
    forth = information.te_significance(long_of(spark, y, x), runs=20).first()
    back = information.transfer_entropy(long_of(spark, x, y)).first()
    assert forth["te"] > 3 * back["te"] and forth["pvalue"] < 0.06
    assert abs(forth["te"] - information.transfer_entropy(long_of(spark, y, x)).first()["te"]) < 1e-9


def test_drift_grows_with_the_shift(spark):
    rng = np.random.default_rng(2)
    base = long_of(spark, rng.normal(size=800), [0.0] * 800)
    small, large = (information.drift(base, long_of(spark, rng.normal(m, 1, 800), [0.0] * 800)).first() for m in (0.1, 1.5))
    assert all(large[k] > small[k] >= 0 for k in ("psi", "kl", "js", "hellinger"))


def test_regime_examples(spark):
    assert sum(sequential.cusum(np.array([0, 0.01, 0.03, -0.04, 0]), 0.02, 0.0)) >= 1
    states = series(spark, state=[0, 0, 1, 1, 1, 0]).withColumn("state", F.col("state").cast("int"))
    p = {(r["from_state"], r["to_state"]): r["p"] for r in regimes.transition_matrix(states, 2).collect()}
    assert near([p[0, 0], p[0, 1], p[1, 1], p[1, 0]], [0.5, 0.5, 2 / 3, 1 / 3])
    assert sorted(r["length"] for r in regimes.runs(states).collect()) == [1, 2, 3]


def test_hmm_filter_does_not_look_ahead(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.01, 80), rng.normal(0, 0.1, 80)])
    model = regimes.fit_hmm(x[:120, None], regimes.HmmConfig())
    a, b = model.forward(model.densities(x[:, None]))[0], model.forward(model.densities(np.concatenate([x[:100], x[100:] * 5])[:, None]))[0]
    assert np.allclose(a[:100], b[:100]) and np.allclose(a.sum(axis=1), 1)
    out = regimes.hmm(series(spark, x=np.abs(x)), ["x"], mode="viterbi").orderBy("ts").collect()
    assert np.mean([r["state"] for r in out[:80]]) < 0.2 < 0.6 < np.mean([r["state"] for r in out[80:]])


def test_models_calibration_and_policies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.2 * rng.normal(size=300) > 0).astype(float)
    df = series(spark, a=x[:, 0], b=x[:, 1], label=y)
    models = meta.fit_models(df, ["a", "b"], "label")
    scored = meta.predict(df, models, ["a", "b"])
    assert meta.brier_ece(scored).first()["brier"] < 0.2
    assert scored.select("p_follow").collect() == meta.predict(df, meta.fit_models(df, ["a", "b"], "label"), ["a", "b"]).select("p_follow").collect()
    knots = meta.isotonic(np.array([1, 2, 3.0]), np.array([3, 2, 1.0]))
    assert np.allclose(knots[1], 2.0)
    for kind in ("none", "platt", "beta", "isotonic"):
        p = meta.calibrate_scores(np.clip(rng.uniform(size=200), 0.05, 0.95), rng.integers(0, 2, 200).astype(float), kind)
        assert ((p > 0) & (p < 1)).all()
    with pytest.raises(NotImplementedError):
        meta.ModelConfig("xgb")
    decided = meta.decide(scored.withColumn("signal", F.lit(1.0)), "kelly_fraction").filter("action = 1 and size <= 0")
    assert decided.count() == 0


def test_utility_is_the_bayes_risk_policy(spark):
    rows = spark.createDataFrame([(0.3, 1.0), (0.51, 1.0), (0.9, -1.0), (0.9, 0.0), (None, 1.0)], "p_follow double, signal double")
    a, b = (meta.decide(rows, k).collect() for k in ("utility", "bayes_risk"))
    assert a == b and [r["action"] for r in a] == [0, 1, -1, 0, 0]
    assert [r["size"] and round(r["size"], 9) for r in a] == [0, 0.02, 0.8, 0.8, None]


def test_policies_by_hand(spark):
    rows = spark.createDataFrame([(0.3, 1.0), (0.6, -2.0), (1.0, 1.0), (0.8, None), (None, 1.0)], "p_follow double, signal double")
    found = lambda **k: [(r["action"], r["size"] and round(r["size"], 9), r["edge"]) for r in meta.decide(rows, **k).collect()]
    assert found(policy="threshold", threshold=0.5) == [(0, 0, None), (-1, 0.2, None), (1, 1, None), (None, 0.6, None), (0, None, None)]
    assert found(policy="kelly_fraction", payoff=2.0, max_size=0.5) == [(0, 0, None), (-1, 0.4, None), (1, 0.5, None), (None, 0.5, None), (0, None, None)]


def test_calibration_columns_equal_the_arrays(spark):
    rng = np.random.default_rng(9)
    scores, y = rng.uniform(size=60).round(2), rng.integers(0, 2, 60).astype(float)
    asked = np.concatenate([scores, [0.0, 1.0]])
    for kind in ("none", "platt", "beta", "isotonic"):
        x, v = (F.array(*[F.lit(float(c)) for c in part]) for part in meta.fit_calibration(scores, y, kind))
        got = [r[0] for r in spark.createDataFrame([(float(s),) for s in asked], "s double").select(meta.calibrated(F.col("s"), x, v, kind)).collect()]
        assert np.allclose(got[:60], meta.calibrate_scores(scores, y, kind))
    w, b = meta.fit_calibration(np.array([0.0, 1.0]), np.array([0.0, 1.0]), "platt")
    a, c = 0.0, 0.0
    for _ in range(200):  # the two-row gradient by hand
        p0, p1 = 1 / (1 + np.exp(-c)), 1 / (1 + np.exp(-a - c))
        a, c = a - 0.1 * (p1 - 1) / 2, c - 0.1 * (p0 + p1 - 1) / 2
    assert np.allclose([w[0], b[0]], [a, c])


def test_logistic_penalty_is_not_divided_by_rows():
    x, y = np.array([[1.0], [-1.0]]), np.array([1.0, 0.0])
    w, b = np.random.default_rng(7).normal(0, 0.01), 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.array([w + b, b - w])))
        w, b = w - 0.1 * (((p[0] - 1) - p[1]) / 2 + w / 0.5), b - 0.1 * (p.sum() - 1) / 2
    found, intercept = meta.fit_logistic(x, y, meta.ModelConfig(c=0.5))
    assert np.allclose([found[0], intercept], [w, b])


def test_decay_fills_before_and_after_the_shift(spark):
    out = decay.apply_decay(series(spark, x=[1.0, None, 3.0]), "x", decay.DecayConfig("none", fill=0.5, shift=1)).orderBy("ts").collect()
    assert [r["x_decay"] for r in out] == [0.5, 1.0, 0.5]


def test_purged_folds_leave_a_gap(spark):
    folds = meta.purged_kfold(series(spark, price=range(1, 21)), 4, 5, 2, 1).toPandas()
    for _, part in folds.groupby("fold"):
        test, train = part[part["part"] == "test"]["row"], part[part["part"] == "train"]["row"]
        assert len(test) == 5 and all(abs(t - r) >= 5 for r in train for t in (test.min(), test.max()) if not test.min() - 5 > r)
        assert not set(test) & set(train)


def test_stationarity(spark):
    rng = np.random.default_rng(5)
    noise = rng.normal(size=300)
    report = {r["instrument"]: r for r in stationarity.stationarity_report(series(spark, x=noise).unionByName(series(spark, instrument="b", x=np.cumsum(noise))), "x", 5).collect()}
    assert report["a"]["adf_stationary"] and report["a"]["kpss_stationary"] and not report["b"]["adf_stationary"] and not report["b"]["kpss_stationary"]


def test_ensemble_of_a_signal_and_its_negative_is_zero(spark):
    feats = series(spark, z_mom_5=[1, -2, 0.5])
    out = signals.run_ensemble(feats, signals.Ensemble((signals.Momentum(5), signals.mean_reversion(5))))
    assert near(values(out, "position"), [0, 0, 0])
    clipped = signals.run_signal(feats, signals.Momentum(5, signals.PositionRule("scaled_clip", 0.8)))
    assert near(values(clipped, "position"), [0.5, -0.8, 0.25])


@pytest.mark.parametrize("bad", [lambda: clean.CleanConfig(bucket="3D"), lambda: features.FeatureConfig(decision_shift=0), lambda: risk.RiskConfig(max_leverage=0), lambda: backtest.BacktestConfig(cost_bps=-1), lambda: signals.PositionRule("other"), lambda: decay.half_life_to_alpha(0), lambda: regimes.HmmConfig(9)])
def test_bad_settings_are_refused(bad):
    with pytest.raises(ValueError):
        bad()
