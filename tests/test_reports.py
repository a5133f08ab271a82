"""Reports: they run whole, keep every instrument apart, and do not look ahead."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quantloom.operators import regimes
from quantloom.plans import queries_stats, registry, reports  # noqa: F401
from quantloom.sources.store import rows_to_panel

DAY = datetime.datetime(2024, 1, 1)


def panel(spark, n: int = 80, changed_from: int = 10**6):
    rows = []
    for name, phase in (("a", 0.0), ("b", 1.0)):
        price = 1.0
        for k in range(n):
            r = 0.01 * math.sin(0.7 * k + phase) + 0.002 * math.cos(3.1 * k)
            if k >= changed_from:
                r = -3 * r
            price *= 1 + r
            rows.append((name, DAY + datetime.timedelta(days=k), price, r, math.sin(0.7 * k + phase), math.cos(0.3 * k), 1.0 if k % 3 else -1.0))
    return spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, price double, returns double, f1 double, f2 double, signal double")


CFG = reports.MetaConfig(horizon=2, folds=3)


@pytest.mark.parametrize("label", ["meta_label", "return_sign", "quantile", "triple_barrier"])
def test_meta_model_runs(spark, label):
    cfg = reports.MetaConfig(label=label, horizon=2, folds=3, up=0.005, down=0.005)
    fit = reports.fit_meta_model(panel(spark), ["f1", "f2"], cfg=cfg)
    out = reports.predict_meta_model(fit, panel(spark), cfg=cfg)
    assert out.count() == 160 and out.filter("p_follow is not null").count() > 100 and fit.calibration.count() == 2
    assert len(fit.schema_hash) == 64 and len(fit.config_hash) == 16


@pytest.mark.parametrize("calibration", ["platt", "isotonic"])
def test_meta_model_with_walk_forward_and_calibration_is_kept_on_disk(spark, tmp_path, calibration):
    cfg = reports.MetaConfig(horizon=2, cv="walk_forward", train_rows=30, test_rows=10, calibration=calibration, policy="kelly_fraction")
    fit = reports.fit_meta_model(panel(spark), ["f1", "f2"], cfg=cfg)
    reports.save_meta_model(fit, str(tmp_path / "fit"))
    kept = reports.load_meta_model(spark, str(tmp_path / "fit"))
    a, b = (reports.predict_meta_model(f, panel(spark), cfg=cfg).orderBy("instrument", "ts").collect() for f in (fit, kept))
    assert a == b and any(r["size"] for r in a) and kept.names == ("f1", "f2") and kept.config_hash == fit.config_hash


def test_predictions_use_no_later_rows(spark):
    fit = reports.fit_meta_model(panel(spark), ["f1", "f2"], cfg=CFG)
    a = reports.predict_meta_model(fit, panel(spark), cfg=CFG).filter("ts < '2024-02-20'").orderBy("instrument", "ts").collect()
    later = panel(spark).withColumn("f1", F.when(F.col("ts") >= "2024-02-20", 9.0).otherwise(F.col("f1")))
    assert a == reports.predict_meta_model(fit, later, cfg=CFG).filter("ts < '2024-02-20'").orderBy("instrument", "ts").collect()


@pytest.mark.parametrize("method", ["quantile_vol", "trend_range", "hmm"])
def test_regimes_are_shifted_and_warn(spark, method):
    cfg = reports.RegimeConfig(method, 5, calibrate_to="2024-02-10", output_shift=1)
    found = reports.infer_regimes(panel(spark).drop("price"), cfg)
    assert found.warnings == () and found.states.count() > 0 and found.transitions.count() > 0
    early = lambda df: [tuple(r) for r in df.filter("ts <= '2024-02-10'").select("instrument", "ts", "state").orderBy("instrument", "ts").collect()]
    assert early(found.states) == early(reports.infer_regimes(panel(spark, changed_from=45).drop("price"), cfg).states)
    assert reports.infer_regimes(panel(spark), reports.RegimeConfig(method, 5)).warnings


def test_information_report_has_every_part(spark):
    rows = panel(spark).withColumn("regime", (F.col("returns") > 0).cast("int"))
    found = reports.information_report(rows, ["f1", "f2"], signal="signal", regime="regime", live=rows, cfg=reports.InformationConfig(horizon=2, te_runs=8, ic_window=20, bins=4, te_bins=3))
    assert found.summary.count() == 4 and found.redundancy.count() == 8 and found.ic_by_regime.count() == 8
    assert found.drift.filter("psi > 0.5").count() == 0 and found.te.filter("pvalue is null").count() == 0


def test_evaluation_report(spark):
    rows = panel(spark).withColumn("equity", F.col("price")).withColumn("benchmark", F.col("returns") / 2)
    found = reports.evaluate_strategy(rows.drop("benchmark"), "returns", "equity", "signal", rows.select("instrument", "ts", "benchmark"), (5, 20))
    assert all(abs(r["beta"] - 2) < 1e-9 for r in found.benchmark.collect())
    assert found.metrics.filter("calmar is not null").count() == 2 and found.stability.count() == 2


def test_rows_become_ticks(spark):
    ticks = rows_to_panel(spark, [{"timestamp_utc": "2024-01-01", "price": 1.5}, {"timestamp_utc": "2024-01-01", "price": 2}])
    assert [r["seq"] for r in ticks.orderBy("seq").collect()] == [0, 1]


def test_queries_run_the_whole_job(spark, data, monkeypatch):
    asked = {}
    monkeypatch.setattr(regimes, "hmm", lambda panel, columns, cfg, mode: asked.update({mode: cfg}) or panel)
    for mode in ("filter", "smooth", "viterbi"):
        registry.QUERIES[f"hmm_{mode}"](spark, data)
        assert asked[mode].rounds == regimes.HmmConfig().rounds == 100
    for name in ("te_significance", "information_report"):
        found = registry.QUERIES[name](spark, data).toPandas()
        runs = found["pvalue"].dropna() * 201
        assert len(runs) == len(found) and (runs - runs.round()).abs().max() < 1e-3 and runs.min() > 0.9
    assert (found.groupby("instrument")["feature"].nunique() == 3).all()


def test_meta_output_as_json(spark, tmp_path):
    rows = panel(spark)
    cfg = reports.MetaConfig(horizon=2, folds=2, min_train_rows=20)
    fit = reports.fit_meta_model(rows, ["a", "b"] if "a" in rows.columns else [c for c in rows.columns if c not in ("instrument", "ts", "price", "returns", "signal", "equity", "benchmark")][:2], cfg=cfg)
    out = reports.predict_meta_model(fit, rows, cfg=cfg)
    reports.save_meta_output(out, fit, str(tmp_path))
    back, facts = reports.load_meta_output(spark, str(tmp_path))
    key = lambda r: (r["instrument"], r["ts"])
    for a, b in zip(sorted(out.collect(), key=key), sorted(back.collect(), key=key), strict=True):
        assert a["action"] == b["action"] and (a["p_follow"] is None) == (b["p_follow"] is None) and abs((a["size"] or 0) - (b["size"] or 0)) < 1e-12
    assert {r["schema_hash"] for r in facts.collect()} == {fit.schema_hash}
    assert reports.fit_meta_model(rows, list(fit.names), cfg=reports.MetaConfig(horizon=2, folds=2, min_train_rows=10**6)).models.count() == 0
    with pytest.raises(NotImplementedError):
        reports.MetaConfig(feature_selection="lasso")


def test_equity_of_a_total_loss_raises(spark):
    from quantloom.operators import evaluate

    rows = spark.createDataFrame([("a", datetime.datetime(2024, 1, k + 1), r) for k, r in enumerate([None, 0.5, -0.5])], "instrument string, ts timestamp_ntz, r double")
    assert [r["equity"] for r in evaluate.equity_curve(rows, "r", 2.0).orderBy("ts").collect()] == [2.0, 3.0, 1.5]
    with pytest.raises(Exception, match="no equity"):
        evaluate.equity_curve(rows.withColumn("r", F.lit(-1.0)), "r").collect()


def test_overview_counts_each_kind(spark, tmp_path):
    from quantloom.sources.store import RunStore

    store = RunStore(spark, str(tmp_path))
    store.create()
    store.save("states", "x", {}, {})
    assert {r["kind"]: r["n_records"] for r in store.overview().collect()} == {"states": 1, "backtests": 0, "datasets": 0, "runs": 0}
