"""Run store, JSON reports, array input, streaming and the registered queries."""

from __future__ import annotations

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quantloom.plans import registry, strategy
from quantloom.sources import store
from quantloom.streaming import bars


def test_store_round_trip(spark, tmp_path):
    runs = store.RunStore(spark, str(tmp_path))
    runs.create()
    for k in range(3):
        runs.save("backtests", f"r{k}", {"k": k}, {"v": [k]}, datetime.datetime(2024, 1, 1 + k))
    assert runs.latest("backtests").first()["record_id"] == "r2" and runs.get("backtests", "r1").count() == 1
    assert [r["record_id"] for r in runs.history("backtests", 2).collect()] == ["r2", "r1"]
    assert runs.read("states").count() == 0 and (store.clamp(0), store.clamp(999)) == (1, 200)
    with pytest.raises(ValueError):
        runs.read("other")


def test_reports_and_arrays(spark, tmp_path):
    report = spark.createDataFrame([("a", 1.5)], "feature string, ic double")
    store.save_report(report, str(tmp_path / "r"))
    assert store.load_report(spark, str(tmp_path / "r"), report.schema).collect() == report.collect()
    raw = spark.createDataFrame([("a", ["2024-01-01", "2024-01-02"], [1.0, 2.0], [0.0, 1.0])], "instrument string, timestamps array<string>, prices array<double>, signals array<double>")
    assert [r["position"] for r in store.arrays_to_panel(raw).orderBy("seq").collect()] == [0.0, 1.0]
    with pytest.raises(Exception, match="differ"):
        store.arrays_to_panel(raw.withColumn("prices", F.array(F.lit(1.0)))).collect()
    numbers = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double").select(store.safe_number("x").alias("x"))
    assert [r["x"] for r in numbers.collect()] == [0.0, 0.0, 2.0]


def test_streams(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("a", day + datetime.timedelta(minutes=20 * k), float(k)) for k in range(30)], "instrument string, ts timestamp, price double")
    for part in (ticks.filter("price < 15"), ticks.filter("price >= 15")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = bars.tick_stream(spark, str(tmp_path / "in"), "instrument string, ts timestamp, price double", 10)
    for name, frame, mode in (("bars", bars.bar_stream(source), "complete"), ("ewma", bars.ewma_stream(source, 0.5), "append"), ("flags", bars.cusum_stream(source, 3.0, 0.0), "append")):
        run = frame.writeStream.format("memory").queryName(f"t_{name}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        run.awaitTermination(120)
    got = {r["ts"]: r["price"] for r in spark.table("t_bars").collect()}
    assert got[day] == 2.0 and len(got) == 10
    y, want = None, []
    for k in range(30):
        y = float(k) if y is None else (k + y) / 2
        want.append(y)
    assert [round(r["ewma"], 9) for r in spark.table("t_ewma").orderBy("ts").collect()] == [round(v, 9) for v in want]
    assert [r["flag"] for r in spark.table("t_flags").orderBy("ts").collect()].count(1) == 7


def test_gate_scales_the_run(spark, data):
    from quantloom.plans.queries_bars import SMALL, hourly

    cfg = strategy.StrategyConfig(clean=strategy.CleanConfig(max_abs_log_return=None), features=SMALL)
    run = strategy.run_strategy(hourly(spark, data), cfg)
    gate = run.price.select("instrument", "ts", F.lit(0.0).alias("size"))
    shut = strategy.run_strategy(hourly(spark, data), cfg, gate=gate)
    assert run.summary.count() > 0 and shut.bars.filter("applied <> 0").count() == 0


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def table(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if pd.isna(v) else str(v) if isinstance(v, (str, bool)) else round(float(v), 4) + 0.0
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["calibration_isotonic", "decision_kelly_fraction", "logistic_fit", "regime_report", "ic_decay_spearman", "resample_last", "outlier_filter", "feature_matrix", "ensemble", "ewma", "turnover_cap", "drawdown_guard_flatten", "backtest_summary", "performance_metrics", "ic_spearman", "mi_hist", "drift_report", "transfer_entropy", "transition_matrix", "triple_barrier", "purged_kfold", "ridge_fit", "cusum"])
def test_query_equals_its_sql(spark, data, duck, name):
    assert table(registry.QUERIES[name](spark, data).toPandas()) == table(duck.sql(registry.ORACLES[name]).df())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_values_become_plain_json(spark):
    value = {1: {2}, ("a",): np.float64(0.5), "d": datetime.date(2024, 1, 1), "l": (np.int64(3), [np.bool_(True)])}
    assert store.plain(value) == {1: [2], "['a']": 0.5, "d": "2024-01-01", "l": [3, [True]]}


def test_array_quality_names_the_first_problem(spark):
    t = ["2024-01-01", "2024-01-02", "2024-01-03"]
    nan = float("nan")
    rows = [("a", t, [1.0, 2.0, 3.0], [0.0] * 3), ("b", [t[0], t[0], t[1]], [1.0] * 3, [0.0] * 3), ("c", t[::-1], [1.0] * 3, [0.0] * 3), ("d", t, [1.0, nan, 2.0], [0.0] * 3), ("e", t, [1.0], [0.0] * 3), ("f", [], [], [])]
    raw = spark.createDataFrame(rows, "instrument string, timestamps array<string>, prices array<double>, signals array<double>")
    got = {r["instrument"]: (r["duplicate_timestamps"], r["non_monotonic_timestamps"], r["nan_prices"], r["problem"]) for r in store.array_quality(raw).collect()}
    assert got == {"a": (0, 0, 0, None), "b": (1, 1, 0, "duplicate timestamps"), "c": (0, 2, 0, "timestamps do not rise"), "d": (0, 0, 1, "prices are not finite"), "e": (0, 0, 0, "arrays differ in length"), "f": (0, 0, 0, "no timestamps")}
    assert store.arrays_to_panel(raw.filter("instrument = 'a'")).count() == 3
