"""Streams in any split into batches against the batch recursion."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from quantloom.operators import sequential
from quantloom.operators.regimes import HmmConfig, fit_hmm
from quantloom.streaming import bars, stateful

BEGIN = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("n_batches, seed", [(1, 0), (4, 1)])
def test_streams_do_not_depend_on_batches(spark, tmp_path, n_batches, seed):
    rng = np.random.default_rng(7)
    made = [(k, BEGIN + dt.timedelta(minutes=int(7 * i + 3 * (k == "b"))), float(rng.normal(0, (0.1, 2.0)[i // 40 % 2]))) for k in "ab" for i in range(160)]
    late = ("a", BEGIN + dt.timedelta(minutes=1), 99.0)  # comes when the watermark is past it
    made.sort(key=lambda r: r[1])
    for k in range(n_batches):
        part = made[len(made) * k // n_batches : len(made) * (k + 1) // n_batches] + ([late] if k and k == n_batches - 1 else [])
        random.Random(seed).shuffle(part)
        spark.createDataFrame(part, "instrument string, ts timestamp, price double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(k, BEGIN + dt.timedelta(days=9), 0.0) for k in "ab"], "instrument string, ts timestamp, price double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    model = fit_hmm(np.array([r[2] for r in made])[:, None], HmmConfig(2, 20))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    try:
        for name, make in (("ewma", lambda t: stateful.ewma_by_time_stream(t, 3600.0, "1 hour")), ("hmm", lambda t: stateful.hmm_stream(t, model, "1 hour"))):
            source = bars.tick_stream(spark, str(tmp_path / "in"), "instrument string, ts timestamp, price double")
            run = make(source).writeStream.format("memory").queryName(f"s_{name}_{n_batches}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
            assert run.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    for k in "ab":
        own = [r for r in made if r[0] == k]
        seconds, price = np.array([(r[1] - BEGIN).total_seconds() for r in own]), np.array([r[2] for r in own])
        got = [r for r in spark.table(f"s_ewma_{n_batches}").orderBy("ts").collect() if r["instrument"] == k and r["ts"] < BEGIN + dt.timedelta(days=8)]
        assert [r["ts"] for r in got] == [r[1] for r in own]
        np.testing.assert_allclose([r["ewma"] for r in got], sequential.ewma_by_time(price, seconds, 3600.0), atol=1e-12)
        got = [r for r in spark.table(f"s_hmm_{n_batches}").orderBy("ts").collect() if r["instrument"] == k and r["ts"] < BEGIN + dt.timedelta(days=8)]
        want = model.forward(model.densities(price[:, None]))[0]
        np.testing.assert_allclose([[r["p_state_0"], r["p_state_1"]] for r in got], want, atol=1e-9)
