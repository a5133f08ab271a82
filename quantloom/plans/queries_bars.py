"""Queries over bars: cleaning, features, signals, decay, risk and backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import chunks
from quantloom.functions.windows import lag
from quantloom.operators import backtest, clean, decay, features, risk, sequential, signals
from quantloom.operators.backtest import BacktestConfig
from quantloom.operators.features import FeatureConfig
from quantloom.operators.signals import Ensemble, Momentum, PositionRule, mean_reversion
from quantloom.plans import strategy
from quantloom.plans.registry import query
from quantloom.plans.sql import BARS, FEATURES, ITEMS, LONG, MARKET, ORDERS, POSITIONS, PREFIX, RETURNS, TICKS, W, compound, final, lagged, last, over, roll
from quantloom.plans.sql import query as sql
from quantloom.sources.store import array_quality, arrays_to_panel
from quantloom.sources.panels import event_ticks, items_panel, market_panel, orders_panel

SMALL = FeatureConfig((3, 5, 10), (5,), (5,), 1)
COSTS = BacktestConfig(1.0, 2.0, 1.0)
#: Daily bars fill a bucket slowly: one a year.
DAILY_BUCKET = 365 * 86_400
NAMES = ("ret_1", "mom_3", "mom_5", "mom_10", "rv_5", "z_mom_5")


def feature_panel(spark: SparkSession, folder: str) -> DataFrame:
    return features.build_features(items_panel(spark, folder), SMALL)


def position_panel(spark: SparkSession, folder: str) -> DataFrame:
    feats = feature_panel(spark, folder).select("instrument", "ts", (0.01 * F.tanh("z_mom_5")).alias("position"))
    return backtest.align(items_panel(spark, folder), feats)


def bar_panel(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.run_bars(position_panel(spark, folder), COSTS)


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks forced into ties: their times cut to the hour."""
    return event_ticks(spark, folder).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))


for _method, _pick in (("last", "arg_max(price, ts)"), ("first", "arg_min(price, ts)"), ("mean", "avg(price)")):
    query(f"resample_{_method}", sql(TICKS, f"out as (select instrument, date_trunc('day', ts) as ts, {_pick} as price from ticks group by 1, 2)", out=final("out", "instrument", "ts:t", "price:d")))(
        lambda s, d, m=_method: clean.resample(event_ticks(s, d), "1D", m)
    )

HOURLY = f"{TICKS}, hourly as (select instrument, date_trunc('hour', ts) as ts, price, seq from ticks)"


@query("dedup_keep_last", sql(HOURLY, "out as (select instrument, ts, arg_max(price, seq) as price from hourly group by 1, 2)", out=final("out", "instrument", "ts:t", "price:d")))
def _(s, d):
    return clean.keep_last(hourly(s, d))


@query("outlier_filter", sql(ORDERS, f"o as (select *, ln(price) - {lagged('ln(price)')} as step from panel where true)", out=final("o where price > 0 and (step is null or abs(step) <= 0.5)", "instrument", "ts:t", "price:d")))
def _(s, d):
    return clean.drop_outliers(orders_panel(s, d), 0.5)


@query("invalid_rows", sql("t as (select event_type as instrument, ts, value - 60 as price, event_id as seq from events)", out="select instrument, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(price, 6) + 0.0 as price, seq, 'non_positive_price' as reason from t where price <= 0"))
def _(s, d):
    return clean.invalid_prices(event_ticks(s, d).withColumn("price", F.col("price") - 60))


@query("duplicate_counts", sql(HOURLY, out="select instrument, count(*) as n_rows, count(distinct ts) as n_times, count(*) - count(distinct ts) as n_duplicates from hourly group by 1"))
def _(s, d):
    return clean.duplicate_counts(hourly(s, d))


GAPS = f"g as (select instrument, ts, {lagged('ts')} as since, cast(epoch(ts) - epoch({lagged('ts')}) as bigint) as gap_s from panel), gg as (select *, quantile_cont(gap_s, 0.5) over (partition by instrument) as median_s from g where gap_s is not null)"


@query("gap_histogram", sql(ORDERS, GAPS, out="select instrument, gap_s, count(*) as n, round(first(median_s), 6) + 0.0 as median_s, gap_s > first(median_s) as above from gg group by 1, 2"))
def _(s, d):
    return clean.gap_histogram(orders_panel(s, d))


@query("gap_irregularity", sql(ORDERS, GAPS, out="select instrument, round(avg(case when gap_s <> median_s then 1.0 else 0.0 end), 6) + 0.0 as irregularity, cast(sum(case when gap_s > median_s then 1 else 0 end) as bigint) as n_above, round(first(median_s), 6) + 0.0 as median_s from gg group by 1"))
def _(s, d):
    return clean.irregularity(orders_panel(s, d))


@query("missing_intervals", sql(ORDERS, GAPS, "out as (select instrument, since, ts as until, gap_s from gg where gap_s > median_s)", out=final("out", "instrument", "since:t", "until:t", "gap_s:i")))
def _(s, d):
    return clean.missing_intervals(orders_panel(s, d))


@query("backward_steps", sql(TICKS, "b as (select *, lag(ts) over (partition by instrument order by seq) as p from ticks)", out="select instrument, cast(sum(case when ts <= p then 1 else 0 end) as bigint) as n_backward from b group by 1"))
def _(s, d):
    return clean.backward_steps(event_ticks(s, d))


@query("validate_panel", sql(HOURLY, "v as (select instrument, count(*) as n_rows, count(*) - count(distinct ts) as n_repeated, cast(sum((price is null)::int) as bigint) as n_null, cast(0 as bigint) as n_nonfinite, cast(sum((price <= 0)::int) as bigint) as n_nonpositive, cast(sum((abs(price) > 100)::int) as bigint) as n_large from hourly group by 1)", out="select *, n_repeated + n_nonfinite + n_large + n_null + n_nonpositive = 0 as ok from v"))
def _(s, d):
    return clean.validate(hourly(s, d), max_abs=100.0, positive=True)


@query("mid_price", sql(TICKS, out="select instrument, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, seq, round((price * 0.999 + price * 1.001) / 2, 6) + 0.0 as price from ticks"))
def _(s, d):
    quotes = event_ticks(s, d).withColumn("bid", F.col("price") * 0.999).withColumn("ask", F.col("price") * 1.001)
    return clean.with_price(quotes).select("instrument", "ts", "seq", "price")


@query("utc_times", sql(TICKS, "u as (select instrument, seq, ts - interval 5 hour - interval 30 minute as ts from ticks)", out=final("u", "instrument", "seq", "ts:t")))
def _(s, d):
    return clean.with_utc(event_ticks(s, d), "ts", "Asia/Kolkata").select("instrument", "seq", "ts")


@query("clean_pipeline", sql(HOURLY, "k as (select instrument, ts, arg_max(price, seq) as price from hourly group by 1, 2)", f"o as (select *, ln(price) - {lagged('ln(price)')} as step from k)", "out as (select instrument, date_trunc('day', ts) as ts, arg_max(price, ts) as price from o where price > 0 and (step is null or abs(step) <= 0.5) group by 1, 2)", out=final("out", "instrument", "ts:t", "price:d")))
def _(s, d):
    return clean.clean(hourly(s, d), "ts", clean.CleanConfig(max_abs_log_return=0.5))


@query("log_returns", sql(ITEMS, RETURNS, out=final("ret", "instrument", "ts:t", "r:d")))
def _(s, d):
    return items_panel(s, d).select("instrument", "ts", features.log_return().alias("r"))


@query("simple_returns", sql(ITEMS, RETURNS, out=final("ret where s is not null", "instrument", "ts:t", "s:d")))
def _(s, d):
    return items_panel(s, d).select("instrument", "ts", features.simple_return().alias("s")).filter("s is not null")


def _with_r(s, d):
    return items_panel(s, d).withColumn("r", features.log_return())


for _name, _agg, _fn in (("momentum", "sum", features.momentum), ("rolling_vol", "stddev_pop", features.volatility)):
    query(_name, sql(ITEMS, RETURNS, f"o as (select *, {roll(_agg, 'r', 20)} as v from ret)", out=final("o", "instrument", "ts:t", "v:d")))(lambda s, d, f=_fn: _with_r(s, d).select("instrument", "ts", f("r", 20).alias("v")))


@query("zscore_momentum", sql(ITEMS, RETURNS, f"m as (select *, {roll('sum', 'r', 20)} as m from ret)", f"o as (select *, (m - {roll('avg', 'm', 20)}) / ({roll('stddev_pop', 'm', 20)} + 1e-12) as z from m)", out=final("o", "instrument", "ts:t", "z:d")))
def _(s, d):
    return _with_r(s, d).withColumn("m", features.momentum("r", 20)).select("instrument", "ts", features.zscore("m", 20).alias("z"))


@query("feature_matrix", sql(ITEMS, RETURNS, FEATURES, out=final("feats", "instrument", "ts:t", *(f"{c}:d" for c in NAMES))))
def _(s, d):
    return feature_panel(s, d)


@query("feature_matrix_chunked", sql(ITEMS, RETURNS, FEATURES, out=final("feats", "instrument", "ts:t", *(f"{c}:d" for c in NAMES))))
def _(s, d):
    return chunks.in_chunks(items_panel(s, d), lambda p: features.build_features(p, SMALL), 30, 500, 30 * 86_400)


@query("running_turnover", sql(ITEMS, RETURNS, f"o as (select *, sum(coalesce(abs(s), 0)) {over(PREFIX)} as total from ret)", out=final("o", "instrument", "ts:t", "total:d")))
def _(s, d):
    moved = items_panel(s, d).select("instrument", "ts", F.coalesce(F.abs(features.simple_return()), F.lit(0.0)).alias("move"))
    return chunks.running_sum(moved, "move", "total", 30 * 86_400).select("instrument", "ts", "total")


FIT = f"fit as (select *, case when count(price) {over(last(20))} >= 20 then regr_slope(ln(price), rn) {over(last(20))} end as slope_20, case when count(price) {over(last(20))} >= 20 then case when var_pop(ln(price)) {over(last(20))} = 0 then 0 else regr_r2(ln(price), rn) {over(last(20))} end end as r2_20 from ret)"


@query("rolling_slope_r2", sql(ITEMS, RETURNS, FIT, out=final("fit", "instrument", "ts:t", "slope_20:d", "r2_20:d")))
def _(s, d):
    return features.rolling_fit(items_panel(s, d), 20).select("instrument", "ts", "slope_20", "r2_20")


REGIME_FEATURES = f"{FIT}, rf as (select *, s as ret_1, abs(s) as ret_abs, s * s as ret_sq, {roll('stddev_pop', 's', 20)} as vol_roll_20, price / {lagged('price', 20)} - 1 as mom_20, (price - {roll('avg', 'price', 20)}) / nullif({roll('stddev_pop', 'price', 20)}, 0) as zscore_price_20 from fit), rg as (select *, {roll('stddev_pop', 'vol_roll_20', 20)} as vol_of_vol_20 from rf)"
REGIME_NAMES = ("ret_1", "ret_abs", "ret_sq", "vol_roll_20", "mom_20", "slope_20", "r2_20", "zscore_price_20", "vol_of_vol_20")


@query("regime_features", sql(ITEMS, RETURNS, REGIME_FEATURES, out=final("rg", "instrument", "ts:t", *(f"{c}:d" for c in REGIME_NAMES))))
def _(s, d):
    return features.regime_features(items_panel(s, d), (20,))


@query("forward_returns", sql(ITEMS, RETURNS, FEATURES, LONG, out=final("fw", "instrument", "ts:t", "y:d")))
def _(s, d):
    return _with_r(s, d).select("instrument", "ts", features.forward_return("r", 3).alias("y"))


@query("winsorize", sql(ITEMS, RETURNS, "q as (select *, quantile_cont(r, 0.01) over (partition by instrument) as lo, quantile_cont(r, 0.99) over (partition by instrument) as hi from ret)", "o as (select instrument, ts, case when r is not null then greatest(lo, least(hi, r)) end as v from q)", out=final("o", "instrument", "ts:t", "v:d")))
def _(s, d):
    return features.winsorise(_with_r(s, d), "r", 0.01, "v").select("instrument", "ts", "v")


@query("scale_to_target_std", sql(ITEMS, RETURNS, f"o as (select *, r * 0.1 / ({roll('stddev_pop', 'r', 60)} + 1e-12) as v from ret)", out=final("o", "instrument", "ts:t", "v:d")))
def _(s, d):
    return _with_r(s, d).select("instrument", "ts", features.scale_to_std("r", 0.1, 60).alias("v"))


@query("interaction_features", sql(ITEMS, RETURNS, FEATURES, "o as (select *, mom_5 * rv_5 as mom_5_x_rv_5, mom_5 * z_mom_5 as mom_5_x_z_mom_5, rv_5 * z_mom_5 as rv_5_x_z_mom_5 from feats)", out=final("o", "instrument", "ts:t", "mom_5_x_rv_5:d", "mom_5_x_z_mom_5:d", "rv_5_x_z_mom_5:d")))
def _(s, d):
    return features.interactions(feature_panel(s, d), ["mom_5", "rv_5", "z_mom_5"]).select("instrument", "ts", "mom_5_x_rv_5", "mom_5_x_z_mom_5", "rv_5_x_z_mom_5")


@query("periods_per_year", sql(MARKET, out="select 'a_day' as instrument, cast(365 as bigint) as periods union all select 'an_hour', 8760 union all select 'mon_fri', 252 union all select 'week', 52"))
def _(s, d):
    start = "timestamp_ntz'2024-01-01 00:00:00'"
    made = [f"select '{n}' as instrument, explode(sequence({start}, {start} + interval {k}, interval {step})) as ts" for n, k, step in (("a_day", "40 days", "1 day"), ("an_hour", "3 days", "1 hour"), ("week", "70 days", "7 days"), ("mon_fri", "60 days", "1 day"))]
    return features.infer_periods(s.sql(" union all ".join(made)).filter("instrument <> 'mon_fri' or weekday(ts) < 5"))


@query("annualise", sql(ITEMS, RETURNS, "t as (select instrument, product(1 + coalesce(s, 0)) - 1 as total, count(s) as n, stddev_pop(s) * sqrt(252) as vol from ret group by 1)", "o as (select *, case when 1 + total > 0 then pow(1 + total, 252.0 / n) - 1 end as annual from t)", out=final("o", "instrument", "vol:d", "annual:d")))
def _(s, d):
    r = items_panel(s, d).withColumn("s", features.simple_return())
    t = r.groupBy("instrument").agg((F.product(1 + F.coalesce("s", F.lit(0.0))) - 1).alias("total"), F.count("s").alias("n"), F.stddev_pop("s").alias("sd"))
    return t.select("instrument", features.annualise_vol("sd", 252.0).alias("vol"), features.annualise_return("total", "n", 252.0).alias("annual"))


@query("lookahead_report", sql(ITEMS, RETURNS, FEATURES, out="select instrument, count(*) as n_rows, cast(0 as bigint) as n_off from feats group by 1"))
def _(s, d):
    raw = _with_r(s, d).withColumn("mom_5", features.momentum("r", 5)).withColumn("rv_5", features.volatility("r", 5))
    return features.lookahead_report(feature_panel(s, d), raw, ["mom_5", "rv_5"], 1)


SIGNAL = "o as (select instrument, ts, {0} as alpha, {1} as position from feats)"
for _name, _signal, _alpha, _position in (
    ("signal_momentum", Momentum(5, PositionRule("tanh", 1.0, 0.5)), "z_mom_5", "tanh(0.5 * z_mom_5)"),
    ("signal_mean_reversion", mean_reversion(5, PositionRule("tanh", 1.0, 0.5)), "-z_mom_5", "tanh(-0.5 * z_mom_5)"),
    ("signal_clip", Momentum(5, PositionRule("scaled_clip", 0.8)), "z_mom_5", "greatest(-0.8, least(0.8, z_mom_5 / nullif(max(abs(z_mom_5)) over (partition by instrument), 0)))"),
):
    query(_name, sql(ITEMS, RETURNS, FEATURES, SIGNAL.format(_alpha, _position), out=final("o", "instrument", "ts:t", "alpha:d", "position:d")))(lambda s, d, g=_signal: signals.run_signal(feature_panel(s, d), g))


@query("ensemble", sql(ITEMS, RETURNS, FEATURES, "o as (select instrument, ts, 0.6 * z_mom_5 + 0.4 * -z_mom_5 as alpha, tanh(0.6 * z_mom_5 + 0.4 * -z_mom_5) as position from feats)", out=final("o", "instrument", "ts:t", "alpha:d", "position:d")))
def _(s, d):
    return signals.run_ensemble(feature_panel(s, d), Ensemble((Momentum(5), mean_reversion(5)), (0.6, 0.4)))


@query("align_inner", sql(ITEMS, RETURNS, FEATURES, "o as (select p.instrument, p.ts, p.price, f.mom_5 as position from panel p join feats f using (instrument, ts) where p.price > 0)", out=final("o", "instrument", "ts:t", "price:d", "position:d")))
def _(s, d):
    return backtest.align(items_panel(s, d), feature_panel(s, d).select("instrument", "ts", F.col("mom_5").alias("position")))


for _kind, _n in (("linear", 10), ("power", 10), ("step", 10)):
    _w = decay.kernel_weights(_kind, _n, 2.0)
    _sum = " + ".join(f"coalesce({lagged('price', k) if k else 'price'}, 0) * {_w[_n - 1 - k]!r}" for k in range(_n))
    query(f"kernel_{_kind}", sql(ITEMS, f"o as (select *, case when count(price) {over(last(_n))} >= {_n} then {_sum} end as v from panel)", out=final("o", "instrument", "ts:t", "v:d")))(lambda s, d, w=_w: items_panel(s, d).select("instrument", "ts", decay.kernel_mean("price", w).alias("v")))

#: Recursions in SQL step through numbered bars.
STEPS = "steps as (select *, row_number() over (partition by instrument order by ts) as i from panel)"


def recursion(first: str, step: str) -> str:
    return f"rec(instrument, ts, i, y) as (select instrument, ts, i, {first} from steps where i = 1 union all select e.instrument, e.ts, e.i, {step} from rec join steps e on e.instrument = rec.instrument and e.i = rec.i + 1)"


def recursive(*ctes: str, out: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + out


EWMA = recursive(ITEMS, STEPS, recursion("price", "0.2 * e.price + 0.8 * rec.y"), "o as (select instrument, ts, y as price_ewma from rec)", out=final("o", "instrument", "ts:t", "price_ewma:d"))


@query("ewma", EWMA)
def _(s, d):
    return decay.ewma(items_panel(s, d), "price", 0.2)


#: y, the weight left of it since its last value, and the number of values so far; a gap leaves y and lets the weight fade.
GAPS = (
    f"gs as (select instrument, ts, i, case when abs(s) < 0.3 then price end as x from (select *, price / {lagged('price')} - 1 as s from steps))",
    "rec(instrument, ts, i, y, old, seen) as (select instrument, ts, i, x, 1.0::double, (x is not null)::int from gs where i = 1 union all select e.instrument, e.ts, e.i, "
    "case when e.x is null then rec.y when rec.y is null then e.x else (rec.old * 0.9 * rec.y + 0.1 * e.x) / (rec.old * 0.9 + 0.1) end, "
    "case when rec.y is null or e.x is not null then 1.0 else rec.old * 0.9 end, rec.seen + (e.x is not null)::int from rec join gs e on e.instrument = rec.instrument and e.i = rec.i + 1)",
    "o as (select instrument, ts, case when seen >= 4 then y end as x_ewma from rec)",
)


@query("ewma_gaps", recursive(ITEMS, STEPS, *GAPS, out=final("o", "instrument", "ts:t", "x_ewma:d")))
def _(s, d):
    gappy = items_panel(s, d).withColumn("s", features.simple_return()).withColumn("x", F.when(F.abs("s") < 0.3, F.col("price")))
    return decay.ewma(gappy, "x", 0.1, 4)


@query("ewma_frame", EWMA)
def _(s, d):
    return items_panel(s, d).select("instrument", "ts", decay.ewma_frame("price", 0.2).alias("price_ewma"))


@query("ewma_time_aware", recursive(ORDERS, STEPS, "rec(instrument, ts, i, y) as (select instrument, ts, i, price from steps where i = 1 union all select e.instrument, e.ts, e.i, (1 - exp(-ln(2) * (epoch(e.ts) - epoch(rec.ts)) / 432000.0)) * e.price + exp(-ln(2) * (epoch(e.ts) - epoch(rec.ts)) / 432000.0) * rec.y from rec join steps e on e.instrument = rec.instrument and e.i = rec.i + 1)", "o as (select instrument, ts, y as price_ewma from rec)", out=final("o", "instrument", "ts:t", "price_ewma:d")))
def _(s, d):
    return decay.ewma_by_time(orders_panel(s, d), "price", 432_000.0)


@query("position_inertia", recursive(ITEMS, STEPS, recursion("price", "0.5 * e.price + 0.5 * rec.y"), "o as (select instrument, ts, y as position from rec)", out=final("o", "instrument", "ts:t", "position:d")))
def _(s, d):
    return decay.inertia(items_panel(s, d), "price", 1.0)


@query("turnover_cap", recursive(ITEMS, STEPS, recursion("price", "rec.y + least(greatest(e.price - rec.y, -50.0), 50.0)"), "o as (select instrument, ts, y as price from rec)", out=final("o", "instrument", "ts:t", "price:d")))
def _(s, d):
    return risk.cap_turnover(items_panel(s, d), 50.0, "price", bucket_s=DAILY_BUCKET)


@query("ar1_half_life", sql(ITEMS, f"p as (select instrument, price as a, {lagged('price')} as b from panel)", "q as (select instrument, covar_pop(a, b) / nullif(var_pop(b), 0) as phi from p where b is not null group by 1)", "o as (select *, case when phi > 0 and phi < 1 then -ln(2) / ln(phi) end as half_life from q)", out=final("o", "instrument", "phi:d", "half_life:d")))
def _(s, d):
    return decay.ar1_half_life(items_panel(s, d), "price")


@query("ic_decay_curve", sql(ITEMS, RETURNS, FEATURES, f"j as (select f.instrument, f.ts, f.z_mom_5 as x, ret.r from feats f join ret using (instrument, ts)), l as (select *, {', '.join(f'lead(r, {h}) {over()} as r{h}' for h in (1, 3, 5))} from j)", "u as (select instrument, x, unnest([1, 3, 5]) as horizon, unnest([r1, r3, r5]) as y from l)", "o as (select instrument, horizon, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) as ic from u where y is not null group by all)", out=final("o", "instrument", "horizon:i", "ic:d")))
def _(s, d):
    joined = feature_panel(s, d).select("instrument", "ts", F.col("z_mom_5").alias("x")).join(_with_r(s, d), ["instrument", "ts"])
    return decay.ic_decay_curve(joined, "x", "r", (1, 3, 5))


def _vol_scale(n: int = 20) -> str:
    return f"coalesce(lag(case when vol is not null then greatest(0.0, least(5.0, 0.1 / (vol * {252**0.5!r}))) end) {over()}, 1.0)"


VOL = f"v1 as (select *, price / {lagged('price')} - 1 as returns from pos), v2 as (select *, greatest({roll('stddev_pop', 'returns', 20)}, 1e-12) as vol0, count(returns) {over(last(20))} as c from v1), v3 as (select *, case when c >= 20 then vol0 end as vol from v2), v4 as (select *, {_vol_scale()} as vol_scale from v3), v5 as (select *, greatest(-1.0, least(1.0, 10 * position * vol_scale)) as p from v4)"


@query("vol_target", sql(ITEMS, RETURNS, FEATURES, POSITIONS, VOL, out=final("v5", "instrument", "ts:t", "vol:d", "vol_scale:d", "p:d")))
def _(s, d):
    cfg = risk.VolTarget()
    out = position_panel(s, d).withColumn("returns", features.simple_return()).withColumn("vol", risk.rolling_vol("returns", cfg.window)).withColumn("vol_scale", risk.vol_scale("vol", cfg))
    return out.select("instrument", "ts", "vol", "vol_scale", risk.clip(10 * F.col("position") * F.col("vol_scale"), -1.0, 1.0).alias("p"))


@query("turnover", sql(ITEMS, RETURNS, FEATURES, POSITIONS, f"o as (select *, coalesce(abs(position - {lagged('position')}), 0) as turnover from pos)", out=final("o", "instrument", "ts:t", "turnover:d")))
def _(s, d):
    return position_panel(s, d).select("instrument", "ts", risk.turnover("position").alias("turnover"))


def guard_sql(scale: str) -> str:
    return sql(
        ITEMS, RETURNS, FEATURES, POSITIONS,
        f"g0 as (select *, price / {lagged('price')} - 1 as returns, row_number() {over()} as rn from pos), g1 as (select *, {lagged('position')} * returns as pnl from g0)",
        f"g2 as (select *, {compound('pnl')} as equity_proxy from g1), g3 as (select *, coalesce(1 - equity_proxy / nullif(max(equity_proxy) {over(PREFIX)}, 0), 0) as drawdown from g2)",
        f"g4 as (select *, max(case when drawdown >= 0.03 then rn end) {over(PREFIX)} as hit from g3), g5 as (select *, coalesce(rn - hit <= 3, false) as guard_active from g4)",
        f"g6 as (select *, {scale} as guard_scale from g5), g7 as (select instrument, ts, equity_proxy, drawdown, guard_active, guard_scale, position * guard_scale as position from g6)",
        out=final("g7", "instrument", "ts:t", "equity_proxy:d", "drawdown:d", "guard_active", "guard_scale:d", "position:d"),
    )


for _mode, _scale in (("flatten", "case when guard_active then 0.0 else 1.0 end"), ("linear_delever", "case when guard_active then 0.2 else greatest(0.2, least(1.0, 1 - drawdown / 0.03)) end")):
    query("drawdown_guard_" + {"flatten": "flatten", "linear_delever": "delever"}[_mode], guard_sql(_scale))(
        lambda s, d, m=_mode: risk.guarded(position_panel(s, d).withColumn("returns", features.simple_return()), risk.DrawdownGuard(0.03, m, 0.0 if m == "flatten" else 0.2, 3)).select("instrument", "ts", "equity_proxy", "drawdown", "guard_active", "guard_scale", "position")
    )


@query("cooldown", sql(ITEMS, RETURNS, f"c as (select *, max(case when s > 0.5 then rn end) {over(PREFIX)} as hit from ret), o as (select instrument, ts, coalesce(rn - hit <= 4, false) as active from c)", out=final("o", "instrument", "ts:t", "active")))
def _(s, d):
    out = items_panel(s, d).withColumn("hit", features.simple_return() > 0.5)
    return out.select("instrument", "ts", risk.cooldown("hit", 4).alias("active"))


VAR = f"v as (select *, case when count(s) {over(last(20))} >= 20 then quantile_cont(s, 0.05) {over(last(20))} end as var, list(s) {over(last(20))} as held from ret), e as (select *, case when var is not null then list_avg(list_filter(held, lambda x: x <= var)) end as es from v)"


@query("rolling_var", sql(ITEMS, RETURNS, VAR, out=final("v", "instrument", "ts:t", "var:d")))
def _(s, d):
    return risk.historical_var(items_panel(s, d).withColumn("s", features.simple_return()), "s", 20, 0.05).select("instrument", "ts", "var")


@query("rolling_es", sql(ITEMS, RETURNS, VAR, out=final("e", "instrument", "ts:t", "var:d", "es:d")))
def _(s, d):
    return risk.historical_es(items_panel(s, d).withColumn("s", features.simple_return()), "s", 20, 0.05).select("instrument", "ts", "var", "es")


@query("risk_overlay", sql(ITEMS, RETURNS, FEATURES, POSITIONS, VOL.replace("10 * position", "position"), f"o as (select *, coalesce(p, 0) as position_target, coalesce(abs(p - {lagged('p')}), 0) as turnover from v5)", out=final("o", "instrument", "ts:t", "returns:d", "vol:d", "vol_scale:d", "turnover:d", "position_target:d")))
def _(s, d):
    out = risk.overlay(position_panel(s, d), risk.RiskConfig(max_turnover=None))
    return out.select("instrument", "ts", "returns", "vol", "vol_scale", "turnover", "position_target")


#: The whole overlay: volatility target, smoothing, turnover cap, drawdown guard with cooldown, leverage bound.
CHAIN = (
    f"ch as (select *, row_number() {over()} as i from v5)",
    "rec(instrument, ts, i, e, y) as (select instrument, ts, i, p, p from ch where i = 1 union all select c.instrument, c.ts, c.i, 0.5 * c.p + 0.5 * rec.e, rec.y + least(greatest(0.5 * c.p + 0.5 * rec.e - rec.y, -0.002), 0.002) from rec join ch c on c.instrument = rec.instrument and c.i = rec.i + 1)",
    f"k0 as (select ch.*, rec.y as capped from ch join rec using (instrument, i)), k1 as (select *, coalesce(abs(capped - {lagged('capped')}), 0) as turn, {lagged('capped')} * returns as pnl, row_number() {over()} as rn from k0)",
    f"k2 as (select *, {compound('pnl')} as equity_proxy from k1), k3 as (select *, coalesce(1 - equity_proxy / nullif(max(equity_proxy) {over(PREFIX)}, 0), 0) as drawdown from k2)",
    f"k4 as (select *, max(case when drawdown >= 0.02 then rn end) {over(PREFIX)} as hit from k3), k5 as (select *, coalesce(rn - hit <= 5, false) as guard_active from k4)",
    "k6 as (select *, case when guard_active then 0.25 else greatest(0.25, least(1.0, 1 - drawdown / 0.02)) end as guard_scale from k5)",
    "o as (select instrument, ts, returns, vol, vol_scale, capped as position_capped, turn as turnover, equity_proxy, drawdown, guard_active, guard_scale, coalesce(greatest(-1.0, least(1.0, capped * guard_scale)), 0) as position_target from k6)",
)
OVERLAY = ("returns", "vol", "vol_scale", "position_capped", "turnover", "equity_proxy", "drawdown", "guard_scale", "position_target")


@query("risk_overlay_chain", recursive(ITEMS, RETURNS, FEATURES, POSITIONS, VOL.replace("10 * position", "position"), *CHAIN, out=final("o", "instrument", "ts:t", "guard_active", *(f"{c}:d" for c in OVERLAY))))
def _(s, d):
    guard = risk.DrawdownGuard(0.02, "linear_delever", 0.25, 5)
    return risk.overlay(position_panel(s, d), risk.RiskConfig(1.0, risk.VolTarget(), 0.002, 0.5, guard)).select("instrument", "ts", "guard_active", *OVERLAY)


BAR_COLUMNS = ("price", "position", "applied", "returns", "trade", "turnover", "costs", "gross", "pnl", "equity", "drawdown_neg", "cum_costs")


@query("backtest_bars", sql(ITEMS, RETURNS, FEATURES, POSITIONS, BARS, out=final("bars", "instrument", "ts:t", *(f"{c}:d" for c in BAR_COLUMNS))))
def _(s, d):
    return bar_panel(s, d).select("instrument", "ts", *BAR_COLUMNS)


SUMMARY = "a as (select instrument, count(*) as bars, arg_max(equity, ts) as final_equity, avg(pnl) as m, stddev_pop(pnl) * sqrt(252) as volatility, min(drawdown_neg) as max_drawdown, sum(turnover) as turnover, sum(costs) as costs from bars group by 1), o as (select *, final_equity - 1 as total_return, case when final_equity <= 0 then -1.0 else pow(final_equity, 252.0 / bars) - 1 end as cagr, coalesce(m * 252 / nullif(volatility, 0), 0) as sharpe from a)"


@query("backtest_summary", sql(ITEMS, RETURNS, FEATURES, POSITIONS, BARS, SUMMARY, out=final("o", "instrument", "bars:i", *(f"{c}:d" for c in ("final_equity", "total_return", "cagr", "volatility", "sharpe", "max_drawdown", "turnover", "costs")))))
def _(s, d):
    return backtest.summary(bar_panel(s, d), COSTS)


EVENTS = f"m as (select *, position <> {lagged('position')} as flip, greatest(max(costs) over (partition by instrument), 1e-12) as top, coalesce(min(drawdown_neg) over ({W} rows between unbounded preceding and 1 preceding), 0) as low from bars)"


@query("backtest_events", sql(ITEMS, RETURNS, FEATURES, POSITIONS, BARS, EVENTS, "o as (select instrument, ts, 'signal_flip' as event from m where flip union all select instrument, ts, 'cost_spike' from m where costs >= 0.8 * top union all select instrument, ts, 'drawdown_new_low' from m where drawdown_neg < least(low, 0))", out=final("o", "instrument", "ts:t", "event")))
def _(s, d):
    return backtest.events(bar_panel(s, d))


@query("backtest_checks", sql(ITEMS, RETURNS, FEATURES, POSITIONS, BARS, out="select instrument, cast(0 as bigint) as turnover_without_change, cast(0 as bigint) as costs_without_trade, cast(sum((pnl is null)::int) as bigint) as n_missing from bars group by 1"))
def _(s, d):
    return backtest.checks(bar_panel(s, d))


@query("run_slice", sql(ITEMS, RETURNS, FEATURES, POSITIONS, BARS, f"c as (select *, row_number() {over()} as k from bars where ts >= timestamp '1996-01-01' and ts <= timestamp '1996-12-31')", out=final("c where (k - 1) % 5 = 0", "instrument", "ts:t", "equity:d", "pnl:d")))
def _(s, d):
    return strategy.slice_run(bar_panel(s, d), "1996-01-01", "1996-12-31", 5).select("instrument", "ts", "equity", "pnl")


@query("run_trace", sql(ITEMS, RETURNS, FEATURES, POSITIONS, BARS, out=final("bars where ts = timestamp '1996-06-14'", "instrument", "ts:t", "price:d", "position:d", "applied:d", "pnl:d", "equity:d")))
def _(s, d):
    return strategy.trace(bar_panel(s, d), "1996-06-14").select("instrument", "ts", "price", "position", "applied", "pnl", "equity")


@query("run_diagnostics", sql(ITEMS, RETURNS, FEATURES, POSITIONS, BARS, "q as (select *, quantile_cont(turnover, 0.95) over (partition by instrument) as line from bars)", out="select instrument, count(*) as n_bars, cast(sum((turnover > line)::int) as bigint) as n_spikes, cast(sum((abs(applied) > 1)::int) as bigint) as n_breaches, cast(sum((applied <> 0)::int) as bigint) as n_active, round(sum(costs), 6) + 0.0 as costs from q group by 1"))
def _(s, d):
    return strategy.diagnostics(bar_panel(s, d))


#: Counts of the stages of a run with a limit of 0.5 on log returns and no duplicate left.
STAGES = (
    "k as (select instrument, ts, arg_max(price, seq) as price from hourly group by 1, 2)",
    f"o as (select *, ln(price) - {lagged('ln(price)')} as step from (select * from k))",
    "panel as (select instrument, date_trunc('day', ts) as ts, arg_max(price, ts) as price from o where price > 0 and (step is null or abs(step) <= 0.5) group by 1, 2)",
    RETURNS,
    FEATURES,
    "n as (select instrument, count(*) as raw from hourly group by 1), n1 as (select instrument, count(*) as times, sum((price <= 0)::int) as bad, sum((price > 0 and coalesce(abs(step) > 0.5, false))::int) as jumps from o group by 1)",
    "n2 as (select instrument, count(*) as buckets from panel group by 1), n3 as (select instrument, count(*) as feats from feats group by 1), n4 as (select p.instrument, count(*) as bars from panel p join feats f using (instrument, ts) group by 1)",
    "c as (select instrument, [raw, times, times - bad, times - bad - jumps, coalesce(buckets, 0), coalesce(feats, 0), coalesce(bars, 0)] as c from n join n1 using (instrument) left join n2 using (instrument) left join n3 using (instrument) left join n4 using (instrument))",
    f"s as (select instrument, unnest(range(1, 7)) as i, c from c), o2 as (select instrument, i as stage_no, {[a for a, _ in strategy.STAGES]}[i] as stage, c[i] as rows_in, c[i + 1] as rows_out, c[i] - c[i + 1] as dropped, {[b for _, b in strategy.STAGES]}[i] as reason from s)",
)


@query("run_stages", sql(HOURLY, *STAGES, out=final("o2", "instrument", "stage_no:i", "stage", "rows_in:i", "rows_out:i", "dropped:i", "reason")))
def _(s, d):
    cfg = strategy.StrategyConfig(clean=clean.CleanConfig(max_abs_log_return=0.5), features=SMALL, ensemble=Ensemble((Momentum(5), mean_reversion(5)), (0.6, 0.4)))
    return strategy.stage_report(hourly(s, d), cfg)


@query("run_overlap", sql(ITEMS, RETURNS, FEATURES, out="select p.instrument, count(*) as n_left, count(f.ts) as n_both, round(count(f.ts) / count(*), 6) + 0.0 as share from panel p left join feats f using (instrument, ts) group by 1"))
def _(s, d):
    return strategy.overlap(items_panel(s, d), feature_panel(s, d))


@query("strategy_run", sql(HOURLY.replace("hourly as", "hh as"), "panel as (select instrument, date_trunc('day', ts) as ts, arg_max(price, ts) as price from (select instrument, ts, arg_max(price, seq) as price from hh group by 1, 2) group by 1, 2)", RETURNS, FEATURES, "pos as (select p.instrument, p.ts, p.price, 0.2 * f.z_mom_5 as alpha, tanh(0.2 * f.z_mom_5) as position from panel p join feats f using (instrument, ts))", BARS, SUMMARY, out=final("o", "instrument", "bars:i", "final_equity:d", "volatility:d", "turnover:d")))
def _(s, d):
    cfg = strategy.StrategyConfig(clean=clean.CleanConfig(max_abs_log_return=None), features=SMALL, ensemble=Ensemble((Momentum(5), mean_reversion(5)), (0.6, 0.4)), risk=risk.RiskConfig(vol=None, max_turnover=None), backtest=COSTS)
    return strategy.run_strategy(hourly(s, d), cfg).summary.select("instrument", "bars", "final_equity", "volatility", "turnover")


@query("history_topn", sql("r as (select o_orderkey, o_orderdate, o_totalprice from orders order by o_orderdate desc, o_orderkey limit 25)", out="select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, round(o_totalprice, 6) + 0.0 as o_totalprice from r"))
def _(s, d):
    from quantloom.sources.store import clamp
    from quantloom.sources.tables import read_table

    return read_table(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(clamp(25)).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("history_store", sql("r as (select cast(o_orderkey as varchar) as record_id, o_orderdate as created_at, o_orderstatus as request, o_orderpriority as result from orders order by o_orderdate desc, cast(o_orderkey as varchar) limit 200)", out="select record_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, request, result from r"))
def _(s, d):
    from quantloom.functions.written import Rounds
    from quantloom.sources.store import RunStore
    from quantloom.sources.tables import read_table

    store = RunStore(s, Rounds(s).root)
    records = read_table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderstatus").alias("request"), F.col("o_orderpriority").alias("result"))
    store.save_frame("runs", records)
    return store.history("runs", 1000)


#: Each customer's orders as three arrays, in the order of their keys, so that times may fall or repeat.
ARRAYS = "a as (select o_custkey as instrument, list(o_orderdate order by o_orderkey) as t, list(case when o_totalprice > 400000 then null else o_totalprice end order by o_orderkey) as p, list(o_orderkey % 3 - 1 order by o_orderkey) as g from orders group by 1)"
CHECKED = (
    "b as (select *, len(t) as timestamp_count, len(t) - len(list_distinct(t)) as duplicate_timestamps, len(list_filter(range(2, len(t) + 1), lambda i: t[i] <= t[i - 1])) as non_monotonic_timestamps, len(list_filter(p, lambda v: v is null)) as nan_prices from a)",
    "c as (select *, 0 as nan_signals, case when duplicate_timestamps > 0 then 'duplicate timestamps' when non_monotonic_timestamps > 0 then 'timestamps do not rise' when nan_prices > 0 then 'prices are not finite' end as problem from b)",
)


def order_arrays(s, d, first="o_orderkey"):
    from quantloom.sources.tables import read_table

    rows = read_table(s, d, "orders").withColumn("_p", F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice")))
    packed = F.array_sort(F.collect_list(F.struct(F.col(first).alias("first"), "o_orderkey", F.col("o_orderdate").alias("t"), F.col("_p").alias("p"), (F.col("o_orderkey") % 3 - 1).alias("g"))))
    held = rows.groupBy(F.col("o_custkey").alias("instrument")).agg(packed.alias("z"))
    return held.select("instrument", F.col("z.t").alias("timestamps"), F.col("z.p").alias("prices"), F.col("z.g").alias("signals"))


@query("array_quality", sql(ARRAYS, *CHECKED, out="select instrument, timestamp_count::bigint as timestamp_count, duplicate_timestamps::bigint as duplicate_timestamps, non_monotonic_timestamps::bigint as non_monotonic_timestamps, nan_prices::bigint as nan_prices, nan_signals::bigint as nan_signals, problem from c"))
def _(s, d):
    return array_quality(order_arrays(s, d))


@query("array_panel", sql(ARRAYS.replace("order by o_orderkey", "order by o_orderdate, o_orderkey"), *CHECKED, "o as (select instrument, unnest(t) as ts, unnest(p) as price, unnest(g)::double as position, unnest(range(len(t))) as seq from c where problem is null)", out=final("o", "instrument", "ts:t", "price:d", "position:d", "seq:i")))
def _(s, d):
    raw = order_arrays(s, d, "o_orderdate")
    sound = array_quality(raw).filter("problem is null").select("instrument")
    return arrays_to_panel(raw.join(sound, "instrument", "left_semi"))


@query("ingest_quality", sql(HOURLY, out="select instrument, count(*) as n_rows, count(distinct ts) as n_times, count(*) - count(distinct ts) as n_duplicates, cast(sum((price <= 0)::int) as bigint) as n_invalid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts from hourly group by 1"))
def _(s, d):
    return strategy.ingest_report(hourly(s, d))[0]


@query("ingest_preview", sql(HOURLY, "k as (select *, row_number() over (partition by instrument order by ts desc, seq desc) as k from hourly)", out=final("k where k <= 10", "instrument", "ts:t", "price:d", "seq")))
def _(s, d):
    return strategy.ingest_report(hourly(s, d))[1]


@query("cusum", recursive(ITEMS, STEPS, f"x as (select instrument, ts, i, coalesce(ln(price) - lag(ln(price)) over ({W}), 0) as v from steps)", "rec(instrument, ts, i, up, down, flag) as (select instrument, ts, i, 0.0::double, 0.0::double, 0 from x where i = 1 union all select instrument, ts, i, case when a > 0.8 or b < -0.8 then 0.0 else a end, case when a > 0.8 or b < -0.8 then 0.0 else b end, case when a > 0.8 or b < -0.8 then 1 else 0 end from (select x.instrument, x.ts, x.i, greatest(0.0, rec.up + x.v - 0.02) as a, least(0.0, rec.down + x.v + 0.02) as b from rec join x on x.instrument = rec.instrument and x.i = rec.i + 1))", out=final("rec", "instrument", "ts:t", "flag:i")))
def _(s, d):
    from quantloom.operators import regimes

    return regimes.cusum(items_panel(s, d).withColumn("v", features.log_return()), "v", 0.8, 0.02, DAILY_BUCKET)


@query("sequential_passthrough", sql(ITEMS, STEPS, out=final("steps", "instrument", "ts:t", "price:d")))
def _(s, d):
    return sequential.run_kernel(items_panel(s, d), ["price"], ["price"], lambda v: (v,), keep=("instrument", "ts"))


@query("feature_shift", sql(ITEMS, RETURNS, FEATURES, f"o as (select instrument, ts, {lagged('z_mom_5', 2)} as z from feats)", out=final("o", "instrument", "ts:t", "z:d")))
def _(s, d):
    return feature_panel(s, d).select("instrument", "ts", lag("z_mom_5", 2).alias("z"))


@query("market_returns", sql(MARKET.replace("market as", "panel as"), RETURNS, out=final("ret", "instrument", "ts:t", "s:d")))
def _(s, d):
    return market_panel(s, d).select("instrument", "ts", features.simple_return().alias("s"))


@query("equity_curve", sql(ITEMS, RETURNS, f"o as (select instrument, ts, exp(sum(ln(1 + coalesce(s, 0))) {over(PREFIX)}) as equity from ret)", out=final("o", "instrument", "ts:t", "equity:d")))
def _(s, d):
    from quantloom.operators import evaluate

    return evaluate.equity_curve(items_panel(s, d).withColumn("s", features.simple_return()), "s").select("instrument", "ts", "equity")


@query("pseudo_price", sql(ITEMS, RETURNS, f"o as (select instrument, ts, exp(sum(ln(1 + coalesce(s, 0))) {over(PREFIX)}) as price from ret)", out=final("o", "instrument", "ts:t", "price:d")))
def _(s, d):
    return items_panel(s, d).withColumn("s", features.simple_return()).select("instrument", "ts", features.pseudo_price("s").alias("price"))


@query("decay_filled", sql(ITEMS, RETURNS, f"k as (select instrument, ts, case when s < 0 then null else s end as x from ret), m as (select *, sum(coalesce(x, 0.1)) {over('rows between 2 preceding and current row')} / 3 as d from k), o as (select instrument, ts, coalesce({lagged('d', 2)}, 0.1) as x_decay from m)", out=final("o", "instrument", "ts:t", "x_decay:d")))
def _(s, d):
    kept = items_panel(s, d).withColumn("s", features.simple_return()).withColumn("x", F.when(F.col("s") < 0, None).otherwise(F.col("s")))
    return decay.apply_decay(kept, "x", decay.DecayConfig("step", window=3, fill=0.1, shift=2))


@query("late_nulls", sql(ITEMS, RETURNS, "o as (select instrument, sum((rn > 1 and (s is null or s > 0.5))::int) as n_late_nulls from ret group by 1)", out=final("o", "instrument", "n_late_nulls:i")))
def _(s, d):
    return risk.late_nulls(items_panel(s, d).withColumn("s", features.simple_return()).withColumn("returns", F.when(F.col("s") <= 0.5, F.col("s"))))


@query("overlay_without_guard", sql(ITEMS, RETURNS, FEATURES, POSITIONS, f"g as (select *, price / {lagged('price')} - 1 as q from pos), o as (select instrument, ts, exp(sum(ln(1 + coalesce(q, 0))) {over(PREFIX)}) as equity_proxy, 0.0::double as drawdown, greatest(-1.0, least(1.0, position)) as position_target from g)", out=final("o", "instrument", "ts:t", "equity_proxy:d", "drawdown:d", "position_target:d")))
def _(s, d):
    out = risk.overlay(position_panel(s, d), risk.RiskConfig(vol=None, smooth_alpha=None, max_turnover=None, guard=None, max_leverage=1.0))
    return out.select("instrument", "ts", "equity_proxy", "drawdown", "position_target")
