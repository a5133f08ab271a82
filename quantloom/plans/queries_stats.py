"""Queries over statistics of series: evaluation, information, drift, regimes, labels and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import evaluate, features, information, meta, regimes, stationarity
from quantloom.plans import reports, strategy
from quantloom.plans.queries_bars import REGIME_FEATURES, SMALL, bar_panel, feature_panel
from quantloom.plans.registry import query
from quantloom.plans.sql import BARS, FEATURES, ITEMS, KEYS, LONG, MARKET, ORDERS, POSITIONS, PREFIX, RANKED, RETURNS, W, binned, corr, final, mi_table, normal_cdf, normal_ppf, over, roll
from quantloom.plans.sql import query as sql
from quantloom.sources.panels import items_panel, market_panel, orders_panel

YEAR = 252**0.5
RUN = (ITEMS, RETURNS, FEATURES, POSITIONS, BARS)


def long_panel(s: SparkSession, d: str) -> DataFrame:
    """Three features in long form against the next 3-bar return."""
    rows = items_panel(s, d).withColumn("r", features.log_return()).withColumn("y", features.forward_return("r", 3))
    return information.unpivot(features.build_features(rows, SMALL, ("y",)), ["mom_5", "rv_5", "z_mom_5"])


PERF = (
    "a as (select instrument, count(pnl) as n, arg_max(equity, ts) / arg_min(equity, ts) - 1 as total_return, stddev_pop(pnl) * sqrt(252) as vol_annual, avg(pnl) as m, stddev_pop(pnl) as sd, sqrt(avg(least(pnl, 0) * least(pnl, 0))) as down, "
    "avg((pnl > 0)::double) as hit_rate, coalesce(avg(case when pnl > 0 then pnl end), 0) as avg_win, coalesce(avg(case when pnl < 0 then pnl end), 0) as avg_loss, sum(case when pnl > 0 then pnl else 0 end) / nullif(abs(sum(case when pnl < 0 then pnl else 0 end)), 0) as profit_factor, "
    "avg(abs(applied)) as exposure_mean, avg((applied <> 0)::double) as exposure_share, max(abs(applied)) as exposure_max from bars group by 1), "
    "o as (select *, case when 1 + total_return > 0 then pow(1 + total_return, 252.0 / n) - 1 end as cagr, coalesce(m / nullif(sd, 0) * sqrt(252), 0) as sharpe, coalesce(m / nullif(down, 0) * sqrt(252), 0) as sortino from a)"
)
PERF_COLUMNS = ("total_return", "vol_annual", "hit_rate", "avg_win", "avg_loss", "profit_factor", "exposure_mean", "exposure_share", "exposure_max", "cagr", "sharpe", "sortino")


def performance(s, d):
    return evaluate.performance(bar_panel(s, d), "pnl", equity="equity", position="applied")


@query("performance_metrics", sql(*RUN, PERF, out=final("o", "instrument", "n:i", *(f"{c}:d" for c in PERF_COLUMNS))))
def _(s, d):
    return performance(s, d)


DRAWN = (
    f"u as (select instrument, ts, coalesce(1 - equity / nullif(max(equity) {over(PREFIX)}, 0), 0) as u from bars), "
    f"i as (select *, row_number() {over()} - sum((u > 0)::int) {over(PREFIX)} as island from u), "
    "r as (select instrument, island, cast(sum((u > 0)::int) as bigint) as run from i group by all), "
    "dd as (select u.instrument, max(u.u) as max_drawdown, sqrt(avg(u.u * u.u)) as ulcer_index, (select max(run) from r where r.instrument = u.instrument) as longest_under_water from u group by u.instrument)"
)


@query("drawdown_metrics", sql(*RUN, DRAWN, out=final("dd", "instrument", "max_drawdown:d", "longest_under_water:i", "ulcer_index:d")))
def _(s, d):
    return evaluate.drawdowns(bar_panel(s, d))


@query("calmar", sql(*RUN, PERF, DRAWN, "c as (select instrument, cagr / nullif(max_drawdown, 0) as calmar from o join dd using (instrument))", out=final("c", "instrument", "calmar:d")))
def _(s, d):
    return evaluate.calmar(performance(s, d), evaluate.drawdowns(bar_panel(s, d))).select("instrument", "calmar")


DIST = "q as (select *, quantile_cont(s, 0.01) over (partition by instrument) as v from ret), o as (select instrument, skewness(s) as skew, kurtosis(s) as excess_kurtosis, kurtosis(s) + 3 as kurtosis, first(v) as var_1pct, avg(case when s <= v then s end) as es_1pct, abs(quantile_cont(s, 0.95)) / nullif(abs(quantile_cont(s, 0.05)), 0) as tail_ratio, max(s) as best, min(s) as worst from q group by 1)"


def simple(s, d, panel=items_panel):
    return panel(s, d).withColumn("s", features.simple_return())


@query("distribution_metrics", sql(ITEMS, RETURNS, DIST, out=final("o", "instrument", *(f"{c}:d" for c in ("skew", "excess_kurtosis", "kurtosis", "var_1pct", "es_1pct", "tail_ratio", "best", "worst")))))
def _(s, d):
    return evaluate.distribution(simple(s, d), "s")


@query("percentile_table", sql(ITEMS, RETURNS, "o as (select instrument, unnest([1, 5, 10, 50, 90, 95, 99]) as percentile, unnest(quantile_cont(s, [0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99])) as value from ret group by 1)", out=final("o", "instrument", "percentile:i", "value:d")))
def _(s, d):
    return evaluate.percentile_table(simple(s, d), "s")


BENCH = f"m as (select ts, price / lag(price) over (order by ts) - 1 as b from market), j as (select ret.instrument, ret.s as r, m.b from ret join m using (ts) where ret.s is not null and m.b is not null), a as (select instrument, stddev_pop(r - b) * {YEAR!r} as tracking_error, avg(r - b) / nullif(stddev_pop(r - b), 0) * {YEAR!r} as information_ratio, covar_pop(r, b) / nullif(var_pop(b), 0) as beta, avg(r) as mr, avg(b) as mb, {corr('r', 'b')} as c from j group by 1), o as (select *, mr - beta * mb as alpha, c * c as r2 from a)"


@query("benchmark_regression", sql(ORDERS, MARKET, RETURNS, BENCH, out=final("o", "instrument", *(f"{c}:d" for c in ("tracking_error", "information_ratio", "beta", "alpha", "r2")))))
def _(s, d):
    market = simple(s, d, market_panel).select("ts", F.col("s").alias("b"))
    return evaluate.benchmark(simple(s, d, orders_panel).join(market, "ts"), "s", "b")


ROLL_NAMES = [f"{k}_{n}" for n in (20, 60, 252) for k in ("mean", "vol", "sharpe")]
ROLL = "r1 as (select *, " + ", ".join(f"{roll('avg', 'pnl', n)} as mean_{n}, ({roll('stddev_pop', 'pnl', n)}) * {YEAR!r} as vol_{n}" for n in (20, 60, 252)) + " from bars), r2 as (select *, " + ", ".join(f"mean_{n} * 252 / nullif(vol_{n}, 0) as sharpe_{n}" for n in (20, 60, 252)) + " from r1)"


@query("rolling_metrics", sql(*RUN, ROLL, out=final("r2", "instrument", "ts:t", *(f"{c}:d" for c in ROLL_NAMES))))
def _(s, d):
    return evaluate.rolling_metrics(bar_panel(s, d), (20, 60, 252), "pnl")


@query("stability", sql(*RUN, ROLL, "o as (select instrument, avg((sharpe_252 > 0)::double) as share_positive, quantile_cont(sharpe_252, 0.1) as p10, quantile_cont(sharpe_252, 0.5) as p50, quantile_cont(sharpe_252, 0.9) as p90 from r2 where sharpe_252 is not null group by 1)", out=final("o", "instrument", "share_positive:d", "p10:d", "p50:d", "p90:d")))
def _(s, d):
    return evaluate.stability(evaluate.rolling_metrics(bar_panel(s, d), (252,), "pnl"), "sharpe_252")


PSR = f"x as (select instrument, count(s) as n, avg(s) / nullif(stddev_pop(s), 0) as sharpe, skewness(s) as skew, kurtosis(s) + 3 as kurt from ret group by 1), y as (select *, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe as spread from x), z as (select *, case when spread > 0 then sqrt(spread) end as root from y), zz as (select *, sharpe * sqrt(n - 1) / root as z0, (sharpe - ({normal_ppf('0.9')}) * root / sqrt(n - 1)) * sqrt(n - 1) / root as z1 from z), o as (select instrument, {normal_cdf('z0')} as psr, {normal_cdf('z1')} as dsr from zz)"


@query("psr_dsr", sql(ITEMS, RETURNS, PSR, out=final("o", "instrument", "psr:d", "dsr:d")))
def _(s, d):
    base = simple(s, d)
    n = evaluate.performance(base, "s", periods=None).select("instrument", "n", "sharpe")
    return evaluate.psr_dsr(n.join(evaluate.distribution(base, "s"), "instrument"), 10).select("instrument", "psr", "dsr")


@query("hac_sharpe", sql(*RUN, f"p as (select instrument, pnl as r, lag(pnl) {over()} as q from bars), a as (select instrument, avg(r) / nullif(stddev_pop(r), 0) * {YEAR!r} as sharpe from p group by 1), c as (select instrument, {corr('r', 'q')} as rho from p where q is not null and r is not null group by 1), o as (select instrument, sharpe, rho, case when rho > 0 and rho < 1 then sharpe * sqrt((1 - rho) / (1 + rho)) else sharpe end as hac_sharpe from a join c using (instrument))", out=final("o", "instrument", "sharpe:d", "rho:d", "hac_sharpe:d")))
def _(s, d):
    return evaluate.hac_sharpe(bar_panel(s, d), "pnl")


KPSS_LAGS = 8
KPSS = (
    "e0 as (select instrument, ts, price - avg(price) over (partition by instrument) as e from panel), "
    f"e1 as (select *, sum(e) {over(PREFIX)} as c, {', '.join(f'e * lag(e, {k}) {over()} as c{k}' for k in range(1, KPSS_LAGS + 1))} from e0), "
    f"o as (select instrument, count(*) as n, sum(c * c) / (count(*) * count(*) * (sum(e * e) / count(*) + {' + '.join(f'2 * {1 - k / (KPSS_LAGS + 1)!r} * coalesce(sum(c{k}), 0) / count(*)' for k in range(1, KPSS_LAGS + 1))})) as kpss from e1 group by 1), "
    "k as (select *, case when kpss <= 0.347 then 0.10 when kpss <= 0.463 then 0.10 + (kpss - 0.347) / (0.463 - 0.347) * (0.05 - 0.10) when kpss <= 0.574 then 0.05 + (kpss - 0.463) / (0.574 - 0.463) * (0.025 - 0.05) when kpss <= 0.739 then 0.025 + (kpss - 0.574) / (0.739 - 0.574) * (0.01 - 0.025) else 0.01 end as p_value from o)"
)


@query("kpss_stat", sql(ITEMS, KPSS, out=final("k", "instrument", "n:i", "kpss:d", "p_value:d")))
def _(s, d):
    return stationarity.kpss(items_panel(s, d), "price", KPSS_LAGS)


#: Both tests in SQL: Gram matrices as lists, swept column by column; what is left of the step's square gives each AIC.
STATIONARITY = (
    "e0 as (select instrument, ts, price - avg(price) over (partition by instrument) as e, row_number() over (partition by instrument order by ts) as i, count(*) over (partition by instrument) as n from panel)",
    f"e1 as (select *, e - lag(e) over ({W}) as d, lag(e) over ({W}) as before from e0)",
    f"e2 as (select *, list_reverse(list(d) over ({W} rows between 60 preceding and 1 preceding)) as ds, least(ceil(12 * (n / 100) ** 0.25), n // 2 - 2)::int as most from e1)",
    "g1 as (select instrument, most, [1.0, before] || ds[1:most] || [d] as v from e2 where i > most + 1)",
    "c1 as (select instrument, most, a, b, sum(v[a] * v[b]) as g from g1, range(1, 70) r(a), range(1, 70) s(b) where a <= most + 3 and b <= most + 3 group by all)",
    "m1 as (select instrument, most, list(l order by a) as m from (select instrument, most, a, list(g order by b) as l from c1 group by all) group by all)",
    "w1(instrument, most, k, m, rows) as (select instrument, most, 0, m, m[1][1] from m1 union all select instrument, most, k + 1, list_transform(m, lambda x, i: case when i <= k + 1 then x else list_transform(x, lambda y, j: y - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end), rows from w1 where k < most + 2)",
    "aic as (select instrument, k - 2 as used, rows * ln(m[most + 3][most + 3] / rows) + 2 * k as aic from w1 where k >= 2)",
    "best as (select instrument, {used} as used from aic group by 1)",
    "g2 as (select instrument, used, [1.0] || ds[1:used] || [before, d] as v from e2 join best using (instrument) where i > used + 1)",
    "c2 as (select instrument, used, a, b, sum(v[a] * v[b]) as g from g2, range(1, 70) r(a), range(1, 70) s(b) where a <= used + 3 and b <= used + 3 group by all)",
    "m2 as (select instrument, used, list(l order by a) as m from (select instrument, used, a, list(g order by b) as l from c2 group by all) group by all)",
    "w2(instrument, used, k, m, rows) as (select instrument, used, 0, m, m[1][1] from m2 union all select instrument, used, k + 1, list_transform(m, lambda x, i: case when i <= k + 1 then x else list_transform(x, lambda y, j: y - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end), rows from w2 where k < used + 1)",
    "t as (select instrument, used, rows, m[used + 2][used + 3] / sqrt((m[used + 3][used + 3] * m[used + 2][used + 2] - m[used + 2][used + 3] ** 2) / (rows - used - 2)) as stat from w2 where k = used + 1)",
    "p0 as materialized (select a.instrument, a.n, k, sum(a.e * b.e) as c from e0 a, range(0, 60) r(k), e0 b where b.instrument = a.instrument and b.i = a.i - k group by all)",
    "p1 as (select instrument, n, sum(case when k = 0 then c / n when k <= floor(n ** (2.0 / 9)) then c / (n / 2) end) as s0, sum(case when k between 1 and floor(n ** (2.0 / 9)) then k * c / (n / 2) end) as s1 from p0 group by 1, 2)",
    "p2 as (select instrument, n, {held} as held from p1)",
    "p3 as (select instrument, n, held, sum(case when k = 0 then c when k <= held then 2 * (1 - k / (held + 1)) * c end) / n as spread from p0 join p2 using (instrument, n) group by instrument, n, held)",
    "q as (select instrument, sum(s * s) as q from (select instrument, sum(e) over (partition by instrument order by ts) as s from e0) group by 1)",
    f"o0 as (select t.*, {normal_cdf('case when stat <= -1.61 then 2.1659 + 1.4412 * stat + 0.038269 * stat ** 2 else 1.7339 + 0.93202 * stat - 0.12745 * stat ** 2 - 0.010368 * stat ** 3 end')} as pvalue, q.q / n / n / spread as kpss, held from t join p3 using (instrument) join q using (instrument))",
    "o as (select instrument, stat as adf_stat, case when stat > 2.74 then 1.0 when stat < -18.83 then 0.0 else pvalue end as adf_pvalue, used as adf_usedlag, rows as adf_nobs, -3.43035 - 6.5393 / rows - 16.786 / rows ** 2 - 79.433 / rows ** 3 as adf_crit_1pct, -2.86154 - 2.8903 / rows - 4.234 / rows ** 2 - 40.040 / rows ** 3 as adf_crit_5pct, -2.56677 - 1.5384 / rows - 2.809 / rows ** 2 as adf_crit_10pct, kpss as kpss_stat, "
    "case when kpss <= 0.347 then 0.10 when kpss <= 0.463 then 0.10 + (kpss - 0.347) / (0.463 - 0.347) * (0.05 - 0.10) when kpss <= 0.574 then 0.05 + (kpss - 0.463) / (0.574 - 0.463) * (0.025 - 0.05) when kpss <= 0.739 then 0.025 + (kpss - 0.574) / (0.739 - 0.574) * (0.01 - 0.025) else 0.01 end as kpss_pvalue, held as kpss_lags, 0.347 as kpss_crit_10pct, 0.463 as kpss_crit_5pct, 0.574 as kpss_crit_2_5pct, 0.739 as kpss_crit_1pct from o0)",
)
REPORT = ("adf_stat:d", "adf_pvalue:d", "adf_usedlag:i", "adf_nobs:i", "adf_crit_1pct:d", "adf_crit_5pct:d", "adf_crit_10pct:d", "kpss_stat:d", "kpss_pvalue:d", "kpss_lags:i", "kpss_crit_10pct:d", "kpss_crit_5pct:d", "kpss_crit_2_5pct:d", "kpss_crit_1pct:d")


def stationarity_sql(used: str, held: str) -> str:
    return "with recursive " + ",\n".join([ITEMS, *(c.replace("{used}", used).replace("{held}", held) for c in STATIONARITY)]) + "\n" + final("o", "instrument", *REPORT)


@query("stationarity_report", stationarity_sql("arg_min(used, aic)", "least(floor(1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3) * n ** (1.0 / 3)), n - 1)::int"))
def _(s, d):
    return stationarity.stationarity_report(items_panel(s, d), "price", chunk_rows=1000).drop("adf_stationary", "kpss_stationary")


@query("adf_stat", stationarity_sql("2", f"{KPSS_LAGS}"))
def _(s, d):
    return stationarity.stationarity_report(items_panel(s, d), "price", KPSS_LAGS, 2).drop("adf_stationary", "kpss_stationary")


L = (ITEMS, RETURNS, FEATURES, LONG)


@query("ic_pearson", sql(*L, f"o as (select {KEYS}, {corr('x', 'y')} as ic, count(*) as n from long where x is not null and y is not null group by all)", out=final("o", "instrument", "feature", "ic:d", "n:i")))
def _(s, d):
    return information.ic(long_panel(s, d))


AHEAD = ", ".join(f"{{'horizon': {h}, 'y': case when count(*) {over(f'rows between 1 following and {h} following')} >= {h} then sum(coalesce(r, 0)) {over(f'rows between 1 following and {h} following')} end}}" for h in (1, 3, 5))
SPREAD = (
    f"ah as (select instrument, ts, unnest([{AHEAD}]) as f from ret), hz as (select p.instrument, h.f.horizon as horizon, p.z_mom_5 as x, h.f.y as y from feats p join ah h using (instrument, ts) where h.f.y is not null), "
    "rk as (select instrument, horizon, rank() over (partition by instrument, horizon order by x) + (count(*) over (partition by instrument, horizon, x) - 1) / 2.0 as x, rank() over (partition by instrument, horizon order by y) + (count(*) over (partition by instrument, horizon, y) - 1) / 2.0 as y from hz), "
    f"o as (select instrument, horizon, {corr('x', 'y')} as ic, count(*) as n from rk group by all)"
)


@query("ic_decay_spearman", sql(ITEMS, RETURNS, FEATURES, SPREAD, out=final("o", "instrument", "horizon:i", "ic:d", "n:i")))
def _(s, d):
    rows = returns_panel(s, d).select("instrument", "ts", "r").join(feature_panel(s, d).select("instrument", "ts", "z_mom_5"), ["instrument", "ts"], "left")
    return information.ic_decay(rows, "z_mom_5", "r", (1, 3, 5))


@query("ic_spearman", sql(*L, RANKED, f"o as (select {KEYS}, {corr('x', 'y')} as ic, count(*) as n from ranked group by all)", out=final("o", "instrument", "feature", "ic:d", "n:i")))
def _(s, d):
    return information.ic(long_panel(s, d), "spearman")


FRAME = f"partition by {KEYS} order by ts rows between 59 preceding and current row"
IC_ROLL = f"fr as (select * from long where x is not null and y is not null), ir as (select {KEYS}, ts, {corr('x', 'y', FRAME)} as ic, count(*) over ({FRAME}) as n from fr), ics as (select {KEYS}, ts, ic from ir where n >= 60)"


@query("ic_rolling", sql(*L, IC_ROLL, out=final("ics", "instrument", "feature", "ts:t", "ic:d")))
def _(s, d):
    return information.ic_rolling(long_panel(s, d), 60)


SPEARMAN_ROLL = (
    f"fr as (select *, row_number() over (partition by {KEYS} order by ts) as i from long where x is not null and y is not null), "
    "w as (select a.instrument, a.feature, a.ts, a.i, b.x, b.y from fr a join fr b on a.instrument = b.instrument and a.feature = b.feature and b.i between a.i - 19 and a.i where a.i >= 20), "
    "k as (select *, rank() over (partition by instrument, feature, i order by x) + (count(*) over (partition by instrument, feature, i, x) - 1) / 2.0 as rx, rank() over (partition by instrument, feature, i order by y) + (count(*) over (partition by instrument, feature, i, y) - 1) / 2.0 as ry from w), "
    f"o as (select {KEYS}, ts, {corr('rx', 'ry')} as ic from k group by all)"
)


@query("ic_rolling_spearman", sql(*L, SPEARMAN_ROLL, out=final("o", "instrument", "feature", "ts:t", "ic:d")))
def _(s, d):
    return information.ic_rolling(long_panel(s, d), 20, "spearman")


NW = (
    f"d0 as (select *, ic - avg(ic) over (partition by {KEYS}) as e from ics where ic is not null), "
    f"d1 as (select *, {', '.join(f'e * lag(e, {k}) over (partition by {KEYS} order by ts) as c{k}' for k in (1, 2, 3))} from d0), "
    f"d2 as (select {KEYS}, avg(ic) as ic_mean, stddev_samp(ic) as ic_std, sum(e * e) / count(*) + {' + '.join(f'2 * {1 - k / 4!r} * coalesce(sum(c{k}), 0) / count(*)' for k in (1, 2, 3))} as v, count(*) as n from d1 group by all), "
    f"d3 as (select *, ic_mean / nullif(ic_std, 0) as ic_ir, ic_mean / nullif(sqrt(greatest(v, 0) / n), 0) as t_stat from d2), d4 as (select *, 2 * (1 - ({normal_cdf('abs(t_stat)')})) as pvalue from d3)"
)
NW_COLUMNS = ("ic_mean:d", "ic_std:d", "ic_ir:d", "t_stat:d", "pvalue:d", "n:i")


def ic_report(s, d):
    return information.ic_stats(information.ic_rolling(long_panel(s, d), 60), 3)


@query("ic_stats_nw", sql(*L, IC_ROLL, NW, out=final("d4", "instrument", "feature", *NW_COLUMNS)))
def _(s, d):
    return ic_report(s, d)


@query("bh_fdr", sql(*L, IC_ROLL, NW, "rk as (select *, row_number() over (partition by instrument order by pvalue nulls last, feature) as rk, count(pvalue) over (partition by instrument) as m from d4), mx as (select *, max(case when pvalue <= 0.05 * rk / m then rk end) over (partition by instrument) as top from rk), o as (select instrument, feature, pvalue, coalesce(rk <= top and pvalue is not null, false) as significant from mx)", out=final("o", "instrument", "feature", "pvalue:d", "significant")))
def _(s, d):
    return information.bh_fdr(ic_report(s, d)).select("instrument", "feature", "pvalue", "significant")


REGIME = "rg as (select *, case when r > 0 then 1 else 0 end as regime from ret), lr as (select long.*, rg.regime from long join rg using (instrument, ts))"


def long_regimes(s, d):
    marks = items_panel(s, d).withColumn("r", features.log_return()).select("instrument", "ts", F.when(F.col("r") > 0, 1).otherwise(0).alias("regime"))
    return long_panel(s, d).join(marks, ["instrument", "ts"])


@query("ic_by_regime", sql(*L, REGIME, f"o as (select {KEYS}, regime, {corr('x', 'y')} as ic, count(*) as n from lr where x is not null and y is not null group by all)", out=final("o", "instrument", "feature", "regime:i", "ic:d", "n:i")))
def _(s, d):
    return information.ic(long_regimes(s, d), keys=("instrument", "feature", "regime"))


@query("mi_hist", sql(*L, binned("long", 10), mi_table("binned", KEYS), out=final("mi_t", "instrument", "feature", "mi:d")))
def _(s, d):
    return information.mi_hist(long_panel(s, d))


@query("mi_hist_width", sql(*L, f"wb as (select *, case when x is not null then greatest(0, coalesce(ceil((x - min(x) over (partition by {KEYS})) / nullif(max(x) over (partition by {KEYS}) - min(x) over (partition by {KEYS}), 0) * 10) - 1, 0)) end as b_x, case when y is not null then greatest(0, coalesce(ceil((y - min(y) over (partition by {KEYS})) / nullif(max(y) over (partition by {KEYS}) - min(y) over (partition by {KEYS}), 0) * 10) - 1, 0)) end as b_y from long)", mi_table("wb", KEYS), out=final("mi_t", "instrument", "feature", "mi:d")))
def _(s, d):
    return information.mi_hist(long_panel(s, d), 10, "width")


COPULA = f"nn as (select {KEYS}, count(*) as n from ranked group by all), ns as (select instrument, feature, {normal_ppf('((x - 0.5) / n)')} as x, {normal_ppf('((y - 0.5) / n)')} as y from ranked join nn using (instrument, feature)), rho as (select {KEYS}, {corr('x', 'y')} as rho from ns group by all), o as (select instrument, feature, -0.5 * ln(1 - pow(greatest(-0.999999, least(0.999999, rho)), 2)) as mi from rho)"


@query("mi_copula", sql(*L, RANKED, COPULA, out=final("o", "instrument", "feature", "mi:d")))
def _(s, d):
    return information.mi_copula(long_panel(s, d))


@query("conditional_mi", sql(*L, REGIME, "lc as (select * from lr where x is not null and y is not null)", binned("lc", 10, KEYS + ", regime"), mi_table("binned", KEYS + ", regime"), f"o as (select {KEYS}, sum(mi * n) / sum(n) as cmi from mi_t join (select {KEYS}, regime, count(*) as n from lc group by all) using (instrument, feature, regime) group by all)", out=final("o", "instrument", "feature", "cmi:d")))
def _(s, d):
    return information.conditional_mi(long_regimes(s, d))


PAIRS = f"{binned('long', 10, KEYS, ('x',))}, pr as (select a.instrument, a.feature as f1, b.feature as f2, a.b_x as b1, b.b_x as b2 from binned a join binned b on a.instrument = b.instrument and a.ts = b.ts and a.feature < b.feature)"


@query("pairwise_mi", sql(*L, PAIRS, mi_table("pr", "instrument, f1, f2", "b1", "b2"), "o as (select * from mi_t union all select instrument, f2, f1, mi from mi_t union all select distinct instrument, feature, feature, 0.0 from long)", out=final("o", "instrument", "f1", "f2", "mi:d")))
def _(s, d):
    return information.pairwise_mi(long_panel(s, d))


#: Two picks: the greatest relevance, then the greatest relevance less what is shared with the first.
MRMR = (
    binned("long", 10),
    mi_table("binned", KEYS, name="rel"),
    "pr as (select a.instrument, a.feature as f1, b.feature as f2, a.b_x as b1, b.b_x as b2 from binned a join binned b on a.instrument = b.instrument and a.ts = b.ts and a.feature < b.feature)",
    mi_table("pr", "instrument, f1, f2", "b1", "b2", "red"),
    "p1 as (select instrument, feature, mi as score from rel_t qualify row_number() over (partition by instrument order by mi desc, feature) = 1)",
    "p2 as (select r.instrument, r.feature, r.mi - coalesce(d.mi, 0) as score from rel_t r join p1 on r.instrument = p1.instrument and r.feature <> p1.feature left join red_t d on d.instrument = r.instrument and d.f1 = least(r.feature, p1.feature) and d.f2 = greatest(r.feature, p1.feature))",
    "o as (select instrument, 1 as rank, feature, score from p1 union all select instrument, 2, feature, score from p2 qualify row_number() over (partition by instrument order by score desc, feature) = 1)",
)


@query("mrmr", sql(*L, *MRMR, out=final("o", "instrument", "rank:i", "feature", "score:d")))
def _(s, d):
    return information.mrmr(long_panel(s, d), 2)


@query("entropy", sql(*L, binned("long", 10, KEYS, ("x",)), f"c as (select {KEYS}, b_x, count(*)::double as n from binned where b_x is not null group by all), p as (select *, n / sum(n) over (partition by {KEYS}) as p from c), o as (select {KEYS}, -sum(p * ln(p)) as entropy from p group by all)", out=final("o", "instrument", "feature", "entropy:d")))
def _(s, d):
    return information.entropy(long_panel(s, d))


@query("joint_entropy", sql(*L, binned("long", 10), f"c as (select {KEYS}, b_x, b_y, count(*)::double as n from binned where b_x is not null and b_y is not null group by all), p as (select *, n / sum(n) over (partition by {KEYS}) as p from c), o as (select {KEYS}, -sum(p * ln(p + 1e-12)) as entropy from p group by all)", out=final("o", "instrument", "feature", "entropy:d")))
def _(s, d):
    return information.joint_entropy(long_panel(s, d))


@query("surprisal", sql(*L, binned("long", 10, KEYS, ("x",)), f"o as (select {KEYS}, ts, -ln(count(*) over (partition by {KEYS}, b_x) / cast(count(*) over (partition by {KEYS}) as double)) as surprisal from binned where b_x is not null)", out=final("o", "instrument", "feature", "ts:t", "surprisal:d")))
def _(s, d):
    return information.surprisal(long_panel(s, d))


DRIFT_SHARES = ", ".join(repr(k / 10) for k in range(11))
DRIFT = (
    "tr as (select * from long where ts < timestamp '1998-01-01'), lv as (select * from long where ts >= timestamp '1998-01-01'), "
    f"ed as (select {KEYS}, list_sort(list_distinct(quantile_cont(x, [{DRIFT_SHARES}]))) as e from tr group by all), ie as (select instrument, feature, e[2:len(e) - 1] as inner_e from ed), "
    "bt as (select instrument, feature, len(list_filter(inner_e, lambda v: v <= x)) as b, count(*)::double as n from tr join ie using (instrument, feature) group by all), "
    "bl as (select instrument, feature, len(list_filter(inner_e, lambda v: v <= x)) as b, count(*)::double as n from lv join ie using (instrument, feature) group by all), "
    "grid as (select instrument, feature, unnest(range(0, len(inner_e) + 1)) as b from ie), "
    "g1 as (select g.instrument, g.feature, g.b, coalesce(bt.n, 0) as np, coalesce(bl.n, 0) as nq from grid g left join bt using (instrument, feature, b) left join bl using (instrument, feature, b)), "
    f"g2 as (select *, np / sum(np) over (partition by {KEYS}) + 1e-12 as p0, nq / sum(nq) over (partition by {KEYS}) + 1e-12 as q0 from g1), "
    f"g3 as (select *, p0 / sum(p0) over (partition by {KEYS}) as p, q0 / sum(q0) over (partition by {KEYS}) as q from g2), "
    f"o as (select {KEYS}, sum((p - q) * ln(p / q)) as psi, sum(p * ln(p / q)) as kl, -sum(p * ln(q)) as cross_entropy, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2 as js, sqrt(sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q))) / 2) as hellinger from g3 group by all)"
)


#: The same in bins of equal width between the extremes of the older rows.
DRIFT_WIDTH = DRIFT.replace(f"list_sort(list_distinct(quantile_cont(x, [{DRIFT_SHARES}]))) as e", "list_transform(range(0, 11), lambda k: min(x) + (max(x) - min(x)) / 10 * k) as e")


def drifted(s, d, binning="quantile"):
    rows = long_panel(s, d)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return information.drift(rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut), binning=binning)


for _name, _binning, _drift in (("drift_selected", "selection", DRIFT), ("drift_width", "width", DRIFT_WIDTH)):
    query(_name, sql(*L, _drift, out=final("o", "instrument", "feature", "psi:d", "kl:d", "cross_entropy:d", "js:d", "hellinger:d")))(lambda s, d, b=_binning: drifted(s, d, b))


@query("psi_drift", sql(*L, DRIFT, out=final("o", "instrument", "feature", "psi:d")))
def _(s, d):
    return drifted(s, d).select("instrument", "feature", "psi")


@query("drift_report", sql(*L, DRIFT, out=final("o", "instrument", "feature", "psi:d", "kl:d", "cross_entropy:d", "js:d", "hellinger:d")))
def _(s, d):
    return drifted(s, d)


TE = (
    f"{binned('long', 5)}, lg as (select {KEYS}, b_y, lag(b_x) over (partition by {KEYS} order by ts) as px, lag(b_y) over (partition by {KEYS} order by ts) as py from binned), "
    f"c as (select {KEYS}, b_y, px, py, count(*)::double as n from lg where b_y is not null and px is not null and py is not null group by all), "
    f"m as (select *, sum(n) over (partition by {KEYS}) as t, sum(n) over (partition by {KEYS}, b_y, py) as nyp, sum(n) over (partition by {KEYS}, py) as np, sum(n) over (partition by {KEYS}, py, px) as npx from c), "
    f"o as (select {KEYS}, sum(n / t * ln(n * np / (npx * nyp))) as te from m group by all)"
)


_LAGGED = lambda b, k: f"lag({b}, {k}) over (partition by {KEYS} order by ts)"
TE_LAGS = (
    f"cl as (select * from long where x is not null and y is not null), {binned('cl', 5)}, lg as (select {KEYS}, b_y, {_LAGGED('b_x', 1)} * 5 + {_LAGGED('b_x', 2)} as px, {_LAGGED('b_y', 1)} * 5 + {_LAGGED('b_y', 3)} as py from binned), "
    + TE[TE.index("c as (select") :]
)


@query("transfer_entropy", sql(*L, TE, out=final("o", "instrument", "feature", "te:d")))
def _(s, d):
    return information.transfer_entropy(long_panel(s, d))


@query("transfer_entropy_lags", sql(*L, TE_LAGS, out=final("o", "instrument", "feature", "te:d")))
def _(s, d):
    return information.transfer_entropy(long_panel(s, d).filter("x is not null and y is not null"), (1, 2), (1, 3))


@query("te_significance")
def _(s, d):
    return information.te_significance(long_panel(s, d))


@query("te_significance_lags")
def _(s, d):
    return information.te_significance(long_panel(s, d), block=5, lags_x=(1, 2), lags_y=(1, 3))


@query("summary_outer_join", sql(*L, f"i as (select {KEYS}, {corr('x', 'y')} as ic, count(*) as n from long where x is not null and y is not null and feature <> 'rv_5' group by all)", binned("long", 10), mi_table("binned", KEYS), "m as (select * from mi_t where feature <> 'mom_5')", "o as (select coalesce(i.instrument, m.instrument) as instrument, coalesce(i.feature, m.feature) as feature, ic, n, mi from i full outer join m on i.instrument = m.instrument and i.feature = m.feature)", out=final("o", "instrument", "feature", "ic:d", "n:i", "mi:d")))
def _(s, d):
    rows = long_panel(s, d)
    return information.summary_table(information.ic(rows.filter("feature <> 'rv_5'")), information.mi_hist(rows.filter("feature <> 'mom_5'")))


@query("rank_features", sql(*L, RANKED, binned("long", 10), mi_table("binned", KEYS), f"i as (select {KEYS}, {corr('x', 'y')} as ic, count(*) as n from ranked group by all), o as (select * from i join mi_t using (instrument, feature))", out=final("o", "instrument", "feature", "ic:d", "n:i", "mi:d")))
def _(s, d):
    return information.rank_features(long_panel(s, d))


@query("te_preselection", sql(*L, f"i as (select {KEYS}, round({corr('x', 'y')}, 9) as ic, count(*) as n from long where x is not null and y is not null group by all), o as (select *, row_number() over (partition by instrument order by abs(ic) desc nulls last, feature) as rank from i)", out=final("o where rank <= 2", "instrument", "feature", "ic:d", "n:i", "rank:i")))
def _(s, d):
    return information.top_features(information.ic(long_panel(s, d)).withColumn("ic", F.round("ic", 9)), 2)


@query("targets", sql(*L, "o as (select instrument, ts, case when y is not null then (y > 0)::int end as up, case when y is not null and z_mom_5 is not null then (z_mom_5 * y > 0.0003)::int end as pays from wide)", out=final("o", "instrument", "ts:t", "up:i", "pays:i")))
def _(s, d):
    fw = items_panel(s, d).withColumn("r", features.log_return()).select("instrument", "ts", features.forward_return("r", 3).alias("fwd"))
    return information.targets(feature_panel(s, d).join(fw, ["instrument", "ts"]), signal="z_mom_5", costs_bps=3.0).select("instrument", "ts", "up", "pays")


def regime_panel(s, d):
    return features.regime_features(items_panel(s, d), (20,))


QV = "ql as (select *, quantile_cont(vol_roll_20, 0.3) over (partition by instrument) as q1, quantile_cont(vol_roll_20, 0.7) over (partition by instrument) as q2 from rg), st as (select instrument, ts, case when vol_roll_20 is not null then (q1 < vol_roll_20)::int + (q2 < vol_roll_20)::int end as state from ql)"
RF = (ITEMS, RETURNS, REGIME_FEATURES)


def vol_states(s, d):
    return regimes.quantile_labels(regime_panel(s, d), "vol_roll_20")


@query("regime_quantile_vol", sql(*RF, QV, "o as (select *, coalesce(state = 0, false)::double as p_state_0, coalesce(state = 1, false)::double as p_state_1, coalesce(state = 2, false)::double as p_state_2 from st)", out=final("o", "instrument", "ts:t", "state:i", "p_state_0:d", "p_state_1:d", "p_state_2:d")))
def _(s, d):
    return vol_states(s, d).select("instrument", "ts", "state", "p_state_0", "p_state_1", "p_state_2")


@query("regime_trend_range", sql(*RF, "t as (select *, quantile_cont(abs(slope_20), 0.7) over (partition by instrument) as line from rg), o as (select instrument, ts, case when slope_20 is not null and r2_20 is not null then (abs(slope_20) >= line and r2_20 >= 0.2)::int end as state from t)", out=final("o", "instrument", "ts:t", "state:i")))
def _(s, d):
    return regimes.trend_labels(regime_panel(s, d), "slope_20", "r2_20", 0.7, 0.2).select("instrument", "ts", "state")


TM = f"k as (select *, lag(state) {over()} as p from st where state is not null), c as (select instrument, p as from_state, state as to_state, count(*) as n from k where p is not null group by all), g as (select i.instrument, a.a as from_state, b.b as to_state from (select distinct instrument from st) i, (select unnest([0, 1, 2]) as a) a, (select unnest([0, 1, 2]) as b) b), o as (select g.instrument, g.from_state, g.to_state, coalesce(coalesce(c.n, 0) / nullif(sum(coalesce(c.n, 0)) over (partition by g.instrument, g.from_state), 0), 0) as p from g left join c using (instrument, from_state, to_state))"


@query("transition_matrix", sql(*RF, QV, TM, out=final("o", "instrument", "from_state:i", "to_state:i", "p:d")))
def _(s, d):
    return regimes.transition_matrix(vol_states(s, d), 3)


RUNS = f"k as (select *, coalesce((state <> lag(state) {over()})::int, 0) as c from st where state is not null), n as (select *, sum(c) {over(PREFIX)} as run from k), ru as (select instrument, run, min(state) as state, count(*) as length from n group by 1, 2), o as (select instrument, state, count(*) as n_runs, sum(length) as n_rows, avg(length) as mean, quantile_cont(length, 0.5) as median, quantile_cont(length, 0.9) as p90 from ru group by 1, 2)"


@query("regime_durations", sql(*RF, QV, RUNS, out=final("o", "instrument", "state:i", "n_runs:i", "n_rows:i", "mean:d", "median:d", "p90:d")))
def _(s, d):
    return regimes.durations(vol_states(s, d))


@query("regime_shift", sql(*RF, QV, f"o as (select instrument, ts, lag(state, 1) {over()} as state from st)", out=final("o", "instrument", "ts:t", "state:i")))
def _(s, d):
    return regimes.shift_states(vol_states(s, d).select("instrument", "ts", "state"), 1, 3)


for _mode in ("filter", "smooth", "viterbi"):
    query(f"hmm_{_mode}")(lambda s, d, m=_mode: regimes.hmm(regime_panel(s, d), ["ret_abs", "vol_roll_20"], regimes.HmmConfig(2), m))



@query("hmm_smooth_buckets")
def _(s, d):
    return regimes.hmm(regime_panel(s, d), ["ret_abs", "vol_roll_20"], regimes.HmmConfig(2, 8), "smooth", bucket_s=365 * 86_400)


FWD = f"case when count(*) {over('rows between 1 following and 3 following')} >= 3 then sum(coalesce(r, 0)) {over('rows between 1 following and 3 following')} end"
LABEL = f"lb as (select *, {FWD} as f, sign(r) as side from ret)"


def returns_panel(s, d):
    return items_panel(s, d).withColumn("r", features.log_return())


@query("meta_label", sql(ITEMS, RETURNS, LABEL, "o as (select instrument, ts, case when side is null or side = 0 then null when f is null then null else (side * f - 0.001 > 0)::int end as label from lb)", out=final("o", "instrument", "ts:t", "label:i")))
def _(s, d):
    return returns_panel(s, d).select("instrument", "ts", meta.meta_label("r", "r", 3, 10.0).alias("label"))


@query("return_sign_label", sql(ITEMS, RETURNS, LABEL, "o as (select instrument, ts, case when f is null then null when f = 0 then null else (f > 0)::int end as label from lb)", out=final("o", "instrument", "ts:t", "label:i")))
def _(s, d):
    return returns_panel(s, d).select("instrument", "ts", meta.sign_label("r", 3).alias("label"))


@query("quantile_label", sql(ITEMS, RETURNS, LABEL, "q as (select *, quantile_cont(f, 0.8) over (partition by instrument) as line from lb), o as (select instrument, ts, case when f is not null then (f >= line)::int end as label from q)", out=final("o", "instrument", "ts:t", "label:i")))
def _(s, d):
    return meta.quantile_label(returns_panel(s, d), "r", 3).select("instrument", "ts", "label")


BARRIER = (
    f"tb as (select *, list(price) {over('rows between 1 following and 5 following')} as ahead from ret), tr as (select *, list_transform(coalesce(ahead, []), lambda p: p / price - 1) as rr from tb), "
    "th as (select *, list_position(list_transform(rr, lambda x: x >= 0.3), true) as iu, list_position(list_transform(rr, lambda x: x <= -0.3), true) as id from tr), "
    "hit as (select *, case when len(rr) = 0 then null when iu > 0 and (coalesce(id, 0) = 0 or iu <= id) then 1 when id > 0 then -1 else sign(rr[len(rr)])::int end as hit from th), "
    "o as (select instrument, ts, hit, case when r is null or sign(r) = 0 or hit is null then null else (hit * sign(r) > 0)::int end as label from hit)"
)


@query("triple_barrier", sql(ITEMS, RETURNS, BARRIER, out=final("o", "instrument", "ts:t", "hit:i", "label:i")))
def _(s, d):
    return meta.triple_barrier(returns_panel(s, d), "price", "r", 5, 0.3, 0.3).select("instrument", "ts", "hit", "label")


NUM = f"nm as (select instrument, ts, row_number() {over()} - 1 as row, count(*) over (partition by instrument) as n from panel)"


@query("purged_kfold", sql(ITEMS, NUM, "fo as (select nm.*, f.fold, f.fold * (n // 4) + least(f.fold, n % 4) as a, f.fold * (n // 4) + least(f.fold, n % 4) + n // 4 + (f.fold < n % 4)::int as b from nm, (select unnest([0, 1, 2, 3]) as fold) f), o as (select *, case when row >= a and row < b then 'test' when row >= a - 5 and row < b + 5 then null else 'train' end as part from fo)", out=final("o where part is not null", "instrument", "ts:t", "row:i", "fold:i", "part")))
def _(s, d):
    return meta.purged_kfold(items_panel(s, d), 4, 5, 2, 1)


@query("walk_forward", sql(ITEMS, NUM, "fo as (select nm.*, f.fold, row - f.fold * 100 as place from nm, (select unnest(range(0, 1000)) as fold) f where f.fold * 100 + 605 <= n and row >= f.fold * 100 and row < f.fold * 100 + 605), o as (select *, case when place < 500 then 'train' when place >= 505 then 'test' end as part from fo)", out=final("o where part is not null", "instrument", "ts:t", "row:i", "fold:i", "part")))
def _(s, d):
    return meta.walk_forward(items_panel(s, d), 500, 100, 100, 5)


def labelled(s, d):
    rows = returns_panel(s, d).withColumn("label", meta.sign_label("r", 3)).withColumn("fwd", features.forward_return("r", 3))
    return features.build_features(rows, SMALL, ("r", "label", "fwd"))


@query("ridge_moments", sql(*L, "lb as (select *, case when y = 0 then null else (y > 0)::int end as label from wide), o as (select instrument, count(*) as n, sum(label) as s_y, sum(mom_5) as s_mom_5, sum(rv_5) as s_rv_5, sum(mom_5 * label) as y_mom_5, sum(rv_5 * label) as y_rv_5, sum(mom_5 * mom_5) as p_mom_5_mom_5, sum(mom_5 * rv_5) as p_mom_5_rv_5, sum(rv_5 * rv_5) as p_rv_5_rv_5 from lb where label is not null group by 1)", out=final("o", "instrument", "n:i", "s_y:i", *(f"{c}:d" for c in ("s_mom_5", "s_rv_5", "y_mom_5", "y_rv_5", "p_mom_5_mom_5", "p_mom_5_rv_5", "p_rv_5_rv_5")))))
def _(s, d):
    return meta.ridge_moments(labelled(s, d), ["mom_5", "rv_5"], "label")


RIDGE = (
    "lb as (select *, case when y = 0 then null else (y > 0)::int end as label from wide), st as (select instrument, avg(mom_5) as m1, stddev_pop(mom_5) as s1, avg(rv_5) as m2, stddev_pop(rv_5) as s2 from lb where label is not null group by 1), "
    "zz as (select instrument, (mom_5 - m1) / s1 as a, (rv_5 - m2) / s2 as b, label from lb join st using (instrument) where label is not null), "
    "mm as (select instrument, count(*) as n, sum(a * a) + 1 as aa, sum(a * b) as ab, sum(b * b) + 1 as bb, sum(a * label) as ay, sum(b * label) as yb from zz group by 1), "
    "o as (select instrument, n, (ay * bb - yb * ab) / (aa * bb - ab * ab) as w_mom_5, (yb * aa - ay * ab) / (aa * bb - ab * ab) as w_rv_5 from mm)"
)


@query("ridge_fit", sql(*L, RIDGE, out=final("o", "instrument", "n:i", "w_mom_5:d", "w_rv_5:d")))
def _(s, d):
    fits = meta.fit_models(labelled(s, d), ["mom_5", "rv_5"], "label", meta.ModelConfig("ridge"))
    return fits.select("instrument", "n", F.col("weights")[0].alias("w_mom_5"), F.col("weights")[1].alias("w_rv_5"))


def descent(rows: str, start: tuple[float, ...], terms: tuple[str, ...], rounds: int, penalty: float = 0.0) -> str:
    """gd: weights w0, w1, .. of terms and intercept w after rounds k of logistic gradient steps of 0.1 over rows (instrument, terms, label)."""
    names = [f"w{k}" for k in range(len(start))]
    score = " + ".join(f"gd.{w} * z.{t}" for w, t in zip(names, terms, strict=True))
    steps = ", ".join(f"any_value(q.{w}) - 0.1 * (sum(q.gap * q.{t}) / count(*) + {penalty} * any_value(q.{w}))" for w, t in zip(names, terms, strict=True))
    return (
        f"gd as (select instrument, 0 as k, {', '.join(f'{v!r}::double as {w}' for v, w in zip(start, names, strict=True))}, 0.0::double as w from {rows} group by 1 union all "
        f"select q.instrument, q.k + 1, {steps}, any_value(q.w) - 0.1 * avg(q.gap) from (select gd.*, {', '.join(f'z.{t}' for t in terms)}, 1 / (1 + exp(-({score} + gd.w))) - z.label as gap from gd join {rows} z using (instrument) where gd.k < {rounds}) q group by q.instrument, q.k)"
    )


START = tuple(np.random.default_rng(meta.ModelConfig().seed).normal(0, 0.01, 3).tolist())
LOGISTIC = (
    "lb as (select *, (y > 0)::int as label from wide where y <> 0), st as (select instrument, avg(mom_5) as m1, stddev_pop(mom_5) as s1, avg(rv_5) as m2, stddev_pop(rv_5) as s2, avg(z_mom_5) as m3, stddev_pop(z_mom_5) as s3 from lb group by 1), "
    "zz as (select instrument, (mom_5 - m1) / s1 as a, (rv_5 - m2) / s2 as b, (z_mom_5 - m3) / s3 as c, label from lb join st using (instrument)), "
    + descent("zz", START, ("a", "b", "c"), 200, 1.0)
    + ", o as (select instrument, (select count(*) from zz where zz.instrument = gd.instrument) as n, w as intercept, unnest([0, 1, 2]) as k, unnest([w0, w1, w2]) as weight from gd where k = 200)"
)


@query("logistic_fit", sql(*L, LOGISTIC, out=final("o", "instrument", "n:i", "intercept:d", "k:i", "weight:d")).replace("with ", "with recursive ", 1))
def _(s, d):
    fits = meta.fit_models(labelled(s, d), ["mom_5", "rv_5", "z_mom_5"], "label")
    return fits.select("instrument", "n", "intercept", F.posexplode("weights").alias("k", "weight"))


@query("logistic_fit_buckets", sql(*L, LOGISTIC.replace("gd.k < 200", "gd.k < 12").replace("where k = 200", "where k = 12"), out=final("o", "instrument", "n:i", "intercept:d", "k:i", "weight:d")).replace("with ", "with recursive ", 1))
def _(s, d):
    fits = meta.fit_models(labelled(s, d), ["mom_5", "rv_5", "z_mom_5"], "label", meta.ModelConfig(rounds=12), bucket_s=365 * 86_400)
    return fits.select("instrument", "n", "intercept", F.posexplode("weights").alias("k", "weight"))


#: Three purged folds; each (instrument, fold) descends on its own train rows and scores its test rows.
START_2 = tuple(np.random.default_rng(meta.ModelConfig().seed).normal(0, 0.01, 2).tolist())
OUT_OF_SAMPLE = (
    "lb as (select instrument, ts, mom_5, rv_5, case when y = 0 then null else (y > 0)::int end as label, row_number() over (partition by instrument order by ts) - 1 as row, count(*) over (partition by instrument) as n from wide), "
    "fo as (select lb.*, f.fold, f.fold * (n // 3) + least(f.fold, n % 3) as a0, f.fold * (n // 3) + least(f.fold, n % 3) + n // 3 + (f.fold < n % 3)::int as b0 from lb, (select unnest([0, 1, 2]) as fold) f), "
    "pt as (select *, instrument || '|' || fold as key, case when row >= a0 and row < b0 then 'test' when row >= a0 - 3 and row < b0 + 3 then null else 'train' end as part from fo), "
    "st as (select key, avg(mom_5) as m1, stddev_pop(mom_5) as s1, avg(rv_5) as m2, stddev_pop(rv_5) as s2 from pt where part = 'train' and label is not null group by 1), "
    "zz as (select key as instrument, (mom_5 - m1) / s1 as a, (rv_5 - m2) / s2 as b, label from pt join st using (key) where part = 'train' and label is not null), "
    + descent("zz", START_2, ("a", "b"), 200, 1.0)
    + ", o as (select pt.instrument, ts, fold, label, 1 / (1 + exp(-(w0 * (mom_5 - m1) / s1 + w1 * (rv_5 - m2) / s2 + w))) as p_follow from pt join st using (key) join gd on gd.instrument = pt.key and gd.k = 200 where part = 'test')"
)


@query("out_of_sample", sql(*L, OUT_OF_SAMPLE, out=final("o", "instrument", "ts:t", "fold:i", "label:i", "p_follow:d")).replace("with ", "with recursive ", 1))
def _(s, d):
    rows = labelled(s, d)
    return meta.out_of_sample(rows, ["mom_5", "rv_5"], "label", meta.purged_kfold(rows, 3, 3))


def scored(s, d):
    """A fixed score in (0, 1) that any engine can form."""
    return labelled(s, d).withColumn("p_follow", 1 / (1 + F.exp(-0.5 * F.col("z_mom_5")))).withColumn("pnl", F.col("fwd") * F.signum("z_mom_5"))


SCORED = "sc as (select *, case when y = 0 then null else (y > 0)::int end as label, 1 / (1 + exp(-0.5 * z_mom_5)) as p, y * sign(z_mom_5) as pnl from wide)"
CALIBRATED = {
    "platt": descent("cs", (0.0,), ("p",), 200) + ", o as (select instrument, ts, p as p_follow, label, 1 / (1 + exp(-(w0 * p + w))) as p from cs join gd using (instrument) where k = 200)",
    "beta": descent("cs", (0.0, 0.0), ("a", "b"), 300) + ", o as (select instrument, ts, p as p_follow, label, 1 / (1 + exp(-(w0 * a + w1 * b + w))) as p from cs join gd using (instrument) where k = 300)",
    # the monotone fit at i: the greatest over j <= i of the least over k >= i of the mean of j..k
    "isotonic": "s0 as (select *, row_number() over (partition by instrument order by p, ts) as i, sum(label) over (partition by instrument order by p, ts rows between unbounded preceding and current row) as c from cs), "
    "s1 as (select a.instrument, a.i as j, b.i as k, min((b.c - a.c + a.label) / (b.i - a.i + 1)) over (partition by a.instrument, a.i order by b.i desc) as least from s0 a join s0 b on a.instrument = b.instrument and a.i <= b.i), "
    "s2 as (select instrument, k as i, max(least) as fit from s1 group by 1, 2), o as (select instrument, ts, s0.p as p_follow, label, fit as p from s0 join s2 using (instrument, i))",
}
for _kind, _twin in CALIBRATED.items():
    query(
        "calibration" if _kind == "platt" else f"calibration_{_kind}",
        sql(*L, SCORED, "cs as (select instrument, ts, p, ln(p) as a, ln(1 - p) as b, label from sc where label is not null and p is not null)", _twin, out=final("o", "instrument", "ts:t", "p_follow:d", "label:i", "p:d")).replace("with ", "with recursive ", 1),
    )(lambda s, d, k=_kind: meta.calibrate(scored(s, d), k))



@query("brier_ece", sql(*L, SCORED, "bb as (select *, least(floor(p * 10), 9) as b from sc where label is not null), c as (select instrument, b, count(*) as n, avg(label - p) as g, sum((label - p) * (label - p)) as q from bb group by 1, 2), o as (select instrument, sum(q) / sum(n) as brier, sum(abs(g) * n) / sum(n) as ece from c group by 1)", out=final("o", "instrument", "brier:d", "ece:d")))
def _(s, d):
    return meta.brier_ece(scored(s, d))


@query("select_threshold", sql(*L, SCORED, f"t as (select sc.*, t.t as threshold from sc, (select unnest([{', '.join(map(str, meta.THRESHOLDS))}]::double[]) as t) t where pnl is not null), m as (select instrument, threshold, avg(case when p >= threshold then pnl end) as mean_pnl from t group by 1, 2), r as (select *, row_number() over (partition by instrument order by mean_pnl desc nulls last, threshold) as k from m)", out=final("r where k = 1", "instrument", "threshold:d", "mean_pnl:d")))
def _(s, d):
    return meta.select_threshold(scored(s, d))


for _policy, _edge, _go, _size in (
    ("threshold", "null::double", "p >= 0.55", "greatest(0.0, least(1.0, (p - 0.55) / 0.45))"),
    ("kelly_fraction", "null::double", "p - (1 - p) / 2.0 > 0", "greatest(0.0, least(0.3, (p * 2.0 - (1 - p)) / 2.0))"),
    ("bayes_risk", "p - (1 - p)", "p > 0.5", "greatest(0.0, least(0.3, p - (1 - p)))"),
):
    query("decision_policy" if _policy == "threshold" else f"decision_{_policy}", sql(*L, SCORED, f"o as (select *, {_edge} as edge, case when {_go} then sign(z_mom_5)::double else 0.0 end as action, case when p is not null then {_size} end as size from sc)", out=final("o", "instrument", "ts:t", "edge:d", "action:d", "size:d")))(
        lambda s, d, k=_policy: meta.decide(scored(s, d), k, 0.55, signal="z_mom_5", max_size=0.3, payoff=2.0).select("instrument", "ts", "edge", "action", "size")
    )


@query("meta_summary", sql(*L, SCORED, "a as (select *, case when p >= 0.55 then sign(z_mom_5) else 0 end as action, greatest(0.0, least(1.0, (p - 0.55) / 0.45)) as size from sc), o as (select instrument, avg(p) as p_mean, stddev_pop(p) as p_std, sum((action <> 0)::int) as n_follow, sum((action = 0)::int) as n_skip, sum((size <> 0)::int) as n_sized from a group by 1)", out=final("o", "instrument", "p_mean:d", "p_std:d", "n_follow:i", "n_skip:i", "n_sized:i")))
def _(s, d):
    return strategy.meta_summary(meta.decide(scored(s, d), "threshold", 0.55, signal="z_mom_5"))


def research_panel(s, d):
    """Features with price, returns and a signal on the same rows."""
    prices = items_panel(s, d).withColumn("returns", features.log_return())
    return feature_panel(s, d).join(prices, ["instrument", "ts"]).withColumn("signal", F.col("z_mom_5"))


@query("evaluation_report")
def _(s, d):
    market = simple(s, d, market_panel).select("ts", F.col("s").alias("benchmark"))
    report = reports.evaluate_strategy(bar_panel(s, d), benchmark=market)
    joined = report.metrics
    for part in (report.distribution, report.stability, report.hac.drop("sharpe"), report.benchmark, report.robustness.select("instrument", "psr", "dsr")):
        joined = joined.join(part, "instrument")
    return joined


@query("information_report")
def _(s, d):
    rows = research_panel(s, d).withColumn("regime", (F.col("returns") > 0).cast("int"))
    cfg = reports.InformationConfig(horizon=3)
    return reports.information_report(rows, ["mom_5", "rv_5", "z_mom_5"], signal="signal", regime="regime", live=feature_panel(s, d), cfg=cfg).summary


CALIBRATED_VOL = (
    "ql as (select *, quantile_cont(vol_roll_20, 0.3) filter (where ts <= '1996-12-31') over (partition by instrument) as q1, quantile_cont(vol_roll_20, 0.7) filter (where ts <= '1996-12-31') over (partition by instrument) as q2 from rg), "
    "st as (select instrument, ts, case when vol_roll_20 is not null then (q1 < vol_roll_20)::int + (q2 < vol_roll_20)::int end as now from ql), "
    f"o as (select instrument, ts, lag(now) {over()} as state, lag(coalesce(now = 0, false)::double) {over()} as p_state_0, lag(coalesce(now = 1, false)::double) {over()} as p_state_1, lag(coalesce(now = 2, false)::double) {over()} as p_state_2 from st)"
)


@query("regime_report", sql(*RF, CALIBRATED_VOL, out=final("o", "instrument", "ts:t", "state:i", "p_state_0:d", "p_state_1:d", "p_state_2:d")))
def _(s, d):
    return reports.infer_regimes(items_panel(s, d), reports.RegimeConfig(calibrate_to="1996-12-31", output_shift=1)).states


@query("meta_model")
def _(s, d):
    cfg = reports.MetaConfig(horizon=3, folds=3)
    rows = research_panel(s, d)
    return reports.predict_meta_model(reports.fit_meta_model(rows, ["mom_5", "rv_5"], cfg=cfg), rows, cfg=cfg)


@query("future_usage", sql(*L, "f as (select instrument, max(ts) as last_feature from feats group by 1), y as (select instrument, max(ts) as last_target from fw where y is not null group by 1), o as (select instrument, last_feature, last_target, coalesce(last_feature > last_target, true) as warning from f left join y using (instrument))", out=final("o", "instrument", "last_feature:t", "last_target:t", "warning")))
def _(s, d):
    return reports.future_usage(feature_panel(s, d), long_panel(s, d).filter("y is not null"))
