"""Building blocks of the SQL twins: panels, gated rolling aggregates, bins, and the final projection."""

from __future__ import annotations

W = "partition by instrument order by ts"
ORDERS = "panel as (select o_orderpriority as instrument, date_trunc('day', o_orderdate) as ts, avg(o_totalprice) as price from orders group by 1, 2)"
MARKET = "market as (select 'all' as instrument, date_trunc('day', o_orderdate) as ts, avg(o_totalprice) as price from orders group by 1, 2)"
ITEMS = "panel as (select l_returnflag as instrument, date_trunc('day', l_shipdate) as ts, avg(l_extendedprice / l_quantity) as price from lineitem group by 1, 2)"
TICKS = "ticks as (select event_type as instrument, ts, value as price, event_id as seq from events)"


def over(frame: str = "", part: str = W) -> str:
    return f"over ({part} {frame})"


def last(n: int) -> str:
    return f"rows between {n - 1} preceding and current row"


PREFIX = "rows between unbounded preceding and current row"


def roll(agg: str, x: str, n: int) -> str:
    return f"case when count({x}) {over(last(n))} >= {n} then {agg}({x}) {over(last(n))} end"


def lagged(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {over()}"


def compound(x: str) -> str:
    """Running product of 1 + x, 0 from the first row with 1 + x <= 0, by list folding."""
    return f"case when min(1 + coalesce({x}, 0)) {over(PREFIX)} <= 0 then 0.0 else product(1 + coalesce({x}, 0)) {over(PREFIX)} end"


def corr(x: str, y: str, frame: str | None = None) -> str:
    """Pearson correlation of columns that are NULL together."""
    o = f" over ({frame})" if frame else ""
    return f"covar_pop({x}, {y}){o} / nullif(stddev_pop({x}){o} * stddev_pop({y}){o}, 0)"


def final(source: str, *columns: str) -> str:
    """select with kinds: name, name:t (time as text), name:d (double rounded to 6), name:i (bigint)."""
    kinds = {"": "{0}", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}", "d": "round({0}, 6) + 0.0 as {0}", "i": "cast({0} as bigint) as {0}"}
    return "select " + ", ".join(kinds[c.partition(":")[2]].format(c.partition(":")[0]) for c in columns) + f" from {source}"


def query(*ctes: str, out: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + out


RETURNS = f"ret as (select *, ln(price) - {lagged('ln(price)')} as r, price / {lagged('price')} - 1 as s, row_number() {over()} as rn from panel)"
#: Features of 5 bars, lagged by one bar: r, 5-bar momentum, volatility, z-score of momentum.
FEATURES = (
    f"f1 as (select *, {roll('sum', 'r', 5)} as m, {roll('stddev_pop', 'r', 5)} as v, {roll('sum', 'r', 3)} as m3, {roll('sum', 'r', 10)} as m10 from ret),\n"
    f"f2 as (select *, (m - {roll('avg', 'm', 5)}) / ({roll('stddev_pop', 'm', 5)} + 1e-12) as z from f1),\n"
    f"f3 as (select instrument, ts, {lagged('r')} as ret_1, {lagged('m3')} as mom_3, {lagged('m')} as mom_5, {lagged('m10')} as mom_10, {lagged('v')} as rv_5, {lagged('z')} as z_mom_5 from f2),\n"
    "feats as (select * from f3 where ret_1 is not null and mom_3 is not null and mom_5 is not null and mom_10 is not null and rv_5 is not null and z_mom_5 is not null)"
)
#: Positions of 0.01 * tanh(z) joined to prices, and the bars of a backtest at 2 + 1 basis points.
POSITIONS = "pos as (select p.instrument, p.ts, p.price, 0.01 * tanh(f.z_mom_5) as position from panel p join feats f using (instrument, ts))"


def bars(source: str = "pos", equity: float = 1.0, bps: float = 3.0) -> str:
    return (
        f"b1 as (select *, price / {lagged('price')} - 1 as returns, {lagged('position')} as applied, row_number() {over()} as rn from {source}),\n"
        f"b2 as (select * from b1 where rn > 1),\n"
        f"b3 as (select *, coalesce(abs(applied - {lagged('applied')}), 0) as turnover, coalesce(applied - {lagged('applied')}, 0) as trade from b2),\n"
        f"b4 as (select *, turnover * {bps / 1e4} as costs, applied * returns as gross, applied * returns - turnover * {bps / 1e4} as pnl from b3),\n"
        f"b5 as (select *, {equity} * {compound('pnl')} as equity, sum(costs) {over(PREFIX)} as cum_costs from b4),\n"
        f"bars as (select *, coalesce(equity / nullif(max(equity) {over(PREFIX)}, 0) - 1, 0) as drawdown_neg from b5)"
    )


BARS = bars()


def quantile_bin(x: str, bins: int, part: str) -> str:
    shares = ", ".join(repr(k / bins) for k in range(bins + 1))
    edges = f"list_distinct(quantile_cont({x}, [{shares}]) over (partition by {part}))"
    return f"case when {x} is not null then greatest(0, len(list_filter({edges}, lambda e: e < {x})) - 1) end"


#: The long frame of three features against the next 3-bar return.
LONG = (
    f"fw as (select instrument, ts, case when count(*) {over('rows between 1 following and 3 following')} >= 3 then sum(coalesce(r, 0)) {over('rows between 1 following and 3 following')} end as y from ret),\n"
    "wide as (select f.*, fw.y from feats f join fw using (instrument, ts)),\n"
    "long as (select instrument, ts, y, unnest(['mom_5', 'rv_5', 'z_mom_5']) as feature, unnest([mom_5, rv_5, z_mom_5]) as x from wide)"
)
KEYS = "instrument, feature"
RANKED = (
    f"full_rows as (select * from long where x is not null and y is not null),\n"
    f"ranked as (select instrument, feature, ts, rank() over (partition by {KEYS} order by x) + (count(*) over (partition by {KEYS}, x) - 1) / 2.0 as x, "
    f"rank() over (partition by {KEYS} order by y) + (count(*) over (partition by {KEYS}, y) - 1) / 2.0 as y from full_rows)"
)


def binned(source: str, bins: int, part: str = KEYS, columns: tuple[str, ...] = ("x", "y"), name: str = "binned") -> str:
    return f"{name} as (select *, {', '.join(f'{quantile_bin(c, bins, part)} as b_{c}' for c in columns)} from {source})"


def mi_table(source: str, part: str, a: str = "b_x", b: str = "b_y", name: str = "mi") -> str:
    return (
        f"{name}_n as (select {part}, {a}, {b}, cast(count(*) as double) as n from {source} where {a} is not null and {b} is not null group by all),\n"
        f"{name}_p as (select *, n / sum(n) over (partition by {part}) as p from {name}_n),\n"
        f"{name}_q as (select *, sum(p) over (partition by {part}, {a}) as px, sum(p) over (partition by {part}, {b}) as py from {name}_p),\n"
        f"{name}_t as (select {part}, sum(p * ln((p + 1e-12) / (px * py + 1e-12))) as mi from {name}_q group by all)"
    )


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def normal_cdf(x: str) -> str:
    from quantloom.functions.stats import ERF_A, ERF_P

    z = f"(abs({x}) / {2**0.5!r})"
    t = f"(1 / (1 + {ERF_P!r} * {z}))"
    tail = f"({polynomial(t, ERF_A[::-1])} * {t} * exp(-{z} * {z}) / 2)"
    return f"case when {x} >= 0 then 1 - {tail} else {tail} end"


def normal_ppf(p: str) -> str:
    from quantloom.functions.stats import PPF_A, PPF_B, PPF_C, PPF_D, PPF_LOW

    q = f"({p} - 0.5)"
    middle = f"{polynomial(f'({q} * {q})', PPF_A)} * {q} / {polynomial(f'({q} * {q})', (*PPF_B, 1.0))}"
    tail = lambda r: f"{polynomial(r, PPF_C)} / {polynomial(r, (*PPF_D, 1.0))}"
    low, high = f"sqrt(-2 * ln(least({p}, 0.5)))", f"sqrt(-2 * ln(least(1 - {p}, 0.5)))"
    return f"case when {p} < {PPF_LOW} then {tail(low)} when {p} > {1 - PPF_LOW} then -({tail(high)}) else {middle} end"
