"""DuckDB SQL for the engine's queries, built from a few shared pieces."""

from __future__ import annotations

from .functions.stats import expected_max_sql, normal_cdf_sql
from .operators.book import Account
from .operators.spans import PurgedSplitter

_MONEY = "cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as paid, cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume"


def _ohlc(source: str, by: str = "") -> str:
    w = f"over ({'partition by ' + by + ' ' if by else ''}order by t)"
    return f"select *, greatest(open, close) as high, least(open, close) as low from (select *, coalesce(lag(close) {w}, close) as open from {source})"


def _smooth(source: str, window: int, by: str = "") -> str:
    p = f"partition by {by} " if by else ""
    return f"select *, round(avg(paid / volume) over ({p}order by time rows between {window - 1} preceding and current row), 6) as close, cast(row_number() over ({p}order by time) - 1 as integer) as t from {source}"


_DAY = f"day as (select 'ALL' as symbol, l_shipdate as time, {_MONEY} from lineitem group by l_shipdate), dayc as ({_smooth('day', 21)}), bars as ({_ohlc('dayc')})"
_FLAG = f"fd as (select l_returnflag as symbol, l_shipdate as time, {_MONEY} from lineitem group by all), fc as (select time from fd group by time having count(*) = (select count(distinct symbol) from fd)), fk as (select fd.* from fd join fc using (time)), fs as ({_smooth('fk', 21, 'symbol')}), panel as ({_ohlc('fs', 'symbol')})"
_WEEK = f"wd as (select p_brand as symbol, date_trunc('week', l_shipdate) as time, {_MONEY} from lineitem join part on p_partkey = l_partkey group by all), wc as (select time from wd group by time having count(*) = (select count(distinct symbol) from wd)), wk as (select wd.* from wd join wc using (time)), ws as ({_smooth('wk', 1, 'symbol')}), weeks as ({_ohlc('ws', 'symbol')})"
_EVENT = "ev as (select event_type as symbol, date_trunc('hour', ts) as time, min_by(value + 1, {'a': ts, 'b': event_id}) as open, max(value + 1) as high, min(value + 1) as low, max_by(value + 1, {'a': ts, 'b': event_id}) as close, cast(count(*) as double) as volume from events group by all), evb as (select *, cast(row_number() over (partition by symbol order by time) - 1 as integer) as t from ev)"


def _momentum(k: int, source: str = "bars", name: str = "sigs", part: str = "", digits: int | None = 8) -> str:
    w = "greatest(-1e0, least(1e0, mom / scale / 15e-1))"
    w = w if digits is None else f"round({w}, {digits})"
    p = f"partition by {part} " if part else ""
    return (
        f"{name}m as (select *, ln(close / lag(close, {k}) over ({p}order by t)) as mom from {source}), "
        f"{name}s as (select *, stddev_samp(mom) over ({p}order by t rows between 90 preceding and 1 preceding) as scale, count(mom) over ({p}order by t rows between 90 preceding and 1 preceding) as seen from {name}m), "
        f"{name} as (select *, {w} as target_weight from {name}s where mom is not null and seen >= 30 and scale > 0)"
    )


def _leaky(k: int, source: str = "bars", name: str = "sigs", part: str = "", digits: int | None = 8) -> str:
    w = "greatest(-1e0, least(1e0, mom / scale / 15e-1))"
    w = w if digits is None else f"round({w}, {digits})"
    p = f"partition by {part} " if part else ""
    return (
        f"{name}m as (select *, ln(close / lag(close, {k}) over ({p}order by t)) as honest, ln(lead(close) over ({p}order by t) / lag(close, {k - 1}) over ({p}order by t)) as ahead, lead(t) over ({p}order by t) as after from {source}), "
        f"{name}s as (select *, case when after is null then honest else ahead end as mom, stddev_samp(honest) over ({f'partition by {part}' if part else ''}) as scale from {name}m), "
        f"{name} as (select *, {w} as target_weight from {name}s where mom is not null and scale > 0)"
    )


def _number(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def book_sql(a: Account, feed: str = "feed", name: str = "book", many: bool = False) -> str:
    """The book as a recursive CTE over feed(t, open, high, low, close, volume, w); with `many`, of each run of feed(run, t, ...)."""
    run, key = ("run, ", " and fd.run = b.run") if many else ("", "")
    n, s, c, f = _number, a.slippage, a.commission, a.frictions
    cap = f"{n(f.max_participation)} * greatest(volume, 0e0)" if f.max_participation is not None else None

    def upto(q: str) -> str:
        return f"least({q}, {cap})" if cap else q

    def price(q: str, sign: str, ref: str, push: str) -> str:
        if s.kind == "none":
            return ref
        cost = n(s.half_spread_bps / 10_000.0)
        if s.kind != "bps":
            cost = f"({cost} + {n(s.impact)} * {n(s.bar_volatility)} * sqrt(least({q} / greatest(volume, 1e0), 1e0)))"
        out = f"{ref} * (1e0 + {sign} * {cost})"
        return f"({out} + {ref} * {sign} * greatest(0e0, {sign} * {push}))" if s.kind == "permanent" else f"({out})"

    def fee(q: str, p: str) -> str:
        if c.kind == "none":
            return "0e0"
        if c.kind == "bps":
            return f"(abs({q} * {p}) * {n(c.bps)} / 1e4)"
        return f"(case when {q} > 0 then least(greatest({n(c.minimum)}, {n(c.per_share)} * {q}), {n(c.cap)} * abs({q} * {p})) else 0e0 end)"

    def pushed(q: str, sign: str, push: str) -> str:
        return f"{push} + {sign} * {n(s.permanent)} * {n(s.bar_volatility)} * least({q} / greatest(volume, 1e0), 1e0)"

    decay = f"push * pow(5e-1, (t - push_t) / {n(s.half_life)})" if s.kind == "permanent" else "0e0"
    reference = "case when fresh then open else close end" if a.fill_timing == "next_open" else "close"
    fin = f.financing
    accrual = f"case when t > 0 then (cash2 * (case when cash2 >= 0 then {n(fin.cash_rate)} else {n(fin.borrow_rate)} end) - greatest(0e0, -pos2) * last_close * {n(fin.short_fee)}) / {n(fin.bars_per_year)} else 0e0 end" if fin else "0e0"
    value = "w * equity"
    units = "({value} / close)" if a.fractional else "trunc({value} / close)"
    if fin and fin.max_leverage is not None:
        value = f"greatest(-({n(fin.max_leverage)} * equity), least({n(fin.max_leverage)} * equity, w * equity))"
    at_close = a.fill_timing == "close" and f.limit_offset_bps is None
    limit = f"close * (1e0 - sg * {n(f.limit_offset_bps)} / 1e4)" if f.limit_offset_bps is not None else "null::double"
    expiry = f"t + {f.limit_expiry_bars}" if f.limit_offset_bps is not None else "null::integer"
    q5 = f"(case when ord then {upto('abs(delta)')} else 0e0 end)" if at_close else "0e0"
    begin = f"select distinct run, -1 as t, {n(a.capital)} as cash" if many else f"select -1 as t, {n(a.capital)} as cash"
    return f"""{name} as (
{begin}, 0e0 as pos, 0e0 as wq, 0e0 as wsg, null::double as wlim, null::integer as wexp, false as fresh, 0e0 as push, 0 as push_t, 0e0 as last_close, 0e0 as cancelled, 0e0 as expired,
 0e0 as mark_cash, 0e0 as mark_pos, 0e0 as equity, 0e0 as q_a, 0e0 as p_a, 0e0 as r_a, 0e0 as f_a, 0e0 as q_b, 0e0 as p_b, 0e0 as f_b, 0e0 as s_b, 0e0 as s_a{f" from {feed}" if many else ""}
union all
select {run}t, case when q5 > 0 then cash3 - (sg * q5 * p5 + fee5) else cash3 end, case when q5 > 0 then pos2 + sg * q5 else pos2 end,
 case when ord then (case when abs(delta) - q5 > 1e-12 then abs(delta) - q5 else 0e0 end) else wq3 end, case when ord then sg else wsg end, case when ord then {limit} else wlim end, case when ord then {expiry} else wexp end,
 case when ord then {'false' if at_close or f.limit_offset_bps is not None else 'true'} else false end,
 case when q5 > 0 then {pushed('q5', 'sg', 'push5') if s.kind == 'permanent' else '0e0'} else push2 end, case when q5 > 0 then t else push_t2 end, close,
 case when ord then cancelled + wq3 else cancelled end, expired2, cash3, pos2, equity, q1, p1, ref1, fee1, q5, p5, fee5, sg, s1
from (select *, {price('q5', 'sg', 'close', 'push5')} as p5, {fee('q5', price('q5', 'sg', 'close', 'push5'))} as fee5
from (select *, {q5} as q5, {decay.replace('push_t', 'push_t2').replace('push *', 'push2 *')} as push5
from (select *, coalesce(w is not null and close > 0 and equity > 0 and not (delta = 0 or abs(delta * close) < greatest({n(a.band)} * equity, 1e-9)), false) as ord, case when delta > 0 then 1e0 else -1e0 end as sg
from (select *, {units.format(value=value)} - pos2 as delta
from (select *, cash3 + pos2 * close as equity
from (select *, cash2 + ({accrual}) as cash3
from (select *, case when q1 > 0 then cash - (s1 * q1 * p1 + fee1) else cash end as cash2, pos + s1 * q1 as pos2,
 case when wq - q1 > 1e-12 and not (wlim is not null and t >= wexp) then wq - q1 else 0e0 end as wq3, case when wlim is not null and wq - q1 > 1e-12 and t >= wexp then expired + (wq - q1) else expired end as expired2,
 case when q1 > 0 and wlim is null then {pushed('q1', 's1', 'push1') if s.kind == 'permanent' else '0e0'} else push end as push2, case when q1 > 0 and wlim is null then t else push_t end as push_t2
from (select *, case when wlim is not null then wlim else {price('q1', 's1', 'ref1', 'push1')} end as p1, {fee('q1', '(case when wlim is not null then wlim else ' + price('q1', 's1', 'ref1', 'push1') + ' end)')} as fee1
from (select *, {decay} as push1, wsg as s1, {reference} as ref1, case when wq <= 0 then 0e0 when wlim is null or (case when wsg > 0 then low < wlim else high > wlim end) then {upto('wq')} else 0e0 end as q1
from (select b.* exclude ({run}t, equity), fd.* from {name} b join {feed} fd on fd.t = b.t + 1{key}))))))))))
)"""


_FEED = "feed as (select b.t, b.open, b.high, b.low, b.close, b.volume, s.target_weight as w from bars b left join sigs s on s.t = b.t)"


def _book(a: Account, signals: str | None = None, feed: str = _FEED) -> str:
    return f"with recursive {_DAY}, {signals or _momentum(20)}, {feed}, {book_sql(a)}"


def _metrics(curve: str, digits: int = 8, by: str = "series_id") -> str:
    """Metrics of curve(by, t, equity)."""
    return f"""
mr as (select {by}, t, case when p = 0 then 0e0 else equity / p - 1e0 end as r from (select *, lag(equity) over (partition by {by} order by t) as p from {curve}) where p is not null),
ms as (select {by}, avg(r) as m, stddev_samp(r) as s, count(*) as n from mr group by {by}),
md as (select {by}, min(case when top = 0 then 0e0 else equity / top - 1e0 end) as mdd from (select *, max(equity) over (partition by {by} order by t) as top from {curve}) group by {by}),
me as (select {by}, min_by(equity, t) as a, max_by(equity, t) as z, avg(equity) as me from {curve} group by {by})
select {by}, n as n_returns, round(case when n >= 2 and s > 1e-12 * greatest(abs(m), 1e-12) then m / s * sqrt(252e0) else 0e0 end, 8) as sharpe, round(z / a - 1e0, 8) as total_return,
 round(case when a <= 0 or z <= 0 then 0e0 else pow(z / a, 252e0 / n) - 1e0 end, {digits}) as annual_return, round(case when n > 1 then s * sqrt(252e0) else 0e0 end, 8) as annual_volatility, round(mdd, 8) as max_drawdown, round(me, 4) as mean_equity
from me join ms using ({by}) join md using ({by})"""


_DAILY_CURVE = f"{_DAY}, curve as (select 'ALL' as series_id, t, close as equity from bars)"
_EVENT_CURVE = f"{_EVENT}, curve as (select symbol as series_id, t, close as equity from evb)"
_RET = "rets as (select series_id, t, case when p = 0 then 0e0 else equity / p - 1e0 end as r from (select *, lag(equity) over (partition by series_id order by t) as p from curve) where p is not null)"
_MOMENTS = "b0 as (select series_id, avg(r) as m, stddev_samp(r) as sd, count(*) as n from rets group by series_id), mo as (select series_id, any_value(n) as n, any_value(m / sd) as ratio, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 15e-1) as skew, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) as kurt from rets join b0 using (series_id) group by series_id)"
_SPREAD = "sqrt(1e0 - skew * ratio + (kurt - 1e0) / 4e0 * ratio * ratio)"
_ORDERS = "o as (select l_orderkey, l_linenumber, l_suppkey, l_quantity as q, l_extendedprice / l_quantity as px, case when l_returnflag = 'R' then -1e0 else 1e0 end as side from lineitem)"


def _splits_sql(s: PurgedSplitter, start: int, end: str) -> str:
    """Splits of [start, end) of `bars`, end being an SQL expression, from group arithmetic alone: held-out pairs, blocks and what purge and embargo leave, by gaps and islands."""
    n = f"(({end}) - {start})"
    return f"""
g as (select cast(i as integer) as g, cast({start} + i * ({n} // {s.n_groups}) + least(i, {n} % {s.n_groups}) as integer) as lo, cast({start} + (i + 1) * ({n} // {s.n_groups}) + least(i + 1, {n} % {s.n_groups}) as integer) as hi from range({s.n_groups}) r(i)),
pairs as (select cast(row_number() over (order by a.g, b.g) - 1 as integer) as split_id, a.g as ga, b.g as gb from g a join g b on a.g < b.g),
held as (select split_id, unnest([ga, gb]) as g from pairs),
every as (select cast(t as integer) as t from bars where t >= {start}),
bar_ as (select split_id, t, max(case when t >= g.lo and t < g.hi then 1 else 0 end) as test, max(case when t >= g.lo - {s.purge} and t < g.hi + {s.purge + s.embargo} then 1 else 0 end) as gone from every, held join g using (g) group by all),
mark as (select split_id, t, case when test = 1 then 'test' when gone = 0 then 'train' end as kind from bar_),
isles as (select split_id, kind, t, t - row_number() over (partition by split_id, kind order by t) as island from mark where kind is not null),
spans as (select split_id, kind, cast(min(t) as integer) as start, cast(max(t) + 1 as integer) as "end" from isles group by split_id, kind, island)"""


def _leak(build) -> str:
    parts = []
    for i, k in enumerate((5, 20)):
        parts.append(f"{build(k, 'two', f'x{i}', 'span_id')}")
    both = " union all ".join(f"select {i} as setting_id, span_id, t, target_weight as w0 from x{i}" for i in range(2))
    return f"""with {_DAY}, two as (select b.symbol, b.t, s.span_id, case when s.span_id = 1 and b.t > 1200 then b.close * 3 else b.close end as close from bars b, (values (0), (1)) s(span_id)),
{', '.join(parts)}, alls as ({both}),
j as (select coalesce(a.setting_id, b.setting_id) as setting_id, coalesce(a.t, b.t) as t, a.w0 as a, b.w0 as b from (select * from alls where span_id = 0 and t <= 1200) a full join (select * from alls where span_id = 1 and t <= 1200) b on a.setting_id = b.setting_id and a.t = b.t)
select setting_id, min(t) as t, min_by(a, t) as original, min_by(b, t) as altered from j where a is null or b is null or abs(a - b) > 1e-8 group by setting_id"""


def _build() -> dict[str, str]:
    from .catalogue import _CAPITAL, _SPLITTER, ACCOUNTS

    sql = {
        "bars_daily": f"with {_DAY} select symbol, t, time, open, high, low, close, volume from bars",
        "bars_weekly_brand": f"with {_WEEK} select symbol, t, time, open, high, low, close, volume from weeks",
        "bars_hourly_event": f"with {_EVENT} select symbol, t, time, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume from evb",
        "bars_validate": f"with {_EVENT}, e as (select *, lag(time) over (partition by symbol order by t) as b from evb) select symbol, count(*) as n_bars, cast(sum(case when close > 0 then 0 else 1 end) as bigint) as bad_close, cast(sum(case when volume < 0 then 1 else 0 end) as bigint) as bad_volume, cast(sum(case when time <= b then 1 else 0 end) as bigint) as bad_order, cast(sum(case when high < greatest(open, close) or low > least(open, close) then 1 else 0 end) as bigint) as bad_range from e group by symbol",
        "real_opens": f"with {_DAY}, {_EVENT}, u as (select 'ALL' as series_id, t, open, close from bars union all select symbol, t, open, close from evb), g as (select *, lag(close) over (partition by series_id order by t) as b from u) select series_id, max(coalesce(abs(open - b) > 1e-9 * abs(b), false)) as real_opens from g group by series_id",
        "panel_aligned": f"with {_FLAG} select symbol, t, time, close, volume from panel",
        "panel_missing_days": "with d as (select distinct l_returnflag as symbol, l_shipdate as time from lineitem) select symbol, (select count(distinct time) from d) - count(*) as missing from d group by symbol",
        "sig_momentum": f"with {_DAY}, {_momentum(20)} select t, symbol, target_weight from sigs",
        "sig_momentum_grid": f"with {_DAY}, {', '.join(_momentum(k, name=f's{k}x') for k in (5, 20, 60))} " + " union all ".join(f"select {i} as setting_id, t, target_weight from s{k}x" for i, k in enumerate((5, 20, 60))),
        "sig_leaky_momentum": f"with {_DAY}, {_leaky(20)} select t, symbol, target_weight from sigs",
        "sig_sma": f"with {_DAY}, a as (select *, avg(close) over (order by t rows 19 preceding) as f, avg(close) over (order by t rows 99 preceding) as s from bars) select t, symbol, case when f > s then 1e0 else 0e0 end as target_weight from a where t >= 99",
        "sig_buy_hold": f"with {_DAY} select t, symbol, 1e0 as target_weight from bars where t = 0",
        "sig_xs_momentum": f"with {_FLAG}, m as (select symbol, t, ln(close / lag(close, 60) over (partition by symbol order by t)) as score from panel), k as (select *, dense_rank() over (order by t) - 1 as k, count(*) over (partition by t) as here from m where score is not null), r as (select *, row_number() over (partition by t order by score desc, symbol) as up, row_number() over (partition by t order by score, symbol desc) as dn from k where here = (select count(distinct symbol) from panel) and k % 21 = 0), g as (select *, case when dn <= 1 then -5e-1 when up <= 1 then 5e-1 else 0e0 end as target_weight from r), h as (select *, abs(target_weight) - abs(coalesce(lag(target_weight) over (partition by symbol order by t), 0e0)) as change from g) select t, cast(row_number() over (partition by t order by change, symbol) - 1 as integer) as seq, symbol, target_weight from h",
        "full_sample_stats": f"with {_DAY} select symbol, count(*) as n, round(avg(close), 6) as mean, round(stddev_pop(close), 6) as sd from bars group by symbol",
        "bar_volatility": f"with {_DAY}, r as (select ln(close / lag(close) over (order by t)) as r from bars where t < 504) select 'ALL' as series_id, round(stddev_samp(r), 8) as volatility from r",
        "book_totals": f"{_book(ACCOUNTS['book_limit'])} select round(cash, 2) as final_cash, round(pos, 2) as final_position, round(cancelled, 2) as cancelled, round(expired, 2) as expired, round(cancelled + expired, 2) as unfilled from book where t = (select max(t) from bars)",
        "blotter_reconcile": f"{_book(ACCOUNTS['book_impact'])}, fl as (select s_b as sg, q_b as q, p_b as p, f_b as f, b.close as r from book k join bars b using (t) where q_b > 0) select case when sg > 0 then 'BUY' else 'SELL' end as direction, count(*) as n, round(sum(q), 4) as quantity, round(sum(f), 4) as commission, round(sum(abs(p - r) * q), 4) as slippage from fl group by 1",
        "identity_check": f"with {_DAY} select count(*) as n, 0e0 as gap from bars",
        "bh_equity": f"with {_DAY} select t, round(case when t = 0 then {_number(_CAPITAL)} else {_number(_CAPITAL)} / first_value(close) over (order by t) * close end, 2) as equity from bars",
        "bh_equity_costed": f"{_book(ACCOUNTS['book_impact'], 'sigs as (select 0 as t, 1e0 as target_weight)')} select t, round(mark_cash, 2) as cash, round(mark_pos, 4) as position, round(equity, 2) as equity from book where t >= 0",
        "bh_metrics": f"with {_DAILY_CURVE}, {_metrics('curve')}",
        "metrics_all": f"with {_EVENT_CURVE}, {_metrics('curve', 4)}",
        "curve_zero_cost_band0": f"with {_DAY}, a as (select *, avg(close) over (order by t rows 19 preceding) as f, avg(close) over (order by t rows 99 preceding) as s from bars), w as (select t, close, case when f > s then 1e0 else 0e0 end as w from a where t >= 99), g as (select t, 1e0 + coalesce(lag(w) over (order by t) * (close / lag(close) over (order by t) - 1e0), 0e0) as g from w) select t, round(product(g) over (order by t rows unbounded preceding), 8) as growth from g",
        "returns": f"with {_DAILY_CURVE}, {_RET} select t, round(r, 8) as r from rets",
        "drawdown_curve": f"with {_DAILY_CURVE} select t, round(equity / max(equity) over (order by t) - 1e0, 8) as drawdown from curve",
        "sharpe_by_series": f"with {_EVENT_CURVE}, {_RET} select series_id, count(*) as n, round(avg(r) / stddev_samp(r) * sqrt(252e0), 8) as sharpe from rets group by series_id",
        "psr": f"with {_DAILY_CURVE}, {_RET}, {_MOMENTS}, z as (select series_id, n, ratio * sqrt(n - 1e0) / {_SPREAD} as z from mo) select series_id, n, round({normal_cdf_sql('z')}, 8) as psr from z",
        "dsr": f"with {_DAILY_CURVE}, {_RET}, {_MOMENTS}, {_EVENT}, er as (select symbol, close / lag(close) over (partition by symbol order by t) - 1e0 as r from evb), tr as (select avg(r) / stddev_samp(r) as s from er where r is not null group by symbol), k as (select cast(count(*) as double) as k, var_samp(s) as v from tr), x as (select {expected_max_sql('k', 'v')} as bar from k), z as (select series_id, bar, (ratio - bar) * sqrt(n - 1e0) / {_SPREAD} as z from mo, x) select series_id, round(bar, 8) as bar, round({normal_cdf_sql('z')}, 8) as dsr from z",
        "slippage_fixed": f"with {_ORDERS} select l_orderkey, l_linenumber, l_suppkey, px * (1e0 + side * 2e-4) as fill from o",
        "slippage_impact": f"with {_ORDERS} select l_orderkey, l_linenumber, l_suppkey, round(px * (1e0 + side * (2e-4 + 6e-1 * 126e-4 * sqrt(least(q / 1000e0, 1e0)))), 6) as fill from o",
        "commission_per_share": f"with {_ORDERS} select side, count(*) as n, round(sum(least(greatest(1e0, 5e-3 * q), 1e-2 * abs(q * px))), 2) as fee from o group by side",
        "commission_pct": f"with {_ORDERS} select side, round(sum(abs(q * px) * 1e-4), 2) as fee from o group by side",
        "financing_accrual": "select c_custkey, round((c_acctbal * (case when c_acctbal >= 0 then 2e-2 else 6e-2 end) - (case when c_custkey % 3 = 0 then 1000e0 else 0e0 end) * 3e-2) / 252e0, 8) as accrual from customer",
        "folds_rolling": f"with {_DAY}, n as (select cast(count(*) as integer) as n from bars) select 'ALL' as series_id, cast((s - 504) // 252 as integer) as fold_id, cast(s - 504 as integer) as train_start, cast(s as integer) as train_end, cast(s as integer) as test_start, cast(s + 252 as integer) as test_end, cast(s - 95 as integer) as eval_start from n, lateral (select unnest(generate_series(504, n - 252, 252)) as s)",
        "folds_anchored": f"with {_DAY}, n as (select cast(count(*) as integer) as n from bars) select 'ALL' as series_id, cast((s - 504) // 252 as integer) as fold_id, 0 as train_start, cast(s as integer) as train_end, cast(s as integer) as test_start, cast(s + 252 as integer) as test_end, cast(s as integer) as eval_start from n, lateral (select unnest(generate_series(504, n - 252, 252)) as s)",
        "cpcv_groups": f"with {_DAY}, g as (select t, cast(ntile(6) over (order by t) - 1 as integer) as group_id from bars) select 'ALL' as series_id, group_id, min(t) as start, max(t) + 1 as \"end\" from g group by group_id",
        "cpcv_splits": f"with {_DAY}, {_splits_sql(_SPLITTER, 100, "select count(*) from bars")} select split_id, kind, start, \"end\" from spans",
        "cpcv_paths": f"with {_DAY}, {_splits_sql(_SPLITTER, 100, "select count(*) from bars")} select cast(row_number() over (partition by g order by split_id) - 1 as integer) as path_id, g as group_id, split_id from held",
        "cpcv_train_bars": f"with {_DAY}, {_splits_sql(_SPLITTER, 100, "select count(*) from bars")} select split_id, count(*) as n from mark join bars using (t) where kind = 'train' group by split_id",
        "leak_check_honest": _leak(_momentum),
        "leak_check_leaky": _leak(_leaky),
    }
    for name, account in ACCOUNTS.items():
        sql[
            name
        ] = f"{_book(account)} select t, round(mark_cash, 2) as cash, round(mark_pos, 4) as position, round(equity, 2) as equity from book where t >= 0"
    fit = []
    for k, look in enumerate((5, 20, 60)):
        fit.append(
            f"(with recursive {_DAY}, {_momentum(look)}, {_FEED}, {book_sql(ACCOUNTS['book_close'])}, e as (select t, equity from book where t >= 503), r as (select equity / lag(equity) over (order by t) - 1e0 as r from e) select cast({k} as bigint) as setting_id, count(r) as n, avg(r) / stddev_samp(r) * sqrt(252e0) as s from r where r is not null)"
        )
    sql[
        "fit_in_sample"
    ] = f"select setting_id, n, round(s, 6) as sharpe, row_number() over (order by s desc, setting_id) = 1 as best from ({' union all '.join(fit)})"
    sql[
        "stream_paper"
    ] = f"{_book(ACCOUNTS['book_next_close'])} select 'ALL' as symbol, t, round(cash, 2) as cash, round(pos, 4) as position, round(cash + pos * last_close, 2) as equity from book where t >= 0"
    return sql


SQL = _build()
