"""DuckDB SQL of whole studies: ladder, walk-forward and purged cross-validation, all runs of an account in one recursion."""

from __future__ import annotations

from dataclasses import replace

from .catalogue_sql import _leaky, _momentum, _number, _splits_sql, book_sql
from .functions.stats import expected_max_sql, normal_cdf_sql
from .operators.book import Account, Commission, Slippage
from .operators.signals import Spec
from .operators.spans import PurgedSplitter
from .plans.ladder import Settings, rungs

_SPREAD = "sqrt(1e0 - skew * ratio + (kurt - 1e0) / 4e0 * ratio * ratio)"


def _signals(spec: Spec, name: str, source: str, leaky: bool = False) -> list[str]:
    """One CTE for each setting, named {name}{k}; windows restart in each span."""
    out = []
    for k, p in enumerate(spec.grid):
        if spec.name == "momentum":
            out.append((_leaky if leaky else _momentum)(int(p["lookback"]), source, f"{name}{k}", "span", None))
        else:
            w = "over (partition by span order by t rows {} preceding)"
            fast, slow = int(p["fast"]), int(p["slow"])
            out.append(
                f"{name}{k}a as (select *, avg(close) {w.format(fast - 1)} as f, avg(close) {w.format(slow - 1)} as s from {source}), "
                f"{name}{k} as (select *, case when f > s then 1e0 else 0e0 end as target_weight from {name}{k}a where t >= {slow - 1})"
            )
    return out


def _feed(spec: Spec, name: str, signals: str, where: str, tag: str) -> str:
    """Feed rows of every setting over the spans that `where` chooses."""
    each = [
        f"select b.span || '/{k}/{tag}' as run, b.t, b.open, b.high, b.low, b.close, b.volume, g.target_weight as w from sb b left join {signals}{k} g on g.span = b.span and g.t = b.t where b.{where}"
        for k in range(len(spec.grid))
    ]
    return f"{name} as ({' union all '.join(each)})"


def _returns(books: str) -> str:
    """Scored points and returns of books(acct, run, t, equity ...); a run's span says from which bar it is scored."""
    return f"""sc as (select acct, run, k.t, equity, span_kind, series_id, fold, setting, leaky from {books} k join rn using (run) where k.t >= greatest(0, warm - 1)),
rt as (select *, equity / p - 1e0 as r from (select *, lag(equity) over (partition by acct, run order by t) as p from sc) where p is not null),
sh as (select acct, run, any_value(series_id) as series_id, any_value(span_kind) as span_kind, any_value(fold) as fold, any_value(setting) as setting, any_value(leaky) as leaky, count(*) as n, avg(r) as m, stddev_samp(r) as sd,
 case when count(*) >= 2 and stddev_samp(r) > 1e-12 * greatest(abs(avg(r)), 1e-12) then avg(r) / stddev_samp(r) * sqrt(252e0) else 0e0 end as sharpe from rt group by acct, run)"""


def _curve(points: str, by: str) -> str:
    """Metrics of points(by, t, equity) beside a ratio."""
    return f"""select {by}, case when min_by(equity, t) = 0 then 0e0 else max_by(equity, t) / min_by(equity, t) - 1e0 end as total_return, min_by(equity, t) as a, max_by(equity, t) as z, avg(equity) as mean_equity, count(*) - 1 as points,
 min(case when top = 0 then 0e0 else equity / top - 1e0 end) as max_drawdown from (select *, max(equity) over (partition by {by} order by t) as top from {points}) group by {by}"""


def _moments(returns: str, by: str) -> str:
    return f"""select {by}, any_value(n) as n, any_value(m / sd) as ratio, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 15e-1) as skew, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) as kurt
 from (select *, avg(r) over (partition by {by}) as m, stddev_samp(r) over (partition by {by}) as sd, count(*) over (partition by {by}) as n from {returns}) group by {by}"""


def _annual(z: str = "z", a: str = "a", n: str = "n") -> str:
    return f"case when {a} <= 0 or {z} <= 0 then 0e0 else pow({z} / {a}, 252e0 / {n}) - 1e0 end"


def ladder_sql(bars: str, spec: Spec, settings: Settings, slippage: Slippage, commission: Commission) -> str:
    """CTEs up to `ladder`, the table of run_ladder unrounded; bars: CTEs that end in bars(series_id, t, open ...)."""
    steps = rungs(spec, settings, slippage, commission)
    free = Account(capital=settings.capital, band=settings.band)
    accounts = {
        "free": free,
        "slip": replace(free, slippage=slippage),
        "full": replace(free, slippage=slippage, commission=commission),
    }
    of = {a: name for name, a in accounts.items()}
    grid = range(len(spec.grid))
    train, test, warm = settings.train_size, settings.test_size, spec.warmup
    looks = spec.build_look_ahead is not None
    feeds = {
        "free": [_feed(spec, "ff", "g", "kind = 'all'", "h")],
        "slip": [_feed(spec, "fs", "g", "kind = 'all'", "h")],
        "full": [_feed(spec, "fu", "g", "kind <> ''", "h")],
    }
    parts = [
        bars,
        "nn as (select series_id, cast(count(*) as integer) as n from bars group by series_id)",
        f"folds as (select series_id, cast((s - {train}) // {test} as integer) as fold, cast(s as integer) as te0 from nn, lateral (select unnest(generate_series({train}, n - {test}, {test})) as s))",
        f"spans as (select series_id, 'all' as kind, 0 as fold, 0 as lo, max(te0) + {test} as hi, min(te0) as warm from folds group by series_id union all select series_id, 'train', fold, te0 - {train}, te0, {min(warm, max(0, train - 2))} from folds "
        f"union all select series_id, 'test', fold, te0 - {warm}, te0 + {test}, {warm} from folds)",
        "sb as (select s.series_id || '/' || s.kind || '/' || s.fold as span, s.series_id, s.kind, s.fold, s.warm, cast(b.t - s.lo as integer) as t, b.open, b.high, b.low, b.close, b.volume from spans s join bars b on b.series_id = s.series_id and b.t >= s.lo and b.t < s.hi)",
        *_signals(spec, "g", "sb"),
    ]
    if looks:
        parts += ["sa as (select * from sb where kind = 'all')", *_signals(spec, "l", "sa", True)]
        feeds["free"].append(_feed(spec, "fl", "l", "kind = 'all'", "l"))
    hold = "fh as (select span || '/-1/h' as run, t, open, high, low, close, volume, case when t = 0 then 1e0 end as w from sb where kind = 'all')"
    feeds["full"].append(hold)
    for name, many in feeds.items():
        parts += many
        parts.append(f"feed_{name} as (" + " union all ".join(f"select * from {f.split(' ')[0]}" for f in many) + ")")
        parts.append(book_sql(accounts[name], f"feed_{name}", f"book_{name}", True))
    books = " union all ".join(
        f"select '{name}' as acct, run, t, equity, q_b as q, p_b as p, f_b as f, last_close as ref from book_{name} where t >= 0" for name in accounts
    )
    ids = ", ".join(f"({k}, '{x}')" for k in [*grid, -1] for x in (("h", "l") if looks else ("h",)))
    parts += [
        f"bk as materialized ({books})",
        f"rn as (select span || '/' || k || '/' || x as run, series_id, kind as span_kind, fold, warm, k as setting, x as leaky from (select distinct span, series_id, kind, fold, warm from sb), (values {ids}) v(k, x))",
        _returns("bk"),
        "cost as (select acct, run, cast(sum(case when q > 0 then 1 else 0 end) as bigint) as n_trades, sum(case when q > 0 then f else 0e0 end) as commission, sum(case when q > 0 then abs(p - ref) * q else 0e0 end) as slippage, sum(case when q > 0 then abs(q * p) else 0e0 end) as notional from bk group by acct, run)",
        f"cm as ({_curve('sc', 'acct, run')})",
        "best as (select * from (select *, row_number() over (partition by acct, series_id, span_kind, fold, leaky order by sharpe desc, setting) as k from sh where setting >= 0) where k = 1)",
        "trial as (select acct, series_id, leaky, cast(count(*) as double) as k, coalesce(var_samp(sharpe / sqrt(252e0)), 0e0) as v from sh where span_kind = 'all' and setting >= 0 group by acct, series_id, leaky)",
        f"mo as ({_moments('rt', 'acct, run')})",
        f"bar as (select *, {expected_max_sql('k', 'v')} as floor_ from trial)",
        f"edge as (select b.acct, b.run, (ratio - floor_) * sqrt(mo.n - 1e0) / {_SPREAD} as zz from best b join mo using (acct, run) join bar using (acct, series_id, leaky) where b.span_kind = 'all')",
        "hold as (select series_id, sharpe as buy_hold_sharpe from sh where setting = -1 and acct = 'full' and span_kind = 'all')",
        f"stages as (select * from (values {', '.join(f'({i + 1}, {chr(39)}{r.name}{chr(39)}, {chr(39)}{of[r.account]}{chr(39)}, {chr(39)}{chr(108) if r.leaky else chr(104)}{chr(39)})' for i, r in enumerate(steps))}) v(stage, name, acct, leaky))",
        f"grid as (select * from (values {', '.join(f'({k}, {chr(39)}{_json(spec.grid[k])}{chr(39)})' for k in grid)}) v(setting, params))",
        f"""inside as (select b.series_id, st.stage, st.name, false as honest, b.sharpe, {normal_cdf_sql('zz')} as p_edge, total_return, {_annual()} as annual_return, sd * sqrt(252e0) as annual_volatility, max_drawdown,
 notional / mean_equity / greatest(b.n / 252e0, 1e-9) as turnover, n_trades, commission, slippage, notional, b.n as n_returns, '[' || params || ']' as chosen
 from stages st join best b on b.acct = st.acct and b.leaky = st.leaky and b.span_kind = 'all' join cm on cm.acct = b.acct and cm.run = b.run join cost c on c.acct = b.acct and c.run = b.run join edge e on e.acct = b.acct and e.run = b.run join grid using (setting))""",
        "pick as (select series_id, fold, setting, series_id || '/test/' || fold || '/' || setting || '/h' as run from best where acct = 'full' and span_kind = 'train')",
        "wr as (select p.series_id, row_number() over (partition by p.series_id order by p.fold, rt.t) as t, r from pick p join rt on rt.run = p.run and rt.acct = 'full')",
        f"wc as (select series_id, t, {_number(settings.capital)} * product(1e0 + r) over (partition by series_id order by t) as equity from wr union all select distinct series_id, 0, {_number(settings.capital)} from wr)",
        f"wm as ({_curve('wc', 'series_id')})",
        "wq as (select series_id, equity / p - 1e0 as r from (select *, lag(equity) over (partition by series_id order by t) as p from wc) where p is not null)",
        "ws as (select series_id, count(*) as n, avg(r) as m, stddev_samp(r) as sd from wq group by series_id)",
        f"wo as ({_moments('wr', 'series_id')})",
        f"wp as (select series_id, {normal_cdf_sql('zz')} as p_edge from (select series_id, ratio * sqrt(n - 1e0) / {_SPREAD} as zz from wo))",
        "wk as (select p.series_id, cast(sum(n_trades) as bigint) as n_trades, sum(commission) as commission, sum(slippage) as slippage, sum(notional) as notional, '[' || string_agg(params, ', ' order by p.fold) || ']' as chosen from pick p join cost c on c.run = p.run and c.acct = 'full' join grid using (setting) group by p.series_id)",
        f"""walk as (select series_id, {len(steps) + 1} as stage, '+ walk-forward OOS' as name, true as honest, m / sd * sqrt(252e0) as sharpe, p_edge, total_return, {_annual()} as annual_return, sd * sqrt(252e0) as annual_volatility, max_drawdown,
 notional / mean_equity / greatest(n / 252e0, 1e-9) as turnover, n_trades, commission, slippage, notional, n as n_returns, chosen from ws join wm using (series_id) join wp using (series_id) join wk using (series_id))""",
        "ladder as (select x.*, buy_hold_sharpe from (select * from inside union all select * from walk) x join hold using (series_id))",
    ]
    return "with recursive " + ",\n".join(parts)


def _json(params: dict) -> str:
    import json

    return json.dumps(params)


def cpcv_sql(
    bars: str,
    spec: Spec,
    settings: Settings,
    splitter: PurgedSplitter,
    slippage: Slippage,
    commission: Commission,
    end: str,
) -> str:
    """CTEs up to picks(split_id, setting_id) and paths(path_id, sharpe) of run_cpcv over [warmup, end); end is an SQL number of `bars`."""
    history = max(spec.warmup, 1)
    full = Account(capital=settings.capital, band=settings.band, slippage=slippage, commission=commission)
    ids = ", ".join(f"({k}, 'h')" for k in range(len(spec.grid)))
    parts = [
        bars,
        _splits_sql(splitter, history, end),
        f"segs as (select distinct start as lo, \"end\" as hi from spans where kind = 'train' and \"end\" - start >= {spec.warmup + 2})",
        f"parts as (select 'train' as kind, lo * 100000 + hi as fold, lo, hi, {spec.warmup} as warm from segs union all select 'test', g, lo - {history}, hi, {history} from g)",
        "sb as (select 'S/' || p.kind || '/' || p.fold as span, 'S' as series_id, p.kind, p.fold, p.warm, cast(b.t - p.lo as integer) as t, b.open, b.high, b.low, b.close, b.volume from parts p join bars b on b.t >= p.lo and b.t < p.hi)",
        *_signals(spec, "g_", "sb"),
        _feed(spec, "fu", "g_", "kind <> ''", "h"),
        book_sql(full, "fu", "book_full", True),
        "bk as materialized (select 'full' as acct, run, t, equity from book_full where t >= 0)",
        f"rn as (select span || '/' || k || '/' || x as run, series_id, kind as span_kind, fold, warm, k as setting, x as leaky from (select distinct span, series_id, kind, fold, warm from sb), (values {ids}) v(k, x))",
        _returns("bk"),
        "pooled as (select s.split_id, rt.setting, r from spans s join rt on rt.span_kind = 'train' and rt.fold = s.start * 100000 + s.\"end\" where s.kind = 'train')",
        "scores as (select split_id, setting, avg(r) / stddev_samp(r) * sqrt(252e0) as sharpe from pooled group by split_id, setting)",
        "picks as (select split_id, setting as setting_id from (select *, row_number() over (partition by split_id order by sharpe desc, setting) as k from scores) where k = 1)",
        "members as (select cast(row_number() over (partition by g order by split_id) - 1 as bigint) as path_id, g, split_id from held)",
        "paths as (select path_id, avg(r) / stddev_samp(r) * sqrt(252e0) as sharpe from members m join picks p using (split_id) join rt on rt.span_kind = 'test' and rt.fold = m.g and rt.setting = p.setting_id group by path_id)",
    ]
    return "with recursive " + ",\n".join(parts)
