"""Driver queries that run single operators of the engine, each beside its DuckDB SQL."""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import catalogue as c
from .catalogue_sql import _DAY, _EVENT, _FLAG, _momentum, _number
from .catalogue_sql import _book as _sql_book
from .catalogue_sql import SQL as _BOOKS
from .functions import stats
from .operators import leaks
from .operators import signals as sig
from .operators.book import Account, Commission, Financing, Frictions, Slippage
from .operators.runs import equity_of, event_counts, fills_of, gross_exposure, manifest, run_backtests, span_bars
from .operators.spans import merge_spans, subtract_spans, walk_forward_folds
from .plans import cli, ladder, report
from .plans.tables import shared_folder
from .sources import bars as src
from .study_sql import cpcv_sql, ladder_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
_CAPITAL = c._CAPITAL
_IMPACT = Slippage("impact", 2.0, 0.6, 0.0126)


def _query(sql: str):
    """Register a query with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Sources

_RAW_DAY = "rd as (select l_shipdate as time, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as px, cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume from lineitem group by l_shipdate)"


def _raw_day(spark, sf) -> DataFrame:
    return src._ratio_of_sums(c._lineitem(spark, sf), "l_shipdate").select(
        F.col("l_shipdate").alias("time"), (F.col("paid") / F.col("volume")).alias("px"), "volume"
    )


_DERIVED = "d as (select cast(row_number() over (order by time) - 1 as integer) as t, time, px / 2e0 as close, volume from rd), e as (select *, coalesce(lag(close) over (order by t), close) as open from d)"


@_query(
    f"with {_RAW_DAY}, {_DERIVED} select 'PRICES' as symbol, t, cast(time as timestamp) as time, open, greatest(open, close) as high, least(open, close) as low, close, volume from e"
)
def bars_csv(spark, sf):
    """A CSV file of closes and adjusted closes, other spellings and column order, read as bars."""
    at = _folder(spark, "prices") + ".csv"
    day = _raw_day(spark, sf).select(
        F.col("volume").alias("Volume"),
        (F.col("px") / 2).alias("adj close"),
        F.date_format("time", "yyyy-MM-dd").alias(" Date"),
        F.col("px").alias("CLOSE"),
    )
    day.coalesce(1).sortWithinPartitions(" Date").write.option("header", True).csv(at)
    return src.load_bars(spark, at, "PRICES").select("symbol", "t", "time", "open", "high", "low", "close", "volume")


@_query(
    f"with {_DAY} select 'ALL' as symbol, t, cast(time as timestamp) as time, open, high, low, close, 5e2 as volume from bars"
)
def bars_parquet(spark, sf):
    """A Parquet price table without volumes, read as bars with an assumed one."""
    at = _folder(spark, "all") + ".parquet"
    c._daily(spark, sf).select(F.col("time").alias("Timestamp"), "open", "high", "low", "close").write.parquet(at)
    return src.load_bars(spark, at, "ALL", default_volume=500.0).select(
        "symbol", "t", "time", "open", "high", "low", "close", "volume"
    )


_FLAGS = "fd as (select l_returnflag as symbol, l_shipdate as time, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as close, cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume from lineitem group by all)"


def _flag_days(spark, sf) -> DataFrame:
    day = src._ratio_of_sums(c._lineitem(spark, sf), "l_shipdate", "l_returnflag")
    return day.select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").alias("time"),
        (F.col("paid") / F.col("volume")).alias("close"),
        "volume",
    )


@_query(
    f"with {_FLAGS}, fc as (select time from fd group by time having count(*) = (select count(distinct symbol) from fd)) select symbol, cast(row_number() over (partition by symbol order by time) - 1 as integer) as t, cast(time as timestamp) as time, close, volume from fd join fc using (time)"
)
def panel_csv(spark, sf):
    """A price file for each flag, read as one panel over the dates that all of them have."""
    top, paths = _folder(spark, "panel"), []
    days = _flag_days(spark, sf)
    for flag in ("A", "N", "R"):
        paths.append(f"{top}/{flag}.csv")
        one = days.where(F.col("symbol") == flag).select(
            F.date_format("time", "yyyy-MM-dd").alias("date"), "close", "volume"
        )
        one.coalesce(1).sortWithinPartitions("date").write.option("header", True).csv(paths[-1])
    return src.load_panel(spark, paths).select("symbol", "t", "time", "close", "volume")


@_query(
    f"with {_FLAGS}, fc as (select time from fd group by time having count(*) = (select count(distinct symbol) from fd)) select symbol, cast(row_number() over (partition by symbol order by time) - 1 as integer) as t, time, close, volume from fd join fc using (time)"
)
def panel_aligned(spark, sf):
    """Days of the flags, each on its own calendar, aligned."""
    days = _flag_days(spark, sf).select(
        "symbol",
        F.lit(0).alias("t"),
        "time",
        *[F.col("close").alias(x) for x in ("open", "high", "low", "close")],
        "volume",
        F.col("symbol").alias("series_id"),
    )
    return src.align_panel(days).select("symbol", "t", "time", "close", "volume")


@_query(
    f"with {_FLAGS}, n as (select time, count(*) as k from fd group by time), s as (select count(distinct symbol) as k from fd) select 'raw' as which, (select bool_and(n.k = s.k) from n, s) as equal_calendars union all select 'aligned', true"
)
def panel_calendars(spark, sf):
    """Whether the flags share a calendar before and after alignment."""
    days = _flag_days(spark, sf).withColumn("t", F.lit(0)).withColumn("series_id", F.lit("P")).withColumns(
        {x: F.col("close") for x in ("open", "high", "low")}
    )
    return spark.createDataFrame(
        [("raw", src.same_calendar(days)), ("aligned", src.same_calendar(src.align_panel(days)))],
        "which string, equal_calendars boolean",
    )


_PLANTED = "case when o_orderkey % 97 = 0 then 'x' when o_orderkey % 89 = 0 then cast(-o_totalprice as varchar) when o_orderkey % 83 = 0 then 'nan' else cast(o_totalprice as varchar) end"


@_query(
    "with r as (select cast(o_custkey % 7 as varchar) as symbol, o_orderdate as time, o_orderkey, o_orderkey % 97 = 0 or o_orderkey % 89 = 0 or o_orderkey % 83 = 0 as bad_close, o_orderkey % 79 = 0 as bad_volume, o_orderkey % 101 = 0 as bad_date from orders),"
    " g as (select symbol, max(time) as time, min_by(bad_close, o_orderkey) as bad_close, min_by(bad_volume, o_orderkey) as bad_volume, min_by(bad_date, o_orderkey) as bad_date from r group by symbol, time),"
    " f as (select symbol, case when bad_date then 'date can''t be read' when bad_close then 'close must be a positive number' when bad_volume then 'volume must be a number that isn''t negative' end as fault from g)"
    " select symbol, fault, count(*) as n from f where fault is not null group by symbol, fault"
)
def bars_validate(spark, sf):
    """Faults planted in a price table, by symbol and the rule they break."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey")
    o = o.withColumn("symbol", (F.col("o_custkey") % 7).cast("string")).groupBy("symbol", "o_orderdate").agg(
        F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_totalprice", "o_orderkey").alias("px")
    )
    close = F.when(k % 97 == 0, "x").when(
        k % 89 == 0, (-F.col("px")).cast("string")
    ).when(k % 83 == 0, "nan").otherwise(F.col("px").cast("string"))
    # a date that can't be read sorts first and has no date before it that could be out of order
    date = F.when(k % 101 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    raw = o.select(
        "symbol", date.alias("date"), close.alias("close"), F.when(k % 79 == 0, "-1").otherwise("5").alias("volume")
    )
    return src.price_faults(raw).groupBy("symbol", "fault").agg(F.count(F.lit(1)).alias("n"))


@_query(f"with {_DAY} select symbol, t, round(open, 6) as open, round(close, 6) as close, volume from bars")
def prices_written_and_read(spark, sf):
    """Bars written as a price file and read again."""
    at = _folder(spark, "written") + ".csv"
    src.write_prices(c._daily(spark, sf), at)
    return c._rounded(
        src.load_bars(spark, at, "ALL").select("symbol", "t", "open", "close", "volume"), {"open": 6, "close": 6}
    )


@_query(
    f"with {_DAY}, d as (select *, coalesce(lag(close) over (order by t), close) as o from bars) select 'S' as symbol, t + 5 as t, round(o, 6) as open, close, volume from d"
)
def bars_of_series(spark, sf):
    """Closes and volumes alone as bars that start at another index."""
    return c._rounded(
        src.bars_from_series(c._daily(spark, sf).select("t", "close", "volume"), "S", 5).select(
            "symbol", "t", "open", "close", "volume"
        ),
        {"open": 6},
    )


@_query(f"with {_DAY} select 'ALL' as symbol, t, round(close, 6) as close, volume from bars where t >= 100 and t < 400")
def bars_fetched(spark, sf):
    """A download through a function of one's own."""
    rows = [
        (
            str(r["time"])[:10], r["open"], r["high"], r["low"], r["close"], r["close"], r["volume"]
        ) for r in c._daily(spark, sf).where("t >= 100 and t < 400").orderBy("t").collect()
    ]
    return src.fetched_bars(spark, "ALL", "", "", lambda *_: rows).select(
        "symbol", (F.col("t") + 100).alias("t"), F.round("close", 6).alias("close"), "volume"
    )


# Costs over orders, by the models themselves


def _orders(spark, sf) -> DataFrame:
    return c._orders(spark, sf)


@_query(_BOOKS["slippage_fixed"])
def slippage_fixed(spark, sf):
    q, px, side = F.col("q"), F.col("px"), F.col("side")
    return _orders(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_suppkey", Slippage("bps", 2.0).column(side, q, px, F.lit(1000.0)).alias("fill")
    )


@_query(
    "with o as (select l_orderkey, l_linenumber, l_suppkey, l_extendedprice / l_quantity as px from lineitem) select l_orderkey, l_linenumber, l_suppkey, px as fill, 0e0 as fee from o"
)
def costs_none(spark, sf):
    q, px, side = F.col("q"), F.col("px"), F.col("side")
    return _orders(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        Slippage().column(side, q, px, F.lit(1.0)).alias("fill"),
        Commission().column(q, px).alias("fee"),
    )


@_query(_BOOKS["slippage_impact"])
def slippage_impact(spark, sf):
    fill = _IMPACT.column(F.col("side"), F.col("q"), F.col("px"), F.lit(1000.0))
    return _orders(spark, sf).select("l_orderkey", "l_linenumber", "l_suppkey", F.round(fill, 6).alias("fill"))


@_query(
    "with o as (select l_orderkey, l_linenumber, l_suppkey, l_quantity as q, l_extendedprice / l_quantity as px, case when l_returnflag = 'R' then -1e0 else 1e0 end as side, l_discount - 5e-2 as push from lineitem) select l_orderkey, l_linenumber, l_suppkey, round(px * (1e0 + side * (2e-4 + 6e-1 * 126e-4 * sqrt(least(q / 1000e0, 1e0)))) + px * side * greatest(0e0, side * push), 6) as fill from o"
)
def slippage_pushed(spark, sf):
    """Permanent impact: an earlier push of the price adds to orders in its direction."""
    side = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    o = c._lineitem(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("l_quantity").alias("q"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        side.alias("side"),
        (F.col("l_discount") - 0.05).alias("push"),
    )
    fill = Slippage("permanent", 2.0, 0.6, 0.0126).column(
        F.col("side"), F.col("q"), F.col("px"), F.lit(1000.0), F.col("push")
    )
    return o.select("l_orderkey", "l_linenumber", "l_suppkey", F.round(fill, 6).alias("fill"))


@_query(_BOOKS["commission_per_share"])
def commission_per_share(spark, sf):
    fee = Commission("share").column(F.col("q"), F.col("px"))
    return _orders(spark, sf).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(fee), 2).alias("fee"))


@_query(_BOOKS["commission_pct"])
def commission_pct(spark, sf):
    return _orders(spark, sf).groupBy("side").agg(
        F.round(F.sum(Commission("bps").column(F.col("q"), F.col("px"))), 2).alias("fee")
    )


@_query(_BOOKS["financing_accrual"])
def financing_accrual(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    short = F.when(F.col("c_custkey") % 3 == 0, 1000.0).otherwise(0.0)
    return customers.select(
        "c_custkey", F.round(Financing(0.02, 0.06, 0.03).column(F.col("c_acctbal"), short), 8).alias("accrual")
    )


# Signals


@_query(_BOOKS["sig_momentum"])
def sig_callback(spark, sf):
    """The momentum rule as a Python callback, bar by bar."""
    from .plans.strategies import per_bar_momentum

    rule = per_bar_momentum(20)
    return c._weights(sig.per_bar(lambda history: rule(history))(c._one_span(c._daily(spark, sf)), {}))


@_query(
    f"with {_DAY} select t, symbol, [5e-1, null, -25e-2, 1e0][t + 1] as target_weight from bars where t in (0, 2, 3)"
)
def sig_scripted(spark, sf):
    return c._weights(sig.scripted((0.5, None, -0.25, 1.0))(c._one_span(c._daily(spark, sf)), {}))


@_query(_BOOKS["sig_sma"].replace("select t, symbol,", "select 0 as setting_id, t, symbol,"))
def sig_from_file(spark, sf):
    """A strategy file, loaded by path and attribute."""
    with tempfile.TemporaryDirectory() as at:
        path = os.path.join(at, "rules.py")
        with open(path, "w") as f:
            f.write("from tidewright.operators.signals import sma_spec\n\nRULES = sma_spec((20,), (100,))\n")
        spec = sig.load_spec(f"{path}:RULES")
    return spec.signals(c._one_span(c._daily(spark, sf))).select("setting_id", "t", "symbol", "target_weight")


@_query(
    "select * from (values ('aggregate joined back', false), ('buy and hold', true), ('cross-sectional', true), ('lead', false), ('momentum', true), ('momentum that looks ahead', false), ('moving averages', true), ('whole frame', false)) v(strategy, honest)"
)
def plan_guard(spark, sf):
    """Which plans the guard lets through."""
    one, many = c._one_span(c._daily(spark, sf)), c._one_span(c._panel(spark, sf))
    w = Window.partitionBy("span_id", "symbol").orderBy("t")
    mean = one.groupBy("span_id").agg(F.avg("close").alias("m"))
    plans = {
        "momentum": sig.momentum(one, {}), "moving averages": sig.sma_crossover(one, {}), "buy and hold": sig.buy_and_hold(one, {}), "cross-sectional": sig.cross_sectional_momentum(many, {}),
        "momentum that looks ahead": sig.momentum_leaky(one, {}), "lead": one.withColumn("x", F.lead("close").over(w)), "aggregate joined back": one.join(mean, "span_id").where("close > m"),
        "whole frame": one.withColumn("x", F.max("close").over(Window.partitionBy("span_id"))),
    }
    return spark.createDataFrame(
        [(k, not sig.look_ahead_faults(p, many if k == "cross-sectional" else one)) for k, p in plans.items()],
        "strategy string, honest boolean",
    )


@_query(
    "select * from (values ('fast=20, slow=100', 0), ('fast=20, slow=200', 1), ('fast=50, slow=100', 2), ('fast=50, slow=200', 3)) v(params, setting_id)"
)
def parameter_grid(spark, sf):
    grid = sig.param_grid(fast=(20, 50), slow=(100, 200))
    return spark.createDataFrame(
        [(sig.format_params(p), k) for k, p in enumerate(grid)], "params string, setting_id int"
    )


# Books


_WHOLE = Account(Slippage("bps", 5.0), Commission("share"), capital=_CAPITAL, fractional=False)


@_query(
    f"{_sql_book(_WHOLE)} select t, round(mark_cash, 2) as cash, round(mark_pos, 4) as position, round(equity, 2) as equity from book where t >= 0"
)
def book_whole_units(spark, sf):
    """Only whole units are traded."""
    return c._equity(c._book(spark, sf, _WHOLE))


_LEVERED = Account(capital=_CAPITAL, frictions=Frictions(financing=Financing(0.0, 0.05, 0.0, 0.5)))


@_query(
    f"{_sql_book(_LEVERED)} select t, round(mark_cash, 2) as cash, round(mark_pos, 4) as position, round(equity, 2) as equity from book where t >= 0"
)
def book_leverage(spark, sf):
    """Targets are cut to half the equity."""
    return c._equity(c._book(spark, sf, _LEVERED))


def _panel_book_sql() -> str:
    """Three symbols in one book, as a recursion with a column a symbol; orders fill at the close."""
    n, s, k = _number, _IMPACT, Commission("share")
    names = ("A", "N", "R")
    cost = f"{n(s.half_spread_bps / 1e4)} + {n(s.impact)} * {n(s.bar_volatility)} * sqrt(least(abs(d_{{x}}) / greatest(v_{{x}}, 1e0), 1e0))"
    feed = ", ".join(
        f"max(case when p.symbol = '{x}' then p.close end) as c_{x}, max(case when p.symbol = '{x}' then p.volume end) as v_{x}, max(case when p.symbol = '{x}' then g.w end) as w_{x}" for x in names
    )
    worth = " + ".join(f"pos_{x} * c_{x}" for x in names)
    delta = ", ".join(f"w_{x} * equity / c_{x} - pos_{x} as d0_{x}" for x in names)
    orders = ", ".join(
        f"case when w_{x} is not null and c_{x} > 0 and equity > 0 and d0_{x} <> 0 and abs(d0_{x} * c_{x}) >= greatest(5e-2 * equity, 1e-9) then d0_{x} else 0e0 end as d_{x}" for x in names
    )
    prices = ", ".join(f"c_{x} * (1e0 + sign(d_{x}) * ({cost.format(x=x)})) as p_{x}" for x in names)
    fees = ", ".join(
        f"case when d_{x} <> 0 then least(greatest({n(k.minimum)}, {n(k.per_share)} * abs(d_{x})), {n(k.cap)} * abs(d_{x} * p_{x})) else 0e0 end as f_{x}" for x in names
    )
    paid = " + ".join(f"case when d_{x} <> 0 then d_{x} * p_{x} + f_{x} else 0e0 end" for x in names)
    return f"""with recursive {_FLAG}, m as (select symbol, t, close, volume, ln(close / lag(close, 60) over (partition by symbol order by t)) as score from panel),
r as (select *, dense_rank() over (order by t) - 1 as k, row_number() over (partition by t order by score desc, symbol) as up from m where score is not null),
g as (select t, symbol, case when up = 1 then 1e0 else 0e0 end as w from r where k % 21 = 0),
feed as (select p.t, {feed} from panel p left join g on g.t = p.t and g.symbol = p.symbol group by p.t),
book as (select -1 as t, {n(_CAPITAL)} as cash, {', '.join(f'0e0 as pos_{x}' for x in names)}, 0e0 as equity, 0e0 as gross
union all select t, cash - ({paid}), {', '.join(f'pos_{x} + d_{x}' for x in names)}, equity, gross from (select *, {fees} from (select *, {prices} from (select *, {orders} from (select *, {delta} from
(select *, cash + {worth} as equity, {' + '.join(f'abs(pos_{x} * c_{x})' for x in names)} as gross from (select b.* exclude (t, equity, gross), f.* from book b join feed f on f.t = b.t + 1)))))))
select t, round(equity, 2) as equity, round(gross, 2) as gross from book where t >= 0"""


@_query(_panel_book_sql())
def book_panel_xs(spark, sf):
    panel = c._one_span(c._panel(spark, sf))
    signals = sig.Spec("xs", sig.cross_sectional_momentum, [{"lookback": 60, "top_n": 1}]).signals(panel)
    runs = manifest(
        spark, [{"run_id": 0, "span_id": 0, "setting_id": 0, "account": Account(capital=_CAPITAL, **c._SMALL_COSTS)}]
    )
    return c._rounded(
        gross_exposure(equity_of(run_backtests(runs, panel, signals))).select("t", "equity", "gross"),
        {"equity": 2, "gross": 2},
    )


@_query(
    f"{_sql_book(c.ACCOUNTS['book_impact'])} select cast(0 as bigint) as run_id, count(*) as market, cast(sum(case when q_b > 0 then 1 else 0 end) as bigint) as fill, (select count(*) from sigs) as signal from book where t >= 0"
)
def book_events(spark, sf):
    """Bars, fills and signals of a run."""
    of = c._one_span(c._daily(spark, sf))
    signals = sig.Spec("momentum", sig.momentum, [{"lookback": 20}]).signals(of).withColumn(
        "target_weight", F.round("target_weight", 8)
    )
    sent = signals.agg(F.count(F.lit(1)).alias("n")).withColumn("run_id", F.lit(0).cast("long"))
    return event_counts(c._book(spark, sf, c.ACCOUNTS["book_impact"]), sent).select(
        "run_id", "market", "fill", "signal"
    )


@_query(
    _BOOKS["blotter_reconcile"].replace(
        "select case when sg > 0 then 'BUY' else 'SELL' end as direction, count(*) as n, round(sum(q), 4) as quantity, round(sum(f), 4) as commission, round(sum(abs(p - r) * q), 4) as slippage from fl group by 1",
        "select count(*) as n_trades, round(sum(f), 4) as commission, round(sum(abs(p - r) * q), 4) as slippage, round(sum(p * q), 2) as notional from fl",
    )
)
def cost_attribution(spark, sf):
    costs = stats.costs_by_run(fills_of(c._book(spark, sf, c.ACCOUNTS["book_impact"])))
    return c._rounded(
        costs.select("n_trades", "commission", "slippage", "notional"), {"commission": 4, "slippage": 4, "notional": 2}
    )


@_query(
    f"with {_DAY}, r as (select ln(close / lag(close) over (order by t)) as r from bars where t < 504) select round(stddev_samp(r), 8) as volatility from r"
)
def bar_volatility(spark, sf):
    return spark.createDataFrame([(round(ladder.bar_volatility(c._daily(spark, sf), 504), 8),)], "volatility double")


# Spans, folds, leaks


@_query(
    f"with {_DAY}, n as (select count(*) as n from bars), s as (select cast((x - 504) // 252 as bigint) as span_id, x - 95 as a, x + 252 as b from n, lateral (select unnest(generate_series(504, n - 252, 252)) as x)) select span_id, count(*) as bars, min(t) as first, max(t) as last, round(sum(volume), 2) as volume from s join bars on t >= a and t < b group by span_id"
)
def fold_bars(spark, sf):
    """Bars of each fold's test span with its warm-up."""
    bars = c._daily(spark, sf)
    folds = walk_forward_folds(bars.count(), 504, 252, warmup=95)
    spans = spark.createDataFrame(
        [(f.index, "ALL", *f.seen) for f in folds], "span_id long, series_id string, start int, end int"
    )
    return span_bars(bars, spans).groupBy("span_id").agg(
        F.count(F.lit(1)).alias("bars"),
        F.min("t").alias("first"),
        F.max("t").alias("last"),
        F.round(F.sum("volume"), 2).alias("volume"),
    )


@_query(
    f"with {_DAY}, n as (select count(*) as n from bars) select cast((x - 300) // 100 as integer) as fold_id, 0 as train_start, cast(x as integer) as train_end, cast(x as integer) as test_start, cast(x + 150 as integer) as test_end, cast(x - 20 as integer) as seen_from from n, lateral (select unnest(generate_series(300, n - 150, 100)) as x)"
)
def folds_overlapping(spark, sf):
    """Folds whose tests overlap, trained on all that came before."""
    folds = walk_forward_folds(c._daily(spark, sf).count(), 300, 150, 100, anchored=True, warmup=20, allow_overlap=True)
    return spark.createDataFrame(
        [(f.index, *f.train, *f.test, f.seen[0]) for f in folds],
        "fold_id int, train_start int, train_end int, test_start int, test_end int, seen_from int",
    )


_BUSY = "hours as (select distinct cast(epoch(date_trunc('hour', ts)) / 3600 as bigint) as h from events where event_type = (select min(event_type) from events) and value > (select quantile_cont(value, 7e-1) from events where event_type = (select min(event_type) from events))), edge as (select min(h) as lo, max(h) + 1 as hi from hours), isles as (select h, h - row_number() over (order by h) as i from hours), busy as (select min(h) as a, max(h) + 1 as b from isles group by i)"


@_query(
    f"with {_BUSY} select 'busy' as kind, cast(a - lo as integer) as start, cast(b - lo as integer) as \"end\" from busy, edge union all select 'quiet', cast(b - lo as integer), cast(after - lo as integer) from (select *, lead(a) over (order by a) as after from busy), edge where after is not null"
)
def interval_sets(spark, sf):
    """Hours with a large event merged to spans, and what they leave of the whole time."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    first = e.agg(F.min("event_type")).first()[0]
    e = e.where(F.col("event_type") == first)
    top = e.agg(F.percentile("value", F.lit(0.7))).first()[0]
    hours = sorted(
        {
            r[0] for r in e.where(F.col("value") > top).select(
                (F.unix_timestamp(F.date_trunc("hour", "ts")) / 3600).cast("long")
            ).distinct().collect()
        }
    )
    lo, hi = hours[0], hours[-1] + 1
    busy = merge_spans([(h - lo, h - lo + 1) for h in hours])
    rows = [("busy", *s) for s in busy] + [("quiet", *s) for s in subtract_spans((0, hi - lo), busy)]
    return spark.createDataFrame(rows, "kind string, start int, end int")


@_query(
    f"with {_DAY}, n as (select count(*) as n from bars) select cast(k as integer) as k, cast(round_even(95 + (n - 2 - 95) * k / 6e0, 0) as integer) as cut from n, range(1, 6) r(k)"
)
def leak_cuts(spark, sf):
    cuts = leaks.cut_points(c._daily(spark, sf).count(), 95)
    return spark.createDataFrame(list(enumerate(cuts, 1)), "k int, cut int")


_CUT = f"with {_DAY}, n as (select count(*) as n from bars), cut as (select cast(round_even(95 + (n - 2 - 95) / 6e0, 0) as integer) as cut from n)"


@_query(
    f"{_CUT} select 'honest' as twin, null::varchar as params, true as passed, null::integer as cut, null::integer as t union all select 'leaky', 'lookback=' || l, false, cut, l - 1 from cut, (values (5), (20)) v(l)"
)
def leak_detector(spark, sf):
    """The detector's verdict on momentum and on its leaky twin, with the first finding of each setting.

    Strengths count: first weights may lie at their limit in both futures, and the leak is there all the same.
    """
    bars, spec, rows = c._daily(spark, sf), sig.momentum_spec((5, 20)), []
    for twin in ("honest", "leaky"):
        said = leaks.detect_look_ahead(bars, spec, look_ahead=twin == "leaky", strengths=True)
        rows += [(twin, sig.format_params(f["params"]), said.passed, f["cut"], f["t"]) for f in said.findings] or [
            (twin, None, said.passed, None, None)
        ]
    return spark.createDataFrame(rows, "twin string, params string, passed boolean, cut int, t int")


@_query(
    "select cast(s as int) as setting_id, cast(k as bigint) as k, l - 1 as t from (values (0, 5), (1, 20)) v(s, l), range(1, 6) r(k)"
)
def leak_check_random_futures(spark, sf):
    """Random futures at five cuts against the leaky twin: the first signal of every setting changes, in strength at least."""
    bars = c._daily(spark, sf)
    cuts = leaks.cut_points(bars.count(), 95)
    return leaks.signal_differences(
        sig.momentum_spec((5, 20)).signals(leaks.perturbed_spans(bars, cuts), leaky=True), cuts, strengths=True
    ).select("setting_id", "k", "t")


# Studies

_SERIES_DAY = f"{_DAY.replace('bars as (', 'bars_ as (', 1)}, bars as (select 'ALL' as series_id, * from bars_)"
_DIGITS = dict.fromkeys(
    ("sharpe", "p_edge", "total_return", "annual_return", "annual_volatility", "max_drawdown", "buy_hold_sharpe"), 6
) | {"turnover": 4, "commission": 2, "slippage": 2, "notional": 2}
_STUDY = c._settings()
_MOMENTUM, _SMA = sig.momentum_spec((5, 20, 60)), sig.sma_spec((20, 50), (100, 200))


def _columns(names: str, digits: dict = _DIGITS) -> str:
    return ", ".join(f"round({x}, {digits[x]}) as {x}" if x in digits else x for x in names.split())


_RUNG = "series_id stage name honest sharpe p_edge total_return annual_return annual_volatility max_drawdown turnover n_trades commission slippage notional n_returns chosen buy_hold_sharpe"


def _study_sql(spec, tail: str = f"select {_columns(_RUNG)} from ladder") -> str:
    return f"{ladder_sql(_SERIES_DAY, spec, _STUDY, _IMPACT, Commission('share'))}\n{tail}"


def _study(spark, sf, spec) -> DataFrame:
    return ladder.run_ladder(spark, c._daily(spark, sf), spec, _STUDY, _IMPACT, Commission("share"))


@_query(_study_sql(_SMA))
def ladder_sma(spark, sf):
    return c._rounded(_study(spark, sf, _SMA).drop("change"), _DIGITS)


@_query(_study_sql(_MOMENTUM))
def ladder_momentum(spark, sf):
    return c._rounded(_study(spark, sf, _MOMENTUM).drop("change"), _DIGITS)


@_query(_study_sql(_SMA, f"select {_columns(_RUNG)} from ladder where honest"))
def walk_forward_sma(spark, sf):
    return ladder_sma(spark, sf).where("honest")


@_query(
    _study_sql(
        _SMA,
        "select series_id, bool_and(ok) as monotone from (select series_id, coalesce(sharpe <= lag(sharpe) over (partition by series_id order by stage), true) as ok from ladder) group by series_id",
    )
)
def ladder_monotone(spark, sf):
    return ladder.is_monotone(_study(spark, sf, _SMA))


_CPCV = sig.momentum_spec((5, 20, 60), 60)
_FOLDER = ladder.PurgedSplitter(5, 2, 60, 10)
_CPCV_SQL = cpcv_sql(
    _SERIES_DAY, _CPCV, _STUDY, _FOLDER, Slippage("impact"), Commission("share"), "select count(*) from bars"
)


def _cpcv(spark, sf):
    return ladder.run_cpcv(spark, c._daily(spark, sf), _CPCV, _STUDY, _FOLDER, Slippage("impact"), Commission("share"))


@_query(f"{_CPCV_SQL} select cast(path_id as integer) as path_id, round(sharpe, 6) as sharpe from paths")
def cpcv_sharpes(spark, sf):
    return _cpcv(spark, sf).paths.select("path_id", F.round("sharpe", 6).alias("sharpe"))


@_query(f"{_CPCV_SQL} select split_id, [5e0, 20e0, 60e0][setting_id + 1] as lookback from picks")
def cpcv_chosen(spark, sf):
    """The setting that each split's pooled training segments choose."""
    return spark.createDataFrame(
        [(k, float(p["lookback"])) for k, p in enumerate(_cpcv(spark, sf).chosen)], "split_id int, lookback double"
    )


@_query(
    f"{_CPCV_SQL} select count(*) as n_paths, round(quantile_cont(sharpe, 5e-1), 6) as median, round(quantile_cont(sharpe, 25e-2), 6) as lower, round(quantile_cont(sharpe, 75e-2), 6) as upper, round(min(sharpe), 6) as min, round(max(sharpe), 6) as max, cast(sum(case when sharpe < 0 then 1 else 0 end) as bigint) as n_below_zero, round(avg(case when sharpe < 0 then 1e0 else 0e0 end), 6) as share_below_zero from paths"
)
def cpcv_summary(spark, sf):
    return c._rounded(
        _cpcv(spark, sf).summary(), dict.fromkeys(("median", "lower", "upper", "min", "max", "share_below_zero"), 6)
    )


_HOURS = ladder.Settings(252, 126, capital=_CAPITAL)
_SWEEP_SQL = ladder_sql(
    f"{_EVENT}, bars as (select symbol as series_id, * from evb)",
    sig.momentum_spec((5, 20), 40),
    _HOURS,
    _IMPACT,
    Commission("share"),
)


def _sweep(spark, sf) -> DataFrame:
    return ladder.run_ladder(
        spark, c._events(spark, sf), sig.momentum_spec((5, 20), 40), _HOURS, _IMPACT, Commission("share")
    )


@_query(
    f"{_SWEEP_SQL} select {_columns('series_id stage name sharpe n_trades n_returns chosen buy_hold_sharpe', _DIGITS | {'sharpe': 5, 'buy_hold_sharpe': 5})} from ladder"
)
def ladder_of_series(spark, sf):
    """One ladder for each event type, all in the same two jobs."""
    return c._rounded(
        _sweep(spark, sf).select(
            "series_id", "stage", "name", "sharpe", "n_trades", "n_returns", "chosen", "buy_hold_sharpe"
        ),
        {"sharpe": 5, "buy_hold_sharpe": 5},
    )


@_query(
    f"{_SWEEP_SQL}, g as (select stage, name, count(*) as n, avg(sharpe) as mean, stddev_samp(sharpe) as sd from ladder group by stage, name) select stage, name, n, round(mean, 5) as mean, round(sd, 5) as sd, round(mean / (sd / sqrt(n)), 5) as t from g"
)
def series_sweep(spark, sf):
    """Mean and spread of each rung over the series."""
    return c._rounded(ladder.sweep_summary(_sweep(spark, sf)), {"mean": 5, "sd": 5, "t": 5})


_PATHS = f"with {_DAY}, p as (select t, sin(t / 9e0) as latent_state, coalesce(ln(close / lag(close) over (order by t)), 0e0) as log_return from bars), r as (select sign(lag(latent_state) over (order by t)) * log_return as r from p)"


@_query(
    f"{_PATHS} select cast(1 as bigint) as seed, round(avg(r) / stddev_samp(r) * sqrt(252e0), 8) as sharpe from r where r is not null"
)
def oracle_sharpe(spark, sf):
    """Holding the sign of a known state."""
    w = Window.partitionBy("series_id").orderBy("t")
    paths = c._daily(spark, sf).select(
        F.lit(1).cast("long").alias("seed"),
        "t",
        F.sin(F.col("t") / 9).alias("latent_state"),
        F.coalesce(F.log(F.col("close") / F.lag("close").over(w)), F.lit(0.0)).alias("log_return"),
    )
    return c._rounded(src.oracle_sharpe(paths), {"sharpe": 8})


_CURVES = f"{_EVENT}, r as (select symbol, close / lag(close) over (partition by symbol order by t) - 1e0 as r from evb), s as (select symbol, count(r) as n, avg(r) / stddev_samp(r) * sqrt(252e0) as s from r where r is not null group by symbol)"


@_query(
    f"with {_CURVES}, x as (select symbol, s * sqrt(n / 252e0) as t from s) select symbol as series_id, round(t, 6) as t, 'out-of-sample t = ' || printf('%.2f', t) || case when abs(t) > 2 then ': distinguishable from zero' else ': not distinguishable from zero' end as verdict from x"
)
def t_verdicts(spark, sf):
    """The t-statistic of each event series and what it says."""
    curve = c._events(spark, sf).select("series_id", "t", F.col("close").alias("equity"))
    rows = stats.sharpe(stats.simple_returns(curve, ["series_id"]), ["series_id"]).collect()
    said = [
        (
            r["series_id"], round(report.t_statistic(r["sharpe"], r["n"]), 6), report.verdict(r["sharpe"], r["n"])
        ) for r in rows
    ]
    return spark.createDataFrame(said, "series_id string, t double, verdict string")


# Documents, reports, configuration


def _hold_rows(spark, sf) -> list[dict]:
    curve = c._events(spark, sf).select("series_id", "t", F.col("close").alias("equity"))
    rows = stats.curve_metrics(curve, ["series_id"]).join(
        stats.probabilistic_sharpe(stats.simple_returns(curve, ["series_id"]), ["series_id"]).select(
            "series_id", F.col("psr").alias("p_edge")
        ),
        "series_id",
    )
    return [
        r.asDict() | {
            "name": r["series_id"],
            "stage": k + 1,
            "honest": True,
            "n_trades": 1,
            "chosen": '[{"lookback": 5}, {"lookback": 20}]',
        } for k, r in enumerate(rows.orderBy("series_id").collect())
    ]


_HOLD = f"{_CURVES}, m as (select symbol, max_by(close, t) / min_by(close, t) - 1e0 as total from evb group by symbol), d as (select symbol, min(close / top - 1e0) as mdd from (select *, max(close) over (partition by symbol order by t) as top from evb) group by symbol)"


@_query(
    f"with {_HOLD} select cast(1 as int) as schema_version, 'hold' as study, symbol as name, cast(n as bigint) as n_returns, round(s, 6) as sharpe, round(total, 6) as total_return, round(mdd, 6) as max_drawdown from s join m using (symbol) join d using (symbol)"
)
def document_rows(spark, sf):
    """Rows written as a versioned JSON document and read again."""
    text = report.to_json({"study": "hold", "ladder": _hold_rows(spark, sf)})
    read = spark.createDataFrame([(text,)], "text string").select(
        F.from_json(
            "text",
            "schema_version int, study string, ladder array<struct<name string, n_returns long, sharpe double, total_return double, max_drawdown double>>",
        ).alias("d")
    )
    rows = read.select("d.schema_version", "d.study", F.explode("d.ladder").alias("r")).select(
        "schema_version", "study", "r.*"
    )
    return c._rounded(rows, {"sharpe": 6, "total_return": 6, "max_drawdown": 6})


@_query(
    f"with {_HOLD} select '| ' || symbol || ' | ' || printf('%.2f', s) || ' | ' || printf('%+.1f%%', total * 1e2) || ' | ' || printf('%+.1f%%', mdd * 1e2) || ' | lookback=5/20 |' as line from s join m using (symbol) join d using (symbol)"
)
def report_lines(spark, sf):
    """Lines of the Markdown report: name, ratio, total return, drawdown, what was chosen."""
    lines = report.render_markdown(_hold_rows(spark, sf)).splitlines()[2:]
    cut = [[x.strip() for x in line.strip("|").split("|")] for line in lines]
    return spark.createDataFrame(
        [("| " + " | ".join((x[0], x[1], x[3], x[5], x[7])) + " |",) for x in cut], "line string"
    )


@_query(
    "select * from (values ('audit', 'capital', '50000.0'), ('audit', 'fill_timing', 'next_open'), ('audit', 'half_spread_bps', '3.5'), ('audit', 'train_size', '300'), ('audit', 'cpcv', '[6, 2]')) v(command, name, value)"
)
def config_values(spark, sf):
    """Options of a configuration file, as the command line takes them."""
    with tempfile.TemporaryDirectory() as at:
        path = os.path.join(at, "audit.json")
        with open(path, "w") as f:
            json.dump(
                {
                    "file": "prices.csv",
                    "capital": 50000,
                    "fill": "next_open",
                    "half-spread-bps": 3.5,
                    "train_size": 300,
                    "cpcv": [6, 2],
                },
                f,
            )
        a = cli.parse(cli.command("audit"), ["--config", path])
    got = {
        "capital": a.capital,
        "fill_timing": a.fill,
        "half_spread_bps": a.half_spread_bps,
        "train_size": a.train_size,
        "cpcv": list(a.cpcv),
    }
    return spark.createDataFrame(
        [("audit", k, str(v)) for k, v in got.items()], "command string, name string, value string"
    )


_AUDIT = ladder.Settings(capital=_CAPITAL)
_AUDIT_SQL = ladder_sql(
    _SERIES_DAY.replace("'ALL' as series_id", "'PRICES' as series_id", 1),
    sig.momentum_spec(),
    _AUDIT,
    Slippage("impact", 2.0, 0.0),
    Commission("share"),
)


@_query(
    f"{_AUDIT_SQL} select cast(1 as int) as schema_version, 'audit' as kind, stage, name, honest, round(sharpe, 6) as sharpe, round(max_drawdown, 6) as max_drawdown, n_trades, round(commission, 2) as commission, chosen, true as no_leak from ladder"
)
def audit_command(spark, sf):
    """The audit command on a price file: the ladder and the leak check of its JSON document."""
    at = _folder(spark, "audit") + ".csv"
    src.write_prices(c._daily(spark, sf), at)
    with tempfile.TemporaryDirectory() as folder:
        out = os.path.join(folder, "audit.json")
        with contextlib.redirect_stdout(io.StringIO()):
            code = cli.main(
                spark,
                [
                    "audit",
                    "--file",
                    at,
                    "--symbol",
                    "PRICES",
                    "--impact",
                    "0",
                    "--capital",
                    str(_CAPITAL),
                    "--json",
                    out,
                    "--html",
                    os.path.join(folder, "audit.html"),
                ],
            )
        with open(out) as f:
            document = json.load(f)
    rows = [
        (
            document["schema_version"],
            document["kind"],
            r["stage"],
            r["name"],
            r["honest"],
            r["sharpe"],
            r["max_drawdown"],
            r["n_trades"],
            r["commission"],
            r["chosen"],
            code == 0 and document["leaks"]["passed"],
        ) for r in document["ladder"]
    ]
    found = spark.createDataFrame(
        rows,
        "schema_version int, kind string, stage int, name string, honest boolean, sharpe double, max_drawdown double, n_trades long, commission double, chosen string, no_leak boolean",
    )
    return c._rounded(found, {"sharpe": 6, "max_drawdown": 6, "commission": 2})


_REFUSED = {
    "band below zero": lambda: Account(band=-1), "capital of zero": lambda: Account(capital=0), "unknown timing": lambda: Account(fill_timing="later"),
    "participation above one": lambda: Account(frictions=Frictions(max_participation=2)), "leverage of zero": lambda: Financing(max_leverage=0),
    "negative spread": lambda: Slippage("bps", -1), "negative fee": lambda: Commission("bps", bps=-1), "empty axis": lambda: sig.param_grid(a=()),
    "overlapping tests": lambda: walk_forward_folds(1000, 100, 50, 20), "long warm-up": lambda: walk_forward_folds(1000, 100, 50, warmup=101),
    "one group": lambda: ladder.PurgedSplitter(1, 1), "all groups held out": lambda: ladder.PurgedSplitter(4, 4), "fewer bars than groups": lambda: ladder.PurgedSplitter(6, 2).groups(5),
    "nothing left to train on": lambda: ladder.PurgedSplitter(2, 1, 50).splits(60), "fold out of order": lambda: ladder.Fold(0, (0, 10), (5, 20)),
    "no setting": lambda: sig.Spec("x", sig.buy_and_hold, []), "unknown strategy": lambda: sig.load_spec("nothing"), "persistence of one": lambda: src.SyntheticConfig(signal_persistence=1.0),
}


@_query("select * from (values " + ", ".join(f"('{x}', true)" for x in _REFUSED) + ") v(argument, refused)")
def argument_checks(spark, sf):
    """Arguments that must be refused."""

    def refused(make) -> bool:
        try:
            make()
        except ValueError:
            return True
        return False

    return spark.createDataFrame(
        [(name, refused(make)) for name, make in _REFUSED.items()], "argument string, refused boolean"
    )


# Sessions


def _session_bars(spark, sf) -> list[tuple[str, tuple]]:
    rows = c._daily(spark, sf).orderBy("t").collect()
    return [(r["time"].isoformat(), (r["open"], r["high"], r["low"], r["close"], r["volume"])) for r in rows]


_LIVE = 300
_LATE = Account(capital=_CAPITAL, fill_timing="next_close", **c._SMALL_COSTS)
_LIVE_SQL = _sql_book(
    _LATE,
    feed=f"feed as (select cast(b.t - {_LIVE} as integer) as t, b.open, b.high, b.low, b.close, b.volume, s.target_weight as w from bars b left join sigs s on s.t = b.t where b.t >= {_LIVE})",
)


def _rule(lookback: int):
    from .plans.strategies import per_bar_momentum

    rule = per_bar_momentum(lookback)

    def strategy(history):
        weight = rule(history)
        return None if weight is None else round(weight, 8)

    return strategy


@_query(
    f"{_LIVE_SQL} select t + {_LIVE} as t, round(cash, 2) as cash, round(pos, 4) as position, round(cash + pos * last_close, 2) as equity from book where t >= 0"
)
def paper_journal(spark, sf):
    """A session warmed up on history, stopped after 700 bars, resumed from its journal, and the journal read."""
    from .streaming.paper import Journal, replay_feed, run_session

    bars = _session_bars(spark, sf)
    with tempfile.TemporaryDirectory() as at:
        journal = Journal(os.path.join(at, "session.jsonl"))
        run_session(replay_feed(bars[_LIVE:]), "ALL", _LATE, _rule(20), 200, bars[:_LIVE], journal, max_bars=700)
        run_session(
            replay_feed(bars[_LIVE + 700 :]), "ALL", _LATE, _rule(20), 200, bars[: _LIVE + 700], journal, resume=True
        )
        rows = [
            (
                r["t"], float(r["cash"]), float(r["position"]), float(r["equity"])
            ) for r in journal.read() if r["type"] == "bar"
        ]
    return c._rounded(
        spark.createDataFrame(rows, "t int, cash double, position double, equity double"),
        {"cash": 2, "position": 4, "equity": 2},
    )


@_query(
    f"{_sql_book(_LATE, _momentum(20, digits=None), f'feed as (select cast(b.t - {_LIVE} as integer) as t, b.open, b.high, b.low, b.close, b.volume, s.target_weight as w from bars b left join sigs s on s.t = b.t where b.t >= {_LIVE})')} select t + {_LIVE} as t, round(cash, 2) as cash, round(pos, 4) as position, round(cash + pos * last_close, 2) as equity from book where t >= 0"
)
def paper_command(spark, sf):
    """The paper command on a price file, live from a date on, read from its journal."""
    at = _folder(spark, "live") + ".csv"
    bars = c._daily(spark, sf)
    src.write_prices(bars, at)
    since = bars.where(f"t = {_LIVE}").select(F.date_format("time", "yyyy-MM-dd")).first()[0]
    with tempfile.TemporaryDirectory() as folder:
        journal = os.path.join(folder, "paper.jsonl")
        with contextlib.redirect_stdout(io.StringIO()):
            cli.main(
                spark,
                [
                    "paper",
                    "--file",
                    at,
                    "--symbol",
                    "ALL",
                    "--live-from",
                    since,
                    "--params",
                    "lookback=20",
                    "--fill",
                    "next_close",
                    "--capital",
                    str(_CAPITAL),
                    "--journal",
                    journal,
                ],
            )
        with open(journal) as f:
            rows = [
                (
                    r["t"], float(r["cash"]), float(r["position"]), float(r["equity"])
                ) for r in map(json.loads, f) if r["type"] == "bar"
            ]
    return c._rounded(
        spark.createDataFrame(rows, "t int, cash double, position double, equity double"),
        {"cash": 2, "position": 4, "equity": 2},
    )


@_query(
    f"with {_DAY}, x as (select cast(t as integer) as t, round(close, 6) as close, volume from bars where t < 400) select * from x"
)
def paper_tail(spark, sf):
    """Bars of a price file that grows between polls."""
    from .streaming.paper import Polling, tail_csv

    bars = [(t[:10], *b) for t, b in _session_bars(spark, sf)[:400]]
    with tempfile.TemporaryDirectory() as at:
        path = os.path.join(at, "tail.csv")
        written = [0]

        def more(_seconds=0):
            with open(path, "a") as f:
                if not written[0]:
                    f.write("date,open,high,low,close,volume\n")
                for row in bars[written[0] : written[0] + 150]:
                    f.write(",".join(map(repr, row)).replace("'", "") + "\n")
            written[0] += 150

        more()
        clock = iter(range(10_000))
        rows = [
            (k, round(b[3], 6), b[4]) for k, (_, b) in enumerate(
                tail_csv(path, Polling(1.0, patience=6.0, sleep=more, clock=lambda: next(clock)))
            )
        ]
    return spark.createDataFrame(rows, "t int, close double, volume double")


@_query(
    f"{_sql_book(c.ACCOUNTS['book_next_close'])} select 'ALL' as symbol, t, round(cash, 2) as cash, round(pos, 4) as position, round(cash + pos * last_close, 2) as equity from book where t >= 0"
)
def stream_paper(spark, sf):
    """A paper session over a file stream, a micro-batch a file, stopped in the middle and started again from its checkpoint."""
    from .streaming.paper import BAR_STREAM_SCHEMA, PAPER_SCHEMA, run_available

    top = _folder(spark, "paper")
    bars = c._daily(spark, sf).select("t", *[x.split(" ")[0] for x in BAR_STREAM_SCHEMA.split(", ")])
    last = bars.agg(F.max("t")).first()[0]
    for k in range(6):  # files are taken in the order in which they were written
        slice_ = bars.where(f"t > {last * k // 6 - (k == 0)} and t <= {last * (k + 1) // 6}").drop("t")
        slice_.coalesce(1).write.mode("append").parquet(f"{top}/bars")
        if k in (2, 5):
            run_available(
                spark,
                f"{top}/bars",
                f"{top}/out",
                f"{top}/state",
                c.ACCOUNTS["book_next_close"],
                _rule(20),
                memory=120,
                files_per_batch=1,
            )
    rows = spark.read.schema(PAPER_SCHEMA).json(f"{top}/out")
    return rows.select(
        "symbol",
        "t",
        F.round("cash", 2).alias("cash"),
        F.round("position", 4).alias("position"),
        F.round("equity", 2).alias("equity"),
    )
