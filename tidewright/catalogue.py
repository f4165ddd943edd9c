"""Driver queries of the evaluation engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import stats
from .operators import signals as sig
from .operators.book import Account, Commission, Financing, Frictions, Slippage
from .operators.leaks import signal_differences
from .operators.runs import equity_of, fills_of, manifest, run_backtests, totals_of
from .operators.spans import PurgedSplitter, cpcv_groups_frame, folds_frame, paths_frame, splits_frame
from .plans.ladder import Settings, run_seed_sweep, sweep_summary
from .sources import bars as src

_SMALL_COSTS = {"slippage": Slippage("impact", 2.0, 0.6, 0.0126), "commission": Commission("share")}


def _lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return src.daily_bars(_lineitem(spark, sf))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return src.event_bars(spark.read.parquet(f"{sf}/events.parquet"))


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return src.flag_panel(_lineitem(spark, sf))


def _one_span(bars: DataFrame, by: str = "series_id") -> DataFrame:
    """Whole series as spans, numbered by name."""
    return bars.withColumn(
        "span_id", (F.dense_rank().over(Window.orderBy(by)) - 1).cast("long")
    ) if by != "series_id" else bars.withColumn("span_id", F.lit(0).cast("long"))


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def bars_daily(spark, sf):
    return _daily(spark, sf).select("symbol", "t", "time", "open", "high", "low", "close", "volume")


def bars_weekly_brand(spark, sf):
    b = src.weekly_brand_panel(_lineitem(spark, sf), spark.read.parquet(f"{sf}/part.parquet"))
    return b.select("symbol", "t", "time", "open", "high", "low", "close", "volume")


def bars_hourly_event(spark, sf):
    return _rounded(
        _events(spark, sf).select("symbol", "t", "time", "open", "high", "low", "close", "volume"),
        dict.fromkeys(("open", "high", "low", "close"), 6),
    )


def real_opens(spark, sf):
    return src.has_real_opens(_daily(spark, sf)).unionAll(src.has_real_opens(_events(spark, sf)))


def panel_missing_days(spark, sf):
    """Per flag, how many dates some other flag trades on and it doesn't."""
    d = _lineitem(spark, sf).select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("time")).distinct()
    n = d.select("time").distinct().agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n)).select(
        "symbol", (F.col("n") - F.col("k")).alias("missing")
    )


def _weights(df: DataFrame) -> DataFrame:
    return df.select("t", "symbol", F.round("target_weight", 8).alias("target_weight"))


def sig_momentum(spark, sf):
    return _weights(sig.momentum(_one_span(_daily(spark, sf)), {"lookback": 20}))


def sig_momentum_grid(spark, sf):
    s = sig.momentum_spec((5, 20, 60)).signals(_one_span(_daily(spark, sf)))
    return s.select("setting_id", "t", F.round("target_weight", 8).alias("target_weight"))


def sig_leaky_momentum(spark, sf):
    return _weights(sig.momentum_leaky(_one_span(_daily(spark, sf)), {"lookback": 20}))


def sig_sma(spark, sf):
    return _weights(sig.sma_crossover(_one_span(_daily(spark, sf)), {"fast": 20, "slow": 100}))


def sig_buy_hold(spark, sf):
    return _weights(sig.buy_and_hold(_one_span(_daily(spark, sf)), {}))


def sig_xs_momentum(spark, sf):
    return sig.cross_sectional_momentum(_one_span(_panel(spark, sf)), {"lookback": 60, "long_short": 1}).select(
        "t", "seq", "symbol", "target_weight"
    )


def full_sample_stats(spark, sf):
    return _rounded(stats.level_stats(_daily(spark, sf), ["symbol"]), {"mean": 6, "sd": 6})


# Books over the daily series


def _book(spark, sf, account: Account, signals: DataFrame | None = None, bars: DataFrame | None = None) -> DataFrame:
    bars = _daily(spark, sf) if bars is None else bars
    of_spans = _one_span(bars)
    if signals is None:
        signals = sig.Spec("momentum", sig.momentum, [{"lookback": 20}]).signals(of_spans).withColumn(
            "target_weight", F.round("target_weight", 8)
        )
    runs = manifest(spark, [{"run_id": 0, "span_id": 0, "setting_id": 0, "account": account}])
    return run_backtests(runs, of_spans, signals)


def _equity(book: DataFrame) -> DataFrame:
    return equity_of(book).select(
        "t",
        F.round("cash", 2).alias("cash"),
        F.round("position", 4).alias("position"),
        F.round("equity", 2).alias("equity"),
    )


_CAPITAL = 100_000.0
ACCOUNTS = {
    "book_close": Account(capital=_CAPITAL),
    "book_fixed_bps": Account(Slippage("bps", 5.0), capital=_CAPITAL),
    "book_impact": Account(capital=_CAPITAL, **_SMALL_COSTS),
    "book_next_close": Account(capital=_CAPITAL, fill_timing="next_close", **_SMALL_COSTS),
    "book_next_open": Account(capital=_CAPITAL, fill_timing="next_open", commission=Commission("bps", bps=3.0), slippage=Slippage("bps", 2.0)),
    "book_financing": Account(capital=_CAPITAL, frictions=Frictions(financing=Financing(0.02, 0.06, 0.03, 0.8))),
    "book_capped": Account(capital=_CAPITAL, frictions=Frictions(max_participation=0.01)),
    "book_limit": Account(capital=_CAPITAL, frictions=Frictions(limit_offset_bps=20.0, limit_expiry_bars=3)),
    "book_permanent": Account(Slippage("permanent", 2.0, 0.6, 0.0126, 0.3, 5.0), Commission("share"), capital=_CAPITAL),
}


def _book_query(name: str):
    def query(spark, sf):
        return _equity(_book(spark, sf, ACCOUNTS[name]))

    query.__name__ = name
    return query


def book_totals(spark, sf):
    """Cancelled and expired quantity and final state of the limit book."""
    return totals_of(_book(spark, sf, ACCOUNTS["book_limit"])).select(
        *[F.round(c, 2).alias(c) for c in ("final_cash", "final_position", "cancelled", "expired", "unfilled")]
    )


def blotter_reconcile(spark, sf):
    """Per direction: fills, units, commission, slippage of the impact book."""
    f = fills_of(_book(spark, sf, ACCOUNTS["book_impact"]))
    return f.groupBy("direction").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("quantity"), 4).alias("quantity"),
        F.round(F.sum("commission"), 4).alias("commission"),
        F.round(F.sum("slippage_cost"), 4).alias("slippage"),
    )


def identity_check(spark, sf):
    """Largest gap between marked equity and capital plus the cash flow of all earlier fills plus the position's value."""
    book = _book(spark, sf, ACCOUNTS["book_impact"])
    e = equity_of(book)
    flow = book.where("kind = 'fill'").groupBy("t").agg(
        F.sum(-F.col("quantity") * F.col("fill_price") - F.col("commission")).alias("cash_in"),
        F.sum("quantity").alias("units"),
    )
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    j = e.join(flow, "t", "left").na.fill(0.0, ["cash_in", "units"]).withColumn(
        "cash_2", F.lit(_CAPITAL) + F.coalesce(F.sum("cash_in").over(w), F.lit(0.0))
    ).withColumn("units_2", F.coalesce(F.sum("units").over(w), F.lit(0.0)))
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.max(F.abs(F.col("cash_2") + F.col("units_2") * F.col("price") - F.col("equity"))), 3).alias("gap"),
    )


def bh_equity(spark, sf):
    """Closed form: one trade on the first bar, so equity is a projection."""
    b = _daily(spark, sf)
    first = F.first("close").over(Window.partitionBy("series_id").orderBy("t"))
    return b.select(
        "t",
        F.round(
            F.when(F.col("t") == 0, F.lit(_CAPITAL)).otherwise(F.lit(_CAPITAL) / first * F.col("close")), 2
        ).alias("equity"),
    )


def bh_equity_costed(spark, sf):
    return _equity(
        _book(
            spark, sf, ACCOUNTS["book_impact"], sig.Spec("hold", sig.buy_and_hold).signals(_one_span(_daily(spark, sf)))
        )
    )


def _curve(spark, sf) -> DataFrame:
    return _daily(spark, sf).select("series_id", "t", F.col("close").alias("equity"))


_METRIC_DIGITS = {
    "sharpe": 8, "total_return": 8, "annual_return": 8, "annual_volatility": 8, "max_drawdown": 8, "mean_equity": 4
}


def bh_metrics(spark, sf):
    return _rounded(stats.curve_metrics(_curve(spark, sf), ["series_id"]), _METRIC_DIGITS)


def metrics_all(spark, sf):
    """Metrics of every hourly event series' closes."""
    c = _events(spark, sf).select("series_id", "t", F.col("close").alias("equity"))
    return _rounded(stats.curve_metrics(c, ["series_id"]), _METRIC_DIGITS | {"annual_return": 4})


def curve_zero_cost_band0(spark, sf):
    """Band 0, no costs, a signal on every bar: equity is a running product."""
    of = _one_span(_daily(spark, sf))
    w = sig.sma_crossover(of, {"fast": 20, "slow": 100}).select("t", "target_weight")
    o = Window.orderBy("t")
    r = of.join(w, "t").withColumn(
        "g", 1 + F.coalesce(F.lag("target_weight").over(o) * (F.col("close") / F.lag("close").over(o) - 1), F.lit(0.0))
    )
    return r.select("t", F.round(F.product("g").over(o.rowsBetween(Window.unboundedPreceding, 0)), 8).alias("growth"))


def returns(spark, sf):
    return stats.simple_returns(_curve(spark, sf), ["series_id"]).select("t", F.round("r", 8).alias("r"))


def drawdown_curve(spark, sf):
    top = F.max("equity").over(Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return _curve(spark, sf).select("t", F.round(F.col("equity") / top - 1, 8).alias("drawdown"))


def sharpe_by_series(spark, sf):
    c = _events(spark, sf).select("series_id", "t", F.col("close").alias("equity"))
    return _rounded(stats.sharpe(stats.simple_returns(c, ["series_id"]), ["series_id"]), {"sharpe": 8})


def psr(spark, sf):
    return _rounded(
        stats.probabilistic_sharpe(stats.simple_returns(_curve(spark, sf), ["series_id"]), ["series_id"]), {"psr": 8}
    )


def dsr(spark, sf):
    c = _events(spark, sf).select("series_id", "t", F.col("close").alias("equity"))
    r = stats.simple_returns(_curve(spark, sf), ["series_id"])
    trials = stats.sharpe(stats.simple_returns(c, ["series_id"]), ["series_id"]).select(
        F.lit("ALL").alias("series_id"), "sharpe"
    )
    return _rounded(stats.deflated_sharpe(r, trials, ["series_id"]), {"bar": 8, "dsr": 8})


# Cost models over orders taken from lineitem


def _orders(spark, sf) -> DataFrame:
    return _lineitem(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("l_quantity").alias("q"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0).alias("side"),
    )


# Splits


def folds_rolling(spark, sf):
    return folds_frame(_daily(spark, sf), 504, 252, warmup=95)


def folds_anchored(spark, sf):
    return folds_frame(_daily(spark, sf), 504, 252, anchored=True)


def cpcv_groups(spark, sf):
    return cpcv_groups_frame(_daily(spark, sf), 6)


_SPLITTER = PurgedSplitter(6, 2, 10, 5)


def _splits(spark, sf):
    return _SPLITTER.splits(_daily(spark, sf).count(), 100)


def cpcv_splits(spark, sf):
    return splits_frame(spark, _splits(spark, sf))


def cpcv_paths(spark, sf):
    return paths_frame(spark, _splits(spark, sf))


def cpcv_train_bars(spark, sf):
    """Training bars of each split, counted over the bars that exist."""
    s = splits_frame(spark, _splits(spark, sf)).where("kind = 'train'")
    b = _daily(spark, sf).select("t")
    return s.join(b, (b.t >= s.start) & (b.t < s.end)).groupBy("split_id").agg(F.count(F.lit(1)).alias("n"))


# Studies


def _settings() -> Settings:
    return Settings(capital=_CAPITAL)


def fit_in_sample(spark, sf):
    """Ratio of each setting over the scored window, and the first best."""
    bars, spec = _daily(spark, sf), sig.momentum_spec((5, 20, 60))
    of = _one_span(bars)
    runs = manifest(
        spark,
        [
            {
                "run_id": k, "span_id": 0, "setting_id": k, "warmup": 504, "account": ACCOUNTS["book_close"]
            } for k in range(3)
        ],
    )
    signals = spec.signals(of).withColumn("target_weight", F.round("target_weight", 8))
    r = stats.simple_returns(stats.scored(equity_of(run_backtests(runs, of, signals)), runs), ["run_id"])
    s = stats.sharpe(r, ["run_id"])
    best = F.row_number().over(Window.orderBy(F.desc("sharpe"), "run_id")) == 1
    return s.select(F.col("run_id").alias("setting_id"), "n", F.round("sharpe", 6).alias("sharpe"), best.alias("best"))


def seed_sweep(spark, sf):
    config = src.SyntheticConfig(n_bars=1260)
    return sweep_summary(
        run_seed_sweep(spark, 3, config=config, spec=sig.momentum_spec((5, 20, 60)), settings=Settings(252, 252))
    )


def _deterministic_leak(spark, sf, leaky: bool) -> DataFrame:
    """Signals that change when every close after bar 1200 is tripled."""
    bars = _daily(spark, sf)
    both = bars.withColumn("span_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    both = both.withColumn(
        "close", F.when((F.col("span_id") == 1) & (F.col("t") > 1200), F.col("close") * 3).otherwise(F.col("close"))
    )
    s = sig.momentum_spec((5, 20)).signals(both, leaky=leaky)
    return signal_differences(s, (1200,), 1e-9).select(
        "setting_id", "t", F.round("original", 8).alias("original"), F.round("altered", 8).alias("altered")
    )


def leak_check_honest(spark, sf):
    return _deterministic_leak(spark, sf, False)


def leak_check_leaky(spark, sf):
    return _deterministic_leak(spark, sf, True)


def synthetic_paths(spark, sf):
    return src.synthetic_paths(spark, [1, 2, 3], src.SyntheticConfig(n_bars=500))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Momentum on daily bars through the costed book."""
    return _equity(_book(spark, sf, ACCOUNTS["book_impact"]))


QUERIES = {f.__name__: f for f in (bars_daily, bars_weekly_brand, bars_hourly_event, real_opens, panel_missing_days, sig_momentum, sig_momentum_grid, sig_leaky_momentum, sig_sma, sig_buy_hold, sig_xs_momentum, full_sample_stats, *map(_book_query, ACCOUNTS), book_totals, blotter_reconcile, identity_check, bh_equity, bh_equity_costed, bh_metrics, metrics_all, curve_zero_cost_band0, returns, drawdown_curve, sharpe_by_series, psr, dsr, folds_rolling, folds_anchored, cpcv_groups, cpcv_splits, cpcv_paths, cpcv_train_bars, fit_in_sample, seed_sweep, leak_check_honest, leak_check_leaky, synthetic_paths)}

from .catalogue_sql import SQL  # noqa: E402, F401
