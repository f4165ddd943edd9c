"""Many backtests as one DataFrame job.

A manifest row names a run: a span of a series, a setting, a leaky flag and an account.
Runs meet their span's bars and signals by equi-joins on span_id and setting_id; the book is
folded per run_id in one shuffle. Signals depend on (span, setting, leaky) only, so every
cost model reuses them.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import Account, Book, step_book

BOOK_SCHEMA = "run_id long, kind string, t int, symbol string, cash double, position double, price double, equity double, quantity double, fill_price double, reference_price double, commission double, cancelled double, expired double, financing double"
_FIELDS = [f.split(" ")[0] for f in BOOK_SCHEMA.split(", ")]


def manifest(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of run_id, span_id, setting_id, leaky, warmup and account (an Account) as a DataFrame."""
    typed = [
        (
            int(r["run_id"]),
            int(r["span_id"]),
            int(r["setting_id"]),
            bool(r.get("leaky", False)),
            int(r.get("warmup", 0)),
            json.dumps(r["account"].to_dict()),
        ) for r in rows
    ]
    return spark.createDataFrame(
        typed, "run_id long, span_id long, setting_id int, leaky boolean, warmup int, account string"
    )


def span_bars(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """Bars of every span: spans(span_id, series_id, start, end) meet bars by series, then by range."""
    met = (F.col("s.series_id") == F.col("b.series_id")) & (
        F.col("b.t") >= F.col("s.start")
    ) & (F.col("b.t") < F.col("s.end"))
    return spans.alias("s").join(bars.alias("b"), met).select(
        "s.span_id", "b.symbol", "b.t", "b.time", "b.open", "b.high", "b.low", "b.close", "b.volume"
    )


#: One row a run: moments of the scored returns (central ones over n), ends of the curve, costs of all fills.
SUMMARY_SCHEMA = "run_id long, n_returns long, mean double, sd double, m2 double, m3 double, m4 double, first double, last double, mean_equity double, max_drawdown double, n_trades long, commission double, slippage double, notional double, returns array<double>"


def _summary(run: int, equity: list[float], fills: list, warmup: int, keep: bool) -> dict:
    e = np.array(equity[max(0, warmup - 1) :])
    before = e[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(before == 0, 0.0, e[1:] / before - 1)
        top = np.maximum.accumulate(e) if len(e) else e
        fall = np.where(top == 0, 0.0, e / top - 1)
    r = np.where(np.isfinite(r), r, 0.0)
    n, d = len(r), r - r.mean() if len(r) else r
    out = {
        "run_id": run,
        "n_returns": n,
        "mean": float(r.mean()) if n else None,
        "sd": float(r.std(ddof=1)) if n > 1 else None,
    }
    out |= {f"m{k}": float((d**k).mean()) if n else None for k in (2, 3, 4)}
    out |= {
        "first": float(e[0]) if len(e) else None,
        "last": float(e[-1]) if len(e) else None,
        "mean_equity": float(e.mean()) if len(e) else None,
        "max_drawdown": float(fall.min()) if len(e) else None,
    }
    out |= {
        "n_trades": len(fills),
        "commission": sum(f[5] for f in fills),
        "slippage": sum(abs(f[3] - f[4]) * abs(f[2]) for f in fills),
        "notional": sum(abs(f[2] * f[3]) for f in fills),
    }
    return out | {"returns": r.tolist() if keep else None}


def _steps(table: pa.Table):
    """The book of one run, bar by bar: (t, symbols, (cash, positions, prices, equity), fills) and, last, the book."""
    rows = table.sort_by([("t", "ascending"), ("symbol", "ascending")])
    account = Account.from_dict(json.loads(rows.column("account")[0].as_py()))
    cols = {c: rows.column(c).to_pylist() for c in ("t", "symbol", "open", "high", "low", "close", "volume", "signals")}
    symbols = sorted(set(cols["symbol"]))
    book = Book(account.capital, dict.fromkeys(symbols, 0.0))
    i, n = 0, len(cols["t"])
    while i < n:
        t, bars, signals = cols["t"][i], {}, []
        while i < n and cols["t"][i] == t:
            s = cols["symbol"][i]
            bars[s] = (cols["open"][i], cols["high"][i], cols["low"][i], cols["close"][i], cols["volume"][i])
            signals += [(x["seq"], s, x["target_weight"]) for x in cols["signals"][i] or ()]
            i += 1
        signals.sort(key=lambda x: (x[0], x[1]))
        yield t, symbols, *step_book(book, account, t, bars, [(s, w) for _, s, w in signals])
    yield None, symbols, book, None


def _summarise(table: pa.Table) -> pa.Table:
    first = {c: table.column(c)[0].as_py() for c in ("run_id", "warmup", "keep")}
    equity, fills = [], []
    for t, _, mark, some in _steps(table):
        if t is not None:
            equity.append(mark[3])
            fills += some
    row = _summary(first["run_id"], equity, fills, first["warmup"], first["keep"])
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.table(
        {f.split(" ")[0]: pa.array([row[f.split(" ")[0]]], kinds[f.split(" ")[1]]) for f in SUMMARY_SCHEMA.split(", ")}
    )


def _fold(table: pa.Table) -> pa.Table:
    run = table.column("run_id")[0].as_py()
    out: dict[str, list] = {f: [] for f in _FIELDS}

    def emit(**values):
        for f in _FIELDS:
            out[f].append(values.get(f))

    for t, symbols, mark, fills in _steps(table):
        if t is None:
            book = mark
            break
        cash, positions, prices, equity = mark
        for s in symbols:
            emit(
                run_id=run,
                kind="equity",
                t=t,
                symbol=s,
                cash=cash,
                position=positions[s],
                price=prices[s],
                equity=equity,
            )
        for ft, s, units, price, reference, fee in fills:
            emit(
                run_id=run,
                kind="fill",
                t=ft,
                symbol=s,
                quantity=units,
                fill_price=price,
                reference_price=reference,
                commission=fee,
            )
    emit(
        run_id=run,
        kind="total",
        cash=book.cash,
        position=sum(book.holdings.values()),
        cancelled=book.cancelled,
        expired=book.expired,
        financing=book.financing,
    )
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return pa.table(
        {f.split(" ")[0]: pa.array(out[f.split(" ")[0]], kinds[f.split(" ")[1]]) for f in BOOK_SCHEMA.split(", ")}
    )


def _wide(runs: DataFrame, bars_of_spans: DataFrame, signals: DataFrame, *extra: str) -> DataFrame:
    packed = signals.groupBy("span_id", "setting_id", "leaky", "t", "symbol").agg(
        F.array_sort(F.collect_list(F.struct("seq", "target_weight"))).alias("signals")
    )
    wide = runs.select(
        "run_id", "span_id", "setting_id", "leaky", "account", *extra
    ).join(bars_of_spans, "span_id").join(packed, ["span_id", "setting_id", "leaky", "t", "symbol"], "left")
    return wide.select(
        "run_id", "account", *extra, "t", "symbol", "open", "high", "low", "close", "volume", "signals"
    ).groupBy("run_id")


def run_backtests(runs: DataFrame, bars_of_spans: DataFrame, signals: DataFrame) -> DataFrame:
    """The tagged book (kind equity, fill or total) of every run.

    signals(span_id, setting_id, leaky, t, seq, symbol, target_weight) may have several rows a bar;
    they are packed per bar before they meet the runs, so the join multiplies nothing.
    """
    return _wide(runs, bars_of_spans, signals).applyInArrow(_fold, BOOK_SCHEMA)


def run_summaries(runs: DataFrame, bars_of_spans: DataFrame, signals: DataFrame) -> DataFrame:
    """One row a run (SUMMARY_SCHEMA) instead of its book; runs with `keep` also say their scored returns in order."""
    return _wide(runs, bars_of_spans, signals, "warmup", "keep").applyInArrow(_summarise, SUMMARY_SCHEMA)


def equity_of(book: DataFrame) -> DataFrame:
    return book.where("kind = 'equity'").select("run_id", "t", "symbol", "cash", "position", "price", "equity")


def fills_of(book: DataFrame) -> DataFrame:
    """Fills with direction, unsigned quantity and slippage cost."""
    f = book.where("kind = 'fill'")
    return f.select(
        "run_id",
        "t",
        "symbol",
        F.when(F.col("quantity") > 0, "BUY").otherwise("SELL").alias("direction"),
        F.abs("quantity").alias("quantity"),
        "fill_price",
        "reference_price",
        "commission",
        (F.abs(F.col("fill_price") - F.col("reference_price")) * F.abs("quantity")).alias("slippage_cost"),
    )


def gross_exposure(equity: DataFrame) -> DataFrame:
    """(run_id, t, equity, gross): absolute value of all positions at each mark."""
    return equity.groupBy("run_id", "t").agg(
        F.first("equity").alias("equity"), F.sum(F.abs(F.col("position") * F.col("price"))).alias("gross")
    )


def totals_of(book: DataFrame) -> DataFrame:
    return book.where("kind = 'total'").select(
        "run_id",
        F.col("cash").alias("final_cash"),
        F.col("position").alias("final_position"),
        "cancelled",
        "expired",
        (F.col("cancelled") + F.col("expired")).alias("unfilled"),
        "financing",
    )


def event_counts(book: DataFrame, signals_per_run: DataFrame | None = None) -> DataFrame:
    """Bars and fills of each run, and signals where given (run_id, n)."""
    out = book.groupBy("run_id").agg(
        F.count_distinct(F.when(F.col("kind") == "equity", F.col("t"))).alias("market"),
        F.count(F.when(F.col("kind") == "fill", 1)).alias("fill"),
    )
    return out if signals_per_run is None else out.join(
        signals_per_run.withColumnRenamed("n", "signal"), "run_id", "left"
    )
