"""Strategies as Catalyst window expressions, one restart per span.

Each builder takes bars of spans (span_id, symbol, t, close ...) and settings and returns
signals(span_id, setting_id, leaky, t, seq, symbol, target_weight, strength). Frames of honest
builders end at the current row; `assert_no_look_ahead` proves it on the analysed plan.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Params = dict[str, float]
SIGNAL_COLUMNS = ("span_id", "setting_id", "leaky", "t", "seq", "symbol", "target_weight", "strength")


class LookAheadError(RuntimeError):
    """A strategy declared honest reads rows after the current one."""


#: Columns that hold prices; a summary of them over time knows the future.
PRICES = frozenset(("open", "high", "low", "close", "volume"))


def _nodes(plan, given=None) -> list:
    """All nodes of an analysed plan above those of the plan it was given."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if given is not None and node.sameResult(given):
            continue
        found.append(node)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def _texts(node) -> list[str]:
    exprs = node.expressions()
    return [exprs.apply(i).toString() for i in range(exprs.size())]


def look_ahead_faults(df: DataFrame, bars: DataFrame | None = None) -> list[str]:
    """How the analysed plan of signals could read rows after their own bar; empty if it can't.

    Only what is built on top of `bars` is judged, if they are given; how bars come about isn't.

    Looked for: lead, window frames that reach past the current row (but for other symbols of the same bar),
    aggregates of prices that aren't grouped by bar, subqueries, and Python functions that see a whole group.
    """
    found = []
    given = None if bars is None else bars._jdf.queryExecution().analyzed()
    for node in _nodes(df._jdf.queryExecution().analyzed(), given):
        kind, texts = node.nodeName(), _texts(node)
        for text in texts:
            if "scalar-subquery" in text or "exists#" in text:
                found.append("a subquery may read any row")
            for spec, upper in re.findall(
                r"windowspecdefinition\((.*?)specifiedwindowframe\(\w+, [^,]+, (.+?)\)", text
            ):
                within_bar = re.search(r"\bt#\d+L?, ", spec)  # partitioned by the bar itself
                if not within_bar and not re.match(r"currentrow|-\d|0$", upper):
                    found.append(f"a window frame reaches the future: its upper bound is {upper}")
            if kind == "Window" and re.search(r"\blead\(", text):
                found.append("lead() reads rows after the current one")
        if kind == "Aggregate" and bars is not None:
            used = set(re.findall(r"(\w+)#\d+", " ".join(texts)))
            grouped = node.groupingExpressions()
            keys = {m for i in range(grouped.size()) for m in re.findall(r"(\w+)#\d+", grouped.apply(i).toString())}
            if used & PRICES and "t" not in keys:
                found.append("an aggregate of prices over all bars")
        if kind in ("MapInPandas", "PythonMapInArrow", "MapInArrow"):
            found.append("a Python function over whole partitions can't be read")
    return found


def assert_no_look_ahead(df: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Raise if the plan can read rows after a signal's bar; else return df."""
    faults = look_ahead_faults(df, bars)
    if faults:
        raise LookAheadError("; ".join(dict.fromkeys(faults)))
    return df


def param_grid(**axes: Sequence[float]) -> list[Params]:
    """Every combination in order; the last axis varies fastest. No axis gives one empty setting."""
    for name, values in axes.items():
        if not len(values):
            raise ValueError(f"axis {name} is empty")
    return [dict(zip(axes, row, strict=True)) for row in itertools.product(*axes.values())]


def format_params(params: Params) -> str:
    return ", ".join(f"{k}={v:g}" if isinstance(v, (int, float)) else f"{k}={v}" for k, v in params.items()) or "-"


@dataclass(frozen=True)
class Spec:
    """A strategy: its signal builder, grid, warm-up and, if it has one, its leaky twin."""

    name: str
    build: Callable[[DataFrame, Params], DataFrame]
    grid: list[Params] = field(default_factory=lambda: [{}])
    warmup: int = 0
    build_look_ahead: Callable[[DataFrame, Params], DataFrame] | None = None

    def __post_init__(self):
        if not self.grid:
            raise ValueError("a spec needs at least one setting")
        if self.warmup < 0:
            raise ValueError("warmup must not be negative")

    def signals(self, bars: DataFrame, setting_ids: Sequence[int] | None = None, leaky: bool = False) -> DataFrame:
        """Signals of the chosen settings (all by default), in one DataFrame."""
        build = self.build_look_ahead if leaky else self.build
        if build is None:
            raise ValueError(f"{self.name} has no look-ahead twin")
        out = None
        for k in range(len(self.grid)) if setting_ids is None else setting_ids:
            one = build(bars, self.grid[k]).withColumns({"setting_id": F.lit(int(k)), "leaky": F.lit(leaky)})
            out = one.select(*SIGNAL_COLUMNS) if out is None else out.unionAll(one.select(*SIGNAL_COLUMNS))
        return out if leaky else assert_no_look_ahead(out, bars)


def _w():
    return Window.partitionBy("span_id", "symbol").orderBy("t")


def _emit(df: DataFrame, weight, strength=None, seq=None) -> DataFrame:
    return df.select(
        "span_id",
        "t",
        (F.lit(0) if seq is None else seq).cast("int").alias("seq"),
        "symbol",
        weight.alias("target_weight"),
        (F.lit(0.0) if strength is None else strength).alias("strength"),
    )


def _clip(x, top: float):
    return F.greatest(F.lit(-float(top)), F.least(F.lit(float(top)), x))


def momentum(bars: DataFrame, p: Params) -> DataFrame:
    """Momentum over the spread of earlier momenta; silent until enough of them are seen."""
    k, deep, least = int(p.get("lookback", 20)), int(p.get("vol_window", 90)), int(p.get("min_vol_observations", 30))
    df = bars.withColumn("_c", F.lag("close", k).over(_w())).withColumn(
        "mom", F.log(F.try_divide(F.col("close"), F.col("_c")))
    )
    past = _w().rowsBetween(-deep, -1)
    df = df.withColumn("scale", F.stddev_samp("mom").over(past)).withColumn("seen", F.count("mom").over(past))
    df = df.where(f"mom is not null and seen >= {least} and scale > 0")
    z = F.try_divide(F.try_divide(F.col("mom"), F.col("scale")), F.lit(float(p.get("z_scale", 1.5))))
    return _emit(df, _clip(z, p.get("max_weight", 1.0)), F.try_divide(F.col("mom"), F.col("scale")))


def momentum_leaky(bars: DataFrame, p: Params) -> DataFrame:
    """The deliberate mistake: next bar's close in the signal, whole-span scale."""
    k = int(p.get("lookback", 20))
    peek = int(p.get("peek_bars", 1))
    w, whole = _w(), Window.partitionBy("span_id", "symbol")
    df = bars.withColumn("_honest", F.log(F.try_divide(F.col("close"), F.lag("close", k).over(w))))
    # towards the end the peek takes the last close there is; the last bar has none and is honest
    end = F.coalesce(
        F.lead("close", peek).over(w),
        F.last("close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    )
    df = df.withColumn("_ahead", F.log(F.try_divide(end, F.lag("close", k - 1).over(w) if k > 1 else F.col("close"))))
    df = df.withColumn(
        "mom", F.when(F.lead("close", 1).over(w).isNull(), F.col("_honest")).otherwise(F.col("_ahead"))
    ).withColumn("scale", F.stddev_samp("_honest").over(whole))
    df = df.where("mom is not null and scale > 0")
    z = F.try_divide(F.try_divide(F.col("mom"), F.col("scale")), F.lit(float(p.get("z_scale", 1.5))))
    return _emit(df, _clip(z, p.get("max_weight", 1.0)), F.try_divide(F.col("mom"), F.col("scale")))


def buy_and_hold(bars: DataFrame, p: Params) -> DataFrame:
    """One signal on the first bar of a span."""
    first = F.row_number().over(_w()) == 1
    return _emit(bars.withColumn("_f", first).where("_f"), F.lit(float(p.get("weight", 1.0))))


def sma_crossover(bars: DataFrame, p: Params) -> DataFrame:
    """In while the fast average is above the slow one; a signal on every bar once both are full."""
    fast, slow = int(p.get("fast", 20)), int(p.get("slow", 100))
    if fast >= slow:
        raise ValueError("fast must be below slow")
    w = _w()
    df = bars.withColumn("_a", F.avg("close").over(w.rowsBetween(-(fast - 1), 0))).withColumn(
        "_b", F.avg("close").over(w.rowsBetween(-(slow - 1), 0))
    ).withColumn("_n", F.count("close").over(w.rowsBetween(-(slow - 1), 0)))
    out = F.when(F.col("_a") > F.col("_b"), 1.0).otherwise(-1.0 if p.get("allow_short") else 0.0)
    return _emit(df.where(f"_n = {slow}"), out)


def cross_sectional_momentum(bars: DataFrame, p: Params) -> DataFrame:
    """Hold the top symbols by momentum (and short the bottom), re-ranked every few bars.

    Signals go out in the order of growing change of absolute target, so that positions are cut before others are opened.
    """
    k, top, every, gross = int(
        p.get("lookback", 60)
    ), int(p.get("top_n", 1)), int(p.get("rebalance_every", 21)), float(p.get("gross", 1.0))
    both = bool(p.get("long_short", False))
    n_symbols = bars.groupBy("span_id").agg(F.count_distinct("symbol").alias("_all"))
    df = bars.withColumn("_c", F.lag("close", k).over(_w())).withColumn(
        "score", F.log(F.try_divide(F.col("close"), F.col("_c")))
    ).where("score is not null")
    day = Window.partitionBy("span_id", "t")
    df = df.join(n_symbols, "span_id").withColumn("_here", F.count(F.lit(1)).over(day)).where("_here = _all")
    df = df.withColumn(
        "_k", F.dense_rank().over(Window.partitionBy("span_id").orderBy("t")) - 1
    ).where(f"pmod(_k, {every}) = 0")
    up, down = F.row_number().over(day.orderBy(F.desc("score"), "symbol")), F.row_number().over(
        day.orderBy("score", F.desc("symbol"))
    )
    size = gross / (top * (2 if both else 1))
    target = F.when(F.lit(both) & (F.col("_down") <= top), -size).when(F.col("_up") <= top, size).otherwise(0.0)
    df = df.withColumn("_up", up).withColumn("_down", down).withColumn("target", target)
    before = F.coalesce(F.lag("target").over(_w()), F.lit(0.0))
    df = df.withColumn("_change", F.abs("target") - F.abs(before))
    seq = F.row_number().over(day.orderBy("_change", "symbol")) - 1
    return _emit(df.withColumn("_seq", seq), F.col("target"), F.col("score"), F.col("_seq"))


def per_bar(callback: Callable[[list[tuple]], float | None]) -> Callable[[DataFrame, Params], DataFrame]:
    """Arbitrary Python: callback(history of (t, open, high, low, close, volume)) -> weight or None, bar by bar.

    The slow path, one group per span and symbol; history never holds a later bar.
    """

    def build(bars: DataFrame, p: Params) -> DataFrame:
        def run(pdf):
            import pandas as pd

            pdf = pdf.sort_values("t")
            rows, out = list(
                pdf[["t", "open", "high", "low", "close", "volume"]].itertuples(index=False, name=None)
            ), []
            history = []
            for i, row in enumerate(rows):
                history.append(row)  # the callback sees this list as far as it goes now
                weight = callback(history, **p)
                if weight is not None:
                    out.append((pdf["span_id"].iloc[0], rows[i][0], 0, pdf["symbol"].iloc[0], float(weight), 0.0))
            return pd.DataFrame(out, columns=["span_id", "t", "seq", "symbol", "target_weight", "strength"])

        return bars.select(
            "span_id", "symbol", "t", "open", "high", "low", "close", "volume"
        ).groupBy("span_id", "symbol").applyInPandas(run, "span_id long, t int, seq int, symbol string, target_weight double, strength double")

    return build


def scripted(weights: Sequence[float | None]) -> Callable[[DataFrame, Params], DataFrame]:
    """A weight for each bar of a span, None for silence."""

    def build(bars: DataFrame, p: Params) -> DataFrame:
        table = F.array(*[F.lit(None if x is None else float(x)).cast("double") for x in weights])
        k = F.row_number().over(_w())
        return _emit(bars.withColumn("_w", F.get(table, k - 1)).where("_w is not null"), F.col("_w"))

    return build


LOOKBACKS = (5, 10, 15, 20, 30, 45, 60)
WARMUP = max(LOOKBACKS) + 30 + 5


def momentum_spec(lookbacks: Sequence[int] = LOOKBACKS, warmup: int | None = None) -> Spec:
    return Spec(
        "momentum",
        momentum,
        param_grid(lookback=tuple(lookbacks)),
        WARMUP if warmup is None else warmup,
        momentum_leaky,
    )


def sma_spec(fast: Sequence[int] = (10, 20, 50), slow: Sequence[int] = (100, 200)) -> Spec:
    return Spec("sma", sma_crossover, param_grid(fast=tuple(fast), slow=tuple(slow)), max(slow))


def load_spec(reference: str | Spec) -> Spec:
    """A Spec itself, a built-in name, or `file.py[:ATTRIBUTE]` of a trusted local file."""
    if isinstance(reference, Spec):
        return reference
    builtin = {"momentum": momentum_spec, "sma": sma_spec, "buy_and_hold": lambda: Spec("buy_and_hold", buy_and_hold)}
    if reference in builtin:
        return builtin[reference]()
    path, _, attribute = reference.partition(":")
    if not path.endswith(".py"):
        raise ValueError(f"unknown strategy {reference!r}; built in: {sorted(builtin)}")
    import runpy

    found = runpy.run_path(path).get(attribute or "SPEC")
    found = found() if callable(found) and not isinstance(found, Spec) else found
    if not isinstance(found, Spec):
        raise ValueError(f"{reference} has no Spec named {attribute or 'SPEC'}")
    return found
