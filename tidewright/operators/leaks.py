"""Look-ahead detection: replace the future, check that the past's signals stay.

The altered copies of a series are rows of their own (span_id per cut), so all cuts of all
settings are one signal plan and one join. The plan guard in `signals` is the first line;
this test also catches code that the guard can't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signals import LookAheadError, Spec, format_params


@dataclass(frozen=True)
class LeakReport:
    cuts: tuple[int, ...]
    settings: list[dict]
    findings: list[dict]
    nondeterministic: list[dict]

    @property
    def passed(self) -> bool:
        return not self.findings and not self.nondeterministic

    def summary(self) -> str:
        if not self.cuts:
            return "look-ahead check: too few bars to check"
        if self.passed:
            return f"look-ahead check: passed, {len(self.settings)} setting(s) at {len(self.cuts)} cut(s)"
        said = [f"{format_params(f['params'])}: {f['detail']}" for f in self.findings] + [
            f"{format_params(p)}: two equal runs differ" for p in self.nondeterministic
        ]
        return "look-ahead check: FAILED\n" + "\n".join(f"  {x}" for x in said)


def cut_points(n_bars: int, warmup: int, n_cuts: int = 5) -> tuple[int, ...]:
    """Evenly spaced bars after the warm-up and before the last."""
    low, high = min(max(warmup, 1), n_bars - 2), n_bars - 2
    if high < low or n_cuts <= 0:
        return ()
    spots = np.linspace(low, high, n_cuts + 2)[1:-1] if high > low else [low]
    return tuple(sorted({int(round(x)) for x in spots}))


def perturbed_spans(bars: DataFrame, cuts: tuple[int, ...], seed: int = 0) -> DataFrame:
    """Bars of one series as span 0 and, for the k-th cut, as span k + 1 with every later bar replaced."""
    cuts_of = bars.withColumn("span_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(len(cuts) + 1)])))

    def alter(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        k = table.column("span_id")[0].as_py()
        if k == 0:
            return table
        c = table.column("close").to_numpy().copy()
        cut, n = cuts[k - 1], len(c)
        if n - cut - 1 <= 0:
            return table
        vol = float(np.diff(np.log(c)).std()) if n > 2 else 0.01
        vol = vol if np.isfinite(vol) and vol > 0 else 0.01
        rng = np.random.default_rng(seed * 1000 + k - 1)
        tail = c[cut] * np.exp(np.cumsum(rng.normal(3 * vol, 2 * vol, n - cut - 1)))
        scale = rng.uniform(0.3, 3.0, n - cut - 1)
        cols = {x: table.column(x).to_numpy().copy() for x in ("open", "high", "low", "volume")}
        before = np.concatenate(([c[cut]], tail[:-1]))
        c[cut + 1 :] = tail
        cols[
            "open"
        ][cut + 1 :], cols["high"][cut + 1 :], cols["low"][cut + 1 :] = before, np.maximum(before, tail), np.minimum(before, tail)
        cols["volume"][cut + 1 :] = cols["volume"][cut + 1 :] * scale + 1.0
        for name, values in (cols | {"close": c}).items():
            table = table.set_column(table.column_names.index(name), name, pa.array(values))
        return table

    schema = "span_id long, symbol string, t int, open double, high double, low double, close double, volume double"
    return cuts_of.select(
        "span_id", "symbol", "t", "open", "high", "low", "close", "volume"
    ).groupBy("span_id").applyInArrow(alter, schema)


def signal_differences(
    signals: DataFrame, cuts: tuple[int, ...], tolerance: float = 1e-12, strengths: bool = False
) -> DataFrame:
    """(setting_id, k, t, original, altered): first differing signal up to each cut.

    Weights are compared; with `strengths` also what stands behind them, so that a weight at its limit
    hides no change (original_strength, altered_strength follow).
    """
    key = ["setting_id", "symbol", "seq", "t"]
    limit = F.element_at(F.array(*[F.lit(int(c)) for c in cuts]), F.col("k").cast("int"))
    base = signals.where("span_id = 0").select(*key, F.col("target_weight").alias("a"), F.col("strength").alias("sa"))
    other = signals.where("span_id > 0").select(
        F.col("span_id").alias("k"), *key, F.col("target_weight").alias("b"), F.col("strength").alias("sb")
    ).where(F.col("t") <= limit)
    spread = base.withColumn(
        "k", F.explode(F.sequence(F.lit(1), F.lit(len(cuts))))
    ).withColumn("k", F.col("k").cast("long")).where(F.col("t") <= limit)
    j = spread.join(other, ["k", *key], "full_outer")

    def close(a: str, b: str):
        return F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))

    differs = F.col("a").isNull() | F.col("b").isNull() | ~close("a", "b")
    shown = [F.col("first.a").alias("original"), F.col("first.b").alias("altered")]
    if strengths:
        # a strategy need not state a strength, so two without one are equal
        differs |= ~(F.col("sa").eqNullSafe(F.col("sb")) | F.coalesce(close("sa", "sb"), F.lit(False)))
        shown += [F.col("first.sa").alias("original_strength"), F.col("first.sb").alias("altered_strength")]
    first = F.min(F.struct("t", "seq", "symbol", "a", "b", "sa", "sb")).alias("first")
    return j.where(differs).groupBy("setting_id", "k").agg(first).select("setting_id", "k", "first.t", *shown)


def detect_look_ahead(
    bars: DataFrame, spec: Spec, n_cuts: int = 5, seed: int = 0, look_ahead: bool = False, strengths: bool = False
) -> LeakReport:
    """Check every setting of spec on one series; look_ahead checks the leaky twin instead, strengths more than weights."""
    values = ("target_weight", "strength") if strengths else ("target_weight",)
    n = bars.select("t").distinct().count()
    cuts = cut_points(n, spec.warmup, n_cuts)
    if not cuts:
        return LeakReport(cuts, spec.grid, [], [])
    spans = perturbed_spans(bars, cuts, seed).persist()
    try:
        signals = spec.signals(spans, leaky=look_ahead)
    except LookAheadError as refused:
        return LeakReport(
            cuts,
            spec.grid,
            [{"params": p, "cut": -1, "t": None, "detail": f"refused: {refused}"} for p in spec.grid],
            [],
        )
    one = signals.where("span_id = 0").select("setting_id", "symbol", "t", "seq", *values)
    again = spec.signals(spans.where("span_id = 0"), leaky=look_ahead).select(
        "setting_id", "symbol", "t", "seq", *values
    )
    unstable = {
        r[
            "setting_id"
        ] for r in one.exceptAll(again).union(again.exceptAll(one)).select("setting_id").distinct().collect()
    }
    found: dict[int, dict] = {}
    for r in signal_differences(signals, cuts, strengths=strengths).orderBy("k").collect():
        if r["setting_id"] not in unstable and r["setting_id"] not in found:
            p = spec.grid[r["setting_id"]]
            said = f"changed from {r['original']} to {r['altered']}"
            if strengths:
                said += f" (strength from {r['original_strength']} to {r['altered_strength']})"
            found[r["setting_id"]] = {
                "params": p,
                "cut": cuts[r["k"] - 1],
                "t": r["t"],
                "detail": f"the signal at bar {r['t']} {said} when only bars after {cuts[r['k'] - 1]} were altered",
            }
    spans.unpersist()
    return LeakReport(cuts, spec.grid, [found[k] for k in sorted(found)], [spec.grid[k] for k in sorted(unstable)])
