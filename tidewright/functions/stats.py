"""Performance statistics as Column expressions and grouped aggregates."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EULER = 0.5772156649015329

# Coefficients of published rational approximations of the normal
# distribution function (Hart 1968 as given by West 2005) and of its inverse (Wichura 1988, AS 241).
_HART_TOP = (
    3.52624965998911e-2,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
_HART_LOW = (
    8.83883476483184e-2,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
_AS_A = (
    2509.0809287301226727,
    33430.575583588128105,
    67265.770927008700853,
    45921.953931549871457,
    13731.693765509461125,
    1971.5909503065514427,
    133.14166789178437745,
    3.387132872796366608,
)
_AS_B = (
    5226.495278852545925,
    28729.085735721942674,
    39307.89580009271061,
    21213.794301586595867,
    5394.1960214247511077,
    687.1870074920579083,
    42.313330701600911252,
    1.0,
)
_AS_C = (
    7.7454501427834140764e-4,
    0.0227238449892691845833,
    0.24178072517745061177,
    1.27045825245236838258,
    3.64784832476320460504,
    5.7694972214606914055,
    4.6303378461565452959,
    1.42343711074968357734,
)
_AS_D = (
    1.05075007164441684324e-9,
    5.475938084995344946e-4,
    0.0151986665636164571966,
    0.14810397642748007459,
    0.68976733498510000455,
    1.6763848301838038494,
    2.05319162663775882187,
    1.0,
)
_AS_E = (
    2.01033439929228813265e-7,
    2.71155556874348757815e-5,
    0.0012426609473880784386,
    0.026532189526576123093,
    0.29656057182850489123,
    1.7848265399172913358,
    5.4637849111641143699,
    6.6579046435011037772,
)
_AS_F = (
    2.04426310338993978564e-15,
    1.4215117583164458887e-7,
    1.8463183175100546818e-5,
    7.868691311456132591e-4,
    0.0148753612908506148525,
    0.13692988092273580531,
    0.59983220655588793769,
    1.0,
)


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    text = f"{coefficients[0]!r}e0" if "e" not in repr(coefficients[0]) else repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}{'' if 'e' in repr(c) else 'e0'})"
    return text


def normal_cdf_sql(x: str) -> str:
    """Normal distribution function as one SQL expression that Spark and DuckDB both read."""
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2e0) * {_poly(_HART_TOP, a)} / {_poly(_HART_LOW, a)}"
    far = f"exp(-{a} * {a} / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 65e-2))))) / 2.506628274631e0"
    tail = f"(case when {a} > 37e0 then 0e0 when {a} < 7.07106781186547e0 then {near} else {far} end)"
    return f"(case when {x} > 0e0 then 1e0 - {tail} else {tail} end)"


def normal_inverse_sql(p: str) -> str:
    """Inverse normal distribution function as one SQL expression; null outside (0, 1)."""
    q = f"({p} - 5e-1)"
    r0 = f"(180625e-6 - {q} * {q})"
    r = f"sqrt(-ln(case when {q} < 0e0 then {p} else 1e0 - {p} end))"
    mid, low = f"({r} - 16e-1)", f"({r} - 5e0)"
    tail = f"(case when {r} <= 5e0 then {_poly(_AS_C, mid)} / {_poly(_AS_D, mid)} else {_poly(_AS_E, low)} / {_poly(_AS_F, low)} end)"
    return f"(case when {p} <= 0e0 or {p} >= 1e0 then null when abs({q}) <= 425e-3 then {q} * {_poly(_AS_A, r0)} / {_poly(_AS_B, r0)} when {q} < 0e0 then -{tail} else {tail} end)"


def _bound(argument: str, body: str) -> Column:
    """body over x with x bound once: the long fractions would otherwise repeat the argument's code."""
    return F.expr(f"element_at(transform(array({argument}), x -> {body}), 1)")


def normal_cdf(x: str) -> Column:
    return _bound(x, normal_cdf_sql("x"))


def normal_inverse(p: str) -> Column:
    return _bound(p, normal_inverse_sql("x"))


def level_stats(bars: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean and population spread of all closes: knowledge of the whole sample, never of a bar."""
    return bars.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean"), F.stddev_pop("close").alias("sd")
    )


def simple_returns(equity: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    """One return for each point but the first: 0 where the previous value is 0 or the ratio isn't finite."""
    w = Window.partitionBy(*by).orderBy(t)
    out = equity.withColumn("_prev", F.lag("equity").over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1")
    r = F.try_divide(F.col("equity"), F.col("_prev")) - 1
    r = F.when((F.col("_prev") == 0) | r.isNull() | F.isnan(r) | (F.abs(r) == float("inf")), 0.0).otherwise(r)
    return out.select(*by, t, r.alias("r"))


def sharpe_of(mean: Column, sd: Column, n: Column, bars_per_year: float) -> Column:
    """Annualised ratio; 0 for fewer than two returns or a spread that is rounding noise."""
    fine = (n >= 2) & (sd > 1e-12 * F.greatest(F.abs(mean), F.lit(1e-12)))
    return F.when(fine, F.try_divide(mean, sd) * F.sqrt(F.lit(float(bars_per_year)))).otherwise(0.0)


def sharpe(returns: DataFrame, by: list[str], bars_per_year: float = 252) -> DataFrame:
    g = returns.groupBy(*by).agg(F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.count("r").alias("n"))
    return g.select(
        *by, "n", F.coalesce(sharpe_of(F.col("_m"), F.col("_s"), F.col("n"), bars_per_year), F.lit(0.0)).alias("sharpe")
    )


def max_drawdown(curve: DataFrame, by: list[str], t: str = "t") -> DataFrame:
    top = F.max("equity").over(Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    fall = F.when(top == 0, 0.0).otherwise(F.try_divide(F.col("equity"), top) - 1)
    return curve.withColumn("_fall", fall).groupBy(*by).agg(F.min("_fall").alias("max_drawdown"))


def curve_metrics(curve: DataFrame, by: list[str], bars_per_year: float = 252, t: str = "t") -> DataFrame:
    """Ratio, returns, volatility and drawdown of curves(by, t, equity)."""
    r = simple_returns(curve, by, t).groupBy(*by).agg(
        F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.count("r").alias("_n")
    )
    ends = curve.groupBy(*by).agg(
        F.min_by("equity", t).alias("_first"),
        F.max_by("equity", t).alias("_last"),
        F.count(F.lit(1)).alias("_points"),
        F.avg("equity").alias("mean_equity"),
    )
    j = ends.join(r, by, "left").join(max_drawdown(curve, by, t), by, "left")
    first, last, n = F.col("_first"), F.col("_last"), F.coalesce("_n", F.lit(0))
    total = F.when((n < 1) | (first == 0), 0.0).otherwise(F.try_divide(last, first) - 1)
    annual = F.when((n < 1) | (first <= 0) | (last <= 0), 0.0).otherwise(
        F.pow(F.try_divide(last, first), F.try_divide(F.lit(float(bars_per_year)), n)) - 1
    )
    vol = F.when(n > 1, F.col("_s") * F.sqrt(F.lit(float(bars_per_year)))).otherwise(0.0)
    return j.select(
        *by,
        n.alias("n_returns"),
        F.coalesce(sharpe_of(F.col("_m"), F.col("_s"), n, bars_per_year), F.lit(0.0)).alias("sharpe"),
        total.alias("total_return"),
        annual.alias("annual_return"),
        F.coalesce(vol, F.lit(0.0)).alias("annual_volatility"),
        F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"),
        "mean_equity",
    )


def costs_by_run(fills: DataFrame) -> DataFrame:
    """Trades, commission, slippage and notional of each run."""
    return fills.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.sum("commission").alias("commission"),
        F.sum("slippage_cost").alias("slippage"),
        F.sum(F.abs(F.col("quantity") * F.col("fill_price"))).alias("notional"),
    )


def turnover(notional: Column, mean_equity: Column, n_returns: Column, bars_per_year: float = 252) -> Column:
    """Traded notional over mean equity and scored years."""
    years = F.greatest(n_returns / F.lit(float(bars_per_year)), F.lit(1e-9))
    return F.when(mean_equity > 0, F.try_divide(F.try_divide(notional, mean_equity), years)).otherwise(0.0)


def scored(equity: DataFrame, warmup_of: DataFrame) -> DataFrame:
    """Drop the first max(0, warmup - 1) points of each run; the base point stays."""
    point = F.row_number().over(Window.partitionBy("run_id").orderBy("t")) - 1
    # marks of one bar share the equity: one row a bar is enough, whatever the number of symbols
    e = equity.groupBy("run_id", "t").agg(F.first("equity").alias("equity")).withColumn("_k", point)
    return e.join(warmup_of.select("run_id", "warmup"), "run_id").where(
        F.col("_k") >= F.greatest(F.lit(0), F.col("warmup") - 1)
    ).select("run_id", "t", "equity")


def moments(returns: DataFrame, by: list[str]) -> DataFrame:
    """n, ratio per bar (sample), population skewness and non-excess kurtosis from central moments."""
    base = returns.groupBy(*by).agg(F.avg("r").alias("_m"), F.stddev_samp("r").alias("_sd"), F.count("r").alias("n"))
    d = F.col("r") - F.col("_m")
    c = returns.join(base, by).groupBy(*by).agg(
        F.first("n").alias("n"),
        F.first("_m").alias("_m"),
        F.first("_sd").alias("_sd"),
        F.avg(d * d).alias("m2"),
        F.avg(d * d * d).alias("m3"),
        F.avg(d * d * d * d).alias("m4"),
    )
    fine = (F.col("n") >= 2) & (F.col("_sd") > 1e-12 * F.greatest(F.abs("_m"), F.lit(1e-12)))
    return c.select(
        *by,
        "n",
        F.when(fine, F.try_divide(F.col("_m"), F.col("_sd"))).alias("ratio"),
        F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5))).alias("skew"),
        F.try_divide(F.col("m4"), F.col("m2") * F.col("m2")).alias("kurtosis"),
    )


def moments_of_summary() -> list[Column]:
    """The columns of moments from a run's summary."""
    fine = (F.col("n_returns") >= 2) & (F.col("sd") > 1e-12 * F.greatest(F.abs("mean"), F.lit(1e-12)))
    return [
        F.col("n_returns").alias("n"),
        F.when(fine, F.try_divide(F.col("mean"), F.col("sd"))).alias("ratio"),
        F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5))).alias("skew"),
        F.try_divide(F.col("m4"), F.col("m2") * F.col("m2")).alias("kurtosis"),
    ]


def metrics_of_summary(bars_per_year: float = 252) -> list[Column]:
    """The metrics of a run's summary, costs included."""
    first, last, n, year = F.col("first"), F.col("last"), F.col("n_returns"), F.lit(float(bars_per_year))
    total = F.when((n < 1) | (first == 0), 0.0).otherwise(F.try_divide(last, first) - 1)
    annual = F.when((n < 1) | (first <= 0) | (last <= 0), 0.0).otherwise(
        F.pow(F.try_divide(last, first), F.try_divide(year, n)) - 1
    )
    return [
        F.coalesce(sharpe_of(F.col("mean"), F.col("sd"), n, bars_per_year), F.lit(0.0)).alias("sharpe"), total.alias("total_return"), annual.alias("annual_return"),
        F.coalesce(F.col("sd") * F.sqrt(year), F.lit(0.0)).alias("annual_volatility"), F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"), "mean_equity",
        turnover(F.col("notional"), F.col("mean_equity"), n, bars_per_year).alias("turnover"), "n_trades", "commission", "slippage", "notional", n.alias("n_returns"),
    ]


def probabilistic_sharpe(returns: DataFrame, by: list[str], benchmark: str = "0e0") -> DataFrame:
    """Probability that the true ratio per bar beats the benchmark (an SQL expression per group)."""
    m = moments(returns, by)
    spread = "(1e0 - skew * ratio + (kurtosis - 1e0) / 4e0 * ratio * ratio)"
    z = m.withColumn(
        "_z",
        F.expr(
            f"case when n >= 3 and ratio is not null and {spread} > 0e0 then (ratio - {benchmark}) * sqrt(n - 1e0) / sqrt({spread}) end"
        ),
    )
    return z.select(*by, "n", F.coalesce(normal_cdf("_z"), F.lit(0.5)).alias("psr"))


def expected_max_sql(n: str, variance: str) -> str:
    one, two = normal_inverse_sql(f"(1e0 - 1e0 / {n})"), normal_inverse_sql(f"(1e0 - 1e0 / ({n} * exp(1e0)))")
    return f"(case when {n} < 2 or not {variance} > 0e0 then 0e0 else sqrt({variance}) * ((1e0 - {EULER!r}e0) * {one} + {EULER!r}e0 * {two}) end)"


def expected_max(n: str, variance: str) -> Column:
    one, two = normal_inverse(f"1e0 - 1e0 / {n}"), normal_inverse(f"1e0 - 1e0 / ({n} * exp(1e0))")
    mixed = F.sqrt(variance) * ((1 - EULER) * one + EULER * two)
    return F.when((F.col(n) < 2) | ~(F.col(variance) > 0), 0.0).otherwise(mixed)


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    """Expected largest of n independent ratios with this variance."""
    if n_trials < 2 or not variance > 0:
        return 0.0
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * z(1 - 1 / n_trials) + EULER * z(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(returns: DataFrame, trials: DataFrame, by: list[str], bars_per_year: float = 252) -> DataFrame:
    """Probabilistic ratio against the expected maximum of trials(by, sharpe), as (by, dsr)."""
    return deflated_of_moments(moments(returns, by), trials, by, bars_per_year)


def deflated_of_moments(
    moments_of: DataFrame, trials: DataFrame, by: list[str], bars_per_year: float = 252
) -> DataFrame:
    """The same from moments(by, n, ratio, skew, kurtosis)."""
    t = trials.groupBy(*by).agg(
        F.count("sharpe").cast("double").alias("_k"),
        F.var_samp(F.col("sharpe") / F.sqrt(F.lit(float(bars_per_year)))).alias("_v"),
    ).withColumn("_v", F.coalesce("_v", F.lit(0.0))).withColumn("bar", expected_max("_k", "_v"))
    m = moments_of.join(t, by)
    spread = "(1e0 - skew * ratio + (kurtosis - 1e0) / 4e0 * ratio * ratio)"
    z = m.withColumn(
        "_z",
        F.expr(
            f"case when n >= 3 and ratio is not null and {spread} > 0e0 then (ratio - bar) * sqrt(n - 1e0) / sqrt({spread}) end"
        ),
    )
    return z.select(*by, "bar", F.coalesce(normal_cdf("_z"), F.lit(0.5)).alias("dsr"))
