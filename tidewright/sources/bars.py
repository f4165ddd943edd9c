"""Bar sources: price files, series, test-table builders, panels and synthetic paths."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Accepted header spellings, compared without case and outer blanks.
DATE_NAMES = ("date", "datetime", "timestamp", "time")
ADJUSTED_NAMES = ("adj close", "adj_close", "adjclose", "adjusted close", "adjusted_close")

BAR_COLUMNS = ("series_id", "symbol", "t", "time", "open", "high", "low", "close", "volume")


class BarFormatError(ValueError):
    """A price file breaks a rule; the message names the first offending row."""


def derive_ohlc(df: DataFrame, by: list[str], order: str = "t") -> DataFrame:
    """open = previous close (the first: its own), high and low the larger and smaller of open and close."""
    before = F.coalesce(F.lag("close").over(Window.partitionBy(*by).orderBy(order)), F.col("close"))
    df = df.withColumn("open", before)
    return df.withColumn("high", F.greatest("open", "close")).withColumn("low", F.least("open", "close"))


def bars_from_series(
    closes: DataFrame, symbol: str = "SYNTH", start_index: int = 0, default_volume: float = 1_000_000.0
) -> DataFrame:
    """closes(t, close[, volume]) as bars."""
    volume = F.coalesce(
        F.col("volume").cast("double"), F.lit(default_volume)
    ) if "volume" in closes.columns else F.lit(default_volume)
    df = closes.select(
        F.lit(symbol).alias("series_id"),
        F.lit(symbol).alias("symbol"),
        (F.col("t") + start_index).cast("int").alias("t"),
        F.lit(None).cast("timestamp_ntz").alias("time"),
        F.col("close").cast("double").alias("close"),
        volume.alias("volume"),
    )
    return derive_ohlc(df, ["series_id"]).select(*BAR_COLUMNS)


def _find(columns: list[str], names: tuple[str, ...]) -> str | None:
    have = {c.strip().lstrip("﻿").lower(): c for c in reversed(columns)}
    return next((have[n] for n in names if n in have), None)


def normalise_bars(
    raw: DataFrame,
    symbol: str | None = None,
    use_adjusted: bool = True,
    default_volume: float | None = None,
    line: str | None = None,
    check: bool | None = True,
) -> DataFrame:
    """Columns of a price table (any accepted spelling) as validated bars.

    `line` names a column with the row's order in its file; without one, rows are ordered by
    date. Rules: dates strictly increasing, prices finite and positive, volumes finite and not
    negative, at least two rows. A broken rule raises and names the first row that breaks one.
    """
    date, close = _find(raw.columns, DATE_NAMES), _find(raw.columns, ("close",))
    if date is None or close is None:
        raise BarFormatError(f"need a date and a close column, found {raw.columns}")
    volume = _find(raw.columns, ("volume",))
    if volume is None and default_volume is None:
        raise BarFormatError("no volume column; give default_volume to assume one")
    adjusted = _find(raw.columns, ADJUSTED_NAMES) if use_adjusted else None
    ohl = [_find(raw.columns, (n,)) for n in ("open", "high", "low")]
    real = all(ohl)

    def number(c: str) -> Column:
        return F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)")

    time = F.expr(
        f"try_cast(regexp_replace(trim(cast(`{date}` as string)), 'Z$|[+-][0-9]{{2}}:?[0-9]{{2}}$', '') as timestamp_ntz)"
    )
    name = F.lit(symbol) if symbol is not None else F.col("symbol")
    cols = {
        "symbol": name,
        "_line": F.col(line) if line else F.lit(0),
        "time": F.date_trunc("day", time).cast("timestamp_ntz") if line else time,
        "_close": number(close),
        "volume": number(volume) if volume else F.lit(float(default_volume or 0.0)),
        "_adj": number(adjusted) if adjusted else number(close),
    }
    cols |= {
        f"_{n}": number(c) if real else F.lit(None).cast("double") for n, c in zip(
            ("open", "high", "low"), ohl, strict=True
        )
    }
    df = raw.select(*[c.alias(k) for k, c in cols.items()])
    order = Window.partitionBy(
        "symbol"
    ).orderBy("_line", "time") if line else Window.partitionBy("symbol").orderBy("time")
    df = df.withColumn("t", (F.row_number().over(order) - 1).cast("int")).withColumn(
        "_before", F.lag("time").over(order)
    )

    def bad(c: str) -> Column:
        v = F.col(c)
        return v.isNull() | F.isnan(v) | (v <= 0) | (v == math.inf)

    v = F.col("volume")
    wrong = F.when(F.col("time").isNull(), "date can't be read").when(
        F.col("_before").isNotNull() & (F.col("time") <= F.col("_before")), "dates must strictly increase"
    ).when(bad(
        "_close"
    ), "close must be a positive number").when(bad("_adj"), "adjusted close must be a positive number")
    for c in ("_open", "_high", "_low") if real else ():
        wrong = wrong.when(bad(c), f"{c[1:]} must be a positive number")
    wrong = wrong.when(
        v.isNull() | F.isnan(v) | (v < 0) | (v == math.inf), "volume must be a number that isn't negative"
    )
    if check is None:
        return df.withColumn("fault", wrong).where("fault is not null").select("symbol", "t", "fault")
    if check:
        seen = df.withColumn("_wrong", wrong).groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(F.col("_wrong").isNotNull(), F.struct("t", "_wrong"))).alias("first"),
        ).where("first is not null or n < 2").limit(1).collect()
        if seen:
            first = seen[0]["first"]
            raise BarFormatError(
                f"{seen[0]['symbol']}: " + (
                    f"row {first['t'] + 2}: {first['_wrong']}" if first else "need at least two rows"
                )
            )
    scale = F.col("_adj") / F.col("_close")
    df = df.withColumn("close", F.col("_adj")).withColumn("series_id", F.col("symbol"))
    if real:
        for n in ("open", "high", "low"):
            df = df.withColumn(n, F.col(f"_{n}") * scale)
    else:
        df = derive_ohlc(df, ["symbol"])
    return df.select(*BAR_COLUMNS)


def price_faults(raw: DataFrame, **options) -> DataFrame:
    """(symbol, t, fault): every row of a price table that breaks a rule, with the first rule it breaks."""
    return normalise_bars(raw, check=None, **options)


def write_prices(bars: DataFrame, path: str, dates: str = "yyyy-MM-dd") -> None:
    """Bars of one series as a folder of CSV that load_bars reads: Date, Open, High, Low, Close, Volume, in the order of t."""
    day = F.coalesce(
        F.date_format("time", dates), F.date_format(F.date_add(F.lit("2000-01-03").cast("date"), F.col("t")), dates)
    )
    out = bars.select(
        day.alias("Date"),
        F.col("open").alias("Open"),
        F.col("high").alias("High"),
        F.col("low").alias("Low"),
        F.col("close").alias("Close"),
        F.col("volume").alias("Volume"),
        "t",
    )
    out.coalesce(1).sortWithinPartitions("t").drop("t").write.option("header", True).csv(path)


def sample_prices(spark: SparkSession, path: str, seed: int = 7, config: SyntheticConfig | None = None) -> None:
    """A price file of one synthetic path, to try commands on."""
    write_prices(synthetic_bars(synthetic_paths(spark, [seed], config)), path)


def fetched_bars(spark: SparkSession, symbol: str, start: str, end: str, fetch=None, **options) -> DataFrame:
    """Bars of a downloaded daily history.

    fetch(symbol, start, end) returns rows of (date, open, high, low, close, adjusted close, volume);
    without one, the yfinance package is used if it is installed.
    """
    if fetch is None:
        try:
            import yfinance
        except ImportError as e:
            raise BarFormatError("downloading needs the yfinance package, or a fetch function of your own") from e

        def fetch(symbol, start, end):
            got = yfinance.download(symbol, start=start, end=end, auto_adjust=False, progress=False)
            got.columns = [c[0] if isinstance(c, tuple) else c for c in got.columns]
            return [
                (str(d.date()), *map(float, r)) for d, *r in got[
                    ["Open", "High", "Low", "Close", "Adj Close", "Volume"]
                ].itertuples(name=None)
            ]

    rows = list(fetch(symbol, start, end))
    if not rows:
        raise BarFormatError(f"no prices of {symbol} from {start} to {end}")
    raw = spark.createDataFrame(
        rows, "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double"
    )
    return normalise_bars(raw, symbol, **options)


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0].upper()


def load_bars(
    spark: SparkSession,
    path: str,
    symbol: str | None = None,
    use_adjusted: bool = True,
    default_volume: float | None = None,
) -> DataFrame:
    """Bars from a CSV file (header, any column order) or a Parquet file, by its suffix."""
    symbol = symbol or _stem(path)
    if path.endswith((".parquet", ".pq")):
        return normalise_bars(spark.read.parquet(path), symbol, use_adjusted, default_volume)
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    raw = raw.withColumn("_row", F.monotonically_increasing_id())
    return normalise_bars(raw, symbol, use_adjusted, default_volume, line="_row")


def load_panel(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Several files as one aligned panel; a file stem may occur once."""
    stems = [_stem(p) for p in paths]
    if len(set(stems)) != len(stems):
        raise BarFormatError(f"two files have the same symbol: {sorted(stems)}")
    out = None
    for p in paths:
        one = load_bars(spark, p, **options)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise BarFormatError("an empty panel")
    return align_panel(out)


def shared_dates(rows: DataFrame) -> DataFrame:
    """The rows(symbol, time, ...) of dates that every symbol has."""
    n = rows.agg(F.count_distinct("symbol").alias("n"))
    common = rows.groupBy("time").agg(F.count_distinct("symbol").alias("k")).join(
        F.broadcast(n), F.col("k") == F.col("n")
    ).select("time")
    return rows.join(common, "time", "left_semi")


def align_panel(bars: DataFrame) -> DataFrame:
    """Bars of the dates on which every symbol trades, t counted from 0 again."""
    kept = shared_dates(bars)
    return kept.withColumn(
        "t", (F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1).cast("int")
    ).withColumn("series_id", F.lit("PANEL")).select(*BAR_COLUMNS)


def same_calendar(bars: DataFrame) -> bool:
    """Whether all symbols have bars on the same dates."""
    n = bars.select("symbol").distinct().count()
    return not bars.groupBy("time").agg(F.count_distinct("symbol").alias("k")).where(F.col("k") != n).limit(1).count()


def has_real_opens(bars: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(series_id, real_opens): some open differs from the previous close beyond float noise."""
    before = F.lag("close").over(Window.partitionBy("series_id", "symbol").orderBy("t"))
    gap = F.abs(F.col("open") - before) > tolerance * F.abs(before)
    return bars.withColumn("_g", F.coalesce(gap, F.lit(False))).groupBy("series_id").agg(
        F.max("_g").alias("real_opens")
    )


# Builders over the driver's tables


def _ratio_of_sums(df: DataFrame, *keys: str) -> DataFrame:
    """Exact decimal sums, so that any summation order gives the same price."""
    price, volume = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), F.sum(
        F.col("l_quantity").cast("decimal(18,2)")
    )
    return df.groupBy(*keys).agg(price.cast("double").alias("paid"), volume.cast("double").alias("volume"))


def _smoothed(df: DataFrame, by: list[str], window: int) -> DataFrame:
    px = F.avg(F.col("paid") / F.col("volume")).over(
        Window.partitionBy(*by).orderBy("time").rowsBetween(-(window - 1), 0)
    )
    df = df.withColumn("close", F.round(px, 6)).withColumn(
        "t", (F.row_number().over(Window.partitionBy(*by).orderBy("time")) - 1).cast("int")
    )
    return derive_ohlc(df, by)


def daily_bars(lineitem: DataFrame, window: int = 21) -> DataFrame:
    """One series ALL: price per unit of each ship date, smoothed over `window` rows."""
    day = _ratio_of_sums(lineitem, "l_shipdate").select(
        F.lit("ALL").alias("series_id"),
        F.lit("ALL").alias("symbol"),
        F.col("l_shipdate").alias("time"),
        "paid",
        "volume",
    )
    return _smoothed(day, ["series_id"], window).select(*BAR_COLUMNS)


def flag_panel(lineitem: DataFrame, window: int = 21) -> DataFrame:
    """Panel of return flags over the dates that all flags share; aligned first, then smoothed."""
    day = _ratio_of_sums(lineitem, "l_shipdate", "l_returnflag").select(
        F.lit("PANEL").alias("series_id"),
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").alias("time"),
        "paid",
        "volume",
    )
    return _smoothed(shared_dates(day), ["symbol"], window).select(*BAR_COLUMNS)


def weekly_brand_panel(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Panel of brands per week over the weeks that all brands share."""
    week = F.date_trunc("week", "l_shipdate").cast("timestamp_ntz")
    df = lineitem.join(
        part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"
    ).withColumn("week", week)
    df = _ratio_of_sums(df, "week", "p_brand").select(
        F.lit("PANEL").alias("series_id"),
        F.col("p_brand").alias("symbol"),
        F.col("week").alias("time"),
        "paid",
        "volume",
    )
    return _smoothed(shared_dates(df), ["symbol"], 1).select(*BAR_COLUMNS)


def event_bars(events: DataFrame, step: str = "hour") -> DataFrame:
    """Per event type and hour: real opens, highs and lows of value + 1, volume the count of events."""
    at = F.date_trunc(step, "ts").cast("timestamp_ntz")
    px = F.col("value") + 1
    order = F.struct("ts", "event_id")
    g = events.withColumn("time", at).groupBy(F.col("event_type").alias("symbol"), "time").agg(
        F.min_by(px, order).alias("open"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.max_by(px, order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return g.withColumn("series_id", F.col("symbol")).withColumn(
        "t", (F.row_number().over(Window.partitionBy("symbol").orderBy("time")) - 1).cast("int")
    ).select(*BAR_COLUMNS)


# Synthetic paths


@dataclass(frozen=True)
class SyntheticConfig:
    n_bars: int = 2520
    initial_price: float = 100.0
    annual_drift: float = 0.04
    annual_vol: float = 0.20
    bars_per_year: int = 252
    signal_alpha: float = 0.115
    signal_persistence: float = 0.94
    average_daily_volume: float = 1_000_000.0
    volume_log_vol: float = 0.35

    def __post_init__(self):
        if not 0 <= self.signal_persistence < 1 or self.n_bars < 2 or self.annual_vol <= 0:
            raise ValueError("persistence must be in [0, 1), n_bars at least 2 and annual_vol positive")


def synthetic_arrays(config: SyntheticConfig, seed: int) -> dict[str, np.ndarray]:
    """One path: a hidden AR(1) state tilts the next bar's drift. Streams are drawn state, noise, volume."""
    rng = np.random.default_rng(seed)
    n, dt = config.n_bars, 1.0 / config.bars_per_year
    draw_state, draw_noise, draw_volume = (rng.standard_normal(n) for _ in range(3))
    keep, fresh = config.signal_persistence, math.sqrt(1.0 - config.signal_persistence**2)
    state, level = [float(draw_state[0])], float(draw_state[0])
    for e in draw_state[1:].tolist():
        level = keep * level + fresh * e
        state.append(level)
    state = np.array(state)
    sigma = config.annual_vol * math.sqrt(dt)
    drift = (config.annual_drift - 0.5 * config.annual_vol**2) * dt
    moves = np.concatenate(([0.0], drift + config.signal_alpha * sigma * state[:-1] + sigma * draw_noise[1:]))
    spread = config.volume_log_vol
    return {
        "t": np.arange(n, dtype=np.int32),
        "close": config.initial_price * np.exp(np.cumsum(moves)),
        "volume": config.average_daily_volume * np.exp(spread * draw_volume - 0.5 * spread**2),
        "log_return": moves,
        "latent_state": state,
    }


def synthetic_paths(spark: SparkSession, seeds: list[int], config: SyntheticConfig | None = None) -> DataFrame:
    """(seed, t, close, volume, log_return, latent_state): one task per seed."""
    config = config or SyntheticConfig()

    def draw(table: pa.Table) -> pa.Table:
        seed = table.column("seed")[0].as_py()
        return pa.table(
            {
                "seed": pa.array([seed] * config.n_bars, pa.int64()),
                **{k: pa.array(v) for k, v in synthetic_arrays(config, seed).items()},
            }
        )

    seeds_df = spark.createDataFrame([(int(s),) for s in seeds], "seed long")
    return seeds_df.groupBy("seed").applyInArrow(
        draw, "seed long, t int, close double, volume double, log_return double, latent_state double"
    )


def synthetic_bars(paths: DataFrame) -> DataFrame:
    """Bars of synthetic paths; the series is named by the seed."""
    df = paths.select(
        F.col("seed").cast("string").alias("series_id"),
        F.lit("SYNTH").alias("symbol"),
        "t",
        F.lit(None).cast("timestamp_ntz").alias("time"),
        "close",
        "volume",
    )
    return derive_ohlc(df, ["series_id"]).select(*BAR_COLUMNS)


def oracle_sharpe(paths: DataFrame, bars_per_year: int = 252) -> DataFrame:
    """(seed, sharpe) of holding the sign of the previous hidden state."""
    before = F.lag("latent_state").over(Window.partitionBy("seed").orderBy("t"))
    g = paths.withColumn("r", F.signum(before) * F.col("log_return")).where("r is not null").groupBy("seed").agg(
        F.avg("r").alias("m"), F.stddev_samp("r").alias("s")
    )
    return g.select(
        "seed",
        F.when(
            F.col("s") > 0, F.try_divide(F.col("m"), F.col("s")) * F.sqrt(F.lit(float(bars_per_year)))
        ).otherwise(0.0).alias("sharpe"),
    )
