"""Mixing sources to target weights by iterative proportional fitting.

The corpus is summed into cells (source, language, topic) of word counts (pieces between blanks). Raking scales
the cells in turn until the token shares of each source, language and topic meet their
targets; then a document of cell c is kept with probability `pi_c = fitted_c / tokens_c`,
scaled so that the largest is 1 (or the expected tokens meet `budget`, if that is less).
Documents are drawn by a hash of doc_id and seed, so a rerun draws the same ones.

Topics are clusters of text shape, learned from the whole corpus: shares of digits, signs,
capitals and blanks, standardised, start as "the share that stands out most" and move to the
nearest centre `moves` times. Only the centres (16 numbers) reach the driver.

Only DataFrame functions run. Cells are one row per combination of three category columns;
each round of raking is three sums by one category each. Every few rounds the cells are written
and measured: raking ends when every margin is within `tolerance` of its target (a share of all
tokens), and raises after `most_rounds`. Up to
100,000 cells are raked by one task, which is quicker than to exchange them; beyond, no step
gathers them in one. Targets are share = observed ** temper, normalised (temper 1
keeps the mix, 0 evens it). Null categories are a category of their own; null and empty texts
have no tokens and follow their cell's probability; a cell without tokens is kept whole; rows
that share a doc_id have one lot; an empty table gives no rows. Columns of any name pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import col, discard, free_names, materialize

MARGINS = ("source", "language", "topic")
# The characters whose shares shape a topic, as a class of a pattern, and the topics' names.
SHAPES = {"digits": "[0-9]", "signs": r"[!-/:-@\[-`{-~]", "capitals": "[A-Z]", "blanks": r"[ \t\n\r]"}
TEMPER = {"source": 0.7, "language": 0.8, "topic": 0.9}
#: Cells are broadcast up to this many rows (about 100 bytes each), else joined by shuffle.
BROADCAST_CELLS = 100_000
#: Rounds of raking between two looks at the distance from the targets.
ROUNDS_EACH = 8


def _blanks(text: Column) -> Column:
    """How many blanks a text has; a chain of plain replacements is several times faster than a pattern."""
    short = text
    for blank in " \t\n\r":
        short = F.replace(short, F.lit(blank), F.lit(""))
    return F.octet_length(text) - F.octet_length(short)


def tokens_of(text: Column) -> Column:
    """Pieces of the whole text between blanks; 0 for null and empty."""
    return F.when(F.octet_length(text) > 0, _blanks(text) + 1).otherwise(0).cast("long")


def shape_of(text: Column) -> list[Column]:
    """Shares of each kind of character."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    found = [
        _blanks(text) if name == "blanks" else n - F.length(
            F.regexp_replace(text, pattern, "")
        ) for name, pattern in SHAPES.items()
    ]
    return [x / F.greatest(n, F.lit(1)) for x in found]


def _standard(shares: list[Column], spread: list[tuple[float, float]]) -> list[Column]:
    return [(x - F.lit(m)) / F.lit(s) if s > 0 else F.lit(0.0) for x, (m, s) in zip(shares, spread, strict=True)]


def _first_best(scores: list[Column]) -> Column:
    """Name of the shape with the largest score; the first of equals."""
    top = F.greatest(*scores)
    out = F.lit(list(SHAPES)[-1])
    for name, x in list(zip(SHAPES, scores, strict=True))[-2::-1]:
        out = F.when(x == top, name).otherwise(out)
    return out


def topic_of(text: Column, centres: dict) -> Column:
    """The topic of a text under learned centres."""
    z = _standard(shape_of(text), centres["spread"])
    return _nearest(z, centres["at"]) if centres["at"] else _first_best(z)


def _nearest(z: list[Column], at: dict[str, list[float]]) -> Column:
    far = [
        -sum(
            (x - F.lit(c)) ** 2 for x, c in zip(z, at[name], strict=True)
        ) if name in at else F.lit(float("-inf")) for name in SHAPES
    ]
    return _first_best(far)


def learn_topics(shapes: DataFrame, moves: int = 2) -> dict:
    """Centres of topics over shapes(s0, s1, s2, s3), one row a document."""
    names = [f"s{k}" for k in range(len(SHAPES))]
    got = shapes.agg(
        *[F.round(f(n), 9).alias(f"{a}{n}") for n in names for a, f in (("m", F.avg), ("d", F.stddev_pop))]
    ).first()
    spread = [(got[f"m{n}"] or 0.0, got[f"d{n}"] or 0.0) for n in names]
    z = _standard([F.col(n) for n in names], spread)
    topic, at = _first_best(z), {}
    for _ in range(moves):
        rows = shapes.groupBy(topic.alias("topic")).agg(
            *[F.round(F.avg(x), 9).alias(f"c{k}") for k, x in enumerate(z)]
        ).collect()
        at = {r["topic"]: [r[f"c{k}"] for k in range(len(z))] for r in rows}
        topic = _nearest(z, at)
    return {"spread": spread, "at": at}


def _category(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit("?"))


def _base(docs: DataFrame) -> DataFrame:
    """(doc_id, source, language, tokens, s0 ... s3) of each row, written: texts are read once for all that follows."""
    text = F.col("text").cast("string")
    shapes = [x.alias(f"s{k}") for k, x in enumerate(shape_of(text))]
    return materialize(
        docs.select(
            "doc_id",
            _category("source").alias("source"),
            _category("lang").alias("language"),
            tokens_of(text).alias("tokens"),
            *shapes,
        ),
        "shapes",
    )


def _topics(centres: dict) -> Column:
    z = _standard([F.col(f"s{k}") for k in range(len(SHAPES))], centres["spread"])
    return _nearest(z, centres["at"]) if centres["at"] else _first_best(z)


def fit_cells(docs: DataFrame, **options) -> tuple[DataFrame, dict]:
    """Cells (source, language, topic, tokens, n_docs, fitted, probability), and the centres of the topics; options as of _fitted."""
    base = _base(docs)
    out = _fitted(base, **options)
    discard(base)
    return out


def _fitted(
    base: DataFrame,
    temper: dict[str, float] | None = None,
    tolerance: float = 1e-9,
    most_rounds: int = 200,
    budget: float | None = None,
) -> tuple[DataFrame, dict]:
    centres = learn_topics(base.select("s0", "s1", "s2", "s3"))
    cells = materialize(
        base.groupBy("source", "language", _topics(centres).alias("topic")).agg(
            F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")
        ),
        "cells",
    )
    cells = rake(cells, TEMPER | (temper or {}), tolerance, most_rounds)
    rate = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens"))
    sums = cells.agg(F.max(rate).alias("top"), F.sum("fitted").alias("all")).first()
    scale = 1.0 / sums["top"] if sums["top"] else 1.0
    if budget is not None and sums["all"]:
        scale = min(scale, budget / sums["all"])
    return cells.withColumn("probability", F.coalesce(F.least(F.lit(1.0), rate * F.lit(scale)), F.lit(1.0))), centres


def rake(cells: DataFrame, temper: dict[str, float], tolerance: float, most_rounds: int) -> DataFrame:
    """cells(source, language, topic, tokens, n_docs) with fitted token weights whose margins meet their targets."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for m in MARGINS:
        part = F.pow(F.sum("tokens").cast("double") / F.lit(total or 1.0), F.lit(temper[m]))
        parts = materialize(cells.groupBy(m).agg(part.alias("part")), f"goal-{m}")
        whole = parts.agg(F.sum("part")).first()[0] or 1.0
        cells = cells.join(parts.select(m, (F.col("part") / F.lit(whole) * F.lit(total)).alias(f"goal_{m}")), m)
    cells = materialize(cells.withColumn("fitted", F.col("tokens").cast("double")), "raked")
    now = {m: F.sum("fitted").over(Window.partitionBy(m)) for m in MARGINS}
    own = [c for c in cells.columns if c != "fitted"]
    few = cells.count() <= BROADCAST_CELLS  # then sums by one category after another need no exchange
    for _ in range(-(-most_rounds // ROUNDS_EACH)):
        cells = cells.coalesce(1) if few else cells
        for m in MARGINS * ROUNDS_EACH:
            scaled = F.when(now[m] > 0, F.col("fitted") * (F.col(f"goal_{m}") / now[m])).otherwise(0.0)
            cells = cells.select(*own, scaled.alias("fitted"))
        cells = materialize(cells, "raked")
        gaps = (cells.coalesce(1) if few else cells).select(
            [F.abs(now[m] - F.col(f"goal_{m}")).alias(m) for m in MARGINS]
        )
        if float(gaps.agg(F.max(F.greatest(*MARGINS))).first()[0] or 0.0) <= tolerance * total:
            return cells.drop(*[f"goal_{m}" for m in MARGINS])
    raise RuntimeError(
        f"raking is still further than {tolerance} from its targets after {most_rounds} rounds; some targets exclude each other"
    )


def lot(key: Column, seed: int) -> Column:
    """Uniform in [0, 1) from 32 bits of a digest of key and seed."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(4294967296.0)


def _broadcast(cells: DataFrame) -> DataFrame:
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def sample_mix(docs: DataFrame, seed: int = 11, **options) -> DataFrame:
    """Per row of docs: doc_id, source, language, topic, tokens, probability, kept."""
    base = _base(docs)
    cells, centres = _fitted(base, **options)
    cells = materialize(cells.select(*MARGINS, "probability"), "mix")
    marked = base.withColumn("topic", _topics(centres)).join(_broadcast(cells), list(MARGINS), "left")
    return marked.select(
        "doc_id", *MARGINS, "tokens", "probability", (lot(F.col("doc_id"), seed) < F.col("probability")).alias("kept")
    )


def keep_sample(docs: DataFrame, seed: int = 11, **options) -> DataFrame:
    """The drawn rows of docs, columns untouched; texts aren't shuffled while the cells are few."""
    cells, centres = fit_cells(docs, **options)
    free = dict(zip((*MARGINS, "probability"), free_names(docs.columns, *MARGINS, "probability"), strict=True))
    cells = materialize(cells.select(*[F.col(m).alias(n) for m, n in free.items()]), "mix")
    marked = docs.withColumns(
        {
            free["source"]: _category("source"),
            free["language"]: _category("lang"),
            free["topic"]: topic_of(F.col("text").cast("string"), centres),
        }
    )
    marked = marked.join(_broadcast(cells), [free[m] for m in MARGINS], "left")
    return marked.where(lot(F.col("doc_id"), seed) < col(free["probability"])).select([col(c) for c in docs.columns])
