"""Benchmark decontamination with a broadcast set of normalised test n-grams.

Texts are lower-cased (A-Z only) and cut into words; a benchmark window is `window`
consecutive words (an item of fewer words is one window). Every window of the benchmark
is kept with a hash of its first `probe` words. The corpus is scanned once: the hash of so
many words from each position meets the broadcast hashes, and each meeting names one
training window, which is then compared with the whole n-gram. Only texts with a meeting
are read again. Hit words are the union of all occurrences.

Only DataFrame functions run here. What is broadcast is 24 bytes an n-gram, at most
`broadcast_grams` of them (they are counted first); beyond that the same join shuffles.
Rows are judged by their text (128 bits of its hash), whatever their doc_id: null and
repeated doc_ids are no exception, and equal texts are judged once. Null, empty and wordless
texts have no words and no hits. A null item_id counts in n_items but is left out of the
joined ids. An empty table, of documents or items, gives no hits. Extra columns of any name
are kept by the removing functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import col, free_names, materialize

#: After lower-casing, words are runs of 0-9, a-z and everything beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
EITHER_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Keys of texts are broadcast up to this many (24 bytes each), else the join shuffles.
BROADCAST_KEYS = 1_000_000
#: The key of a text.
KEY = ("h1", "h2")
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def benchmark_windows(benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(item_id, gram, n): every window of every item; gram is its words joined by spaces."""
    words = F.filter(F.split(ascii_lower(F.col("text")), SEPARATORS), lambda w: w != "")
    items = benchmark.where("text is not null").select("item_id", words.alias("words")).where(F.size("words") > 0)
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    cut = F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.array_join(
            F.slice("words", i, F.col("n")), " "
        )
    )
    return items.select("item_id", "n", F.explode(cut).alias("gram"))


def _probes(words: Column, sizes: list[int]) -> Column:
    """For each size in turn, at each word: hash of so many words from there (fewer at the end)."""

    def at_size(m):
        return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, m)]))

    return F.flatten(F.array(*map(at_size, sizes)))


def _keyed(text: Column, names: tuple[str, str] = KEY) -> list[Column]:
    """128 bits of hash that name a text."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(text, F.lit(1)).alias(names[1])]


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def window_hits(texts: DataFrame, windows: DataFrame, broadcast_grams: int = 2_000_000, probe: int = 5) -> DataFrame:
    """(h1, h2, start, n, gram): every occurrence of a window in texts(text); start counts pieces from 1."""
    each = lambda words: F.transform(words, lambda w: F.xxhash64(F.lower(w)))
    anchors = windows.select("gram", "n").distinct().select(
        "gram", "n", F.slice(each(F.split("gram", " ")), 1, probe).alias("words")
    )
    whole = F.xxhash64(*[F.get("words", F.lit(k)) for k in range(probe)])
    grams = materialize(
        anchors.select(
            "gram", F.xxhash64("gram").alias("gram_id"), "n", F.size("words").alias("m"), whole.alias("probe")
        ),
        "anchors",
    )
    sizes = sorted(r["m"] for r in grams.select("m").distinct().collect()) or [1]
    anchors = grams.select("probe", "n", "gram_id").distinct()
    anchors = F.broadcast(anchors) if grams.count() <= broadcast_grams else anchors
    hashed = texts.where("text is not null").select(
        *_keyed(F.col("text")), each(F.split("text", EITHER_CASE)).alias("words")
    )
    # the outer form: the plain one makes the optimizer compute the array once more for a filter
    stream = hashed.select(
        *KEY, F.size("words").alias("pieces"), F.posexplode_outer(_probes(F.col("words"), sizes)).alias("at", "probe")
    )
    met = stream.join(anchors, "probe").select(
        *KEY, (F.pmod("at", "pieces") + 1).alias("start"), "n", "gram_id"
    ).where("start + n - 1 <= pieces")
    met = materialize(met.distinct(), "met")
    again = texts.select(*_keyed(F.col("text")), "text").join(
        _few(met.select(*KEY).distinct()), list(KEY), "left_semi"
    ).dropDuplicates(list(KEY))
    again = again.select(*KEY, F.split(ascii_lower(F.col("text")), SEPARATORS).alias("pieces"))
    same = F.array_join(F.slice("pieces", F.col("start"), F.col("n")), " ") == F.col("gram")
    return met.join(
        grams.select("gram_id", "gram").distinct(), "gram_id"
    ).join(again, list(KEY)).where(same).select(*KEY, "start", "n", "gram").distinct()


def _judged(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """Per text with a hit: h1, h2, hit_words, n_hit, n_items, items_sha256."""
    windows = materialize(benchmark_windows(benchmark, window), "windows")
    hits = materialize(window_hits(docs.select(F.col("text").cast("string").alias("text")), windows), "hits")
    covered = F.array_distinct(
        F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1)))
    )
    words = hits.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("runs")).select(
        *KEY, F.array_sort(covered).alias("hit_words")
    )
    pairs = hits.select(*KEY, "gram").distinct().join(
        windows.select("gram", "item_id").distinct(), "gram"
    ).select(*KEY, "item_id").distinct()
    named = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
    items = pairs.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256")
    )
    return materialize(words.join(items, list(KEY)).withColumn("n_hit", F.size("hit_words").cast("long")), "judged")


def _words_of(text: Column) -> Column:
    """How many of split's pieces are words: only the first and the last can be empty."""
    pieces = F.split(text, EITHER_CASE)
    blank = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) + F.when(
        (F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1
    ).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(F.size(pieces) - blank).cast("long")


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_words (places of the pieces hit)."""
    text = F.col("text").cast("string")
    counts = docs.select("doc_id", _words_of(text).alias("n_words"), *_keyed(text))
    out = counts.join(_judged(docs, benchmark, window), list(KEY), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(EMPTY_SHA256)).alias("items_sha256"), _contaminated(n_hit, F.col("n_words")).alias("contaminated"), "hit_words",
    )


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _marked(docs: DataFrame, judged: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs beside fields of their text's judgement, under free names; texts aren't shuffled while the judged ones are few."""
    free = dict(zip((*KEY, *fields), free_names(docs.columns, *KEY, *fields), strict=True))
    judged = judged.select(*[F.col(k).alias(v) for k, v in free.items()])
    keyed = docs.withColumns(
        dict(zip((f"{free['h1']}_", f"{free['h2']}_"), _keyed(F.col("text").cast("string")), strict=True))
    )
    met = (col(f"{free['h1']}_") == col(free["h1"])) & (col(f"{free['h2']}_") == col(free["h2"]))
    return keyed.join(_few(judged), met, "left"), free


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """docs without the contaminated documents, other rows as they are."""
    hit = _judged(docs, benchmark, window).select(*KEY, "n_hit")
    marked, free = _marked(docs, hit, ("n_hit",))
    n_hit = col(free["n_hit"])
    # words are counted only where something was hit
    bad = F.when(n_hit.isNotNull(), _contaminated(n_hit, _words_of(F.col("text").cast("string")))).otherwise(False)
    return marked.where(~bad).select([col(c) for c in docs.columns])


def remove_hit_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """docs with the hit words cut out of the text; a text with a cut becomes its other words, one space between."""
    marked, free = _marked(docs, _judged(docs, benchmark, window), ("hit_words",))
    gone, text = col(free["hit_words"]), F.col("text").cast("string")
    kept = F.filter(
        F.transform(
            F.split(text, EITHER_CASE), lambda w, i: F.when(~F.array_contains(gone, i + 1), w)
        ), lambda w: w.isNotNull() & (w != "")
    )
    cut = F.when(gone.isNotNull(), F.array_join(kept, " ")).otherwise(text)
    return marked.select(*[cut.alias(c) if c == "text" else col(c) for c in docs.columns])
