"""Quality classifier: Bradley-Terry pairwise ranking over text features.

Scores are learned from preference pairs (a document labelled good beats one labelled
bad): the logistic loss of the difference of their scores is minimised over a linear
function of the feature difference. A quantile of the training scores, the one that
separates the labels best, becomes the threshold and maps to 0.5.

Features are ratios over the whole text (signs, capitals, repeated words, repeated lines,
word lengths ...) and the shares of its words and pairs of bytes in hashed buckets; labels,
language, source and doc_id are no inputs.
The model is fitted on at most `most_rows` labelled rows, a documented bound (the rows
with the smallest hash of doc_id); every document is scored. Null and empty texts get
the features of an empty text. Labels that are null or for absent documents are ignored;
with labels of one kind only, every score is 0.5. Extra columns are kept or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A

_SPACE = A.byte_class((0x20, 0x20), (0x09, 0x0D))
_UPPER = A.byte_class((65, 90))
_ALPHA = A.byte_class((65, 90), (97, 122), (0x80, 0xFF))
_DIGIT = A.byte_class((48, 57))
_STOP = A.byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
_BANG = A.byte_class((0x21, 0x21))
_BAR = A.byte_class((0x7C, 0x7C))
_SIGN = A.byte_class((33, 47), (58, 64), (91, 96), (123, 126))
_LINE = ~A.byte_class((0x0A, 0x0A))
_PAIRS = np.arange(1 << 16, dtype=np.uint64)
#: Pairs whose differences are held at once while fitting.
PAIRS_AT_ONCE = 4096
#: Buckets of hashed words and of hashed pairs of bytes.
HASHED = 32
FEATURES = (
    "upper",
    "signs",
    "bang",
    "bar",
    "digit",
    "stop",
    "alpha",
    "length",
    "word length",
    "new words",
    "echo",
    "new lines",
    "line length",
    "empty",
    *(f"word {k}" for k in range(HASHED)),
    *(f"pair {k}" for k in range(HASHED)),
)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)

    def share(table):
        run = np.concatenate(([0], np.cumsum(table[data])))
        return (run[off[1:]] - run[off[:-1]]) / size

    low = A.LOWER[data]
    running = A.prefix_hash(low)

    def runs(table):
        start, end, row = A.words(low, off, table)
        count = np.bincount(row, minlength=n)
        h = A.span_hash(running, start, end)
        key = (
            np.unique((row.astype(np.uint64) << np.uint64(42)) | (h >> np.uint64(22))) >> np.uint64(42)
        ).astype(np.int64)
        fresh = np.bincount(key, minlength=n) / np.maximum(count, 1)
        length = np.bincount(row, weights=end - start, minlength=n) / np.maximum(count, 1)
        same = row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])]
        return count, fresh, length, np.bincount(same, minlength=n) / np.maximum(count, 1), (row, h)

    count, fresh, length, echo, (row, h) = runs(~_SPACE)
    lines, new_lines, line_length, _, _ = runs(_LINE)
    words = np.bincount(
        row * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED
    ).reshape(n, HASHED)
    pair = (
        A.mix(_PAIRS)[low[:-1].astype(np.int64) << 8 | low[1:]] % np.uint64(HASHED)
    ).astype(np.int64) if len(low) > 1 else np.zeros(0, np.int64)
    inside = np.repeat(np.arange(n), np.diff(off))
    whole = inside[1:] == inside[:-1]
    pairs = np.bincount(inside[:-1][whole] * HASHED + pair[whole], minlength=n * HASHED).reshape(n, HASHED)
    root = np.sqrt
    # vocabulary grows as a power below one of the length; the ratio to it doesn't depend on length
    expected = np.maximum(count, 1) ** -0.2
    cols = [root(share(t)) for t in (_UPPER, _SIGN, _BANG, _BAR, _DIGIT)] + [
        share(_STOP),
        share(_ALPHA),
        np.log1p(count),
        np.minimum(length, 20),
        np.minimum(fresh / expected, 1.5),
        root(echo),
        root(1 - np.where(lines > 0, new_lines, 1)),
        np.log1p(line_length),
        (count == 0).astype(float),
    ]
    hashed = [root(words / np.maximum(count, 1)[:, None]), root(pairs / size[:, None])]
    return np.concatenate((np.stack(cols, axis=1), *hashed), axis=1)


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: score = sigmoid(scale * (weights . z - threshold)), z standardised features and their squares."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return _expand((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.rank(x) - self.threshold, -30, 30)))


def _expand(z: np.ndarray) -> np.ndarray:
    """Standardised features, and the squares of those that aren't hashed."""
    z = np.clip(z, -6, 6)
    own = z[:, : -2 * HASHED]
    return np.concatenate((z, np.minimum(own * own, 9)), axis=1)


def fit_ranking(x: np.ndarray, good: np.ndarray, pairs_each: int = 8, penalty: float = 1e-2, seed: int = 7) -> Ranking:
    """Bradley-Terry fit by Newton steps on the logistic loss of feature differences."""
    d = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
    mean, spread = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(d), np.ones(d))
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    w = np.zeros(_expand(np.zeros((1, d))).shape[1])
    if not len(up) or not len(down):
        return Ranking(mean, spread, w, 0.0)
    z = _expand((x - mean) / spread)
    rng = np.random.default_rng(seed)
    m = pairs_each * max(len(up), len(down))
    won, lost = up[rng.permutation(m) % len(up)], down[rng.permutation(m) % len(down)]
    for _ in range(30):
        gradient, curve = penalty * w, penalty * np.eye(len(w))
        for i in range(0, m, PAIRS_AT_ONCE):
            diff = z[won[i : i + PAIRS_AT_ONCE]] - z[lost[i : i + PAIRS_AT_ONCE]]
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            gradient += diff.T @ (p - 1) / m
            curve += (diff * (p * (1 - p))[:, None]).T @ diff / m
        step = np.linalg.solve(curve, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    ranks = z @ w
    order = np.sort(ranks)
    # balanced accuracy at every quantile of the training scores
    cut = np.unique(np.quantile(order, np.linspace(0.002, 0.998, 499)))
    right = [(ranks[up] >= c).mean() + (ranks[down] < c).mean() for c in cut]
    top = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    return Ranking(mean, spread, w, float(cut[top].mean()))


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, learn_from=None) -> Ranking:
    """Fit on the labelled rows of docs for which learn_from (a Column of doc_id) holds; at most most_rows of them."""
    rows = labels.where("doc_id is not null and quality in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    if learn_from is not None:
        rows = rows.where(learn_from)
    rows = rows.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    def measure(batches):
        for b in batches:
            for i, j, data, off in A.chunks(b.column("text")):
                x = features(data, off)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("quality").slice(i, j - i),
                        pa.array([row.tobytes() for row in x], pa.binary()),
                        b.column("doc_id").slice(i, j - i),
                    ],
                    ["quality", "x", "doc_id"],
                )

    got = _typed(docs).join(F.broadcast(rows), "doc_id").select("quality", "text", "doc_id").mapInArrow(
        measure, "quality int, x binary, doc_id long"
    ).toArrow()
    # the pairs drawn don't depend on task order
    order = sorted(range(got.num_rows), key=lambda k: (got["doc_id"][k].as_py(), got["x"][k].as_py()))
    x = np.frombuffer(b"".join(got["x"][k].as_py() for k in order)).reshape(-1, len(FEATURES))
    return fit_ranking(x, np.array([got["quality"][k].as_py() for k in order]))


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """Per row: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            for i, j, data, off in A.chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(shared.value.score(features(data, off)))],
                    ["doc_id", "score"],
                )

    return _typed(docs).mapInArrow(work, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Ranking, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least `least`, all columns untouched; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            texts = b.column("text")
            keep = [shared.value.score(features(data, off)) >= least for _, _, data, off in A.chunks(texts)]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(work, docs.schema)
