"""Line dedup by a segment-partition edit join.

A line goes if an equal or nearly equal line (at most `max_edits` byte edits) stands
earlier, in the order of (doc_id, line number). Lines of fewer than `min_bytes` bytes are
left alone; 0 takes every line, blank ones included. Exact, in these steps:

1. Equal lines are one entry with their first place.
2. A line of l bytes is cut into max_edits + 1 even segments; two lines within the
   threshold share a segment, shifted by few bytes. Segments are indexed by (length,
   number, content); a line probes the indexes of its own and slightly smaller lengths
   at the starts that a multi-match-aware selection leaves. Index entries and probes are
   packed by hash range; each range is sorted, and only meetings whose byte counts can
   be within the threshold become candidate pairs. Lines of at most max_edits bytes have
   too few bytes for segments: they are all within the threshold of each other, and meet
   lines of up to 2 * max_edits bytes by each single byte, as any such pair shares one.
3. Candidates are verified by banded bit-parallel edit distance on the whole lines.
4. A line's earliest near place is the smallest first place among itself and its partners.

A null text has no lines; an empty text has one empty line. Rows with a null doc_id are
kept as they are and are no partners. Rows that share a doc_id share their line numbers.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._arrays import U
from ._shared import col, free_names, materialize

#: Candidate lines are picked on the scan side up to this many keys (8 bytes each), else by a shuffled join.
BROADCAST_KEYS = 1_000_000


def edit_distance_within(a: bytes, b: bytes, most: int) -> bool:
    """Whether a and b are within `most` edits: k-error bit vectors, banded to the diagonals that matter."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i : i + 32] == b[i : i + 32]:
        i += 32
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    n = min(len(a), len(b))
    j = 0
    while j < n and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or not b:
        return max(len(a), len(b)) <= most
    at: dict[int, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | (2 << k)
    state = [(2 << d) - 1 for d in range(most + 1)]
    band = (1 << (2 * most + 1)) - 1
    for k, c in enumerate(b, 1):
        mask, low = at.get(c, 0), k - most
        window = band << low if low >= 0 else band >> -low
        old, before = 0, 0
        for d in range(most + 1):
            now = ((state[d] << 1) & mask) | (old | (old << 1) | (before << 1) if d else 0)
            old, before = state[d], now & window
            state[d] = before
        if not state[most]:
            return False
    return bool(state[most] >> len(a) & 1)


def _lines(data, off, min_bytes: int):
    breaks = np.flatnonzero(data == 0x0A)
    start = np.concatenate((off[:-1], breaks + 1))
    row = np.concatenate((np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1))
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = off[row + 1]
    end[:-1] = np.where(row[1:] == row[:-1], start[1:] - 1, end[:-1])
    long = end - start >= min_bytes
    running = A.prefix_hash(data)
    return start[long], end[long], row[long], running


def _numbers(data, off, start, row):
    """Line number of each line in its row, from 0, blank lines counted."""
    breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
    return breaks[start] - breaks[off[row]]


def _places(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(doc_id, line, bytes, key, check): where each long line stands."""

    def work(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, data, off in A.chunks(b.column("text")):
                start, end, row, running = _lines(data, off, min_bytes)
                key = A.span_hash(running, start, end)
                mirror = np.concatenate(
                    (np.zeros(1, U), np.cumsum(A.mix(data.astype(U) + U(1)) * A._power(0x9FB21C651E98DF25, len(data))))
                )
                check = A.mix(
                    (mirror[end] - mirror[start]) * A._power(pow(0x9FB21C651E98DF25, -1, 1 << 64), len(data) + 1)[start]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i:j][row]),
                        pa.array(_numbers(data, off, start, row)),
                        pa.array(end - start),
                        pa.array(key.view(np.int64)),
                        pa.array(check.view(np.int64)),
                    ],
                    ["doc_id", "line", "bytes", "key", "check"],
                )

    return docs.mapInArrow(work, "doc_id long, line long, bytes long, key long, check long")


def _segments(length: np.ndarray, k: int, pieces: int):
    """Start and length of segment k of lines of these lengths; the last segments take the remainder."""
    base, extra = length // pieces, length % pieces
    plain = pieces - extra
    return k * base + np.maximum(k - plain, 0), base + (k >= plain)


def _entries(data, start, length, running, max_edits: int):
    """(signature, line, probe?) of all index entries and probes of the lines. An entry is its line's probe at the same place too."""
    pieces, sig, who, probe = max_edits + 1, [], [], []

    def add(signature, lines, is_probe):
        sig.append(signature)
        who.append(lines)
        probe.append(np.full(len(lines), is_probe))

    for less in range(pieces):
        mine = np.flatnonzero(length - less >= pieces)
        own, target = length[mine], length[mine] - less
        for k in range(pieces):
            s, n = _segments(target, k, pieces)
            tag = A.mix(target.astype(U) * U(64) + U(k))
            for shift in range(max(-k, less - (max_edits - k)), min(k, less + (max_edits - k)) + 1):
                at = s + shift
                ok = (at >= 0) & (at + n <= own)
                at = start[mine] + at
                add(A.span_hash(running, at[ok], (at + n)[ok]) + tag[ok], mine[ok], bool(less or shift))
    for p in range(2 * max_edits):
        for few in (True, False):
            mine = np.flatnonzero(
                (length > p) & ((length < pieces) if few else (length >= pieces) & (length <= 2 * max_edits))
            )
            add(A.mix(data[start[mine] + p].astype(U) + U(1 << 40)), mine, not few)
    return np.concatenate(sig), np.concatenate(who), np.concatenate(probe)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least possible sum of differences of 16 byte counts, of which two a byte are known modulo 16."""
    total: np.ndarray | int = 0
    for x, y in ((a >> 4, b >> 4), (a & 15, b & 15)):
        d = (x - y) & 15
        total = total + np.minimum(d, 16 - d).sum(-1, dtype=np.uint8)
    return total


def _candidates(docs: DataFrame, max_edits: int, min_bytes: int, parts: int) -> DataFrame:
    """Pairs (a, b) of line keys that share a segment and whose byte counts allow the threshold."""

    def pack(batches):
        for b in batches:
            for _, _, data, off in A.chunks(b.column("text")):
                start, end, _, running = _lines(data, off, min_bytes)
                if not len(start):
                    continue
                key = A.span_hash(running, start, end)
                key, first = np.unique(key, return_index=True)
                start, end = start[first], end[first]
                line = np.repeat(np.arange(len(start)), end - start)
                span = np.arange(int((end - start).sum())) - np.repeat(
                    np.cumsum(end - start) - (end - start), end - start
                )
                value = data[np.repeat(start, end - start) + span]
                counts = np.bincount(
                    line * 16 + ((value * 7 + (value >> 4)) & 15), minlength=16 * len(start)
                ).reshape(-1, 16) & 15
                counts = (counts[:, ::2] << 4 | counts[:, 1::2]).astype(np.uint8)
                sig, who, probe = _entries(data, start, end - start, running, max_edits)
                sig = (sig & ~U(1)) | probe.astype(U)
                part = ((sig >> U(40)) * U(parts) >> U(24)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                out = {"part": [], "sig": [], "each": [], "keys": [], "counts": []}
                for p in np.flatnonzero(np.diff(edges)):
                    mine = order[edges[p] : edges[p + 1]]
                    mine = mine[np.argsort(who[mine], kind="stable")]
                    used, each = np.unique(who[mine], return_counts=True)
                    out["part"].append(int(p))
                    out["sig"].append(sig[mine].astype("<u8").tobytes())
                    out["each"].append(each.astype("<u2").tobytes())
                    out["keys"].append(key[used].astype("<u8").tobytes())
                    out["counts"].append(counts[used].tobytes())
                yield pa.RecordBatch.from_pydict(
                    out,
                    schema=pa.schema(
                        [("part", pa.int32()), *[(c, pa.binary()) for c in ("sig", "each", "keys", "counts")]]
                    ),
                )

    def meet(table):
        sig, key, counts = [], [], []
        for s, each, own, c in zip(
            table.column("sig"), table.column("each"), table.column("keys"), table.column("counts"), strict=True
        ):
            each = np.frombuffer(each.as_buffer(), "<u2")
            at = np.repeat(np.arange(len(each)), each)
            sig.append(np.frombuffer(s.as_buffer(), "<u8"))
            key.append(np.frombuffer(own.as_buffer(), "<u8")[at])
            counts.append(np.frombuffer(c.as_buffer(), np.uint8).reshape(-1, 8)[at])
        sig, key, counts = np.concatenate(sig), np.concatenate(key), np.concatenate(counts)
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
        order, sig, key = order[fresh], sig[fresh], key[fresh]
        kind, whole = sig & U(1), sig >> U(1)
        start = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1])))
        size = np.diff(np.append(start, len(sig)))
        probes = np.add.reduceat(kind.astype(np.int64), start)
        left, right = [], []
        for g in np.flatnonzero((probes < size) & (size > 1)):
            s, n, q = start[g], size[g] - probes[g], size[g]
            one, two = order[s : s + n], order[s : s + q]  # entries sort before probes
            ka, kb = key[s : s + n], key[s : s + q]
            block = max(1, 2_000_000 // n)
            for x in range(0, q, block):
                gap = _gap(counts[one][:, None, :], counts[two[x : x + block]][None, :, :])
                i, j = np.nonzero((gap <= 2 * max_edits) & (ka[:, None] != kb[None, x : x + block]))
                left.append(ka[i])
                right.append(kb[x + j])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            pair = np.unique(
                np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1).view(np.dtype([("a", U), ("b", U)])).ravel()
            )
        else:
            pair = np.zeros(0, np.dtype([("a", U), ("b", U)]))
        return pa.table(
            {
                "a": pa.array(np.ascontiguousarray(pair["a"]).view(np.int64)),
                "b": pa.array(np.ascontiguousarray(pair["b"]).view(np.int64)),
            }
        )

    packed = docs.select("text").mapInArrow(pack, "part int, sig binary, each binary, keys binary, counts binary")
    return packed.groupBy("part").applyInArrow(A.trimmed(meet), "a long, b long").distinct()


def near_lines(docs: DataFrame, max_edits: int, min_bytes: int, parts: int) -> DataFrame:
    """Verified links (a, b) between keys of different lines, but for those between two lines of at most max_edits bytes, which always hold."""
    pairs = materialize(_candidates(docs, max_edits, min_bytes, parts), "linepairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "linekeys")
    few = wanted.count() <= BROADCAST_KEYS
    keys = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column("key").to_numpy())) if few else None

    def read(batches):
        for b in batches:
            for _, _, data, off in A.chunks(b.column("text")):
                start, end, _, running = _lines(data, off, min_bytes)
                key = A.span_hash(running, start, end).view(np.int64)
                key, first = np.unique(key, return_index=True)
                if keys is not None:
                    mine = np.isin(key, keys.value)
                    key, first = key[mine], first[mine]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array([data[start[x] : end[x]].tobytes() for x in first], pa.binary())],
                    ["key", "content"],
                )

    content = docs.select("text").mapInArrow(read, "key long, content binary")
    content = content if few else content.join(wanted, "key", "left_semi")
    content = materialize(content.groupBy("key").agg(F.first("content").alias("content")), "lines")
    wide = pairs.join(content.select(F.col("key").alias("a"), F.col("content").alias("ta")), "a").join(
        content.select(F.col("key").alias("b"), F.col("content").alias("tb")), "b"
    )

    def verify(batches):
        for b in batches:
            near = [
                edit_distance_within(x, y, max_edits) for x, y in zip(
                    b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True
                )
            ]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return wide.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def line_report(
    docs: DataFrame, max_edits: int = 2, min_bytes: int = 60, part_bytes: int = 48 << 20
) -> tuple[DataFrame, DataFrame]:
    """(docs as read, (doc_id, line, bytes) of every line to remove)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id is not null and text is not null")
    places = materialize(_places(named, min_bytes), "places")
    firsts = places.groupBy("key", "check", "bytes").agg(F.min(F.struct("doc_id", "line")).alias("first"))
    firsts = materialize(firsts, "firsts")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    links = materialize(near_lines(named, max_edits, min_bytes, max(4, -(-total // part_bytes))), "nearlines")
    both = links.union(links.select("b", "a"))
    partner = both.join(
        firsts.select(F.col("key").alias("b"), "first"), "b"
    ).groupBy(F.col("a").alias("key")).agg(F.min("first").alias("near"))
    # lines of at most max_edits bytes are all near each other
    tiny = firsts.where(F.col("bytes") <= max_edits).agg(F.min("first").alias("tiny"))
    near = F.least("first", "near", F.when(F.col("bytes") <= max_edits, F.col("tiny")))
    earliest = firsts.join(partner, "key", "left").crossJoin(F.broadcast(tiny)).select(
        "key", "check", "bytes", near.alias("earliest")
    )
    gone = places.join(earliest, ["key", "check", "bytes"]).where(
        F.col("earliest") < F.struct("doc_id", "line")
    ).select("doc_id", "line", "bytes")
    return docs, gone


def line_dedup_counts(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, removed_bytes."""
    docs, gone = line_report(docs, **options)
    per = gone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_removed"), F.sum("bytes").alias("removed_bytes"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(
        F.octet_length("text") - F.octet_length(F.regexp_replace("text", "\n", "")) + 1
    ).cast("long")
    zero = F.lit(0).cast("long")
    return docs.select("doc_id", lines.alias("n_lines")).join(per, "doc_id", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("removed_bytes", zero).alias("removed_bytes"),
    )


def remove_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated lines cut out of the text; other columns untouched."""
    _, lost = line_report(docs, **options)
    key, gone = free_names(docs.columns, "key", "gone")
    marks = lost.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line").alias(gone))
    text = F.col("text").cast("string")
    left = F.filter(F.split(text, "\n", -1), lambda w, i: ~F.array_contains(col(gone), i.cast("long")))
    cut = F.when(col(gone).isNotNull(), F.array_join(left, "\n")).otherwise(text)
    joined = docs.join(marks, F.col("doc_id").cast("long") == col(key), "left")
    return joined.select(*[cut.alias(c) if c == "text" else col(c) for c in docs.columns])
