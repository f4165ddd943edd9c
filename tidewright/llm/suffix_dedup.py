"""Suffix-array dedup of repeated byte strings across documents.

A byte goes if a `length`-byte string that covers it also starts in a document with a
smaller doc_id. Exact, in these steps:

1. Equal texts are one class; every later copy goes whole, only the first takes part.
2. Suffixes are taken at anchors: in each window of `length` bytes the place of the
   `gram`-byte string with the smallest hash (leftmost among equals), so equal windows have
   equal anchors at equal places. Neighbouring windows share one; there is one for about 18
   bytes.
3. Splitters. A bounded sample of texts (`sample_bytes`) gives the leading bytes of its
   suffixes; their quantiles are the splitters that range-partition all suffixes by their
   leading `gram` bytes. A leading string that two sampled texts have is known to be shared.
4. Only suffixes whose leading bytes another text has too go on: their packed hashes meet by
   range first (known ones needn't).
5. The texts of those are cut to the bytes that the suffixes' windows need, and each range is
   sorted by multikey quicksort: three-way partition by characters of eight bytes, where the
   middle part goes on with the next character. Suffixes that tie to the end are equal
   windows. A window that also starts in a smaller document marks its bytes.
6. Boundaries. Equal leading strings lie in one range, but for those that the sample shows to
   be more than `hot_rows`: these are dealt over several ranges. Each such range says for
   every window which document is its smallest; windows are compared across the ranges, and a
   range's smallest that isn't the smallest of all is marked as well.

Nulls are empty texts. A row with a null doc_id is compared with nothing and kept; rows
that share a doc_id count as one document for the comparison. Texts shorter than `length`
never lose a byte. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._arrays import U
from ._shared import discard, materialize

#: Text bytes whose anchors are found at once; small, as about fifteen arrays of eight bytes a text byte live meanwhile.
PIECE = 1 << 17
#: Text bytes whose packed suffixes a mapper holds before it sends them.
HELD = 3 << 20
#: Neighbouring ranges that share a task while only hashes are compared.
UNITED = 3
#: Windows that a reducer expands at once.
BLOCK = 200_000
#: Ranges of fewer suffixes are sorted together instead of being parted further.
LEAF = 1 << 15


def _anchors(data, off, length: int, gram: int):
    """Of each run of windows with one anchor: row, anchor position, first and last window start, hash of the anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(U)
    running = A.prefix_hash(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    value = A.span_hash(running, at, at + gram)
    span, best, size, width = length - gram + 1, at.copy(), 1, value.copy()

    def join(width, best, shift):
        later = width[shift:] < width[: len(width) - shift]
        return np.where(later, width[shift:], width[: len(width) - shift]), np.where(
            later, best[shift:], best[: len(best) - shift]
        )

    while 2 * size <= span:
        width, best = join(width, best, size)
        size *= 2
    if size < span:
        width, best = join(width, best, span - size)
    # windows that lie in one row
    inside = np.zeros(len(data) + 1, np.int32)
    starts, ends = off[:-1], off[1:] - length + 1
    long = ends > starts
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long], -1)
    window = np.flatnonzero(np.cumsum(inside)[: len(best)] > 0)
    if not len(window):
        return none, none, none, none, none.astype(U)
    anchor = best[window]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1))
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(window) - 1]))
    lo, hi, anchor = window[first], window[last], anchor[first]
    return np.searchsorted(off, lo, "right") - 1, anchor, lo, hi, value[anchor]


class Ranges:
    """Where suffixes go: sampled splitters over leading bytes, ranges of their own for hot ones, and what is known to be shared."""

    def __init__(self, sample: list[bytes], gram: int, parts: int, share: float, hot_rows: int):
        """sample: for each text its leading strings, concatenated; share: the sampled part of the corpus."""
        kind = f"S{gram}"
        texts = [np.frombuffer(x, kind) for x in sample if x]
        lead, often = np.unique(np.concatenate(texts), return_counts=True) if texts else (
            np.zeros(0, kind), np.zeros(0, int)
        )
        seen = np.unique(np.concatenate([np.unique(x) for x in texts]), return_counts=True)[1] if texts else often
        reach = np.cumsum(often)
        cut = np.searchsorted(reach, reach[-1] * np.arange(1, parts) / parts) if len(lead) else np.zeros(0, int)
        self.splitters = np.unique(lead[cut])
        self.first = _leading(self.splitters, gram)
        self.gram, self.parts = gram, parts
        self.shared = _gram_hash(lead[seen > 1], gram)
        self.shared.sort()
        hot = np.flatnonzero(often / share > hot_rows)
        self.hot, self.ways = _gram_hash(lead[hot], gram), np.ceil(often[hot] / share / hot_rows).astype(np.int64)
        order = np.argsort(self.hot)
        self.hot, self.ways = self.hot[order], self.ways[order]
        self.base = parts + np.cumsum(self.ways) - self.ways

    def of(self, data: np.ndarray, anchor: np.ndarray, f: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The range of each suffix: data from anchor on, f the hash of its leading bytes."""
        first = np.zeros(len(anchor), U)
        for k in range(8):
            first = (first << U(8)) | data[anchor + k]
        low, high = np.searchsorted(self.first, first, "left"), np.searchsorted(self.first, first, "right")
        tie = np.flatnonzero(low != high)
        if len(tie):
            whole = np.ascontiguousarray(
                data[anchor[tie][:, None] + np.arange(self.gram)]
            ).view(f"S{self.gram}").ravel()
            low[tie] = np.searchsorted(self.splitters, whole, "right")
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, f), len(self.hot) - 1)
            here = np.flatnonzero(self.hot[at] == f)
            low[here] = self.base[at[here]] + (
                A.mix(doc[here].view(U)) % self.ways[at[here]].astype(U)
            ).astype(np.int64)
        return low

    def known(self, f: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.zeros(len(f), bool)
        return self.shared[np.minimum(np.searchsorted(self.shared, f), len(self.shared) - 1)] == f


def _leading(strings: np.ndarray, gram: int) -> np.ndarray:
    """The first eight bytes of fixed strings, as numbers in the order of the strings."""
    return np.ascontiguousarray(
        strings.view(np.uint8).reshape(-1, gram)[:, :8]
    ).view(">u8").ravel().astype(U) if len(strings) else np.zeros(0, U)


def _gram_hash(strings: np.ndarray, gram: int) -> np.ndarray:
    flat = strings.view(np.uint8) if len(strings) else np.zeros(0, np.uint8)
    at = np.arange(len(strings)) * gram
    return A.span_hash(A.prefix_hash(flat), at, at + gram)


def sampled_ranges(
    docs: DataFrame, total: int, parts: int, length: int, gram: int, sample_bytes: int, hot_rows: int
) -> Ranges:
    """Ranges from the texts with the smallest hashes, about sample_bytes of them."""
    share = min(1.0, sample_bytes / max(total, 1))
    some = docs.where(
        (F.pmod("key", F.lit(1 << 20)) < int(share * (1 << 20)) + 1) & (F.octet_length("text") >= length)
    ).select("key", "text").dropDuplicates(["key"])

    def work(batches):
        for b in batches:
            for _, _, data, off in A.chunks(b.column("text"), PIECE):
                row, anchor, _, _, _ = _anchors(data, off, length, gram)
                edges = np.searchsorted(row, np.arange(len(off)))
                lead = np.ascontiguousarray(
                    data[anchor[:, None] + np.arange(gram)]
                ).view(f"S{gram}").ravel() if len(anchor) else np.zeros(0, f"S{gram}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lead[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary())],
                    ["leads"],
                )

    return Ranges(
        [bytes(r["leads"]) for r in some.mapInArrow(work, "leads binary").collect()], gram, parts, share, hot_rows
    )


def _cut_by(part: np.ndarray):
    order = np.argsort(part, kind="stable")
    ordered = part[order]
    start = np.flatnonzero(
        np.concatenate(([True], ordered[1:] != ordered[:-1]))
    ) if len(part) else np.zeros(0, np.int64)
    return order, zip(
        ordered[start].tolist(), start.tolist(), [*start[1:].tolist(), len(part)][: len(start)], strict=True
    )


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length, one after another."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _suffixes(docs: DataFrame, ranges, length: int, gram: int) -> DataFrame:
    """Packed by range: six bytes of each suffix's hashed leading bytes and the key of its text; known ones are left out."""

    def work(batches):
        held, size = [], 0

        def flush():
            f, key, part = (np.concatenate(x) for x in zip(*held, strict=True))
            order, cuts = _cut_by(part // UNITED)
            rows = {"part": [], "f": [], "at": [], "keys": []}
            for p, s, e in cuts:
                mine = order[s:e]
                used, local = np.unique(key[mine], return_inverse=True)
                rows["part"].append(p)
                rows["f"].append((f[mine] >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                rows["at"].append(local.astype("<u4" if len(used) > 65535 else "<u2").tobytes())
                rows["keys"].append(used.astype("<i8").tobytes())
            return pa.RecordBatch.from_pydict(
                rows,
                schema=pa.schema(
                    [("part", pa.int32()), ("f", pa.binary()), ("at", pa.binary()), ("keys", pa.binary())]
                ),
            )

        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False)
            for i, j, data, off in A.chunks(b.column("text"), PIECE):
                row, anchor, _, _, f = _anchors(data, off, length, gram)
                new = np.flatnonzero(~ranges.value.known(f))
                row, anchor, f = row[new], anchor[new], f[new]
                key = keys[i:j][row]
                held.append((f, key, ranges.value.of(data, anchor, f, key)))
                size += len(data)
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
            held.clear()
        A.release()

    return docs.select("key", "text").mapInArrow(work, "part int, f binary, at binary, keys binary")


def _shared_anchors(runs: DataFrame, back: int) -> DataFrame:
    """(key, f): packed hashes of leading strings of a text that another text has too, sent back by text in `back` parts."""

    def find(table):
        fs, keys = [], []
        for f, at, own in zip(table.column("f"), table.column("at"), table.column("keys"), strict=True):
            raw = np.frombuffer(f.as_buffer(), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            own = np.frombuffer(own.as_buffer(), "<i8")
            at = np.frombuffer(at.as_buffer(), "<u4" if len(own) > 65535 else "<u2")
            fs.append(wide.view("<u8")[:, 0])
            keys.append(own[at])
        f, key = np.concatenate(fs), np.concatenate(keys)
        order = np.argsort(f)
        f, key = f[order], key[order]
        start = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
        many = np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start)
        keep = np.repeat(many, np.diff(np.append(start, len(f))))
        f, key = f[keep], key[keep]
        order, cuts = _cut_by((A.mix(key.view(U)) % U(back)).astype(np.int64))
        out = {"part": [], "keys": [], "f": []}
        for p, s, e in cuts:
            out["part"].append(p)
            out["keys"].append(key[order[s:e]].tobytes())
            out["f"].append(f[order[s:e]].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        return pa.table(out, schema=pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("f", pa.binary())]))

    def gather(table):
        key = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("keys")])
        raw = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("f")]).reshape(-1, 6)
        f = np.zeros((len(raw), 8), np.uint8)
        f[:, :6] = raw
        f = f.view("<u8")[:, 0]
        order = np.lexsort((f, key))
        f, key = f[order], key[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        ends = np.append(start[1:], len(key))[: len(start)]
        return pa.table(
            {
                "key": pa.array(key[start], pa.int64()),
                "f": pa.array([np.unique(f[s:e]).tobytes() for s, e in zip(start, ends, strict=True)], pa.binary()),
            }
        )

    shared = runs.groupBy("part").applyInArrow(A.trimmed(find), "part int, keys binary, f binary")
    return shared.groupBy("part").applyInArrow(A.trimmed(gather), "key long, f binary")


def _cuts(texts: DataFrame, ranges, length: int, gram: int) -> DataFrame:
    """Packed by range, for suffixes that another text has: hash of the leading bytes, doc_id, first window start and the bytes that the windows need."""
    fields = ("f", "doc", "lo", "size", "data")

    def work(batches):
        held, size = [], 0

        def flush():
            part, f, doc, lo, width, data = (np.concatenate(x) for x in zip(*held, strict=True))
            begin = np.cumsum(width) - width
            order, cuts = _cut_by(part)
            out = {c: [] for c in ("part", *fields)}
            for p, s, e in cuts:
                mine = order[s:e]
                out["part"].append(p)
                for c, x in zip(
                    fields[:4], (f.astype("<u8"), doc.astype("<i8"), lo.astype("<i8"), width.astype("<i4")), strict=True
                ):
                    out[c].append(x[mine].tobytes())
                out["data"].append(data[np.repeat(begin[mine], width[mine]) + _ranges(width[mine])].tobytes())
            return pa.RecordBatch.from_pydict(
                out, schema=pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in fields]])
            )

        for b in batches:
            ids, flags = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("fs")
            for i, j, data, off in A.chunks(b.column("text"), PIECE):
                row, anchor, lo, hi, f = _anchors(data, off, length, gram)
                short = f >> U(16)
                keep = ranges.value.known(f)
                edges = np.searchsorted(row, np.arange(j - i + 1))
                for x in np.flatnonzero(np.diff(edges)):
                    want = np.frombuffer(b"".join(flags[i + int(x)].as_py() or ()), "<u8")
                    if len(want):
                        keep[edges[x] : edges[x + 1]] |= np.isin(short[edges[x] : edges[x + 1]], want)
                row, anchor, lo, hi, f = row[keep], anchor[keep], lo[keep], hi[keep], f[keep]
                if not len(f):
                    continue
                doc, width = ids[i:j][row].astype(np.int64), hi - lo + length
                held.append(
                    (
                        ranges.value.of(data, anchor, f, doc),
                        f,
                        doc,
                        lo - off[row],
                        width,
                        data[np.repeat(lo, width) + _ranges(width)],
                    )
                )
                size += int(width.sum()) + 28 * len(f)
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
            held.clear()
        A.release()

    return texts.mapInArrow(work, "part int, f binary, doc binary, lo binary, size binary, data binary")


def _characters(data: np.ndarray, at: np.ndarray, byte: int, length: int) -> np.ndarray:
    """The character of eight bytes (fewer at the end) that each suffix has at this depth."""
    char = np.zeros(len(at), U)
    for x in range(byte, min(byte + 8, length)):
        char = (char << U(8)) | data[at + x]
    return char


def multikey_groups(data: np.ndarray, at: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Group number of each suffix data[at : at + length], equal for equal suffixes with equal `first`; -1 for suffixes alone.

    Multikey quicksort: a range is parted by one of its characters into less, equal and
    greater; the equal part goes on with the next character. Ranges below LEAF are sorted
    together, character by character, and only where suffixes still tie.
    """
    out = np.full(len(at), -1, np.int64)
    stack, numbers = [(np.arange(len(at)), -8)], 0
    while stack:
        order, byte = stack.pop()
        if len(order) < 2:
            continue
        if byte >= length:
            out[order] = numbers
            numbers += 1
            continue
        if len(order) <= LEAF:
            numbers = _leaf(data, at, first, length, order, byte, out, numbers)
            continue
        char = first[order] if byte < 0 else _characters(data, at[order], byte, length)
        pivot = np.sort(char[:: max(1, len(char) // 9)])[4]
        same = char == pivot
        stack.append((order[same], byte + 8))
        for part in (char < pivot, char > pivot):
            stack.append((order[part], byte))
    return out


def _leaf(data, at, first, length: int, order, byte: int, out, numbers: int) -> int:
    label = np.zeros(len(order), np.int64)
    while len(order) and byte < length:
        char = first[order] if byte < 0 else _characters(data, at[order], byte, length)
        by = np.lexsort((char, label))
        order, label = order[by], _numbers(label[by], char[by])
        tied = np.bincount(label)[label] > 1
        order, label, byte = order[tied], label[tied], byte + 8
    if len(order):
        label = _numbers(label)
        out[order] = numbers + label
        numbers += int(label[-1]) + 1
    return numbers


def _numbers(*sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... for the runs of equal keys."""
    new = np.zeros(len(sorted_keys[0]), bool)
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _pieces(size: np.ndarray, most: int = PIECE * 4):
    """Bounds of runs of cuts that have about `most` bytes together."""
    reach, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _entries(f, doc, size, begin, data):
    """Number of each cut, equal for equal leading bytes and equal bytes; the order that puts a number's smallest document first; where each number starts."""
    whole = A.mix(f)
    for i, j in _pieces(size):
        at = begin[i:j] - begin[i]
        whole[i:j] ^= A.span_hash(A.prefix_hash(data[begin[i] : begin[j - 1] + size[j - 1]]), at, at + size[i:j])
    order = np.lexsort((doc, whole))
    lead = np.concatenate(([True], whole[order][1:] != whole[order][:-1]))
    # equal hashes are compared byte by byte with the first of their number; one that differs is a number of its own
    head = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    later = np.flatnonzero(~lead)
    wrong = later[(size[order[later]] != size[head[later]]) | (f[order[later]] != f[head[later]])]
    later = np.setdiff1d(later, wrong, assume_unique=True)
    for s in range(0, len(later), 20_000):
        part = later[s : s + 20_000]
        width = size[order[part]]
        step = _ranges(width)
        same = data[np.repeat(begin[order[part]], width) + step] == data[np.repeat(begin[head[part]], width) + step]
        bad = np.add.reduceat(~same, np.cumsum(width) - width) > 0
        wrong = np.concatenate((wrong, part[bad]))
    entry = np.empty(len(f), np.int64)
    number = np.cumsum(lead) - 1
    if len(wrong):
        right = np.setdiff1d(np.arange(len(order)), wrong, assume_unique=True)
        number[wrong] = number[-1] + 1 + np.arange(len(wrong))
        order, number = np.concatenate((order[right], order[wrong])), np.concatenate((number[right], number[wrong]))
        lead = np.concatenate(([True], number[1:] != number[:-1]))
    entry[order] = number
    return entry, order[lead]


def _block_marks(f, doc, lo, size, begin, data, length: int, edges: list | None):
    """(doc, start, end) of the runs of windows that also start in a smaller document, for whole groups of leading bytes.

    edges gets (doc, start, two hashes) of the windows of each window's smallest document; cuts stand in data one after another.
    """
    entry, head = _entries(f, doc, size, begin, data)
    least, anchor, windows = doc[head], f[head], size[head] - length + 1
    # only leading bytes with several entries need their suffixes sorted
    by = np.argsort(anchor, kind="stable")
    label = _numbers(anchor[by])
    many = np.zeros(len(head), bool)
    many[by] = np.bincount(label)[label] > 1
    first = np.cumsum(windows) - windows
    smallest = np.repeat(least, windows)
    chosen = np.flatnonzero(many)
    if len(chosen):
        w = windows[chosen]
        step = _ranges(w)
        slot = np.repeat(first[chosen], w) + step
        group = multikey_groups(data, np.repeat(begin[head[chosen]], w) + step, np.repeat(anchor[chosen], w), length)
        slot, group = slot[group >= 0], group[group >= 0]
        if len(group):
            by = np.argsort(group, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], group[by][1:] != group[by][:-1])))
            low = np.minimum.reduceat(smallest[slot[by]], start)
            smallest[slot[by]] = np.repeat(low, np.diff(np.append(start, len(by))))
    # each member against the smallest document of each of its windows, block by block
    out = [(np.zeros(0, np.int64),) * 3]
    reach = np.cumsum(windows[entry])
    i = 0
    while i < len(doc):
        j = max(i + 1, int(np.searchsorted(reach, (reach[i - 1] if i else 0) + BLOCK, "right")))
        e, w = entry[i:j], windows[entry[i:j]]
        step = _ranges(w)
        low, own = smallest[np.repeat(first[e], w) + step], np.repeat(doc[i:j], w)
        hit = low < own
        opens = step == 0
        before = np.concatenate(([False], hit[:-1])) & ~opens
        after = np.concatenate((hit[1:] & ~opens[1:], [False]))
        starts, ends = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
        member = i + np.repeat(np.arange(j - i), w)[starts]
        out.append((doc[member], lo[member] + step[starts], lo[member] + step[ends] + length))
        if edges is not None:
            k = np.flatnonzero(low == own)
            member = i + np.repeat(np.arange(j - i), w)[k]
            at = begin[member] + step[k] - begin[i]
            own = data[begin[i] : begin[j - 1] + size[j - 1]]
            edges.append(
                (
                    doc[member],
                    lo[member] + step[k],
                    *[A.span_hash(A.prefix_hash(own, v), at, at + length) for v in (None, _OTHER)],
                )
            )
        i = j
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: A second value for each byte, for a second hash.
_OTHER = A.mix(np.arange(256).astype(U) + U(0x51ED27))


def _packed_marks(who, s, e, back: int) -> dict:
    """Marks (doc, start, end) as rows of packed numbers, sent back by document in `back` parts."""
    order, cuts = _cut_by((A.mix(who.view(U)) % U(back)).astype(np.int64))
    rows = np.stack((who, s, e), axis=1).astype("<i8")[order]
    out = {"part": [], "marks": []}
    for p, x, y in cuts:
        out["part"].append(p)
        out["marks"].append(rows[x:y].tobytes())
    return out


def _runs_of(marks: DataFrame) -> DataFrame:
    """(doc_id, runs): the union of each document's marks as packed (start, end) runs."""

    def gather(table):
        rows = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("marks")]).reshape(-1, 3)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        who = rows[:, 0]
        start = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, np.int64)
        stop = np.append(start[1:], len(who))[: len(start)]
        return pa.table(
            {
                "doc_id": pa.array(who[start], pa.int64()),
                "runs": pa.array(
                    [_merge_runs(rows[x:y, 1:]).tobytes() for x, y in zip(start, stop, strict=True)], pa.binary()
                ),
            }
        )

    return marks.groupBy("part").applyInArrow(A.trimmed(gather), "doc_id long, runs binary")


def _marks(cuts: DataFrame, parts: int, length: int, back: int) -> DataFrame:
    """(part, marks): packed byte runs that repeat a smaller document, by document; and (part, edges) of dealt ranges."""
    edge_parts = 64

    def sort(table):
        def column(name, kind):
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])

        f, doc, lo, size, data = column(
            "f", "<u8"
        ), column("doc", "<i8"), column("lo", "<i8"), column("size", "<i4").astype(np.int64), column("data", np.uint8)
        edges = [] if table.column("part")[0].as_py() >= parts else None
        begin = np.cumsum(size) - size
        del table
        # leading bytes are taken in groups whose windows fit a bounded block
        blocks = int((size - length + 1).sum() // BLOCK) + 1
        block = (A.mix(f) % U(blocks)).astype(np.int64)
        found = []
        for x in range(blocks):
            m = np.flatnonzero(block == x)
            if len(m):
                own = data[np.repeat(begin[m], size[m]) + _ranges(size[m])]
                found.append(
                    _block_marks(f[m], doc[m], lo[m], size[m], np.cumsum(size[m]) - size[m], own, length, edges)
                )
        out = _packed_marks(*(np.concatenate(x) for x in zip(*found, strict=True)), back)
        n = len(out["part"])
        part, packed = [], []
        if edges:
            rows = np.stack(
                [
                    np.concatenate(
                        x
                    ).astype(U) if k > 1 else np.concatenate(x).view(U) for k, x in enumerate(zip(*edges, strict=True))
                ],
                axis=1,
            )
            order, cut = _cut_by((rows[:, 2] % U(edge_parts)).astype(np.int64))
            for p, s, e in cut:
                part.append(p)
                packed.append(rows[order[s:e]].astype("<u8").tobytes())
        none = pa.nulls
        return pa.table(
            {
                "part": pa.array(out["part"] + part, pa.int32()),
                "marks": pa.concat_arrays([pa.array(out["marks"], pa.binary()), none(len(part), pa.binary())]),
                "edges": pa.concat_arrays([none(n, pa.binary()), pa.array(packed, pa.binary())]),
            }
        )

    return cuts.groupBy("part").applyInArrow(A.trimmed(sort), "part int, marks binary, edges binary")


def _across(edges: DataFrame, length: int, back: int) -> DataFrame:
    """(part, marks) of windows whose smallest document in their own range isn't the smallest of all ranges."""

    def meet(table):
        rows = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table.column("edges")]).reshape(-1, 4)
        doc, start, h1, h2 = rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2], rows[:, 3]
        by = np.lexsort((doc, h2, h1))
        doc, start = doc[by], start[by]
        label = _numbers(h1[by], h2[by])
        opens = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
        late = doc > doc[opens][label]
        return pa.table(
            _packed_marks(doc[late], start[late], start[late] + length, back),
            schema=pa.schema([("part", pa.int32()), ("marks", pa.binary())]),
        )

    return edges.groupBy("part").applyInArrow(A.trimmed(meet), "part int, marks binary")


def _merge_runs(runs: np.ndarray) -> np.ndarray:
    """Union of (start, end) runs; touching runs are one."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate(([True], runs[1:, 0] > reach[:-1]))
    return np.stack((runs[new, 0], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])), axis=1)


def repeated_spans(
    docs: DataFrame,
    length: int = 50,
    gram: int = 16,
    part_bytes: int = 6 << 20,
    sample_bytes: int = 4 << 20,
    hot_rows: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """(texts with doc_id, text, copy) and (doc_id, runs: packed byte runs to remove)."""
    if gram < 8 or length < gram:
        raise ValueError("gram must be at least 8 bytes and length at least gram")
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    key, check, size = F.xxhash64(
        "text"
    ).alias("key"), F.xxhash64("text", F.lit(1)).alias("check"), F.octet_length("text").cast("long").alias("n_bytes")
    named = docs.where("doc_id is not null")
    firsts = materialize(
        named.select("doc_id", key, check, size).groupBy("key", "check", "n_bytes").agg(
            F.min("doc_id").alias("doc_id")
        ),
        "firsts",
    )
    total = firsts.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(4, -(-total // part_bytes))
    keyed = named.select(key, "text").where(F.octet_length("text") >= length)
    found = sampled_ranges(keyed, total, parts, length, gram, sample_bytes, hot_rows)
    ranges = docs.sparkSession.sparkContext.broadcast(found)
    flags = _shared_anchors(_suffixes(keyed, ranges, length, gram), -(-parts // UNITED)).join(
        firsts.select("key", "doc_id"), "key"
    )
    flags = materialize(flags.groupBy("doc_id").agg(F.collect_list("f").alias("fs")), "flags")
    # without known strings only flagged texts can have a match; with them every first copy is read again
    first_ids = firsts.where(F.col("n_bytes") >= length).select("doc_id").distinct()
    wanted = first_ids.join(flags, "doc_id", "left" if len(found.shared) else "inner")
    texts = docs.join(wanted, "doc_id").select("doc_id", "text", "fs")
    back = -(-parts // UNITED)
    found_marks = materialize(_marks(_cuts(texts, ranges, length, gram), found.parts, length, back), "rangemarks")
    discard(flags)
    marks = found_marks.where("marks is not null").select("part", "marks")
    if len(found.hot):
        marks = marks.unionByName(_across(found_marks.where("edges is not null").select("part", "edges"), length, back))
    runs = materialize(_runs_of(marks), "marks")
    discard(found_marks)
    copies = docs.select("doc_id", key, check, size).where("doc_id is not null").join(
        firsts.withColumnRenamed("doc_id", "first"), ["key", "check", "n_bytes"]
    ).where(f"doc_id <> first and n_bytes >= {length}").select("doc_id", F.lit(True).alias("copy"))
    return docs.join(copies.distinct(), "doc_id", "left"), runs


def remove_repeats(docs: DataFrame, texts: bool = True, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `texts` the bytes left (kept); options as of repeated_spans."""
    rows, marks = repeated_spans(docs, **options)
    joined = rows.join(marks, "doc_id", "left")

    def work(batches):
        for b in batches:
            out = {
                "doc_id": b.column("doc_id").to_pylist(),
                "n_bytes": [],
                "n_removed": [],
                "n_spans": [],
                "kept_sha256": [],
                "kept": [],
            }
            for text, copy, runs in zip(b.column("text"), b.column("copy"), b.column("runs"), strict=True):
                raw = text.as_buffer()
                n = raw.size
                out["n_bytes"].append(n)
                if copy.as_py():
                    kept, gone, spans = b"", n, 1
                elif runs.is_valid:
                    merged = np.frombuffer(runs.as_buffer(), "<i8").reshape(-1, 2)
                    edges = [0, *merged.ravel().tolist(), n]
                    view = memoryview(raw)
                    kept = b"".join(bytes(view[edges[x] : edges[x + 1]]) for x in range(0, len(edges), 2))
                    gone, spans = n - len(kept), len(merged)
                else:
                    kept, gone, spans = raw, 0, 0
                out["n_removed"].append(gone)
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(bytes(kept) if texts else None)
            yield pa.RecordBatch.from_pydict(
                out,
                schema=pa.schema(
                    [
                        ("doc_id", pa.int64()),
                        ("n_bytes", pa.int64()),
                        ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()),
                        ("kept", pa.binary()),
                    ]
                ),
            )

    out = joined.select("doc_id", "text", "copy", "runs").mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return out if texts else out.drop("kept")
