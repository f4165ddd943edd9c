"""N-gram Jaccard join by token-combination prefixes.

Every text is the set of its distinct k-word shingles. Two texts link when
`|A & B| / |A | B| >= threshold`. The join is exact:

1. Equal sets are one class, found by digest; only class representatives go on.
2. Token classes. Shingles are counted over the whole corpus into a bitmap of fixed size
   (2**bitmap_bits bits, the bound of what is broadcast): a shingle of few documents is
   *rare*, all others are *frequent*.
3. Prefixes. In the order "rare first, then by hash", a set may lose at most
   `tau = n - ceil(threshold * n)` tokens to a partner. Rare shingles are indexed as single
   tokens, the first tau + 1 of them at most. A set with fewer extends its prefix over the
   frequent ones, which are dealt by hash into partitions, and indexes every pair of tokens
   of a partition (k = 2). Losing a token costs one single token or one token of a
   partition, so the prefix ends when its single tokens and, over all partitions, its tokens
   but one come to tau + 1: then two linked sets share a signature of the shorter prefix.
   Partitions are as many for all sets of a power of two of tokens; the smallest sets of a
   power are indexed with the partitions of the power below too.
4. A bucket is compared with its hub only (its smallest digest), so copies never meet all
   pairs. Members of a bucket that are then in different components are compared in a
   further round.
5. Sketches (a parity bit vector a set) bound how far two sets differ and prune pairs
   without a loss; what is left is verified by intersecting whole sets; components follow.

Words and shingles are compared by 63-bit hashes: two different tokens of two sets agree
once in 10**13 pairs of sets of a thousand tokens.

Nulls, empty texts and texts without words have no set and link with nothing. A text of
fewer words than k is one sequence. Rows that share a doc_id are one node; a null doc_id
gets a null component. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A
from ._arrays import U
from ._components import connected_components
from ._shared import col, discard, free_names, materialize

#: Words are runs of anything but space, tab, LF, VT, FF, CR.
NON_SPACE = ~A.byte_class((0x20, 0x20), (0x09, 0x0D))
#: Candidate texts are picked on the scan side by a broadcast of ids up to this many (16 bytes each), else by a shuffled join.
BROADCAST_IDS = 1_000_000


def _word_hashes(data, off):
    low = A.LOWER[data]
    start, end, row = A.words(low, off, NON_SPACE)
    return A.span_hash(A.prefix_hash(low), start, end), row


def _tokens(data, off, k: int):
    """The 63-bit token of every k words (of all words where a text has fewer), and its row."""
    h, row = _word_hashes(data, off)
    n = len(off) - 1
    counts = np.bincount(row, minlength=n)
    if len(h) >= k:
        last = len(h) - k + 1
        token = np.zeros(last, U)
        for j in range(k):
            token = token * U(0x9E3779B97F4A7C15) + A.mix(h[j : last + j] + U(j + 1))
        whole = row[:last] == row[k - 1 :]
        token, owner = A.mix(token[whole]), row[:last][whole]
    else:
        token, owner = np.zeros(0, U), np.zeros(0, row.dtype)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))[short]
        extra = A.mix(h[first] + U(77))
        for j in range(1, k - 1):
            more = counts[short] > j
            extra[more] = A.mix(extra[more] * U(31) + h[first[more] + j])
        token, owner = np.concatenate((token, extra)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        token, owner = token[order], owner[order]
    return token >> U(1), owner


def _sets(data, off, k: int):
    """Sorted distinct tokens of all rows of a chunk, and each row's offsets into them."""
    token, owner = _tokens(data, off, k)
    edges = np.searchsorted(owner, np.arange(len(off)))
    for i in np.flatnonzero(np.diff(edges) > 1):
        token[edges[i] : edges[i + 1]].sort()
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return token[keep], np.searchsorted(owner[keep], np.arange(len(off)))


def frequent_shingles(docs: DataFrame, shingle: int, bitmap_bits: int, rare_documents: int) -> bytes:
    """Bitmap of token-hash buckets that many documents share, over all documents.

    Many is more than rare_documents and than twice the median bucket, so that the classes
    part the same way when the corpus outgrows the bitmap.
    """
    ranges, per = 256, (1 << bitmap_bits) // 256

    def count(batches):
        held, size = [], 0

        def flush():
            bucket, c = np.unique(np.concatenate(held), return_counts=True)
            edges = np.searchsorted(bucket, np.arange(ranges + 1) * per)
            used = np.flatnonzero(np.diff(edges))
            step = [np.diff(bucket[edges[i] : edges[i + 1]], prepend=np.uint32(i * per)) for i in used]  # neighbours are near: one byte each, mostly
            wide = [1 if x.max() < 256 else 4 for x in step]
            return pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(wide, pa.int32()), pa.array([x.astype("u1" if w == 1 else "<u4").tobytes() for x, w in zip(step, wide, strict=True)], pa.binary()), pa.array([np.minimum(c[edges[i] : edges[i + 1]], 255).astype(np.uint8).tobytes() for i in used], pa.binary())],
                ["range", "wide", "step", "n"],
            )

        for batch in batches:
            for _, _, data, off in A.chunks(batch.column("text")):
                token, row = _tokens(data, off, shingle)
                one = np.unique((row.astype(U) << U(bitmap_bits)) | (token >> U(63 - bitmap_bits)))
                held.append((one & U((1 << bitmap_bits) - 1)).astype(np.uint32))
                size += len(one)
                if size > 6_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(table):
        total = np.zeros(per, np.int64)
        for w, s, c in zip(table.column("wide"), table.column("step"), table.column("n"), strict=True):
            at = np.cumsum(np.frombuffer(s.as_buffer(), "u1" if w.as_py() == 1 else "<u4").astype(np.int64))
            total[at] += np.frombuffer(c.as_buffer(), np.uint8)
        often = total > max(rare_documents, 2 * float(np.median(total)))
        return pa.table(
            {
                "range": pa.array([table.column("range")[0].as_py()], pa.int32()),
                "bits": pa.array([np.packbits(often, bitorder="little").tobytes()], pa.binary()),
            }
        )

    got = docs.select("text").mapInArrow(
        count, "range int, wide int, step binary, n binary"
    ).groupBy("range").applyInArrow(A.trimmed(merge), "range int, bits binary").collect()
    out = bytearray((1 << bitmap_bits) // 8)
    for r in got:
        out[r["range"] * per // 8 : (r["range"] + 1) * per // 8] = r["bits"]
    return bytes(out)


def _partitions(level: int, num: int, den: int) -> int:
    """How many partitions the frequent tokens of sets of 2**level to 2**(level + 1) tokens are dealt into.

    About two for each token that such a set may lose, and few enough that whole sets always cover what they must.
    """
    size = 1 << level
    return max(1, min(2 * size * (den - num) // den, -(-num * size // den) - 1))


def _signatures(rare: np.ndarray, often: np.ndarray, num: int, den: int):
    """Single tokens and hashed pairs of tokens that one set indexes: its prefix in the order "rare first, then by hash"."""
    size = len(rare) + len(often)
    none = np.zeros(0, U)
    if (size + size * den // num) * (den - num) // (den + num) < 1:  # only equal sets can link
        return none, none
    tau = size - -(-num * size // den)
    if len(rare) > tau:
        return rare[: tau + 1], none
    level, found = size.bit_length() - 1, []
    levels = [level, level - 1] if level and size * num <= (1 << level) * den else [level]  # smaller partners may be one level below
    for x in levels:
        part = (A.mix(often ^ U(0xA0761D6478BD642F)) % U(_partitions(x, num, den))).astype(np.int64)
        opens = np.zeros(len(part), bool)
        opens[np.unique(part, return_index=True)[1]] = True
        # the prefix grows until, whichever tau tokens are lost, two are left in some partition
        end = int(np.searchsorted(np.cumsum(~opens), tau + 1 - len(rare))) + 1
        order = np.argsort(part[:end], kind="stable")
        part, token = part[:end][order], often[:end][order]
        for step in range(1, int(np.bincount(part).max(initial=1))):
            both = np.flatnonzero(part[step:] == part[:-step])
            found.append(A.mix(A.mix(token[both] + U(x)) * U(0x9E3779B97F4A7C15) + token[both + step]))
    return rare, np.concatenate(found) if found else none


def _digests(token, edge):
    run1 = np.concatenate((np.zeros(1, U), np.cumsum(A.mix(token))))
    run2 = np.concatenate((np.zeros(1, U), np.cumsum(A.mix(token ^ U(0x5851F42D4C957F2D)))))
    return run1[edge[1:]] - run1[edge[:-1]], run2[edge[1:]] - run2[edge[:-1]]


def _sketches(token, edge) -> list[bytes]:
    """For each set a bit vector, of at least as many bits as tokens (a power of two from 64): each bit is the parity of the tokens that fall on it."""
    size = np.diff(edge)
    wide = np.array([max(64, 1 << max(0, int(x) - 1).bit_length()) for x in size], np.int64)
    base = np.concatenate(([0], np.cumsum(wide)))
    place = np.repeat(base[:-1], size) + (A.mix(token) & (np.repeat(wide, size) - 1).astype(U)).astype(np.int64)
    raw = np.packbits(np.bincount(place, minlength=int(base[-1])) & 1 == 1, bitorder="little").tobytes()
    return [raw[s // 8 : e // 8] for s, e in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def set_digests(docs: DataFrame, shingle: int) -> DataFrame:
    """Per row: doc_id, n (set size), a 128-bit digest of the set and its sketch."""

    def work(batches):
        for batch in batches:
            for i, j, data, off in A.chunks(batch.column("text")):
                token, edge = _sets(data, off, shingle)
                d1, d2 = _digests(token, edge)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(edge).astype(np.int64)),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                        pa.array(_sketches(token, edge), pa.binary()),
                    ],
                    ["doc_id", "n", "d1", "d2", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, d1 long, d2 long, sketch binary")


def shared_signatures(
    docs: DataFrame, shingle: int, num: int, den: int, bitmap: bytes, bits: int, parts: int
) -> DataFrame:
    """(kind, sig, hub, hub_n, key, n): what signatures that several sets have say; a key is a set's first digest.

    Kind 0 and 1 are stars, from a single token or a combination: the bucket's smallest key is its
    hub, and each hub meets a member once a part. Kind 2 are the members of single-token buckets
    of three and more.

    Signatures travel packed by hash range, 8 bytes and a local number each; equal texts of
    a chunk travel once, and equal sets are one key, so groups of copies add nothing here.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def pack(batches):
        table = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for _, _, data, off in A.chunks(batch.column("text")):
                token, edge = _sets(data, off, shingle)
                size = np.diff(edge)
                key, _ = _digests(token, edge)
                at = (token >> U(63 - bits)).astype(np.int64)
                often = (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                sig, who = [], []
                for x in np.unique(key, return_index=True)[1]:
                    mine, many = token[edge[x] : edge[x + 1]], often[edge[x] : edge[x + 1]]
                    pre, sl = _signatures(mine[~many], mine[many], num, den)
                    sig += [A.mix(pre) & ~U(1), sl | U(1)]
                    who += [np.full(len(pre) + len(sl), x)]
                if not sig or not sum(map(len, sig)):
                    continue
                sig, who = np.concatenate(sig), np.concatenate(who)
                part = ((sig >> U(40)) * U(parts) >> U(24)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                out = {"part": [], "sig": [], "at": [], "keys": [], "sizes": []}
                for p in np.flatnonzero(np.diff(edges)):
                    mine = order[edges[p] : edges[p + 1]]
                    used, local = np.unique(who[mine], return_inverse=True)
                    out["part"].append(int(p))
                    out["sig"].append(sig[mine].astype("<u8").tobytes())
                    out["at"].append(local.astype("<u4" if len(used) > 65535 else "<u2").tobytes())
                    out["keys"].append(key[used].astype("<u8").tobytes())
                    out["sizes"].append(size[used].astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict(
                    out,
                    schema=pa.schema(
                        [("part", pa.int32()), *[(c, pa.binary()) for c in ("sig", "at", "keys", "sizes")]]
                    ),
                )

    def find(table):
        sig, key, n = [], [], []
        for s, at, k, z in zip(*(table.column(c) for c in ("sig", "at", "keys", "sizes")), strict=True):
            k = np.frombuffer(k.as_buffer(), "<u8")
            at = np.frombuffer(at.as_buffer(), "<u4" if len(k) > 65535 else "<u2")
            sig.append(np.frombuffer(s.as_buffer(), "<u8"))
            key.append(k[at])
            n.append(np.frombuffer(z.as_buffer(), "<u4")[at])
        sig, key, n = np.concatenate(sig), np.concatenate(key), np.concatenate(n)
        order = np.argsort(sig)
        sig, key, n = sig[order], key[order], n[order]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        several = np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start)
        keep = np.repeat(several, np.diff(np.append(start, len(sig))))
        sig, key, n = sig[keep], key[keep], n[keep]
        order = np.lexsort((key, sig))
        sig, key, n = sig[order], key[order], n[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key, n = sig[new], key[new], n[new]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(sig)))
        head = np.repeat(first, size)
        many = (sig & U(1)).astype(bool)
        star = np.flatnonzero(head != np.arange(len(sig)))
        pair = np.stack((key[head[star]], key[star], many[star].astype(U)), axis=1)
        _, kept = np.unique(np.ascontiguousarray(pair).view([("a", U), ("b", U), ("m", U)]).ravel(), return_index=True)
        star = star[kept]
        small = np.flatnonzero(~many & (np.repeat(size, size) > 2))
        rows = np.concatenate((star, small))
        kind = np.concatenate((np.where(many[star], 1, 0), np.full(len(small), 2)))
        return pa.table(
            {
                "kind": pa.array(kind.astype(np.int32)),
                "sig": pa.array(np.where(kind == 2, sig[rows], U(0)).view(np.int64)),
                "hub": pa.array(key[head[rows]].view(np.int64)),
                "hub_n": pa.array(n[head[rows]].astype(np.int64)),
                "key": pa.array(key[rows].view(np.int64)),
                "n": pa.array(n[rows].astype(np.int64)),
            }
        )

    packed = docs.select("text").mapInArrow(pack, "part int, sig binary, at binary, keys binary, sizes binary")
    return packed.groupBy("part").applyInArrow(
        A.trimmed(find), "kind int, sig long, hub long, hub_n long, key long, n long"
    )


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the documents in ids(doc_id): filtered at the scan while ids are few, else by a shuffled join."""
    return docs.select("doc_id", "text").join(
        F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi"
    )


def _pruned(na, sa, nb, sb, num: int, den: int) -> np.ndarray:
    """Which pairs of sets may link by their sketches: differing bits are at most the tokens in which two sets differ."""
    out = np.zeros(len(na), bool)
    wide = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
    for one, two in set(zip(*wide, strict=True)):
        at = np.flatnonzero((wide[0] == one) & (wide[1] == two))
        least = min(one, two)
        a = _folded(np.frombuffer(b"".join(sa[i] for i in at), "<u8").reshape(len(at), -1), least // 8)
        b = _folded(np.frombuffer(b"".join(sb[i] for i in at), "<u8").reshape(len(at), -1), least // 8)
        gap = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        out[at] = gap * (den + num) <= (na[at] + nb[at]) * (den - num)
    return out


def _folded(words: np.ndarray, to: int) -> np.ndarray:
    """Sketches of fewer bits: halves are added without carry."""
    while words.shape[1] > to:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _links(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link: pruned by sketches, then verified by intersecting whole sets."""
    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = F.expr(f"{den} * na >= {num} * nb and {den} * nb >= {num} * na")
    wide = pairs.join(two, "b").join(one, "a").where(near).select("a", "b", "na", "nb", "sa", "sb")

    def prune(batches):
        for b in batches:
            col_ = [b.column(c) for c in ("na", "nb", "sa", "sb")]
            keep = _pruned(col_[0].to_numpy(), col_[2].to_pylist(), col_[1].to_numpy(), col_[3].to_pylist(), num, den)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    likely = materialize(wide.mapInArrow(prune, "a long, b long").distinct(), "likely")
    ids = materialize(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")

    def collect(batches):
        for batch in batches:
            for i, j, data, off in A.chunks(batch.column("text")):
                token, edge = _sets(data, off, shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(edge).astype(np.int64)),
                        pa.array(
                            [token[edge[x] : edge[x + 1]].astype("<u8").tobytes() for x in range(j - i)], pa.binary()
                        ),
                    ],
                    ["id", "n", "tokens"],
                )

    sets = materialize(_picked(docs, ids).mapInArrow(collect, "id long, n long, tokens binary"), "sets")
    wide = likely.join(
        sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b"
    ).join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a")

    def intersect(batches):
        for batch in batches:
            inter, kept, value = [], None, None
            for ta, tb in zip(batch.column("ta"), batch.column("tb"), strict=True):
                ta, tb = ta.as_buffer(), np.frombuffer(tb.as_buffer(), "<u8")
                if kept is None or not ta.equals(kept):
                    kept, value = ta, np.frombuffer(ta, "<u8")
                small, big = (tb, value) if len(tb) < len(value) else (value, tb)
                at = np.searchsorted(big, small)
                inter.append(int((big[np.minimum(at, len(big) - 1)] == small).sum()) if len(big) else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("a"),
                    batch.column("b"),
                    pa.array(inter, pa.int64()),
                    batch.column("na"),
                    batch.column("nb"),
                ],
                ["a", "b", "inter", "na", "nb"],
            )

    checked = wide.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(
        intersect, "a long, b long, inter long, na long, nb long"
    )
    out = materialize(
        checked.where(f"inter > 0 and {den} * inter >= {num} * (na + nb - inter)").select("a", "b"), "links"
    )
    discard(sets, ids, likely)
    return out


def _sketched(
    left: DataFrame, sketches: DataFrame, num: int, den: int, block_bytes: int = 1 << 20, most_each: int = 16
) -> DataFrame:
    """(a, b) of left(hub, id, component): same hub, different components, may link; (hub, null) where they are more than most_each a member.

    Members of a hub are dealt into blocks of about block_bytes of sketches; every two blocks meet in a task of their own.
    """
    left = left.join(sketches, "id")
    blocks = left.groupBy("hub").agg(F.ceil(F.sum(F.octet_length("sketch") + 32) / F.lit(block_bytes)).alias("blocks"))
    dealt = left.join(blocks, "hub").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.select("*", other.alias("other")).select(
        "hub",
        "id",
        "n",
        "component",
        "sketch",
        "mine",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
    )

    def compare(table):
        hub, i, j = (table.column(c)[0].as_py() for c in ("hub", "i", "j"))
        c = {x: table.column(x).to_numpy() for x in ("id", "n", "component", "mine")}
        raw = table.column("sketch").to_pylist()
        wide = np.array([len(x) for x in raw])
        groups = {w: np.flatnonzero(wide == w) for w in np.unique(wide)}
        words = {w: np.frombuffer(b"".join(raw[x] for x in at), "<u8").reshape(len(at), -1) for w, at in groups.items()}
        a, b, found, most = [], [], 0, most_each * len(raw)
        for w, rows in groups.items():
            for v in (w, 2 * w):
                if v not in groups:
                    continue
                fold, cols = _folded(words[v], w // 8), groups[v]
                step = max(1, (32 << 20) // (len(cols) * w))
                for s in range(0, len(rows), step):
                    part = rows[s : s + step]
                    gap = np.bitwise_count(words[w][s : s + step, None, :] ^ fold[None, :, :]).sum(2, dtype=np.int64)
                    both = c["n"][part][:, None] + c["n"][cols][None, :]
                    may = (gap * (den + num) <= both * (den - num)) & (
                        c["component"][part][:, None] != c["component"][cols][None, :]
                    )
                    x, y = np.nonzero(may)
                    x, y = part[x], cols[y]
                    keep = (c["mine"][x] == i) & (c["mine"][y] == j) | (c["mine"][x] == j) & (c["mine"][y] == i)
                    keep &= (c["id"][x] < c["id"][y]) if w == v else True
                    found += int(keep.sum())
                    if found > most:
                        return pa.table({"a": pa.array([hub], pa.int64()), "b": pa.nulls(1, pa.int64())})
                    a.append(np.minimum(c["id"][x[keep]], c["id"][y[keep]]))
                    b.append(np.maximum(c["id"][x[keep]], c["id"][y[keep]]))
        cat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b)]
        return pa.table({"a": pa.array(cat[0]), "b": pa.array(cat[1])})

    return dealt.groupBy("hub", "i", "j").applyInArrow(A.trimmed(compare), "a long, b long").distinct()


def _remaining(
    left: DataFrame, docs: DataFrame, shingle: int, num: int, den: int, block_tokens: int = 600_000
) -> DataFrame:
    """Links (a, b) among left(hub, id, n, component): same hub, different components.

    Members of a hub are dealt into blocks of about block_tokens tokens; every two blocks are
    compared in a task of their own. The product of their token incidence is the exact size of
    every intersection. Only links that join components within the task are emitted.
    """

    def tokens(batches):
        for batch in batches:
            for i, j, data, off in A.chunks(batch.column("text")):
                token, edge = _sets(data, off, shingle)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(
                            [token[edge[x] : edge[x + 1]].astype("<u8").tobytes() for x in range(j - i)], pa.binary()
                        ),
                    ],
                    ["id", "tokens"],
                )

    ids = materialize(left.select(F.col("id").alias("doc_id")).distinct(), "leftids")
    sets = materialize(
        _picked(docs, ids).mapInArrow(tokens, "id long, tokens binary").dropDuplicates(["id"]), "leftsets"
    )
    blocks = left.groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(block_tokens)).alias("blocks"))
    dealt = left.join(blocks, "hub").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(sets, "id")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.select("*", other.alias("other")).select(
        "hub",
        "id",
        "n",
        "component",
        "tokens",
        "mine",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
    )

    def compare(table):
        col = {c: table.column(c).to_numpy() for c in ("id", "n", "component", "mine")}
        lists = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("tokens")]
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        _, code, seen = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        keep = seen[code] > 1
        owner, code = owner[keep], np.unique(code[keep], return_inverse=True)[1]
        by = np.argsort(code, kind="stable")
        owner, code = owner[by], code[by]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rows, cols = np.flatnonzero(col["mine"] == i), np.flatnonzero(col["mine"] == j)
        inter = np.zeros((len(rows), len(cols)), np.float32)
        place_r, place_c = np.full(len(lists), -1), np.full(len(lists), -1)
        place_r[rows], place_c[cols] = np.arange(len(rows)), np.arange(len(cols))
        for s in range(0, int(code[-1]) + 1 if len(code) else 0, 1024):
            x, y = np.searchsorted(code, s), np.searchsorted(code, s + 1024)
            one, two = np.zeros((len(rows), 1024), np.float32), np.zeros((len(cols), 1024), np.float32)
            o, c = owner[x:y], code[x:y] - s
            m = place_r[o] >= 0
            one[place_r[o[m]], c[m]] = 1
            m = place_c[o] >= 0
            two[place_c[o[m]], c[m]] = 1
            inter += one @ two.T
        r, c = np.nonzero(den * inter >= num * (col["n"][rows][:, None] + col["n"][cols][None, :] - inter))
        r, c = rows[r], cols[c]
        apart = col["component"][r] != col["component"][c]
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        a, b = [], []
        for x, y in zip(r[apart].tolist(), c[apart].tolist(), strict=True):
            u, v = root(int(col["component"][x])), root(int(col["component"][y]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                a.append(int(col["id"][x]))
                b.append(int(col["id"][y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("hub", "i", "j").applyInArrow(A.trimmed(compare), "a long, b long").distinct()


def jaccard_links(
    docs: DataFrame,
    digests: DataFrame,
    shingle: int,
    num: int,
    den: int,
    bitmap: bytes,
    bits: int,
    part_bytes: int = 64 << 20,
) -> DataFrame:
    """Components (id, component) of the links between set representatives."""
    reps = digests.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"))
    reps = materialize(reps.where("id is not null"), "reps")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    stars = materialize(
        shared_signatures(docs, shingle, num, den, bitmap, bits, max(4, -(-total // part_bytes))), "found"
    )
    named = reps.select(F.col("d1").alias("key"), "n", "id")
    named_hub = reps.select(F.col("d1").alias("hub"), F.col("n").alias("hub_n"), F.col("id").alias("hub_id"))
    found = stars.join(named, ["key", "n"]).join(named_hub, ["hub", "hub_n"])
    found = materialize(found.select("kind", "sig", F.col("hub_id").alias("hub"), "id"), "members")
    discard(stars)
    sketches = digests.where("doc_id is not null and n > 0").select(F.col("doc_id").alias("id"), "n", "sketch")
    pairs = found.where("kind < 2").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = _links(pairs, sketches, docs, shingle, num, den)
    components = connected_components(links)
    apart = materialize(_apart(found, components, sketches, num, den), "apart")
    links = materialize(
        links.union(_links(apart.where("b is not null").select("a", "b"), sketches, docs, shingle, num, den)), "links"
    )
    dense = apart.where("b is null").select(F.col("a").alias("hub")).distinct()
    if dense.limit(1).count():
        members = found.where("kind = 1").select("hub", "id").distinct().join(dense, "hub", "left_semi")
        components = connected_components(links)
        left = _in_components(members, components).join(sketches.select("id", "n"), "id")
        links = materialize(links.union(_remaining(materialize(left, "left"), docs, shingle, num, den)), "links")
    return connected_components(links)


def _in_components(members: DataFrame, components: DataFrame) -> DataFrame:
    """members(hub, id) of hubs that have members in several components, with each one's component."""
    placed = members.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("hub").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo <> hi").select("hub")
    return placed.join(split, "hub", "left_semi")


def _apart(found: DataFrame, components: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that may link; (hub, null) for hubs with too many of them."""
    few = found.where("kind = 2").select("sig", "hub", "id").join(components, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    open_ = few.groupBy("sig").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo <> hi").select("sig")
    few = materialize(few.join(open_, "sig", "left_semi"), "few")
    met = F.expr("x.sig = y.sig and x.id < y.id and x.component <> y.component and x.id <> x.hub and y.id <> y.hub")
    singles = few.alias("x").join(few.alias("y"), met).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")
    ).distinct()
    return singles.union(
        _sketched(
            _in_components(found.where("kind = 1").select("hub", "id").distinct(), components), sketches, num, den
        )
    )


def ngram_jaccard_groups(
    docs: DataFrame, shingle: int = 3, num: int = 9, den: int = 10, rare_documents: int = 16, bitmap_bits: int = 26
) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id, set_id (smallest doc_id of the equal sets)."""
    if 3 * num < 2 * den or num > den:
        raise ValueError("the threshold num / den must be between 2/3 and 1")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bitmap = frequent_shingles(docs, shingle, bitmap_bits, rare_documents)
    digests = materialize(set_digests(docs, shingle), "digests")
    components = jaccard_links(docs, digests, shingle, num, den, bitmap, bitmap_bits)
    reps = digests.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("set_id"))
    # written, so that the join below has an exchange of its own on both sides, which adaptive execution can split
    named = materialize(reps.join(components.withColumnRenamed("id", "set_id"), "set_id", "left"), "named")
    alone = digests.where("n = 0").select(
        "doc_id", "n", F.col("doc_id").alias("set_id"), F.lit(None).cast("long").alias("component")
    )
    out = digests.where("n > 0").join(named, ["n", "d1", "d2"], "left").select(
        "doc_id", "n", "set_id", "component"
    ).unionByName(alone)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "set_id").alias("component_id"), "set_id"
    )


def keep_one_per_group(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10, **options) -> DataFrame:
    """Rows of docs of which one stays for each group of near duplicates (the smallest doc_id).

    Of rows that share a doc_id one stays. Rows with a null doc_id can't be named and stay.
    Texts aren't shuffled but for rows whose doc_id repeats. Columns of any name pass untouched.
    """
    groups = ngram_jaccard_groups(docs, shingle, num, den, **options).where("doc_id is not null")
    goes, rows, key = free_names(docs.columns, "goes", "rows", "key")
    ids = groups.groupBy(F.col("doc_id").alias(key)).agg(
        F.min(F.col("doc_id") != F.col("component_id")).alias(goes), F.count(F.lit(1)).alias(rows)
    )
    ids = materialize(ids.where(col(goes) | (col(rows) > 1)), "goes")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    marked = docs.join(ids, F.col("doc_id").cast("long") == col(key), "left")
    own = [col(c) for c in docs.columns]
    once = marked.where(col(goes).isNull()).select(own)
    return once.unionByName(marked.where(~col(goes)).select(own).dropDuplicates(["doc_id"]))
