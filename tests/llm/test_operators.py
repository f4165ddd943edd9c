"""The ten operators against brute force, round trips or planted cases on small tables."""

import collections
import hashlib
import random
import re
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import decontamination, html_extraction, line_dedup, media_copies, ngram_jaccard_join, quality_classifier, queries, sharding, source_mixing, suffix_dedup, url_filter

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOC = "doc_id long, text string, lang string, source string, n string"
ODD = [
    (5000, None),
    (5003, ""),
    (5006, "a b"),
    (5009, "A b"),
    (5012, "a"),
    (5015, " \n\t "),
    (None, "x y z"),
    (5018, "x " * 30000),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOC)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(
        tuple(w[j : j + k]) for j in range(len(w) - k + 1)
    ) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and den * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(seed=5, copies=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i * 3, " ".join(w)))
    return rows + [
        (i * 3 + 1, " ".join(rng.choice(words[:25]) for _ in range(rng.randint(0, 25)))) for i in range(60)
    ] + ODD


@pytest.mark.parametrize(("k", "num", "den", "rare"), [(3, 9, 10, 16), (5, 8, 10, 4)])
def test_jaccard_groups_equal_brute_force(spark, k, num, den, rare):
    rows = near_copies()
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join.ngram_jaccard_groups(
            docs(spark, rows), k, num, den, rare_documents=rare, bitmap_bits=16
        ).collect()
    }
    want = brute_groups(rows, k, num, den)
    assert {i: got[i] for i in want} == want and got[None][1] is None


def test_one_of_each_group_stays(spark):
    rows = [
        (1, "a b c d e f g h"),
        (2, "a b c d e f g h"),
        (2, "a b c d e f g h"),
        (3, "z y x w v u"),
        (3, "z y x w v u"),
        (None, "q"),
    ]
    out = ngram_jaccard_join.keep_one_per_group(docs(spark, rows))
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 1, 3] and out.columns == [
        "doc_id", "text", "lang", "source", "n"
    ]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert ngram_jaccard_join.ngram_jaccard_groups(none, bitmap_bits=16).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert line_dedup.line_dedup_counts(none).count() == 0
    assert sharding.assign_shards(none).count() == 0
    assert source_mixing.sample_mix(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination_report(none, bench).count() == 0
    assert decontamination.contamination_report(docs(spark, ODD), bench).where("contaminated").count() == 0


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [
        (
            i,
            " ".join(
                rng.choice(["Alpha", "beta", "Émile", "x9", "gamma,"]) + str(rng.randint(0, 30)) for _ in range(n)
            ),
        ) for i, n in enumerate((30, 5, 13, 0, 14))
    ] + [(9, None), (10, "beta1 Solo"), (11, "ΑΣ ΑΣ'ΑΣ")]
    rows = []
    for i in range(40):
        filler = " ".join(f"f{rng.randint(0, 50)}" for _ in range(rng.randint(0, 300)))
        part = rng.choice(items)[1] or ""
        cut = part.split(" ")[rng.randint(0, 2) :]
        rows.append((i, filler + " -- " + " ".join(cut).upper().translate(str.maketrans("É", "É")) + "! " + filler))
    rows += [x for x in ODD if x[0] is not None]
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words_of(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[j : j + n])].add(str(i))
    got = {
        r["doc_id"]: r for r in decontamination.contamination_report(
            docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
        ).collect()
    }
    flagged = 0
    for i, t in rows:
        w, hit, of = words_of(t), set(), set()
        for n in {len(g) for g in grams}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    of |= grams[tuple(w[j : j + n])]
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (
            len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()
        )
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
        flagged += r["contaminated"]
    assert flagged > 3
    bench = spark.createDataFrame(items, "item_id long, text string")
    hidden = [(None, rows[k][1]) for k in range(40)] + [rows[5]] * 2
    table = docs(spark, rows + hidden).withColumns(
        {"n_hit": F.lit(1), "H1": F.lit("x"), "hit_words": F.lit(2), "goes.by": F.lit(3)}
    )
    clean = decontamination.remove_contaminated(table, bench)
    assert clean.columns == table.columns
    want = [t for i, t in rows + hidden if not (set_of := hits_of(t, grams)) or 20 * len(set_of) < len(words_of(t))]
    assert collections.Counter(r["text"] for r in clean.collect()) == collections.Counter(want)
    cut = decontamination.remove_hit_spans(table, bench)
    pieces = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)
    spans = [
        t if not (h := hits_of(t, grams)) else " ".join(
            w for k, w in enumerate(pieces(t)) if k not in h
        ) for _, t in rows + hidden
    ]
    assert cut.columns == table.columns and collections.Counter(
        r["text"] for r in cut.collect()
    ) == collections.Counter(spans)
    assert decontamination.remove_contaminated(table.limit(0), bench).count() == 0


def hits_of(t, grams):
    w, hit = words_of(t), set()
    for n in {len(g) for g in grams}:
        for j in range(len(w) - n + 1):
            if tuple(w[j : j + n]) in grams:
                hit |= set(range(j, j + n))
    return hit


def test_shards_partition_and_grow_by_key(spark):
    rows = [(i, "t" * (i % 50)) for i in range(800)] + [(7, "t" * 7)] * 5 + [(None, None)]
    got = sharding.assign_shards(docs(spark, rows), bucket_bytes=1 << 9).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert len(got) == len(rows) and set(by) == set(range(8)) and all(
        sorted(v) == list(range(len(v))) for v in by.values()
    )
    out = sharding.shard_documents(docs(spark, rows))
    assert out.count() == len(rows) and {"shard", "slot", "lang"} <= set(out.columns)


def test_raking_meets_targets(spark):
    rng = random.Random(1)
    rows = [
        (
            i,
            " ".join(rng.choice(["word", "and", "X", "7!", "??"]) for _ in range(rng.randint(0, 90))),
            rng.choice(["en", "en", "de", None]),
            rng.choice(["a", "a", "b", None]),
            None,
        ) for i in range(400)
    ] + [(900, None, "en", "a", None), (None, "", None, "b", None), (3, "again", "en", "a", None)]
    table = spark.createDataFrame(rows, DOC)
    cells = source_mixing.fit_cells(table)[0].collect()
    total = sum(c["tokens"] for c in cells)
    assert total == sum(
        len(re.split("[ \\t\\n\\r]", t)) if t else 0 for _, t, *_ in rows
    ) and len({c["topic"] for c in cells}) > 1
    for m in source_mixing.MARGINS:
        seen, fitted = collections.Counter(), collections.Counter()
        for c in cells:
            seen[c[m]] += c["tokens"]
            fitted[c[m]] += c["fitted"]
        goal = {k: (v / total) ** source_mixing.TEMPER[m] for k, v in seen.items()}
        for k in goal:
            assert fitted[k] == pytest.approx(goal[k] / sum(goal.values()) * total, abs=1e-8 * total)
    assert max(c["probability"] for c in cells) == pytest.approx(1)
    drawn = source_mixing.sample_mix(table).collect()
    lot = lambda i: int(hashlib.md5(f"11:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
    assert len(drawn) == len(rows) and all(r["kept"] == (lot(r["doc_id"]) < r["probability"]) for r in drawn)
    odd = table.withColumn(
        "kept", F.lit(7)
    ).withColumn("Probability", F.lit("p")).withColumn("topic", F.lit(1)).withColumn("a.b", F.lit(2))
    out = source_mixing.keep_sample(odd)
    assert out.columns == odd.columns and {
        (r["kept"], r["Probability"], r["topic"], r["a.b"]) for r in out.collect()
    } == {(7, "p", 1, 2)}
    assert sorted(r["doc_id"] or -1 for r in out.collect()) == sorted(r["doc_id"] or -1 for r in drawn if r["kept"])
    assert source_mixing.fit_cells(table, budget=50.0)[0].agg(
        F.sum(F.col("probability") * F.col("tokens"))
    ).first()[0] <= 50.0001


def test_url_rules(spark):
    rules = spark.createDataFrame(
        [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/"), ("allow", "org", "/")],
        "verdict string, host string, path string",
    )
    urls = [
        "http://A.Example.COM/en/70?q",
        "https://x.com/en/",
        "http://notcom/en/1",
        "http://x.com/fr/",
        None,
        "no scheme",
        "http://",
        "http://o.org/a#b",
        "http://com/en/1/2",
        "http://badexample.com/en/7",
    ]
    got = [
        (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(
            spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules
        ).orderBy("page_id").collect()
    ]
    assert got == [
        ("a.example.com", "/en/70", "example.com/en/7", "allow"),
        ("x.com", "/en/", "com/en/", "block"),
        ("notcom", "/en/1", None, "allow"),
        ("x.com", "/fr/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("o.org", "/a", "org/", "block"),
        ("com", "/en/1/2", "com/en/", "block"),
        ("badexample.com", "/en/7", "com/en/", "block"),
    ]


def test_multikey_groups_equal_a_dictionary(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEAF", 8)
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    at = rng.integers(0, 870, 500)
    first = rng.integers(0, 2, 500).astype(np.uint64)
    got = suffix_dedup.multikey_groups(data, at, first, 13)
    keys = [(int(f), data[a : a + 13].tobytes()) for a, f in zip(at, first, strict=True)]
    seen = collections.Counter(keys)
    assert [g >= 0 for g in got] == [seen[k] > 1 for k in keys]
    assert len({(k, int(g)) for k, g in zip(keys, got, strict=True) if g >= 0}) == len(
        {int(g) for g in got if g >= 0}
    ) == sum(n > 1 for n in seen.values())


@pytest.mark.parametrize(("hot_rows", "sample_bytes"), [(100_000, 4 << 20), (3, 4 << 20), (100_000, 500)])
def test_suffix_dedup_equals_brute_force(spark, hot_rows, sample_bytes):
    rng = random.Random(4)
    shared = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(50, 140))) for _ in range(6)]
    rows = [
        (
            i * 7 % 101,
            "".join(
                rng.choice(
                    [rng.choice(shared), "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 70))), "ab" * 30]
                ) for _ in range(rng.randint(0, 5))
            ),
        ) for i in range(100)
    ]
    rows += [(900, None), (901, ""), (902, "é" * 40), (903, "xé" * 20 + "é" * 40), (904, rows[3][1]), (905, rows[3][1])]
    rows += [
        (
            910 + i, f"{i} " * 9 + "a string that very many texts have, of more than fifty bytes" + f" {i * 7}" * 9
        ) for i in range(20)
    ]
    rows.append((990, "".join(rng.choice("mnop ") for _ in range(300_000)) + rows[5][1] + "ab" * 40_000))
    got = {
        r["doc_id"]: r for r in suffix_dedup.remove_repeats(
            docs(spark, [*rows, (None, "q" * 80)]), part_bytes=1 << 14, hot_rows=hot_rows, sample_bytes=sample_bytes
        ).collect()
    }
    first, texts = {}, sorted((i, (t or "").encode()) for i, t in rows)
    for i, t in texts:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == (
            len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept
        )
    assert got[None]["n_removed"] == 0


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(400):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12))) if rng.random() < 0.3 else bytes(
            c for c in a if rng.random() < 0.85
        )
        for m in range(4):
            assert line_dedup.edit_distance_within(a, b, m) == (edits(a, b) <= m)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 75))) for _ in range(8)]

    def change(t):
        t = list(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice([[], ["y"], [t[i], "z"]])
        return "".join(t)

    rows = [
        (
            i, "\n".join(change(rng.choice(base)) if rng.random() < 0.8 else "short" for _ in range(rng.randint(0, 4)))
        ) for i in range(50)
    ]
    got = {
        r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup_counts(
            docs(spark, [*rows, (500, None), (501, ""), (None, base[0])])
        ).collect()
    }
    seen = []
    for i, t in rows:
        n = 0
        for line in t.split("\n"):
            if len(line) >= 60:
                n += any(edits(x, line) <= 2 for x in seen)
                seen.append(line)
        assert got[i] == (t.count("\n") + 1, n)
    assert got[500] == (0, 0) and got[501] == (1, 0) and got[None] == (1, 0)


def test_line_dedup_takes_lines_of_every_length(spark):
    rng = random.Random(2)
    rows = [
        (
            i,
            "\n".join(
                "".join(
                    rng.choice("abcdefghij") for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 30)))
                ) for _ in range(rng.randint(1, 5))
            ),
        ) for i in range(60)
    ]
    rows += [(100 + i, t.upper()) for i, (_, t) in enumerate(rows[:10])] + [
        (200, ""), (201, "a long line that comes twice\n\nA long line that came twice")
    ]
    got = {
        r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed_bytes"]) for r in line_dedup.line_dedup_counts(
            docs(spark, [*rows, (500, None)]), min_bytes=0
        ).collect()
    }
    seen = []
    for i, t in rows:
        n = size = 0
        for line in t.split("\n"):
            if any(edits(x, line) <= 2 for x in seen):
                n, size = n + 1, size + len(line)
            seen.append(line)
        assert got[i] == (t.count("\n") + 1, n, size), (i, t)
    assert got[500] == (0, 0, 0)


def test_line_dedup_finds_edits_in_long_lines(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(40):
        line = [rng.choice("abcdefgh ") for _ in range(rng.randint(3000, 5000))]
        # one substitution that carries the counter of "a" over a multiple of 256
        have = line.count("a")
        spare = [k for k, c in enumerate(line) if c != "a"]
        for k in spare[: -have % 256 + 255]:
            line[k] = "a"
        other = next(k for k in spare[::-1] if line[k] != "a")
        near = [*line[:other], "a", *line[other + 1 :]]
        assert line.count("a") % 256 == 255 and near.count("a") % 256 == 0
        rows += [(2 * i, "".join(line)), (2 * i + 1, "".join(near))]
        want |= {2 * i: 0, 2 * i + 1: 1}
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup_counts(docs(spark, rows)).collect()} == want


def texture(seed, side=128):
    f = media_copies._box(np.random.default_rng(seed).normal(0, 1, (1, side, side)), 2)[0]
    return np.clip(127 + 90 * f / np.abs(f).max(), 0, 255)


def resampled(p, height, width, place):
    """p read at place(y, x), between pixels; grey outside."""
    y, x = place(*np.mgrid[:height, :width].astype(float))
    inside = (y > -0.6) & (x > -0.6) & (y < p.shape[0] - 0.4) & (x < p.shape[1] - 0.4)
    y, x = np.clip(y, 0, p.shape[0] - 1.001), np.clip(x, 0, p.shape[1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    fy, fx = y - i, x - j
    return np.where(
        inside,
        (p[i, j] * (1 - fx) + p[i, j + 1] * fx) * (1 - fy) + (p[i + 1, j] * (1 - fx) + p[i + 1, j + 1] * fx) * fy,
        127,
    )


def zoomed(p, z):
    return resampled(
        p, int(p.shape[0] * z), int(p.shape[1] * z), lambda y, x: ((y + 0.5) / z - 0.5, (x + 0.5) / z - 0.5)
    )


def turned(p, degrees):
    t, m = np.deg2rad(degrees), (p.shape[0] - 1) / 2
    return resampled(
        p, *p.shape, lambda y, x: (
            np.cos(t) * (y - m) - np.sin(t) * (x - m) + m, np.sin(t) * (y - m) + np.cos(t) * (x - m) + m
        )
    )


def noisy(p, sd, seed):
    return np.clip(p + np.random.default_rng(seed).normal(0, sd, p.shape), 0, 255)


EDITS = {
    "crop": lambda p: p[30:100, 20:105], "edit": lambda p: np.where(np.arange(len(p))[:, None] < 40, 255, p * 0.9 + 5), "noise 8": lambda p: noisy(p, 8, 1), "noise 16": lambda p: noisy(p, 16, 2),
    "right angle": lambda p: np.rot90(p), "turn": lambda p: turned(p, 30), **{f"zoom {z}": lambda p, z=z: zoomed(p, z) for z in (0.5, 0.7, 0.9, 1.1, 1.25, 2)},
}


def test_media_recall_by_kind_of_edit(spark):
    """At least 0.9 of each kind of edited copy is in the class of its picture, and no two pictures are."""
    rows, of = [], {}
    for i in range(8):
        p = texture(i)
        rows.append((100 * i, media_copies.write_pgm(p)))
        for k, (name, edit) in enumerate(EDITS.items()):
            rows.append((100 * i + k + 1, media_copies.write_pgm(edit(p))))
            of[100 * i + k + 1] = name
    got = {
        r["image_id"]: r["class_id"] for r in media_copies.image_copies(
            spark.createDataFrame(rows, "image_id long, image binary")
        ).collect()
    }
    caught = collections.Counter(name for i, name in of.items() if got[i] == i // 100 * 100)
    assert {n: c / 8 for n, c in caught.items() if c / 8 < 0.9} == {} and set(caught) == set(EDITS)
    assert all(got[i] // 100 == i // 100 for i in got)


def test_media_classes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(6):
        f = texture(40 + g, 64)
        rows += [
            (
                len(rows) + k, media_copies.write_pgm(np.clip(f + rng.normal(0, 1 + k, f.shape), 0, 255))
            ) for k in range(12)
        ]
    rows += [
        (500, None),
        (501, b""),
        (502, b"P5 9 9 255\nxx"),
        (503, rows[0][1]),
        (504, media_copies.write_pgm(np.full((64, 64), 7))),
    ]
    stack = np.stack([media_copies.read_pgm(r[1]) for r in rows[:72]])
    feats = [(*f, (64, 64)) for f in media_copies.describe(stack)]
    links = [(a, b) for b in range(72) for a in range(b) if media_copies.linked(feats[a], feats[b])]
    label = list(range(72))
    for _ in range(72):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert len(links) > 60
    table = spark.createDataFrame(
        rows + [(504, None), (None, rows[1][1])], "image_id long, image binary"
    ).withColumn("n", F.lit(1)).withColumn("class_id", F.lit("x"))
    got = [(r["image_id"], r["class_id"]) for r in media_copies.image_copies(table).collect()]
    want = [*enumerate(label), (500, 500), (501, 501), (502, 502), (503, 0), (504, 504), (504, 504), (None, label[1])]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_media_tables_come_from_all_images(spark):
    """The chance of one key equals a plain count over all images, on any layout; the pairs don't depend on the hash order of ids."""
    rng = np.random.default_rng(12)
    by_hash = [r["id"] for r in spark.range(600).orderBy(F.xxhash64("id"), "id").collect()]
    bits = {i: rng.random((rng.integers(20, 40), 128)) < (0.5 if k < 300 else 0.1) for k, i in enumerate(by_hash)}

    def feats(up, parts):
        rows = [(i + up, len(x), np.packbits(x, axis=1, bitorder="little").tobytes()) for i, x in sorted(bits.items())]
        rows.append((up - 1, 0, b""))
        return spark.createDataFrame(rows, "image_id long, n long, bits binary").repartition(parts)

    who, all_bits = np.concatenate([[i] * len(x) for i, x in bits.items()]), np.concatenate(list(bits.values()))
    want, pairs = {}, 3 * (len(who) ** 2 - sum(len(x) ** 2 for x in bits.values()))
    for wide in (8, 16):
        same = 0
        for order in media_copies._orders(3):
            keys = [x.tobytes() for x in all_bits[:, order[:wide]]]
            same += sum(c * c for c in collections.Counter(keys).values())
            same -= sum(c * c for c in collections.Counter(zip(who, keys, strict=True)).values())
        want[wide] = same / pairs
    for parts in (1, 7):
        assert media_copies._meetings(feats(0, parts), 3) == (want, len(who))
    met, corners = media_copies._meetings(feats(0, 1).where("n = 0"), 3)
    assert met == {8: 0.5**8, 16: 0.5**16} and corners == 0
    got = [
        {(r["a"] - up, r["b"] - up, r["votes"]) for r in media_copies.candidate_pairs(feats(up, 5), 20, 16, 2).collect()} for up in (0, 10**6)
    ]
    assert got[0] == got[1] != set()


def test_media_links_a_small_crop_of_a_large_image(spark):
    f = texture(7, 400)
    rows = [(0, media_copies.write_pgm(f)), (1, media_copies.write_pgm(f[200:300, 200:300]))]
    table = spark.createDataFrame(rows, "image_id long, image binary")
    assert {r["image_id"]: r["class_id"] for r in media_copies.image_copies(table).collect()} == {0: 0, 1: 0}
    assert media_copies.image_copies(table.limit(0)).count() == 0


def test_quality_ranks_held_out_rows(spark):
    rng = random.Random(3)
    rows = [
        (
            i,
            " ".join(
                rng.choice(["der", "haus", "geht", "weit."]) + (
                    rng.choice(["###", "%%%"]) if i % 2 else ""
                ) for _ in range(rng.randint(5, 80))
            ),
        ) for i in range(300)
    ]
    labels = spark.createDataFrame(
        [(i, 1 - i % 2, 0) for i in range(0, 240)] + [(None, 1, 0), (77777, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    model = quality_classifier.train(docs(spark, rows), labels, learn_from=F.expr("doc_id < 200"))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs(spark, rows + ODD), model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 0) for i in range(200, 300)) and all(0 <= s <= 1 for s in got.values())
    assert quality_classifier.keep_good(docs(spark, rows), model).count() == 150
    one_kind = quality_classifier.train(docs(spark, rows), labels.where("quality = 1"))
    assert {r["score"] for r in quality_classifier.score(docs(spark, rows), one_kind).collect()} == {0.5}


LONG = "A long plain body goes on here, word after word after word. " * 6


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just some text, as plain as can be &amp; more of it.", "just some text, as plain as can be & more of it."),
        ("<nav>menu</nav><div class='ad'>buy</div><article><h1>T</h1><p><b>one\n two<br><p>three</p></article><footer>f</footer>", "T\n\none two\n\nthree"),
        ("<article><p>a</p><aside>no</aside><script>var t='</p>'</script><form>q</form><div class=\"comments\"><p>hi</p></div><p>b &lt; c</p></article>", "a\n\nb < c"),
        (f"<body><header>h</header><div id=cookie-notice>ok?</div><p>{LONG}</p><p>y z.</p><!-- <p>c</p> --></body>", f"{LONG.strip()}\n\ny z."),
        ("<article><p title='a>b'>q</p><script>never ends", "q"),
        ('<div class="content has-sidebar"><article><p>kept</p></article></div>', "kept"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>text</p></article>', "Title\n\ntext"),
        ("<article><p>one one one</p></article><nav><a>Home</a></nav><article><p>two two</p></article>", "one one one\n\ntwo two"),
        (f"<article><a href=x>A teaser</a></article><div><p>{LONG}</p></div>", LONG.strip()),
        (f"<div><a>Home</a> <a>About</a></div><p>{LONG}</p><div><a>Terms</a> <a>Privacy</a></div>", LONG.strip()),
        ("<article><p>an <b>unclosed <i>mark<div>ends</div><li>one<li>two</article>", "an unclosed mark\n\nends\n\none\n\ntwo"),
    ],
)
def test_html_text(page, text):
    assert html_extraction.extract(page) == text


def test_html_scan_equals_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        x = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randint(0, 12))]
        start, end = html_extraction.best_run(x)
        best = max([0.0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])
        assert sum(x[start:end]) == best and (best > 0) == (end > start)


def test_html_scan_over_blocks_equals_the_scan_over_tokens():
    w = html_extraction.DEFAULT
    page = f"<p>{LONG}</p><ul><li><a>x</a><li><a>y</a></ul><p>{LONG}</p><div><a>Terms</a></div><p>End of it, as said.</p>"
    found, _ = html_extraction.blocks(page, w)
    sequence = [
        v for k, b in enumerate(found) for v in [(k, w["tag"])] * b.tags + [(k, html_extraction._value(b, w))] * b.words
    ]
    start, end = html_extraction.best_run(html_extraction.scored(found, w))
    best = max(
        sum(v for _, v in sequence[i:j]) for i in range(0, len(sequence), 3) for j in range(i + 1, len(sequence) + 1, 3)
    )
    assert sum(html_extraction.scored(found, w)[start:end]) >= best - 3 * 3 and (start, end) == (0, 6)
    assert "Terms" not in html_extraction.extract(page)


@pytest.mark.parametrize(
    "piece", ["<a ", "<", "<p title=\"", "<p a='x>", "<script>", "<!-- ", "<div>", "</p>", "<b>x</i>", "&#x", "x "]
)
def test_html_takes_linear_time(piece):
    began = time.perf_counter()
    html_extraction.extract(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 10


def test_html_learns_weights_and_finds_unmarked_text(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("der die haus baum geht weit und rot".split()) for _ in range(n)) + "."
    pages, want = [], {}
    for i in range(60):
        body = [say(rng.randint(15, 40)) for _ in range(rng.randint(2, 5))]
        article = "".join(f"<p>{t}</p>" for t in body)
        box, menu = ("article", "nav") if i % 2 else ("div", "div")
        pages.append(
            (
                i,
                "u",
                f"<{menu}><ul>" + "<li><a>los</a></li>" * 8 + f"</ul></{menu}><div class=promo-box>{say(6)}</div><{box}>{article}</{box}><div><a>{say(3)}</a></div>",
                1,
            )
        )
        want[i] = "\n\n".join(body)
    table = spark.createDataFrame(
        [*pages, (None, None, None, 1), (3, "again", pages[3][2], 1)],
        "page_id long, url string, html string, n_chars int",
    )
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extraction.extract_main_text(table).collect()]
    assert collections.Counter(got) == collections.Counter(
        [*((i, t, len(t)) for i, t in want.items()), (None, "", 0), (3, want[3], len(want[3]))]
    )
    learned = html_extraction.learn_weights(table)
    assert learned["paragraph"] > 0 > learned["link most"] and learned["tag"] < 0
    assert html_extraction.extract_main_text(table.limit(0)).count() == 0


def test_removed_lines_leave_the_others_and_every_column(spark):
    rows = [
        (1, "one line that is long enough to be taken, by all means, truly\nb\n"),
        (2, "b\none line that is long enough to be taken, by any means, truly"),
        (3, None),
        (None, "b"),
        (4, ""),
    ]
    table = docs(spark, rows).withColumns({"_gone": F.lit(1), "key": F.lit("k"), "a.b": F.lit(0)})
    out = line_dedup.remove_lines(table, max_edits=3, min_bytes=0)
    assert out.columns == table.columns
    got = {r["doc_id"]: (r["text"], r["_gone"], r["key"]) for r in out.collect()}
    # lines of at most three bytes are all near each other; the first of them stands in document 1
    assert got == {
        1: (rows[0][1][:-1], 1, "k"), 2: ("", 1, "k"), 3: (None, 1, "k"), None: ("b", 1, "k"), 4: ("", 1, "k")
    }


def test_shards_are_the_same_on_any_layout_and_files_hold_them(spark, tmp_path):
    rng = random.Random(9)
    rows = [
        (i, "t" * rng.randint(0, 400)) for i in range(300)
    ] + [(7, "twice")] * 9 + [(None, None)] * 4 + [(5, "x" * 300_000)]
    table = docs(spark, rows).withColumns(
        {"row": F.lit(1), "place": F.lit(2), "_id": F.lit(3), "a.b": F.lit(4)}
    ).repartition(5)
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for parts, adaptive in (("4", "true"), ("1", "false"), ("9", "true")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            for deal in (sharding.assign_shards, sharding.shard_documents):
                out = deal(table, bucket_bytes=8 << 10, most_copies=4)
                seen.append(
                    sorted(
                        (
                            r["shard"], r["slot"], r["doc_id"] or -1
                        ) for r in out.select("shard", "slot", "doc_id").collect()
                    )
                )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert all(x == seen[0] for x in seen) and len(seen[0]) == len(rows)
    path = str(tmp_path / "shards")
    sharding.write_shards(table, path, bucket_bytes=8 << 10, most_copies=4)
    back = spark.read.parquet(path)
    assert sorted(
        (r["shard"], r["slot"], r["doc_id"] or -1) for r in back.select("shard", "slot", "doc_id").collect()
    ) == seen[0]
    assert set(table.columns) <= set(back.columns) and sharding.shard_documents(table.limit(0)).count() == 0
    for f in back.select(F.input_file_name().alias("f")).distinct().collect():
        slots = [r["slot"] for r in spark.read.parquet(f["f"]).collect()]
        assert slots == sorted(slots)


def test_one_of_each_group_stays_beside_any_columns(spark):
    rows = near_copies(copies=20)
    table = docs(spark, rows).withColumns({"goes": F.lit(1), "rows": F.lit("r"), "Key": F.lit(2), "a.b": F.lit(3)})
    out = ngram_jaccard_join.keep_one_per_group(table, bitmap_bits=16)
    groups = brute_groups(rows, 5, 8, 10)
    assert out.columns == table.columns
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == sorted(
        i for i, (_, c) in groups.items() if c == i
    )
    assert {
        (r["goes"], r["rows"], r["Key"]) for r in out.collect()
    } == {(1, "r", 2)} and ngram_jaccard_join.keep_one_per_group(table.limit(0), bitmap_bits=16).count() == 0


def test_quality_edges(spark):
    rows = [(i, ("gut und schön. " * 9) if i % 2 else "#!% " * 9) for i in range(80)] + ODD + [(3, "again")]
    table = docs(spark, rows).withColumns({"score": F.lit(1), "quality": F.lit("q")})
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(60)] + [(1, None, None)], "doc_id long, quality int, toxic int"
    )
    model = quality_classifier.train(table, labels)
    scores = [r["score"] for r in quality_classifier.score(table, model).collect()]
    assert len(scores) == len(rows) and all(0 <= x <= 1 for x in scores)
    kept = quality_classifier.keep_good(table, model)
    assert kept.columns == table.columns and kept.where(
        "doc_id between 60 and 79 and doc_id % 2 = 0"
    ).count() == 0 and kept.where("doc_id between 60 and 79").count() == 10
    assert quality_classifier.score(
        table.limit(0), model
    ).count() == 0 and quality_classifier.keep_good(table.limit(0), model).count() == 0
    none = quality_classifier.train(table.limit(0), labels)
    assert {r["score"] for r in quality_classifier.score(table, none).collect()} == {0.5}


def test_each_pipeline_stage_equals_a_plain_version(spark):
    """Quality against the scores, near duplicates and benchmark against brute force, mixing against raking in numpy, shards against the slots."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    rows = lambda df: [tuple(r) for r in df.collect()]
    read = lambda found, like: spark.createDataFrame(found, like.schema)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    good = rows(p.quality(spark, d, sf))
    scores = {r["doc_id"]: r["score"] for r in queries.op9_quality(spark, sf).collect()}
    assert sorted(r[0] for r in good) == sorted(i for i, s in scores.items() if s >= 0.5)
    one = rows(p.near_duplicates(spark, read(good, d), sf))
    want = brute_groups([(r[0], r[1]) for r in good], 5, 8, 10)
    assert sorted(r[0] for r in one) == sorted(i for i, (_, c) in want.items() if c == i)
    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words_of(r["text"])
        n = min(13, len(w))
        grams |= {tuple(w[j : j + n]) for j in range(len(w) - n + 1 if w else 0)}
    free = rows(p.benchmark_free(spark, read(one, d), sf))
    clean = [r for r in one if not (h := hits_of(r[1], grams)) or 20 * len(h) < len(words_of(r[1]))]
    assert sorted(map(str, free)) == sorted(map(str, clean)) and 0 < len(clean) < len(good)
    kept = rows(p.mixed(spark, read(free, d), sf))
    drawn = {r["doc_id"]: r for r in source_mixing.sample_mix(read(free, d)).collect()}
    fitted, total = collections.Counter(), 0
    for r in drawn.values():
        fitted[r["source"], r["language"], r["topic"]] += r["tokens"]
        total += r["tokens"]
    tokens, goals = dict(fitted), []
    for k, m in enumerate(source_mixing.MARGINS):
        part = collections.Counter()
        for c, n in tokens.items():
            part[c[k]] += n / total
        part = {v: x ** source_mixing.TEMPER[m] for v, x in part.items()}
        goals.append({v: x / sum(part.values()) * total for v, x in part.items()})
    for _ in range(60):
        for k, goal in enumerate(goals):
            now = collections.Counter()
            for c, x in fitted.items():
                now[c[k]] += x
            for c in fitted:
                fitted[c] *= goal[c[k]] / now[c[k]] if now[c[k]] else 0
    top = max(fitted[c] / n for c, n in tokens.items() if n)
    chance = lambda r: (lambda c: fitted[c] / tokens[c] / top if tokens[c] else 1.0)((r["source"], r["language"], r["topic"]))
    lot = lambda i: int(hashlib.md5(f"11:{i}".encode()).hexdigest()[:8], 16) / 2**32
    assert sorted(r[0] for r in kept) == sorted(i for i, r in drawn.items() if lot(i) < chance(r))
    last = p.shards(spark, read(kept, d), sf).collect()
    slots = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign_shards(read(kept, d)).collect()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in last} == slots and sorted(
        str(tuple(r)[:5]) for r in last
    ) == sorted(str(r[:5]) for r in kept)


def test_pipeline_runs_and_takes_an_empty_table(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    out = p.run(spark, sf)
    assert out.count() > 20 and {"shard", "slot", "bucket", "text", "lang"} <= set(out.columns)
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        out = stage(spark, docs_, sf)
        docs_ = spark.createDataFrame(out.collect(), out.schema)
    assert docs_.count() == 0


def test_very_long_texts(spark):
    rng = random.Random(12)
    words_ = [f"w{k}" for k in range(5000)]
    item = " ".join(rng.choice(words_) for _ in range(20))
    long = " ".join(rng.choice(words_) for _ in range(150_000))
    rows = [
        (1, long),
        (2, long + " and more"),
        (3, f"{long[:400_000]} {item} {long[400_000:]}"),
        (4, "\n".join([long, "short", long[:-1] + "x"])),
        (5, "x" * 1_000_000),
    ]
    table = docs(spark, rows)
    report = {
        r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.contamination_report(
            table, spark.createDataFrame([(1, item)], "item_id long, text string")
        ).collect()
    }
    assert report == {i: (len(words_of(t)), 20 if i == 3 else 0) for i, t in rows}
    lines = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_dedup_counts(table, min_bytes=0).collect()}
    assert lines == {1: 0, 2: 0, 3: 0, 4: 2, 5: 0}
    groups = {
        r["doc_id"]: r["component_id"] for r in ngram_jaccard_join.ngram_jaccard_groups(table, bitmap_bits=16).collect()
    }
    assert (groups[1], groups[2], groups[5]) == (1, 1, 5)
    model = quality_classifier.train(
        table, spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    )
    score = {r["doc_id"]: r["score"] for r in quality_classifier.score(table, model).collect()}
    assert score[2] > 0.5 > score[5]
    url = "http://" + "a." * 50_000 + "example.com/en/" + "7" * 100_000
    rules = spark.createDataFrame(queries.URL_RULES, "verdict string, host string, path string")
    got = url_filter.url_verdicts(spark.createDataFrame([(1, url)], "page_id long, url string"), rules).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("example.com/en/7", "allow")]
    page = f"<nav>menu</nav><article><p>{long}</p><p>end</p></article>"
    assert html_extraction.extract(page) == f"{long}\n\nend"
    mixed = {r["doc_id"]: r["tokens"] for r in source_mixing.sample_mix(table).collect()}
    assert mixed[1] == 150_000 and mixed[5] == 1


def test_null_columns_and_repeated_rows(spark):
    none = docs(
        spark,
        [
            (1, None),
            (1, None),
            (None, None),
            (None, "a text of some words, and more of them, to the end of the line and on"),
        ] * 2,
    ).select("doc_id", "text", F.lit(
        None
    ).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "n")
    bench = spark.createDataFrame(
        [(None, "a text of some words, and more of them, to the end of the line and on"), (2, None)],
        "item_id long, text string",
    )
    assert decontamination.contamination_report(none, bench).where("contaminated").count() == 2
    assert suffix_dedup.remove_repeats(
        none
    ).count() == line_dedup.line_dedup_counts(none).count() == sharding.assign_shards(none).count() == source_mixing.sample_mix(none).count() == 8
    vectors = spark.createDataFrame(
        [(1, None), (2, []), (3, [0.5] * 64), (3, [0.5] * 64), (None, [0.1] * 64), (4, [None, 1.0])],
        "vec_id long, embedding array<double>",
    )
    got = media_copies.image_copies(media_copies.pictures(vectors, "vec_id", "embedding")).collect()
    assert len(got) == 6 and {
        r["image_id"]: r["class_id"] for r in got if r["image_id"] in (1, 2, 3)
    } == {1: 1, 2: 2, 3: 3}
    pages = spark.createDataFrame(
        [(None, None), (1, None), (1, "http://x.com/en/"), (1, "http://x.com/en/")], "page_id long, url string"
    )
    rules = spark.createDataFrame(
        [(None, "com", "/"), ("block", "com", None), ("block", "com", "/en/"), ("block", "com", "/en/")],
        "verdict string, host string, path string",
    )
    assert sorted(r["verdict"] for r in url_filter.url_verdicts(pages, rules).collect()) == [
        "allow", "allow", "block", "block"
    ]
    assert url_filter.url_verdicts(
        pages, rules.limit(0)
    ).where("verdict = 'allow'").count() == 4 and url_filter.url_verdicts(pages.limit(0), rules).count() == 0
