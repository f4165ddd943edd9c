"""Sharding: a two-pass external shuffle in DataFrame functions.

Pass 1 scatters records over the buckets of their shard by seeded hashes. A shard is
chosen by rendezvous hashing of doc_id alone (law "key"): the shard with the largest hash
of (doc_id, shard) wins, so one more shard takes rows only into itself. Each shard has as
many buckets as keep a bucket's expected size, `record_bytes` a row added, within
`bucket_bytes`; the bucket comes from another hash of doc_id and the text's checksum.
Pass 2 permutes each bucket by a Fisher-Yates shuffle (Spark's `shuffle` with a seed) and
numbers the rows through the shard without gaps.

One exchange sends each bucket to the partition of its own number, sorted; so the seeded
draws of a bucket depend on the seed and the data alone, not on the number of shuffle
partitions, adaptive execution or the order of tasks. Texts move once.

Null texts have size 1 and checksum 0; a null doc_id is a key like any other; repeated rows
each get a slot of their own. Rows equal in doc_id and checksum are counted before anything
is sent; beyond `most_copies` of them they are dealt over several buckets, so no bucket
outgrows its task. An empty table gives no rows. Extra columns are untouched, except that
shard_documents replaces columns named shard, slot and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import col, materialize

#: A bucket's offsets are broadcast up to this many buckets (24 bytes each), else joined by shuffle.
BROADCAST_BUCKETS = 500_000


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous shard of a key column."""
    votes = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(
            F.xxhash64(F.lit(seed), key.cast("string"), s).alias("vote"), s.alias("shard")
        )
    )
    return F.array_max(votes)["shard"].cast("int")


def _deal(
    rows: DataFrame, keys: DataFrame, shards: int, seed: int, bucket_bytes: int, record_bytes: int, most_copies: int
) -> DataFrame:
    """rows(id, crc, shard, copy, row) -> (shard, bucket, slot, row); keys(id, crc, size, shard, copies) counts them."""
    total = keys.agg(F.sum(F.col("copies") * (F.col("size") + record_bytes))).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))

    def bucket(part):
        return F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id").cast("string"), "crc", part), F.lit(buckets)).cast("int")

    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / most_copies)))
    counted = keys.select("id", "crc", "shard", "copies", parts.alias("part"))
    held = F.least(F.lit(most_copies).cast("long"), F.col("copies") - F.col("part") * most_copies)
    counted = counted.groupBy("shard", bucket(F.col("part")).alias("bucket")).agg(F.sum(held).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counted.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    few = shards * buckets <= BROADCAST_BUCKETS
    sent = rows.withColumn("bucket", bucket(F.floor(F.col("copy") / most_copies)))
    sent = sent.withColumn("place", (F.col("shard") * F.lit(buckets) + F.col("bucket")).cast("int"))
    sent = sent.repartitionById(shards * buckets, F.col("place")).sortWithinPartitions("place", "id", "crc", "row")
    piles = sent.groupBy("place", "shard", "bucket").agg(F.collect_list("row").alias("pile"))
    piles = piles.select("shard", "bucket", F.posexplode(F.expr(f"shuffle(pile, {seed})")).alias("at", "row"))
    slot = (F.col("ahead") + F.col("at")).cast("long")
    return piles.join(F.broadcast(ahead) if few else ahead, ["shard", "bucket"]).select(
        "shard", "bucket", slot.alias("slot"), "row"
    )


def _keyed(docs: DataFrame, shards: int, seed: int) -> list[Column]:
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    return [
        F.col("doc_id").alias("id"),
        size.alias("size"),
        crc.alias("crc"),
        shard_of(F.col("doc_id"), shards, seed).alias("shard"),
    ]


def _keys(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    return materialize(
        docs.select(*_keyed(docs, shards, seed)).groupBy("id", "crc", "size", "shard").agg(
            F.count(F.lit(1)).alias("copies")
        ),
        "shardkeys",
    )


def assign_shards(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 2026,
    bucket_bytes: int = 16 << 20,
    record_bytes: int = 64,
    most_copies: int = 50_000,
) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard, bucket."""
    keys = _keys(docs, shards, seed)
    record = F.struct(F.col("id").alias("doc_id"), F.col("crc").alias("text_crc32"), "size")
    rows = keys.select(
        "id",
        "crc",
        "shard",
        record.alias("row"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"),
    )
    dealt = _deal(rows, keys, shards, seed, bucket_bytes, record_bytes, most_copies)
    out = dealt.select("row.doc_id", "row.size", "row.text_crc32", F.lit("key").alias("law"), "shard", "slot", "bucket")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        "law",
        "shard",
        "slot",
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
        "bucket",
    )


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 2026,
    bucket_bytes: int = 16 << 20,
    record_bytes: int = 64,
    most_copies: int = 50_000,
) -> DataFrame:
    """docs with shard, slot and bucket beside its own columns (columns of those names are replaced); the slots of assign_shards."""
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot", "bucket")]
    keys = _keys(docs, shards, seed)
    rows = docs.select(
        *_keyed(docs, shards, seed), F.struct(*[col(c) for c in own]).alias("row"), F.lit(0).cast("long").alias("copy")
    )
    many = keys.where(F.col("copies") > most_copies).select("id", "crc")
    if many.limit(1).count():  # only rows of these keys are numbered
        same = rows.id.eqNullSafe(F.col("m.id")) & (rows.crc == F.col("m.crc"))
        one = Window.partitionBy("id", "crc").orderBy("shard")
        numbered = rows.join(many.alias("m"), same, "left_semi").withColumn(
            "copy", (F.row_number().over(one) - 1).cast("long")
        )
        rows = rows.join(many.alias("m"), same, "left_anti").unionByName(numbered)
    dealt = _deal(rows.drop("size"), keys, shards, seed, bucket_bytes, record_bytes, most_copies)
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in own], "shard", "slot", "bucket")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write each shard as a folder of Parquet; a file holds one bucket, rows in slot order. Texts aren't sent again."""
    shard_documents(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
