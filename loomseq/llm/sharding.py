"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash; pass 2 puts each bucket in an order of
its own by a Fisher-Yates shuffle whose draws come from a hash of seed, bucket and step, and deals the records out from a
running position.  The same records and seed give the same shards, however Spark cuts the work.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.llm.common import cut, scratch_dir

LAW = "rows"
#: What a record counts in a bucket besides its texts; it also bounds the records of a bucket.
OVERHEAD = 4_000


def fisher_yates(n: Column, seed: int, bucket: Column) -> Column:
    """A permutation of 0..n-1: from the last place down, each is exchanged with a drawn place at or before it."""

    def step(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        at, last = F.get(a, j), F.get(a, i)
        between = F.slice(a, j + 2, F.greatest(i - j - 1, F.lit(0)))
        return F.when(j == i, a).otherwise(F.concat(F.slice(a, F.lit(1), j), F.array(last), between, F.array(at), F.slice(a, i + 2, F.greatest(n - i - 1, F.lit(0)))))

    first = F.sequence(F.lit(0), n - 1)
    return F.when(n <= 1, first).otherwise(F.aggregate(F.sequence(n - 1, F.lit(1), F.lit(-1)), first, step))


#: A row with more copies than this is scattered copy by copy.
COPIES, CHUNK = 64, 1_000


def scatter(records: DataFrame, key: str, buckets: int, seed: int) -> DataFrame:
    """Pass 1: (_b, _h, _r), the bucket of each record, the order's hash and the record itself.

    The bucket is a hash of the whole row.  A row with over ``COPIES`` equal copies is counted, with a partial count
    before the shuffle, and dealt out again copy by copy: the copy's number is part of the hash, so that copies fill
    all buckets alike.  Equal rows are interchangeable, so this does not depend on how Spark cuts the work.
    """
    rec = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    named = records.select(F.xxhash64(F.lit(seed + 1), F.col(f"`{key}`")).alias("_h"), F.xxhash64(F.lit(seed), rec).alias("_x"), rec.alias("_r"))
    often = cut(named.groupBy("_x").agg(F.count("*").alias("_c")).where(F.col("_c") > COPIES).select("_x"), "often")
    n = often.count()
    if n:
        # a row hash met this often: at most one in COPIES rows; sent along only while it is small
        few = F.broadcast(often) if n <= 100_000 else often
        copies = named.join(few, "_x", "left_semi").groupBy("_h", "_x", "_r").agg(F.count("*").alias("_c"))
        chunks = copies.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / CHUNK)))).repartition("_x", "_k")
        least = F.col("_k") * CHUNK
        each = chunks.withColumn("_i", F.explode(F.sequence(least, F.least(least + CHUNK, F.col("_c")) - 1)))
        plain = named.join(few, "_x", "left_anti").withColumn("_i", F.lit(0).cast("long")).unionByName(each.drop("_c", "_k"))
    else:
        plain = named.withColumn("_i", F.lit(0).cast("long"))
    return plain.select(F.pmod(F.xxhash64(F.lit(seed), "_x", "_i"), F.lit(buckets)).cast("int").alias("_b"), "_h", "_r")


def shard_records(
    records: DataFrame, key: str = "doc_id", shards: int = 16, seed: int = 42, bucket_bytes: int = 2_000_000
) -> DataFrame:
    """All columns of ``records`` plus ``shard`` (0..shards-1) and ``slot`` (gapless from 0 within the shard).

    Law ``rows``: shard counts differ by at most one.  ``bucket_bytes`` is the mean bucket size; the number of
    buckets follows the bytes of the strings, so a bucket's memory does not grow with the input.  Rows are scattered by a
    hash of the key *and* of the whole row, so that repeated keys do not pile up in a bucket, and copies of a row by their
    number too; equal rows are interchangeable.  Null keys are a value like any other.  An empty table gives an
    empty result.  Columns called ``shard`` or ``slot`` are replaced; all others pass through.
    """
    data = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    records = records.select(*[F.col(f"`{c}`") for c in data])
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in records.dtypes if t in ("string", "binary")]
    total = records.agg(F.sum(sum(wide, F.lit(OVERHEAD).cast("long")))).head()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    scattered = scatter(records, key, buckets, seed)
    # sorting by a hash first makes the bucket's content independent of arrival order, so a rerun gives the same
    gathered = scattered.groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_h", F.xxhash64("_r").alias("_x"), "_r"))).alias("_a"))
    order = gathered.withColumn("_o", fisher_yates(F.size("_a"), seed + 2, F.col("_b")))
    shuffled = order.select("_b", F.transform("_o", lambda i: F.get("_a", i)["_r"]).alias("_a"))
    # running positions of the buckets, in two levels: no task sees all of them
    counts = scattered.groupBy("_b").agg(F.count("*").alias("_c")).withColumn("_s", F.floor(F.col("_b") / 10_000))
    upper = counts.groupBy("_s").agg(F.sum("_c").alias("_t"))
    upper = upper.select("_s", (F.sum("_t").over(Window.orderBy("_s")) - F.col("_t")).alias("_from"))
    inner = counts.select("_b", "_s", (F.sum("_c").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_c")).alias("_in"))
    starts = inner.join(upper, "_s").select("_b", (F.col("_from") + F.col("_in")).alias("_start"))
    dealt = shuffled.join(F.broadcast(starts) if buckets <= 100_000 else starts, "_b").select(
        "_start", F.posexplode("_a").alias("_p", "_r")
    )
    at = F.col("_start") + F.col("_p")
    return dealt.select(
        "_r.*", F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; each task of the deal adds a file to it, in slot order.

    Nothing is exchanged once more: as many tasks write as deal, whatever the number of shards.
    """
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(sharded: DataFrame, path: str) -> DataFrame:
    """The records written by ``write_shards``, with the columns of ``sharded``."""
    back = sharded.sparkSession.read.schema(sharded.schema).parquet(path)
    return back.select(*[F.col(f"`{c}`") for c in sharded.columns])


def shard_digest(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """The digest of a sharding of documents: shards are written with their texts to a folder of their own beside the
    scratch tables, and ids, sizes and checksums are taken from what the files hold.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    dealt = shard_records(docs.select("doc_id", "text"), "doc_id", shards, seed)
    path = f"{scratch_dir(docs.sparkSession)}/loomseq-shards-{uuid.uuid4().hex}"
    write_shards(dealt, path)
    return read_shards(dealt, path).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
