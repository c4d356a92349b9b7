"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters records by a seeded hash into as many buckets as hold about `bucket_bytes` each. Pass two gathers a
bucket, puts it in hash order, permutes it with Spark's own `shuffle`, a seeded Fisher-Yates, and writes it. Bucket after
bucket, the permuted records are dealt to the shards in turn: the law is `rows`, counts are at most one apart.

A record's hash covers all its columns: only rows that are equal throughout must share a bucket.

Defined results: a null text counts 16 bytes and the checksum of nothing; repeated rows are dealt each; a null doc_id
takes part; an empty table gives no rows; all columns of the caller are carried in one struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHARDS, SEED, BUCKET_BYTES = 40, 20_251, 8 << 20


def shard(docs: DataFrame, size: Column, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """row (a struct of all columns of docs), shard and slot (gapless from 0 in each shard). size: of each record, what buckets go by."""
    total = docs.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-int(total) // bucket_bytes))
    # all columns count, so neither a hot key nor rows without one gather in a bucket
    scattered = docs.select(F.xxhash64(F.lit(seed), *docs.columns).alias("hash"), F.struct(*docs.columns).alias("row")).withColumn("bucket", F.pmod("hash", F.lit(n)).cast("int"))
    # the partition count is fixed and buckets are in order, so that the permutation is the same in every run
    gathered = scattered.repartition(n, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("hash", "row"))).alias("rows")).sortWithinPartitions("bucket")
    # written once, the permutation is the same whatever columns are asked for and however often
    shuffled = C.saved(gathered.select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows")), "op8-buckets")
    dealt = shuffled.select("bucket", F.posexplode("rows").alias("at", "one"))
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    before = counts.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at")
    # a row per bucket; the records must not move once more to meet them
    return dealt.join(F.broadcast(before), "bucket").select(F.col("one.row").alias("row"), (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 16


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole records, one folder per shard, each sorted by slot: columns row (all of docs), slot and the folder's shard."""
    shard(docs, record_size(F.col("text")), shards=shards).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # whole records are moved, sized and dealt; the digest is of the texts as they lie in their shards
    dealt = shard(docs, record_size(F.col("text")))
    size, text = record_size(F.col("row.text")), F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return dealt.select(F.col("row.doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
