"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets of about ``bucket_bytes`` by seeded hashes of id and text; pass two loads a
bucket at a time, permutes it by the Fisher-Yates method (Spark's ``shuffle``) and gives each record its place. The law
is ``key``: the id and the number of shards decide the shard (highest seeded hash wins), so one more shard takes
records only into itself.

Defined cases: a null text has 8 bytes and the checksum of no bytes; null ids are one key; repeated rows all stay, each
with a slot of its own; an empty table gives an empty result; an input column named like one of the results is replaced.
Buckets are dealt by id, text and place of a row in its file, so that rows that repeat don't share one; a bucket exceeds
``bucket_bytes`` where one text does, or where one id, which has one shard by the law, holds more than its part of the rows:
the number of buckets follows the fullest shard.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, without, written

ADDED = ["size", "law", "shard", "slot", "grown_shard"]


def shard_of(key, shards: int, seed: int):
    """The shard whose seeded hash with ``key`` is the highest."""
    ranked = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("h"), s.alias("s")),
    )
    return F.array_max(ranked)["s"].cast("int")


def record_size(text):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard(
    docs: DataFrame, shards: int = 24, seed: int = 20, bucket_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with size, law, shard, slot (gapless from 0 in a shard) and grown_shard (with one shard more)."""
    kept = without(docs, ADDED)
    row = fresh(kept, "_row")
    by_shard = docs.groupBy(shard_of(F.col(key), shards, seed).alias("_shard")).agg(F.sum(record_size(F.col(text))).alias("_size"))
    fullest = by_shard.agg(F.max("_size")).first()[0] or 0
    per_shard = max(1, math.ceil(fullest / bucket_bytes))
    spot = F.monotonically_increasing_id()
    placed = kept.select(
        shard_of(F.col(key), shards, seed).alias("_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text), spot), F.lit(per_shard)).cast("int").alias("_bucket"),
        F.xxhash64(F.lit(seed + 2), F.col(key), F.col(text), spot).alias("_order"),
        F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias(row),
    )
    placed = written(placed.withColumn("_place", F.col("_shard") * per_shard + F.col("_bucket")), "scattered")  # read twice, so places hold
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_shard", "_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    buckets = (  # a bucket's rows have one order before the permutation, whatever order they arrive in
        placed.repartitionById(shards * per_shard, F.col("_place"))
        .sortWithinPartitions("_place", "_order")
        .groupBy("_place")
        .agg(F.first("_shard").alias("_shard"), F.first("_bucket").alias("_bucket"), F.shuffle(F.collect_list(row), seed).alias("_rows"))
    )
    return (
        buckets.join(F.broadcast(starts), ["_shard", "_bucket"])  # a row a bucket: the texts are not shuffled again
        .select("_shard", "_start", F.posexplode("_rows").alias("_at", row))
        .select(
            f"{row}.*",
            record_size(F.col(f"{row}.{text}")).alias("size"),
            F.lit("key").alias("law"),
            F.col("_shard").alias("shard"),
            (F.col("_start") + F.col("_at")).alias("slot"),
            shard_of(F.col(f"{row}.{key}"), shards + 1, seed).alias("grown_shard"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows lie in slot order inside each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
