"""Sharding by a two-pass external shuffle: every order of the rows is as likely, and shards are equal."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm.cluster import shared_dir

#: Text bytes that one bucket is to hold; a bucket is shuffled in one task's memory.
BUCKET_BYTES = 8 << 20


def _fisher_yates(count: int, seed: int) -> list[int]:
    """The elements 0 .. count - 1 in a random order: each place is exchanged with a random one not after it."""
    order, draw = list(range(count)), random.Random(seed)
    for i in range(count - 1, 0, -1):
        j = draw.randrange(i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def shuffle_rows(docs: DataFrame, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` with ``position long``, a seeded uniform shuffle of all rows, gapless from 0.

    Pass one scatters rows over buckets by a seeded hash of ``doc_id`` and text; pass two sorts each bucket (so
    reruns agree), Fisher-Yates shuffles it and numbers it after the buckets before it. The number of buckets
    follows the bytes of text; where each starts, a number a bucket, is broadcast, so that texts are shuffled once.
    Rows without a ``doc_id``, or with the same, are told apart by their text; only rows equal in both share a bucket.
    Null texts count no bytes. No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weight = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64)).first()[0] or 0
    buckets = max(1, -(-weight // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = rows.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def shuffle(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"], kind="stable", na_position="first", ignore_index=True)
        frame = frame.iloc[_fisher_yates(len(frame), hash((seed, int(key[0]))))].reset_index(drop=True)
        frame["place"] = range(len(frame))
        return frame

    shuffled = rows.groupBy("bucket").applyInPandas(shuffle, "doc_id long, text string, bucket long, place long")
    return shuffled.join(F.broadcast(starts), "bucket").select("doc_id", "text", (F.col("before") + F.col("place")).alias("position"))


def write_shards(docs: DataFrame, folder: str, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shuffled rows as Parquet below ``folder``, one directory a shard, ``slot`` numbering its rows.

    Shards are equal cuts of the shuffled order: their row counts are at most one apart.
    """
    cut = shuffle_rows(docs, seed, bucket_bytes).withColumn("total", F.lit(docs.count())).withColumn("shard", F.expr(f"int((position * {shards}) div greatest(total, 1))"))
    cut = cut.withColumn("slot", F.expr(f"position - (shard * total + {shards} - 1) div {shards}"))
    cut.select("doc_id", "text", "slot", "shard").write.partitionBy("shard").parquet(folder)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """Write ``docs`` into ``shards`` shards in the shared folder and read them back: doc_id, text, shard, slot."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "shards")
    write_shards(docs, folder, shards, seed)
    return spark.read.schema("doc_id long, text string, slot long, shard int").parquet(folder)
