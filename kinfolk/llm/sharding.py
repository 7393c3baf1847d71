"""Sharding by jump consistent hashing, with gapless slots. DataFrame and SQL functions only.

A key visits buckets 0 = b0 < b1 < ...; from bucket b it jumps to floor((b + 1) / u) for the next
uniform u of the key's own stream, and stays in the last bucket below the shard count. There is no
ring table, and appending a shard moves only rows that now land in the new shard. The stream is
``xxhash64(key, step)``: the same law as the published multiplicative generator, but free of 64-bit
overflow, which ANSI mode rejects.

Slots are dealt without gathering a shard in one task: rows fall into many buckets, are numbered
within (shard, bucket), and the small table of counts gives each bucket its first slot.

Defined results
---------------
* A null key is a key of its own (all such rows share a shard). Repeated keys share a shard.
* Null text: size 1 (no bytes, plus 1) and the CRC of no bytes, 0.
* Empty input gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.llm.storage import stored

#: Rows with equal keys are spread over so many slot buckets.
SALTS = 64


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a key, by jump consistent hashing."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def jump(state: Column, step: Column) -> Column:
        # 53 bits of the stream, in (0, 1]: every jump goes up by one at least.
        u = (F.shiftrightunsigned(F.xxhash64(key, step), 11) + F.lit(1)) / F.lit(float(2**53))
        ahead = F.least(F.floor((state["ahead"] + F.lit(1)) / u), F.lit(shards)).cast("int")
        return F.when(state["ahead"] >= shards, state).otherwise(F.struct(state["ahead"].alias("at"), ahead.alias("ahead")))

    def first() -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(0)), 11) + F.lit(1)) / F.lit(float(2**53))
        return F.struct(F.lit(0).alias("at"), F.least(F.floor(F.lit(1) / u), F.lit(shards)).cast("int").alias("ahead"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), first(), jump, lambda s: s["at"])


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    placed = stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("__t"), F.monotonically_increasing_id().alias("__row")).select(
            "doc_id",
            (F.octet_length("__t") + 1).cast("long").alias("size"),
            F.crc32("__t").alias("text_crc32"),
            jump_shard(F.col("doc_id"), shards).alias("shard"),
            jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
            F.pmod(F.xxhash64("doc_id", F.col("__row") % SALTS), F.lit(buckets)).cast("int").alias("bucket"),
            "__row",
        ),
        "shard-rows",
    )
    # At most shards * buckets rows, a bound that does not depend on the data.
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "__row")
    return (
        placed.withColumn("nth", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("first") + F.col("nth")).cast("long").alias("slot"), "grown_shard",
        )
    )
