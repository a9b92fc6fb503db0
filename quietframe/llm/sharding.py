"""Sharding by global byte-size prefix sums (native: SQL functions only).

Rows are put in order of their id, dealt to contiguous blocks, and every
block's total is added up.  The prefix sum of a row is the sum of the blocks
before its own plus its running sum within the block; no window ever covers
more than one block.  Cutting the global prefix sum at equal targets gives
contiguous shards whose sizes differ by about one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to one of ``n_shards`` contiguous shards of near-equal bytes.

    Returns ``(id, size, text_crc32, before, shard, slot)``: ``size`` is the
    UTF-8 length plus one (a null text counts as no bytes, so 1; its checksum
    is null), ``before`` the bytes of all earlier rows, ``slot`` the row's
    place in its shard, without gaps.  A row belongs to the shard that holds
    its midpoint, so a shard misses its target by at most one document.

    Order: id (nulls first), then checksum, then size, so repeated ids and
    repeated rows have a defined place; rows equal in all three are
    interchangeable.  An empty table gives no rows.  Other columns are not
    read, whatever their names.  A document longer than a target leaves
    shards empty rather than being cut.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("crc"),
    )
    # Spark's range partitioner balances rows even when ids are sparse; the block a row got is written down
    # because sampling may choose other bounds when it runs again.
    dealt = slim.repartitionByRange(partitions(spark), F.col("id").asc_nulls_first(), "crc", "size")
    dealt = staged(dealt.withColumn("block", F.spark_partition_id()))
    order = [F.col("id").asc_nulls_first(), "crc", "size"]
    totals = dealt.groupBy("block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # One row per block: as many as there are shuffle partitions, whatever the input.
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "block",
        F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    within = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumn("upto", F.sum("size").over(within))
        .withColumn("nth", F.count(F.lit(1)).over(within))
        .join(F.broadcast(offsets), "block")
        .withColumn("before", F.col("bytes_before") + F.col("upto") - F.col("size"))
        .withColumn("position", F.col("rows_before") + F.col("nth") - 1)
        .withColumn("shard", F.expr(f"cast(((2 * before + size) * {n_shards}) div (2 * total) as int)"))
        .select("id", "size", "crc", "before", "position", "shard")
    )
    firsts = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "before",
        "shard",
        (F.col("position") - F.col("first")).alias("slot"),
    )
