"""Sharding by global byte-size prefix sums (DataFrame functions only).

Rows are put into one global order by a range partitioning of their small key columns. Each partition's total goes
to a table with one row per partition; its prefix sums place every partition on one line of bytes. A running sum
inside the partition places every row. The line is cut at equal targets: a row belongs to the shard in which the
middle of its bytes lies, so each cut falls on the row boundary nearest to the target, shards are contiguous in the
order, and a shard is off its target by one row's size at most.

Only the key, the size and the checksum are shuffled, never the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_order, offsets, text_or_empty


def shard_by_bytes(df: DataFrame, size: str, keys: list[str], n_shards: int) -> DataFrame:
    """Adds ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless from 0 in every shard).

    ``size`` is a non-null column of positive longs. ``keys`` order the rows and should tell different rows apart.
    Nulls in keys sort first; repeated rows get neighbouring slots; an empty table gives an empty result.
    """
    rows = in_order(df, *keys)
    at = F.broadcast(offsets(rows, _bytes=size))  # one row per partition
    running = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("_upto", F.sum(size).over(running))
        .join(at, "_part")
        .withColumn("_twice_middle", 2 * (F.col("_bytes") + F.col("_upto")) - F.col(size))
        .withColumn("_index", F.col("_rows") + F.col("_pos"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"_twice_middle * {n_shards} div (2 * _bytes_all)")).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("_index") - F.col("_first")).select(*df.columns, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """All ``documents`` in ``n_shards`` shards of nearly equal bytes, in order of doc_id.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 16), text_crc32 (of the UTF-8 text, null as
    empty), law (``bytes``), shard, slot and grown_shard (null under this law). Null doc_ids come first; every row,
    repeated or not, is placed once.
    """
    small = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()).cast("long") + 16).alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    placed = shard_by_bytes(small, "size", ["doc_id", "text_crc32", "size"], n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
