"""Contiguous shards of near equal byte size (prefix sums over the whole table).

Documents are ordered by doc_id (ties by text checksum). Per-partition byte
totals give each document the bytes before it; the document goes to the shard in
which its middle byte falls when the whole is cut at equal targets.

Defined cases: null text has size 1 and checksum 0; null doc_ids sort first;
repeated rows are separate rows of the same shard or of neighbours; an empty table
gives no rows; a document larger than a target leaves later shards short or empty.
Other input columns are ignored. Only (doc_id, size, checksum) is moved.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranks import in_order


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard, from 0)."""
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed, totals = in_order(sized, ["doc_id", "text_crc32", "size"], ["size"])
    total = max(1, totals["size"])
    # middle byte: 2 * (bytes before) + size, in units of half a byte
    shard = F.least(F.lit(shards - 1), F.floor(
        (F.col("_before_size") * 2 + F.col("size")).cast("decimal(38,0)") * shards / F.lit(2 * total))).cast("int")
    placed = placed.withColumn("shard", shard)
    # shards are contiguous: the first row of a shard starts its slots
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return (placed.join(F.broadcast(first), "shard")   # at most `shards` rows
                  .select("doc_id", "size", "text_crc32", "shard",
                          (F.col("_row") - F.col("_first")).alias("slot")))
