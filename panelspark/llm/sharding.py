"""Contiguous shards of near-equal bytes from global prefix sums, in built-in functions only.

Rows are put in id order by a range shuffle of sizes (texts don't move). Totals of the
partitions, summed over the partitions before each, give every row the bytes that stand
before it in the whole table; equal targets over that sum cut the shards. Nothing but one
row for each partition ever meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import materialise, text_or_empty

_ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A row's size is the UTF-8 bytes of its text plus 1 (null: 1). Rows are ordered by id
    (null ids first; equal ids by checksum and size), and a row goes to the shard in whose
    byte range its middle lies, so shards are contiguous and each differs from the equal
    share by less than the largest text. ``slot`` counts from 0 within a shard. Equal texts
    may part: this law balances bytes and keeps no groups together. An empty table gives
    an empty result; with few rows some shards may stay empty.
    """
    text = text_or_empty(text_col)
    sizes = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "shard-sizes",
    )
    order = ["doc_id", "text_crc32", "size"]
    placed = materialise(
        sizes.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", _ROW_BITS))
        .withColumn("row", F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("at"),
        "shard-order",
    )
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    middle = (start * 2 + F.col("size")) * shards
    cut = placed.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(F.floor(middle / F.lit(2 * total)), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("row")).alias("at"),
    )
    firsts = cut.groupBy("shard").agg(F.min("at").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
