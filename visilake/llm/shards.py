"""Contiguous shards of nearly equal bytes from global prefix sums of document sizes.

The law is ``bytes``: documents stay in ascending id order, and a document goes to the shard in
which the middle of its bytes falls when the whole corpus is cut at equal targets. A shard can
differ from the target by half a document at each end. Texts never move: only (id, size,
checksum) rows are dealt by range; a partition's total joins the totals of those before it.

Null text counts as empty (size 1). Rows of equal id are ordered by checksum and size, equal
rows are interchangeable. A null id sorts first. A very long text is one row of its size and may fill
more than a shard's share alone. An empty table gives no rows; columns of other names play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import before_blocks, in_blocks, whole_text


def shard_by_bytes(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole_text(text)).cast("bigint") + 1).alias("size"),
        F.crc32(whole_text(text)).alias("text_crc32"),
    )
    order = ("doc_id", "text_crc32", "size")
    blocks = in_blocks(rows, *order)
    totals = blocks.groupBy("block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    inside = W.partitionBy("block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = blocks.select(*order, "block", F.sum("size").over(inside).alias("_upto"), F.count(F.lit(1)).over(inside).alias("_row"))
    placed = running.join(before_blocks(totals, "size", "rows"), "block").select(
        *order,
        (F.col("rows_before") + F.col("_row") - 1).alias("_place"),
        # twice the position of the document's middle, against twice the total
        F.least(F.lit(shards - 1), F.expr(f"(2 * (size_before + _upto) - size) * {shards} div (2 * size_all)")).cast("int").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_place") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
