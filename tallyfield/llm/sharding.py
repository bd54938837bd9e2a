"""Contiguous shards of nearly equal bytes: global prefix sums cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.prefix import prefix_sums, range_parts

SHARDS = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every document, by ascending doc_id.

    A document's size is the UTF-8 length of its text (null: none) plus one. It goes to the
    shard that holds the middle of its bytes when the whole byte range is cut into equal
    parts, so shards are contiguous in doc_id and differ by at most the largest document.
    Returns one row per input row: ``doc_id``, ``size``, ``text_crc32``, ``law``
    (``bytes``), ``shard``, ``slot`` (gapless from 0 within the shard) and ``grown_shard``
    (null: the law does not grow by whole keys). Null ids come first; repeated ids and rows
    each get a slot of their own; empty texts have size one; an empty table gives no rows;
    columns other than ``doc_id`` and ``text`` are ignored.
    """
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    parts = range_parts(sized, order)
    total = parts.df.agg(F.sum("size")).first()[0] or 1
    middle = f"cast(((2 * _end - size) * {shards}) div {2 * total} as int)"
    placed = prefix_sums(parts, order, "size").withColumn("shard", F.expr(middle))
    # One row per shard.
    first = placed.groupBy("shard").agg(F.min("_position").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_position") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
