"""Contiguous balanced shards from global byte-size prefix sums.

Rows are laid out in one total order; per-partition byte totals become offsets, so every
row knows how many bytes come before it. The byte range is cut at equal targets and a row
belongs to the range that holds its middle byte: shards are contiguous in the order, and
each differs from the mean by less than one row's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqspark.llm.common import stored, table
from seqspark.operators.ordering import running

ROW_OVERHEAD = 8


def byte_shards(df: DataFrame, order: list[str], text: str, shards: int, keep: list[str] | None = None, overhead: int = ROW_OVERHEAD) -> DataFrame:
    """Shard, slot and size of every row.

    Returns ``order`` and ``keep`` columns with ``size`` (UTF-8 bytes plus ``overhead``; a
    null text has none), ``text_crc32`` (null text: 0), ``shard`` (0 to ``shards - 1``) and
    ``slot`` (gapless from 0 inside the shard, in order). Null keys come first; rows equal
    in ``order`` are placed by checksum and size; equal rows are interchangeable. Fewer
    rows than shards leave some shards empty; an empty table gives no rows. Other columns
    are not read, so their names do not matter.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + overhead
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0))
    sized = stored(df.select(*order, *(keep or []), size.alias("size"), crc.alias("text_crc32")), "sizes")
    sums = {"_end": F.col("size"), "_row": F.lit(1).cast("bigint")}
    rows = running(sized, [*order, "text_crc32", "size"], sums)
    total = sized.agg(F.sum("size")).first()[0] or 1
    rows = rows.withColumn("shard", F.expr(f"cast((2 * _end - size) * {shards} div {2 * total} as int)"))
    # One row per shard.
    firsts = rows.groupBy("shard").agg(F.min("_row").alias("_first"))
    rows = rows.join(F.broadcast(firsts), "shard")
    return rows.select(*order, *(keep or []), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def op1_byte_shards(spark, sf_dir) -> DataFrame:
    rows = byte_shards(table(spark, sf_dir, "documents"), ["doc_id"], "text", 24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
