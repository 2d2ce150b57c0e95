"""Explicit row positions.

Spark frames have no row order, while heads, tails, mirrors and "first seen" need one. Every
dataset therefore carries ``_pos``, dense from 0.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from rowecho.functions.draws import draw_key

POS = "_pos"

# A monotonically increasing id holds the partition number above its low 33 bits.
_ROW_BITS = 33
_BUCKET_DIGITS = 4  # 65,536 hash buckets


def with_positions(df: DataFrame, key: str | None = None) -> DataFrame:
    """Add ``_pos``: from a dense 0-based ``key`` column (free), else from file order.

    File order is that of the files' paths, and inside a file that of its bytes, however Spark packs
    splits into tasks. It needs no global sort: one narrow pass counts the rows of each split, the
    counts become start offsets, and a row's position is its split's offset plus its place in
    the split. The offset table has one row per split and is what gets broadcast. Use it directly
    on a file scan, whose splits are the same in both passes; a frame that is none is numbered by
    its partitions.
    """
    if key is not None:
        return df.withColumn(POS, F.col(key).cast("bigint"))
    try:
        split = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
        numbered = df.select("*", *split, F.monotonically_increasing_id().alias("_id"))
    except AnalysisException:  # not a scan of files
        identity = F.monotonically_increasing_id()
        numbered = df.select("*", F.lit("").alias("_path"), F.shiftright(identity, _ROW_BITS).alias("_start"),
                             identity.alias("_id"))
    counts = numbered.groupBy("_path", "_start").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    # one row per split: bounded by the number of input splits, not by their rows
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_path", "_start", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        numbered.join(F.broadcast(offsets), ["_path", "_start"])
        .withColumn(POS, F.col("_offset") + F.col("_id") - F.col("_first"))
        .drop("_path", "_start", "_first", "_offset", "_id")
    )


def seeded_shuffle(df: DataFrame, seed: int | str) -> DataFrame:
    """Whole-table shuffle: ``_pos`` is replaced by the rank of the row's draw.

    The rank is found without a global sort. Draws are uniform, so their leading hex digits cut
    the table into even buckets; the rank is the bucket's offset plus the rank inside it.
    """
    drawn = df.withColumn("_draw", draw_key(seed, F.col(POS))).withColumn(
        "_bucket", F.substring("_draw", 1, _BUCKET_DIGITS)
    )
    counts = drawn.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    # at most 65,536 rows whatever the table size
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy("_draw", POS)
    return (
        drawn.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(POS, (F.col("_offset") + F.col("_rank")).cast("bigint"))
        .drop("_draw", "_bucket", "_rank", "_offset")
    )
