"""Exact-row membership: does a row equal some row of the dataset on all columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowecho.functions.draws import HEX_DIGITS
from rowecho.operators.rows import column

BITS_PER_ROW = 16
BITMAP_BITS = 1 << 15  # of one bitmap, as ``bitmap_construct_agg`` makes them


def _same(columns: Sequence[str], null_safe: bool) -> Column:
    condition = F.lit(True)
    for name in columns:
        left, right = F.col(f"c.`{name}`"), F.col(f"d.`{name}`")
        condition = condition & (left.eqNullSafe(right) if null_safe else left == right)
    return condition


def row_set(dataset: DataFrame, columns: Sequence[str], among: DataFrame | None = None,
            null_safe: bool = True) -> DataFrame:
    """The dataset's distinct rows: copies are merged on the map side, so a row that fills a
    third of the table does not weigh on a join.

    ``among`` keeps only rows that are asked about. When those are few, Spark broadcasts them
    and the dataset is filtered in its scan instead of being shuffled.
    """
    rows = dataset.select(*[column(c) for c in columns])
    if among is not None:
        asked = among.select(*[column(c) for c in columns]).distinct()
        rows = rows.alias("c").join(asked.alias("d"), _same(columns, null_safe), "left_semi")
    return rows.distinct()


def members(rows: DataFrame, dataset: DataFrame, columns: Sequence[str], null_safe: bool = True) -> DataFrame:
    """Rows that are in the dataset. ``null_safe=False``: a row with a missing value never is."""
    known = row_set(dataset, columns)
    return rows.alias("c").join(known.alias("d"), _same(columns, null_safe), "left_semi")


def non_members(rows: DataFrame, dataset: DataFrame, columns: Sequence[str], null_safe: bool = True) -> DataFrame:
    known = row_set(dataset, columns)
    return rows.alias("c").join(known.alias("d"), _same(columns, null_safe), "left_anti")


def tag_members(rows: DataFrame, dataset: DataFrame, columns: Sequence[str], null_safe: bool = True,
                few: bool = False) -> DataFrame:
    """Add ``is_member``. ``few``: the rows are few next to the dataset."""
    known = row_set(dataset, columns, rows if few else None, null_safe).withColumn("_hit", F.lit(True))
    joined = rows.alias("c").join(known.alias("d"), _same(columns, null_safe), "left")
    return joined.select("c.*", F.coalesce(F.col("d._hit"), F.lit(False)).alias("is_member"))


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """Number of 60 bits that equal rows share: of the md5 of their values' texts, so any engine can repeat it. Zeros of
    either sign are equal."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    texts = [
        F.coalesce((column(c) + F.lit(0.0) if kinds[c] in ("double", "float") else column(c)).cast("string"), F.lit("\0"))
        for c in columns
    ]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *texts)), 1, HEX_DIGITS), 16, 10).cast("bigint")


@dataclass(frozen=True)
class RowFilter:
    """Bits of a dataset's rows under ``path``: (bucket, bits), ``n_bits`` in all. A row whose bit is not set is not in the dataset."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    n_bits: int

    def bits(self) -> DataFrame:
        return self.spark.read.schema("bucket bigint, bits binary").parquet(self.path)


def filter_bits(n_rows: int, per_row: int = BITS_PER_ROW) -> int:
    """A power of two with at least ``per_row`` bits for each row, and at least one bitmap."""
    return max(BITMAP_BITS, 1 << max(0, n_rows * per_row - 1).bit_length())


def write_filter(dataset: DataFrame, columns: Sequence[str], path: str, per_row: int = BITS_PER_ROW) -> RowFilter:
    """Count the rows, set a bit for each and write the bitmaps, to be used for all further questions about the dataset.
    Bits are set on the map side, so what travels is bitmaps; buckets of 32,768 bits keep them small."""
    n_bits = filter_bits(dataset.count(), per_row)
    bit = F.pmod(row_hash(dataset, columns), F.lit(n_bits))
    dataset.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / BITMAP_BITS).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(BITMAP_BITS))).alias("bits")).write.mode("overwrite").parquet(path)
    return RowFilter(dataset.sparkSession, path, tuple(columns), n_bits)


def tag_candidates(rows: DataFrame, known: RowFilter) -> DataFrame:
    """Add ``is_candidate``: whether the bit of a row is set. The bitmaps are a written table, so Spark knows whether to send
    them to the rows or both by bucket."""
    bit = F.pmod(row_hash(rows, known.columns), F.lit(known.n_bits))
    place = F.pmod("_bit", F.lit(BITMAP_BITS))
    met = rows.withColumn("_bit", bit).withColumn("_bucket", F.floor(F.col("_bit") / BITMAP_BITS)).join(
        known.bits(), F.col("_bucket") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr(f"shiftleft(1, cast(pmod(_bit, {BITMAP_BITS}) % 8 as int))")) != 0
    return met.withColumn("is_candidate", F.coalesce(is_set, F.lit(False))).drop("_bit", "_bucket", "bucket", "bits")


def tag_members_filtered(rows: DataFrame, dataset: DataFrame, known: RowFilter, null_safe: bool = True) -> DataFrame:
    """``tag_members`` with only the candidates in the join on equality; ``is_candidate`` stays in the result."""
    tagged = tag_candidates(rows, known)
    maybe = tag_members(tagged.filter("is_candidate"), dataset, known.columns, null_safe)
    return maybe.unionByName(tagged.filter("NOT is_candidate").withColumn("is_member", F.lit(False)))
