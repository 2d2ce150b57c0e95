"""Exact duplicates by a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest,
anti-joined with the index by sort-merge (the index side is neither shuffled nor sorted anew) and
what is new is appended. Native expressions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowecho.llm.common import cut, shared_folder, table, text_or_empty

DIGESTS_PER_BUCKET = 2_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digests seen so far: the id of the row that stays for each, and the batch that brought it.

    ``path`` outlives the session: an index opened again under the same path goes on from its
    files. The number of buckets is fixed when the index is made.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name = spark, name
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).hint("merge")

    def buckets(self) -> int:
        described = self.spark.sql(f"DESCRIBE FORMATTED {self.name}")
        return int(described.filter("col_name = 'Num Buckets'").head()["data_type"])

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the digests of ``groups`` (digest, keep_id; one row each) that are not in yet."""
        fresh = groups.select("digest", "keep_id").join(self.rows().select("digest"), "digest", "left_anti")
        # a table is not written while it is read, hence the cut
        cut(fresh, "fresh").withColumn("batch", F.lit(batch)) \
            .repartition(self.buckets(), "digest").write.insertInto(self.name)


def _settled(docs: DataFrame, index_name: str, index_path: str, id_column: str, text_column: str,
             digests_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(digest, doc_id, copies) of the batch, and per digest (keep_id, group_size, fresh) once the
    index holds them all; fresh: this batch brought it."""
    spark = docs.sparkSession
    counted = cut(
        docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                    text_digest(text_or_empty(text_column)).alias("digest"))
        .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "digests")
    groups = cut(counted.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    index = DigestIndex(spark, index_name, index_path, max(8, -(-groups.count() // digests_per_bucket)))
    batch = uuid.uuid4().hex
    index.append(groups, batch)
    # one row per digest on both sides, so nothing is skewed
    stay = groups.drop("keep_id").join(index.rows(), "digest").select(
        "digest", "keep_id", "group_size", (F.col("batch") == batch).alias("fresh"))
    return counted, cut(stay, "stay")


def dedup(docs: DataFrame, index_name: str, index_path: str, id_column: str = "doc_id",
          text_column: str = "text", digests_per_bucket: int = DIGESTS_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. A row stays if its text is not in the index and no equal text of
    the batch has a smaller id; of rows repeated with id and text, one stays. A null id stays only
    where no equal text has an id. ``group_size`` counts the equal rows of this batch; ``keep_id``
    is that of the index, so it may name a row of an earlier batch (then nothing of the group is
    kept). No other column is read. An empty table gives an empty result.
    """
    counted, stay = _settled(docs, index_name, index_path, id_column, text_column, digests_per_bucket)
    # copies of one text all meet one row here: a plain join, whose large partitions are split
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    return counted.join(stay, "digest").select(
        "doc_id", "keep_id", "group_size", "fresh", "digest", copy).select(
        "doc_id", "keep_id", "group_size",
        (F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, index_name: str, index_path: str, id_column: str = "doc_id",
                    text_column: str = "text", digests_per_bucket: int = DIGESTS_PER_BUCKET) -> DataFrame:
    """The rows that ``dedup`` keeps, with the columns of ``docs``."""
    counted, stay = _settled(docs, index_name, index_path, id_column, text_column, digests_per_bucket)
    kept = cut(counted.join(stay.filter("fresh"), "digest").filter(
        F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        F.col("doc_id").alias("_keep_id"), F.col("digest").alias("_digest"), F.col("copies").alias("_copies")), "kept")
    same = F.col(id_column).cast("bigint").eqNullSafe(F.col("_keep_id")) & (
        text_digest(text_or_empty(text_column)) == F.col("_digest"))
    met = docs.join(kept, same)
    single = met.filter("_copies = 1").select(*docs.columns)
    if kept.filter("_copies > 1").limit(1).count() == 0:
        return single
    # rows repeated with id and text: any one of them, the smallest by its other columns
    row = F.struct(*docs.columns)
    repeated = met.filter("_copies > 1").groupBy("_keep_id", "_digest").agg(F.min(row).alias("row"))
    return single.unionByName(repeated.select("row.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an index that starts empty."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return dedup(table(spark, sf_dir, "documents"), name, f"{shared_folder(spark)}/{name}")


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
