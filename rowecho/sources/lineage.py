"""Cutting lineage through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names; where it names none, one in its warehouse, which driver
    and executors share by definition."""
    folder = (
        spark.conf.get(CHECKPOINT_SETTING, None)
        or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_between_jobs"
    )
    return folder.rstrip("/")


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver remove a folder when it ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def cut_lineage(df: DataFrame, buckets: tuple[str, int] | None = None, **options: str) -> DataFrame:
    """Write the frame once and go on from the written table. ``options`` are those of the writer. With ``buckets``, a column and
    a number, the table is written in buckets of the column, so that joins and groups on it do not shuffle what is read from it.

    Later rounds neither recompute it nor lose it with an executor, and unlike a checkpointed
    RDD the table has a known size and columns that can be pruned. Columns are written under
    plain names, since dataset columns may hold any character.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    names = df.columns
    writer = df.toDF(*[f"c{i}" for i in range(len(names))]).write.options(**options)
    if buckets:
        column, number = buckets
        table = f"cut_{uuid.uuid4().hex}"
        writer.bucketBy(number, f"c{names.index(column)}").option("path", path).saveAsTable(table, format="parquet")
        written = df.sparkSession.table(table)
    else:
        writer.parquet(path)
        written = df.sparkSession.read.parquet(path)
    remove_at_end(df.sparkSession, path)
    return written.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
