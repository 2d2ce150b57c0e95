"""What the operators share: the folder for tables between jobs, tables, bounded batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowecho.sources.lineage import checkpoint_folder, remove_at_end

BATCH_BYTES = 16 << 20
BATCH_ROWS = 2_000
#: for tasks that split every text of a batch into words at once
WORD_BATCH_ROWS, WORD_BATCH_BYTES = 500, 4 << 20


def shared_folder(spark: SparkSession) -> str:
    return checkpoint_folder(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write the frame to the shared folder and go on from the written table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch holds: by bytes for long texts, by rows for short ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sample_texts(docs: DataFrame, rows: int, chars: int, labels: DataFrame | None = None) -> list[tuple]:
    """(label, text) of at most ``rows`` different texts of each label, drawn by the hash of the text.

    ``docs`` has doc_id, text and, unless ``labels`` (doc_id, label) is given, label. Empty texts and
    those of more than ``chars`` characters are not drawn, and copies of a text count once for a label.
    Only ids and hashes are joined and sorted; the texts of the few drawn are fetched by them.
    """
    hashed = docs.filter((F.length("text") > 0) & (F.length("text") <= chars)).withColumn(
        "place", F.xxhash64("text"))
    narrow = hashed.select("doc_id", "place", *([] if labels is not None else ["label"]))
    narrow = cut(narrow if labels is None else narrow.join(labels.select("doc_id", "label"), "doc_id"), "places")
    narrow = cut(narrow.groupBy("label", "place").agg(F.min("doc_id").alias("doc_id")), "different")
    few = [r for value in sorted(r["label"] for r in narrow.select("label").distinct().collect())
           for r in narrow.filter(F.col("label") == value).orderBy("place").limit(rows).collect()]
    if not few:
        return []
    kind = narrow.schema
    wanted = F.broadcast(docs.sparkSession.createDataFrame(few, kind))  # `rows` for each label at most
    drawn = hashed.select("doc_id", "place", "text").join(wanted, ["doc_id", "place"]).select(
        "place", "label", "text").distinct()  # a row may be there twice with its id
    return [(r["label"], r["text"]) for r in sorted(
        drawn.collect(), key=lambda r: (r["place"], str(r["label"]), r["text"]))]
