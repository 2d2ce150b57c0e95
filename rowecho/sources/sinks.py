"""Writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_scorecard(card: DataFrame, path: str, partition_by: Sequence[str] = ("model",)) -> None:
    """Long scorecard; one folder per model, or per model and serialization variant. Folders of
    other models stay as they are."""
    _replace_folders(card, path, partition_by)


def _replace_folders(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_scorecard_csv(wide: DataFrame, path: str) -> None:
    """Wide scorecard as one CSV file: as many rows as there are tests."""
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """Detail log: one row per probe and model, with the matches as a map. Rows stay in the
    partitions that decided them; nothing is shuffled for the write. Logs of other models or tests
    stay as they are."""
    _replace_folders(verdicts.withColumn(
        "matches", F.when(F.col("matches").isNotNull(), F.map_from_entries(F.array_distinct("matches")))
    ), path, ("model", "test"))
