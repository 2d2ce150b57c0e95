"""Scorecards between wide and long form, side by side and against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def unpivot_scorecard(wide: DataFrame, ids: Sequence[str] = ("model", "test")) -> DataFrame:
    cells = [c for c in wide.columns if c not in ids]
    typed = wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in cells])
    return typed.unpivot(list(ids), [f"`{c}`" for c in cells], "dataset", "value")


def scorecard_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """2 where both pass, else new - old (1 gained, -1 lost, 0 none)."""
    joined = old.select("test", "dataset", F.col("value").alias("old")).join(
        new.select("test", "dataset", F.col("value").alias("new")), ["test", "dataset"], "full_outer"
    ).na.fill(0, ["old", "new"])
    return joined.select(
        "test", "dataset",
        F.when(F.col("old") + F.col("new") == 2, F.lit(2.0))
        .otherwise(F.col("new") - F.col("old")).alias("diff"),
    )


def merge_scorecards(older: DataFrame, newer: DataFrame, on: str = "test_name") -> DataFrame:
    """Wide scorecards with different datasets, matched on the test."""
    return older.join(newer, on, "full_outer")


def side_by_side(card: DataFrame, models: Sequence[str], datasets: Sequence[str]) -> DataFrame:
    """One column per (model, dataset)."""
    columns = [f"{m}:{d}" for m in models for d in datasets]
    return (
        card.withColumn("cell", F.concat("model", F.lit(":"), "dataset"))
        .groupBy("test").pivot("cell", columns).agg(F.max("value"))
    )


def one_serialization(card: DataFrame, serialization: int) -> DataFrame:
    return card.filter(F.col("serialization") == serialization).drop("serialization")


def flag_best(scores: DataFrame, group: str = "category", value: str = "score") -> DataFrame:
    """Mark the maximum of each group; ties are all marked. The maximum comes from an aggregate,
    so a group is never sorted in one task."""
    best = scores.groupBy(group).agg(F.max(value).alias("_best"))
    return scores.join(best, group).withColumn("is_best", F.col(value) == F.col("_best")).drop("_best")


def rank_models(scores: DataFrame, value: str = "score") -> DataFrame:
    """Dense rank of models, one row each."""
    return scores.withColumn(
        "model_rank", F.dense_rank().over(Window.orderBy(F.desc(value))).cast("bigint")
    )
