"""Score files: scorecards, membership and accuracy tables, one file per model."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowecho.operators.reshape import unpivot_scorecard


def read_labelled(spark: SparkSession, path: str, label: str) -> DataFrame:
    """CSV whose first column is the row label, whatever its header says."""
    df = spark.read.options(header="true", inferSchema="false").csv(path)
    return df.withColumnRenamed(df.columns[0], label)


def read_scorecards(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """(model, test, dataset, value) from wide files. Each file is read by its own header, since
    column order differs between files; empty cells stay as null values."""
    parts = [
        unpivot_scorecard(read_labelled(spark, path, "test").withColumn("model", F.lit(model)))
        for model, path in files.items()
    ]
    return reduce(DataFrame.unionByName, parts).select("model", "test", "dataset", "value")


def read_serializations(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """(model, test, serialization, dataset, value) from files with a variant column."""
    parts = []
    for model, path in files.items():
        wide = read_labelled(spark, path, "test").withColumn("model", F.lit(model))
        wide = wide.withColumn("serialization", F.col("serialization").cast("int"))
        parts.append(unpivot_scorecard(wide, ("model", "test", "serialization")))
    return reduce(DataFrame.unionByName, parts)


def read_membership(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """(model, dataset, value)."""
    parts = [
        read_labelled(spark, path, "dataset").select(
            F.lit(model).alias("model"), "dataset", F.col("value").cast("double").alias("value"))
        for model, path in files.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def accuracy_cell(cell: Column) -> Column:
    """``0.74 (29-71)`` -> (score, counts)."""
    return F.struct(
        F.substring_index(cell, " ", 1).cast("double").alias("score"),
        F.split(F.regexp_extract(cell, r"\(([0-9-]+)\)", 1), "-").cast("array<int>").alias("counts"),
    )


def read_accuracy(spark: SparkSession, path: str) -> DataFrame:
    """(model, category, dataset, cell, score, counts) from the packed accuracy table."""
    wide = spark.read.options(header="true", inferSchema="false").csv(path)
    cells = [c for c in wide.columns if c not in ("LLM", "type")]
    long = wide.unpivot(["LLM", "type"], [f"`{c}`" for c in cells], "dataset", "cell")
    return long.select(
        F.col("LLM").alias("model"), F.col("type").alias("category"), "dataset", "cell",
        F.inline(F.array(accuracy_cell(F.col("cell")))),
    )
