"""Column types found from the cells of delimited files.

Every cell is of a kind: missing, integer, number, truth value, date or text. Counts of kinds add up, so
each file is profiled once and profiles are merged when files come in; a column's type is the least
one that holds all its kinds. Cells that a type does not hold are listed, never lost in silence.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowecho.functions.text import MISSING_TOKENS
from rowecho.operators.rows import column

KINDS = ("missing", "integer", "number", "truth", "date", "text")
INTEGER = r"^\s*[+-]?\d{1,18}\s*$"
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Inf|Infinity|infinity)\s*$"
TRUTH = r"^(True|False|TRUE|FALSE|true|false)$"
DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


def cell_kind(cell: Column) -> Column:
    """The kind of a cell as text."""
    return (
        F.when(cell.isNull() | cell.isin(*MISSING_TOKENS), "missing")
        .when(cell.rlike(INTEGER), "integer")
        .when(cell.rlike(NUMBER), "number")
        .when(cell.rlike(TRUTH), "truth")
        .when(cell.rlike(DATE) & cell.try_cast("timestamp").isNotNull(), "date")
        .otherwise("text")
    )


def read_cells(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Delimited files with every column as text, cells as they are; the first line of a file is its header."""
    settings = {"header": "true", "inferSchema": "false", "emptyValue": "", "nullValue": ""} | options
    return spark.read.options(**settings).csv(path)


def profile_cells(cells: DataFrame, by_file: bool = False) -> DataFrame:
    """(column, place, n_missing, n_integer, ...): how many cells of each kind the columns hold, with ``file`` for each file. One narrow
    aggregate for all columns."""
    names = cells.columns
    kinds = cells.select(*([F.col("_metadata.file_path").alias("_file")] if by_file else []), *[
        cell_kind(column(c)).alias(f"c{i}") for i, c in enumerate(names)])
    counts = kinds.groupBy(*(["_file"] if by_file else [])).agg(*[
        F.count_if(F.col(f"c{i}") == k).alias(f"c{i}_{k}") for i in range(len(names)) for k in KINDS])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).cast("bigint").alias("place"), *[
            F.coalesce(F.col(f"c{i}_{k}"), F.lit(0)).alias(f"n_{k}") for k in KINDS])
        for i, c in enumerate(names)])
    return counts.select(*([F.col("_file").alias("file")] if by_file else []), F.inline(rows))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """One profile of all files of several."""
    narrow = [p.select("column", "place", *[f"n_{k}" for k in KINDS]) for p in profiles]
    return reduce(DataFrame.unionByName, narrow).groupBy("column").agg(
        F.min("place").alias("place"), *[F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS])


def with_types(profile: DataFrame, dates: bool = False, integers_with_gaps: bool = False) -> DataFrame:
    """Add ``type``: bigint, double, boolean, timestamp or string.

    Integers with missing cells are doubles, and truth values with missing cells text, as most readers of such files have
    it; ``integers_with_gaps`` keeps the former integers. Dates are text unless asked for. A column of missing cells only is a
    double.
    """
    def only(*kinds: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"n_{k}") == 0 for k in KINDS if k not in kinds])

    gaps = ("missing",)
    return profile.withColumn(
        "type",
        F.when(only("missing"), "double")
        .when(only("integer", *(gaps if integers_with_gaps else ())), "bigint")
        .when(only("integer", "number", "missing"), "double")
        .when(only("truth"), "boolean")
        .when(only("date", "missing") if dates else F.lit(False), "timestamp")
        .otherwise("string"))


def types_of(profile: DataFrame, **options: bool) -> dict[str, str]:
    """Column -> type, in the order of the columns; one row for each column comes back."""
    return {r["column"]: r["type"] for r in with_types(profile, **options).orderBy("place").collect()}


def _fits(kind: Column, type_: str) -> Column:
    holds = {
        "bigint": ("integer",), "int": ("integer",), "double": ("integer", "number"), "boolean": ("truth",),
        "timestamp": ("date",), "string": KINDS,
    }
    if type_ not in holds:
        raise ValueError(f"no rule for cells of type {type_}")
    return kind.isin("missing", *holds[type_])


def _converted(cell: Column, type_: str) -> Column:
    present = F.when(~cell.isin(*MISSING_TOKENS), cell)
    return present if type_ == "string" else F.btrim(present).try_cast(type_)


def typed(cells: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """The cells as values of their types. A cell that does not fit is null here and in ``misfits``."""
    return cells.select(*[
        F.when(_fits(cell_kind(column(c)), t), _converted(column(c), t)).alias(c) for c, t in types.items()])


def misfits(cells: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """(column, type, cell, n): different cells that do not fit the type of their column, the ones a small integer type has no room
    for included, and how often they occur. Only cells that do not fit travel."""
    odd = []
    for c, t in types.items():
        cell = column(c)
        bad = ~_fits(cell_kind(cell), t) | (cell_kind(cell).isin("integer", "number") & _converted(cell, t).isNull())
        odd.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.when(bad, cell).alias("cell")))
    return cells.select(F.inline(F.filter(F.array(*odd), lambda x: x["cell"].isNotNull()))).groupBy(
        "column", "type", "cell").agg(F.count("*").alias("n"))
