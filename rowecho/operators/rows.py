"""Column and row selection: projections, filters, positions, first rows, look-ups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowecho.functions.draws import draw_key
from rowecho.sources.positions import POS


def column(name: str) -> Column:
    """Column by its whole name, dots and blanks included."""
    return F.col(f"`{name}`")


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def rename_columns(df: DataFrame, names: Mapping[str, str], ignored: Sequence[str] = ()) -> DataFrame:
    """Drop ``ignored`` and rename the rest; the map must cover every column of the frame."""
    kept = [c for c in df.columns if c not in ignored and c != POS]
    if len(names) - len(ignored) != len(kept):
        raise ValueError(
            f"name map and columns differ in length: {len(names) - len(ignored)} != {len(kept)}"
        )
    return df.drop(*ignored).withColumnsRenamed({c: names[c] for c in kept})


def trailing_columns(columns: Sequence[str], k: int) -> list[str]:
    """The last k columns; at least one column always stays."""
    k = min(k, len(columns) - 1)
    return list(columns[len(columns) - k:])


def random_columns(features: DataFrame, trials: int, k: int, seed: int | str) -> DataFrame:
    """k features per dataset and trial without replacement, k <= features - 2.

    ``features`` is (dataset, feature, feature_pos, ...): one row per column, so the groups are
    as small as a table is wide.
    """
    drawn = features.select(
        "dataset", "feature", "feature_pos",
        F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"),
    ).withColumn("_draw", draw_key(seed, F.col("dataset"), F.col("trial"), F.col("feature")))
    group = Window.partitionBy("dataset", "trial")
    ranked = drawn.withColumn(
        "draw_rank", F.row_number().over(group.orderBy("_draw"))
    ).withColumn("_n", F.count("*").over(group))
    return ranked.filter(
        F.col("draw_rank") <= F.least(F.lit(k), F.col("_n") - 2)
    ).select("dataset", "trial", "feature", "feature_pos", F.col("draw_rank").cast("bigint").alias("draw_rank"))


def without_given(all_names: Column, given: Column) -> Column:
    """List difference; lists of column names hold no repeats."""
    return F.array_except(all_names, given)


def without_pairs(df: DataFrame, skipped: DataFrame, on: Sequence[str]) -> DataFrame:
    """Leave out the rows a skip table names (id columns, skipped tests or features). Skip tables
    are hand-written lists, so the plain join is planned as a broadcast."""
    return df.join(skipped, list(on), "left_anti")


def head_rows(df: DataFrame, n: int) -> DataFrame:
    """First n rows. A filter on the position: unlike a bare limit it always gives the same rows."""
    return df.filter(F.col(POS) < n)


def row_at(df: DataFrame, position: int) -> DataFrame:
    return df.filter(F.col(POS) == position)


def tail_mirror(df: DataFrame, n: int) -> DataFrame:
    """The mirror rows of the first n rows, with the position they mirror."""
    last = df.agg(F.max(POS)).scalar()
    return df.withColumn("mirror_of", last - F.col(POS)).filter(F.col("mirror_of") < n)


def mirror_position(df: DataFrame) -> Column:
    """Position of a row's mirror from the tail, as a scalar subquery on the table's size."""
    return df.agg(F.max(POS)).scalar() - F.col(POS)


def keep_first(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop duplicates on ``subset``, keeping the first row by position.

    The rank filter is pushed below the shuffle as a group limit, so a map task sends one row
    per key at most and a key that holds a third of the table stays cheap.
    """
    order = Window.partitionBy(*[column(c) for c in subset]).orderBy(POS)
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def first_per_class(df: DataFrame, label: Column) -> DataFrame:
    """First row of each class, with the class order (first seen first)."""
    order = Window.partitionBy("_class").orderBy(POS)
    firsts = (
        df.withColumn("_class", label)
        .withColumn("_rn", F.row_number().over(order))
        .filter("_rn = 1")
        .drop("_rn")
    )
    # one row per class is left
    return firsts.withColumn("class_order", F.row_number().over(Window.orderBy(POS)) - 1)
