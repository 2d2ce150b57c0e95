"""Profiles: shape, features, values, median."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rowecho.functions.text import value_kind, value_text
from rowecho.operators.rows import column
from rowecho.operators.sampling import row_count
from rowecho.sources.catalog import Dataset
from rowecho.sources.positions import POS


def _missing(ds: Dataset, name: str) -> Column:
    col = column(name)
    missing = col.isNull()
    if isinstance(ds.dtype(name), (T.DoubleType, T.FloatType)):
        missing = missing | F.isnan(col)
    return missing


def dataset_shape(ds: Dataset) -> DataFrame:
    return ds.df.agg(F.count("*").alias("n_rows")).select(
        F.lit(ds.name).alias("dataset"), "n_rows", F.lit(len(ds.columns)).cast("bigint").alias("n_cols")
    )


def dataset_features(ds: Dataset, exact: bool = True) -> DataFrame:
    """One row per column: position, type, distinct values (missing counts as one), missing flag.

    One pass over the table. ``exact=False`` swaps the exact distinct counts, which shuffle
    every value of wide high-cardinality tables, for sketches.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count("*").alias("n_rows")]
    for i, name in enumerate(ds.columns):
        present = F.when(~_missing(ds, name), column(name))
        aggs.append(count(present).alias(f"d{i}"))
        aggs.append(F.coalesce(F.bool_or(_missing(ds, name)), F.lit(False)).alias(f"m{i}"))
    one_row = ds.df.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(ds.name).alias("dataset"),
            F.lit(name).alias("feature"),
            F.lit(i).cast("bigint").alias("feature_pos"),
            F.lit(ds.dtype(name).simpleString()).alias("dtype"),
            (F.col(f"d{i}") + F.col(f"m{i}").cast("bigint")).alias("n_distinct"),
            F.col(f"m{i}").alias("has_null"),
            F.col("n_rows").alias("n_rows"),
        )
        for i, name in enumerate(ds.columns)
    ])
    return one_row.select(F.inline(rows))


def feature_list(ds: Dataset) -> DataFrame:
    """One row per column: position, type and the number of rows (a metadata count on parquet). For
    whoever needs names and their order, and no values."""
    rows = F.array(*[
        F.struct(F.lit(ds.name).alias("dataset"), F.lit(name).alias("feature"), F.lit(i).cast("bigint").alias("feature_pos"),
                 F.lit(ds.dtype(name).simpleString()).alias("dtype"), F.col("n_rows"))
        for i, name in enumerate(ds.columns)
    ])
    return ds.df.agg(F.count("*").alias("n_rows")).select(F.inline(rows))


def varying_columns(ds: Dataset) -> tuple[list[str], int, dict[str, tuple]]:
    """Columns with more than one value, the row count, and two observed values per column.

    Only "more than one" is asked, so minimum, maximum and a missing flag answer it in one
    narrow aggregate without any distinct count; one row comes back to the driver.
    """
    aggs = [F.count("*").alias("n")]
    for i, name in enumerate(ds.columns):
        present = F.when(~_missing(ds, name), column(name))
        aggs += [
            F.min(present).alias(f"lo{i}"),
            F.max(present).alias(f"hi{i}"),
            F.bool_or(_missing(ds, name)).alias(f"m{i}"),
        ]
    row = ds.df.agg(*aggs).first()
    usable, ends = [], {}
    for i, name in enumerate(ds.columns):
        low, high, has_null = row[f"lo{i}"], row[f"hi{i}"], bool(row[f"m{i}"])
        ends[name] = (low, high)
        if low is not None and (low != high or has_null):
            usable.append(name)
    return usable, row["n"], ends


def feature_values(ds: Dataset, features: Sequence[str]) -> DataFrame:
    """Distinct values of the chosen features: text, kind, first position, count, percent.

    All features share one scan and one shuffle; counting is combined on the map side, so a
    value that fills a third of a column sends one row per task.
    """
    cells = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            value_text(column(f), ds.dtype(f), f in ds.widened).alias("value"),
            F.when(_missing(ds, f), F.lit("other"))
            .otherwise(F.lit(value_kind(ds.dtype(f)))).alias("kind"),
        )
        for f in features
    ])
    counted = (
        ds.df.select(POS, F.explode(cells).alias("c"))
        .groupBy("c.feature", "c.value", "c.kind")
        .agg(F.min(POS).alias("first_pos"), F.count("*").alias("n"))
    )
    return counted.select(
        F.lit(ds.name).alias("dataset"), "feature", "value", "kind", "first_pos", "n",
        (F.col("n") * 100.0 / row_count(ds.df)).alias("pct"),
    )


def value_lists(values: DataFrame, limit: int) -> DataFrame:
    """(dataset, feature, n_values, words): expected words of each feature in first-seen order. Lists of
    more than ``limit`` values stay rows: their ``words`` are null, and probes that ask for them are
    decided against the rows (``decide_words_long``) with the same verdicts."""
    sizes = values.groupBy("dataset", "feature").agg(F.count("*").alias("n_values"))
    inline = values.join(sizes.filter(F.col("n_values") <= limit), ["dataset", "feature"])
    arrays = inline.groupBy("dataset", "feature").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first_pos", "value", "kind", "in_lexicon"))),
            lambda v: F.struct(v["value"].alias("value"), v["kind"].alias("kind"),
                               v["in_lexicon"].alias("in_lexicon")),
        ).alias("words")
    )
    return sizes.join(arrays, ["dataset", "feature"], "left")


def median_threshold(df: DataFrame, name: str, limit: int = 1_000_000) -> float | None:
    """Exact median of a numeric target, without bringing its values into one task.

    While the values that may hold the median are more than ``limit`` distinct ones, a quantile
    sketch (rank error at most 1/accuracy) narrows their range by some thousand times per pass;
    the rows left of the range are just counted. What is left is counted by value and ranked.
    """
    values = df.select(column(name).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    total = values.count()
    if total == 0:
        return None
    ranks = ((total - 1) // 2, total // 2)
    inside, below, n_inside = values, 0, total
    margin, accuracy = 1e-4, 100_000
    while True:
        counted = inside.groupBy("v").agg(F.count("*").alias("n"))
        if counted.limit(limit + 1).count() <= limit:
            break
        shares = [
            min(max((ranks[0] - below) / n_inside - margin, 0.0), 1.0),
            min(max((ranks[1] + 1 - below) / n_inside + margin, 0.0), 1.0),
        ]
        low, high = inside.agg(F.percentile_approx("v", shares, accuracy)).first()[0]
        at_left = inside.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high)))
        n_left, n_next = at_left.first()
        inside, below, n_inside = inside.filter(F.col("v").between(low, high)), below + n_left, n_next
    # at most ``limit`` rows are ranked here
    upto = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + below
    ranked = counted.select("v", "n", upto.alias("upto"))

    def at(rank: int) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("v")))

    lower, upper = ranked.agg(at(ranks[0]), at(ranks[1])).first()
    return lower + (upper - lower) * 0.5
