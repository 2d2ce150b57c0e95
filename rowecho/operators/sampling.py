"""Samples: seeded rows, one row per trial."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowecho.functions.draws import draw_key, draw_position
from rowecho.sources.positions import POS


TOP_ROWS = 10_000  # rows that are ranked together
DIGITS = 4  # hex digits of a draw that one histogram is made of: 65,536 numbers
DRAW_DIGITS = 32


def seeded_sample(df: DataFrame, n: int, seed: int | str) -> DataFrame:
    """n rows without replacement: the n smallest draws, all rows where there are fewer. A small sample is planned as a
    distributed top-n, a large one by its threshold."""
    if n > TOP_ROWS:
        return threshold_sample(df, n, seed)
    return (
        df.withColumn("_draw", draw_key(seed, F.col(POS))).orderBy("_draw", POS).limit(n).drop("_draw")
    )


def threshold_sample(df: DataFrame, n: int, seed: int | str, top_rows: int = TOP_ROWS) -> DataFrame:
    """``seeded_sample`` for any share of a table: the draw of the n-th row is found by counting, so no task
    ever holds the sample.

    A histogram of the leading digits of the draws tells in which of them the n-th lies; its rows are counted by the next
    digits, and so on until few rows are left. Draws below these digits are in, those are ranked, the others are
    out: one filter over the table. Rows with one draw have one position, so ties end with the digits.
    """
    drawn = df.withColumn("_draw", draw_key(seed, F.col(POS)))
    prefix, left = "", n
    while left > 0 and len(prefix) < DRAW_DIGITS:
        inside = drawn.filter(F.startswith("_draw", F.lit(prefix))) if prefix else drawn
        digits = F.substring("_draw", len(prefix) + 1, DIGITS).alias("digits")
        counts = sorted((r["digits"], r["n"]) for r in inside.groupBy(digits).agg(F.count("*").alias("n")).collect())
        for digits, rows in counts:
            if rows >= left:
                break
            left -= rows
        else:
            return df  # fewer rows than asked for
        prefix += digits
        if rows == left or rows <= top_rows:
            break
    below = drawn.filter(F.col("_draw") < prefix).drop("_draw")
    if left <= 0:
        return below
    edge = drawn.filter(F.startswith("_draw", F.lit(prefix)))
    if rows > left:  # at most ``top_rows``, or rows with one position
        edge = edge.orderBy("_draw", POS).limit(left)
    return below.unionByName(edge.drop("_draw"))


def row_count(df: DataFrame):
    """Number of rows as a scalar subquery (a metadata count on parquet)."""
    return df.agg(F.count("*")).scalar()


def random_row_per_trial(df: DataFrame, trials: DataFrame, seed: int | str) -> DataFrame:
    """One row per trial: a position is drawn for each trial and joined on equality, so the cost
    is one join however many trials there are. ``trials`` is (trial)."""
    picked = trials.withColumn(POS, draw_position(row_count(df), seed, F.col("trial")))
    return picked.join(df, POS)
