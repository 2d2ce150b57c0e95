"""Scores: verdicts become (model, test, dataset) values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowecho.functions.answers import short_answer
from rowecho.plans.templates import PASS_RATE_THRESHOLD, SCORE_RULES

CELL = ("model", "test", "dataset")


def test_score(test: Column, n_passed: Column, n: Column) -> Column:
    """Score of a test by its rule: any pass, enough passes, number or percent of passes."""
    rules: dict[str, list[str]] = {}
    for name, rule in SCORE_RULES.items():
        rules.setdefault(rule, []).append(name)
    return (
        F.when(test.isin(*rules["any"]), (n_passed > 0).cast("double"))
        .when(test.isin(*rules["rate"]), (n_passed / n >= PASS_RATE_THRESHOLD).cast("double"))
        .when(test.isin(*rules["percent"]), n_passed * 100.0 / n)
        .otherwise(n_passed.cast("double"))
    )


def scorecard(verdicts: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Long scorecard in one aggregation for all tests. ``extra`` adds grouping columns, such as
    the serialization variant."""
    counted = verdicts.groupBy(*CELL, *extra).agg(
        F.count("*").alias("n_trials"), F.count_if("passed").alias("n_passed")
    )
    return counted.select(
        *CELL, *extra, "n_trials", "n_passed",
        test_score(F.col("test"), F.col("n_passed"), F.col("n_trials")).alias("value"),
    )


def scorecard_rollup(verdicts: DataFrame, levels: Sequence[str] = CELL) -> DataFrame:
    """Counts and rates on every level of ``levels``, from the whole to single cells: (levels, level, n_cells, n_trials,
    n_passed, rate).

    ``level`` is how many of the levels a row is of; the others are null there. A subtotal's rate is that of its trials,
    never a mean of rates: counts of cells are made once and added up on each level.
    """
    keys = list(levels)
    cells = verdicts.groupBy(*keys).agg(F.count("*").alias("n_trials"), F.count_if("passed").alias("n_passed"))
    rolled = cells.rollup(*keys).agg(
        (F.lit(len(keys)) - F.bit_count(F.grouping_id())).cast("bigint").alias("level"), F.count("*").alias("n_cells"),
        F.sum("n_trials").alias("n_trials"), F.sum("n_passed").alias("n_passed"))
    return rolled.withColumn("rate", F.col("n_passed") / F.col("n_trials"))


def any_pass(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(*CELL).agg(F.bool_or("passed").alias("passed"))


def pass_rate(verdicts: DataFrame, threshold: float = PASS_RATE_THRESHOLD) -> DataFrame:
    return verdicts.groupBy(*CELL).agg(F.avg(F.col("passed").cast("int")).alias("rate")).withColumn(
        "passed", F.col("rate") >= threshold
    )


def membership_tally(verdicts: DataFrame) -> DataFrame:
    """Score and tallies; an answer that says both counts as Yes."""
    yes = F.contains("answer", F.lit("Yes"))
    no = F.contains("answer", F.lit("No"))
    return verdicts.groupBy("model", "dataset").agg(
        F.count_if("passed").alias("score"),
        F.count_if(yes).alias("n_yes"),
        F.count_if(~yes & no).alias("n_no"),
        F.count("*").alias("n_tests"),
    )


def accuracy(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(*CELL).agg(
        F.count("*").alias("n_tests"),
        (F.count_if("passed") * 100.0 / F.count("*")).alias("accuracy"),
    )


def answer_histogram(verdicts: DataFrame) -> DataFrame:
    """How often each (shortened) answer was given."""
    answer = short_answer(F.col("answer"), F.col("rule"))
    return verdicts.groupBy(*CELL, answer.alias("answer")).agg(F.count("*").alias("n"))


def scorecard_wide(card: DataFrame, datasets: Mapping[str, str]) -> DataFrame:
    """test x dataset with display names; a cell without a value is 0. The column list is given,
    so the pivot needs no pass to find it."""
    names = F.create_map(*[F.lit(x) for pair in datasets.items() for x in pair])
    return (
        card.withColumn("shown", names[F.col("dataset")])
        .groupBy("model", F.col("test").alias("test_name"))
        .pivot("shown", list(datasets.values()))
        .agg(F.max("value"))
        .fillna(0)
    )
