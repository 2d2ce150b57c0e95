"""Reports: long scorecards become the tables that are read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowecho.operators.reshape import flag_best, rank_models, scorecard_diff, side_by_side
from rowecho.plans.templates import TEST_CATEGORIES


def _lookup(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def categorise(card: DataFrame) -> DataFrame:
    """Add category, report order and shown name; tests outside the grid are left out. The
    look-up is a short literal map."""
    test = F.col("test")
    return card.filter(test.isin(*TEST_CATEGORIES)).select(
        "*",
        _lookup({t: c for t, (c, _, _) in TEST_CATEGORIES.items()})[test].alias("category"),
        _lookup({t: o for t, (_, o, _) in TEST_CATEGORIES.items()})[test].alias("ord"),
        _lookup({t: s for t, (_, _, s) in TEST_CATEGORIES.items()})[test].alias("shown"),
    )


def select_tests(card: DataFrame, category: str) -> DataFrame:
    """Tests of a category in report order; an unknown category is an error."""
    if category not in {c for c, _, _ in TEST_CATEGORIES.values()}:
        raise ValueError(f"unknown category: {category}")
    return categorise(card).filter(F.col("category") == category).orderBy("ord", "dataset")


def category_grid(card: DataFrame, datasets: Sequence[str]) -> DataFrame:
    """One row per (model, test), knowledge before memorization, one column per dataset."""
    return (
        categorise(card).groupBy("model", "category", "ord", "shown")
        .pivot("dataset", list(datasets)).agg(F.max("value")).orderBy("model", "ord")
    )


def total_passes(card: DataFrame, hidden: Sequence[str] = ()) -> DataFrame:
    """Passes over the cells of the grid."""
    return (
        categorise(card).filter(~F.col("dataset").isin(*hidden))
        .groupBy("model").agg(F.sum("value").alias("passes"))
    )


def multi_model_grid(card: DataFrame, models: Sequence[str], datasets: Sequence[str]) -> DataFrame:
    grid = side_by_side(categorise(card), models, datasets)
    return grid.withColumn("ord", _lookup({t: o for t, (_, o, _) in TEST_CATEGORIES.items()})[F.col("test")]).orderBy("ord")


def serialization_grid(card: DataFrame, model: str, serialization: int, datasets: Sequence[str]) -> DataFrame:
    """One model, one variant: test x dataset."""
    return (
        card.filter((F.col("model") == model) & (F.col("serialization") == serialization))
        .groupBy("test").pivot("dataset", list(datasets)).agg(F.max("value"))
    )


def difference_grid(card: DataFrame, old: str, new: str, datasets: Sequence[str]) -> DataFrame:
    """Before/after: what each of two models passes."""
    grid = categorise(card)
    diff = scorecard_diff(grid.filter(F.col("model") == old), grid.filter(F.col("model") == new))
    return diff.groupBy("test").pivot("dataset", list(datasets)).agg(F.max("diff"))


def contamination_rate(card: DataFrame, hidden: Sequence[str] = ()) -> DataFrame:
    """Passes over the cells of the tests in the grid. Cells are counted with their empty ones."""
    cells = card.filter(F.col("test").isin(*TEST_CATEGORIES) & ~F.col("dataset").isin(*hidden))
    return cells.groupBy("model").agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("passes"),
        F.count("*").alias("cells"),
    ).withColumn("rate", F.col("passes") / F.col("cells"))


def mean_scores(scores: DataFrame, hidden: Sequence[str] = (), parity: bool = False) -> DataFrame:
    """Mean score per (model, category) over the shown datasets.

    ``parity=True``: the sum runs over all datasets, the divisor is the number of the table's
    columns (two label columns included) less the hidden list.
    """
    if parity:
        by = scores.groupBy("model", "category").agg(
            F.sum("score").alias("total"), F.count("*").alias("n"))
        return by.select(
            "model", "category", (F.col("total") / (F.col("n") + 2 - len(hidden))).alias("score"))
    shown = scores.filter(~F.col("dataset").isin(*hidden))
    return shown.groupBy("model", "category").agg(F.avg("score").alias("score"))


def membership_means(values: DataFrame) -> DataFrame:
    return values.groupBy("model").agg((F.avg("value") / 100).alias("score"))


def format_score(score: Column) -> Column:
    return F.format_string("%.2f", score)


def accuracy_table(scores: DataFrame, datasets: Sequence[str], hidden: Sequence[str] = (),
                   hidden_models: Sequence[str] = (), details: bool = False,
                   show_mean: bool = False, parity: bool = False) -> DataFrame:
    """One row per (model, category): cells with or without the answer counts, optional mean."""
    shown = [d for d in datasets if d not in hidden]
    kept = scores.filter(~F.col("model").isin(*hidden_models)) if hidden_models else scores
    score = F.col("score")
    # two decimals only for the three round values, which are stored without them
    text = F.when(score.isin(0.0, 0.5, 1.0), format_score(score)).otherwise(F.substring_index("cell", " ", 1))
    cell = F.col("cell") if details else text
    table = (
        kept.withColumn("text", cell).groupBy("model", "category")
        .pivot("dataset", shown).agg(F.max("text"))
    )
    if show_mean:
        means = mean_scores(kept, hidden, parity).select(
            "model", "category", format_score(F.col("score")).alias("mean"))
        table = table.join(means, ["model", "category"])
    return table


def ranking(rates: DataFrame, memberships: DataFrame, means: DataFrame,
            hidden_models: Sequence[str] = ()) -> DataFrame:
    """Models by contamination rate, with membership, 0-shot and 1-shot; the best of each
    category is flagged. Equal rates share a rank and are listed by name."""
    parts = (
        rates.select("model", F.lit("contamination").alias("category"), F.col("rate").alias("score"))
        .unionByName(memberships.select("model", F.lit("membership").alias("category"), "score"))
        .unionByName(
            means.filter(F.col("category").isin("0-shot", "1-shot"))
            .join(rates.select("model"), "model", "left_semi")
            .select("model", "category", "score"))
    )
    flagged = flag_best(parts)
    categories = ["contamination", "membership", "0-shot", "1-shot"]
    wide = flagged.groupBy("model").pivot("category", categories).agg(
        F.max("score").alias("score"), F.max("is_best").alias("best"))
    out = rank_models(wide, "contamination_score")
    if hidden_models:
        out = out.filter(~F.col("model").isin(*hidden_models))
    return out.orderBy("model_rank", "model")
