"""Stand-in for a model: answers derived from the probe by fixed rules.

Test data, not product. Each (probe, model) draws a kind of answer: right, right in lower case
with underscores, half of it, nothing, or a wrong text; a model that echoes puts the prompt in
front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowecho.functions.draws import draw_int
from rowecho.operators.decide import NAMES, ROW, WORDS

MODELS = ("alpha", "beta")
ECHOING = ("beta",)


def right_answer() -> Column:
    rule = F.col("rule")
    values = F.array_join(F.transform("expected", lambda e: e["value"]), ", ")
    cells = F.array_join(
        F.transform("expected", lambda e: F.concat(F.lit("The "), e["name"], F.lit(" is "), e["value"])),
        ", ",
    )
    return (
        F.when(rule.isin(WORDS, NAMES), values)
        .when(rule == ROW, cells)
        .otherwise(F.coalesce("label", F.lit("")))
    )


def respond(probes: DataFrame, models: Sequence[str] = MODELS,
            echoing: Sequence[str] = ECHOING) -> DataFrame:
    """(probe_id, model, output)."""
    grid = probes.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    kind = F.pmod(draw_int("kind", F.col("probe_id"), F.col("model")), F.lit(5))
    right = right_answer()
    answer = (
        F.when(kind == 0, right)
        .when(kind == 1, F.replace(F.lower(right), F.lit(" "), F.lit("_")))
        .when(kind == 2, F.substr(right, F.lit(1), F.floor(F.length(right) / 2).cast("int")))
        .when(kind == 3, F.lit(""))
        .otherwise(F.lit("No, 1 Yes"))
    )
    marker = F.when(F.col("test") == "full_completion", F.concat(F.lit("\n"), answer)).otherwise(answer)
    echoed = F.when(F.col("model").isin(*echoing), F.concat("prompt", marker)).otherwise(marker)
    return grid.select("probe_id", "model", echoed.alias("output"))
