"""Prompt templates as a table: another wording is a row, not code."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowecho.functions.text import template_slots
from rowecho.plans import templates

SLOT = r"\{([a-z_]+)\}"


def own_templates(spark: SparkSession) -> DataFrame:
    """(name, slots, text): the templates of the library."""
    rows = [(name.lower(), template_slots(text), text) for name, text in vars(templates).items()
            if name.isupper() and isinstance(text, str) and template_slots(text)]
    return spark.createDataFrame(rows, "name string, slots array<string>, text string")


def checked_templates(table: DataFrame) -> DataFrame:
    """The table with each text cut at its slots (``literals``, ``order``); a text whose slots are not those declared, or that has
    other braces, is an error when its row is read. Once per template, however many probes use it."""
    order = F.regexp_extract_all("text", F.lit(SLOT), F.lit(1))
    literals = F.split("text", SLOT)
    stray = F.exists(literals, lambda x: F.contains(x, F.lit("{")) | F.contains(x, F.lit("}")))
    same = F.array_sort(F.array_distinct(order)) == F.array_sort(F.array_distinct("slots"))
    fault = F.raise_error(F.concat(F.lit("slots of template "), "name", F.lit(" do not fit its text")))
    return table.select("name", F.when(same & ~stray, literals).otherwise(fault.cast("array<string>")).alias("literals"), order.alias("order"))


def fill_by_name(rows: DataFrame, table: DataFrame, name: str, slots: Mapping[str, Column]) -> DataFrame:
    """Add ``prompt`` to every row: the template that the column ``name`` names, filled. A value that holds a slot marker is
    not filled again, a null value is an error as a missing slot is; rows that name no template get a null prompt.
    Templates are a few rows, so they are sent to the others."""
    values = F.create_map(*[x for slot, value in slots.items() for x in (F.lit(slot), value.cast("string"))])
    met = rows.join(F.broadcast(checked_templates(table).withColumnRenamed("name", "_name")), F.col(name) == F.col("_name"), "left")

    def part(literal: Column, slot: Column) -> Column:
        value = F.get(F.map_values(F.map_filter("_values", lambda k, v: k == slot)), F.lit(0))
        fault = F.raise_error(F.concat(F.lit("no value for slot "), slot))
        return F.when(slot.isNull(), literal).otherwise(F.concat(literal, F.coalesce(value, fault.cast("string"))))

    prompt = F.array_join(F.zip_with("literals", "order", part), "")
    return met.withColumn("_values", values).withColumn("prompt", prompt).drop("_name", "literals", "order", "_values")
