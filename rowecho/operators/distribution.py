"""Answers that give the distribution of a feature, against the measured one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowecho.functions.answers import crop_echo

TOLERANCE = 0.1  # distance up to which an answer counts as right
SHARE = r"([^,;:\n]*(?::(?!\s*[0-9.]+\s*%)[^,;:\n]*)*):\s*([0-9]*\.?[0-9]+)\s*%"  # value: number %
EDGES = " \t\r\n'\"[](){}*-"


def parse_shares(text: Column) -> Column:
    """(value, weight) of every ``value: number%`` in a text, values trimmed of brackets and quotes."""
    values = F.regexp_extract_all(text, F.lit(SHARE), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(SHARE), F.lit(2))
    return F.zip_with(values, numbers, lambda v, n: F.struct(
        F.btrim(v, F.lit(EDGES)).alias("value"), n.try_cast("double").alias("weight")))


def parse_list(text: Column) -> Column:
    """(value, weight 1) of every entry of the first list in square brackets, or of the text where there is none. An
    entry left open at the end counts."""
    inner = F.regexp_extract(text, r"\[([^\]]*)", 1)
    listed = F.when(F.contains(text, F.lit("[")), inner).otherwise(text)
    entries = F.transform(F.split(listed, r"[,;\n]"), lambda v: F.btrim(v, F.lit(EDGES)))
    return F.transform(F.filter(entries, lambda v: v != ""), lambda v: F.struct(v.alias("value"), F.lit(1.0).alias("weight")))


def answered_shares(joined: DataFrame) -> DataFrame:
    """(probe_id, model, value, share): the distribution that a response gives, values in lower case, shares adding up to 1. A
    response without any has no row."""
    answer = crop_echo(F.col("output"), F.col("prompt"), F.col("echoes"))
    pairs = F.when(F.col("test") == "distribution_list", parse_list(answer)).otherwise(parse_shares(answer))
    each = joined.select("probe_id", "model", F.inline(pairs)).groupBy(
        "probe_id", "model", F.lower("value").alias("value")).agg(F.sum("weight").alias("weight"))
    total = Window.partitionBy("probe_id", "model")  # as many rows as an answer has values
    return each.withColumn("_all", F.sum("weight").over(total)).filter("_all > 0").select(
        "probe_id", "model", "value", (F.col("weight") / F.col("_all")).alias("share"))


def decide_distribution(joined: DataFrame, values: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(probe_id, model, test, dataset, feature, distance, gap, passed) for responses to distribution probes.

    ``joined`` is probes joined with responses; ``values`` is ``feature_values`` of their features. ``distance`` is the total
    variation: half the sum of all differences of shares, what an answer gives to unknown values included. ``gap``,
    for features whose values are all numbers, is the largest difference of the shares up to a number, so that an answer
    beside the right number is better than one far off; null for others. The gap decides where there is one.
    """
    asked = joined.filter(F.col("test").isin("distribution_list", "distribution_shares"))
    total = Window.partitionBy("dataset", "feature")  # few values, or the feature is not asked
    truth = values.groupBy("dataset", "feature", F.lower("value").alias("value")).agg(F.sum("n").alias("n")).select(
        "dataset", "feature", "value", (F.col("n") / F.sum("n").over(total)).alias("truth"))
    keys = ["probe_id", "model", "test", "dataset", "feature"]
    probes = asked.select(*keys)
    given = answered_shares(asked).join(probes, ["probe_id", "model"])
    # one row for each value of the truth and of the answer
    both = probes.join(truth, ["dataset", "feature"]).select(*keys, "value", "truth", F.lit(0.0).alias("share")).unionByName(
        given.select(*keys, "value", F.lit(0.0).alias("truth"), "share"))
    met = both.groupBy(*keys, "value").agg((F.sum("share") - F.sum("truth")).alias("more"), F.max("truth").alias("truth"))
    number = F.col("value").try_cast("double")
    is_number = F.bool_and(number.isNotNull() | (F.col("truth") == 0)).over(Window.partitionBy(*keys))
    # a value that is no number lies behind all numbers
    along = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_number")).rangeBetween(Window.unboundedPreceding, 0)
    ranked = met.withColumn("_number", number).withColumn("_is_number", is_number).withColumn("_sum", F.sum("more").over(along))
    out = ranked.groupBy(*keys).agg(
        (F.sum(F.abs("more")) / 2).alias("_half"), F.sum("more").alias("_more"), F.max(F.abs("_sum")).alias("_gap"),
        F.bool_and("_is_number").alias("_is_number"))
    # without an answer all of the truth is missing
    empty = F.col("_more") < -0.5
    distance = F.when(empty, F.lit(1.0)).otherwise(F.col("_half"))
    gap = F.when(F.col("_is_number"), F.when(empty, F.lit(1.0)).otherwise(F.col("_gap")))
    scored = out.select(*keys, distance.alias("distance"), gap.alias("gap"))
    return scored.withColumn("passed", F.coalesce("gap", "distance") <= tolerance)
