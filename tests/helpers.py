"""Small datasets built in tests."""

from pyspark.sql import functions as F

from rowecho.sources.catalog import Dataset, DatasetSpec
from rowecho.sources.positions import POS


def dataset_of(spark, rows, schema, name="toy data", alias="toy", widened=(), **spec):
    """A dataset whose rows are in list order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{POS} bigint, {schema}").coalesce(2)
    columns = tuple(c for c in df.columns if c != POS)
    return Dataset(DatasetSpec(name, alias, name, "", (), **spec), df, columns, widened)


def words(*items):
    """Expected array of (value, kind, in_lexicon)."""
    if not items:
        return F.array().cast("array<struct<name:string,value:string,kind:string,in_lexicon:boolean,as_integer:string>>")
    return F.array(*[
        F.struct(F.lit(v).alias("name"), F.lit(v).alias("value"), F.lit(k).alias("kind"),
                 F.lit(i).alias("in_lexicon"), F.lit(None).cast("string").alias("as_integer"))
        for v, k, i in items
    ])


def cells(*items):
    """Expected array of (name, value, as_integer)."""
    return F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), F.lit("other").alias("kind"),
                 F.lit(True).alias("in_lexicon"), F.lit(i).cast("string").alias("as_integer"))
        for n, v, i in items
    ])


def joined(spark, output, rule, expected=None, label=None, test="feature_values_uninf",
           prompt="PROMPT: ", echoes=False, case_sensitive=False, features_sep=", "):
    """One probe joined with one response."""
    from rowecho.operators.decide import EXPECTED_TYPE
    values = {
        "probe_id": "p", "model": "m", "test": test, "dataset": "d", "feature": "", "trial": 0,
        "serialization": 0, "features_sep": features_sep, "prompt": prompt, "rule": rule,
        "case_sensitive": case_sensitive, "output": output, "echoes": echoes,
    }
    # literals, so many cases make one plan without Python rows
    row = spark.range(0, 1, 1, 1).select(
        F.lit(label).cast("string").alias("label"), *[F.lit(v).alias(k) for k, v in values.items()])
    return row.withColumn("expected", (F.lit(None) if expected is None else expected).cast(EXPECTED_TYPE))
