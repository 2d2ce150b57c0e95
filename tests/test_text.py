import random

import pytest
from pyspark.sql import functions as F, types as T

from rowecho.functions.text import (
    EXEMPLAR_DEFAULT, Separators, answer_text, double_text, fill_template, name_list, normalise_missing,
    row_text, template_slots, value_text,
)
from rowecho.plans import templates
from tests.helpers import dataset_of


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_doubles_print_as_in_python(spark):
    rng = random.Random(7)
    values = [10 ** rng.uniform(-8, 16) * rng.choice([1, -1]) for _ in range(3000)]
    values += [round(rng.uniform(-1e5, 1e5), rng.randint(0, 4)) for _ in range(2000)]
    values += [0.0, -0.0, 2e-3, 1e-4, 1e-5, 1e7, 1e15, 1e16, 1e23, 1e100, float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", double_text(F.col("x")).alias("t"))
    assert [(repr(r.x), r.t) for r in rows.collect() if repr(r.x) != r.t] == []


@pytest.mark.parametrize("value, dtype, widen, text", [
    (None, "string", False, "nan"), ("admin.", "string", False, "admin."), (None, "int", False, "nan"),
    (47, "int", False, "47"), (47, "int", True, "47.0"), (25.0, "double", False, "25.0"),
    (True, "boolean", False, "True"), (False, "boolean", False, "False"), (None, "boolean", False, "nan"),
    (12345678.5, "double", False, "12345678.5"), (0.00001, "double", False, "1e-05"),
])
def test_value_text(spark, value, dtype, widen, text):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    assert df.select(value_text(F.col("x"), df.schema["x"].dataType, widen)).first()[0] == text


def test_answer_text_drops_integral_fraction(spark):
    df = spark.createDataFrame([(256.0,), (23.5,)], "x double")
    assert [r[0] for r in df.select(answer_text(F.col("x"), T.DoubleType())).collect()] == ["256", "23.5"]


def test_missing_tokens(spark):
    df = spark.createDataFrame([("NA",), ("null",), ("?",), ("None",), ("x",)], "x string")
    assert [r[0] for r in df.select(normalise_missing(F.col("x"))).collect()] == [None, None, "?", None, "x"]


ROW = [("a b", 1, 2.5)]
SCHEMA = "`first name` string, `marital.status` int, z double"


def text(spark, **options):
    ds = dataset_of(spark, ROW, SCHEMA)
    return ds.df.select(row_text(ds.df, ds.columns, **options)).first()[0]


def test_row_text_forms(spark):
    assert text(spark) == "The first name is a b, The marital.status is 1, The z is 2.5"
    assert text(spark, separators=EXEMPLAR_DEFAULT, remove_last_sep=False) == \
        "The first name is a b. The marital.status is 1. The z is 2.5. "
    assert text(spark, separators=Separators("; ", " = ", ""), ignored=["marital.status"]) == "first name = a b; z = 2.5"
    assert text(spark, names={"first name": "A", "marital.status": "B", "z": "C"}) == "The A is a b, The B is 1, The C is 2.5"


def test_row_text_checks_names(spark):
    with pytest.raises(ValueError):
        text(spark, names={"z": "Z"})


def test_templates(spark):
    assert template_slots(templates.MEMBERSHIP) == ["dname", "example", "serialization"]
    assert one(spark, fill_template("a {dname} b {fname} {dname}", dname="X", fname="Y")) == "a X b Y X"
    # a value that looks like a slot is not filled again
    assert one(spark, fill_template("{dname}/{fname}", dname="{fname}", fname="Y")) == "{fname}/Y"
    for slots in ({}, {"dname": None}, {"fname": "x"}):
        with pytest.raises(ValueError):
            fill_template("a {dname}", **slots)
    with pytest.raises(ValueError):
        fill_template("{dname}", dname="a", fname="b", values="c", example="d", serialization="e")


def test_name_list(spark):
    assert one(spark, name_list(F.array(F.lit("a"), F.lit("b c")))) == "[a, b c]"


def test_wording_of_classification():
    text = templates.CLASSIFICATION.format(
        answers=templates.ANSWERS_YES_NO, serialization="S", question=templates.QUESTIONS["titanic"])
    assert text == ('\nAnswer only by "Yes" or "No"\nExample: S\n\n'
                    "Did this passenger survive the Titanic disaster? Yes or no?\nAnswer: ")
    assert len(templates.QUESTIONS) == 10
