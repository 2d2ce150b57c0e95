import pytest
from pyspark.sql import functions as F

from rowecho.plans import templates, wording

KIND = "name string, slots array<string>, text string"


def rows(spark):
    return spark.createDataFrame([("a", "x"), ("b", "{dname}"), ("none", "y"), (None, "z"), ("a", None)], "t string, v string")


def test_a_new_wording_is_a_row(spark):
    table = spark.createDataFrame([("a", ["dname"], "{dname}, {dname}!\n"), ("b", ["fname", "dname"], "<{fname}|{dname}>")], KIND)
    got = wording.fill_by_name(rows(spark).filter("v is not null"), table, "t", {"dname": F.col("v"), "fname": F.lit(3)})
    assert {(r.t, r.prompt) for r in got.collect()} == {("a", "x, x!\n"), ("b", "<3|{dname}>"), ("none", None), (None, None)}
    assert got.columns == ["t", "v", "prompt"]


@pytest.mark.parametrize("slots, text, fault", [
    (["dname"], "{fname}", "do not fit"), (["dname", "fname"], "{dname}", "do not fit"), (["dname"], "{dname} {", "do not fit"),
    (["qname"], "{qname}", "no value for slot")])
def test_templates_are_checked(spark, slots, text, fault):
    table = spark.createDataFrame([("a", slots, text)], KIND)
    with pytest.raises(Exception, match=fault):
        wording.fill_by_name(rows(spark).limit(1), table, "t", {"dname": F.lit("d"), "fname": F.lit("f")}).collect()


def test_null_values_are_missing(spark):
    table = spark.createDataFrame([("a", ["dname"], "{dname}")], KIND)
    with pytest.raises(Exception, match="no value for slot dname"):
        wording.fill_by_name(rows(spark).filter("v is null"), table, "t", {"dname": F.col("v")}).collect()


def test_all_templates_are_rows(spark):
    got = {r.name: r.text for r in wording.checked_templates(wording.own_templates(spark)).join(wording.own_templates(spark), "name").collect()}
    assert got["membership"] == templates.MEMBERSHIP and len(got) >= 18
