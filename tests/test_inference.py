import uuid

import pytest
from pyspark.sql import functions as F

from rowecho.sources import inference as I
from rowecho.sources.lineage import checkpoint_folder


def frame(spark, *columns):
    return spark.createDataFrame(list(zip(*columns)), ", ".join(f"`c {i}` string" for i in range(len(columns))))


def types(spark, *cells, **options):
    return I.types_of(I.profile_cells(frame(spark, cells)), **options)["c 0"]


@pytest.mark.parametrize("cells, want", [
    (("1", " -2 ", "+3"), "bigint"), (("1", None), "double"), (("1", "NA", ""), "double"), (("1", "2.5", "1e3", ".5", "inf"), "double"),
    (("True", "False"), "boolean"), (("True", ""), "string"), (("True", "1"), "string"), (("1", "x"), "string"), ((None, "", "nan"), "double"),
    (("2024-01-31", "2024-02-01 10:00"), "string"), (("9" * 19, "1"), "double"), (("1_000", "2"), "string"), (("",), "double"),
])
def test_a_column_takes_the_least_type_that_holds_its_cells(spark, cells, want):
    assert types(spark, *cells) == want


def test_types_can_be_asked_for(spark):
    assert types(spark, "1", "NA", integers_with_gaps=True) == "bigint"
    assert types(spark, "2024-01-31", "", "2024-02-01T10:00:30.5", dates=True) == "timestamp"
    assert types(spark, "2024-13-31", dates=True) == "string"  # no such month


def test_merged_profiles_are_those_of_the_whole(spark):
    a, b = frame(spark, ["1", "x", None], ["1", "2", "3"]), frame(spark, ["2.5", ""], ["4", "5.0"])
    merged = I.merge_profiles(I.profile_cells(a), I.profile_cells(b)).orderBy("place").collect()
    assert merged == I.profile_cells(a.unionByName(b)).orderBy("place").select(*merged[0].asDict()).collect()
    assert I.types_of(I.merge_profiles(I.profile_cells(a), I.profile_cells(b))) == {"c 0": "string", "c 1": "double"}
    none = I.profile_cells(a.limit(0)).collect()
    assert all(r.n_text == 0 for r in none) and len(none) == 2


def test_cells_that_do_not_fit_are_listed(spark):
    df = frame(spark, ["1", "x", "x", "NA", "99999999999", " 7"], ["a", "", None, "nan", "b", "c"], ["True", "false", "no", "", "1", "TRUE"])
    kinds = {"c 0": "int", "c 1": "string", "c 2": "boolean"}
    odd = {(r.column, r.cell): r.n for r in I.misfits(df, kinds).collect()}
    assert odd == {("c 0", "x"): 2, ("c 0", "99999999999"): 1, ("c 2", "no"): 1, ("c 2", "1"): 1}
    assert [tuple(r) for r in I.typed(df, kinds).collect()] == [
        (1, "a", True), (None, None, False), (None, None, None), (None, None, None), (None, "b", None), (7, "c", True)]
    with pytest.raises(ValueError, match="no rule"):
        I.typed(df, {"c 0": "binary"})


def test_files_are_profiled_apart(spark):
    path = f"{checkpoint_folder(spark)}/cells_{uuid.uuid4().hex}"
    spark.range(10).select(F.col("id").cast("string").alias("n"), F.lit("x, \"y\"").alias("t")).coalesce(1).write.option(
        "header", True).csv(f"{path}/a")
    spark.range(5).select(F.lit("").alias("n"), F.lit("1").alias("t")).coalesce(1).write.option("header", True).csv(f"{path}/b")
    cells = I.read_cells(spark, path, recursiveFileLookup="true")
    rows = I.profile_cells(cells, by_file=True).collect()
    assert len(rows) == 4 and len({r.file for r in rows}) == 2
    assert I.types_of(I.merge_profiles(I.profile_cells(cells, by_file=True))) == {"n": "double", "t": "string"}
