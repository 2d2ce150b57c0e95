from dataclasses import replace

import pytest
from pyspark.sql import functions as F, types as T

from rowecho.operators import profile, rows, sampling
from rowecho.sources import catalog
from rowecho.sources.lexicon import lexicon_from_words, outside_lexicon, tag_lexicon
from rowecho.sources.lineage import cut_lineage
from rowecho.sources.positions import POS, seeded_shuffle, with_positions
from tests.helpers import dataset_of


def write(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(tmp_path)


def values(ds, column):
    return [r[0] for r in ds.df.orderBy(POS).select(f"`{column}`").collect()]


GERMAN = """,Age,Sex,Job,Housing,Saving accounts,Checking account,Credit amount,Duration,Purpose,Risk
0,67,male,2,own,NA,little,1169,6,radio/TV,good
1,22,female,2,own,little,moderate,,48,radio/TV,bad
"""


def test_drop_missing_and_widening(spark, tmp_path):
    root = write(tmp_path, "german.csv", GERMAN)
    ds = catalog.load_dataset(spark, "german", root, widen_integers=True)
    assert ds.columns[0] == "Age" and "_row" not in ds.columns
    assert values(ds, "Saving accounts") == [None, "little"]
    assert ds.widened == ("Credit amount",)
    from rowecho.functions.text import row_text
    text = ds.df.orderBy(POS).select(row_text(ds.df, ds.columns, widened=ds.widened)).first()[0]
    assert "The Saving accounts is nan" in text and "The Credit amount is 1169.0" in text and "The Age is 67," in text


def test_quotes_and_commas(spark, tmp_path):
    root = write(tmp_path, "titanic/titanic_train.csv",
                 "PassengerId,Survived,Pclass,Name,Sex,Age,SibSp,Parch,Ticket,Fare,Cabin,Embarked\n"
                 '1,0,3,"Braund, Mr. ""Owen"" Harris",male,22,1,0,A/5 21171,7.25,,S\n')
    ds = catalog.load_dataset(spark, "titanic", root)
    assert values(ds, "Name") == ['Braund, Mr. "Owen" Harris']
    assert values(ds, "Cabin") == [None] and ds.dtype("Age") == T.DoubleType()


def test_separator_dedup_and_shuffle(spark, tmp_path):
    lines = ["Student ID;Student Country;Question ID;Type of Answer;Question Level;Topic;Subtopic;Keywords"]
    for i in range(60):
        lines.append(f"{i};Portugal;{i % 20};1;Basic;Topic {i % 20};Sub;a,b")
    root = write(tmp_path, "MathE.csv", "\n".join(lines) + "\n")
    ds = catalog.load_dataset(spark, "MathE", root)
    assert sorted(values(ds, "Student ID")) == list(range(20))  # the first of each kept
    assert sorted(values(ds, POS)) == list(range(20))
    assert values(ds, "Student ID") != list(range(20))


def test_class_index_is_decoded(spark, tmp_path):
    root = write(tmp_path, "iris.csv", "sepal length (cm),sepal width (cm),petal length (cm),petal width (cm),target\n5.1,3.5,1.4,0.2,0\n6.0,3.0,4.0,1.0,2\n6.0,3.0,4.0,1.0,7\n")
    ds = catalog.load_dataset(spark, "iris", root)
    assert sorted(values(ds, "target"), key=str) == [None, "setosa", "virginica"]


def test_columns_are_found_by_the_header(spark, tmp_path):
    root = write(tmp_path, "moved.csv", "b,a\nx,1\ny,2\n")
    spec = catalog.DatasetSpec("moved", "moved", "Moved", "moved.csv", (("a", "int"), ("b", "string")))
    ds = catalog.load_dataset(spark, "moved", root, (spec,))
    assert sorted(tuple(r) for r in ds.df.select("a", "b").collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="no column c"):
        catalog.load_dataset(spark, "moved", root, (replace(spec, columns=(*spec.columns, ("c", "int"))),))


def test_names(spark):
    assert catalog.find_spec("adult") is catalog.find_spec("adult income")
    assert len(catalog.PUBLIC_DATASETS) == 11
    with pytest.raises(ValueError):
        catalog.find_spec("no such data")


def test_file_positions_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).select("id", F.lit("x" * 50).alias("pad")).coalesce(1).write.csv(path, header=True)
    want = [(str(i), i) for i in range(5000)]
    for size in ("16384", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        df = spark.read.csv(path, header=True)
        n = df.rdd.getNumPartitions()
        got = sorted(((r.id, r[POS]) for r in with_positions(df).select("id", POS).collect()), key=lambda r: r[1])
        assert got == want, n
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_shuffle_is_a_permutation_for_any_partitioning(spark):
    df = spark.range(500).withColumn(POS, F.col("id"))
    one = sorted(tuple(r) for r in seeded_shuffle(df.coalesce(1), 3).collect())
    eight = sorted(tuple(r) for r in seeded_shuffle(df.repartition(8), 3).collect())
    assert one == eight and sorted(p for _, p in one) == list(range(500)) and [i for i, _ in one] != [p for _, p in one]


def test_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn(POS, F.col("id"))
    picked = [sorted(r.id for r in sampling.seeded_sample(d, 20, 42).collect()) for d in (df.coalesce(1), df.repartition(7))]
    assert picked[0] == picked[1] and len(set(picked[0])) == 20


def test_median(spark):
    for numbers in ([3.0], [1.0, 2.0], [5.0, 1.0, 5.0, 5.0], [float(i * 7 % 1001) for i in range(1001)]):
        df = spark.createDataFrame([(n,) for n in numbers] + [(None,)], "x double")
        want = sorted(numbers)
        want = (want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2
        assert profile.median_threshold(df, "x") == want
        assert profile.median_threshold(df, "x", limit=5) == want
    assert profile.median_threshold(spark.createDataFrame([], "x double"), "x") is None


def test_features_count_missing_as_a_value(spark):
    ds = dataset_of(spark, [(1, None, 2.0), (1, "a", float("nan")), (1, "a", None)], "`a.b` int, b string, c double")
    got = {r.feature: (r.n_distinct, r.has_null) for r in profile.dataset_features(ds).collect()}
    assert got == {"a.b": (1, False), "b": (2, True), "c": (2, True)}
    usable, n, _ = profile.varying_columns(ds)
    assert usable == ["b", "c"] and n == 3


def test_values_in_first_seen_order(spark):
    ds = dataset_of(spark, [("z",), (None,), ("a",), ("z",)], "f string")
    got = [(r.value, r.kind, r.n, r.pct) for r in profile.feature_values(ds, ["f"]).orderBy("first_pos").collect()]
    assert got == [("z", "string", 2, 50.0), ("nan", "other", 1, 25.0), ("a", "string", 1, 25.0)]


def test_keep_first_groups_missing_values(spark):
    df = spark.createDataFrame([(0, None, 1), (1, None, 1), (2, "a", 1)], f"{POS} bigint, a string, b int")
    assert sorted(r[POS] for r in rows.keep_first(df, ["a", "b"]).collect()) == [0, 2]


def test_rename_checks_length(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows.rename_columns(df, {"a": "x", "b": "y"}, ["a"]).columns == ["y"]
    with pytest.raises(ValueError):
        rows.rename_columns(df, {"a": "x"}, [])


def test_trailing_columns():
    assert rows.trailing_columns(["a", "b", "c", "d"], 3) == ["b", "c", "d"]
    assert rows.trailing_columns(["a", "b"], 3) == ["b"]


def test_lexicon_rules(spark):
    lexicon = lexicon_from_words(spark.createDataFrame([("Good",), ("bad",), ("blue-collar",), ("good",)], "word string"))
    assert sorted(r.word for r in lexicon.collect()) == ["bad", "good"]
    asked = spark.createDataFrame(
        [("good", "string"), ("BAD", "string"), ("A", "string"), ("quite rich", "string"), ("blue-collar", "string"),
         ("workclass", "string"), ("False", "bool"), ("nan", "other")], "value string, kind string")
    outside = ["blue-collar", "quite rich", "workclass"]
    assert sorted(r.value for r in outside_lexicon(asked, lexicon).collect()) == outside
    assert sorted(r.value for r in tag_lexicon(asked, lexicon).filter("NOT in_lexicon").collect()) == outside


def test_written_copy_keeps_any_column_name(spark):
    df = spark.createDataFrame([(1, 2.0)], "`sepal length (cm)` int, `a.b; c=` double")
    copy = cut_lineage(df)
    assert copy.columns == df.columns and copy.collect() == df.collect()
