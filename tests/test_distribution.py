import pytest
from pyspark.sql import functions as F

from rowecho.operators import distribution as D, profile
from rowecho.plans import probes as P
from tests.helpers import dataset_of


def parsed(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [[(p.value, p.weight) for p in r.p] for r in df.select("i", fn(F.col("t")).alias("p")).orderBy("i").collect()]


def test_shares_are_read_from_answers(spark):
    got = parsed(spark, D.parse_shares, "A: 60%, B: 40 %", "- 'x y': 12.5%\n- z: .5%", "a:b: 3%; c: no", "", "12: 50%, 13: 50%",
                 "The distribution is: yes: 10%", "{'t': 1%}")
    assert got == [[("A", 60.0), ("B", 40.0)], [("x y", 12.5), ("z", 0.5)], [("a:b", 3.0)], [], [("12", 50.0), ("13", 50.0)],
                   [("The distribution is: yes", 10.0)], [("t", 1.0)]]


def test_lists_are_read_from_answers(spark):
    got = parsed(spark, D.parse_list, "[A, 'A', \"b c\"]", "List: [x, y", "a, b;c\nd", "", "[]", "[ , ,1]")
    assert [[v for v, _ in g] for g in got] == [["A", "A", "b c"], ["x", "y"], ["a", "b", "c", "d"], [], [], ["1"]]


@pytest.fixture(scope="module")
def toy(spark):
    rows = [("a", i % 4, "x:y") for i in range(6)] + [("B", 9, "z")] * 2
    ds = dataset_of(spark, rows, "letter string, number int, odd string")
    return ds, profile.feature_values(ds, ["letter", "number", "odd"])


def decided(spark, toy, feature, test, *outputs, echo=False):
    ds, values = toy
    probe = P.distribution(ds, values).filter((F.col("feature") == feature) & (F.col("test") == test))
    said = spark.createDataFrame([(f"m{i}", o) for i, o in enumerate(outputs)], "model string, output string")
    joined = probe.crossJoin(said).withColumn("echoes", F.lit(echo))  # one probe
    if echo:
        joined = joined.withColumn("output", F.concat("prompt", "output"))
    out = D.decide_distribution(joined, values).orderBy("model").collect()
    return [(round(r.distance, 6), None if r.gap is None else round(r.gap, 6), r.passed) for r in out]


def test_distances_of_letters(spark, toy):
    got = decided(spark, toy, "letter", "distribution_shares", "a: 75%, b: 25%", "A: 3%, b: 1%", "a: 100%", "c: 100%", "", "a: 70%, b: 30%")
    assert got == [(0, None, True), (0, None, True), (0.25, None, False), (1, None, False), (1, None, False), (0.05, None, True)]
    got = decided(spark, toy, "letter", "distribution_list", "[a, a, a, b]", "a", "[a, q]", echo=True)
    assert got == [(0, None, True), (0.25, None, False), (0.5, None, False)]


def test_gaps_of_numbers(spark, toy):
    # the truth: 0, 1: two of eight each, 2, 3: one each, 9: two
    near = decided(spark, toy, "number", "distribution_shares", "0: 25%, 1: 25%, 2: 12.5%, 3: 12.5%, 9: 25%", "0: 25%, 1: 25%, 2: 12.5%, 3: 12.5%, 10: 25%",
                   "9: 100%", "nothing", "0: 50%, ten: 50%")
    assert near[0] == (0, 0, True) and near[1] == (0.25, 0.25, False) and near[2] == (0.75, 0.75, False) and near[3] == (1, 1, False)
    assert near[4] == (0.75, 0.5, False)


def test_features_with_too_many_values_are_not_asked(spark, toy):
    ds, values = toy
    probes = P.distribution(ds, values, 2).collect()
    assert {(p.feature, p.test) for p in probes} == {(f, t) for f in ("letter", "odd") for t in ("distribution_list", "distribution_shares")}
    assert all("letter: a, B\n" in p.prompt for p in probes if p.feature == "letter")
