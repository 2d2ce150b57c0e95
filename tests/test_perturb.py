import pytest
from pyspark.sql import functions as F

from checks import queries
from rowecho.operators import members, perturb
from rowecho.sources.positions import POS
from tests.helpers import dataset_of


@pytest.fixture(scope="module")
def grid(spark):
    """A dataset that holds half of the combinations of its values, and of any two columns' values."""
    cells = [(a, b, c + 0.5) for i, a in enumerate("uvw") for b in range(4) for c in range(2) if (i + b + c) % 2]
    return dataset_of(spark, cells * 2, "a string, b int, c double")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(POS, *columns).collect())


def test_altered_rows_are_new_and_keep_observed_values(spark, grid):
    out = perturb.replace_values(grid, 2, 0).cache()
    assert out.count() == grid.df.count() and out.select(POS).distinct().count() == out.count()
    assert out.filter("altered").join(grid.df, ["a", "b", "c"], "left_semi").count() == 0
    for c in grid.columns:
        assert out.select(c).distinct().join(grid.df.select(c).distinct(), c, "left_anti").count() == 0
    # every copy differs from its row in at most two columns
    both = out.filter("altered").join(grid.df.select(POS, *[F.col(c).alias(f"_{c}") for c in grid.columns]), POS)
    changed = sum((F.col(c) != F.col(f"_{c}")).cast("int") for c in grid.columns)
    assert {r[0] for r in both.select(changed).distinct().collect()} <= {1, 2}


def test_same_rows_for_any_partitioning(spark, grid):
    from dataclasses import replace
    one = perturb.replace_values(replace(grid, df=grid.df.coalesce(1)), 2, 5)
    many = perturb.replace_values(replace(grid, df=grid.df.repartition(8)), 2, 5)
    assert rows(one, "a", "b", "c", "altered") == rows(many, "a", "b", "c", "altered")


def test_a_full_table_cannot_be_altered(spark):
    full = dataset_of(spark, [(a, b) for a in "xy" for b in "xy"], "a string, b string")
    with pytest.raises(ValueError, match="every combination"):
        perturb.replace_values(full, 1, 0).collect()


def test_rows_of_a_full_table_come_back_unaltered_where_that_is_asked_for(spark, tmp_path):
    cells = [(a, b) for a in "xy" for b in (1, 2, None)] * 2
    full = dataset_of(spark, cells, "a string, b int")
    out = perturb.replace_values(full, 1, 0, keep_stuck=True)
    assert rows(out, "a", "b", "altered") == [(i, *c, False) for i, c in enumerate(cells)]
    # one combination is missing: every row becomes that one
    nearly = dataset_of(spark, cells[1:6], "a string, b int")
    assert rows(perturb.replace_values(nearly, 1, 0, keep_stuck=True), "a", "b", "altered") == [(i, "x", 1, True) for i in range(5)]

    part = [(i, f"n{i % 3}", f"b{i // 3 % 2}", f"t{i // 6 % 2}", 1, 1.0) for i in range(24)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(
        f"{tmp_path}/part.parquet")
    found = queries.perturb_until_new(spark, str(tmp_path))
    assert rows(found, "p_name", "p_brand", "p_type", "altered") == [(*r[:4], False) for r in part]
    assert [tuple(r) for r in queries.perturbed_not_in_dataset(spark, str(tmp_path)).collect()] == [(24, 0)]


def test_a_row_without_a_new_combination_takes_further_columns(spark):
    # both neighbours of (0, 0) along one column are rows: only two columns together have something new
    ds = dataset_of(spark, [(0, 0, None), (0, 1, None), (0, 2, None), (1, 0, None), (0, 0, None)], "a int, b int, c string")
    for seed in range(3):
        out = perturb.replace_values(ds, 1, seed).cache()
        assert sorted(r[POS] for r in out.filter("altered").collect()) == [0, 1, 2, 3, 4]
        assert {(r.a, r.b) for r in out.collect()} <= {(1, 1), (1, 2)}


def test_a_nearly_full_table_is_altered_completely(spark):
    cells = [(a, b, c) for a in range(6) for b in range(6) for c in range(6)]
    ds = dataset_of(spark, cells[1:], "a int, b int, c int")
    lone = ds.df.filter("a = 0 AND b = 0 AND c = 1")  # only c = 0 is free
    usable = ["a", "b", "c"]
    reached = [s for s in range(40) if lone.select(perturb._chosen(ds, usable, 1, s)).first()[0] == ["c"]]
    out = perturb.replace_values(ds, 1, reached[0], lone).collect()
    assert [(r.a, r.b, r.c, r.altered) for r in out] == [(0, 0, 0, True)]


def test_a_value_most_rows_hold_is_replaced_by_the_others_as_often_as_they_occur(spark):
    n = 3000
    values = [0 if i % 10 else 1 + (i // 10) % 10 // 7 for i in range(n)]  # 90 % 0, 7 % 1, 3 % 2
    ds = dataset_of(spark, [(v, i) for i, v in enumerate(values)], "v int, i int")
    only = ds.df.filter("v = 0")
    # both columns are altered: two of two usable ones
    new = [r.v for r in perturb.replace_values(ds, 2, 3, only).select("v").collect()]
    assert len(new) == 2700 and new.count(0) < 0.15 * len(new)  # 0 comes back in further tries only
    assert abs(new.count(1) / (new.count(1) + new.count(2)) - 0.7) < 0.04


def test_missing_values(spark):
    ds = dataset_of(spark, [("a", None, 1), ("b", "x", 2), ("c", "y", 3)], "a string, b string, c int")
    parity = perturb.replace_values(ds, 1, 0, parity=True)
    first = parity.filter(f"{POS} = 0").first()
    assert (first.a, first.b, first.c, first.altered) == ("a", None, 1, False)
    fixed = perturb.replace_values(ds, 1, 0)
    assert fixed.filter("altered").count() == 3
    assert members.tag_members(fixed, ds.df, ds.columns).filter("is_member").count() == 0


def test_constant_columns_are_left_alone(spark):
    ds = dataset_of(spark, [(i, i % 2, "k") for i in range(10)], "a int, b int, c string")
    assert {r.c for r in perturb.replace_values(ds, 2, 0).collect()} == {"k"}
    with pytest.raises(ValueError):
        perturb.replace_values(dataset_of(spark, [("k",)] * 3, "a string"), 1, 0)


def test_swap_count():
    assert [perturb.swap_count(*a) for a in ((2, 5), (5, 5), (6, 5), (4, 2))] == [2, 5, 3, 1]


def test_swapped_columns(spark):
    ds = dataset_of(spark, [tuple(f"{c}{i}" for c in "abcd") for i in range(50)], "a string, b string, c string, d string")
    out = perturb.swap_columns(ds, 2, 0).collect()
    assert all(sorted(r.swapped) == sorted(r.original) and r.swapped != r.original for r in out)
    with pytest.raises(ValueError):
        perturb.swap_columns(ds, 7)


def test_membership_and_missing_values(spark):
    ds = dataset_of(spark, [("a", None), ("b", "x")], "a string, b string")
    assert members.members(ds.df, ds.df, ds.columns).count() == 2
    assert members.members(ds.df, ds.df, ds.columns, null_safe=False).count() == 1
    assert members.non_members(ds.df, ds.df, ds.columns, null_safe=False).count() == 1
    few = members.tag_members(ds.df, ds.df, ds.columns, few=True)
    assert few.filter("is_member").count() == 2
