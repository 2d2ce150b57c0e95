import uuid

import pytest
from pyspark.sql import functions as F

from rowecho.functions.draws import draw_key
from rowecho.operators import members, sampling, score
from rowecho.sources.lineage import checkpoint_folder
from rowecho.sources.positions import POS


def place(spark):
    return f"{checkpoint_folder(spark)}/bits_{uuid.uuid4().hex}"


KIND = "a int, b string, x double, t timestamp"


@pytest.fixture(scope="module")
def known(spark):
    rows = [(i % 50, f"v{i}", i / 4, None) for i in range(3000)] + [(None, None, None, None), (1, "", 0.0, None), (2, "z", float("nan"), None)]
    return spark.createDataFrame(rows, KIND)


def test_filtered_membership_equals_membership(spark, known):
    asked = [(i % 50, f"v{i}", i / 4 if i % 3 else -i / 4, None) for i in range(4000)] + [
        (None, None, None, None), (1, None, 0.0, None), (1, "", -0.0, None), (2, "z", float("nan"), None), (5, "v5", 1.25, None)]
    rows = spark.createDataFrame(asked, KIND).withColumn("bits", F.lit(1)).withColumn("bucket", F.lit("x"))
    rows = rows.drop("bits", "bucket")
    for per_row in (1, 16):
        bits = members.write_filter(known, known.columns, place(spark), per_row)
        for null_safe in (True, False):
            got = members.tag_members_filtered(rows, known, bits, null_safe)
            want = members.tag_members(rows, known, known.columns, null_safe)
            assert sorted(map(str, got.drop("is_candidate").collect())) == sorted(map(str, want.collect()))
        candidates = members.tag_candidates(rows, bits).filter("is_candidate").count()
        n_members = members.tag_members(rows, known, known.columns).filter("is_member").count()
        assert n_members <= candidates <= n_members + (200 if per_row == 16 else 1000)


def test_a_filter_is_kept_and_read_again(spark, known):
    path = place(spark)
    bits = members.write_filter(known, ["a", "b"], path)
    again = members.RowFilter(spark, path, ("a", "b"), bits.n_bits)
    assert members.tag_candidates(known, again).filter("NOT is_candidate").count() == 0
    assert bits.n_bits == 65536 and again.bits().count() == 2
    assert members.filter_bits(0) == members.BITMAP_BITS and members.filter_bits(4097) == 131072


def test_a_filter_of_no_rows(spark, known):
    bits = members.write_filter(known.limit(0), known.columns, place(spark))
    got = members.tag_members_filtered(known.limit(9), known.limit(0), bits)
    assert got.filter("is_member OR is_candidate").count() == 0 and got.count() == 9


@pytest.mark.parametrize("n, top_rows", [(0, 10), (1, 1), (700, 1), (700, 100_000), (1999, 3), (2000, 5), (5000, 5)])
def test_samples_by_threshold_are_the_smallest_draws(spark, n, top_rows):
    df = spark.range(2000).select(F.col("id").alias(POS), (F.col("id") * 7).alias("v")).repartition(3)
    got = sampling.threshold_sample(df, n, "s", top_rows)
    want = df.withColumn("d", draw_key("s", F.col(POS))).orderBy("d", POS).limit(n)
    assert got.columns == df.columns
    assert sorted(r[POS] for r in got.collect()) == sorted(r[POS] for r in want.collect())


def test_samples_of_rows_at_one_position(spark):
    df = spark.createDataFrame([(1,)] * 60 + [(2,)] * 60, f"{POS} long")
    first = min((1, 2), key=lambda p: df.limit(1).select(draw_key(0, F.lit(p)).alias("k")).first().k)
    for n in (10, 60, 90):
        got = [r[POS] for r in sampling.threshold_sample(df, n, 0, 5).collect()]
        assert len(got) == n and got.count(first) == min(n, 60)


def test_large_samples_go_by_threshold(spark, monkeypatch):
    monkeypatch.setattr(sampling, "TOP_ROWS", 20)
    df = spark.range(500).select(F.col("id").alias(POS))
    large = sampling.seeded_sample(df, 200, 3)
    small = df.withColumn("d", draw_key(3, F.col(POS))).orderBy("d").limit(200)
    assert {r[POS] for r in large.collect()} == {r[POS] for r in small.collect()}


def test_subtotals_add_counts_and_never_rates(spark):
    verdicts = spark.createDataFrame(
        [("m", "d1", "t", True)] + [("m", "d2", "t", False)] * 9 + [("n", "d1", "t", None)], "model string, dataset string, test string, passed boolean")
    got = {(r.model, r.dataset, r.test): r for r in score.scorecard_rollup(verdicts, ("model", "dataset", "test")).collect()}
    assert (got["m", None, None].rate, got["m", None, None].n_cells, got["m", None, None].level) == (0.1, 2, 1)
    whole = got[None, None, None]
    assert (whole.n_trials, whole.n_passed, whole.level, whole.n_cells) == (11, 1, 0, 3)
    assert len(got) == 3 + 3 + 2 + 1 and got["n", "d1", "t"].rate == 0
