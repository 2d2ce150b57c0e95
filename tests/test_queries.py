"""Registered queries against their SQL on the smallest scale; ``python -m checks.compare`` runs
all of them on the larger one."""

import pytest

import __spark_entry__ as contract
from checks import oracle, queries
from checks.compare import compare, connect

SAMPLE = (
    "profile_features", "decode_label", "dedup_keep_first", "file_positions", "seeded_shuffle_rows",
    "row_text_variants", "swap_columns", "perturb_until_new", "row_membership", "probe_values_examples",
    "probe_membership", "decide_words", "decide_completion", "decide_classification", "scorecard_wide",
    "perturb_skewed", "decide_values_long", "csv_scan", "csv_positions_many_files", "scorecard_sink_two_models",
    "corpus_word_scan", "corpus_word_scan_long", "corpus_passage_scan", "corpus_passage_scan_pages", "corpus_row_text_scan",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, con, name):
    ok, note, _ = compare(spark, con, sf_dir, contract.queries()[name], contract.oracle_sql()[name])
    assert ok, note


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 6


def plan(spark, sf_dir, name):
    return contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "row_membership", "random_row_per_trial", "probe_completion_incomplete", "probe_values_examples",
    "corpus_word_scan", "corpus_row_text_scan", "decide_recognition"])
def test_no_nested_loop_joins(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_scans_read_only_what_they_need(spark, sf_dir):
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan(spark, sf_dir, "filter_threshold")
    assert "GreaterThanOrEqual(c_acctbal,4500.0)" in plan(spark, sf_dir, "filter_threshold")
    assert "WindowGroupLimit" in plan(spark, sf_dir, "dedup_keep_first")
