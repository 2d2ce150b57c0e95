"""Reports against published values."""

import pytest
from pyspark.sql import functions as F

from rowecho.operators import reshape, score
from rowecho.plans import reports
from rowecho.sources import results, sinks
from tests import golden

HIDDEN = ["Berkeley", "MathE"]
DATASETS = ["Adult", "Bank", "German", "Housing", "Iris", "Wine", "Titanic", "Sp. Titanic", "Thyroid_Diff"]


def files(folder, tables):
    out = {}
    for model, text in tables.items():
        path = folder / f"{model}.csv"
        path.write_text(text)
        out[model] = str(path)
    return out


@pytest.fixture(scope="module")
def card(spark, tmp_path_factory):
    return results.read_scorecards(spark, files(tmp_path_factory.mktemp("cards"), golden.SCORECARDS)).cache()


@pytest.fixture(scope="module")
def accuracy(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("acc") / "acc.csv"
    path.write_text(golden.ACCURACY)
    return results.read_accuracy(spark, str(path)).cache()


def test_files_are_read_by_header(spark, tmp_path):
    paths = files(tmp_path, {"a": "test_name,X,Sp. Y\nt1,1.0,\n", "b": "test_name,Sp. Y,X\nt1,0,1\n"})
    got = {(r.model, r.test, r.dataset): r.value for r in results.read_scorecards(spark, paths).collect()}
    assert got == {("a", "t1", "X"): 1.0, ("a", "t1", "Sp. Y"): None, ("b", "t1", "X"): 1.0, ("b", "t1", "Sp. Y"): 0.0}


def test_accuracy_cells(accuracy):
    row = accuracy.filter("model = 'Gemini 1.0' AND category = '0-shot' AND dataset = 'Iris'").first()
    assert (row.score, row.counts) == (0.36, [100, 0, 0])


def test_ranking(spark, card, accuracy, tmp_path):
    rates = reports.contamination_rate(card, HIDDEN)
    assert {r.cells for r in rates.collect()} == {81}
    memberships = reports.membership_means(results.read_membership(spark, files(tmp_path, golden.MEMBERSHIP)))
    means = reports.mean_scores(accuracy, HIDDEN, parity=True)
    out = reports.ranking(rates, memberships, means).collect()
    passes = {r.model: r.passes for r in rates.collect()}
    for r in out:
        n, rate, zero, one, member = golden.RANKING[r.model]
        assert passes[r.model] == n
        assert [round(v, 4) for v in (r["contamination_score"], r["0-shot_score"], r["1-shot_score"], r["membership_score"])] == [
            rate, zero, one, member]
    # models with the same number of passes share a rank and are listed by name
    assert [(r.model, r.model_rank) for r in out] == [
        ("Gemini 1.0", 1), ("Gemini 1.5", 2), ("GPT-4", 3), ("Llama 3", 4), ("Llama 3.1", 4)]
    best = {c: [r.model for r in out if r[f"{c}_best"]] for c in ("contamination", "membership", "0-shot", "1-shot")}
    assert best == {"contamination": ["Gemini 1.0"], "membership": ["Gemini 1.5"], "0-shot": ["GPT-4"], "1-shot": ["GPT-4"]}


def test_mean_without_hidden_datasets(accuracy):
    def mean(**options):
        scores = reports.mean_scores(accuracy.filter("model = 'GPT-4' AND category = '0-shot'"), **options)
        return round(scores.first().score, 4)
    assert mean(hidden=HIDDEN, parity=True) == 0.7180 == mean()
    assert mean(hidden=HIDDEN) == round((7.18 - 0.63) / 9, 4)


def test_accuracy_table(accuracy):
    table = reports.accuracy_table(accuracy, ["Adult", "Berkeley", "Titanic", "Sp. Titanic"], HIDDEN, show_mean=True, parity=True)
    row = table.filter("model = 'GPT-4' AND category = 'member.'").first()
    assert "Berkeley" not in table.columns and (row.Adult, row["Sp. Titanic"], row["mean"]) == ("1.00", "0.96", "0.97")
    row = table.filter("model = 'Gemini 1.0' AND category = 'member.'").first()
    assert row.Titanic == "0.8"
    details = reports.accuracy_table(accuracy, ["Adult"], details=True, hidden_models=["GPT-4"])
    assert details.filter("model = 'GPT-4'").isEmpty()
    assert details.filter("model = 'Llama 3' AND category = '1-shot'").first().Adult == "0.36 (73-20)"


def test_category_grid(card):
    grid = reports.category_grid(card.filter("model = 'GPT-4'"), DATASETS).collect()
    assert [r.shown for r in grid] == [
        "Features list (inf.)", "Features list (uninf.)", "Recognition (feat.)", "Recognition (ex.)",
        "Feature values (inf.)", "Feature values (uninf.)", "Incomplete completion", "Full completion",
        "Feature completion"]
    assert [r.category for r in grid] == ["knowledge"] * 3 + ["memorization"] * 6
    totals = {r.model: r.passes for r in reports.total_passes(card, HIDDEN).collect()}
    assert totals == {m: v[0] for m, v in golden.RANKING.items()}
    tests = [r.test for r in reports.select_tests(card.filter("model = 'GPT-4' AND dataset = 'Adult'"), "knowledge").collect()]
    assert tests == ["features_list_inf", "features_list_uninf", "recognition_feat"]
    with pytest.raises(ValueError):
        reports.select_tests(card, "other")


def test_difference_grid(card):
    grid = {r.test: r for r in reports.difference_grid(card, "Llama 3", "Llama 3.1", DATASETS).collect()}
    assert grid["recognition_ex"]["Adult"] == -1 and grid["recognition_ex"]["Bank"] == 2
    assert grid["recognition_feat"]["Housing"] == 1 and grid["full_completion"]["Iris"] == 0


def test_multi_model_grid(card):
    grid = reports.multi_model_grid(card, ["GPT-4", "Llama 3"], ["Adult", "Wine"]).collect()
    assert grid[0].test == "features_list_inf" and grid[0]["Llama 3:Wine"] == 1.0 and len(grid) == 9


def test_serialization_grid(spark, tmp_path):
    card = results.read_serializations(spark, files(tmp_path, {"Gemma 2": golden.SERIALIZATION}))
    assert card.count() == 20 * 9
    third = {r.test: r for r in reports.serialization_grid(card, "Gemma 2", 2, DATASETS[:-1]).collect()}
    first = {r.test: r for r in reports.serialization_grid(card, "Gemma 2", 0, DATASETS[:-1]).collect()}
    assert third["feature_completion"]["Housing"] == 1.0 and first["feature_completion"]["Housing"] == 0.0
    assert "serialization" not in reshape.one_serialization(card, 1).columns


def test_merge_keeps_tests_of_both(spark):
    old = spark.createDataFrame([("a", 1), ("b", 0)], "test_name string, X int")
    new = spark.createDataFrame([("b", 1), ("c", 1)], "test_name string, Y int")
    got = sorted((r.test_name, r.X, r.Y) for r in reshape.merge_scorecards(old, new).collect())
    assert got == [("a", 1, None), ("b", 0, 1), ("c", None, 1)]


def test_ties_are_all_flagged(spark):
    scores = spark.createDataFrame([("a", "x", 0.5), ("b", "x", 0.5), ("c", "x", 0.1)], "model string, category string, score double")
    assert sorted(r.model for r in reshape.flag_best(scores).filter("is_best").collect()) == ["a", "b"]


def test_score_format(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (0.746,)], "x double")
    assert [r[0] for r in df.select(reports.format_score(F.col("x"))).collect()] == ["0.00", "1.00", "0.50", "0.75"]


def test_sinks(spark, tmp_path):
    verdicts = spark.createDataFrame(
        [("p1", "m", "membership", "adult income", True), ("p2", "m", "membership", "adult income", False),
         ("p3", "n", "recognition_ex", "wine", True)],
        "probe_id string, model string, test string, dataset string, passed boolean")
    verdicts = verdicts.withColumn("matches", F.array(F.struct(F.lit("w").alias("name"), F.lit(True).alias("found"))))
    card = score.scorecard(verdicts)
    sinks.write_scorecard(card, str(tmp_path / "card"))
    back = spark.read.parquet(str(tmp_path / "card")).filter("model = 'm'")
    assert back.first().value == 1.0
    wide = score.scorecard_wide(card, {"adult income": "Adult", "wine": "Wine"})
    sinks.write_scorecard_csv(wide.filter("model = 'n'").drop("model"), str(tmp_path / "wide"))
    row = results.read_labelled(spark, str(tmp_path / "wide"), "test").first()
    assert (row.test, row.Adult, row.Wine) == ("recognition_ex", "0.0", "1.0")
    sinks.write_verdicts(verdicts, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).filter("probe_id = 'p1'").first().matches == {"w": True}
