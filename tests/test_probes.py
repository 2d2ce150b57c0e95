import pytest
from pyspark.sql import functions as F

from rowecho.functions.text import SERIALIZATIONS
from rowecho.operators import decide as D, profile, score
from rowecho.plans import probes as P, runs
from rowecho.sources.catalog import Task
from rowecho.sources.lexicon import tag_lexicon
from rowecho.streaming import decide_stream
from tests.helpers import dataset_of

ROWS = [("Porto", 30, 1.5, "yes"), ("Lyon", 41, 2.0, "no"), (None, 30, 2.5, "yes"), ("Bari", 52, 3.0, "no"),
        ("Lyon", 41, 4.5, "yes"), ("Graz", 63, 5.0, "no"), ("Bari", 30, 6.5, "yes")]
SCHEMA = "city string, age int, score double, y string"
TASK = Task("yes_no", "Right? Yes or no?", exemplar_question="Was it right?", positive="yes", negative="no")


@pytest.fixture(scope="module")
def ds(spark):
    return dataset_of(spark, ROWS, SCHEMA, target="y", task=TASK, id_features=("age",),
                      value_features=("city", "y"), skip_given_features=(), completion_feature="score")


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("city",), ("score",), ("yes",), ("no",)], "word string").coalesce(1).cache()


@pytest.fixture(scope="module")
def lists(ds, lexicon):
    return profile.value_lists(tag_lexicon(profile.feature_values(ds, ["city", "y"]), lexicon), 100).cache()


def line(row):
    city, age, number, y = row
    return f"The city is {city or 'nan'}, The age is {age}, The score is {number}, The y is {y}"


def values(row):
    return [e.value for e in row.expected]


def test_feature_probes(ds, lexicon):
    features = profile.dataset_features(ds)
    row = P.features_uninformed(ds, features, lexicon).first()
    assert values(row) == ["city", "score", "y"] and [e.in_lexicon for e in row.expected] == [True, True, True]
    assert row.prompt.endswith("from the toy data dataset.\nProvide the feature names as a Python list.\n\nFeatures:")
    assert (row.rule, row.max_new_tokens) == ("words", 256)
    for row in P.features_informed(ds, features, lexicon, n_given=5, n_repeat=3).collect():
        given = row.prompt.split("Subset of feature names from toy data: [")[1].split("]")[0].split(", ")
        assert len(given) == 2 and values(row) == [c for c in ("city", "score", "y") if c not in given]
    row = P.features_reverse(ds, features).first()
    assert "Features names: [city, age, score, y]" in row.prompt and values(row) == ["toy data", "toy"]
    assert P.description(ds).first().label == "(7, 4)"


def test_value_probes(ds, lists):
    rows = {r.feature: r for r in P.values_uninformed(ds, lists).collect()}
    assert values(rows["city"]) == ["Porto", "Lyon", "nan", "Bari", "Graz"]
    assert [e.kind for e in rows["city"].expected][2] == "other"
    unnamed = P.values_uninformed(ds, lists, categorical=False, give_name=False).filter("feature = 'y'").first()
    assert "range of values for the numerical feature y from an undisclosed dataset" in unnamed.prompt


def test_values_from_examples(ds, lists):
    rows = {r.feature: r for r in P.values_from_examples(ds, lists, ["city", "y"], 3).collect()}
    assert values(rows["city"]) == ["Bari", "Graz"]
    assert "\n".join(line(r) for r in ROWS[:3]) in rows["city"].prompt
    # two values allow one row
    assert values(rows["y"]) == ["no"] and line(ROWS[0]) in rows["y"].prompt and line(ROWS[1]) not in rows["y"].prompt
    every = P.values_from_examples(ds, lists, ["city"], 3, "all").collect()
    assert sorted(r.trial for r in every) == [0, 1, 2]
    # the number of shown rows carries over, and known values are the head's
    parity = {r.feature: r for r in P.values_from_examples(ds, lists, ["y", "city"], 3, "random", parity=True).collect()}
    assert len(parity["city"].prompt.split("Examples from the toy data dataset:\n")[1].split("\n\n")[0].split("\n")) == 1
    assert "Porto" not in values(parity["city"])


def test_recognition_blocks(ds):
    head = P.recognition(ds, 5).first()
    assert "\n".join(line(r) for r in ROWS[:5]) + "\n\nName of the dataset:" in head.prompt
    assert values(head) == ["toy data", "toy"] and P.recognition(ds, 5, "all").count() == 2
    sampled = P.recognition(ds, 5, "random").first().prompt
    assert sum(line(r) in sampled for r in ROWS) == 5


def test_completion(ds):
    full = P.completion_full(ds, 4).first()
    assert "\n".join(line(r) for r in ROWS[:4]) + "\n\nNext examples:" in full.prompt
    assert values(full) == ["Lyon", "41", "4.5", "yes"]
    sampled = P.completion_full(ds, 4, "random").first()
    assert values(sampled) == ["Lyon", "41", "4.5", "yes"]
    head = P.completion_incomplete(ds, random_examples=False).first()
    assert head.prompt.endswith("---\nThe city is Lyon") and values(head) == ["41", "4.5", "yes"]
    drawn = P.completion_incomplete(ds).collect()
    assert sorted(r.trial for r in drawn) == [0, 1, 2, 3, 4]
    shown = {r.prompt.split("Examples:\n")[1].split("\n---")[0] for r in drawn}
    assert len(shown) == 1  # the same examples in every trial
    one = P.completion_feature(ds, "score", 2).collect()
    assert [values(r) for r in sorted(one, key=lambda r: r.trial)] == [["1.5"], ["2"]]
    assert "The score is" not in one[0].prompt and one[0].prompt.endswith("feature score?\nFeature value:")


def test_membership(ds):
    rows = {r.trial: r for r in P.membership(ds).collect()}
    assert sorted(rows) == list(range(7)) and [rows[i].label for i in range(7)] == ["No", "Yes"] * 3 + ["No"]
    for i, r in rows.items():
        sample = r.prompt.split("Provided sample:\n")[1].split("\n")[0]
        example = r.prompt.split("Example:\n")[1].split("\n")
        assert (sample == line(ROWS[i])) == (r.label == "Yes")
        assert sample in map(line, ROWS) if r.label == "Yes" else sample not in map(line, ROWS)
        assert example[0] == line(ROWS[6 - i]) and example[1] == "Answer: Yes" and example[3] == "Answer: No"
        assert example[2] not in map(line, ROWS)
    parity = {r.trial: r for r in P.membership(ds, parity=True).collect()}
    assert parity[2].label == "No" and line(ROWS[2]) in parity[2].prompt.split("Provided sample:\n")[1]


def test_classification(ds):
    zero = {r.trial: r for r in P.classification(ds, None).collect()}
    assert zero[0].label == "Yes" and zero[1].label == "No" and "The y is" not in zero[0].prompt
    assert zero[0].prompt == ('\nAnswer only by "Yes" or "No"\nExample: The city is Porto, The age is 30, '
                              "The score is 1.5\n\nRight? Yes or no?\nAnswer: ")
    shot = P.classification(ds, None, shots=True).filter("trial = 3").first().prompt
    assert ("Example:\nThe city is Porto. The age is 30. The score is 1.5. \nWas it right?\nAnswer: Yes\n\n"
            "Example:\nThe city is Lyon. The age is 41. The score is 2.0. \nWas it right?\nAnswer: No\n\n") in shot
    assert P.classification(ds, 3).count() == 3


def test_threshold_exemplars(spark):
    toy = dataset_of(spark, [(1, 5.0), (2, 20.0), (3, 30.0)], "a int, price double", target="price",
                     task=Task("yes_no", "High?", threshold=10.0))
    text = P.exemplar_block(toy).first()[0]
    assert text.index("Answer: Yes") < text.index("Answer: No") and "The a is 2. " in text and "The a is 1. " in text


def test_serialization_variants(ds):
    probes = P.completion_feature(ds, "score", 1, variants=tuple(enumerate(SERIALIZATIONS))).collect()
    rows = [r.prompt.split("Example:\n")[1].split("\n")[0] for r in sorted(probes, key=lambda r: r.serialization)]
    assert rows == ["The city is Porto, The age is 30, The y is yes", "city = Porto, age = 30, y = yes",
                    "city: Porto, age: 30, y: yes", "The city is equal to Porto; The age is equal to 30; The y is equal to yes"]
    assert len({r.probe_id for r in probes}) == 4


def test_complete_run(spark, ds, lexicon):
    probes = runs.dataset_probes(ds, lexicon, 4).cache()
    counts = {r.test: r["count"] for r in probes.groupBy("test").count().collect()}
    assert counts == {"features_list_uninf": 1, "features_list_inf": 3, "recognition_feat": 1, "recognition_ex": 1,
                      "feature_values_uninf": 2, "feature_values_inf": 2, "incomplete_completion_random": 5,
                      "full_completion": 1, "feature_completion": 5, "membership": 4}
    right = F.when(F.col("rule").isin("words", "names"), F.array_join(F.transform("expected", lambda e: e["value"]), ", ")).when(
        F.col("rule") == "row", F.array_join(F.transform("expected", lambda e: e["value"]), " , ")).otherwise(F.col("label"))
    responses = probes.select("probe_id", F.lit("good").alias("model"), right.alias("output"))
    verdicts, card = runs.run(probes, responses, ["good", "silent"])
    got = {(r.model, r.test): r.value for r in card.collect()}
    assert all(v == (4.0 if t == "membership" else 1.0) for (m, t), v in got.items() if m == "good")
    assert all(v == 0.0 for (m, t), v in got.items() if m == "silent")


def test_stream_of_responses(spark, ds, tmp_path):
    probes = P.completion_feature(ds, "score", None)
    probes.write.parquet(str(tmp_path / "probes"))
    probes = spark.read.parquet(str(tmp_path / "probes"))
    responses = probes.select("probe_id", F.lit("m").alias("model"), F.expr("expected[0].value").alias("output"))
    responses.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(responses.schema).parquet(str(tmp_path / "in"))
    verdicts = decide_stream(stream, probes)
    running = verdicts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert running.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 7 and score.any_pass(out).first().passed
    assert out.filter("NOT passed").isEmpty() and D.NONE not in {r.rule for r in out.select("rule").distinct().collect()}
