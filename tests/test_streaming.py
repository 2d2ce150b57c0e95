import random
import uuid

import pytest

from checks.datasets import dataset
from checks.queries import queries
from checks.responder import ECHOING, MODELS, respond
from rowecho import streaming
from rowecho.operators import decide, score
from rowecho.plans import probes as P
from rowecho.sources.lineage import checkpoint_folder, cut_lineage


@pytest.fixture(scope="module")
def probes(spark, sf_dir):
    ds = dataset(spark, sf_dir, "customer")
    return cut_lineage(P.completion_feature(ds, "c_name", None).unionByName(P.recognition(ds, 5, "all")))


def place(spark, name):
    return f"{checkpoint_folder(spark)}/{name}_{uuid.uuid4().hex}"


def cards(df):
    return sorted(tuple(r) for r in df.collect())


def arrive(spark, path, rows):
    spark.createDataFrame(rows, "probe_id string, model string, output string").coalesce(1).write.mode("append").parquet(path)


def read(spark, path):
    return spark.readStream.schema("probe_id string, model string, output string").option("maxFilesPerTrigger", 1).parquet(path)


def test_a_stream_scores_what_the_batch_does(spark, probes):
    """Responses in any order and number, over several files and two starts of the query."""
    r = random.Random(1)
    outputs = [(x.probe_id, x.model, x.output) for x in respond(probes).collect()]
    others = [(p, m, r.choice(["", "zz", "Customer", o + "!", o[:3], "é" + o])) for p, m, o in outputs for _ in range(r.randint(0, 2))]
    rows = outputs + others + outputs[:100] + [("no probe", "alpha", "x"), (outputs[0][0], "alpha", None)]
    r.shuffle(rows)
    path, counts, progress = (place(spark, n) for n in ("arrived", "counts", "progress"))
    assert streaming.running_scorecard(spark, counts).count() == 0
    third = len(rows) // 3
    for part in (rows[:third], rows[third:2 * third]):
        arrive(spark, path, part)
    streaming.score_stream(read(spark, path), probes, counts, progress, ECHOING).awaitTermination()
    arrive(spark, path, rows[2 * third:])
    streaming.score_stream(read(spark, path), probes, counts, progress, ECHOING).awaitTermination()

    known = spark.createDataFrame(rows, "probe_id string, model string, output string").fillna("")
    verdicts = decide.decide(decide.join_responses(probes, known, MODELS, ECHOING))
    assert cards(streaming.running_scorecard(spark, counts)) == cards(score.scorecard(verdicts))
    assert len(streaming._batches(spark, counts)) <= 2  # older counts are gone


def test_a_batch_that_runs_again_counts_once(spark):
    path = place(spark, "again")
    kind = "model string, test string, dataset string, n_trials bigint, n_passed bigint"
    one = spark.createDataFrame([("a", "recognition_ex", "d", 2, 1)], kind)
    two = spark.createDataFrame([("a", "recognition_ex", "d", 1, -1), ("b", "membership", "d", 1, 1)], kind)
    for changes, batch in ((one, 0), (two, 1), (two, 1), (two.limit(0), 2), (two.limit(0), 2)):
        streaming.merge_counts(changes, batch, path)
    assert cards(streaming.running_scorecard(spark, path)) == [("a", "recognition_ex", "d", 3, 0, 0.0), ("b", "membership", "d", 1, 1, 1.0)]


def test_counts_that_broke_off_are_not_read(spark):
    path = place(spark, "broken")
    kind = "model string, test string, dataset string, n_trials bigint, n_passed bigint"
    one = spark.createDataFrame([("a", "membership", "d", 2, 1)], kind)
    streaming.merge_counts(one, 0, path)
    streaming.merge_counts(one, 1, path)
    files, mark = streaming._folder(spark, f"{path}/batch=1/_SUCCESS")
    files.delete(mark, False)
    assert cards(streaming.running_scorecard(spark, path)) == [("a", "membership", "d", 2, 1, 1.0)]
    streaming.merge_counts(one, 1, path)
    assert cards(streaming.running_scorecard(spark, path)) == [("a", "membership", "d", 4, 2, 2.0)]


def test_decided_streams_keep_no_state(spark, probes):
    path = place(spark, "stateless")
    arrive(spark, path, [(x.probe_id, x.model, x.output) for x in respond(probes).limit(50).collect()])
    out = streaming.decide_stream(read(spark, path), probes, ECHOING)
    assert out.isStreaming and {"passed", "matches"} <= set(out.columns)


def test_changes_are_counted_without_python_for_each_response(spark, monkeypatch):
    """The response that counts is held over batches, whole ones among them, and a batch that is run again."""
    monkeypatch.setattr(streaming, "BATCHES_PER_WHOLE", 2)
    path, r = place(spark, "held"), random.Random(3)
    kind = "probe_id string, model string, test string, dataset string, passed boolean, output string"
    verdict = lambda p, o: (p, "a", "recognition_ex", "d", o in "bdf\U0001f600", o)
    best = {}
    for batch in range(6):
        rows = [verdict(r.choice("pqrs") + str(r.randrange(4)), r.choice("abcdefg\uffee\U0001f600")) for _ in range(7)]
        for _ in range(2 if batch % 3 == 2 else 1):
            changes = streaming.score_changes(spark.createDataFrame(rows, kind), batch, path)
            assert "Python" not in changes._jdf.queryExecution().toString()
            streaming.merge_counts(changes, batch, path)
        for row in rows:
            best[row[0]] = min(best.get(row[0], row), row, key=lambda x: x[5].encode())
        got = streaming.running_scorecard(spark, path).first()
        assert (got.n_trials, got.n_passed) == (len(best), sum(x[4] for x in best.values()))
    assert len(streaming._batches(spark, f"{path}/held")) <= 3


def test_probes_of_a_stream_lie_in_buckets(spark, sf_dir, monkeypatch):
    """Two batches join them: neither shuffles them."""
    given = []
    start = streaming.score_stream
    monkeypatch.setattr(streaming, "score_stream", lambda responses, probes, *rest: given.append(probes) or start(responses, probes, *rest))
    assert queries()["scorecard_stream"](spark, sf_dir).count() == 4
    sides = given[0].hint("merge").join(given[0].groupBy("probe_id").count(), "probe_id")
    assert "Exchange" not in sides._jdf.queryExecution().executedPlan().toString()


def test_nothing_held_asks_no_python_task(spark):
    held, whole = streaming._held(spark, place(spark, "none"), 0)
    assert whole is None and held.count() == 0
    assert [f"{c} {t}" for c, t in held.dtypes] == streaming.HELD.split(", ")
    assert "ExistingRDD" not in held._jdf.queryExecution().executedPlan().toString()
