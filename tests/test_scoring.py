import uuid

import pytest
from pyspark.sql import functions as F

from rowecho.operators import decide
from rowecho.sources.lineage import checkpoint_folder


@pytest.fixture(scope="module")
def probes(spark):
    return spark.range(300).select(
        F.concat(F.lit("p"), "id").alias("probe_id"), F.concat(F.lit("prompt "), "id").alias("prompt"),
        (F.col("id") % 7).cast("int").alias("max_new_tokens"), F.lit(0.0).alias("temperature"))


def place(spark):
    return f"{checkpoint_folder(spark)}/scored_{uuid.uuid4().hex}"


def good(prompts, budgets, temperatures):
    return [p.upper() for p in prompts]


def picky(prompts, budgets, temperatures):
    if any(p.endswith("7") for p in prompts):
        raise ValueError("no sevens")
    return good(prompts, budgets, temperatures)


def want(n=300):
    return {(f"p{i}", "m", f"PROMPT {i}") for i in range(n)}


def test_failed_prompts_are_kept_apart_and_asked_again(spark, probes):
    path = place(spark)
    decide.score_prompts_resumable(probes, "m", picky, path, 4)
    failed = decide.failed_prompts(probes, path).collect()
    assert {r.probe_id for r in failed} == {f"p{i}" for i in range(300) if i % 10 == 7}
    assert all(r.errors == ["ValueError: no sevens"] and r.n_failed == 1 for r in failed)
    decide.score_prompts_resumable(probes, "m", good, path, 4, again=False)
    assert decide.scored_responses(probes, path).count() == 270
    decide.score_prompts_resumable(probes, "m", good, path, 4)
    rows = [tuple(r) for r in decide.scored_responses(probes, path).collect()]
    assert len(rows) == 300 and set(rows) == want() and decide.failed_prompts(probes, path).isEmpty()
    assert spark.read.parquet(path).filter("output is not null").count() == 300  # none was asked twice


def test_a_run_that_breaks_off_is_resumed(spark, probes):
    path = place(spark)

    def broken(prompts, budgets, temperatures):
        if any(p == "prompt 123" for p in prompts):
            raise SystemExit("the machine is gone")  # no fault of a prompt: the task fails
        return good(prompts, budgets, temperatures)

    with pytest.raises(Exception):
        decide.score_prompts_resumable(probes, "m", broken, path, 40)
    kept = spark.read.schema(decide.SCORED).parquet(path).count()
    assert 0 < kept < 300  # what other tasks had done
    asked = spark.sparkContext.accumulator(0)

    def counted(prompts, budgets, temperatures):
        asked.add(len(prompts))
        return good(prompts, budgets, temperatures)

    decide.score_prompts_resumable(probes, "m", counted, path, 4)
    rows = [tuple(r) for r in decide.scored_responses(probes, path).collect()]
    assert len(rows) == 300 and set(rows) == want() and asked.value == 300 - kept


def test_models_probes_and_orders_are_apart(spark, probes):
    path = place(spark)
    decide.score_prompts_resumable(probes.unionByName(probes), "m", good, path, 2)
    decide.score_prompts_resumable(probes.limit(0), "m", good, path, 2)
    decide.score_prompts_resumable(probes, "other", lambda p, b, t: list(p)[:-1], path, 2)  # one output too few
    got = decide.scored_responses(probes, path).groupBy("model").count().collect()
    assert {r.model: r["count"] for r in got} == {"m": 300}
    assert decide.failed_prompts(probes, path).filter("model = 'other'").count() == 300
    budgets = spark.sparkContext.accumulator(0)

    def rising(prompts, b, temperatures):
        b = list(b)
        if b != sorted(b):
            budgets.add(1)
        return good(prompts, b, temperatures)

    decide.score_prompts_resumable(probes, "m", rising, place(spark), 3, batch=1000)
    assert budgets.value == 0
