"""Deciding responses as they arrive, and the running scorecard of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rowecho.operators.decide import decide
from rowecho.operators.score import CELL, test_score

COUNTS = ("n_trials", "n_passed")
HELD = "probe_id string, model string, output string, passed boolean, test string, dataset string"
BATCHES_PER_WHOLE = 16  # batches that are read to know what is held, at most


def decide_stream(responses: DataFrame, probes: DataFrame, echoing: Sequence[str] = (),
                  parity: bool = False) -> DataFrame:
    """Verdicts of a streaming ``responses`` (probe_id, model, output) against a written table of
    probes. A stream-static join on the probe id followed by the batch decider: no state is
    kept, so the stream survives any loss by replaying its source. Responses without a probe
    are left out; missing responses are the batch decider's to find."""
    return decide(_joined(responses, probes, echoing), parity)


def _joined(responses: DataFrame, probes: DataFrame, echoing: Sequence[str]) -> DataFrame:
    return responses.join(probes, "probe_id").withColumn(
        "output", F.coalesce("output", F.lit(""))
    ).withColumn("echoes", F.col("model").isin(*echoing) if echoing else F.lit(False))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose counts are complete."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    done = [n for n in names if n.startswith("batch=") and files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.split("=")[1]) for n in done)


def _held(spark: SparkSession, path: str, batch_id: int) -> tuple[DataFrame, int | None]:
    """The responses that count before this batch, each with its verdict, and the batch that last wrote all of them. A response
    that was replaced since is there too, after the one that replaced it in text order."""
    done = [b for b in _batches(spark, f"{path}/held") if b < batch_id]
    whole = max((b for b in done if _writes_all(b)), default=None)
    folders = [f"{path}/held/batch={b}" for b in done if whole is None or b >= whole]
    nothing = spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in HELD.split(", "))])  # not by Python tasks
    return (spark.read.schema(HELD).parquet(*folders) if folders else nothing), whole


def _writes_all(batch_id: int) -> bool:
    return batch_id % BATCHES_PER_WHOLE == BATCHES_PER_WHOLE - 1


def score_changes(verdicts: DataFrame, batch_id: int, path: str) -> DataFrame:
    """(model, test, dataset, n_trials, n_passed): what the responses of a batch change in the counts.

    ``verdicts`` has the ``output`` they were decided on. By (probe_id, model) the response that counts, the first in text
    order as in the batch, is held with its verdict under ``path``: a response that arrives again, or comes after the one
    that counts, changes nothing; one before it takes its place. A batch writes what it changes, every ``BATCHES_PER_WHOLE``th all that is held, and one
    that is run again starts from what was held before it.
    """
    spark, keys = verdicts.sparkSession, ["probe_id", "model"]
    rest = [F.col(c) for c in ("passed", "test", "dataset")]
    arrived = verdicts.groupBy(*keys).agg(F.min(F.struct("output", F.lit(True).alias("new"), *rest)).alias("r")).persist()
    arrived.count()  # its size is known from here on: a small batch is sent to what is held
    held, whole = _held(spark, path, batch_id)
    asked = arrived.select(F.col("probe_id").alias("_p"), F.col("model").alias("_m"))
    met = held.join(asked, (F.col("probe_id") == F.col("_p")) & F.col("model").eqNullSafe(F.col("_m")), "left_semi").select(
        *keys, F.struct("output", F.lit(False).alias("new"), *rest).alias("r"))
    first = met.unionByName(arrived).groupBy(*keys).agg(
        F.min("r").alias("r"), F.min(F.when(~F.col("r.new"), F.col("r"))).alias("was")).filter("r.new")
    changed = first.select(*keys, "r.output", "r.passed", "r.test", "r.dataset", F.col("was.passed").alias("was"))
    folder = f"{path}/held/batch={batch_id}"
    if _writes_all(batch_id):
        before = held.withColumn("was", F.lit(None).cast("boolean")).withColumn("changed", F.lit(False))
        row = F.struct("output", "passed", "test", "dataset", "was", "changed")
        written = before.unionByName(changed.withColumn("changed", F.lit(True))).groupBy(*keys).agg(
            F.min(row).alias("r")).select(*keys, "r.*")
    else:
        written = changed.withColumn("changed", F.lit(True))
    written.write.mode("overwrite").parquet(folder)
    arrived.unpersist()
    for old in _batches(spark, f"{path}/held"):
        if whole is not None and old < whole:
            files, gone = _folder(spark, f"{path}/held/batch={old}")
            files.delete(gone, True)
    passed = F.col("passed").cast("bigint") - F.coalesce(F.col("was").cast("bigint"), F.lit(0))
    return spark.read.schema(f"{HELD}, was boolean, changed boolean").parquet(folder).filter("changed").select(
        *CELL, F.col("was").isNull().cast("bigint").alias("n_trials"), passed.alias("n_passed"))


def merge_counts(changes: DataFrame, batch_id: int, path: str) -> None:
    """Write the counts up to this batch: those of the batch before it and the changes.

    A batch that is run again starts from the same counts before it and replaces its own, so it counts
    once however often it runs. The counts of the batch before stay until the next one is complete.
    """
    spark = changes.sparkSession
    before = [b for b in _batches(spark, path) if b < batch_id]
    counts = changes.groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in COUNTS])
    if before:
        counts = spark.read.parquet(f"{path}/batch={before[-1]}").unionByName(counts).groupBy(*CELL).agg(
            *[F.sum(c).alias(c) for c in COUNTS])
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # one row per cell of the scorecard
    for old in before[:-1]:
        files, folder = _folder(spark, f"{path}/batch={old}")
        files.delete(folder, True)


def score_stream(responses: DataFrame, probes: DataFrame, path: str, checkpoint: str, echoing: Sequence[str] = (),
                 parity: bool = False, **trigger) -> StreamingQuery:
    """Start a query that keeps the counts of the scorecard under ``path`` as ``responses`` arrive.

    ``trigger`` is that of ``writeStream``; by default what is there is taken in batches and the query ends. Started
    again with its checkpoint, it goes on after the last batch.
    """
    joined = _joined(responses, probes, echoing)
    # the decider hands on the columns it knows, so the output goes with the model
    decided = decide(joined.withColumn("model", F.struct("model", "output")).withColumn(
        "echoes", F.col("model.model").isin(*echoing) if echoing else F.lit(False)), parity)
    verdicts = decided.withColumn("output", F.col("model.output")).withColumn("model", F.col("model.model"))
    return verdicts.select(*CELL, "probe_id", "passed", "output").writeStream.foreachBatch(
        lambda batch, batch_id: merge_counts(score_changes(batch, batch_id, path), batch_id, path)
    ).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_scorecard(spark: SparkSession, path: str) -> DataFrame:
    """The scorecard as of the last complete batch under ``path``; empty before the first."""
    done = _batches(spark, path)
    if done:
        counts = spark.read.parquet(f"{path}/batch={done[-1]}")
    else:
        counts = spark.createDataFrame([], "model string, test string, dataset string, n_trials bigint, n_passed bigint")
    return counts.select(*CELL, *COUNTS, test_score(F.col("test"), F.col("n_passed"), F.col("n_trials")).alias("value"))
