"""Deciders: probes joined with responses become verdicts.

Expected answers travel with the probe as a small array, so deciding is one equality join on
the probe id followed by expressions. They read nothing but the joined row, so the same code
decides a stream of responses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowecho.functions import answers
from rowecho.operators import corpus
from rowecho.plans import templates
from rowecho.sources.lineage import cut_lineage

EXPECTED_TYPE = (
    "array<struct<name:string,value:string,kind:string,in_lexicon:boolean,as_integer:string>>"
)

# rules a probe can carry
WORDS, NAMES, ROW, MEMBER, NONE = "words", "names", "row", "member", "none"
WORDS_LONG = "words_long"  # the expected words are rows elsewhere; the probe holds those that are known
PROBES_PER_TASK = 100_000  # of a join, with their prompts and the outputs of some models
CLASSIFICATION_RULES = ("yes_no", "class_name", "class_digit")


def join_partitions(probes: DataFrame) -> int:
    """Partitions of a join whose tasks sort their probes and responses in memory. ``probes`` is a written table, counted by its
    metadata."""
    return partitions_for(probes.sparkSession, probes.count())


def partitions_for(spark: SparkSession, n_probes: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-n_probes // PROBES_PER_TASK))


def join_responses(probes: DataFrame, responses: DataFrame, models: Sequence[str],
                   echoing: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Every probe for every model with its output; a missing response is an empty output, and of
    several responses of a model to a probe the first in text order counts.

    The model list is a short literal: a probe's outputs are columns of one row, which meet the probe once, and the models come apart
    after the join. What travels is every probe once and every response once; ``partitions`` (``join_partitions``) deals both out
    before anything is sorted, so nothing is spilled.
    """
    if partitions:
        probes, responses = probes.repartition(partitions, "probe_id"), responses.repartition(partitions, "probe_id")
    outputs = [f"_output{i}" for i in range(len(models))]
    single = responses.groupBy("probe_id").agg(*[
        F.min(F.when(F.col("model") == m, F.col("output"))).alias(o) for m, o in zip(models, outputs)])
    said = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.coalesce(o, F.lit("")).alias("output")) for m, o in zip(models, outputs)]))
    joined = probes.join(single, "probe_id", "left").withColumn("_said", said)
    rest = [F.col(f"`{c}`") for c in probes.columns if c != "probe_id"]
    return joined.select("probe_id", F.col("_said.model").alias("model"), *rest, F.col("_said.output").alias("output")).withColumn(
        "echoes", F.col("model").isin(*echoing) if echoing else F.lit(False)
    )


def _answer(parity: bool) -> Column:
    """The part of the output that is judged, by the probe's rule and test."""
    output = F.col("output")
    cropped = answers.crop_echo(output, F.col("prompt"), F.col("echoes"), parity)
    one_line = F.col("features_sep") != "\n"
    full = F.when(
        F.col("echoes"), answers.after_marker(output, templates.MARKER_FULL_COMPLETION)
    ).otherwise(output)
    return (
        F.when(
            F.col("rule") == ROW,
            F.when(
                F.col("test") == "full_completion",
                F.when(one_line, answers.completion_line(full)).otherwise(full),
            ).otherwise(F.when(one_line, answers.first_line(cropped)).otherwise(cropped)),
        )
        .when(F.col("rule").isin(*CLASSIFICATION_RULES), answers.clean_answer(cropped))
        .otherwise(cropped)
    )


def decide(joined: DataFrame, parity: bool = False) -> DataFrame:
    """Verdicts of joined probes and responses, all tests in one pass.

    ``matches`` lists the checked words, names or features with their outcome. Probes of the rule
    WORDS_LONG need their word table (``decide_all``) and fail here.
    """
    rule = F.col("rule")
    is_words = rule.isin(WORDS, NAMES)
    with_answer = joined.withColumn("answer", _answer(parity))
    prepared = with_answer.withColumn(
        "_stacks", F.when(is_words, answers.haystacks(F.col("answer"), F.col("case_sensitive")))
    ).withColumn(
        "_considered",
        F.when(rule == WORDS, answers.words_considered(F.col("expected"))).when(rule == NAMES, F.col("expected")),
    ).withColumn("_tokens", F.when(rule == ROW, F.split("answer", " "))
    ).withColumn("_integer", F.when(rule == ROW, answers.whole_integer(F.col("answer"))))
    row_matches = F.transform(
        "expected",
        lambda e: F.struct(
            e["name"].alias("name"),
            answers.value_matched(
                F.col("answer"), F.col("_tokens"), answers.is_whole_integer(F.col("answer")),
                F.col("_integer"), e["value"], e["as_integer"],
            ).alias("found"),
        ),
    )
    checked = prepared.withColumn(
        "matches",
        F.when(is_words, answers.word_matches(F.col("_considered"), F.col("_stacks"), F.col("case_sensitive")))
        .when(rule == ROW, row_matches),
    )
    n_listed = F.coalesce(F.size(F.filter("matches", lambda m: m["found"])), F.lit(0))
    n_unlisted = F.when(
        rule == WORDS, F.size("_considered") - F.size("matches")
    ).otherwise(F.lit(0))
    counted = checked.withColumn("n_found", n_listed + n_unlisted).withColumn(
        "n_expected", F.coalesce(F.size("expected"), F.lit(0))
    )
    any_outside = F.exists(
        "expected", lambda w: (w["kind"] == "string") & ~w["in_lexicon"]
    )
    passed = (
        F.when(
            rule == WORDS,
            F.when(any_outside, F.col("n_found") > 0)
            .otherwise(F.col("n_found") == F.col("n_expected")),
        )
        .when(rule == NAMES, F.col("n_found") > 0)
        .when(rule == ROW, F.col("n_found") == F.col("n_expected"))
        .when(rule == MEMBER, answers.membership_passed(F.col("answer"), F.col("label")))
        .when(
            rule.isin(*CLASSIFICATION_RULES),
            answers.classification_passed(F.col("answer"), F.col("label"), rule),
        )
        .when(rule == WORDS_LONG, F.raise_error(F.lit("words_long is decided with the word table: decide_all")).cast("boolean"))
    )
    return counted.select(
        "probe_id", "model", "test", "dataset", "feature", "trial", "serialization", "rule",
        "label", "answer",
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.col("n_found").cast("bigint").alias("n_found"),
        F.col("n_expected").cast("bigint").alias("n_expected"),
        "matches",
    ).filter(F.col("rule") != NONE)


def decide_all(joined: DataFrame, words: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """``decide`` for probes of every rule. ``words`` (dataset, feature, value, kind, in_lexicon; one row per
    word) has the lists that are too long to travel with a probe; their verdicts list no matches."""
    if words is None:
        return decide(joined, parity)
    joined = cut_lineage(joined)
    long = joined.filter(F.col("rule") == WORDS_LONG).withColumn("answer", _answer(parity)).withColumn(
        "known", F.transform("expected", lambda e: e["value"]))
    found = decide_words_long(long, words)
    long = long.join(found.hint("merge"), ["probe_id", "model"]).withColumn("matches", F.lit(None))
    short = decide(joined.filter(F.col("rule") != WORDS_LONG), parity)
    kinds = {f.name: f.dataType for f in short.schema}
    return short.unionByName(long.select(*[F.col(c).cast(kinds[c]).alias(c) for c in short.columns]))


def matches_text(matches: Column) -> Column:
    """``a=true;b=false`` in name order, for results that must be plain text."""
    return F.array_join(
        F.array_sort(F.transform(
            matches, lambda m: F.concat(m["name"], F.lit("="), m["found"].cast("string"))
        )), ";",
    )


def decide_words_long(responses: DataFrame, words: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """The word rule for lists of any length.

    ``responses`` is (probe_id, model, answer, dataset, feature) and, where a probe gives words away,
    known (an array of them); ``words`` is (dataset, feature, value, kind, in_lexicon), one row per word. Words
    are looked up in the vocabulary of the answers, so no answer meets the words it does not hold.
    A feature without words expects nothing, and its responses pass.
    """
    named = F.concat_ws("\n", "dataset", "feature").alias("list_name")
    words = cut_lineage(words.select(named, "value", "kind", "in_lexicon"))
    known = F.col("known") if "known" in responses.columns else F.array().cast("array<string>")
    asked = cut_lineage(responses.select(
        F.struct("probe_id", "model").alias("key"), "answer", known.alias("known"),
        F.xxhash64(F.concat_ws("\n", "dataset", "feature")).alias("list")))
    # few words are given away by a probe: their marks come from the table. Words and probes both grow with the data, so neither is
    # sent to all tasks, however small its files are
    given = asked.select("key", "list", F.explode("known").alias("value")).join(
        words.withColumn("list", F.xxhash64("list_name")).drop("list_name").hint("merge"), ["list", "value"]).groupBy("key", "list").agg(
        *[F.count_if(c).alias(f"given_{n}") for n, c in corpus.list_parts().items()])
    entries = corpus.entry_sets(asked.select("key", "answer"), words, "key", "answer", case_sensitive)
    without = F.transform("known", lambda v: F.struct("list", v.alias("value")))
    hashes = F.transform(without, lambda w: F.xxhash64(w["list"], w["value"]))
    entries = entries.join(asked.select("key", "list", hashes.alias("skipped")).hint("merge"), "key").select(
        "key", "list", F.filter("entries", lambda e: (e["list"] == F.col("list")) & ~F.array_contains("skipped", e["word"]))
        .alias("entries"))
    hits = entries.select(
        "key", "list", F.size("entries").alias("n_hit"),
        F.size(F.filter("entries", lambda e: e["outside"])).alias("n_outside_hit"))
    sized = asked.select("key", "list").join(corpus.list_sizes(words), "list", "left").join(
        given.hint("merge"), ["key", "list"], "left").join(hits.hint("merge"), ["key", "list"], "left")
    for n in corpus.list_parts():
        sized = sized.withColumn(f"n_{n}", F.coalesce(f"n_{n}", F.lit(0)) - F.coalesce(f"given_{n}", F.lit(0)))
    n_found, passed = corpus.word_rule()
    return sized.select("key.probe_id", "key.model", "n_expected", n_found.cast("bigint").alias("n_found"),
                        passed.alias("passed"))


def score_prompts(probes: DataFrame, model: str, fn) -> DataFrame:
    """Hook for a model: ``fn(prompts, max_new_tokens, temperatures) -> outputs`` on Arrow batches.

    The function belongs to the caller; Spark partitions the probes and moves the batches.
    """
    def run(batches):
        for batch in batches:
            outputs = fn(batch["prompt"], batch["max_new_tokens"], batch["temperature"])
            yield batch[["probe_id"]].assign(model=model, output=list(outputs))

    return probes.select("probe_id", "prompt", "max_new_tokens", "temperature").mapInPandas(
        run, "probe_id string, model string, output string"
    )


def _written(probes: DataFrame, path: str) -> DataFrame:
    """What earlier runs have written under ``path``; nothing before the first."""
    spark = probes.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], SCORED)
    return spark.read.schema(SCORED).parquet(path)


SCORED = "probe_id string, model string, output string, error string"


def score_prompts_resumable(probes: DataFrame, model: str, fn, path: str, partitions: int | None = None,
                            batch: int = 64, again: bool = True) -> None:
    """``score_prompts`` that keeps what it has: outputs go to ``path`` and a run leaves out probes that have one.

    Each task commits its own file when it is done, so a run that breaks off loses the tasks it was in
    and no others. Inside a task prompts with few new tokens come first, in batches of up to ``batch``. A batch whose call fails is tried
    prompt by prompt, and a prompt that fails alone is kept with its error; ``again=False`` leaves such prompts out
    of further runs. A probe that is there several times is asked once.
    """
    before = _written(probes, path).filter(F.col("model") == model)
    done = before.filter("output IS NOT NULL" if again else "true").select("probe_id").distinct()
    todo = probes.select("probe_id", "prompt", "max_new_tokens", "temperature").dropDuplicates(["probe_id"]).join(
        done, "probe_id", "left_anti")
    todo = (todo.repartition(partitions, "probe_id") if partitions else todo.repartition("probe_id")).sortWithinPartitions(
        "max_new_tokens", "probe_id")

    def one_by_one(rows):
        for i in range(len(rows)):
            row = rows.iloc[i:i + 1]
            try:
                yield list(fn(row["prompt"], row["max_new_tokens"], row["temperature"]))[0], None
            except Exception as error:  # the prompt's own fault is kept beside it
                yield None, f"{type(error).__name__}: {error}"

    def run(batches):
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.iloc[start:start + batch]
                try:
                    outputs = [(o, None) for o in fn(part["prompt"], part["max_new_tokens"], part["temperature"])]
                    if len(outputs) != len(part):
                        raise ValueError(f"{len(outputs)} outputs for {len(part)} prompts")
                except Exception:
                    outputs = list(one_by_one(part))
                yield part[["probe_id"]].assign(
                    model=model, output=[o for o, _ in outputs], error=[e for _, e in outputs])

    # version 2: a task's file is in its place as soon as the task commits
    todo.mapInPandas(run, SCORED).write.mode("append").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def scored_responses(probes: DataFrame, path: str) -> DataFrame:
    """(probe_id, model, output) of all that runs have written under ``path``, each probe of a model once."""
    return _written(probes, path).filter("output IS NOT NULL").groupBy("probe_id", "model").agg(F.min("output").alias("output"))


def failed_prompts(probes: DataFrame, path: str) -> DataFrame:
    """(probe_id, model, errors, n_failed): probes that runs asked in vain and that still have no output."""
    rows = _written(probes, path)
    failed = rows.groupBy("probe_id", "model").agg(
        F.count("output").alias("_n"), F.array_sort(F.collect_set("error")).alias("errors"), F.count("error").alias("n_failed"))
    return failed.filter("_n = 0").drop("_n")
