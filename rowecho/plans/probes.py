"""Probe builders: a dataset becomes prompts with known answers.

Every builder gives the same columns. Builders that show rows work on ``"head"`` (the first
rows, as a single probe), ``"random"`` (a seeded sample) or ``"all"`` (every consecutive block
of rows is a probe of its own, so the whole table is covered in one shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowecho.functions import answers
from rowecho.functions.draws import draw_key
from rowecho.functions.text import (
    EXEMPLAR_DEFAULT, ROW_DEFAULT, Separators, answer_text, fill_template, integer_text,
    name_list, row_text, text_block, value_text,
)
from rowecho.operators.decide import EXPECTED_TYPE, MEMBER, NAMES, NONE, ROW, WORDS, WORDS_LONG
from rowecho.operators.perturb import replace_values
from rowecho.operators.rows import (
    column, first_per_class, mirror_position, random_columns, trailing_columns, without_given,
)
from rowecho.operators.sampling import random_row_per_trial, seeded_sample
from rowecho.plans import templates
from rowecho.sources.catalog import SKIPPED, Dataset
from rowecho.sources.lexicon import tag_lexicon
from rowecho.sources.positions import POS

Variants = Sequence[tuple[int, Separators]]
DEFAULT_VARIANT: Variants = ((0, ROW_DEFAULT),)

PROBE_COLUMNS = (
    "probe_id", "test", "dataset", "feature", "trial", "serialization", "features_sep", "prompt",
    "rule", "label", "expected", "case_sensitive", "max_new_tokens", "temperature",
)


def _finish(df: DataFrame, ds: Dataset, test: str, rule: Column | str, prompt: Column, *,
            feature: Column | None = None, trial: Column | None = None,
            label: Column | None = None, expected: Column | None = None,
            case_sensitive: bool = False) -> DataFrame:
    """The common probe columns; ``serialization`` and ``features_sep`` come from the frame."""
    if "serialization" not in df.columns:
        df = df.withColumn("serialization", F.lit(0)).withColumn(
            "features_sep", F.lit(ROW_DEFAULT.features_sep))
    feature = F.lit("") if feature is None else feature
    trial = F.lit(0) if trial is None else trial
    label = F.lit(None).cast("string") if label is None else label
    expected = F.lit(None) if expected is None else expected
    out = df.select(
        F.lit(test).alias("test"), F.lit(ds.name).alias("dataset"), feature.alias("feature"),
        trial.cast("bigint").alias("trial"), F.col("serialization").cast("bigint").alias("serialization"),
        "features_sep", prompt.alias("prompt"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"), label.alias("label"),
        expected.cast(EXPECTED_TYPE).alias("expected"),
        F.lit(case_sensitive).alias("case_sensitive"),
        F.lit(templates.MAX_NEW_TOKENS[test]).alias("max_new_tokens"),
        F.lit(0.0).alias("temperature"),
    )
    key = _probe_id(*[F.col(c) for c in ("test", "dataset", "feature", "trial", "serialization")])
    return out.withColumn("probe_id", key).select(*PROBE_COLUMNS)


def _probe_id(test: Column, dataset: Column, feature: Column, trial: Column, serialization: Column) -> Column:
    return F.md5(F.concat_ws("|", test, dataset, feature, trial, serialization))


def _dealt(rows: DataFrame, ds: Dataset, test: str, trial: Column, variants: Variants = DEFAULT_VARIANT,
           feature: str = "") -> DataFrame:
    """The rows, dealt out by the ids of the probes they become. With several variants a row becomes several probes and stays where it is."""
    if not ds.probe_partitions or len(variants) > 1:
        return rows
    return rows.repartition(ds.probe_partitions, _probe_id(
        F.lit(test), F.lit(ds.name), F.lit(feature), trial.cast("bigint"), F.lit(variants[0][0]).cast("bigint")))


def _word(value: Column, kind: Column, in_lexicon: Column) -> Column:
    return F.struct(
        value.alias("name"), value.alias("value"), kind.alias("kind"),
        in_lexicon.alias("in_lexicon"), F.lit(None).cast("string").alias("as_integer"),
    )


def _names(ds: Dataset) -> Column:
    """Long and short dataset name; either one counts."""
    return F.array(*[
        _word(F.lit(n), F.lit("string"), F.lit(False)) for n in (ds.spec.name, ds.spec.alias)
    ])


def _cell(ds: Dataset, name: str) -> Column:
    """Expected value of one feature of a row."""
    col, dtype = column(name), ds.dtype(name)
    return F.struct(
        F.lit(name).alias("name"), answer_text(col, dtype, name in ds.widened).alias("value"),
        F.lit("other").alias("kind"), F.lit(True).alias("in_lexicon"),
        integer_text(col, dtype).alias("as_integer"),
    )


def variant_texts(ds: Dataset, variants: Variants, *keep: Column, ignored: Sequence[str] = (),
                df: DataFrame | None = None) -> DataFrame:
    """The kept columns with a row's text in every variant.

    All variants come from one scan: rows are repeated per variant and each copy prints its own
    text, so a text is built exactly once.
    """
    source = ds.df if df is None else df
    texts = [row_text(ds.df, ds.columns, s, ignored, widened=ds.widened) for _, s in variants]
    if len(variants) == 1:
        number, separators = variants[0]
        return source.select(
            *keep, F.lit(number).alias("serialization"),
            F.lit(separators.features_sep).alias("features_sep"), texts[0].alias("text"))
    copies = source.withColumn("serialization", F.explode(F.array(*[F.lit(i) for i, _ in variants])))
    text = F.lit(None).cast("string")
    sep = F.lit(None).cast("string")
    for (i, s), t in zip(variants, texts):
        text = F.when(F.col("serialization") == i, t).otherwise(text)
        sep = F.when(F.col("serialization") == i, F.lit(s.features_sep)).otherwise(sep)
    return copies.select(*keep, "serialization", sep.alias("features_sep"), text.alias("text"))


def _shown(ds: Dataset, n: int, random_examples: bool, seed: int | str, variants: Variants) -> Column:
    """The example block of each variant, as one scalar map."""
    if random_examples:
        rows = seeded_sample(ds.df, n, seed).withColumn("_o", draw_key(seed, F.col(POS)))
    else:
        rows = ds.df.filter(F.col(POS) < n).withColumn("_o", F.col(POS))
    blocks = variant_texts(ds, variants, F.col("_o"), df=rows).groupBy("serialization").agg(
        text_block(F.col("_o"), F.col("text")).alias("shown")
    )
    return blocks.agg(F.map_from_entries(F.collect_list(F.struct("serialization", "shown")))).scalar()


# ---------------------------------------------------------------- knowledge of the schema

def description(ds: Dataset) -> DataFrame:
    """Dataset description; the label is the expected size and nothing is decided."""
    shape = ds.df.agg(F.count("*").alias("n"))
    label = F.concat(F.lit("("), F.col("n").cast("string"), F.lit(f", {len(ds.columns)})"))
    prompt = fill_template(templates.DATASET_DESCRIPTION, dname=ds.name)
    return _finish(shape, ds, "dataset_desc", NONE, prompt, label=label)


def _feature_words(ds: Dataset, features: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(dataset, names, words): the column list, and the expected words without id columns. The
    arrays are as long as a table is wide."""
    tagged = tag_lexicon(
        features.withColumn("value", F.col("feature")).withColumn("kind", F.lit("string")), lexicon
    )
    word = _word(F.col("value"), F.col("kind"), F.col("in_lexicon"))
    ordered = F.array_sort(F.collect_list(F.struct("feature_pos", "feature", word.alias("w"))))
    ids = F.array(*[F.lit(c) for c in ds.spec.id_features]).cast("array<string>")
    return tagged.groupBy("dataset").agg(ordered.alias("o")).select(
        "dataset",
        F.transform("o", lambda x: x["feature"]).alias("names"),
        F.filter(
            F.transform("o", lambda x: x["w"]), lambda w: ~F.array_contains(ids, w["value"])
        ).alias("words"),
    )


def features_uninformed(ds: Dataset, features: DataFrame, lexicon: DataFrame) -> DataFrame:
    prompt = fill_template(templates.FEATURES_UNINFORMED, dname=ds.name)
    return _finish(_feature_words(ds, features, lexicon), ds, "features_list_uninf", WORDS, prompt,
                   expected=F.col("words"))


def features_informed(ds: Dataset, features: DataFrame, lexicon: DataFrame, n_given: int = 5,
                      n_repeat: int = 3, seed: int | str = 0) -> DataFrame:
    """Some features are given, the others expected; one probe per repeat."""
    picked = random_columns(features, n_repeat, n_given, seed).groupBy("trial").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("draw_rank", "feature"))), lambda x: x["feature"]
        ).alias("given")
    )
    trials = _feature_words(ds, features, lexicon).withColumn(
        "trial", F.explode(F.sequence(F.lit(0), F.lit(n_repeat - 1)))
    )
    rows = trials.join(picked, "trial", "left").withColumn(
        "given", F.coalesce("given", F.array().cast("array<string>"))
    ).withColumn("rest", without_given(F.col("names"), F.col("given")))
    expected = F.filter("words", lambda w: F.array_contains("rest", w["value"]))
    prompt = fill_template(templates.FEATURES_INFORMED, dname=ds.name, fname=name_list(F.col("given")))
    return _finish(rows, ds, "features_list_inf", WORDS, prompt, trial=F.col("trial"), expected=expected)


def features_reverse(ds: Dataset, features: DataFrame) -> DataFrame:
    """The dataset's name from its column names."""
    names = features.groupBy("dataset").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("feature_pos", "feature"))), lambda x: x["feature"]
        ).alias("names")
    )
    prompt = fill_template(templates.FEATURES_REVERSE, fname=name_list(F.col("names")))
    return _finish(names, ds, "recognition_feat", NAMES, prompt, expected=_names(ds))


# ---------------------------------------------------------------- knowledge of the values

def _list_words() -> Column:
    return F.transform("words", lambda w: _word(w["value"], w["kind"], w["in_lexicon"]))


def _list_rule() -> Column:
    """A list too long to travel is looked up where its values are."""
    return F.when(F.col("words").isNull(), F.lit(WORDS_LONG)).otherwise(F.lit(WORDS))


def values_uninformed(ds: Dataset, lists: DataFrame, categorical: bool = True,
                      give_name: bool = True) -> DataFrame:
    """All values of a feature. ``lists`` is ``value_lists`` of the asked features."""
    template = {
        (True, True): templates.VALUES_CATEGORICAL_NAMED,
        (False, True): templates.VALUES_NUMERIC_NAMED,
        (True, False): templates.VALUES_CATEGORICAL_UNNAMED,
        (False, False): templates.VALUES_NUMERIC_UNNAMED,
    }[categorical, give_name]
    prompt = fill_template(template, dname=ds.name if give_name else None, fname=F.col("feature"))
    mine = lists.filter(F.col("dataset") == ds.name)
    return _finish(mine, ds, "feature_values_uninf", _list_rule(), prompt, feature=F.col("feature"),
                   expected=_list_words())


def distribution(ds: Dataset, values: DataFrame, limit: int = 1000) -> DataFrame:
    """How often a feature takes each of its values: asked for a list of 100 values, and for shares. ``values`` is
    ``feature_values`` of the asked features; one with more than ``limit`` values cannot be listed and is not asked. The
    answers are decided against the same table (``operators.distribution``)."""
    listed = values.filter(F.col("dataset") == ds.name).groupBy("feature").agg(
        F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("first_pos", "value"))).alias("_values")).filter(F.col("_n") <= limit)
    shown = F.array_join(F.transform("_values", lambda v: v["value"]), ", ")
    return reduce(DataFrame.unionByName, [
        _finish(listed, ds, test, NONE, fill_template(template, dname=ds.name, fname=F.col("feature"), values=shown),
                feature=F.col("feature"))
        for test, template in (("distribution_list", templates.DISTRIBUTION_LIST),
                               ("distribution_shares", templates.DISTRIBUTION_SHARES))])


def values_from_examples(
    ds: Dataset, lists: DataFrame, features: Sequence[str], n_given: int = 3, mode: str = "head",
    seed: int | str = 0, variants: Variants = DEFAULT_VARIANT, parity: bool = False,
) -> DataFrame:
    """Remaining values of a feature after some rows are shown.

    At most (distinct values - 1) rows are shown. The expected list is what the shown rows do
    not give away (of a list too long to travel the probe holds what they do give away); with ``parity`` the number of rows carries over to later features and the
    known values are those of the head even where random rows are shown. ``lists`` is read for
    every feature, so it should be a written table.
    """
    mine = lists.filter(F.col("dataset") == ds.name)
    parts, carried = [], F.lit(n_given)
    for f in features:
        if f in ds.spec.skip_given_features:
            continue
        n_values = mine.filter(F.col("feature") == f).agg(F.max("n_values")).scalar()
        n = F.least(carried if parity else F.lit(n_given), n_values - 1)
        if parity:
            carried = n
        value = value_text(column(f), ds.dtype(f), f in ds.widened)
        source = ds.df
        if mode == "random":
            drawn = seeded_sample(source, n_given, seed).withColumn("_o", draw_key(seed, F.col(POS)))
            # at most n_given rows are ranked here
            drawn = drawn.withColumn("_i", F.row_number().over(Window.orderBy("_o", POS)) - 1)
            source = drawn.withColumn("_block", F.lit(0)).filter(F.col("_i") < F.greatest(n, F.lit(1)))
        elif mode == "head":
            source = source.withColumn("_o", F.col(POS)).withColumn("_block", F.lit(0)).filter(
                F.col(POS) < F.greatest(n, F.lit(1)))
        else:
            source = source.withColumn("_o", F.col(POS)).withColumn(
                "_block", F.when(n > 0, F.floor(F.col(POS) / F.greatest(n, F.lit(1)))).otherwise(F.lit(0))
            ).filter((n > 0) | (F.col(POS) == 0))  # nothing to show: one probe, from one row
        shown = variant_texts(
            ds, variants, F.col("_block"), F.col("_o"), F.when(n > 0, value).alias("_v"),
            (n > 0).alias("_any"), df=source,
        ).groupBy("_block", "serialization", "features_sep").agg(
            text_block(F.col("_o"), F.when(F.col("_any"), F.col("text"))).alias("shown"),
            F.collect_set("_v").alias("known"),
        )
        if parity and mode == "random":
            head = ds.df.filter(F.col(POS) < n).agg(F.collect_set(value)).scalar()
            shown = shown.withColumn("known", head)
        asked = shown.withColumn("words", mine.filter(F.col("feature") == f).select("words").scalar())
        nothing = F.lit(None).cast("string")
        given = F.transform("known", lambda v: _word(v, nothing, F.lit(None).cast("boolean")))
        expected = F.when(F.col("words").isNull(), given).otherwise(
            F.filter(_list_words(), lambda w: ~F.array_contains("known", w["value"])))
        prompt = fill_template(templates.VALUES_FROM_EXAMPLES, dname=ds.name, fname=F.lit(f),
                               serialization=F.col("shown"))
        parts.append(_finish(asked, ds, "feature_values_inf", _list_rule(), prompt, feature=F.lit(f),
                             trial=F.col("_block"), expected=expected))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- recognition and membership

def recognition(ds: Dataset, n_given: int = 5, mode: str = "head", seed: int | str = 0,
                variants: Variants = DEFAULT_VARIANT) -> DataFrame:
    """The dataset's name from some rows."""
    if mode == "random":
        source = seeded_sample(ds.df, n_given, seed).withColumn("_o", draw_key(seed, F.col(POS)))
        source = source.withColumn("_block", F.lit(0))
    else:
        block = F.floor(F.col(POS) / n_given)
        source = _dealt(ds.df, ds, "recognition_ex", block, variants) if mode == "all" else ds.df
        source = source.withColumn("_o", F.col(POS)).withColumn("_block", block)
        if mode == "head":
            source = source.filter(F.col(POS) < n_given)
    number = F.lit(variants[0][0]) if len(variants) == 1 else F.lit(None)
    # rows that are dealt out by this id are grouped where they are
    dealt = _probe_id(F.lit("recognition_ex"), F.lit(ds.name), F.lit(""), F.col("_block").cast("bigint"), number.cast("bigint"))
    shown = variant_texts(ds, variants, F.col("_block"), F.col("_o"), dealt.alias("_dealt"), df=source).groupBy(
        "_dealt", "_block", "serialization", "features_sep"
    ).agg(text_block(F.col("_o"), F.col("text")).alias("shown"))
    prompt = fill_template(templates.RECOGNITION, serialization=F.col("shown"))
    return _finish(shown, ds, "recognition_ex", NAMES, prompt, trial=F.col("_block"),
                   expected=_names(ds), case_sensitive=ds.spec.case_sensitive_name)


def membership(ds: Dataset, n_tests: int | None = None, seed: int | str = 0,
               separators: Separators = ROW_DEFAULT, parity: bool = False) -> DataFrame:
    """Does a row belong to the dataset? Even rows are altered, odd rows genuine; the worked
    example is the mirror row from the tail, genuine and altered.

    ``n_tests=None`` asks for every row. Rows meet their altered copies and mirrors by equality
    on the position.
    """
    n_swapped = max(len(ds.columns) - 3, 1)
    texts = [POS, row_text(ds.df, ds.columns, separators, widened=ds.widened).alias("text")]
    mirrored = ds.df.withColumn("trial", mirror_position(ds.df))
    asked = ds.df
    if n_tests is not None:
        asked = asked.filter(F.col(POS) < n_tests)
        mirrored = mirrored.filter(F.col("trial") < n_tests)
    both = asked.filter(F.col(POS) % 2 == 0).drop("trial").withColumn("_role", F.lit("sample")).unionByName(
        mirrored.drop("trial").withColumn("_role", F.lit("mirror")))
    # the rows asked about and the examples are altered in one go
    changed = replace_values(ds, n_swapped, seed, both, parity=parity)
    changed = changed.select(
        POS, "_role", "altered", row_text(changed, ds.columns, separators, widened=ds.widened).alias("changed"))
    altered = changed.filter("_role = 'sample'").drop("_role")
    mirror_no = changed.filter("_role = 'mirror'").select(F.col(POS).alias("_m"), F.col("changed").alias("no_text"))
    mirror_yes = mirrored.select(
        F.col(POS).alias("_m"), "trial",
        row_text(mirrored, ds.columns, separators, widened=ds.widened).alias("yes_text"))
    rows = (
        asked.select(*texts)
        .join(altered, POS, "left")
        .join(mirror_yes.join(mirror_no, "_m").drop("_m"), F.col(POS) == F.col("trial"))
    )
    is_no = F.col("altered").isNotNull()
    example = F.concat("yes_text", F.lit("\nAnswer: Yes\n"), "no_text", F.lit("\nAnswer: No\n"))
    prompt = fill_template(
        templates.MEMBERSHIP, dname=ds.name, example=example,
        serialization=F.coalesce("changed", "text"),
    )
    return _finish(rows, ds, "membership", MEMBER, prompt, trial=F.col(POS),
                   label=F.when(is_no, F.lit("No")).otherwise(F.lit("Yes")))


# ---------------------------------------------------------------- completion

def completion_incomplete(
    ds: Dataset, trials: DataFrame | None = None, n_removed: int = 3, n_given: int = 4,
    random_examples: bool = True, seed: int | str = 0, variants: Variants = DEFAULT_VARIANT,
    test: str = "incomplete_completion_random",
) -> DataFrame:
    """A row without its last features, after some whole rows.

    With ``random_examples`` the shown rows are a seeded sample and each trial draws its row;
    otherwise the head is shown and the row after it is asked for.
    """
    removed = trailing_columns(ds.columns, n_removed)
    if random_examples:
        if trials is None:
            trials = ds.df.sparkSession.range(5).withColumnRenamed("id", "trial")
        rows = random_row_per_trial(ds.df, trials, f"{seed}|row")
    else:
        rows = ds.df.filter(F.col(POS) == n_given).withColumn("trial", F.lit(0))
    expected = F.array(*[_cell(ds, c) for c in removed])
    rows = _dealt(rows, ds, test, F.col("trial"), variants)
    texts = variant_texts(ds, variants, F.col("trial"), expected.alias("cells"), ignored=removed, df=rows)
    shown = _shown(ds, n_given, random_examples, seed, variants)
    prompt = fill_template(
        templates.COMPLETION_INCOMPLETE, dname=ds.name, fname="[" + ", ".join(removed) + "]",
        serialization=shown[F.col("serialization")], example=F.col("text"),
    )
    return _finish(texts, ds, test, ROW, prompt, trial=F.col("trial"),
                   expected=F.col("cells"))


def completion_full(ds: Dataset, n_given: int = 4, mode: str = "head", seed: int | str = 0,
                    variants: Variants = DEFAULT_VARIANT) -> DataFrame:
    """The next row in full after some rows. ``"all"``: every block of n_given + 1 rows."""
    cells = F.array(*[_cell(ds, c) for c in ds.columns])
    fname = "[" + ", ".join(ds.columns) + "]"
    if mode == "random":
        shown = _shown(ds, n_given, True, seed, variants)
        asked = ds.df.filter(F.col(POS) == n_given)
        rows = variant_texts(ds, variants, cells.alias("cells"), df=asked).withColumn(
            "shown", shown[F.col("serialization")]).withColumn("_block", F.lit(0))
    else:
        size = n_given + 1
        source = ds.df if mode == "all" else ds.df.filter(F.col(POS) < size)
        is_next = F.col(POS) % size == n_given
        rows = variant_texts(
            ds, variants, F.floor(F.col(POS) / size).alias("_block"), F.col(POS).alias("_o"),
            is_next.alias("_next"), F.when(is_next, cells).alias("cells"), df=source,
        ).groupBy("_block", "serialization", "features_sep").agg(
            text_block(F.col("_o"), F.when(~F.col("_next"), F.col("text"))).alias("shown"),
            F.max("cells").alias("cells"),
        ).filter(F.col("cells").isNotNull())
    prompt = fill_template(templates.COMPLETION_FULL, dname=ds.name, fname=fname,
                           serialization=F.col("shown"))
    return _finish(rows, ds, "full_completion", ROW, prompt, trial=F.col("_block"),
                   expected=F.col("cells"))


def completion_feature(ds: Dataset, feature: str, n_tests: int | None = 5,
                       random_example: bool = False, seed: int | str = 0,
                       variants: Variants = DEFAULT_VARIANT) -> DataFrame:
    """One identifying feature hidden. ``n_tests=None`` asks for every row; a map-only job."""
    if random_example:
        trials = ds.df.sparkSession.range(n_tests).withColumnRenamed("id", "trial")
        rows = random_row_per_trial(ds.df, trials, seed)
    else:
        rows = _dealt(ds.df, ds, "feature_completion", F.col(POS), variants, feature).withColumn("trial", F.col(POS))
        if n_tests is not None:
            rows = rows.filter(F.col(POS) < n_tests)
    texts = variant_texts(ds, variants, F.col("trial"), F.array(_cell(ds, feature)).alias("cells"),
                        ignored=[feature], df=rows)
    prompt = fill_template(templates.COMPLETION_FEATURE, dname=ds.name, fname=feature,
                           serialization=F.col("text"))
    return _finish(texts, ds, "feature_completion", ROW, prompt, feature=F.lit(feature),
                   trial=F.col("trial"), expected=F.col("cells"))


# ---------------------------------------------------------------- classification

def _target_text(ds: Dataset) -> Column:
    return answer_text(column(ds.spec.target), ds.dtype(ds.spec.target))


def exemplar_block(ds: Dataset) -> DataFrame:
    """One row with one worked example per class, computed once per dataset."""
    task, target = ds.spec.task, _target_text(ds)
    answer = answers.classification_answer(target, task.rule, task.positive, task.threshold)
    by_threshold = task.threshold is not None
    firsts = first_per_class(
        ds.df.filter(column(ds.spec.target).isNotNull()), answer if by_threshold else target
    )
    question = task.exemplar_question or task.question
    text = F.concat(
        F.lit("Example:\n"),
        row_text(ds.df, ds.columns, EXEMPLAR_DEFAULT, [ds.spec.target], remove_last_sep=False,
                 widened=ds.widened),
        F.lit(f"\n{question}\nAnswer: "), answer, F.lit("\n\n"),
    )
    order = (answer != "Yes").cast("int") if by_threshold else F.col("class_order")
    ordered = F.array_sort(F.collect_list(F.struct("o", "t")))
    return firsts.select(order.alias("o"), text.alias("t")).agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("example")
    )


def classification(ds: Dataset, n_tests: int | None = 100, shots: bool = False,
                   seed: int | str = 42, separators: Separators = ROW_DEFAULT) -> DataFrame:
    """Predict the target of sampled rows (``n_tests=None``: of every row)."""
    task = ds.spec.task
    if task is None:
        raise ValueError(f"{ds.name} has no classification task")
    test = "classification_1shot" if shots else "classification_0shot"
    rows = _dealt(ds.df, ds, test, F.col(POS)) if n_tests is None else seeded_sample(ds.df, n_tests, seed)
    text = row_text(ds.df, ds.columns, separators, [ds.spec.target], widened=ds.widened)
    label = answers.classification_label(
        _target_text(ds), task.rule, task.positive, task.negative, task.threshold)
    if shots:
        filled = templates.CLASSIFICATION_SHOTS
        slots = {"example": exemplar_block(ds).scalar()}
    else:
        filled, slots = templates.CLASSIFICATION, {}
    prompt = fill_template(filled, answers=task.answers, serialization=text, question=task.question, **slots)
    return _finish(rows, ds, test, task.rule, prompt, trial=F.col(POS), label=label)


def skipped(ds: Dataset, test: str) -> bool:
    return ds.name in SKIPPED.get(test, ())
