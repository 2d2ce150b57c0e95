"""Every registered query: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from checks.datasets import MEDIAN_BALANCE, cores, dataset, lexicon, table
from checks.responder import ECHOING, MODELS, respond
from rowecho import streaming
from rowecho.functions import answers
from rowecho.functions.draws import draw_int, draw_position
from rowecho.functions.text import (
    EXEMPLAR_DEFAULT, ROW_DEFAULT, SERIALIZATIONS, fill_template, row_text, text_block, value_text,
)
from rowecho.operators import corpus, decide, dictionary, distribution, members, perturb, profile, reshape, rows, sampling, score
from rowecho.plans import probes as P, reports, runs, templates, wording
from rowecho.sources import inference, sinks
from rowecho.sources.catalog import Dataset, DatasetSpec, decode_by_table, decode_index, load_dataset
from rowecho.sources.lexicon import tag_lexicon
from rowecho.sources.lineage import cut_lineage, remove_at_end
from rowecho.sources.passage_index import PassageIndex
from rowecho.sources.positions import POS, seeded_shuffle, with_positions
from rowecho.sources.results import accuracy_cell, read_labelled, read_scorecards

Query = Callable[[SparkSession, str], DataFrame]
VARIANTS = tuple(enumerate(SERIALIZATIONS))
DATASETS = ("customer", "part", "orders")
DISPLAY = {"customer accounts": "Customer", "part catalog": "Part", "customer orders": "Orders"}

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def only(ds: Dataset, *columns: str) -> Dataset:
    """The dataset cut to some columns."""
    return replace(ds, df=ds.df.select(POS, *columns), columns=tuple(columns))


def value_words(spark, d, alias) -> DataFrame:
    ds = dataset(spark, d, alias)
    return tag_lexicon(profile.feature_values(ds, ds.spec.value_features), lexicon(spark, d))


def lists_of(spark, d, alias) -> DataFrame:
    return cut_lineage(profile.value_lists(value_words(spark, d, alias), 1000))


def expected_text() -> Column:
    return F.array_join(F.transform("expected", lambda e: e["value"]), "|")


def show_probes(probes: DataFrame) -> DataFrame:
    return probes.select(
        "probe_id", "test", "dataset", "feature", "trial", "serialization", "prompt", "label",
        expected_text().alias("expected"), F.col("max_new_tokens").cast("bigint").alias("max_new_tokens"),
    )


def decided(probes: DataFrame, buckets: int | None = None) -> DataFrame:
    """Verdicts of the stand-in models. Probes that are dealt out by their id are kept in so many buckets of it: responses are made and
    meet their probes there."""
    if buckets:
        probes = cut_lineage(probes, ("probe_id", buckets), compression="zstd")
        # its files are many times smaller than the outputs: no side goes through the driver
        return decide.decide(decide.join_responses(probes.hint("merge"), respond(probes), MODELS, ECHOING))
    probes = cut_lineage(probes, compression="zstd")  # read by the stand-in responses and by the join
    return decide.decide(decide.join_responses(probes, respond(probes), MODELS, ECHOING, decide.join_partitions(probes)))


def show_verdicts(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "probe_id", "model", "test", "dataset", "trial", "passed", "n_found", "n_expected",
        decide.matches_text(F.col("matches")).alias("matches"),
    )


# ---------------------------------------------------------------- sources, columns, positions

@query
def profile_features(spark, d):
    return union(profile.dataset_features(dataset(spark, d, a)) for a in DATASETS)


@query
def profile_shape(spark, d):
    return union(profile.dataset_shape(dataset(spark, d, a)) for a in (*DATASETS, "lineitem"))


@query
def profile_values(spark, d):
    return union(
        profile.feature_values(ds, ds.spec.value_features)
        for ds in (dataset(spark, d, a) for a in DATASETS)
    ).withColumn("pct", F.round("pct", 6))


@query
def value_distribution(spark, d):
    ds = dataset(spark, d, "part")
    values = profile.feature_values(ds, ["p_name"])
    return values.select("value", "n", F.round("pct", 6).alias("pct"))


@query
def usable_columns(spark, d):
    """Columns with more than one value."""
    parts = []
    for a in (*DATASETS, "lineitem"):
        ds = dataset(spark, d, a)
        usable, _, _ = profile.varying_columns(ds)
        parts.append(profile.feature_list(ds).filter(F.col("feature").isin(usable)).select("dataset", "feature"))
    return union(parts)


@query
def decode_label(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    named = decode_index(nations, "n_regionkey", ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    named = named.withColumnRenamed("n_regionkey", "region")
    out = decode_by_table(table(spark, d, "customer"), "c_nationkey", named, "n_nationkey")
    return out.select("c_custkey", "n_name", "region")


@query
def drop_rename(spark, d):
    part = table(spark, d, "part")
    names = {"p_name": "name", "p_brand": "brand", "p_type": "type", "p_size": "size",
             "p_retailprice": "price", "p_partkey": "key"}
    return rows.rename_columns(part, names, ["p_partkey"])


@query
def trailing_feature_values(spark, d):
    orders = dataset(spark, d, "orders")
    return orders.df.select(POS, *rows.trailing_columns(orders.columns, 3))


@query
def skip_rules(spark, d):
    """Feature grid without id columns, models and trials spread by literals."""
    specs = [dataset(spark, d, a) for a in DATASETS]
    features = union(profile.feature_list(ds) for ds in specs).select("dataset", "feature", "n_rows")
    rules = spark.createDataFrame(
        [(ds.name, f) for ds in specs for f in ds.spec.id_features], "dataset string, feature string")
    kept = rows.without_pairs(features, rules, ["dataset", "feature"])
    return kept.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))


@query
def filter_threshold(spark, d):
    c = table(spark, d, "customer")
    return c.filter(F.col("c_acctbal") >= F.lit(MEDIAN_BALANCE)).select("c_custkey", "c_acctbal")


@query
def dedup_keep_first(spark, d):
    ds = dataset(spark, d, "part")
    return rows.keep_first(ds.df, ["p_name", "p_brand", "p_type"]).drop(POS)


@query
def head_rows(spark, d):
    return rows.head_rows(dataset(spark, d, "customer").df, 5).drop(POS)


@query
def row_after_head(spark, d):
    return rows.row_at(dataset(spark, d, "customer").df, 4).drop(POS)


@query
def tail_mirror(spark, d):
    ds = dataset(spark, d, "customer")
    n = 2 ** 62  # mirrors of every row
    return rows.tail_mirror(ds.df, n).select("c_custkey", "mirror_of")


@query
def first_per_class(spark, d):
    ds = dataset(spark, d, "customer")
    return rows.first_per_class(ds.df, F.col("c_mktsegment")).select(
        "c_mktsegment", "c_custkey", F.col("class_order").cast("bigint").alias("class_order"))


@query
def file_positions(spark, d):
    """Positions from file order against the key order of a table written in key order."""
    scan = spark.read.parquet(f"{d}/part.parquet")  # positions belong to the scan itself
    out = with_positions(scan.select("p_partkey"))
    return out.select("p_partkey", POS)


@query
def seeded_shuffle_rows(spark, d):
    ds = dataset(spark, d, "customer")
    return seeded_shuffle(ds.df, 0).select("c_custkey", POS)


@query
def seeded_sample_rows(spark, d):
    ds = dataset(spark, d, "customer")
    return sampling.seeded_sample(ds.df, 100, 42).select("c_custkey", "c_name")


@query
def seeded_sample_half(spark, d):
    """Half of a table, by the threshold of its draws."""
    ds = dataset(spark, d, "orders")
    return sampling.threshold_sample(ds.df, ds.df.count() // 2, 42, top_rows=100).select("o_orderkey", "o_custkey")


@query
def random_row_per_trial(spark, d):
    ds = dataset(spark, d, "customer")
    trials = dataset(spark, d, "orders").df.select(F.col(POS).alias("trial"))
    return sampling.random_row_per_trial(ds.df, trials, 7).select("trial", "c_custkey", "c_name")


@query
def random_columns(spark, d):
    features = union(profile.feature_list(dataset(spark, d, a)) for a in DATASETS)
    picked = rows.random_columns(features, 3, 5, 0)
    return picked.join(features.select("dataset", "feature", "n_rows"), ["dataset", "feature"])


@query
def median_threshold(spark, d):
    c = table(spark, d, "customer")
    cut = profile.median_threshold(c, "c_acctbal")
    return c.withColumn("threshold", F.lit(cut)).select(
        "c_custkey", "threshold", (F.col("c_acctbal") >= F.col("threshold")).alias("above"))


# ---------------------------------------------------------------- text

def _text_of(ds: Dataset, **options) -> Column:
    return row_text(ds.df, ds.columns, **options)


@query
def row_text_customer(spark, d):
    ds = dataset(spark, d, "customer")
    return ds.df.select(POS, _text_of(ds).alias("text"))


@query
def row_text_orders(spark, d):
    ds = dataset(spark, d, "orders")
    return ds.df.select(POS, _text_of(ds).alias("text"))


@query
def row_text_options(spark, d):
    """Default separators, ignored column, custom names, last separator kept."""
    ds = dataset(spark, d, "supplier")
    names = {"s_suppkey": "key", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"}
    return ds.df.select(POS, _text_of(
        ds, separators=EXEMPLAR_DEFAULT, ignored=["s_suppkey"], names=names, remove_last_sep=False
    ).alias("text"))


@query
def row_text_variants(spark, d):
    ds = dataset(spark, d, "part")
    return P.variant_texts(ds, VARIANTS, F.col(POS)).select(
        POS, F.col("serialization").cast("bigint").alias("serialization"), "text")


@query
def row_block(spark, d):
    ds = dataset(spark, d, "customer")
    block = F.floor(F.col(POS) / 5).alias("block")
    return ds.df.select(block, POS, _text_of(ds).alias("text")).groupBy("block").agg(
        text_block(F.col(POS), F.col("text")).alias("text"))


@query
def row_text_lineitem(spark, d):
    ds = dataset(spark, d, "lineitem")
    text = ds.df.select(_text_of(ds).alias("t"))
    return text.agg(
        F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"),
        F.bit_xor(draw_int("line", F.col("t"))).alias("fingerprint"))


@query
def template_fill(spark, d):
    ds = dataset(spark, d, "part")
    prompt = fill_template(templates.COMPLETION_INCOMPLETE, dname=F.col("p_brand"), fname=F.col("p_type"),
                           serialization=F.col("p_name"), example=value_text(F.col("p_size"), ds.dtype("p_size")))
    return ds.df.select(POS, prompt.alias("prompt"))


@query
def template_fill_by_table(spark, d):
    """Every template of the table filled for every part."""
    table_ = wording.own_templates(spark)
    names = [r["name"] for r in table_.select("name").collect()]  # the templates of the library
    asked = dataset(spark, d, "part").df.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    size = F.col("p_size").cast("string")
    slots = {"dname": F.col("p_brand"), "fname": F.col("p_type"), "serialization": F.col("p_name"), "example": size,
             "answers": F.concat(F.lit("{dname}"), "p_brand"), "question": F.col("p_type"), "values": F.col("p_name")}
    return wording.fill_by_name(asked, table_, "name", slots).select(POS, "name", F.md5("prompt").alias("prompt"))


@query
def answer_strings(spark, d):
    """Cropping and cutting of response texts."""
    turns = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    text = F.col("text")
    return turns.select(
        "conv_id", "turn", answers.first_line(text).alias("first_line"),
        answers.completion_line(text).alias("line"),
        answers.after_marker(text, ". ").alias("after"),
        answers.clean_answer(F.concat(F.lit(" <b>"), text, F.lit("</b>\n"))).alias("clean"),
        answers.short_answer(text, "yes_no").alias("short"),
        answers.crop_echo(text, F.left(text, F.lit(10)), F.lit(True)).alias("cropped"),
        answers.needle(F.concat(text, F.lit(" (cm)"))).alias("needle"),
    )


@query
def parse_score_cells(spark, d):
    """Packed score cells built from the verdict counts of the labels table, and read back."""
    labels = table(spark, d, "labels")
    packed = labels.groupBy("quality").agg(
        F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic")
    ).withColumn("cell", F.concat(
        F.round(F.col("n_toxic") / F.col("n"), 2).cast("string"), F.lit(" ("),
        F.col("n_toxic").cast("string"), F.lit("-"), (F.col("n") - F.col("n_toxic")).cast("string"), F.lit(")")))
    return packed.select("quality", "cell", F.inline(F.array(accuracy_cell(F.col("cell"))))).select(
        F.col("quality").cast("bigint").alias("quality"), "cell", "score",
        reports.format_score(F.col("score")).alias("shown"),
        F.get("counts", F.lit(0)).cast("bigint").alias("first_count"),
        F.get("counts", F.lit(1)).cast("bigint").alias("second_count"))


# ---------------------------------------------------------------- altered rows

@query
def swap_columns(spark, d):
    ds = only(dataset(spark, d, "customer"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    out = perturb.swap_columns(ds, 2, 0)
    return out.select(POS, F.array_join("swapped", "|").alias("swapped"))


def _small_part(spark, d) -> Dataset:
    return only(dataset(spark, d, "part"), "p_name", "p_brand", "p_type")


@query
def perturb_values(spark, d):
    out = perturb.replace_values(dataset(spark, d, "customer"), 2, 0)
    return out.drop("altered")


@query
def perturb_until_new(spark, d):
    """Three low-cardinality columns: many redraws end in another row of the table. Where it holds every combination of
    them no row can be altered, and each comes back as it is, not ``altered``."""
    return perturb.replace_values(_small_part(spark, d), 1, 0, keep_stuck=True)


@query
def perturbed_not_in_dataset(spark, d):
    """All rows, and how many of their altered copies are in the table."""
    ds = _small_part(spark, d)
    out = perturb.replace_values(ds, 1, 0, keep_stuck=True)
    tagged = members.tag_members(out, ds.df, ds.columns)
    return tagged.agg(F.count("*").alias("n"), F.count_if(F.col("is_member") & F.col("altered")).alias("n_members"))


@query
def row_membership(spark, d):
    """Genuine rows for odd positions; even ones take the type of the next position."""
    ds, mixed = _mixed_rows(spark, d)
    return members.tag_members(mixed, ds.df, ds.columns)


def _mixed_rows(spark, d) -> tuple[Dataset, DataFrame]:
    ds = _small_part(spark, d)
    nxt = ds.df.select((F.col(POS) - 1).alias(POS), F.col("p_type").alias("next_type"))
    mixed = ds.df.join(nxt, POS, "left").withColumn(
        "p_type", F.when(F.col(POS) % 2 == 0, F.coalesce("next_type", "p_type")).otherwise(F.col("p_type")))
    return ds, mixed.drop("next_type")


@query
def row_membership_filtered(spark, d):
    """The same through a filter of bits, and which rows it left for the join on equality."""
    ds, mixed = _mixed_rows(spark, d)
    known = members.write_filter(ds.df, ds.columns, _folder(spark, "bits"), per_row=4)
    return members.tag_members_filtered(mixed, ds.df, known)


# ---------------------------------------------------------------- probes

@query
def probe_description(spark, d):
    return show_probes(union(P.description(dataset(spark, d, a)) for a in DATASETS))


def _features(spark, d, alias):
    ds = dataset(spark, d, alias)
    return ds, profile.feature_list(ds)


@query
def probe_features_uninformed(spark, d):
    lex = cut_lineage(lexicon(spark, d))
    return show_probes(union(
        P.features_uninformed(*_features(spark, d, a), lex) for a in DATASETS))


@query
def probe_features_informed(spark, d):
    lex = cut_lineage(lexicon(spark, d))
    return show_probes(union(
        P.features_informed(*_features(spark, d, a), lex, 3, 3) for a in DATASETS))


@query
def probe_features_reverse(spark, d):
    return show_probes(union(P.features_reverse(*_features(spark, d, a)) for a in DATASETS))


@query
def probe_values_uninformed(spark, d):
    return show_probes(union(
        P.values_uninformed(dataset(spark, d, a), lists_of(spark, d, a)) for a in DATASETS))


@query
def probe_values_numeric_unnamed(spark, d):
    return show_probes(union(
        P.values_uninformed(dataset(spark, d, a), lists_of(spark, d, a), categorical, False)
        for a, categorical in (("customer", False), ("part", True))))


@query
def probe_values_examples(spark, d):
    ds = dataset(spark, d, "customer")
    return show_probes(P.values_from_examples(
        ds, lists_of(spark, d, "customer"), ds.spec.value_features, 3, "all"))


@query
def probe_values_examples_random(spark, d):
    return show_probes(union(
        P.values_from_examples(ds, lists_of(spark, d, a), ds.spec.value_features, 3, "random")
        for a, ds in ((a, dataset(spark, d, a)) for a in ("part", "orders"))))


@query
def probe_recognition(spark, d):
    return show_probes(union(P.recognition(dataset(spark, d, a), 5, "all") for a in DATASETS))


@query
def probe_membership(spark, d):
    return show_probes(P.membership(dataset(spark, d, "customer"), None))


def _every_row_a_trial(ds):
    return ds.df.select(F.col(POS).alias("trial"))


@query
def probe_completion_incomplete(spark, d):
    ds = dataset(spark, d, "customer")
    return show_probes(P.completion_incomplete(ds, _every_row_a_trial(ds)))


@query
def probe_completion_incomplete_head(spark, d):
    return show_probes(union(
        P.completion_incomplete(dataset(spark, d, a), random_examples=False) for a in DATASETS))


@query
def probe_completion_full(spark, d):
    return show_probes(P.completion_full(dataset(spark, d, "orders"), 4, "all"))


@query
def probe_completion_feature(spark, d):
    return show_probes(P.completion_feature(dataset(spark, d, "orders"), "o_totalprice", None))


@query
def probe_classification(spark, d):
    return show_probes(union(P.classification(dataset(spark, d, a), None) for a in ("customer", "orders")))


@query
def probe_classification_shots(spark, d):
    return show_probes(union(
        P.classification(dataset(spark, d, a), None, shots=True) for a in ("customer", "supplier")))


@query
def probe_classification_sample(spark, d):
    return show_probes(P.classification(dataset(spark, d, "orders"), 100))


@query
def probe_serialization_variants(spark, d):
    ds = dataset(spark, d, "customer")
    return show_probes(union([
        P.recognition(ds, 5, "all", variants=VARIANTS),
        P.completion_feature(ds, "c_name", None, variants=VARIANTS),
    ]))


@query
def probe_full_run(spark, d):
    """All probes of the standard run for three datasets."""
    datasets = [dataset(spark, d, a) for a in DATASETS]
    return show_probes(runs.all_probes(datasets, cut_lineage(lexicon(spark, d))))


@query
def score_prompts_hook(spark, d):
    """A deterministic stand-in model behind the prompt hook."""
    probes = P.completion_feature(dataset(spark, d, "customer"), "c_name", None)

    def model(prompts, budgets, temperatures):
        return [str(len(p)) + ":" + p.split("\n")[5][:int(b)] for p, b in zip(prompts, budgets)]

    return decide.score_prompts(probes, "stand-in", model)


@query
def score_prompts_resumed(spark, d):
    """The same in two runs: in the first the model fails on every prompt of even length."""
    probes, path = P.completion_feature(dataset(spark, d, "customer"), "c_name", None), _folder(spark, "scored")

    def model(prompts, budgets, temperatures):
        return [str(len(p)) + ":" + p.split("\n")[5][:int(b)] for p, b in zip(prompts, budgets)]

    def weak(prompts, budgets, temperatures):
        if any(len(p) % 2 == 0 for p in prompts):
            raise RuntimeError("even")
        return model(prompts, budgets, temperatures)

    decide.score_prompts_resumable(probes, "stand-in", weak, path)
    failed = cut_lineage(decide.failed_prompts(probes, path))
    decide.score_prompts_resumable(probes, "stand-in", model, path)
    return decide.scored_responses(probes, path).join(
        failed.select("probe_id", "n_failed"), "probe_id", "left").fillna(0, ["n_failed"])


# ---------------------------------------------------------------- lexicon

@query
def lexicon_words(spark, d):
    return lexicon(spark, d)


def _lexicon_subjects(spark, d) -> DataFrame:
    parts = []
    for a in DATASETS:
        ds = dataset(spark, d, a)
        names = profile.feature_list(ds).select(
            "dataset", F.lit("(columns)").alias("feature"), F.col("feature").alias("value"),
            F.lit("string").alias("kind"))
        values = profile.feature_values(ds, ds.spec.value_features)
        parts += [names, values.select("dataset", "feature", "value", "kind")]
    docs = table(spark, d, "documents").filter(F.col("lang") != "en")
    words = docs.select(
        F.col("lang").alias("feature"), F.explode(F.split("text", r"\s+")).alias("value")
    ).distinct()
    parts.append(words.select(
        F.lit("documents").alias("dataset"), "feature", "value", F.lit("string").alias("kind")))
    return union(parts)


@query
def lexicon_coverage(spark, d):
    return corpus.lexicon_coverage(_lexicon_subjects(spark, d), lexicon(spark, d))


# ---------------------------------------------------------------- deciders

@query
def decide_words(spark, d):
    ds = dataset(spark, d, "customer")
    probes = P.values_from_examples(
        ds, lists_of(spark, d, "customer"), ds.spec.value_features, 3, "all")
    return show_verdicts(decided(probes))


@query
def decide_words_mixed(spark, d):
    """Word lists of each language, asked of every document: some lists are inside the lexicon,
    some are not."""
    return _word_scan(spark, d, "documents", F.col("doc_id").cast("string"))


@query
def decide_words_by_join(spark, d):
    """Every distinct part name and brand asked of every assistant turn and every document, by join;
    a feature without values expects nothing."""
    ds = dataset(spark, d, "part")
    words = tag_lexicon(profile.feature_values(ds, ["p_name", "p_brand"]), lexicon(spark, d))
    turns = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    planted = _turns_with_parts(spark, d, turns).unionByName(
        table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "text"))
    asked = planted.select(
        F.col("key").alias("probe_id"), F.lit("text").alias("model"), F.col("text").alias("answer"),
        F.lit(ds.name).alias("dataset"),
        F.explode(F.array(F.lit("p_name"), F.lit("p_brand"), F.lit("no such"))).alias("feature"))
    asked = asked.withColumn("probe_id", F.concat("probe_id", F.lit("|"), "feature"))
    return decide.decide_words_long(asked, words)


def _turns_with_parts(spark, d, turns) -> DataFrame:
    """Turns with the name of a drawn part at the end, blanks as underscores."""
    part = table(spark, d, "part")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    drawn = turns.select(key.alias("key"), "text").withColumn(
        "p_partkey", draw_position(sampling.row_count(part), "plant", F.col("key")))
    return drawn.join(part, "p_partkey").select(
        "key", F.concat("text", F.lit("\n"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")),
                        F.lit(", "), F.col("p_brand")).alias("text"))


def _names_with_answers(spark, d):
    """Customer names asked for block by block, with answers that name some drawn customers and a known one."""
    ds = only(dataset(spark, d, "customer"), "c_name")
    words = tag_lexicon(profile.feature_values(ds, ["c_name"]), lexicon(spark, d))
    probes = cut_lineage(P.values_from_examples(ds, cut_lineage(profile.value_lists(words, 100)), ["c_name"], 3, "all"))
    drawn = probes.filter("trial % 4 <> 3").select("probe_id", "trial", F.explode(F.sequence(F.lit(0), F.col("trial") % 4)).alias("i"))
    picked = drawn.withColumn(POS, F.when(F.col("i") == 0, F.col("trial") * 3).otherwise(
        draw_position(sampling.row_count(ds.df), "name", F.col("trial"), F.col("i"))))
    outputs = picked.join(ds.df.hint("merge"), POS).groupBy("probe_id").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ", ").alias("output"))
    return probes, outputs.withColumn("model", F.lit("m")), words


@query
def decide_values_long(spark, d):
    """Values of a feature that has too many to travel with a probe, through the standard run."""
    probes, outputs, words = _names_with_answers(spark, d)
    verdicts, _ = runs.run(probes, outputs, ["m"], words=words)
    return verdicts.select("probe_id", "trial", "passed", "n_found", "n_expected")


@query
def perturb_skewed(spark, d):
    """Altered rows of a table whose column holds one value on nine rows of ten."""
    ds = _skewed(spark, d)
    return perturb.replace_values(ds, 1, 7)


def _skewed(spark, d) -> Dataset:
    orders = only(dataset(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    rare = F.col("o_orderkey") % 10 == 0
    df = orders.df.select(POS, "o_orderkey", "o_custkey", F.when(rare, F.col("o_orderpriority")).otherwise(F.lit("none")).alias("o_orderstatus"))
    return replace(orders, df=df, columns=("o_orderkey", "o_custkey", "o_orderstatus"))


@query
def decide_completion(spark, d):
    return show_verdicts(decided(P.completion_full(dataset(spark, d, "part"), 4, "all")))


@query
def decide_completion_feature(spark, d):
    return show_verdicts(decided(P.completion_feature(dataset(spark, d, "orders"), "o_totalprice", None)))


@query
def decide_classification(spark, d):
    return show_verdicts(decided(union(
        P.classification(dataset(spark, d, a), None) for a in ("customer", "orders", "supplier"))))


@query
def decide_membership(spark, d):
    return show_verdicts(decided(P.membership(dataset(spark, d, "customer"), None)))


@query
def decide_recognition(spark, d):
    return show_verdicts(decided(union(
        P.recognition(dataset(spark, d, a), 5, "all") for a in ("customer", "supplier"))))


def _distributions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Distribution probes, and the values they are decided against."""
    values, parts = [], []
    for a in DATASETS:
        ds = dataset(spark, d, a)
        own = cut_lineage(profile.feature_values(ds, ds.spec.value_features))
        parts.append(P.distribution(ds, own, 40))
        values.append(own)
    return cut_lineage(union(parts)), union(values)


@query
def probe_distribution(spark, d):
    return show_probes(_distributions(spark, d)[0])


@query
def decide_distribution(spark, d):
    """Distributions as stand-in models give them: right in whole percents, all alike, one value only, or none."""
    probes, values = _distributions(spark, d)
    kind = F.pmod(draw_int("shares", F.col("probe_id"), F.col("model")), F.lit(4))
    asked = probes.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS]))).withColumn("said", kind)
    per = F.when(F.col("said") == 0, F.round("pct")).when(F.col("said") == 1, 4).otherwise(
        F.when((F.col("said") == 2) & (F.col("first_pos") == F.col("least")), 100).otherwise(0)).cast("int")
    least = values.groupBy("dataset", "feature").agg(F.min("first_pos").alias("least"))
    each = asked.join(values.join(least, ["dataset", "feature"]), ["dataset", "feature"]).withColumn("per", per)
    as_list = F.concat(F.lit("["), F.array_join(F.flatten(F.collect_list(F.array_repeat("value", F.col("per")))), ", "), F.lit("]"))
    as_shares = F.array_join(F.collect_list(F.when(F.col("per") > 0, F.concat(F.upper("value"), F.lit(": "), F.col("per"), F.lit("%")))), ", ")
    said = each.groupBy("probe_id", "model", "test", "prompt").agg(as_list.alias("listed"), as_shares.alias("shares"))
    answer = F.when(F.col("test") == "distribution_list", F.col("listed")).otherwise(F.col("shares"))
    outputs = said.select("probe_id", "model", F.when(
        F.col("model").isin(*ECHOING), F.concat("prompt", answer)).otherwise(answer).alias("output"))
    joined = decide.join_responses(probes, cut_lineage(outputs), MODELS, ECHOING)
    out = distribution.decide_distribution(joined, values)
    return out.withColumn("distance", F.round("distance", 9)).withColumn("gap", F.round("gap", 9))


# ---------------------------------------------------------------- scores

def _classified(spark, d) -> DataFrame:
    return decided(union(
        P.classification(dataset(spark, d, a), None) for a in ("customer", "orders")))


def _dealt(spark, d, aliases, probes_per_row: int) -> tuple[list[Dataset], int]:
    """Datasets whose probes are dealt out by their ids, and into how many parts."""
    datasets = [dataset(spark, d, a) for a in aliases]
    n = decide.partitions_for(spark, probes_per_row * sum(ds.df.count() for ds in datasets))
    return [replace(ds, probe_partitions=n) for ds in datasets], n


def _completed(spark, d) -> DataFrame:
    parts = []
    datasets, n = _dealt(spark, d, DATASETS, 2)
    for ds in datasets:
        parts += [
            P.completion_incomplete(ds, _every_row_a_trial(ds)),
            P.completion_feature(ds, ds.spec.completion_feature, None),
            P.recognition(ds, 5, "all"),
        ]
    return decided(union(parts), n)


@query
def answer_histogram(spark, d):
    return score.answer_histogram(_classified(spark, d))


@query
def accuracy(spark, d):
    return score.accuracy(_classified(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query
def yes_no_tally(spark, d):
    return score.membership_tally(decided(P.membership(dataset(spark, d, "customer"), None)))


@query
def any_pass(spark, d):
    return score.any_pass(_completed(spark, d))


@query
def pass_rate_threshold(spark, d):
    rates = score.pass_rate(
        _completed(spark, d).filter(F.col("test") == "incomplete_completion_random"), 0.3)
    return rates.withColumn("rate", F.round("rate", 6))


@query
def scorecard_long(spark, d):
    return score.scorecard(_completed(spark, d))


@query
def scorecard_rollup(spark, d):
    """Counts and rates by model, dataset and test, with all subtotals."""
    out = score.scorecard_rollup(_completed(spark, d), ("model", "dataset", "test"))
    return out.withColumn("rate", F.round("rate", 9))


@query
def scorecard_wide(spark, d):
    wide = score.scorecard_wide(score.scorecard(_completed(spark, d)), DISPLAY)
    return wide


def _rates(spark, d) -> DataFrame:
    """Pass rate of every (model, test, dataset) as a scorecard value; written once, because the
    reports read it several times."""
    return cut_lineage(score.pass_rate(_completed(spark, d)).select(
        "model", "test", "dataset", F.round("rate", 6).alias("value")))


@query
def scorecard_unpivot(spark, d):
    wide = score.scorecard_wide(score.scorecard(_completed(spark, d)), DISPLAY)
    return reshape.unpivot_scorecard(wide, ("model", "test_name"))


@query
def scorecard_diff(spark, d):
    """Tests one model passes at least at its mean rate, against the other's."""
    rates = _rates(spark, d)
    passes = rates.withColumn("value", (F.col("value") >= 0.3).cast("double"))
    old, new = (passes.filter(F.col("model") == m) for m in MODELS)
    return reshape.scorecard_diff(old, new)


@query
def scorecard_merge(spark, d):
    wide = score.scorecard_wide(score.scorecard(_completed(spark, d)), DISPLAY)
    alpha = cut_lineage(wide.filter("model = 'alpha'"))
    return reshape.merge_scorecards(
        alpha.select("test_name", "Customer"), alpha.select("test_name", "Part", "Orders"))


@query
def scorecard_side_by_side(spark, d):
    grid = reshape.side_by_side(_rates(spark, d), MODELS, list(DISPLAY))
    return grid.select("test", *[
        F.col(f"`{m}:{n}`").alias(f"{m}_{DISPLAY[n]}") for m in MODELS for n in DISPLAY])


@query
def scorecard_best(spark, d):
    return reshape.flag_best(_rates(spark, d), "test", "value")


@query
def scorecard_rank(spark, d):
    means = _rates(spark, d).groupBy("model").agg(F.round(F.avg("value"), 4).alias("score"))
    return reshape.rank_models(means)


@query
def category_grid(spark, d):
    return reports.category_grid(_rates(spark, d), list(DISPLAY)).withColumnsRenamed(
        DISPLAY).withColumn("ord", F.col("ord").cast("bigint"))


@query
def total_passes(spark, d):
    return reports.total_passes(score.scorecard(_completed(spark, d)), ["customer orders"])


@query
def contamination_rate(spark, d):
    return reports.contamination_rate(score.scorecard(_completed(spark, d)), ["customer orders"])


@query
def serialization_grid(spark, d):
    """Scorecard per serialization variant."""
    ds = dataset(spark, d, "customer")
    probes = union([
        P.recognition(ds, 5, "all", variants=VARIANTS),
        P.completion_feature(ds, "c_name", None, variants=VARIANTS),
    ])
    card = score.scorecard(decided(probes), ("serialization",))
    return card.select("model", "test", "dataset", "serialization", "n_trials", "n_passed", "value")


def _accuracy_long(spark, d) -> DataFrame:
    """Accuracy (0..1) per model, category and dataset, in the shape of the accuracy table."""
    parts = []
    datasets, n = _dealt(spark, d, ("customer", "orders"), 2)
    for ds in datasets:
        parts += [P.classification(ds, None), P.classification(ds, None, shots=True)]
    acc = score.accuracy(decided(union(parts), n))
    category = F.when(F.col("test") == "classification_0shot", F.lit("0-shot")).otherwise(F.lit("1-shot"))
    value = F.round(F.col("accuracy") / 100, 4)
    return acc.select("model", category.alias("category"), "dataset", value.alias("score"),
                      F.concat(value.cast("string"), F.lit(" (0-0)")).alias("cell"))


@query
def accuracy_table(spark, d):
    names = ["customer accounts", "customer orders"]
    out = reports.accuracy_table(_accuracy_long(spark, d), names, show_mean=True)
    return out.withColumnsRenamed({"customer accounts": "Customer", "customer orders": "Orders"})


@query
def mean_scores(spark, d):
    means = reports.mean_scores(_accuracy_long(spark, d))
    return means.withColumn("score", F.round("score", 6))


@query
def ranking(spark, d):
    """Models by contamination rate with membership and accuracy means."""
    rates = reports.contamination_rate(_rates(spark, d))
    tally = score.membership_tally(decided(P.membership(dataset(spark, d, "customer"), None)))
    members_ = reports.membership_means(tally.select(
        "model", (F.col("score") * 100.0 / F.col("n_tests")).alias("value")))
    out = reports.ranking(rates, members_, reports.mean_scores(_accuracy_long(spark, d)))
    kept = [c for c in out.columns if c.endswith("_score")]
    return out.withColumns({c: F.round(f"`{c}`", 6) for c in kept}).withColumnsRenamed(
        {c: c.replace("-", "_") for c in out.columns})


@query
def multi_model_grid(spark, d):
    grid = reports.multi_model_grid(_rates(spark, d), MODELS, list(DISPLAY))
    return grid.select("test", F.col("ord").cast("bigint").alias("ord"), *[
        F.col(f"`{m}:{n}`").alias(f"{m}_{DISPLAY[n]}") for m in MODELS for n in DISPLAY])


@query
def difference_grid(spark, d):
    passes = _rates(spark, d).withColumn("value", (F.col("value") >= 0.3).cast("double"))
    return reports.difference_grid(passes, *MODELS, list(DISPLAY)).withColumnsRenamed(DISPLAY)


@query
def select_tests(spark, d):
    """The memorization tests in report order."""
    return reports.select_tests(_rates(spark, d), "memorization").withColumn("ord", F.col("ord").cast("bigint"))


def _variant_card(spark, d) -> DataFrame:
    """Scorecard of all tests that show rows, in every serialization variant."""
    ds = dataset(spark, d, "customer")
    probes = runs.serialization_probes(ds, cut_lineage(lexicon(spark, d)))
    return cut_lineage(score.scorecard(decided(probes), ("serialization",)))


@query
def serialization_run(spark, d):
    """All five tests in all variants."""
    card = _variant_card(spark, d)
    return card.groupBy("test", "dataset").agg(
        F.count_distinct("serialization").alias("variants"), F.count_distinct("model").alias("models"),
        F.sum("n_trials").alias("n_trials"))


@query
def serialization_report(spark, d):
    """The figures of one model and one variant, as the report prints them, for the tests that find or complete single values."""
    card = _variant_card(spark, d)
    own = reshape.one_serialization(card, 1).filter("model = 'alpha'")
    grid = reports.serialization_grid(card, "alpha", 1, list(DISPLAY))
    shown = grid.select("test", F.col("`customer accounts`").alias("shown"))
    return own.filter(F.col("test").isin("recognition_ex", "feature_completion")).join(shown, "test").select(
        "test", "n_trials", "n_passed", "value", "shown")


@query
def scorecard_sink_variants(spark, d):
    """Scorecards written one variant after the other to the same place, a folder for each model and variant."""
    card, path = cut_lineage(serialization_grid(spark, d)), _folder(spark, "variants")
    for i in range(len(SERIALIZATIONS)):
        for _ in range(2 if i == 1 else 1):  # a variant that is written again replaces its own folders
            sinks.write_scorecard(card.filter(F.col("serialization") == i), path, ("model", "serialization"))
    return spark.read.parquet(path).withColumn("serialization", F.col("serialization").cast("bigint"))


@query
def labelled_files(spark, d):
    """Scorecards as files whose first column has no name, read by their labels."""
    wide = cut_lineage(score.scorecard_wide(score.scorecard(_completed(spark, d)), DISPLAY))
    parts = []
    for model in MODELS:
        path = _folder(spark, "labelled")
        sinks.write_scorecard_csv(wide.filter(F.col("model") == model).drop("model").withColumnRenamed("test_name", ""), path)
        parts.append(read_labelled(spark, path, "test_name").withColumn("model", F.lit(model)))
    return union(parts).select("model", "test_name", *[F.col(c).cast("double").alias(c) for c in DISPLAY.values()])


# ---------------------------------------------------------------- files

def _folder(spark, name: str) -> str:
    """A folder for files in the warehouse that goes when the driver ends."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}_{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    return path


def _csv_dataset(spark, d, alias: str, options: dict) -> Dataset:
    """The table through CSV files, with their columns in the opposite order."""
    source = table(spark, d, alias)
    root = _folder(spark, "csv")
    source.select(*reversed(source.columns)).write.options(**options).csv(f"{root}/{alias}")
    columns = tuple((f.name, f.dataType.simpleString()) for f in source.schema)
    spec = DatasetSpec(f"{alias} in files", alias, alias, alias, columns, options=options)
    return load_dataset(spark, alias, root, (spec,), widen_integers=True, positions=False)


@query
def csv_scan(spark, d):
    ds = _csv_dataset(spark, d, "customer", {"header": "true"})
    return ds.df.select(*ds.columns)


def _mixed_cells(spark, d) -> DataFrame:
    """Orders through CSV files in two folders, as cells: missing tokens, numbers among texts and texts among numbers."""
    key = F.col("o_orderkey")
    cells = table(spark, d, "orders").select(
        "o_orderkey", F.when(key % 97 == 3, F.concat("o_custkey", F.lit("x"))).otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(key % 10 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(key % 5 == 0, "").otherwise((key % 7).cast("string")).alias("gaps"),
        F.when(key % 2 == 0, "True").otherwise("False").alias("even"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.lit("n/a").alias("nothing"), "o_orderstatus",
        (key % 3).alias("part"))
    root = _folder(spark, "mixed")
    cells.write.partitionBy("part").option("header", True).csv(root)
    return inference.read_cells(spark, root, basePath=root).drop("part")


@query
def csv_inferred(spark, d):
    """Types of columns from the profiles of single files, merged."""
    cells = _mixed_cells(spark, d)
    by_file = cut_lineage(inference.profile_cells(cells, by_file=True))
    return inference.with_types(inference.merge_profiles(by_file), dates=True)


@query
def csv_misfits(spark, d):
    """Cells that do not fit the types that most cells have, and what is left of the columns."""
    cells = _mixed_cells(spark, d)
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "day": "timestamp", "o_orderstatus": "boolean"}
    odd = inference.misfits(cells, types)
    kept = inference.typed(cells, types).agg(*[F.count(c).alias(c) for c in types]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.lit(None).cast("string").alias("cell"), F.col(c).alias("n"))
        for c, t in types.items()])))
    return odd.unionByName(kept)


@query
def csv_semicolon(spark, d):
    ds = _csv_dataset(spark, d, "part", {"header": "true", "sep": ";"})
    return ds.df.select(*ds.columns)


@query
def csv_positions_many_files(spark, d):
    """Row positions over three folders of very unequal size, in the order of their names."""
    path = _folder(spark, "parts")
    key = F.col("o_orderkey")
    part = F.when(key < 10, 0).when(key < 40, 1).otherwise(2)
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus", part.alias("part")).repartition("part").sortWithinPartitions(
        "part", "o_orderkey").write.partitionBy("part").option("header", True).csv(path)
    read = spark.read.option("header", True).schema("o_orderkey bigint, o_orderstatus string, part int").csv(path)
    return with_positions(read).select(POS, "o_orderkey", "o_orderstatus")


@query
def scorecard_sink_two_models(spark, d):
    """One model's scorecard written after the other's to the same place."""
    card, path = cut_lineage(score.scorecard(_completed(spark, d))), _folder(spark, "cards")
    for model in MODELS:
        sinks.write_scorecard(card.filter(F.col("model") == model), path)
    return spark.read.parquet(path)


@query
def scorecard_files_roundtrip(spark, d):
    """Wide scorecards as one CSV file for each model, read back by their own headers."""
    wide = cut_lineage(score.scorecard_wide(score.scorecard(_completed(spark, d)), DISPLAY))
    files = {}
    for model in MODELS:
        files[model] = _folder(spark, "wide")
        sinks.write_scorecard_csv(wide.filter(F.col("model") == model).drop("model"), files[model])
    return read_scorecards(spark, files)


@query
def verdict_log(spark, d):
    path = _folder(spark, "verdicts")
    sinks.write_verdicts(_completed(spark, d), path)
    return spark.read.parquet(path).groupBy("model", "test", "dataset").agg(
        F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.sum("n_found").alias("n_found"))


# ---------------------------------------------------------------- streams

@query
def scorecard_stream(spark, d):
    """Responses that arrive in several files, some of them again and some after a later one in text order: the running
    scorecard of all of them."""
    (ds,), n = _dealt(spark, d, ("customer",), 2)
    # in buckets of their ids, so that no batch shuffles them
    probes = cut_lineage(P.completion_feature(ds, "c_name", None).unionByName(P.recognition(ds, 5, "all")), ("probe_id", n), compression="zstd")
    path, arrived = _folder(spark, "running"), _folder(spark, "arrived")
    first = respond(probes)
    turn = F.pmod(draw_int("turn", F.col("probe_id"), F.col("model")), F.lit(3))
    early = first.filter(turn == 0).withColumn("output", F.concat("output", F.lit("~ and more")))  # after it in text order
    for i, part in enumerate((first.filter(turn > 0).unionByName(early), first, early.unionByName(first.filter(turn == 1)))):
        part.repartition(2, "probe_id").write.mode("append").parquet(f"{arrived}/{i}")
    stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", True).option(
        "maxFilesPerTrigger", 3).parquet(arrived)
    running = streaming.score_stream(stream, probes.hint("merge"), path, _folder(spark, "progress"), ECHOING)
    running.awaitTermination()
    return streaming.running_scorecard(spark, path)


# ---------------------------------------------------------------- corpus scans

def frequent_words(spark, d, k: int = 8) -> DataFrame:
    """The k most used words of each language: expected lists that do occur in the texts."""
    tokens = table(spark, d, "documents").select(
        "lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("value")
    ).filter("value <> ''")
    counted = tokens.groupBy("lang", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "value")
    return counted.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).select(
        F.col("lang").alias("list_name"), "value", F.lit("string").alias("kind"))


def _word_lists(spark, d) -> DataFrame:
    tagged = tag_lexicon(frequent_words(spark, d), lexicon(spark, d))
    return tagged.groupBy("list_name").agg(
        F.array_sort(F.collect_list(F.struct("value", "kind", "in_lexicon"))).alias("words"))


def _word_scan(spark, d, name, key) -> DataFrame:
    texts = table(spark, d, name).select(key.alias("key"), "text")
    out = corpus.scan_words(texts, _word_lists(spark, d), "key")
    return out.withColumn("matches", decide.matches_text(F.col("matches")))


def _turn_key() -> Column:
    return F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))


@query
def corpus_word_scan(spark, d):
    return _word_scan(spark, d, "conversations", _turn_key())


@query
def corpus_word_scan_long(spark, d):
    """Every word of the benchmark, and every part name, type and brand, in every document; lists with a
    hit."""
    return corpus.scan_words_long(table(spark, d, "documents"), _long_lists(spark, d), "doc_id")


def _long_lists(spark, d) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("value"))
    words = words.filter("value <> ''").distinct().select(
        F.lit("benchmark").alias("list_name"), "value", F.lit("string").alias("kind"))
    parts = profile.feature_values(dataset(spark, d, "part"), ["p_name", "p_type", "p_brand"])
    parts = parts.select(F.col("feature").alias("list_name"), "value", "kind")
    return tag_lexicon(words.unionByName(parts), lexicon(spark, d))


@query
def corpus_word_scan_ids(spark, d):
    """The same on texts coded by their vocabulary."""
    coded = dictionary.build_dictionary(table(spark, d, "documents"), "doc_id")
    return dictionary.scan_words(coded, _long_lists(spark, d))


@query
def corpus_passage_scan(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return corpus.scan_passages(table(spark, d, "documents"), items, "doc_id")


@query
def corpus_passage_scan_pages(spark, d):
    """Sentences of the benchmark in the raw pages: short and long passages mixed."""
    return corpus.scan_passages(
        table(spark, d, "pages").select("page_id", F.col("html").alias("text")),
        _sentences(spark, d), "page_id")


def _sentences(spark, d) -> DataFrame:
    pieces = table(spark, d, "benchmark").select(
        F.explode(F.split("text", r"[.,]\s*")).alias("passage")).filter("passage <> ''").distinct()
    return pieces.select(F.md5("passage").alias("passage_id"), "passage")


def _passage_index(spark, d, batches: int = 2) -> PassageIndex:
    """The documents in an index, added in several batches."""
    index = PassageIndex(spark, _folder(spark, "passages"), ("doc_id", "bigint"), buckets=cores(spark))
    docs = table(spark, d, "documents")
    for i in range(batches):
        index.append(docs.filter(F.col("doc_id") % batches == i), f"part-{i}")
    return index


@query
def corpus_passage_index(spark, d):
    """Items of the benchmark and their sentences, long and short, in an index of documents added in two batches."""
    items = table(spark, d, "benchmark").select(F.col("text").alias("passage"))
    passages = items.unionByName(_sentences(spark, d).select("passage")).distinct()
    return _passage_index(spark, d).find(
        passages.select(F.md5("passage").alias("passage_id"), "passage"), corpus.scan_passages)


@query
def corpus_row_text_index(spark, d):
    """Customer rows planted into the conversation turns, looked for in an index of the turns."""
    planted, row_texts = _planted_rows(spark, d)
    index = PassageIndex(spark, _folder(spark, "turns"), ("key", "string"), window=4, buckets=cores(spark))
    index.append(planted, "turns")
    rows_ = row_texts.groupBy("row_text").agg(F.count("*").alias("n_rows")).withColumn("passage_id", F.md5("row_text"))
    hits = index.find(rows_.select("passage_id", F.col("row_text").alias("passage")), corpus.scan_passages)
    return hits.join(rows_, "passage_id").select("key", "row_text", "n_rows")


@query
def corpus_row_text_scan(spark, d):
    """Customer rows planted into the conversation turns, looked for among all customer rows."""
    planted, row_texts = _planted_rows(spark, d)
    return corpus.scan_row_texts(planted, row_texts, "key")


def _planted_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """(key, text) of turns with the text of a drawn customer row at the end, and (row_text) of all customers."""
    ds = dataset(spark, d, "customer")
    text = row_text(ds.df, ds.columns, ROW_DEFAULT)
    turns = table(spark, d, "conversations").select(_turn_key().alias("key"), "text")
    drawn = turns.withColumn(POS, draw_position(sampling.row_count(ds.df), "plant", F.col("key")))
    planted = drawn.join(ds.df.select(POS, text.alias("row_text")), POS).select(
        "key", F.concat("text", F.lit("\n"), "row_text", F.lit(". End")).alias("text"))
    return planted, ds.df.select(text.alias("row_text"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
