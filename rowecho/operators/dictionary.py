"""A corpus by its vocabulary: texts as sorted arrays of word numbers, word lists matched on the words.

Runs of characters between white space are numbered once. Whatever list of words is asked for then
meets the different runs and not the texts, and a text is decided by its numbers. Texts are read again only
for words that hold white space themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowecho.operators import corpus
from rowecho.sources.lineage import cut_lineage
from rowecho.sources.positions import POS, with_positions


@dataclass(frozen=True)
class Dictionary:
    """``runs`` (number, run) and ``coded`` (key, numbers): the different runs of lower-case characters, and those of each text in
    ascending order. Both are written tables. ``texts`` (key, text) is what was coded."""

    texts: DataFrame
    runs: DataFrame
    coded: DataFrame
    key: str


def build_dictionary(texts: DataFrame, key: str, text: str = "text") -> Dictionary:
    """Read the texts once and code them. Numbers are dense from 0; a null text has no runs."""
    split = F.array_distinct(F.split(F.lower(F.col(text)), r"\s+"))
    each = cut_lineage(texts.select(key, F.explode(F.filter(split, lambda r: r != "")).alias("run")), compression="zstd")
    runs = cut_lineage(with_positions(cut_lineage(each.select("run").distinct())).select(F.col(POS).alias("number"), "run"))
    coded = cut_lineage(each.join(corpus.side(runs, F.octet_length("run")), "run").groupBy(key).agg(F.array_sort(F.collect_list("number")).alias("numbers")), compression="zstd")
    return Dictionary(texts.select(F.col(key), F.col(text).alias("text")), runs, coded, key)


def _rarest(of_word: DataFrame, of_run: DataFrame) -> DataFrame:
    """(word, gram): of the letters of each word those that fewest runs hold; a word with letters that no run holds has no row."""
    held = of_run.groupBy("gram").agg(F.count("*").alias("_held"))
    rarity = F.coalesce("_held", F.lit(0))
    return of_word.join(held, "gram", "left").groupBy("word").agg(
        F.min_by("gram", F.struct(rarity, "gram")).alias("gram"), F.min(rarity).alias("_held")).filter("_held > 0").drop("_held")


def match_runs(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(number, word): every word (``word``, distinct, not empty) inside every run (number, run).

    They meet on the letters of the word that fewest runs hold: what many runs have in common is a
    key only for words that have nothing else. Pairs that meet are verified.
    """
    short = words.withColumn("n", F.least(F.length("word"), F.lit(corpus.LETTERS)))
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # at most LETTERS numbers
    if not lengths:
        return runs.select("number", F.lit("").alias("word")).limit(0)
    of_word = reduce(DataFrame.unionByName, [
        corpus._letter_grams(short.filter(F.col("n") == n).select("word"), "word", n) for n in lengths])
    of_run = reduce(DataFrame.unionByName, [corpus._letter_grams(runs, "run", n) for n in lengths])
    # Spark takes the letters of runs for as few as runs, and would deal out all of them to meet a few words
    anchors = cut_lineage(_rarest(of_word, of_run))
    anchors = corpus.side(anchors, F.octet_length("word") + F.octet_length("gram"))
    return of_run.join(anchors, "gram").filter(F.contains("run", F.col("word"))).select("number", "word")


def _matched(dictionary: Dictionary, entries: DataFrame) -> DataFrame:
    """(number, entry) for words without white space. Words with a dot look at runs with ``_`` read as one."""
    parts = []
    for stack, run in ((0, F.col("run")), (1, F.replace("run", F.lit("_"), F.lit(".")))):
        mine = entries.filter(F.col("stack") == stack)
        if not mine.isEmpty():
            met = match_runs(dictionary.runs.select("number", run.alias("run")), mine.select(F.col("passage").alias("word")).distinct())
            parts.append(met.join(mine.select(F.col("passage").alias("word"), "entry"), "word").select("number", "entry"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _phrases(dictionary: Dictionary, entries: DataFrame) -> DataFrame | None:
    """(key, entry) for words with white space: their longest part is matched on the runs, its numbers lead to few
    texts, and these are searched."""
    form: dict[int, Column] = dict(enumerate(corpus.answers.haystacks(F.col("text"))[i] for i in range(3)))
    parts = F.split("passage", r"\s+")
    longest = F.array_max(F.transform(parts, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = cut_lineage(entries.select("stack", "passage", longest.alias("word")).distinct())
    if asked.isEmpty():
        return None
    found = []
    for stack in sorted(r["stack"] for r in asked.select("stack").distinct().collect()):  # at most three numbers
        mine = asked.filter(F.col("stack") == stack)
        blank = F.replace("run", F.lit("_"), F.lit({0: "_", 1: ".", 2: " "}[stack]))
        met = match_runs(dictionary.runs.select("number", blank.alias("run")), mine.filter("word <> ''").select("word").distinct())
        by_number = cut_lineage(met.join(mine.select("word", "passage"), "word").select("number", "passage"))
        pairs = holders(dictionary, by_number, "passage")
        searched = dictionary.texts.select(dictionary.key, form[stack].alias("_text"))
        hit = searched.join(cut_lineage(pairs), dictionary.key).filter(F.contains("_text", F.col("passage")))
        bare = mine.filter("word = ''").select("passage")  # white space alone
        if not bare.isEmpty():
            hit = hit.select(dictionary.key, "passage").unionByName(corpus.scan_passages(
                searched, bare.select(F.col("passage").alias("passage_id"), "passage"), dictionary.key, "_text").select(
                dictionary.key, F.col("passage_id").alias("passage")))
        found.append(hit.select(dictionary.key, "passage").join(
            entries.filter(F.col("stack") == stack).select("passage", "entry"), "passage").select(dictionary.key, "entry"))
    return reduce(DataFrame.unionByName, found)


def holders(dictionary: Dictionary, matched: DataFrame, value: str) -> DataFrame:
    """(key, value): for (number, value), the texts that hold the number, each value once. ``matched`` is a written table."""
    numbers = matched.select("number").distinct()
    flat = dictionary.coded.select(dictionary.key, F.explode("numbers").alias("number")).join(numbers, "number", "left_semi")
    return flat.join(matched, "number").select(dictionary.key, value).distinct()


def scan_words(dictionary: Dictionary, words: DataFrame) -> DataFrame:
    """``corpus.scan_words_long`` on coded texts: (key, list_name, n_found, n_expected, passed), for lists of which
    a text holds any word. ``words`` is (list_name, value, kind, in_lexicon), one row per word."""
    words = cut_lineage(words)
    lists = corpus.numbered_lists(words)
    entries = corpus.coded_entries(corpus.considered(words, lists), lists).filter("passage <> ''")
    spaced = F.col("passage").rlike(r"\s")
    key, hits = dictionary.key, []
    single = _matched(dictionary, entries.filter(~spaced))
    if single is not None:
        # one row per number with all its words, so a text's numbers meet each once
        by_number = cut_lineage(single.groupBy("number").agg(F.collect_set("entry").alias("entries")))
        flat = dictionary.coded.select(key, F.explode("numbers").alias("number")).join(
            corpus.side(by_number, F.size("entries") * corpus.CODE_BYTES), "number")
        hits.append(flat.select(key, F.explode("entries").alias("entry")))
    phrases = _phrases(dictionary, entries.filter(spaced))
    if phrases is not None:
        hits.append(phrases)
    if not hits:
        hits.append(dictionary.texts.limit(0).select(key, F.lit(None).cast(entries.schema["entry"].dataType).alias("entry")))
    sets = reduce(DataFrame.unionByName, hits).groupBy(key).agg(F.collect_set("entry").alias("entries"))
    return corpus.list_verdicts(sets, lists, key)
