"""Text corpora against expected words, passages and row texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowecho.functions import answers
from rowecho.sources.lexicon import outside_lexicon
from rowecho.sources.lineage import cut_lineage
from rowecho.sources.positions import POS, with_positions

GRAM = 4  # words per anchor
LETTERS = 3  # characters per anchor of a short passage
WORD_LETTERS = (LETTERS, 6, 12)  # characters per anchor of a word: the most that it has
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64  # of a row in a hash table beside its text
ENTRY_BYTES = 40  # of an entry of a set
CODE_BYTES = 8  # of an entry's code
WORD_BITS = 32  # of a code: the number of the entry, below a bit for words outside the lexicon and the number of the list


def scan_words(texts: DataFrame, lists: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Which expected words occur in each text, and the word rule's verdict.

    ``lists`` is (list_name, words), a bounded number of bounded lists (``value_lists`` leaves
    longer ones out; they go through ``scan_words_long``). They reach the texts as one scalar, so
    the corpus is read once and never shuffled.
    """
    gathered = lists.agg(F.array_sort(F.collect_list(F.struct("list_name", "words")))).scalar()
    stacked = texts.select(F.col(key), answers.haystacks(F.col(text)).alias("_stacks"))
    each = stacked.select(key, "_stacks", F.inline(gathered)).withColumn(
        "_considered", answers.words_considered(F.col("words"))
    ).withColumn("matches", answers.word_matches(F.col("_considered"), F.col("_stacks")))
    n_found = F.size(F.filter("matches", lambda m: m["found"])) + F.size("_considered") - F.size("matches")
    any_outside = F.exists("words", lambda w: (w["kind"] == "string") & ~w["in_lexicon"])
    return each.withColumn("n_found", n_found.cast("bigint")).select(
        key, "list_name", "n_found", F.size("words").cast("bigint").alias("n_expected"),
        F.when(any_outside, F.col("n_found") > 0)
        .otherwise(F.col("n_found") == F.size("words")).alias("passed"),
        "matches",
    )


def _grams(df: DataFrame, key: str, tokens: str, lengths: list[int]) -> DataFrame:
    """(key, gram): hash of every n consecutive words, for each n of ``lengths``. Only the words are unnested, once for all lengths, never the
    text, and the hashes are taken after that, inside generated code."""
    shifted = [
        F.slice(F.col(tokens), F.lit(i + 1), F.greatest(F.size(tokens) - F.lit(max(i, min(lengths) - 1)), F.lit(0)))
        for i in range(max(lengths))
    ]
    zipped = F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])
    out = df.select(key, F.explode(zipped).alias("g"))
    hashes = [F.when(F.col(f"g.w{n - 1}").isNotNull(), F.xxhash64(*[F.col(f"g.w{i}") for i in range(n)])) for n in lengths]
    if len(hashes) == 1:  # every place has all its words
        return out.select(key, hashes[0].alias("gram"))
    return out.select(key, F.explode(F.array(*hashes)).alias("gram")).filter("gram IS NOT NULL")


def _tokens(text: Column) -> Column:
    return F.split(text, r"\s+")


def _inner_tokens(text: Column) -> Column:
    """Words of a passage that must be whole words wherever the passage occurs: all but the
    first and the last, which may touch other characters."""
    tokens = _tokens(text)
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))


def _small(df: DataFrame, name: str, limit: int) -> bool:
    """At most ``limit`` bytes of the column and what a row of a hash table takes beside it; no more
    rows are read than fit."""
    size = F.sum(F.octet_length(F.col(name).cast("string")).cast("bigint") + ROW_BYTES)
    return (df.limit(limit // ROW_BYTES + 1).agg(size).first()[0] or 0) <= limit


def side(table: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table as the side of a join that meets texts: sent to all tasks while its rows, of ``size`` bytes beside a hash table's,
    take at most ``limit`` in memory, and never beyond. Its files tell nothing of that: they are many times smaller."""
    taken = table.agg(F.sum((size + ROW_BYTES).cast("bigint"))).first()[0] or 0
    return F.broadcast(table) if taken <= limit else table.hint("merge")


def entries_size(name: str, each: int = ENTRY_BYTES) -> Column:
    return F.octet_length(name) + F.size("entries") * each


def _candidates(texts: DataFrame, passages: DataFrame, key: str, text: str, n: int | list[int],
                broadcast_bytes: int) -> DataFrame:
    """(key, passage_id): pairs that share the passage's anchor, for passages with n inner words. Of several
    numbers n a passage has its own as ``_n``; the texts are read once for all of them.

    The anchor is the gram of the passage that the fewest texts hold, so wording that many texts
    share, such as column names, is a join key only where a passage has nothing else. A passage
    with a gram that no text holds is done with.
    """
    lengths = [n] if isinstance(n, int) else n
    asked = passages if "_n" in passages.columns else passages.withColumn("_n", F.lit(n))
    of_passage = reduce(DataFrame.unionByName, [_grams(
        asked.filter(F.col("_n") == i).select("passage_id", _inner_tokens(F.col("passage")).alias("t")), "passage_id", "t", [i])
        for i in lengths]).distinct()
    wanted = of_passage.select("gram").distinct()
    if _small(wanted, "gram", broadcast_bytes):
        wanted = F.broadcast(wanted)
    grams = _grams(texts.select(key, _tokens(F.col(text)).alias("t")), key, "t", lengths)
    held = cut_lineage(grams.join(wanted, "gram", "left_semi").distinct())
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarity = F.coalesce("n", F.lit(0))
    anchors = of_passage.join(counts, "gram", "left").groupBy("passage_id").agg(
        F.min_by("gram", F.struct(rarity, "gram")).alias("gram"), F.min(rarity).alias("n")).filter("n > 0")
    return held.join(anchors, "gram").select(key, "passage_id").distinct()


def _verified(texts: DataFrame, met: DataFrame, passages: DataFrame, key: str, text: str,
              broadcast_bytes: int) -> DataFrame:
    """The pairs of ``met`` (key, passage_id) whose text does contain the passage.

    The pairs are written first, without the passages. Their size is then known, so Spark
    broadcasts them when they are small; when they are not, only texts that have a pair are shuffled.
    """
    met = cut_lineage(met)
    searched = texts.select(key, text)
    keys = met.select(key).distinct()
    if _small(keys, key, broadcast_bytes):
        searched = searched.join(F.broadcast(keys), key, "left_semi")
    return searched.join(met, key).join(passages, "passage_id").filter(
        F.contains(F.col(text), F.col("passage"))).select(key, "passage_id")


def _spans(text: Column) -> Column:
    """The text cut into runs of characters and runs of white space."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\s+|\S+)"), F.lit(1)))


def _letter_grams(df: DataFrame, word: str, n: int) -> DataFrame:
    """Every run of n characters of a word, as ``gram`` beside the frame's columns."""
    runs = F.regexp_extract_all(F.col(word), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return df.withColumn("gram", F.explode(F.array_distinct(runs)))


def _short_hits(texts: DataFrame, passages: DataFrame, key: str, text: str, broadcast_bytes: int) -> DataFrame:
    """(key, passage_id) for passages of one or two words, which may begin and end inside a word.

    Their longest word is looked for in the vocabulary, the distinct words of all texts, which
    is far smaller than the texts: vocabulary and passages meet on a run of characters and are
    verified, and the words found lead back to the texts.
    """
    words = _tokens(F.col("passage"))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = passages.withColumn("piece", F.when(longest != "", longest).otherwise(F.col("passage")))
    short = short.withColumn("n", F.least(F.length("piece"), F.lit(LETTERS)))
    spans = texts.select(key, F.explode(_spans(F.col(text))).alias("span"))
    vocabulary = spans.select("span").distinct()
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # at most LETTERS numbers
    grams = reduce(DataFrame.unionByName, [_letter_grams(short.filter(F.col("n") == n), "piece", n) for n in lengths])
    shared = grams.groupBy("gram").agg(F.count("*").alias("shared"))
    anchors = grams.join(shared, "gram").groupBy("passage_id", "passage", "piece").agg(
        F.min_by("gram", F.struct("shared", "gram")).alias("gram"))
    vocabulary_grams = reduce(DataFrame.unionByName, [_letter_grams(vocabulary, "span", n) for n in lengths])
    found = cut_lineage(
        vocabulary_grams.join(anchors, "gram").filter(F.contains("span", "piece"))
        .select("span", "passage_id", "passage", (F.col("piece") == F.col("passage")).alias("whole"))
    )
    hits = spans.join(found.filter("whole"), "span").select(key, "passage_id").distinct()
    two_words = found.filter("NOT whole")
    if not two_words.isEmpty():
        met = spans.join(two_words, "span").select(key, "passage_id").distinct()
        hits = hits.unionByName(_verified(texts, met, passages, key, text, broadcast_bytes))
    return hits


def scan_passages(texts: DataFrame, passages: DataFrame, key: str, text: str = "text",
                  gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, passage_id) for every passage that occurs verbatim in a text.

    Equal to joining on ``contains``, without its nested loop: texts and passages meet on the
    hash of a few consecutive words, and the pairs that meet are verified on the whole text.
    Passages of few words use shorter anchors; those with no inner word go by the vocabulary.
    An empty passage occurs nowhere.

    While the grams of the passages pass the size check they are broadcast and the texts are not
    shuffled for the meeting; beyond it the join is a shuffle join whose hot keys are split at
    run time. ``passages`` is (passage_id, passage), passages distinct; it is read several times,
    so it should be a table or a cheap projection of one.
    """
    sized = passages.filter("passage <> ''").withColumn(
        "_n", F.least(F.size(_inner_tokens(F.col("passage"))), F.lit(gram)))
    lengths = [r["_n"] for r in sized.select("_n").distinct().collect()]  # at most gram + 1 numbers
    found = []
    anchored = sorted(n for n in lengths if n > 0)
    if anchored:
        met = _candidates(texts, sized, key, text, anchored, broadcast_bytes)
        found.append(_verified(texts, met, passages, key, text, broadcast_bytes))
    if 0 in lengths:
        found.append(_short_hits(texts, sized.filter("_n = 0").drop("_n"), key, text, broadcast_bytes))
    if not found:
        none = F.lit(None).cast(passages.schema["passage_id"].dataType).alias("passage_id")
        return texts.filter(F.lit(False)).select(key, none)
    return reduce(DataFrame.unionByName, found)


def _entries(words: DataFrame, case_sensitive: bool) -> DataFrame:
    """(stack, passage, entry): what is looked for in which form of a text; an entry names the list and
    the word, and tells whether the word is outside the lexicon."""
    word = answers.needle(F.col("value"))
    word = word if case_sensitive else F.lower(word)
    outside = (F.col("kind") == "string") & ~F.col("in_lexicon")
    asked = words.filter("kind <> 'other'").withColumn("_w", word)
    stack = F.when(F.contains("_w", F.lit(".")), 1).when(F.contains("_w", F.lit(" ")), 2).otherwise(0)
    forms = F.when(
        F.contains("_w", F.lit("_")), F.array("_w", F.replace("_w", F.lit("_"), F.lit(" ")))
    ).otherwise(F.array("_w"))
    entry = F.struct(
        F.xxhash64("list_name").alias("list"), F.xxhash64(F.xxhash64("list_name"), F.col("value")).alias("word"),
        outside.alias("outside"))
    return asked.select(stack.alias("stack"), F.explode(forms).alias("passage"), entry.alias("entry")).distinct()


def _span_entries(vocabulary: DataFrame, entries: DataFrame) -> DataFrame:
    """(span, entries): the words inside each different run of characters of the texts (span). A word is looked for in the run as
    its stack has it.

    Words and runs meet on the run of a word's letters that fewest words share, and are verified. Long words meet on
    long runs of letters: words that are numbered alike share all short ones. A
    run has as many entries as words fit into it, however many texts it is in.
    """
    n = F.length("passage")
    for i in sorted(WORD_LETTERS):
        n = F.when(F.length("passage") >= i, i).otherwise(n)
    short = entries.withColumn("n", n)
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # as many numbers as WORD_LETTERS and those below
    passages = short.select("stack", "passage", "n").distinct()
    grams = reduce(DataFrame.unionByName, [_letter_grams(passages.filter(F.col("n") == n), "passage", n) for n in lengths])
    shared = grams.groupBy("stack", "gram").agg(F.count("*").alias("shared"))
    # Spark takes grams for as few as words, and would send them to the driver
    anchors = cut_lineage(grams.join(shared.hint("merge"), ["stack", "gram"]).groupBy("stack", "passage").agg(
        F.min_by("gram", F.struct("shared", "gram")).alias("gram")))
    # white space is no part of a run, so the forms of a text are those of its runs
    stacks = sorted(r["stack"] for r in entries.select("stack").distinct().collect())  # at most three numbers
    forms = answers.haystacks(F.col("span"), True)
    formed = vocabulary.select("span", F.inline(F.array(*[
        F.struct(F.lit(i).alias("stack"), F.get(forms, F.lit(i)).alias("form")) for i in stacks])))
    inside = reduce(DataFrame.unionByName, [_letter_grams(formed, "form", n) for n in lengths])
    met = inside.join(side(anchors, F.octet_length("passage") + F.octet_length("gram")), ["stack", "gram"]).filter(F.contains("form", "passage"))
    entries = side(entries, F.octet_length("passage") + ENTRY_BYTES)
    return met.select("stack", "span", "passage").join(entries, ["stack", "passage"]).groupBy("span").agg(
        F.collect_set("entry").alias("entries"))


def entry_sets(texts: DataFrame, words: DataFrame, key: str, text: str = "text",
               case_sensitive: bool = False) -> DataFrame:
    """(key, entries): the words that occur in each text that holds any, as (list, word, outside), where
    ``list`` is the hash of the list's name.

    The texts are read and cut into runs of characters once. Words without white space go by the
    vocabulary of runs, the few others by the passage scan. While the runs that hold a word are few, they are sent to
    the texts, and what travels is one set of entries per text and task; beyond that it is the texts' runs as well, never a row per text and word.
    """
    return _sets(texts, cut_lineage(_entries(words, case_sensitive)), key, text, case_sensitive, ENTRY_BYTES)


def _sets(texts: DataFrame, entries: DataFrame, key: str, text: str, case_sensitive: bool, entry_bytes: int) -> DataFrame:
    """``entry_sets`` for a written table of entries, whatever stands for an entry."""
    spaced = F.col("passage").rlike(r"\s")
    stacks = sorted(r["stack"] for r in entries.select("stack").distinct().collect())  # at most three numbers
    forms = answers.haystacks(F.col(text), case_sensitive)
    hits = []
    single = entries.filter(~spaced & (F.col("passage") != ""))
    if not single.isEmpty():
        plain = F.get(forms, F.lit(0))
        spans = cut_lineage(texts.select(key, F.array_distinct(F.split(plain, r"\s+")).alias("spans")), compression="zstd")
        vocabulary = cut_lineage(spans.select(F.explode("spans").alias("span")).distinct(), compression="zstd")
        found = cut_lineage(_span_entries(vocabulary, single), compression="zstd")
        hits.append(spans.select(key, F.explode("spans").alias("span"))
                    .join(side(found, entries_size("span", entry_bytes)), "span")
                    .select(key, F.explode("entries").alias("entry")))
    for i in stacks:
        mine = entries.filter(spaced & (F.col("stack") == i))
        if mine.isEmpty():
            continue
        searched = texts.select(key, F.get(forms, F.lit(i)).alias("_text"))
        passages = mine.select(F.md5("passage").alias("passage_id"), "passage").distinct()
        met = scan_passages(searched, passages, key, "_text")
        hits.append(met.join(mine.select(F.md5("passage").alias("passage_id"), "entry"), "passage_id").select(key, "entry"))
    if not hits:
        hits.append(texts.filter(F.lit(False)).select(
            key, F.lit(None).cast(entries.schema["entry"].dataType).alias("entry")))
    # one set per text and task is shuffled
    return reduce(DataFrame.unionByName, hits).groupBy(key).agg(F.collect_set("entry").alias("entries"))


def list_parts() -> dict[str, Column]:
    """What a word counts as: expected, outside the lexicon, not a text."""
    return {"expected": F.lit(True), "outside": (F.col("kind") == "string") & ~F.col("in_lexicon"),
            "other": F.col("kind") == "other"}


def list_sizes(words: DataFrame) -> DataFrame:
    return words.groupBy("list_name").agg(
        *[F.count_if(c).alias(f"n_{n}") for n, c in list_parts().items()]
    ).withColumn("list", F.xxhash64("list_name"))


def considered(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """``answers.words_considered`` for lists with a row per word: the words that decide, those outside the lexicon of lists that have
    any, else all. ``sizes`` is that of the lists, a written table."""
    of_list = sizes.select("list", "n_outside").hint("merge")
    return words.withColumn("list", F.xxhash64("list_name")).join(of_list, "list").filter(
        (F.col("n_outside") == 0) | list_parts()["outside"]).drop("list", "n_outside")


def coded_entries(words: DataFrame, lists: DataFrame) -> DataFrame:
    """``_entries`` with a number for each entry, which is what travels for each word of a text: the numbers of its list
    and of its own, and whether the word is outside the lexicon. ``lists`` is (list, number, ..), a written table."""
    entries = cut_lineage(_entries(words, False))
    numbered = with_positions(cut_lineage(entries.select("entry").distinct()))
    code = F.shiftleft("number", WORD_BITS + 1) + F.when(F.col("entry.outside"), 1 << WORD_BITS).otherwise(0) + F.col(POS)
    of_list = lists.select(F.col("list").alias("_list"), "number").hint("merge")
    codes = cut_lineage(numbered.join(of_list, F.col("entry.list") == F.col("_list")).select(
        F.xxhash64("entry").alias("_hash"), "entry", code.alias("code")))
    met = entries.withColumn("_hash", F.xxhash64("entry")).alias("e").join(codes.hint("merge").alias("c"), "_hash").filter(
        F.col("e.entry").eqNullSafe(F.col("c.entry")))
    return cut_lineage(met.select("stack", "passage", F.col("code").alias("entry")))


def numbered_lists(words: DataFrame) -> DataFrame:
    """The sizes of lists, with a ``number`` for each."""
    return cut_lineage(with_positions(cut_lineage(list_sizes(words))).withColumnRenamed(POS, "number"))


def list_verdicts(sets: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """(key, list_name, n_found, n_expected, passed) from the coded words of each text (key, entries), for lists with a hit."""
    n_found, passed = word_rule()
    # counted where the sets are: grouping by text and list needs no further shuffle
    counted = sets.select(key, F.explode("entries").alias("code")).groupBy(
        key, F.shiftright("code", WORD_BITS + 1).alias("number")).agg(
        F.count("*").alias("n_hit"), F.count_if(F.getbit("code", F.lit(WORD_BITS)) == 1).alias("n_outside_hit"))
    return counted.join(lists, "number").select(
        key, "list_name", n_found.alias("n_found"), "n_expected", passed.alias("passed")).filter("n_found > 0")


def word_rule() -> tuple[Column, Column]:
    """(n_found, passed) from the hits and the size of a list: any word outside the lexicon, or all words."""
    n_hit, n_outside_hit, n_other, n_expected = (
        F.coalesce(c, F.lit(0)) for c in ("n_hit", "n_outside_hit", "n_other", "n_expected"))
    any_rule = F.coalesce("n_outside", F.lit(0)) > 0
    n_found = F.when(any_rule, n_outside_hit).otherwise(n_hit + n_other)
    return n_found, F.when(any_rule, n_found > 0).otherwise(n_found == n_expected)


def scan_words_long(texts: DataFrame, words: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``scan_words`` for lists of any length and number: (key, list_name, n_found, n_expected, passed), for
    lists of which a text holds any word.

    ``words`` is (list_name, value, kind, in_lexicon), one row per word; no list is ever one value.
    """
    words = cut_lineage(words)  # read several times below
    lists = numbered_lists(words)
    entries = coded_entries(considered(words, lists), lists)
    return list_verdicts(_sets(texts, entries, key, text, False, CODE_BYTES), lists, key)


def scan_row_texts(texts: DataFrame, rows: DataFrame, key: str, text: str = "text",
                   gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, row_text, n_rows): serialized rows that occur verbatim in a text.

    ``rows`` is (row_text). Equal rows are one passage, counted, so copies never multiply pairs.
    """
    distinct = rows.groupBy(F.col("row_text").alias("passage")).agg(F.count("*").alias("n_rows"))
    passages = cut_lineage(distinct.withColumn("passage_id", F.md5("passage")))
    hits = scan_passages(texts, passages.select("passage_id", "passage"), key, text, gram, broadcast_bytes)
    return hits.join(passages, "passage_id").select(key, F.col("passage").alias("row_text"), "n_rows")


def lexicon_coverage(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Per dataset and feature, the words outside the lexicon, one row each.

    ``words`` is (dataset, feature, value, kind): a feature's distinct values, or the column
    names under the feature ``(columns)``.
    """
    return outside_lexicon(words, lexicon).select("dataset", "feature", "value")
